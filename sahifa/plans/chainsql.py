"""The chain rules once more, in DuckDB's SQL: what the queries over chains are compared with.

Nothing here is shared with the operators. Texts are cut into characters and into runs of word
characters, so word boundaries need no lookaround and offsets no map: they are sums of lengths.
Every constant is spelled out.
"""

from __future__ import annotations

MARK = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}]"
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
VERBS = "('حدثنا', 'حدثني', 'اخبرنا', 'اخبرني', 'انبانا', 'ثنا', 'نا', 'انا', 'ابنا', 'انبا', 'سمعت', 'سمع', 'عن')"
GOING_ON = "('حدثنا', 'حدثني', 'اخبرنا', 'اخبرني', 'انبانا', 'ثنا', 'نا', 'انا', 'ابنا', 'انبا', 'سمعت', 'عن')"
OPENER = r'(?:قال|يقول|سمعت)\s+(?:رسول\s+الله|النبي)|ان\s+(?:رسول\s+الله|النبي)\s|عن\s+النبي\s*صلي|يقول\s*:|قال\s*:\s*"'
TITLES = r"(?:\s*(?:صاحب\s+(?:رسول\s+الله|النبي)|صلي\s+الله\s+عليه\s+وسلم|رضي\s+الله\s+عن(?:ه|ها|هم|هما)|رحمه\s+الله|رحمها\s+الله))+\s*$"
STOPS = r"""،,;؛.!؟?()\[\]{}«»"''"""  # within a literal: the last two are one apostrophe
TRIMMED = " ،:."


def folded(t: str) -> str:
    """The normalized text."""
    return f"trim(regexp_replace(translate(regexp_replace({t}, '{MARK}', '', 'g'), 'آأإٱةىؤئ', 'اااا' || 'هيءء'), '{SPACE}+', ' ', 'g'))"


def characters(source: str) -> str:
    """Common table expressions over ``source (k, t)``: ``kept (k, f, i, after)`` has the raw place of each folded character and of the next one that is no mark."""
    return f"""u as materialized (select k, coalesce(t, '') as t, {folded("coalesce(t, '')")} as n from {source}),
    seen as (select k, c, i, regexp_matches(c, '{SPACE}') as blank from (select k, unnest(cs) as c, unnest(range(len(cs))) as i from (select k, regexp_extract_all(t, '(?s).') as cs from u)) where not regexp_matches(c, '{MARK}')),
    beside as (select k, i, blank, lag(blank) over (partition by k order by i) as was, lead(i) over (partition by k order by i) as after from seen),
    kept as materialized (select k, i, after, row_number() over (partition by k order by i) - 1 as f from beside where not (blank and coalesce(was, true)))"""


def hops(limit: str) -> str:
    """Hops of ``u`` up to the folded place ``limit`` of ``bound (k, e)``: ``hop`` and ``named``, the latter with names of any length."""
    return f"""part as materialized (select u.k, substr(u.n, 1, e::bigint) as n from u join {limit} using (k)),
    run as (select k, w, j, (sum(length(w)) over (partition by k order by j) - length(w))::bigint as place from (select k, unnest(p) as w, unnest(range(len(p))) as j from (select k, regexp_extract_all(n, '{RUNS}') as p from part))),
    verb as (select k, w as verb, place, place + length(w) as stop, row_number() over (partition by k order by place) - 1 as pos, lead(place) over (partition by k order by place) as next from run where w in {VERBS}),
    piece as materialized (select verb.*, regexp_extract(substr(n, stop + 1, coalesce(next, length(n)) - stop), '^[^{STOPS}]*') as cut from verb join part using (k)),
    bare as (select *, length(cut) - length(ltrim(cut, '{TRIMMED}')) as skip, trim(cut, '{TRIMMED}') as name from piece),
    named as materialized (select k, verb, place, stop, pos, stop + skip as first, trim(regexp_replace(regexp_replace(name, '\\s+(?:قال|قالا|قالوا|ان)$', ''), '{TITLES}', ''), '{TRIMMED}') as mention from bare),
    places as materialized (select k, list(i order by f) as starts, list(after order by f) as afters from kept group by k),
    hop as (select named.k, verb, mention, pos, starts[first + 1] as start, coalesce(afters[first + length(mention)], length(u.t)) as "end", starts[place + 1] as verb_start, coalesce(afters[stop], length(u.t)) as verb_end
        from named join u using (k) join places using (k)
        where length(mention) between 2 and 60)"""


def boundaries() -> str:
    """``bound (k, e, opens, speech)`` of ``u``: the folded end of each chain."""
    return f"""word as (select k, w, (sum(length(w)) over (partition by k order by j) - length(w))::bigint as place, lead(w) over (partition by k order by j) as w1, lead(w, 2) over (partition by k order by j) as w2
        from (select k, unnest(p) as w, unnest(range(len(p))) as j from (select k, regexp_extract_all(n, '{RUNS}') as p from u))),
    spoken as (select k, min(place) as speech from word where w in ('قال', 'قالت') and place >= 8 and regexp_matches(w1, '^\\s*:') and not (coalesce(w2, '') in {GOING_ON} and regexp_matches(w1, '^\\s*:\\s*$')) group by k),
    opened as (select u.k, n, speech, case when regexp_matches(n, '{OPENER}') then length(regexp_extract(n, '(?s)^(.*?)(?:{OPENER})', 1)) end as opens from u left join spoken using (k)),
    bound as (select k, opens, speech, case when opens is not null and (speech is null or opens <= speech) then opens when speech is not null then speech else least(length(n), 300) end as e from opened)"""


def parsed(source: str) -> str:
    """All of it: ``parse (k, sanad_end, sanad_end_raw, confidence, flags, n_hops)`` and ``hop``."""
    return f"""{characters(source)}, {boundaries()}, {hops("bound")},
    tally as (select bound.k, count(*) filter (length(mention) between 2 and 60) as good, count(*) filter (mention <> '' and length(mention) not between 2 and 60) as bad, min(place) as early from bound left join named using (k) group by bound.k),
    parse as (select b.k, e::int as sanad_end, case when opens is null and speech is null then -1 else coalesce(kept.i, -1) end::int as sanad_end_raw,
        case when good = 0 then 0.0::double else round(greatest(0.5::double + case when early < 15 then 0.2::double else 0 end + case when opens is not null then 0.3::double when speech is not null then 0.2::double else 0 end - case when bad > 0 then 0.2::double else 0 end, 0), 2) end as confidence,
        array_to_string(list_concat(case when opens is null and speech is not null then ['speech_boundary'] when opens is null then ['no_matn_marker'] else [] end, list_transform(range(bad), lambda x: 'dropped_mention')), ',') as flags,
        good::int as n_hops from bound b join tally using (k) left join kept on kept.k = b.k and kept.f = e)"""


def structure_output(units: str) -> str:
    """``(k, output)`` of ``units (k, t)``: segments by the rules' boundary with the chain of each ISNAD segment below it, in English."""
    return rf"""with p as materialized (with {parsed(units)} select k, t, sanad_end_raw from parse join u using (k)),
    bit as (select k, sanad_end_raw, b, j, sum(length(b)) over (partition by k order by j) - length(b) as place from (select k, sanad_end_raw, unnest(bs) as b, unnest(range(len(bs))) as j from (select k, sanad_end_raw, regexp_extract_all(t, '{SPACE}+|{SPACE.replace("[", "[^", 1)}+') as bs from p))),
    w as (select k, b as w, j, row_number() over (partition by k order by j) - 1 as idx, place, sanad_end_raw from bit where not regexp_matches(b, '^{SPACE}')),
    l as (select k, w, j, case when idx = 0 and regexp_matches(w, '^\p{{Nd}}+[-–.)\]]*$') then 'HNUM' when place < sanad_end_raw then 'ISNAD' else 'MATN' end as code from w),
    turn as (select *, case when code is distinct from lag(code) over (partition by k order by j) then 1 else 0 end as new from l),
    seg as materialized (select k, code, seg, string_agg(w, ' ' order by j) as text from (select *, sum(new) over (partition by k order by j) - 1 as seg from turn) group by k, code, seg),
    h as (with {characters("(select {'k': k, 'seg': seg} as k, text as t from seg where code = 'ISNAD')")}, bound as (select k, length(n) as e from u), {hops("bound")}
        select k.k as k, k.seg as seg, string_agg('      ' || no || '. ' || v || ' — ' || name, chr(10) order by no) as lines from
            (select k, row_number() over (partition by k order by pos) as no, substr(t, verb_start + 1, verb_end - verb_start) as v, substr(t, start + 1, "end" - start) as name from hop join u using (k)) group by all),
    shown as (select seg.k, seg.seg, '[' || case code when 'HNUM' then 'hadith number' when 'ISNAD' then 'isnād' when 'MATN' then 'matn' end || '] ' || text || coalesce(chr(10) || '    narrators:' || chr(10) || lines, '') as part from seg left join h on h.k = seg.k and h.seg = seg.seg)
    select k, string_agg(part, chr(10) order by seg) as output from shown group by k"""


BARE = r"[\x{064B}-\x{0652}\x{0670}]"


def vocalized_output(rows: str, lexicon: str, gaps: bool) -> str:
    """``(k, output)`` of ``rows (k, t)``: words by ``lexicon (word, label)``; with ``gaps`` only bare words outside quotations."""
    word = SPACE.replace("[", "[^", 1)
    free = f"regexp_matches(b, '[\\x{{0621}}-\\x{{064A}}]') and not regexp_matches(b, '{BARE}') and not exists (select 1 from quoted q where q.k = bit.k and bit.place < q.upto and bit.place + length(b) > q.place)" if gaps else "true"
    return f"""with r as (select k, coalesce(t, '') as t from {rows}),
    bit as (select k, b, j, sum(length(b)) over (partition by k order by j) - length(b) as place from (select k, unnest(bs) as b, unnest(range(len(bs))) as j from (select k, regexp_extract_all(t, '{SPACE}+|{word}+') as bs from r))),
    quoted as (select * from (select k, q, sum(length(q)) over (partition by k order by j) - length(q) as place, sum(length(q)) over (partition by k order by j) as upto
        from (select k, unnest(qs) as q, unnest(range(len(qs))) as j from (select k, regexp_extract_all(t, '(?s)[^﴿{{]+|﴿[^﴾]*﴾|\\{{[^}}]*\\}}|.') as qs from r))) where length(q) > 1 and q[1] in ('﴿', '{{')),
    chosen as (select k, j, b, case when regexp_matches(b, '^{word}') and {free} then regexp_replace(b, '{BARE}', '', 'g') end as word from bit),
    filled as (select k, string_agg(coalesce(label, chosen.word, b), '' order by j) as output from chosen left join ({lexicon}) as lex on lex.word = chosen.word group by k)
    select k, output from filled"""


def forms(table: str, key: str, text: str) -> str:
    """``(word, label)``: the most frequent vocalized form of each bare word, ties by first occurrence."""
    return f"""select word, label from (select word, label, row_number() over (partition by word order by count(*) desc, min({{'a': place, 'b': j}})) as best from
        (select {key} as place, unnest(fs) as label, unnest(range(len(fs))) as j, regexp_replace(unnest(fs), '{BARE}', '', 'g') as word from (select {key}, regexp_extract_all(coalesce({text}, ''), '{SPACE.replace("[", "[^", 1)}+') as fs from {table}))
        where regexp_matches(label, '{BARE}') group by word, label) where best = 1"""
