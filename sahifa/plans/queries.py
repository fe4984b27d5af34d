"""Queries of the engine's own operators over whole tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sahifa.functions import charclasses as C, labels as L, marks as M, text as X, tokens as K
from sahifa.functions.charclasses import duck
from sahifa.operators import chain, metrics, ratelimit, runs, taggers, vocab
from sahifa.plans import chainsql, pipelines
from sahifa.session import read_table, ship_package
from sahifa.sources import corpus, exporters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


# --- pieces of SQL ---------------------------------------------------------

# Spelled out here, so that a wrong class in the operators shows.
_NORM = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}]"
_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NONWS = _WS.replace("[", "[^", 1)
_MARK, _NOTMARK = r"[\x{064B}-\x{0652}\x{0670}]", r"[^\x{064B}-\x{0652}\x{0670}]"
_LETTER = r"[\x{0621}-\x{064A}]"


def _strip(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '{_NORM}', '', 'g')"


def _normalize(t: str) -> str:
    return f"trim(regexp_replace(translate({_strip(t)}, 'آأإٱةىؤئ', 'اااا' || 'هيءء'), '{_WS}+', ' ', 'g'))"


def _words(t: str) -> str:
    return f"regexp_extract_all(coalesce({t}, ''), '{_NONWS}+')"


def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '{duck(pattern)}'))"


def _trimmed(t: str) -> str:
    return f"regexp_replace(coalesce({t}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _split(k: str) -> str:
    part = lambda at, w: f"('0x' || substr(md5({k}), {at}, 8))::bigint * {w}"
    b = f"(({part(1, 36)} + {part(9, 16)} + {part(17, 96)} + {part(25, 1)}) % 100)"
    return f"case when {k} is null then null when {b} < 90 then 'train' when {b} < 95 then 'dev' else 'test' end"


_VOWEL_LIST = "[" + ", ".join(f"'{v}'" for v in C.VOWELS[1:]) + "]"
_ALL_VOWELS = "[" + ", ".join(f"'{v}'" for v in C.VOWELS) + "]"


def _split_marks(t: str) -> str:
    label = f"cast(coalesce(list_position({_VOWEL_LIST}, regexp_extract(g, '{duck(C.VOWEL_SIGN)}')), 0) + case when contains(g, '{C.SHADDA}') then 8 else 0 end as int)"
    return f"list_transform(regexp_extract_all(coalesce({t}, ''), '(?s){_NOTMARK}{_MARK}*'), lambda g: {{'base': substr(g, 1, 1), 'label': {label}}})"


def _tokens(t: str) -> str:
    pieces = f"regexp_extract_all(coalesce({t}, ''), '{_WS}*{_NONWS}+')"
    return f"""(select list({{'idx': cast(i - 1 as int), 'text': w, 'start': cast(e - length(w) as int), 'end': cast(e as int)}} order by i) from
        (select i, w, sum(length(p)) over (order by i) as e from (select unnest(range(1, len(ps) + 1)) as i, unnest(ps) as p, regexp_extract(unnest(ps), '{_NONWS}+$') as w from (select {pieces} as ps))))"""


def _csv(c: str) -> str:
    return f"case when regexp_matches({c}, '{C.FORMULA}') then chr(39) || {c} else {c} end"


# --- text and marks --------------------------------------------------------


@query(f"select w as word, count(*) as n from (select unnest({_words(_normalize('text'))}) as w from documents) group by w")
def word_freq_normalized(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(K.words(X.normalize_arabic(F.col("text")))).alias("word")
    return read_table(spark, sf, "documents").select(words).groupBy("word").agg(F.count("*").alias("n"))


@query(f"select unit_id, {_strip('source')} as bare from unit")
def strip_marks(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "unit").select("unit_id", X.strip_diacritics(F.col("source")).alias("bare"))


@query(f"select doc_id, {_normalize('text')} as norm from documents")
def normalize_fold(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", X.normalize_arabic(F.col("text")).alias("norm"))


@query(f"select source, count(*) as n, sum(case when regexp_matches(coalesce(text, ''), '{duck(C.DIAC_HAS)}') then 1 else 0 end)::bigint as vocalized from documents group by source")
def has_marks_rate(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(X.has_tashkeel(F.col("text")).cast("long")).alias("vocalized"))


@query(
    f"select unit_id, letters, marks, letters >= 60 and marks >= 0.6 * letters as dense from (select unit_id, {_count('output', C.LETTER)}::int as letters, {_count('output', C.MARK_BUILD)}::int as marks from unit)"
)
def mark_density_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("output")
    return read_table(spark, sf, "unit").select("unit_id", X.letter_count(t).alias("letters"), X.mark_count(t).alias("marks"), X.densely_vocalized(t).alias("dense"))


@query(f"select unit_id, array_to_string(list_transform(m, lambda x: x.base), '') as bare, array_to_string(list_transform(m, lambda x: x.label), ',') as labels from (select unit_id, {_split_marks('output')} as m from unit)")
def split_marks_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "unit").select("unit_id", M.split_marks(F.col("output")).alias("m"))
    labels = F.array_join(F.transform("m", lambda x: x["label"].cast("string")), ",")
    return rows.select("unit_id", F.array_join(F.transform("m", lambda x: x["base"]), "").alias("bare"), labels.alias("labels"))


_JOINED = f"array_to_string(list_transform(m, lambda x: x.base || case when x.label > 0 and regexp_matches(x.base, '^{_LETTER}$') then case when x.label >= 8 then '{C.SHADDA}' else '' end || ({_ALL_VOWELS})[(x.label % 8) + 1] else '' end), '')"


@query(f"select unit_id, joined, nfc_normalize(joined) = nfc_normalize(coalesce(output, '')) as same from (select unit_id, output, {_JOINED} as joined from (select unit_id, output, {_split_marks('output')} as m from unit))")
def apply_marks_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "unit").select("unit_id", "output", M.join_marks(M.split_marks(F.col("output"))).alias("joined"))
    same = M.canonical_marks(F.col("joined")) == M.canonical_marks(F.coalesce("output", F.lit("")))
    return rows.select("unit_id", "joined", same.alias("same"))


@query(f"select x.label as label, count(*) as n from (select unnest({_split_marks('output')}) as x from unit) where regexp_matches(x.base, '^{_LETTER}$') group by 1")
def mark_class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "unit").select(F.explode(M.split_marks(F.col("output"))).alias("x")).where(F.col("x.base").rlike(f"^{C.LETTER}$"))
    return x.groupBy(F.col("x.label").alias("label")).agg(F.count("*").alias("n"))


@query(f"select doc_id, {_split('text')} as split from documents")
def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", X.split_of(F.col("text")).alias("split"))


@query(f"select split, count(*) as n from (select {_split('text')} as split from documents) group by split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.split_counts(split_assignment(spark, sf))


@query(f"select source, sum({_count('text', C.SCRIPT)})::bigint as score, sum(length(coalesce(text, '')))::bigint as chars from documents group by source")
def script_score(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").groupBy("source").agg(F.sum(X.script_score(F.col("text"))).alias("score"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query(f"select doc_id, regexp_replace(coalesce(text, ''), '{C.JUNK}', ' ', 'g') as clean from documents")
def junk_removal(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", X.remove_junk(F.col("text")).alias("clean"))


@query(f"select doc_id, {_csv('coalesce(text, ' + chr(39) * 2 + ')')} as cell, replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' ') as md, {_trimmed('regexp_replace(text, ' + chr(39) + '[' + chr(92) + 'r' + chr(92) + 'n]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} as header from documents")
def safe_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return read_table(spark, sf, "documents").select("doc_id", X.csv_safe(t).alias("cell"), X.markdown_cell(F.col("text")).alias("md"), X.clean_header(F.col("text")).alias("header"))


@query("select doc_id, cast(i as int) as n, l as line from (select doc_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as ls from documents))")
def pasted_lines(spark: SparkSession, sf: str) -> DataFrame:
    units = corpus.pasted_units(read_table(spark, sf, "documents"), "doc_id", "text", None, None)
    return units.select("doc_id", "n", F.col("source").alias("line"))


@query(
    r"select doc_id, regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '\x13[^\x14\x15]*[\x14\x15]?', '', 'g'), '[\x14\x15]', '', 'g'), chr(13) || chr(7) || chr(11) || chr(12) || chr(30) || chr(160), repeat(chr(10), 4) || '- '), '[\x00-\x08\x0e-\x1f\x{feff}]', '', 'g') as clean from documents"
)
def word_control_codes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", X.clean_word_text(F.col("text")).alias("clean"))


# --- tokens, blocks, runs --------------------------------------------------


@query(f"select doc_id, len({_words('text')})::int as n_words from documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", K.word_count(F.col("text")).alias("n_words"))


@query(f"select unit_id, t.idx as idx, t.text as word, t.start as start_at, t.end as end_at from (select unit_id, unnest({_tokens('source')}) as t from unit)")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    t = K.explode_once(read_table(spark, sf, "unit"), ["unit_id"], K.tokens(F.col("source")), "t")
    return t.select("unit_id", "t.idx", F.col("t.text").alias("word"), F.col("t.start").alias("start_at"), F.col("t.end").alias("end_at"))


@query(f"select doc_id, cast(b as int) as block, array_to_string(w[b * 220 + 1:b * 220 + 220], ' ') as words from (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 220.0) as bigint))) as b from (select doc_id, {_words('text')} as w from documents))")
def word_blocks_220(spark: SparkSession, sf: str) -> DataFrame:
    cut = read_table(spark, sf, "documents").select("doc_id", F.posexplode(K.blocks(K.words(F.col("text")), 220)).alias("block", "b"))
    return cut.select("doc_id", "block", F.array_join("b", " ").alias("words"))


@query(
    "select pos_id, cast(b as int) as block, array_to_string(list_transform(tokens[b * 120 + 1:b * 120 + 120], lambda x: coalesce(x, '?')), ' ') as tokens, array_to_string(list_transform(tags[b * 120 + 1:b * 120 + 120], lambda x: coalesce(x, '?')), ' ') as tags "
    "from (select pos_id, tokens, tags, unnest(range(0, cast(ceil(len(tokens) / 120.0) as bigint))) as b from pos where len(tokens) = len(tags) and len(tokens) > 0)"
)
def pos_chunks_120(spark: SparkSession, sf: str) -> DataFrame:
    rows = pipelines.pos_rows(read_table(spark, sf, "pos").select("pos_id", "tokens", "tags"))
    return rows.select("pos_id", "block", F.array_join("tokens", " ", "?").alias("tokens"), F.array_join("tags", " ", "?").alias("tags"))


_PAIRS = "select pos_id, i, tokens[i] as word, lower(trim(tags[i])) as code from (select pos_id, tokens, tags, unnest(range(1, len(tokens) + 1)) as i from pos where len(tokens) = len(tags) and len(tokens) > 0)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    good = read_table(spark, sf, "pos").where("size(tokens) = size(tags) and size(tokens) > 0")
    rows = good.select("pos_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("i", "p"))
    return rows.select("pos_id", (F.col("i") + 1).alias("i"), F.col("p.tokens").alias("word"), F.lower(F.trim("p.tags")).alias("code"))


@query(
    f"""with p as ({_PAIRS}), r as (select *, case when i = 1 or lag(code) over w is distinct from code then 1 else 0 end as fresh from p window w as (partition by pos_id order by i)),
    s as (select *, sum(fresh) over (partition by pos_id order by i) - 1 as run from r)
    select pos_id, cast(run as bigint) as run, code, coalesce(string_agg(word, ' ' order by i), '') as text, min(i)::int as first, max(i)::int as last from s group by pos_id, run, code"""
)
def run_merge_segments(spark: SparkSession, sf: str) -> DataFrame:
    return runs.merged_segments(_pairs(spark, sf), ["pos_id"], "i", "code", "word")


_LABELLED = f"""select idx_id, t, case when t.idx = 0 and regexp_matches(t.text, '{C.HNUM}') then 'HNUM' when t.start < sanad_end then 'ISNAD' else 'MATN' end as label
    from (select idx_id, sanad_end, unnest({_tokens('text')}) as t from indexing where sanad_end is not null)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "indexing").where("sanad_end is not null").select("idx_id", "sanad_end", K.tokens(F.col("text")).alias("t"))
    return rows.withColumn("labels", K.let(lambda x: pipelines.rule_labels(x["t"], F.col("sanad_end")), t=F.col("t")))


@query(f"select idx_id, t.idx as idx, t.text as word, label from ({_LABELLED}) where t.idx < 220")
def unit_word_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "indexing").where("sanad_end is not null").select("idx_id", "sanad_end", K.tokens(F.col("text")).alias("t"))
    both = F.arrays_zip(F.slice("t", 1, 220).alias("t"), runs.unit_labels(F.col("t"), F.col("sanad_end")).alias("l"))
    return rows.select("idx_id", F.explode(both).alias("x")).select("idx_id", "x.t.idx", F.col("x.t.text").alias("word"), F.col("x.l").alias("label"))


_SPANS = f"""with l as ({_LABELLED}), n as (select idx_id, count(*) as n from l group by idx_id having count(*) >= 12),
    r as (select l.*, case when t.idx = 0 or lag(label) over w is distinct from label then 1 else 0 end as fresh from l join n using (idx_id) window w as (partition by idx_id order by t.idx)),
    s as (select *, sum(fresh) over (partition by idx_id order by t.idx) as run from r)
    select idx_id, run, min(t.start) as a, max(t.end) as b, label from s group by idx_id, run, label"""


@query(f"select idx_id, a::int as start_at, b::int as end_at, label from ({_SPANS})")
def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    x = K.explode_once(_labelled(spark, sf), ["idx_id"], runs.spans(F.col("t"), F.col("labels")), "s")
    return x.select("idx_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.label")


@query(f"select idx_id, coalesce(sum(case when label = 'ISNAD' then b - a end), 0) >= 30 and coalesce(sum(case when label = 'MATN' then b - a end), 0) >= 40 as usable from (select idx_id, a, b, label from ({_SPANS}) union all select idx_id, 0, 0, null from indexing where sanad_end is not null) group by idx_id")
def usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("idx_id", runs.usable(runs.spans(F.col("t"), F.col("labels"))).alias("usable"))


@query(f"select idx_id, '{{\"file\":\"' || idx_id || '\",\"usable\":' || (coalesce(sum(case when label = 'ISNAD' then b - a end), 0) >= 30 and coalesce(sum(case when label = 'MATN' then b - a end), 0) >= 40)::varchar || ',\"spans\":[' || string_agg('[' || a || ',' || b || ',\"' || label || '\"]', ',' order by a) || ']}}' as payload from ({_SPANS}) group by idx_id")
def spans_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).select("idx_id", F.col("idx_id").cast("string").alias("file"), runs.spans(F.col("t"), F.col("labels")).alias("spans")).where("size(spans) > 0")
    payload = exporters.spans_json(rows, "file", "spans", runs.usable(F.col("spans")))
    keyed = payload.withColumn("idx_id", F.get_json_object("payload", "$.file").cast("long"))
    return keyed.select("idx_id", "payload")


_PACK = """list_reduce(list_concat([''], w), lambda a, x: case when a = '' then x when length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) + 1 > LIMIT then a || chr(10) || x else a || ' ' || x end)"""


@query(f"select doc_id, cast(i as int) as at, x as win from (select doc_id, unnest(ws) as x, unnest(range(0, len(ws))) as i from (select doc_id, string_split({_PACK.replace('LIMIT', '380')}, chr(10)) as ws from (select doc_id, {_words('text')} as w from documents) where len(w) > 0))")
def greedy_windows_380(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", F.posexplode(K.windows(F.col("text"))).alias("at", "win"))


@query(f"select book_id, array_to_string(string_split({_PACK.replace('LIMIT', '13')}, chr(10)), '/') as lines from (select book_id, {_words('title')} as w from books)")
def wrapped_titles(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "books").select("book_id", F.array_join(K.wrap_words(F.col("title"), 12), "/").alias("lines"))


@query(
    f"""select doc_id, cast(i as int) as at, x as text, {_split('x')} as split from (select doc_id, unnest(ws) as x, unnest(range(0, len(ws))) as i from
    (select doc_id, string_split({_PACK.replace('LIMIT', '380')}, chr(10)) as ws from (select doc_id, {_words(f"regexp_replace(text, '{C.JUNK}', ' ', 'g')")} as w from documents) where len(w) > 0))
    where {_count('x', C.LETTER)} >= 60 and {_count('x', C.MARK_BUILD)} >= 0.6 * {_count('x', C.LETTER)}"""
)
def tashkeel_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.vocalized_windows(read_table(spark, sf, "documents"), "doc_id", "text")


_MASKED = r"""array_to_string(list_transform(regexp_extract_all(source, '(?s)﴿[^﴾]*﴾|\{[^}]*\}|.'), lambda p: case when length(p) > 1 then repeat(chr(57344), length(p)) else p end), '')"""


@query(
    f"select unit_id, t.idx as idx, t.text as word from (select unit_id, {_MASKED} as masked, unnest({_tokens('source')}) as t from unit) "
    f"where regexp_matches(t.text, '{_LETTER}') and not regexp_matches(t.text, '{_MARK}') and not contains(substr(masked, t.start + 1, t.end - t.start), chr(57344))"
)
def gap_fill_eligible(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.explode_once(read_table(spark, sf, "unit"), ["unit_id"], runs.gap_fill_eligible(K.tokens(F.col("source")), F.col("source")), "t")
    return rows.select("unit_id", "t.idx", F.col("t.text").alias("word"))


# --- vocabularies, metrics -------------------------------------------------

_CHARS = "select pos_id, i, k, substr(w, k, 1) as item from (select pos_id, i, w, unnest(range(1, length(w) + 1)) as k from (select pos_id, unnest(tokens) as w, unnest(range(1, len(tokens) + 1)) as i from pos))"


@query(f"select item, n, cast(row_number() over (order by n desc, first) + 1 as int) as id from (select item, count(*) as n, min({{'a': pos_id, 'b': i, 'c': k}}) as first from ({_CHARS}) group by item) qualify row_number() over (order by n desc, first) <= 400")
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    chars = read_table(spark, sf, "pos").select("pos_id", F.posexplode("tokens").alias("i", "w")).where("w is not null")
    items = chars.select("pos_id", "i", F.posexplode(F.regexp_extract_all("w", F.lit("(?s)."), F.lit(0))).alias("k", "item"))
    return vocab.build(items, "item", ["pos_id", "i", "k"], 400)


_TAG_VOCAB = f"select code as item, cast(row_number() over (order by n desc, first) + 1 as int) as id from (select code, count(*) as n, min({{'a': pos_id, 'b': i}}) as first from ({_PAIRS}) where code is not null group by code) qualify row_number() over (order by n desc, first) <= 24"


@query(f"select p.pos_id, p.i::int as i, p.code, coalesce(v.id, 1) as id from ({_PAIRS}) p left join ({_TAG_VOCAB}) v on p.code = v.item")
def vocab_encode(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    tags = vocab.build(pairs.where("code is not null"), "code", ["pos_id", "i"], 24)
    return vocab.encode_rows(pairs.select("pos_id", "i", "code"), "code", tags)


@query(
    """select pos_id, array_to_string(list_transform(range(1, length(bare) + 1), lambda k: coalesce(case when length(replace(substr(bare, 1, k - 1), ' ', '')) >= 0 and (k - 1 - length(replace(substr(bare, 1, k - 1), ' ', ''))) < len(tags) then coalesce(tags[k - length(replace(substr(bare, 1, k - 1), ' ', ''))], '?') else 'x' end, '?')), ' ') as tags_of
    from (select pos_id, array_to_string(list_transform(tokens, lambda t: coalesce(t, '')), ' ') as bare, coalesce(tags, []) as tags from pos where tokens is not null)"""
)
def char_tag_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "pos").where("tokens is not null")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return rows.select("pos_id", F.array_join(K.char_tags(F.array_join("tokens", " ", ""), tags), " ", "?").alias("tags_of"))


_LEXICON = f"""with p as ({_PAIRS}), c as (select word, code, count(*) as n, min({{'a': pos_id, 'b': i}}) as first from p group by word, code),
    lex as (select word, code, n from c qualify row_number() over (partition by word order by n desc, first) = 1),
    scored as (select p.pos_id, p.i, p.code as gold, coalesce(lex.code, 'noun') as predicted from p left join lex on p.word = lex.word)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    lexicon = taggers.train_lexicon(pairs, "word", "code", ["pos_id", "i"])
    return taggers.tag_words(pairs, "word", lexicon, "noun").withColumnRenamed("code", "gold")


@query(f"{_LEXICON} select round(1 - sum(case when gold is not distinct from predicted then 0 else 1 end) / greatest(count(*), 1), 9) as accuracy, count(*) as tokens from scored")
def word_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(_scored(spark, sf), "gold", "predicted").withColumn("accuracy", F.round("accuracy", 9))


@query(f"{_LEXICON} select gold, predicted, count(*) as n from scored where gold is distinct from predicted group by gold, predicted order by n desc, min({{'a': pos_id, 'b': i}}) limit 8")
def top_confusions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_confusions(_scored(spark, sf), "gold", "predicted", ["pos_id", "i"])


@query(f"with v as ({_TAG_VOCAB}) select distinct code from ({_PAIRS}) where code is not null and code not in (select item from v)")
def unseen_tags_anti(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    return metrics.unseen(pairs, vocab.build(pairs.where("code is not null"), "code", ["pos_id", "i"], 24), "code")


_ERRORS = f"""with l as ({_LABELLED}), g as (select idx_id, count(*) as n, min(case when label = 'MATN' then t.idx end) as gold, max(label = 'ISNAD') as has from l group by idx_id)
    select idx_id, case when n > 1 then abs(cast(floor(n / 2) as int) - gold) end as error from g where gold is not null and has"""


def _boundary_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Gold boundaries against a baseline that puts every boundary in the middle (none in units of one word)."""
    half = F.transform(K.beside(F.col("t"), n=F.size("t")), lambda x: F.when((x["item"]["idx"] >= F.floor(x["n"] / 2)) & (x["n"] > 1), "MATN").otherwise("ISNAD"))
    return metrics.boundary_errors(_labelled(spark, sf).withColumn("predicted", half), "labels", "predicted")


@query(f"select count(*) as boundaries, round(sum(case when error <= 2 then 1 else 0 end) / greatest(count(*), 1), 9) as within_share, list_sort(list(error) filter (error is not null))[cast(floor(count(error) / 2) as int) + 1]::int as median_error from ({_ERRORS})")
def boundary_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.boundary_scores(_boundary_errors(spark, sf)).withColumn("within_share", F.round("within_share", 9))


_DER = f"""with s as (select {_split_marks('output')} as g, {_split_marks('source')} as p from unit where output is not null and source is not null),
    z as (select g[i] as g, p[i] as p from (select g, p, unnest(range(1, len(g) + 1)) as i from s where array_to_string(list_transform(g, lambda x: x.base), '') = array_to_string(list_transform(p, lambda x: x.base), '')))
    select round(coalesce(sum(case when g.label <> p.label then 1 else 0 end), 0) / greatest(count(*), 1), 9) as der_all, round(coalesce(sum(case when g.label > 0 and g.label <> p.label then 1 else 0 end), 0) / greatest(sum(case when g.label > 0 then 1 else 0 end), 1), 9) as der_marked, count(*) as letters
    from z where regexp_matches(g.base, '^{_LETTER}$')"""


@query(_DER)
def der_all_marked(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "unit").where("output is not null and source is not null").select(M.split_marks(F.col("output")).alias("g"), M.split_marks(F.col("source")).alias("p"))
    same = F.transform("g", lambda x: x["base"]) == F.transform("p", lambda x: x["base"])
    rates = metrics.error_rates(rows.where(same).select(M.letter_errors(F.col("g"), F.col("p")).alias("e")))
    return rates.select(F.round("der_all", 9).alias("der_all"), F.round("der_marked", 9).alias("der_marked"), "letters")


def _label_en(c: str) -> str:
    return f"case {c} " + " ".join(f"when '{e[0]}' then '{e[1]}'" for e in L.POS) + f" else {c} end"


# --- rows and their forms for models ---


@query(f"select unit_id, output from unit where length(array_to_string(list_transform({_split_marks('output')}, lambda x: x.base), '')) >= 20")
def diacritization_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.diacritization_rows(read_table(spark, sf, "unit"), "output").select("unit_id", "output")


@query("select pos_id, split from pos where split = 'test'")
def split_selection(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.rows_of_split(read_table(spark, sf, "pos"), "test").select("pos_id", "split")


@query(f"select idx_id, array_to_string(list_transform({_words('text')}, lambda w: regexp_replace(w, '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06DC}}\\x{{06DF}}-\\x{{06E8}}\\x{{06EA}}-\\x{{06ED}}\\x{{0640}}]', '', 'g')), '|') as words from indexing")
def encoder_words(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "indexing").select("idx_id", F.array_join(K.encoder_words(K.words(F.col("text"))), "|").alias("words"))


_BARE_WORDS = f"list_filter({_words('source')}, lambda w: regexp_matches(w, '{_LETTER}') and not regexp_matches(w, '{_MARK}'))"


@query(
    f"""with recursive w as (select unit_id, ws, len(ws) as n from (select unit_id, {_BARE_WORDS} as ws from unit) where len(ws) > 0),
    s as (select unit_id, ws, n, 1::bigint as i, 0::bigint as chunk, length(ws[1])::bigint + 1 as held from w
      union all select unit_id, ws, n, i + 1, case when held + length(ws[i + 1]) + 1 > 380 then chunk + 1 else chunk end, case when held + length(ws[i + 1]) + 1 > 380 then length(ws[i + 1]) + 1 else held + length(ws[i + 1]) + 1 end from s where i < n)
    select unit_id, chunk::int as chunk, string_agg(ws[i], ' ' order by i) as words from s group by unit_id, chunk"""
)
def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The bare words of each unit in the chunks a diacritizer reads them in."""
    bare = F.filter(K.words(F.col("source")), lambda w: w.rlike(C.LETTER) & ~w.rlike(C.MARK_MODEL))
    rows = read_table(spark, sf, "unit").select("unit_id", F.posexplode(K.context_chunks(bare)).alias("chunk", "words"))
    return rows.select("unit_id", "chunk", F.array_join("words", " ").alias("words"))


@query(f"""with p as (select * from ({_PAIRS}) where word is not null and code is not null), c as (select word, code, count(*) as n, min({{'a': pos_id, 'b': i}}) as first from p group by word, code),
    lex as (select word, code from c qualify row_number() over (partition by word order by n desc, first) = 1),
    line as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as l from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) as ls from documents)),
    w as (select doc_id, l, unnest(ws) as word, unnest(range(len(ws))) as j from (select doc_id, l, {_words('line')} as ws from line)),
    done as (select doc_id, l, string_agg(concat_ws('/', w.word, case when j < 120 then case when lex.word is null then 'noun' else lex.code end else '?' end), ' ' order by j) as output from w left join lex on lex.word = w.word group by doc_id, l)
    select doc_id, string_agg(coalesce(output, line), chr(10) order by l) as output from line left join done using (doc_id, l) group by doc_id""".replace("then case when lex.word is null then 'noun' else lex.code end", "then " + _label_en("coalesce(lex.code, 'noun')")))
def pos_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Tags line by line, blank lines kept."""
    lexicon = taggers.train_lexicon(_pairs(spark, sf).where("word is not null and code is not null"), "word", "code", ["pos_id", "i"])
    return pipelines.infer_lines(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", "pos", "en", lexicon)


# --- labels and exports ----------------------------------------------------


def _label_case(lang: int, c: str) -> str:
    return f"case {c} " + " ".join(f"when '{e[0]}' then '{e[lang]}'" for e in L.POS) + f" else {c} end"


@query(f"select code, {_label_case(1, 'code')} as en, {_label_case(2, 'code')} as ar, count(*) as n from ({_PAIRS}) group by code")
def label_lookup_lang(spark: SparkSession, sf: str) -> DataFrame:
    counted = _pairs(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    return counted.select("code", L.name("pos", F.col("code"), "en").alias("en"), L.name("pos", F.col("code"), "fr").alias("ar"), "n")


@query(f"select pos_id, string_agg(concat_ws('/', word, {_label_case(2, 'code')}), ' ' order by i) as output from ({_PAIRS}) group by pos_id")
def format_pairs(spark: SparkSession, sf: str) -> DataFrame:
    good = read_table(spark, sf, "pos").where("size(tokens) = size(tags) and size(tokens) > 0")
    pairs = F.zip_with("tokens", "tags", lambda w, t: F.struct(w.alias("word"), F.lower(F.trim(t)).alias("code")))
    return good.select("pos_id", L.format_pos(pairs).alias("output"))


@query(f"select pos_id, cast(i - 1 as int) as i, {_csv('word')} as word, {_csv(_label_case(1, 'code'))} as tag, {_csv('code')} as tag_code from ({_PAIRS})")
def pos_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    good = read_table(spark, sf, "pos").where("size(tokens) = size(tags) and size(tokens) > 0")
    pairs = F.zip_with("tokens", "tags", lambda w, t: F.struct(w.alias("word"), F.lower(F.trim(t)).alias("code")))
    rows = exporters.pos_export(good.select("pos_id", F.lit(1).alias("n"), pairs.alias("pairs")), "en", ("pos_id",))
    return rows.drop("line")


@query(
    f"select u.unit_id, u.n as line, {_csv('u.source')} as segment, coalesce(cast(x.n as varchar), '') as narrator_n, coalesce({_csv('x.verb')}, '') as narrator_verb, coalesce({_csv('x.name')}, '') as narrator_name "
    "from unit u left join narrator x on u.unit_id = x.unit_id and x.seg = 0"
)
def narrators_explode_outer(spark: SparkSession, sf: str) -> DataFrame:
    """One row per narrator of a unit's first segment; units without narrators keep a row."""
    none = F.array().cast("array<struct<seg:int,n:int,verb:string,name:string>>")
    found = read_table(spark, sf, "narrator").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("seg", "n", "verb", "name"))).alias("narrators"))
    units = read_table(spark, sf, "unit").join(found, "unit_id", "left").withColumn("narrators", F.coalesce("narrators", none))
    pairs = F.array(F.struct(F.lit("ISNAD").alias("code"), F.col("source").alias("text")))
    rows = exporters.structure_export(units.select("unit_id", "n", pairs.alias("pairs"), "narrators"), "en", ("unit_id",))
    return rows.select("unit_id", "line", "segment", "narrator_n", "narrator_verb", "narrator_name")


@query("select unit_id, seg, cast(row_number() over (partition by unit_id, seg order by n) as int) as dense_n, name from narrator")
def narrator_dense_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.ordinal_rows(read_table(spark, sf, "narrator").withColumnRenamed("n", "given"), ["given"], ["unit_id", "seg"])
    return rows.select("unit_id", "seg", F.col("n").alias("dense_n"), "name")


@query(f"select unit_id, n as line, {_csv('source')} as input, {_csv('coalesce(output, ' + chr(39) * 2 + ')')} as output from unit where regexp_matches(coalesce(source, ''), '{_NONWS}')")
def plain_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return exporters.plain_export(read_table(spark, sf, "unit"), "n", "source", "output", ("unit_id",))


@query("select upload_id, string_agg(coalesce(output, ''), chr(10) order by n, coalesce(output, '')) as body from unit group by upload_id")
def upload_text(spark: SparkSession, sf: str) -> DataFrame:
    return exporters.as_text(read_table(spark, sf, "unit"), ["upload_id"], "n", "output")


@query("select '| ' || title || ' | ' || collection || ' |' as row from books")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    return exporters.markdown_table(read_table(spark, sf, "books"), ["title", "collection"])


@query("select text, kind from (select text, cast(null as varchar) as kind from documents where length(text) between 150 and 4000 union all select title as text, 'heading' as kind from books where length(title) between 15 and 200)")
def union_units_headings(spark: SparkSession, sf: str) -> DataFrame:
    units = read_table(spark, sf, "documents").where(F.length("text").between(150, 4000)).select("text")
    heads = read_table(spark, sf, "books").where(F.length("title").between(15, 200)).select(F.col("title").alias("text"), F.lit("heading").alias("kind"))
    return units.unionByName(heads, allowMissingColumns=True)


@query("select title from books where length(title) between 15 and 200 order by md5('13:' || title) limit 50")
def seeded_titles(spark: SparkSession, sf: str) -> DataFrame:
    heads = read_table(spark, sf, "books").where(F.length("title").between(15, 200)).select("title")
    return corpus.seeded_sample(heads, "title", 50)


# --- chains ----------------------------------------------------------------


_UNITS = "(select unit_id as k, source as t from unit)"


@query(f"with {chainsql.parsed(_UNITS)} select k as unit_id, sanad_end, sanad_end_raw, confidence, flags, n_hops from parse")
def chain_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary, confidence and flags of every unit."""
    parsed = chain.parse_chains(read_table(spark, sf, "unit").select("unit_id", "source"), "source")
    return parsed.select("unit_id", "sanad_end", "sanad_end_raw", "confidence", F.array_join("flags", ",").alias("flags"), F.size("hops").alias("n_hops"))


@query(f"""with {chainsql.parsed(_UNITS)} select k as unit_id, verb, mention, pos::int as pos, start::int as start, "end"::int as "end", verb_start::int as verb_start, verb_end::int as verb_end from hop""")
def chain_hops(spark: SparkSession, sf: str) -> DataFrame:
    return chain.explode_hops(chain.parse_chains(read_table(spark, sf, "unit").select("unit_id", "source"), "source"), "unit_id")


@query(f"""with {chainsql.parsed("(select doc_id as k, text as t from documents where length(text) between 150 and 4000)")}
    select t as text, sanad_end_raw as sanad_end, cast(null as varchar) as kind, {_split('t')} as split from parse join u using (k) where confidence >= 0.9 and sanad_end_raw > 30
    union all select * from (select title, cast(null as int), 'heading', {_split('title')} from books where length(title) between 15 and 200 order by md5('13:' || title) limit 5000)""")
def indexing_dataset(spark: SparkSession, sf: str) -> DataFrame:
    titles = read_table(spark, sf, "books").select(F.col("title").alias("text"))
    return pipelines.build_indexing(read_table(spark, sf, "documents"), "doc_id", "text", titles)


_WORK = f"(select unit_id as k, source as t from unit where regexp_matches(coalesce(source, ''), '{_NONWS}'))"
_PASSED = f"select unit_id, source, source as output from unit where not regexp_matches(coalesce(source, ''), '{_NONWS}')"


def _task(sql: str) -> str:
    return f"select unit_id, source, made.output from ({sql}) as made join unit on k = unit_id union all {_PASSED}"


@query(_task(chainsql.structure_output(_WORK)))
def structure_task(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.run_task(read_table(spark, sf, "unit"), "unit_id", "source", "structure", "en")


@query(f"""with p as (select * from ({_PAIRS}) where word is not null and code is not null), c as (select word, code, count(*) as n, min({{'a': pos_id, 'b': i}}) as first from p group by word, code),
    lex as (select word, code from c qualify row_number() over (partition by word order by n desc, first) = 1),
    w as (select k, unnest(ws) as word, unnest(range(len(ws))) as j from (select k, {_words('t')} as ws from {_WORK})),
    tagged as (select k, string_agg(concat_ws('/', w.word, case when j < 120 then {_label_case(2, "coalesce(code, 'noun')")} else '?' end), ' ' order by j) as output from w left join lex on lex.word = w.word group by k)
    {_task("select k, output from tagged")}""")
def pos_task(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = taggers.train_lexicon(_pairs(spark, sf).where("word is not null and code is not null"), "word", "code", ["pos_id", "i"])
    return pipelines.run_task(read_table(spark, sf, "unit"), "unit_id", "source", "pos", "ar", lexicon)


_FORMS = chainsql.forms("unit", "unit_id", "output")


@query(_task(chainsql.vocalized_output(_WORK, _FORMS, gaps=True)))
def gap_fill_task(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = taggers.train_diacritizer(read_table(spark, sf, "unit"), "output", "unit_id")
    return pipelines.run_task(read_table(spark, sf, "unit"), "unit_id", "source", "tashkeel_gaps", "ar", lexicon)


@query(_task(chainsql.vocalized_output(_WORK, _FORMS, gaps=False)))
def diacritize_task(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = taggers.train_diacritizer(read_table(spark, sf, "unit"), "output", "unit_id")
    return pipelines.run_task(read_table(spark, sf, "unit"), "unit_id", "source", "tashkeel", "ar", lexicon)


# --- limits ----------------------------------------------------------------


def _limit_sql(limit: int, micros: int, expired: str) -> str:
    return f"""with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null),
    s as (select event_id, user_id, k, [us] as held, true as admitted from e where k = 1
      union all
      select event_id, user_id, k, case when len(h) < {limit} then list_append(h, us) else h end, len(h) < {limit} from
        (select e.event_id, e.user_id, e.k, e.us, list_filter(s.held, lambda t: not ({expired.replace('W', str(micros))})) as h from s join e on e.user_id = s.user_id and e.k = s.k + 1))
    select event_id, user_id, admitted from s"""


# Thirty requests a minute never happen in the events table, so the window is a day and more here.
@query(_limit_sql(3, 86_400_000_000, "t < e.us - W"))
def rate_limit_events(spark: SparkSession, sf: str) -> DataFrame:
    return ratelimit.rate_limit(read_table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 86_400.0).select("event_id", "user_id", "admitted")


@query(_limit_sql(2, 172_800_000_000, "e.us - t >= W"))
def feedback_limit_events(spark: SparkSession, sf: str) -> DataFrame:
    return ratelimit.rate_limit(read_table(spark, sf, "events"), "user_id", "ts", "event_id", 2, 172_800.0, inclusive=False).select("event_id", "user_id", "admitted")


def queries() -> dict[str, Query]:
    def shipped(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        return run

    return {name: shipped(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
