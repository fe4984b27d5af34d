"""Variant spellings of names, linked to the register they come from (problem 4).

Every canonical rewriting of a register entry is generated: the parts that a mention may leave
out (father, grandfather, place name, byname), the teknonym in place of the name, "son of" in
place of the name, parts in any order, parts cut to initials, parts with one slip of the pen.
A mention is brought to the same canonical form, rewritings and mentions are exploded to hashed
keys, and an equi-join finds who shares one; what shares a key is checked on the names
themselves. The rarer a rewriting (the fewer entries that have it) the more it says: a mention
is scored by the share its entry has of all entries that share its rewritings, and linked when
the best tier of rewritings it reaches belongs to one entry alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import xxhash
from pyspark.sql import DataFrame, functions as F

from sahifa.llm.words import normalize_text
from sahifa.operators.rowmap import map_rows
from sahifa.session import materialise

# Our own lists (normalized): titles before a name, wishes after it, connectors, teknonym words, kin and others that name nobody.
_TITLES = {"الشيخ", "الامام", "الحافظ", "القاضي", "السيد", "العلامه", "الفقيه", "المحدث", "الاستاذ", "شيخنا", "سيدنا", "الثقه"}
_WISHES = re.compile(r"\s*(?:رضي الله (?:تعالي )?عن(?:ه|ها|هم|هما)|رحمه الله(?: تعالي)?|رحمها الله|رحمهم الله|رحمهما الله|صلي الله عليه وسلم|عليه السلام|حفظه الله|غفر الله له)\s*")
_SON = {"بن", "ابن", "ب.", "بنت"}
_FATHER = {"ابو", "ابا", "ابي"}
_OWNER = {"ذو", "ذي", "ذا"}
_NOBODY = {"رجل", "رجلا", "رجال", "بعض", "اصحابه", "اصحابنا", "جده", "ابيه", "ابوه", "اباه", "امه", "عمه", "عمته", "خاله", "اخيه", "اخوه", "جدته", "امراه", "شيخ", "فلان", "غيره", "قوم"}
_MARKS = re.compile(r"[()\[\]{}«»\"'،,؛;:؟?!…*/\\-]+")
_SLAVE = "عبد"
_MARK_OF_SON = "<"


def tokens_of(name: str | None) -> list[str]:
    """Canonical parts of a name; "" parts never occur. A leading "son of" marks the part after it.

    Compounds ("slave of ...", "father of ...", "owner of ...") are one part however they are
    spaced. Null, empty and nameless mentions (a man, his father) give no parts.
    """
    if not name:
        return []
    plain = _WISHES.sub(" ", " " + _MARKS.sub(" ", normalize_text(name)) + " ")
    words = [w for w in (x if x.rstrip(".") and len(x.rstrip(".")) <= 4 and x.endswith(".") else x.strip(".") for x in plain.split()) if w]
    while words and words[0] in _TITLES:
        words = words[1:]
    parts: list[str] = []
    i, son = 0, False
    while i < len(words):
        w = words[i]
        if w in _SON and not (w == "ب." and (not parts or (i + 1 < len(words) and words[i + 1] in _SON))):
            son = not parts or son
            i += 1
            continue
        if w in _NOBODY:
            return []
        start = i
        if w in _FATHER and i + 1 < len(words):
            i += 1
            w = "ابو"
            if words[i] == _SLAVE and i + 1 < len(words):
                i += 1
                w += _SLAVE
            w += words[i]
        elif w == _SLAVE and i + 1 < len(words):
            i += 1
            w += words[i]
        elif w in _OWNER and i + 1 < len(words):
            i += 1
            w = "ذو" + words[i]
        parts.append((_MARK_OF_SON if son and start == 1 else "") + w)
        son = False
        i += 1
    return parts


def one_part(text: str | None) -> str:
    """A single part (teknonym, byname) of the register in canonical form."""
    return "".join(tokens_of(text))


def entry_forms(full_name: str | None, kunya: str | None, laqab: str | None) -> Iterator[tuple[int, tuple[str, ...]]]:
    """Every rewriting of an entry that says who is meant, as its parts and how many of the first are the ordered line of descent."""
    parts = tokens_of(full_name)
    kunya_part, laqab_part = one_part(kunya), one_part(laqab)
    nisba = parts[-1] if len(parts) > 1 and parts[-1].startswith("ال") else None
    line = parts[:-1] if nisba else parts
    extras = [p for p in (nisba, kunya_part, laqab_part) if p]
    chains: list[tuple[str, ...]] = [tuple(line[:k]) for k in range(len(line) + 1)]
    if len(line) > 1:
        chains += [(_MARK_OF_SON + line[1], *line[2 : 2 + k]) for k in range(len(line) - 1)]
    seen = set()
    for chain in chains:
        for n in range(len(extras) + 1):
            for more in combinations(extras, n):
                if not chain and not ({kunya_part, laqab_part} - {""}) & set(more):
                    continue
                form = chain + more
                if form and (form not in seen):
                    seen.add(form)
                    yield len(chain), form


def in_order(parts: list[str], form: list[str], line: int, known: tuple[tuple[str, str], ...] = ()) -> bool:
    """Whether a mention has the ``line`` first parts of ``form`` (the person, their father, ...) in that order.

    ``known`` pairs parts of the form with the mention's parts that stand for them. Any other
    part that is not there takes the place of the mention's first part that no part of the form
    accounts for.
    """
    stands = dict(known)
    odd = next((i for i, p in enumerate(parts) if p not in form), -1)
    at = [parts.index(stands.get(p, p)) if stands.get(p, p) in parts else odd for p in form[:line]]
    return all(a < b for a, b in zip(at, at[1:]))


def _key(parts: list[str] | tuple[str, ...]) -> str:
    return "|".join(sorted(parts))


def cut_keys(form: tuple[str, ...]) -> Iterator[str]:
    """Keys with one part cut to its first letters and a point, or two parts cut to initials."""

    def cut(part: str, k: int) -> str:
        mark = len(part) - len(part.lstrip(_MARK_OF_SON))
        return part[: mark + k] + "."

    for i, part in enumerate(form):
        for k in range(1, min(4, len(part.lstrip(_MARK_OF_SON)) - 1) + 1):
            yield _key(form[:i] + (cut(part, k),) + form[i + 1 :])
        for j in range(i + 1, len(form)):
            yield _key(form[:i] + (cut(part, 1),) + form[i + 1 : j] + (cut(form[j], 1),) + form[j + 1 :])


def slip_keys(form: tuple[str, ...] | list[str]) -> Iterator[tuple[str, str]]:
    """Keys in which one part lacks one letter (or none), with that part: two parts one slip apart share a key."""
    for i, part in enumerate(form):
        if len(part) < 3 or part.endswith("."):
            continue
        rest = _key([p for k, p in enumerate(form) if k != i])
        for short in {part, *(part[:k] + part[k + 1 :] for k in range(len(part)))}:
            yield f"~{short}~{rest}", part


def cut_slip_keys(form: tuple[str, ...], line: int) -> Iterator[tuple[str, str, str]]:
    """Keys without one part of the line and with a slip in another: ``(key, part with the slip, part left out)``."""
    for i in range(line if len(form) > 1 else 0):
        for key, part in slip_keys(form[:i] + form[i + 1 :]):
            yield "*" + key, part, form[i]


def mention_slip_keys(parts: list[str]) -> Iterator[str]:
    """The same keys of a mention, without its cut part if it has one."""
    cut = [p for p in parts if p.endswith(".")]
    if not cut:
        yield from (key for key, _ in slip_keys(parts))
    elif len(cut) == 1:
        yield from ("*" + key for key, _ in slip_keys([p for p in parts if p != cut[0]]))


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours makes ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


#: Tiers of rewritings, from what says most to what says least; each step weighs a quarter of the one before.
WHOLE, CUT, SLIP, CUT_SLIP = 0, 1, 2, 3
_TIER_STEP = 4.0


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


class _Forms(dict):
    """Register entry ``(full_name, kunya, laqab)`` -> its rewritings ``(line, form)`` in order; bounded."""

    def __missing__(self, entry: tuple[str | None, str | None, str | None]) -> list[tuple[int, tuple[str, ...]]]:
        if len(self) >= 50_000:
            self.clear()
        self[entry] = forms = list(entry_forms(*entry))
        return forms


_FORMS = _Forms()


def register_keys(register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, ref_id, tier, form)`` of whole and cut rewritings, and of those with a slip.

    Keys are hashes and forms are numbers in the order of :func:`entry_forms`; the strings are
    made again for what a mention reaches only.
    """
    columns = register_entries(register)
    # one small file must not mean one task: an entry has hundreds of rewritings
    columns = columns.repartition(register.sparkSession.sparkContext.defaultParallelism, "ref_id")

    def keys(of):
        def run(ids, names, kunyas, laqabs):
            out = [[], [], [], []]
            for ref, *entry in zip(ids, names, kunyas, laqabs):
                for no, (line, form) in enumerate(_FORMS[tuple(entry)]):
                    for tier, key in dict.fromkeys(of(line, form)):
                        for column, value in zip(out, (_hash(key), ref, tier, no)):
                            column.append(value)
            return out

        return map_rows(columns, run, "key long, ref_id int, tier byte, form int", dealt=False)

    def whole(line, form):
        yield WHOLE, _key(form)
        yield from ((CUT, key) for key in cut_keys(form))

    def slips(line, form):
        yield from ((SLIP, key) for key, _ in slip_keys(form))
        yield from ((CUT_SLIP, key) for key, _, _ in cut_slip_keys(form, line))

    return keys(whole), keys(slips)


def register_entries(register: DataFrame) -> DataFrame:
    return register.select(F.col("ref_id").cast("int").alias("ref_id"), "full_name", "kunya", "laqab").where("ref_id is not null")


class _Cuts(dict):
    """Form -> its keys with parts cut short; bounded."""

    def __missing__(self, form: tuple[str, ...]) -> frozenset[str]:
        if len(self) >= 50_000:
            self.clear()
        self[form] = keys = frozenset(cut_keys(form))
        return keys


_CUTS = _Cuts()


def slipped_part(parts: list[str], form: tuple[str, ...]) -> tuple[str, str] | None:
    """The one part in which a mention and a form of the same other parts differ by a slip, of the form and of the mention."""
    if len(parts) != len(form):
        return None
    mine = list(parts)
    theirs = [p for p in form if p not in mine or mine.remove(p)]
    if len(theirs) != 1 or min(len(theirs[0]), len(mine[0])) < 3 or theirs[0].endswith(".") or mine[0].endswith("."):
        return None
    return (theirs[0], mine[0]) if one_slip(mine[0], theirs[0]) else None


def says(parts: list[str], tier: int, line: int, form: tuple[str, ...]) -> bool:
    """Whether a mention of ``parts`` is the rewriting ``form`` of an entry at ``tier``, with the line of descent in its order."""
    if tier == WHOLE:
        return sorted(parts) == sorted(form) and in_order(parts, list(form), line)
    if tier == CUT:
        return _key(parts) in _CUTS[form] and in_order(parts, list(form), line)
    if tier == SLIP:
        slip = slipped_part(parts, form)
        return slip is not None and in_order(parts, list(form), line, (slip, ("", "")))
    cut = next((p for p in parts if p.endswith(".")), None)
    if cut is None:
        return False
    rest = [p for p in parts if p != cut]
    for i in range(line if len(form) > 1 else 0):
        if form[i].startswith(cut[:-1]):
            slip = slipped_part(rest, form[:i] + form[i + 1 :])
            if slip and in_order(parts, list(form), line, (slip, (form[i], cut))):
                return True
    return False


def link_names(names: DataFrame, register: DataFrame) -> DataFrame:
    """``(name, ref_id, tier, score)`` of the distinct ``name`` values that refer to one entry.

    A rewriting says the more the rarer it is: an entry a name reaches at a tier weighs the less
    the lower the tier, and ``score`` is the entry's share of the weight of all entries that
    share the name's rewritings, 1 where no other entry has any of them. Names that fit several
    entries equally well, nameless mentions and names of nobody have no row; null and empty
    names neither.
    """

    def canonical(values):
        kept = [(v, t) for v, t in ((v, tokens_of(v)) for v in values) if t]
        return [[v for v, _ in kept], [t for _, t in kept], [_hash(v) for v, _ in kept], [_hash(_key(t)) for _, t in kept]]

    mentions = materialise(map_rows(names.select("name").where("name is not null").distinct(), canonical, "name string, parts array<string>, id long, key long", dealt=False))
    entries = register_entries(register)
    whole, slipped = register_keys(register)

    def checked(hits: DataFrame, of: DataFrame) -> DataFrame:
        """The hits ``(id, ref_id, tier, form)`` that hold on the strings themselves; equal hashes of others fall out."""

        def run(values, parts, refs, tiers, forms, *entry):
            kept = [i for i in range(len(values)) if says(parts[i], tiers[i], *_FORMS[entry[0][i], entry[1][i], entry[2][i]][forms[i]])]
            return [[c[i] for i in kept] for c in (values, refs, tiers)]

        rows = hits.distinct().join(of.select("id", "name", "parts").hint("merge"), "id").join(entries.hint("merge"), "ref_id")
        return map_rows(rows.select("name", "parts", "ref_id", "tier", "form", "full_name", "kunya", "laqab"), run, "name string, ref_id int, tier byte", dealt=False)

    # the register is small, its rewritings are not: the optimizer sees only the former, so a broadcast is ruled out
    exact = mentions.select("id", "key").join(whole.hint("merge"), "key").select("id", "ref_id", "tier", "form")
    found = materialise(best_of(checked(exact, mentions)))
    left = mentions.join(found.select("name").hint("merge"), "name", "left_anti")

    def explode(ids, parts):
        out = [[], []]
        for i, p in zip(ids, parts):
            for key in set(mention_slip_keys(p)):
                out[0].append(i)
                out[1].append(_hash(key))
        return out

    keys = map_rows(left.select("id", "parts"), explode, "id long, key long", dealt=False)
    near = keys.join(slipped.hint("merge"), "key").select("id", "ref_id", "tier", "form")
    linked = found.where("fits = 1").unionByName(best_of(checked(near, left)).where("fits = 1"))
    return linked.select("name", "ref_id", "tier", "score")


def best_of(candidates: DataFrame) -> DataFrame:
    """``(name, tier, ref_id, fits, score)``: best tier of each name, an entry of it, how many entries reach it, and that entry's share of the weight of all."""
    each = candidates.groupBy("name", "ref_id").agg(F.min("tier").alias("tier"))
    by_tier = each.groupBy("name", "tier").agg(F.min("ref_id").alias("ref_id"), F.count("*").alias("fits"))
    weight = F.pow(F.lit(_TIER_STEP), -F.col("tier"))
    best = by_tier.groupBy("name").agg(F.min(F.struct("tier", "ref_id", "fits")).alias("b"), F.sum(weight * F.col("fits")).alias("all"))
    return best.select("name", "b.tier", "b.ref_id", "b.fits", F.round(F.pow(F.lit(_TIER_STEP), -F.col("b.tier")) / F.col("all"), 6).alias("score"))


SALTS = 8


def linked_rows(rows: DataFrame, register: DataFrame) -> DataFrame:
    """``(tbl, row_id, ref_id, name, full, tier, score)`` of ``(tbl, row_id, name)``: every row whose name is linked.

    Names are matched once each; rows meet them salted, as a few names stand in very many rows.
    ``full`` tells whether the normalized name is that of the entry's full name.
    """
    links = link_names(rows, register)
    full = map_rows(register.select(F.col("ref_id").cast("int").alias("ref_id"), "full_name"), lambda i, n: [i, [normalize_text(x or "") for x in n]], "ref_id int, full string")
    plain = map_rows(links, lambda n, r, t, s: [n, r, t, s, [normalize_text(x) for x in n]], "name string, ref_id int, tier byte, score double, plain string", dealt=False)
    known = materialise(plain.join(full.hint("merge"), "ref_id").select("name", "ref_id", "tier", "score", (F.col("plain") == F.col("full")).alias("full")))
    salted = known.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["name", "salt"]).select("tbl", "row_id", "ref_id", "name", "full", "tier", "score")


def mention_rows(hop: DataFrame, narrator: DataFrame) -> DataFrame:
    """``(tbl, row_id, name)`` of both tables; a hop delivered twice is taken as last delivered."""
    hops = hop.groupBy(F.col("hop_id").alias("row_id")).agg(F.max(F.struct("loaded_at", F.col("mention").alias("name"))).alias("last")).select(F.lit("hop").alias("tbl"), "row_id", "last.name")
    return hops.unionByName(narrator.select(F.lit("narrator").alias("tbl"), F.col("narrator_id").alias("row_id"), "name").distinct())


def variant_links(hop: DataFrame, narrator: DataFrame, register: DataFrame) -> DataFrame:
    """``(tbl, row_id, ref_id)``: rows that name an entry in another spelling than its full name."""
    return linked_rows(mention_rows(hop, narrator), register).where("not full").select("tbl", "row_id", "ref_id")
