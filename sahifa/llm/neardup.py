"""Near-duplicate records with small edits, insertions or moved words (problem 3).

Two rows are alike when they share at least ``similarity`` of the words of the longer one,
counted with repetition and in any order. A row is the set of its numbered words (the second
"قال" of a row is another element than the first), so that share is a set overlap; and an
overlap of ``s`` of the longer row means a Jaccard similarity of at least ``s / (2 - s)``.

HyperMinHash registers: for each salted hash the least value over a row's elements is kept as
its number of leading zeros and the top ``MANTISSA`` bits after them, 16 bits in all. (Rows
are short, so the buckets are salted passes; buckets of one pass would mostly stay empty.)

1. rows with equal elements form one class, in it rows with the same stored text are copies;
   only one row of a class goes on;
2. bands of whole registers are the join keys; with each goes a compressed form of ``SKETCH``
   registers, two bits of the leading zeros and two of the mantissa. Pairs of a band whose
   agreement, with the chance agreement of such codes taken out, estimates a Jaccard similarity
   well below the bound leave inside the join, before anything is written;
3. what remains is verified exactly on the elements, which are fetched for those rows only.

The number of registers in a band grows with the logarithm of the number of rows and the number
of bands follows from the recall wanted at the bound, so random partners stay in proportion to
the rows at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sahifa.llm.samelook import COPIES_EXPANDED
from sahifa.llm.words import _ALNUM, Tokens, raw_words, stored_key, stored_texts
from sahifa.operators.rowmap import map_batches
from sahifa.session import materialise

MANTISSA = 10
WORDS = 2  # 64-bit words of compressed registers that go along with a band
SKETCH = 16 * WORDS  # registers in them
LEAST_WORDS = 15
_SLACK = 4.0  # standard errors by which an estimate may fall below the bound
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Token -> 64-bit hashes of its plain words, bounded."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        plain = map(_ALNUM.__getitem__, raw_words(token))
        self[token] = value = tuple([xxhash.xxh3_64_intdigest(w) | 1 for w in plain if w])
        return value


_HASHES = _Hashes()


def flat_words(column: pa.Array, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the rows of an Arrow column (texts or arrays of tokens) with at least ``least`` words: kept positions, sizes, and all hashes one row after the other."""
    sizes, flat, _ = Tokens(column).spread(_HASHES.__getitem__)
    fits = sizes >= least
    return np.flatnonzero(fits), sizes[fits], flat[np.repeat(fits, sizes)]


def numbered(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of many rows sorted row by row, and their elements: the second of a word is another than the first."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = words[np.lexsort((words, row))]
    at = np.arange(len(words))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return words, _mix(words + nth.astype(np.uint64) * _GOLDEN)


def numbered_words(column: pa.Array, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of the rows with at least ``least`` words: kept positions, starts, and the element hashes one row after the other."""
    kept, sizes, flat = flat_words(column, least)
    if not len(kept):
        return kept, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return kept, np.concatenate(([0], np.cumsum(sizes)[:-1])), numbered(flat, sizes)[1]


def keys_of(column: pa.Array, kept: np.ndarray) -> pa.Array:
    """128-bit keys of the stored texts of the kept rows."""
    return pa.array([stored_key(t) for t in stored_texts(column.take(pa.array(kept)))], type=pa.binary())


def registers(elements: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` HyperMinHash registers of each row: leading zeros and mantissa of the least hash."""
    salts = _mix(np.arange(1, count + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    least = np.empty((count, len(starts)), dtype=np.uint64)
    for k in range(count):
        least[k] = np.minimum.reduceat(elements * salts[k], starts)
    # the exponent of a float is the number of leading zeros, its fraction the bits after them
    return ((least.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)) & np.uint64(0xFFFF)).astype(np.uint16).T


def plan_bands(rows: int, similarity: float, recall_at_bound: float = 0.999) -> tuple[int, int]:
    """Registers in a band and number of bands for so many rows."""
    bound = similarity / (2 - similarity)
    width = max(4, round(math.log10(max(rows, 1))) - 1)
    return width, math.ceil(math.log(1 - recall_at_bound) / math.log(1 - min(bound, 0.999) ** width))


def compressed(regs: np.ndarray) -> list[np.ndarray]:
    """Four bits of each of the first ``SKETCH`` registers, 16 registers to a 64-bit word: the two low bits of the leading zeros and of the mantissa."""
    code = ((regs[:, :SKETCH] >> MANTISSA & 3) << 2 | regs[:, :SKETCH] & 3).astype(np.uint64)
    place = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return [(code[:, k : k + 16] << place).sum(axis=1, dtype=np.uint64) for k in range(0, SKETCH, 16)]


def chance_agreement(n: int = 64) -> float:
    """How often the compressed registers of two unrelated rows agree.

    The least of ``n`` hashes has ``z`` leading zeros with chance ``(1 - 2**-(z+1))**n -
    (1 - 2**-z)**n``; their two low bits must agree, and the mantissa's two bits agree in a
    quarter of the cases. The result hardly depends on ``n``.
    """
    at = [(1 - 2.0 ** -(z + 1)) ** n - (1 - 2.0**-z) ** n for z in range(60)]
    return sum(sum(at[k::4]) ** 2 for k in range(4)) / 4


def sketches(df: DataFrame, key: str, text: str, width: int, bands: int) -> DataFrame:
    """``(row_id, bag, stored, size, bands, code_0, ...)`` of the rows with enough words."""
    count = max(SKETCH, width * bands)

    def run(ids, values):
        kept, starts, elements = numbered_words(values)
        if not len(kept):
            return [[] for _ in range(5 + WORDS)]
        sizes = np.diff(np.append(starts, len(elements)))
        regs = registers(elements, starts, count)
        keys = np.empty((len(kept), bands), dtype=np.uint64)
        for b in range(bands):
            value = np.full(len(kept), b + 1, dtype=np.uint64)
            for k in range(b * width, (b + 1) * width):
                value = _mix((value ^ regs[:, k].astype(np.uint64)) * _GOLDEN)
            keys[:, b] = value
        one, two = np.add.reduceat(elements, starts), np.add.reduceat(_mix(elements ^ _GOLDEN), starts)
        bag = np.stack([one, two], axis=1).tobytes()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(kept) + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        bags = [bag[i : i + 16] for i in range(0, len(bag), 16)]
        return [ids.take(pa.array(kept)), pa.array(bags, type=pa.binary()), keys_of(values, kept), pa.array(sizes.astype(np.int32)), lists, *(pa.array(c.view(np.int64)) for c in compressed(regs))]

    return map_batches(
        df.select(F.col(key).cast("long").alias("row_id"), text).where("row_id is not null"), run,
        f"row_id long, bag binary, stored binary, size int, bands array<long>, {', '.join(f'code_{k} long' for k in range(WORDS))}",
    )


def least_agreeing(similarity: float) -> int:
    """Least number of agreeing compressed registers that a pair at the bound still has, ``_SLACK`` standard errors down.

    A register agrees when its least element is shared (the Jaccard similarity) and else by
    chance: the estimate of the similarity is the agreement with the chance taken out.
    """
    bound, chance = similarity / (2 - similarity), chance_agreement()
    agree = bound + (1 - bound) * chance
    return math.floor(SKETCH * agree - _SLACK * math.sqrt(SKETCH * agree * (1 - agree)))


def class_candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: pairs of class representatives of a band whose estimated similarity reaches the bound."""
    codes = [f"code_{k}" for k in range(WORDS)]

    def side(row: str) -> DataFrame:
        return reps.select(F.explode("bands").alias("band"), F.col("head").alias(row), *(F.col(c).alias(f"{c}_{row}") for c in ("size", *codes)))

    def differing(c: str):
        apart = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 1))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 2))
        return F.bit_count(apart.bitwiseAND(F.lit(0x1111111111111111)))

    differ = sum((differing(c) for c in codes), F.lit(0))
    near = (F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & (differ <= SKETCH - least_agreeing(similarity))
    return side("a").join(side("b").hint("merge"), "band").where(near).select("a", "b").distinct()


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs whose exact share of words reaches ``similarity``; elements are made for rows in a pair only."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    source = df.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("value"))

    def run(ids, values):
        kept, starts, elements = numbered_words(values)
        offsets = np.append(starts, len(elements)).astype(np.int32) if len(kept) else np.zeros(1, dtype=np.int32)
        return [ids.take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))]

    # elements are made before the semi-join: a word's hash is smaller than the word
    elements = materialise(map_batches(source, run, "row_id long, elements array<long>").join(needed.hint("merge"), "row_id", "left_semi"))
    a = elements.select(F.col("row_id").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("row_id").alias("b"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(shared >= F.lit(similarity) * F.greatest(F.size("ea"), F.size("eb")) - 1e-9).select("a", "b")


class NearDuplicates:
    """Copy classes and verified links of one table.

    ``members``: ``(row_id, head, rep, copies)`` of every row with enough words: the least row with
    the same words, the least with the same stored text and the number of the latter's copies;
    ``links``: pairs of heads. Null and short texts are in neither; ties and repeated
    rows share a class; other columns of the input are ignored. Ids are taken as unique.
    """

    def __init__(self, df: DataFrame, key: str, text: str, similarity: float = 0.8, expanded: int | None = COPIES_EXPANDED) -> None:
        self.expanded = expanded
        width, bands = plan_bands(df.count(), similarity)
        sketched = materialise(sketches(df, key, text, width, bands))
        classes = sketched.groupBy("bag", "stored").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies"))
        heads = classes.groupBy("bag").agg(F.min("rep").alias("head"))
        self.members = materialise(sketched.select("row_id", "bag", "stored").join(classes.hint("merge"), ["bag", "stored"]).join(heads.hint("merge"), "bag").select("row_id", "head", "rep", "copies"))
        reps = sketched.join(self.members.where("row_id = head").select("row_id").hint("merge"), "row_id", "left_semi").withColumnRenamed("row_id", "head")
        candidates = materialise(class_candidates(reps, similarity))
        self.links = materialise(verified(candidates, df, key, text, similarity))

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)``: all pairs of alike rows.

        Different stored texts are always paired, by their representatives. Up to ``expanded``
        copies of one stored text (None: any number) are expanded; more are given by their
        representative: each copy is paired with it, and it alone is paired with other texts.
        ``groups`` has each row's representative, from which all other pairs follow.
        """
        whole = F.lit(True) if self.expanded is None else F.col("copies") <= self.expanded
        speakers = self.members.where(whole | (F.col("row_id") == F.col("rep"))).select("row_id", "rep").hint("merge")
        a = speakers.select(F.col("rep").alias("a"), F.col("row_id").alias("x"))
        b = speakers.select(F.col("rep").alias("b"), F.col("row_id").alias("y"))
        across = form_links(self.links, self.members, within=True).join(a, "a").join(b, "b").select("x", "y")
        several = self.members.where("copies > 1")
        few = several.where(whole).select("rep", "row_id")
        within = few.select("rep", F.col("row_id").alias("x")).join(few.select("rep", F.col("row_id").alias("y")).hint("merge"), "rep").where("x < y").select("x", "y")
        star = several.where(~whole & (F.col("row_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("row_id").alias("y"))
        return across.unionByName(within).unionByName(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``(row_id, group_id, links, copies, rep)``: one row per row with enough words.

        Its connected group, the number of links of its class of equal words, and the number and
        representative of the rows with its stored text.
        """
        labels = connected_labels(self.links)
        degree = self.links.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("degree"))
        sized = self.members.join(labels.withColumnRenamed("rep", "head").hint("merge"), "head", "left").join(degree.hint("merge"), "head", "left")
        return sized.select("row_id", F.coalesce("label", "head").alias("group_id"), F.coalesce("degree", F.lit(0)).alias("links"), "copies", "rep")


def form_links(links: DataFrame, members: DataFrame, within: bool) -> DataFrame:
    """Pairs ``(a, b)`` of representatives of stored texts from ``links`` between heads; ``within``: those under one head as well."""
    forms = members.where("row_id = rep").select("head", "rep").hint("merge")
    across = links.select("a", "b").join(forms.toDF("a", "x"), "a").join(forms.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not within:
        return across
    return across.unionByName(forms.toDF("head", "a").join(forms.toDF("head", "b"), "head").where("a < b").select("a", "b"))


def connected_labels(links: DataFrame, rounds: int = 200) -> DataFrame:
    """``(rep, label)``: least id of each node's component, by alternating large-star and small-star rounds.

    Each round is a grouped minimum and a join; a node's neighbours are never gathered. Ends when
    a round changes nothing.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "rep")
    return nodes.unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("label")).distinct().join(nodes.select("rep"), "rep", "left_anti"))


def near_duplicate_pairs(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    return NearDuplicates(df, key, text, similarity).pairs()


def near_duplicate_groups(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    return NearDuplicates(df, key, text, similarity).groups()


