"""Same or nearly same records across splits (problem 5).

The similarity counts words in any order, so what is winnowed is a row's words in one canonical
order for all rows: rare words first (by hashed counters of fixed size, made in one pass over
all rows), the word's hash deciding among equals. The fingerprints of a row are the rolling
hashes of its first grams in that order, which are the least ones; a moved word breaks none. A
gram has two words, and is continued while rows that are unrelated would share it with more
than ``PARTNERS`` others, so formulas of a collection are no hot keys. How many grams a row
gives follows from the recall: those that could be taken up by the words one row has alone, and
after them as many as make it certain to ``RECALL`` that two rows at the similarity keep one;
rows too short for that give grams that leave a word out as well. While grams have two words
and a row at most 50, that is no matter of chance at all: among the words both share more stand
side by side than the others can part.

Fingerprints are joined across splits. Rows with the same words are one class per split side and
give their fingerprints once, so copies never multiply in the join. A gram of words that keep
company (the parts of a name) is in far more rows than its words' counts tell, and the pairs it
makes grow with the square of the rows; so the parity bitmaps stand beside the fingerprints, and
pairs whose bitmaps differ too much leave inside the join, before anything is written. The
fingerprints are joined in up to ``PASSES`` parts by their hash, one after the other, each of
which takes its shuffle files with it. Of the pairs left the exact share is taken, and those that reach the similarity are aligned: grams winnowed in the
rows' own order are the seeds, the longest collinear chain of them is extended word by word, and
words that were moved are aligned afterwards wherever they stand.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sahifa.functions import charclasses as C
from sahifa.llm.neardup import _GOLDEN, _mix, flat_words, form_links, keys_of, numbered
from sahifa.llm.samelook import COPIES_EXPANDED, expand_links
from sahifa.llm.words import ranges
from sahifa.operators.rowmap import map_batches
from sahifa.session import discard, materialise

PARTNERS = 32.0
LONG_GRAM = 8
RECALL = 0.999
SKIPS = 3  # kinds of grams: whole ones, and those that leave out one or two words after their first
SEED_GRAM, SEED_WINDOW = 3, 5
BITMAPS = 4  # words of 64 bits
BITS = [f"bits_{k}" for k in range(BITMAPS)]
BIT_SCHEMA = ", ".join(f"{c} long" for c in BITS)
PASSES, PASS_ROWS = 4, 1 << 15  # most parts of the join, rows from which on there is one more
_COUNTERS = 1 << 19  # slots of either of two tables


def side_of(split: Column) -> Column:
    """1 for train, 2 for dev (also written validation) or test, null for none; case and outer blanks mean nothing."""
    name = F.lower(F.regexp_replace(split, f"^{C.WS}+|{C.WS}+$", ""))
    return F.when(name == "train", 1).when(name.isin("dev", "validation", "test"), 2)


def split_name(split: Column) -> Column:
    name = F.lower(F.regexp_replace(split, f"^{C.WS}+|{C.WS}+$", ""))
    return F.when(name == "validation", "dev").otherwise(name)


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("row_id"), side_of(F.col("split")).alias("side"), F.col(text).alias("value")).where("side is not null and row_id is not null")


def _slots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(_COUNTERS - 1)
    return ((words >> np.uint64(44)) & mask).astype(np.int64), ((words >> np.uint64(20)) & mask).astype(np.int64) + _COUNTERS


def word_levels(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Hashed counts of the words of all rows, in quarters of their binary logarithm, and that of the number of rows.

    Two tables of fixed size whatever the input; of a word's two counts the lesser holds.
    """

    def run(batches):
        table = np.zeros(2 * _COUNTERS, dtype=np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            _, _, flat = flat_words(batch.column(0))
            for slots in _slots(flat):
                table += np.bincount(slots, minlength=2 * _COUNTERS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(table[used], n))], names=["slot", "n"])

    counted = rows.select("value").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most 2 * _COUNTERS + 1 rows
    table = np.zeros(2 * _COUNTERS + 1, dtype=np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.round(4 * np.log2(np.maximum(table[:-1], 1))).astype(np.uint8), 4 * math.log2(max(int(table[-1]), 1))


def _level(words: np.ndarray, levels: np.ndarray) -> np.ndarray:
    one, two = _slots(words)
    return np.minimum(levels[one], levels[two])


def canonical_grams(
    words: np.ndarray, sizes: np.ndarray, levels: np.ndarray, rows: float, similarity: float, wanted_rows: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and fingerprint of the least grams of each row's words in canonical order (see the module's docstring), and each row's bitmap.

    Only rows marked in ``wanted_rows`` (None: all) give grams. The bitmap is ``BITMAPS`` words of
    parities of hashed words: two rows' bitmaps never differ in more bits than their words do.

    ``levels`` has the counters and ``rows`` the number of rows, both in quarters of binary
    logarithms. A gram of ``g`` words is kept by a pair at the similarity with a chance of
    ``similarity ** (2 g - 1)``: its words are shared, and none that only the other row has
    stands between them.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    level = _level(words, levels)
    ranked = level.astype(np.uint64) << np.uint64(56) | words >> np.uint64(8)
    order = np.lexsort((ranked, row))
    ranked, share = ranked[order], np.minimum(level[order] - rows, 0.0)
    # equal words stand together now: the second of them is another element than the first
    at = np.arange(len(ranked))
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (row[1:] != row[:-1])
    elements = _mix(words[order] + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _GOLDEN)
    own = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64)  # words one row may have alone
    wanted = math.log(1 / (1 - RECALL))
    weight = np.array([0.0, 0.0, *(-math.log(1 - similarity ** (2 * g - 1)) for g in range(2, LONG_GRAM + 1))])
    bits, part = np.uint64(1) << (elements & np.uint64(63)), (elements >> np.uint64(6)) % np.uint64(BITMAPS)
    bitmaps = np.stack([np.bitwise_xor.reduceat(np.where(part == k, bits, np.uint64(0)), starts) for k in range(BITMAPS)])
    mass = np.zeros(len(sizes)) if wanted_rows is None else np.where(wanted_rows, 0.0, wanted)
    out_rows, out_keys = [], []
    # what a row's first grams leave wanting is looked for further on, then in grams with words left out
    reach = math.ceil(wanted / weight[2])
    for skip, near in ((0, True), (0, False), *((k, None) for k in range(1, SKIPS))):
        rows_left = mass < wanted
        low = np.zeros_like(sizes) if near is not False else own + reach
        high = np.minimum(own + reach, sizes) if near else sizes
        span = np.where(rows_left, np.maximum(np.minimum(high, sizes - 1 - skip) - low, 0), 0)
        here = ranges(starts + low, span)
        if not len(here):
            continue
        of = row[here]
        last = (starts + sizes)[of] - 1
        second = here + 1 + skip
        key = _mix(_mix(elements[here] + np.uint64(skip)) + elements[second])
        partners = rows + share[here] + share[second]
        length = np.full(len(here), 2)
        open_ = np.arange(len(here))
        for k in range(1, LONG_GRAM - 1):
            open_ = open_[(partners[open_] > 4 * math.log2(PARTNERS)) & (second[open_] + k <= last[open_])]
            if not len(open_):
                break
            following = second[open_] + k
            key[open_] = _mix(key[open_] * _GOLDEN + elements[following])
            partners[open_] += share[following]
            length[open_] += 1
        junk = here - starts[of] < own[of]
        gain = np.where(junk, 0.0, weight[length])
        first = np.cumsum(span) - span
        before = np.cumsum(gain) - gain
        before += (mass - np.append(before, 0.0)[np.minimum(first, len(before))])[of]
        chosen = np.flatnonzero(junk | (before < wanted))
        out_rows.append(of[chosen])
        out_keys.append(key[chosen])
        mass += np.bincount(of[chosen], weights=gain[chosen], minlength=len(sizes))
    found, keys = np.concatenate(out_rows or [row[:0]]), np.concatenate(out_keys or [elements[:0]])
    order = np.argsort(found, kind="stable")
    return found[order], keys[order], bitmaps


def winnowed(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and rolling hash of the grams that winnowing selects in the rows' own order.

    In each window of ``SEED_WINDOW`` consecutive grams the one with the least hash, so any run
    of ``SEED_GRAM + SEED_WINDOW - 1`` shared words shares a selected gram.
    """
    n = len(words)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = (starts + sizes)[row]
    padded = np.concatenate([words, np.zeros(SEED_GRAM, dtype=np.uint64)])
    rolling = np.zeros(n, dtype=np.uint64)
    for k in range(SEED_GRAM):
        rolling = _mix(rolling * _GOLDEN + padded[k : k + n])
    opens = np.flatnonzero(np.arange(n) <= ends - SEED_GRAM - SEED_WINDOW + 1)  # grams that open a full window of their row
    if not len(opens):
        return row[:0], row[:0], rolling[:0]
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([rolling, np.full(SEED_WINDOW - 1, ~np.uint64(0))]), SEED_WINDOW)
    chosen = np.unique(opens + windows[opens].argmin(axis=1))
    return row[chosen], chosen - starts[row[chosen]], rolling[chosen]


def fingerprints(rows: DataFrame, levels: np.ndarray, n_rows: float, similarity: float) -> DataFrame:
    """``(row_id, side, bag, bag_too, stored, size, keys, bits_0, ...)`` of rows with enough words.

    ``bag`` and ``bag_too`` are the same for the same words in any order; in a batch the first row of a bag and
    side has the keys, the others none.
    """
    table = rows.sparkSession.sparkContext.broadcast(levels)  # 2 * _COUNTERS bytes

    def run(ids, sides, values):
        kept, sizes, words = flat_words(values)
        if not len(kept):
            return [[] for _ in range(7 + BITMAPS)]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sums = np.stack([_mix(np.add.reduceat(words, starts) + sizes.astype(np.uint64) * _GOLDEN), np.add.reduceat(_mix(words), starts)], axis=1)
        side = sides.take(pa.array(kept))
        first = np.unique(np.column_stack([sums, side.to_numpy().astype(np.uint64)]), axis=0, return_index=True)[1]
        first.sort()
        reps = np.zeros(len(kept), dtype=bool)
        reps[first] = True
        keyed, keys, bitmaps = canonical_grams(words, sizes, table.value, n_rows, similarity, reps)
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(keyed, minlength=len(kept))))).astype(np.int32))
        bags = (pa.array(np.ascontiguousarray(sums[:, k]).view(np.int64)) for k in (0, 1))
        return [ids.take(pa.array(kept)), side, *bags, keys_of(values, kept), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))), *(pa.array(b.view(np.int64)) for b in bitmaps)]

    return map_batches(rows.select("row_id", "side", "value"), run, f"row_id long, side int, bag long, bag_too long, stored binary, size int, keys array<long>, {BIT_SCHEMA}")


def chain_and_align(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> tuple[int, int]:
    """Words covered by the extended collinear chain, and words shared in all once moved words are aligned as well.

    The chain is the longest run of seeds that go up in both rows. From each seed the alignment
    goes on word by word to both sides while words agree; what then remains unaligned on the
    two sides is matched as a multiset.
    """
    seeds = sorted(set(seeds))
    tails: list[int] = []
    links: list[int] = []
    before = [-1] * len(seeds)
    order = sorted(range(len(seeds)), key=lambda i: (seeds[i][0], -seeds[i][1]))
    for i in order:
        y = seeds[i][1]
        k = bisect_left(tails, y)
        before[i] = links[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            links.append(i)
        else:
            tails[k] = y
            links[k] = i
    chain = []
    i = links[-1] if links else -1
    while i >= 0:
        chain.append(seeds[i])
        i = before[i]
    used_a, used_b = set(), set()
    for x, y in reversed(chain):
        while x > 0 and y > 0 and a[x - 1] == b[y - 1] and x - 1 not in used_a and y - 1 not in used_b:
            x, y = x - 1, y - 1
        while x < len(a) and y < len(b) and a[x] == b[y]:
            if x in used_a or y in used_b:
                if not (x in used_a and y in used_b):
                    break
            used_a.add(x)
            used_b.add(y)
            x, y = x + 1, y + 1
    rest: dict[int, int] = {}
    for y, h in enumerate(b):
        if y not in used_b:
            rest[h] = rest.get(h, 0) + 1
    moved = 0
    for x, h in enumerate(a):
        if x not in used_a and rest.get(h, 0):
            rest[h] -= 1
            moved += 1
    return len(used_a), len(used_a) + moved


def single_words(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of the words that stand once in either row: seeds for a pair without a selected gram in common."""
    once_a, once_b = ({h: i for i, h in enumerate(r) if counts[h] == 1} for r, counts in ((a, Counter(a)), (b, Counter(b))))
    return [(i, once_b[h]) for h, i in once_a.items() if h in once_b]


def shared_words(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Words shared, counted with repetition, by the rows of ``a`` and ``b`` side by side."""
    ea, eb = numbered(a, sizes_a)[1], numbered(b, sizes_b)[1]
    row = np.concatenate([np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)])
    both = np.concatenate([ea, eb])
    order = np.lexsort((both, row))
    both, row = both[order], row[order]
    same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])  # an element is once in either row at most
    return np.bincount(row[1:][same], minlength=len(sizes_a))


class SplitOverlap:
    """Overlaps of one table between train and the other splits.

    ``members``: ``(row_id, side, head, rep, copies)``, the least row of the side with the same
    words, the least with the same stored text and the number of the latter's copies;
    ``links``: ``(a, b, size_a, size_b, chained, shared)`` between heads, ``a``
    in train. Rows without a split, null texts and rows of fewer than 15 words are in neither.
    Ids are taken as unique.
    """

    def __init__(self, df: DataFrame, key: str, text: str, similarity: float = 0.8, expanded: int | None = COPIES_EXPANDED) -> None:
        self.similarity, self.expanded = similarity, expanded
        rows = _prepared(df, key, text)
        levels, n_rows = word_levels(rows)
        printed = materialise(fingerprints(rows, levels, n_rows, similarity))
        classes = printed.groupBy("side", "bag", "bag_too", "stored").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies"))
        heads = classes.groupBy("side", "bag", "bag_too").agg(F.min("rep").alias("head"))
        own = F.when(F.col("row_id") == F.col("head"), F.col("bag")).alias("bag")  # of heads only
        members = printed.drop("keys", *BITS).join(classes.hint("merge"), ["side", "bag", "bag_too", "stored"]).join(heads.hint("merge"), ["side", "bag", "bag_too"])
        members = materialise(members.select("row_id", "side", "head", "rep", "copies", own), sweep=True)
        self.members = members.select("row_id", "side", "head", "rep", "copies")
        pairs = self._candidates(printed, members.where("row_id = head").select("side", "bag", "head"), min(PASSES, 1 + int(2 ** (n_rows / 4)) // PASS_ROWS))
        discard(printed)
        self.links = self._aligned(pairs, rows)
        discard(pairs)

    def _candidates(self, printed: DataFrame, heads: DataFrame, passes: int) -> DataFrame:
        """``(a, b)``: pairs of heads that share a fingerprint and whose sizes and bitmaps allow the similarity.

        The join is one of bags: a bag comes once per batch that has it and is made one again
        beside the join, in the same partitioning. Two bags with one ``bag`` stay two heads.
        """

        def keys(side: int, row: str, part: int) -> DataFrame:
            own = printed.where(F.col("side") == side)
            each = own.select(F.explode("keys").alias("key"), F.col("bag").alias(row), *(F.col(c).alias(f"{c}_{row}") for c in ("size", *BITS)))
            return each.where(F.pmod("key", F.lit(passes)) == part).repartition("key").distinct()

        def of(side: int, row: str, head: str) -> DataFrame:
            return heads.where(F.col("side") == side).select(F.col("bag").alias(row), F.col("head").alias(head)).hint("merge")

        longer = F.greatest("size_a", "size_b")
        near = F.least("size_a", "size_b") >= F.lit(self.similarity) * longer - 1e-9
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS), F.lit(0))
        alike = differ <= F.col("size_a") + F.col("size_b") - F.lit(2 * self.similarity) * longer + 1e-6
        parts = []
        for part in range(passes):
            met = keys(1, "a", part).join(keys(2, "b", part).hint("merge"), "key").where(near & alike)
            parts.append(materialise(met.select("a", "b").distinct(), sweep=True))
        met = reduce(DataFrame.unionByName, parts).distinct()
        found = met.join(of(1, "a", "x"), "a").join(of(2, "b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = materialise(found, sweep=True)
        for table in parts:
            discard(table)
        return found

    def _aligned(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The pairs that reach the similarity by their exact share of words, aligned."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()

        def hashes(ids, values):
            kept, sizes, flat = flat_words(values)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            return [ids.take(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))]

        # hashes are made before the semi-join: a word's hash is smaller than the word
        hashed = map_batches(rows.select("row_id", "value"), hashes, "row_id long, words array<long>")
        words = materialise(hashed.join(needed.hint("merge"), "row_id", "left_semi"), sweep=True)
        a, b = (words.select(F.col("row_id").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
        both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        limit = self.similarity

        def run(a_ids, b_ids, was, wbs):
            own = [(c.flatten().to_numpy().view(np.uint64), pc.list_value_length(c).to_numpy().astype(np.int64)) for c in (was, wbs)]
            sizes = np.stack([own[0][1], own[1][1]])
            shared = shared_words(*own[0], *own[1])
            kept = np.flatnonzero(shared >= limit * sizes.max(axis=0) - 1e-9)
            out = [a_ids.take(pa.array(kept)), b_ids.take(pa.array(kept)), sizes[0][kept], sizes[1][kept], [], []]
            parts = []
            for flat, n in own:
                flat, n = flat[ranges((np.cumsum(n) - n)[kept], n[kept])], n[kept]
                row, place, gram = winnowed(flat, n)
                parts.append((np.split(flat.view(np.int64), np.cumsum(n)[:-1]), np.searchsorted(row, np.arange(len(n) + 1)), place.tolist(), gram.tolist()))
            (wa, ra, pa_, ga), (wb, rb, pb, gb) = parts
            for i in range(len(kept)):
                at: dict[int, list[int]] = {}
                for k in range(rb[i], rb[i + 1]):
                    at.setdefault(gb[k], []).append(pb[k])
                seeds = [(pa_[k], y) for k in range(ra[i], ra[i + 1]) for y in at.get(ga[k], ())]
                x, y = wa[i].tolist(), wb[i].tolist()
                chained, total = chain_and_align(x, y, seeds or single_words(x, y))
                out[4].append(chained)
                out[5].append(total)
            return out

        links = map_batches(both.select("a", "b", "wa", "wb"), run, "a long, b long, size_a int, size_b int, chained int, shared int", dealt=False)
        links = materialise(links, sweep=True)
        discard(words)
        return links

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)``, ``id_a < id_b``: rows of train with rows of dev or test.

        Different stored texts are always paired. Up to ``expanded`` copies of one stored text
        (None: any number) are expanded; of more, each copy is paired with the other side's
        representative, and the representative with all of it. ``members`` tells the rest.
        """
        return expand_links(form_links(self.links, self.members, within=False), self.members, self.expanded)

    def records(self, df: DataFrame, key: str) -> DataFrame:
        """``(row_id, split, collection, partners, chained_share, shared_share)`` of every row with a split.

        ``partners`` counts the rows of the other side, each copy; the shares are those of the
        best partner, null without one. No pair is expanded.
        """
        sizes = self.members.groupBy("head").agg(F.count("*").alias("n"))
        longer = F.greatest("size_a", "size_b")

        def of(own: str, other: str) -> DataFrame:
            met = self.links.join(sizes.withColumnRenamed("head", other).hint("merge"), other)
            return met.groupBy(F.col(own).alias("head")).agg(F.sum("n").alias("partners"), F.max(F.col("chained") / longer).alias("chained_share"), F.max(F.col("shared") / longer).alias("shared_share"))

        hit = self.members.select("row_id", "head").join(of("a", "b").unionByName(of("b", "a")).hint("merge"), "head").drop("head")
        rows = df.where(side_of(F.col("split")).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("row_id"), split_name(F.col("split")).alias("split"), "collection")
        return rows.join(hit.hint("merge"), "row_id", "left").withColumn("partners", F.coalesce("partners", F.lit(0)))

    def coverage(self, df: DataFrame, key: str) -> DataFrame:
        """``(split, collection, rows, overlapping, chained_share, pairs)`` per evaluation split and collection.

        ``pairs`` counts each pair of rows, copies included; no pair is expanded.
        """
        rows = self.records(df, key).where("split in ('dev', 'test')")
        return rows.groupBy("split", "collection").agg(F.count("*").alias("rows"), F.count("chained_share").alias("overlapping"), F.round(F.avg("chained_share"), 6).alias("chained_share"), F.sum("partners").alias("pairs"))


def overlap_pairs(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    return SplitOverlap(df, key, text, similarity).pairs()


def overlap_report(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    return SplitOverlap(df, key, text, similarity).coverage(df, key)


def overlap_members(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    """``(row_id, head, rep, copies)`` of the compared rows: what the pairs of large groups of copies follow from."""
    return SplitOverlap(df, key, text, similarity).members.select("row_id", "head", "rep", "copies")


def overlap_records(df: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    return SplitOverlap(df, key, text, similarity).records(df, key)
