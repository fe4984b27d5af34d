"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. The total is the largest one at which every source that
has documents can still give its share with no record used more than ``max_repeats`` times.
Each source's budget is then met by whole rounds of all its documents and a subset for what is
left: documents are counted by exact token length, all lengths give their share of the rest,
and a bounded knapsack over the remaining counts (a bit set of reachable sums) fits the last
tokens. Only the table of lengths reaches that step, never documents. Which documents of a
length are taken follows from a seeded hash.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sahifa.llm.bpe import token_counts
from sahifa.session import materialise

_FINE = 1 << 15  # tokens left to the exact step, at least
_BUCKETS = 256


def _seeded(seed: int, length: int) -> bytes:
    return hashlib.blake2b(f"{seed}:{length}".encode(), digest_size=8).digest()


def fit_budget(counts: dict[int, int], budget: int, seed: int = 13) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to ``budget``, or to the nearest sum below it that the exact step finds.

    ``counts`` has the documents available of each positive length; their total is at least
    ``budget``.
    """
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or total <= 0:
        return {}
    if budget >= total:
        return dict(counts)
    take = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * k for n, k in take.items())
    fine = max(_FINE, 4 * min(counts))
    for n in sorted(counts, key=lambda n: _seeded(seed, n)):  # coarse: one more of each length, in seeded order
        if left - n < fine:
            continue
        more = min(counts[n] - take[n], 1)
        take[n] += more
        left -= n * more
    for n in sorted(counts, reverse=True):  # and whole stretches of a length where one more of each is not enough
        if left > 2 * fine and counts[n] > take[n]:
            more = min(counts[n] - take[n], (left - fine) // n)
            if more > 0:
                take[n] += more
                left -= n * more
    for n in sorted(counts, key=lambda n: _seeded(seed + 2, n)):  # give back where the shares left too little for the exact step
        if left >= fine:
            break
        back = min(take[n], -(-(fine - left) // n))
        take[n] -= back
        left += n * back
    # exact: bounded knapsack, counts split into powers of two, reachable sums as bits of one integer
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in sorted((n for n in counts if n <= left), key=lambda n: _seeded(seed + 1, n)):
        free, k = min(counts[n] - take[n], left // n), 1
        while free > 0:
            k = min(k, free)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


def plan(sized: DataFrame, targets: DataFrame, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """``(lengths, shares)``: documents to take of each source and length, and the budget of each source."""
    wanted = targets.select("source", "target_share", F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats")).where("source is not null and target_share > 0")
    sizes = sized.where("n_tokens > 0").groupBy("source", F.col("n_tokens").alias("length")).agg(F.count("*").alias("n"))
    lengths = materialise(sizes)
    have = lengths.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("available"))
    able = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = able.where("available > 0 and max_repeats > 0")
    whole = live.agg(F.sum("target_share").alias("s"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("t")).first()
    share, total = float(whole["s"] or 0.0), float(whole["t"] or 0.0) * float(whole["s"] or 0.0)
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    effective = F.when(usable, F.col("target_share") / F.lit(share or 1.0)).otherwise(0.0)
    shares = able.withColumn("effective_share", effective).withColumn("budget", F.least(F.round(F.col("effective_share") * F.lit(total)).cast("long"), F.col("available") * F.col("max_repeats")))
    shares = shares.withColumn("rounds", F.when(usable, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
    shares = materialise(shares.withColumn("rest", F.when(usable, F.col("budget") - F.col("rounds") * F.col("available")).otherwise(0).cast("long")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = fit_budget({int(n): int(c) for n, c in zip(pdf["length"], pdf["n"])}, int(pdf["rest"].iloc[0]), seed)
        return pd.DataFrame({"source": pdf["source"], "length": pdf["length"], "take": [taken.get(int(n), 0) for n in pdf["length"]]})

    chosen = lengths.join(shares.where("rest > 0").select("source", "rest"), "source").groupBy("source").applyInPandas(fit, "source string, length long, take long")
    return chosen, shares


class Mix:
    """A selection of ``documents`` in which each source has its target share of all tokens.

    ``selection()``: ``(doc_id, source, n_tokens, copies)``, each chosen record once with the
    number of copies to use. ``shares()``: the shares really reached. Sources without a target
    and documents without tokens (null, empty) are not used; the shares of sources that have a
    target but no tokens are given to the others in proportion (``effective_share``). Repeated
    rows are records of their own; an empty table gives an empty selection and shares of 0.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer_path: str | None = None, seed: int = 13) -> None:
        self.seed = seed
        wanted = targets.select("source").where("target_share > 0").distinct()
        # ids need not be unique: the hash of id and size decides, ties are settled by the rank
        self.sized = materialise(token_counts(documents, tokenizer_path).where("n_tokens > 0").join(wanted, "source", "left_semi").select("doc_id", "source", "n_tokens"))
        self.chosen, self.budgets = plan(self.sized, targets, seed)
        self._selection = None

    def selection(self) -> DataFrame:
        if self._selection is None:
            self._selection = materialise(self._select())
        return self._selection

    def _select(self) -> DataFrame:
        from pyspark.sql import Window as W

        rank = F.xxhash64(F.col("doc_id"), F.lit(self.seed))
        rows = self.sized.withColumnRenamed("n_tokens", "length").withColumn("h", rank).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int"))
        counts = rows.groupBy("source", "length", "bucket").agg(F.count("*").alias("n"))
        # a window over at most _BUCKETS rows for each length of a source, whatever the number of documents
        running = counts.withColumn("upto", F.sum("n").over(W.partitionBy("source", "length").orderBy("bucket")))
        cut = running.join(self.chosen.where("take > 0"), ["source", "length"]).select("source", "length", "bucket", (F.col("take") - (F.col("upto") - F.col("n"))).alias("quota"), "n")
        placed = rows.join(cut.where("quota > 0"), ["source", "length", "bucket"], "left")
        sure = placed.where("quota is null or quota >= n").withColumn("extra", F.when(F.col("quota").isNull(), 0).otherwise(1))
        split = placed.where("quota < n")
        place = F.row_number().over(W.partitionBy("source", "length", "bucket").orderBy("h", "doc_id"))
        edge = split.withColumn("place", place).withColumn("extra", (F.col("place") <= F.col("quota")).cast("int")).drop("place")
        both = sure.unionByName(edge).join(self.budgets.select("source", "rounds"), "source")
        out = both.select("doc_id", "source", F.col("length").alias("n_tokens"), (F.col("rounds") + F.col("extra")).cast("int").alias("copies"))
        return out.where("copies > 0")

    def shares(self) -> DataFrame:
        got = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
        whole = got.agg(F.sum("tokens")).first()[0] or 0
        row = self.budgets.select("source", "target_share", "max_repeats", "effective_share", "available", "budget").join(got, "source", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return row.select(
            "source", "target_share", F.round("effective_share", 6).alias("effective_share"), "available", "budget", zero("tokens"),
            F.round(zero("tokens") / F.lit(whole or 1), 6).alias("reached_share"), zero("records"), "max_repeats", zero("most_copies"),
        )
