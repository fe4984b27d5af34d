"""Agreement between gold and predicted labels; all sums, so all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sahifa.operators.vocab import top_counts


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``(accuracy, tokens)``: 1 minus wrong over all; an empty input counts as one word."""
    wrong = F.sum(F.when(F.col(gold).eqNullSafe(F.col(predicted)), 0).otherwise(1))
    n = F.count("*")
    return df.agg((F.lit(1.0) - F.coalesce(wrong, F.lit(0)) / F.greatest(n, F.lit(1))).alias("accuracy"), n.alias("tokens"))


def top_confusions(df: DataFrame, gold: str, predicted: str, ordinal: list[str], k: int = 8) -> DataFrame:
    """The ``k`` most frequent pairs of a gold and another predicted label, ties by first occurrence."""
    wrong = df.where(~F.col(gold).eqNullSafe(F.col(predicted)))
    return top_counts(wrong, [gold, predicted], ordinal, k).select(F.col(gold).alias("gold"), F.col(predicted).alias("predicted"), "n")


def first_report(labels: Column) -> Column:
    """0-based index of the first MATN label, -1 for none."""
    return (F.array_position(labels, "MATN") - 1).cast("int")


def boundary_errors(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``error`` in words per row whose gold labels have both chain and report; null where nothing is predicted."""
    both = df.where(F.array_contains(gold, "ISNAD") & F.array_contains(gold, "MATN"))
    found = first_report(F.col(predicted))
    return both.select(F.when(found >= 0, F.abs(found - first_report(F.col(gold)))).alias("error"))


def boundary_scores(errors: DataFrame, within: int = 2) -> DataFrame:
    """``(boundaries, within_share, median_error)``; a missing prediction is a miss, the median is the upper one.

    The median comes from the histogram of errors (a few values), not from a list of rows.
    """
    histogram = errors.groupBy("error").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("error", "n"))))
    found = F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    hits = F.coalesce(F.sum(F.when(F.col("error") <= within, F.col("n"))), F.lit(0))
    summed = histogram.agg(total.alias("boundaries"), (hits / F.greatest(total, F.lit(1))).alias("within_share"), found.alias("found"), pairs.alias("pairs"))
    # walk the histogram up to the element in the middle
    walk = F.aggregate(
        "pairs",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("m")),
        lambda s, p: F.struct((s["seen"] + p["n"]).alias("seen"), F.when(s["m"].isNull() & (s["seen"] + p["n"] > F.floor(F.col("found") / 2)), p["error"]).otherwise(s["m"]).alias("m")),
        lambda s: s["m"],
    )
    return summed.select("boundaries", "within_share", walk.alias("median_error"))


def error_rates(errors: DataFrame, struct: str = "e") -> DataFrame:
    """``(der_all, der_marked, letters)`` of rows of :func:`sahifa.functions.marks.letter_errors`."""
    s = lambda f: F.coalesce(F.sum(F.col(f"{struct}.{f}")), F.lit(0))
    return errors.agg((s("wrong") / F.greatest(s("letters"), F.lit(1))).alias("der_all"), (s("marked_wrong") / F.greatest(s("marked"), F.lit(1))).alias("der_marked"), s("letters").alias("letters"))


def builder_yield(df: DataFrame, kept: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(kept, 1).otherwise(0)), F.lit(0)).alias("kept"), F.count("*").alias("seen"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))


def unseen(train: DataFrame, vocabulary: DataFrame, item: str) -> DataFrame:
    """Distinct items of ``train`` that the vocabulary does not have."""
    return train.select(item).where(F.col(item).isNotNull()).distinct().join(vocabulary.select(F.col("item").alias(item)), item, "left_anti")
