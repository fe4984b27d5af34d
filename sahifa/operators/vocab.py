"""Vocabularies as DataFrames, and counts with ties settled by first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PAD, UNKNOWN = 0, 1


def top_counts(df: DataFrame, items: list[str], ordinal: list[str], k: int | None = None) -> DataFrame:
    """``items..., n, first``: counts, most frequent first, ties by the least ``ordinal`` (a top-k, so the limit is the feature)."""
    counted = df.groupBy(*items).agg(F.count("*").alias("n"), F.min(F.struct(*ordinal)).alias("first"))
    ordered = counted.orderBy(F.desc("n"), F.asc("first"))
    return ordered.limit(k) if k else ordered


def build(df: DataFrame, item: str, ordinal: list[str], max_size: int) -> DataFrame:
    """``(item, n, id)``: ids from 2 on in order of frequency, ties by first occurrence; 0 and 1 are pad and unknown.

    The numbering window runs over at most ``max_size`` rows: the top-k comes first.
    """
    top = top_counts(df, [item], ordinal, max_size)
    return top.withColumn("id", (F.row_number().over(W.orderBy(F.desc("n"), F.asc("first"))) + 1).cast("int")).select(F.col(item).alias("item"), "n", "id")


def as_map(vocabulary: DataFrame) -> Column:
    """A literal map of a vocabulary whose size is bounded by ``build``'s ``max_size``."""
    rows = vocabulary.select("item", "id").collect()
    return F.create_map(*[F.lit(x) for r in rows for x in (r["item"], r["id"])]) if rows else F.create_map().cast("map<string,int>")


def inverse(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("id", "item")


def encode_rows(df: DataFrame, item: str, vocabulary: DataFrame) -> DataFrame:
    """Adds ``id`` by a left join; items the vocabulary does not have are unknown."""
    return df.join(vocabulary.select(F.col("item").alias(item), "id"), item, "left").withColumn("id", F.coalesce("id", F.lit(UNKNOWN)))
