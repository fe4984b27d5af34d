"""Pairs of rows that look the same but are stored in other characters (problem 2)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sahifa.llm.oneform import one_form
from sahifa.llm.words import stored_key, stored_texts
from sahifa.operators.rowmap import map_batches
from sahifa.session import materialise

COPIES_EXPANDED = 64


def with_one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(row_id, raw, form)``: the stored text (tokens joined by one space) and its one form; null texts count as empty."""

    def run(ids, texts):
        raw = stored_texts(texts)
        return [ids, raw, [one_form(t) for t in raw]]

    return map_batches(df.select(F.col(key).cast("long").alias("row_id"), text), run, "row_id long, raw string, form string")


def look_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(row_id, look, stored)``: 128-bit keys of the one form and of the stored text; rows with nothing visible are left out.

    Only keys travel, so long texts cost no more to compare than short ones.
    """

    def run(ids, texts):
        raw = stored_texts(texts)
        forms = [one_form(t) for t in raw]
        kept = [i for i, form in enumerate(forms) if form]
        return [ids.take(pa.array(kept, type=pa.int64())), [stored_key(forms[i]) for i in kept], [stored_key(raw[i]) for i in kept]]

    return map_batches(df.select(F.col(key).cast("long").alias("row_id"), text), run, "row_id long, look binary, stored binary")


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(row_id, look, rep, copies)`` of rows whose look is stored in more than one way.

    ``rep`` is the least row stored equally and ``copies`` their number. Looks stored in one way
    leave before any join, by a minimum and a maximum that combine before the shuffle.
    """
    keys = materialise(look_keys(df, key, text))
    shared = keys.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("look")
    kept = keys.where("row_id is not null").join(shared.hint("merge"), "look", "left_semi")
    classes = kept.groupBy("look", "stored").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies"))
    return materialise(kept.join(classes.hint("merge"), ["look", "stored"]).select("row_id", "look", "rep", "copies"))


def same_look_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(row_id, class_id, rep, copies)``: one row per row that looks like one stored otherwise; rows of one look share ``class_id``."""
    members = look_classes(df, key, text)
    least = members.groupBy("look").agg(F.min("rep").alias("class_id"))
    return members.join(least.hint("merge"), "look").select("row_id", "class_id", "rep", "copies")


def same_look_pairs(df: DataFrame, key: str, text: str, expanded: int | None = COPIES_EXPANDED) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: rows with one look that are not stored equally.

    Rows stored equally are one class and form no pair; only classes are joined. Classes of up
    to ``expanded`` copies (None: of any number) are expanded; of a larger class each copy is
    paired with the other class's representative, so no link between different texts is lost
    and the result stays in proportion to the rows; :func:`same_look_members` has every row's
    class. Null ids are in no pair.
    """
    members = look_classes(df, key, text)
    reps = members.where("row_id = rep").select("look", "rep")
    links = reps.withColumnRenamed("rep", "a").join(reps.withColumnRenamed("rep", "b").hint("merge"), "look").where("a < b").select("a", "b")
    return expand_links(links, members, expanded)


def expand_links(links: DataFrame, members: DataFrame, expanded: int | None = COPIES_EXPANDED) -> DataFrame:
    """Pairs of rows from ``links`` ``(a, b)`` between representatives of classes and ``members`` ``(row_id, rep, copies)``."""
    whole = F.lit(True) if expanded is None else F.col("copies") <= expanded
    few = members.where(whole | (F.col("row_id") == F.col("rep"))).select("row_id", "rep").hint("merge")
    pairs = links.join(few.toDF("x", "a"), "a").join(few.toDF("y", "b"), "b").select("x", "y")
    if expanded is not None:
        many = members.where((F.col("copies") > expanded) & (F.col("row_id") != F.col("rep"))).select("row_id", "rep").hint("merge")
        more_a = links.join(many.toDF("x", "a"), "a").select("x", F.col("b").alias("y"))
        more_b = links.join(many.toDF("y", "b"), "b").select(F.col("a").alias("x"), "y")
        pairs = pairs.unionByName(more_a).unionByName(more_b)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
