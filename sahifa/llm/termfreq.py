"""Frequency of every distinct term, and marks on the rare and the common (problem 6).

Terms are counted once per batch where they are read, so a term that stands in a third of all
rows leaves each batch as one partial count. Partial counts are partitioned by bits of the
term's hash: the first bits choose the shuffle partition, and in a task the next bits choose
one of ``FAN_OUT`` files on disk whenever more than ``rows_in_memory`` partial counts arrive.
A file that is still too large is split again by the bits after those; each part that fits is
aggregated by DuckDB, out of core. No part ever holds more than one hash prefix.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sahifa.llm.words import Tokens, terms
from sahifa.operators.rowmap import map_batches
from sahifa.session import shared_folder

FAN_BITS = 4
FAN_OUT = 1 << FAN_BITS
SPLIT_BITS = 43  # of 63: those above choose the shuffle partition
_PARTIAL = "field string, term string, hash long, n_occurrences long, n_rows long"
_ARROW = pa.schema([("field", pa.string()), ("term", pa.string()), ("hash", pa.int64()), ("n_occurrences", pa.int64()), ("n_rows", pa.int64())])


def _label(tag: str) -> list[str]:
    tag = tag.strip().lower()
    return [tag] if tag else []


def _counted(column: pa.Array, of: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms of a batch, their occurrences and their rows; each spelling is looked at once."""
    tokens = Tokens(column)
    number: dict[str, int] = {}
    sizes, ids, _ = tokens.spread(lambda t: [number.setdefault(w, len(number)) for w in of(t)], np.int64)
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(number), 1) + ids)
    return list(number), np.bincount(ids, minlength=len(number)), np.bincount(pairs % max(len(number), 1), minlength=len(number))


def partial_counts(df: DataFrame) -> DataFrame:
    """One row per batch, field and term: occurrences and rows, of ``tokens`` and of ``tags``."""
    import xxhash

    def run(tokens, tags):
        out = [[], [], [], [], []]
        for field, column, of in (("tokens", tokens, terms), ("tags", tags, _label)):
            found, total, held = _counted(column, of)
            out[0] += [field] * len(found)
            out[1] += found
            out[2] += [xxhash.xxh3_64_intdigest(field + "\x1f" + w) >> 1 for w in found]
            out[3] += total.tolist()
            out[4] += held.tolist()
        return out

    return map_batches(df.select("tokens", "tags"), run, _PARTIAL)


def _aggregate(table: pa.Table, scratch: str, memory: str) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": scratch})
    try:
        con.register("part", table)
        query = "select field, term, any_value(hash) as hash, cast(sum(n_occurrences) as bigint) as n_occurrences, cast(sum(n_rows) as bigint) as n_rows from part group by field, term"
        found = con.sql(query).to_arrow_table()
        return found.cast(_ARROW)
    finally:
        con.close()


def _radix(table: pa.Table, shift: int) -> Iterator[tuple[int, pa.Table]]:
    digit = pc.bit_wise_and(pc.shift_right(table["hash"], shift), FAN_OUT - 1)
    for d in range(FAN_OUT):
        part = table.filter(pc.equal(digit, d))
        if part.num_rows:
            yield d, part


def radix_totals(batches: Iterator[pa.RecordBatch], scratch: str, rows_in_memory: int, memory: str, shift: int = 0) -> Iterator[pa.Table]:
    """Totals of partial counts, spilling by hash bits ``shift`` and up when they do not fit."""
    held: list[pa.RecordBatch] = []
    count = 0
    files: dict[int, tuple[object, str]] = {}

    def spill() -> None:
        nonlocal held, count
        for d, part in _radix(pa.Table.from_batches(held, _ARROW), shift):
            if d not in files:
                path = os.path.join(scratch, f"{uuid.uuid4().hex}.arrow")
                files[d] = (pa.ipc.new_file(path, _ARROW), path)
            files[d][0].write_table(part)
        held, count = [], 0

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            if count > rows_in_memory and shift + FAN_BITS <= SPLIT_BITS:
                spill()
    if not files:
        if held:
            yield _aggregate(pa.Table.from_batches(held, _ARROW), scratch, memory)
        return
    if held:
        spill()
    for writer, path in files.values():
        writer.close()
        with pa.memory_map(path) as source:
            reader = pa.ipc.open_file(source)
            yield from radix_totals((reader.get_batch(i) for i in range(reader.num_record_batches)), scratch, rows_in_memory, memory, shift + FAN_BITS)
        os.remove(path)


def term_frequencies(df: DataFrame, rows_in_memory: int = 1_000_000, memory: str = "256MB") -> DataFrame:
    """``(field, term, n_occurrences, n_rows)`` of every distinct term of ``tokens`` and ``tags``.

    Null arrays, null or blank tokens and tags hold no term; words without a letter are none; a
    row counts once per term however often it repeats it; repeated rows each count. An empty
    table gives no rows. ``rows_in_memory`` bounds the partial counts held by one task.
    """
    shared = shared_folder(df.sparkSession)
    place = shared.removeprefix("file://") if shared.startswith("file://") else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if place:  # files of this task only, in the shared folder
            os.makedirs(place, exist_ok=True)
        # without a mounted shared folder Spark's own scratch folders of the executor take them
        scratch = tempfile.mkdtemp(prefix="radix_", dir=place or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        try:
            for table in radix_totals(batches, scratch, rows_in_memory, memory):
                yield from table.select(["field", "term", "n_occurrences", "n_rows"]).combine_chunks().to_batches(50_000)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    parts = partial_counts(df)
    spread = parts.repartition(F.shiftright(F.col("hash"), SPLIT_BITS))  # the highest bits; lower ones split a task's share
    return spread.mapInArrow(run, "field string, term string, n_occurrences long, n_rows long")


def marked_terms(df: DataFrame, rare_below: int = 3, common_above: float = 0.45) -> DataFrame:
    """All terms with ``mark``: ``rare`` in fewer rows than ``rare_below``, ``common`` in more than that share of all rows, else null.

    Rows of all kinds count for the share, those without tokens as well.
    """
    n_all = df.count()
    rows = F.col("n_rows")
    mark = F.when(rows < rare_below, "rare").when(rows > F.lit(common_above) * F.lit(n_all), "common")
    return term_frequencies(df).withColumn("mark", mark)
