"""JSON arrays of any size, read by many tasks each.

A file that is one array has no line ends to cut it at, so it is read as text
with the comma as separator, which Spark cuts into byte ranges like lines. A
comma ends an element only outside strings and one level deep, and what a range
starts with depends on all earlier ones. So there are two passes. The first
reduces every range to its effect: does it hold an odd number of quotes, and how
many brackets stay open if it starts outside a string, and if inside. Running
sums of these over a file's ranges give the state each one starts in. The second
pass joins the pieces between element ends. Elements that cross a range come as
fragments and are put together by a grouping; everything else stays where it was
read. No task holds more than its range and one element.

Works on whatever file system Spark reads from; nothing is opened by Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenewright.session import cut_lineage

#: States of so many ranges are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_RANGES = 200_000
EFFECT = "file string, start bigint, odd int, outside int, inside int, first string"
#: Kinds of text: a whole element, its beginning, its end, and a range inside one.
WHOLE, BEGINNING, END, MIDDLE = range(4)
TEXTS = "file string, start bigint, n bigint, kind int, value string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between commas with their effect on the state: quotes, and brackets left open outside and inside a string."""
    value = F.col("value")
    bare = F.regexp_replace(value, r"\\.", "")  # without escaped characters
    outside = F.regexp_replace("_bare", '"[^"]*(?:"|$)', "")
    inside = F.regexp_replace(F.regexp_replace("_bare", '^[^"]*(?:"|$)', ""), '"[^"]*(?:"|$)', "")

    def opened(text):
        return (F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))).cast("int")

    quotes = F.length("_bare") - F.length(F.replace("_bare", F.lit('"'), F.lit("")))
    return (spark.read.option("lineSep", ",").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value)
            .withColumn("_bare", bare).select(
                "file", "start", "value", (quotes % 2).cast("int").alias("odd"),
                opened(outside).alias("outside"), opened(inside).alias("inside")))


def _runs(batch: pa.RecordBatch):
    """Slices of a batch that belong to one range; a range's pieces are neighbours, in order."""
    file, start = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(start)]):
        if b > a:
            yield batch.column("file")[a].as_py(), int(start[a]), batch.slice(a, b - a)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list] = {}
    for batch in batches:
        for file, start, run in _runs(batch):
            state = found.setdefault((file, start), [0, 0, 0, None])
            odd, out, into = (run.column(c).to_numpy().astype(np.int64) for c in ("odd", "outside", "inside"))
            flipped = (state[0] + np.cumsum(odd) - odd) % 2 == 1
            state[1] += int(np.where(flipped, into, out).sum())
            state[2] += int(np.where(flipped, out, into).sum())
            state[0] = (state[0] + int(odd.sum())) % 2
            if state[3] is None:
                state[3] = (run.column("value")[0].as_py().lstrip("﻿ \t\r\n") or " ")[0]
    rows = [(f, s, *v) for (f, s), v in found.items()]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 6, kinds)],
                                     ["file", "start", "odd", "outside", "inside", "first"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and fragments of every range, from the state it starts in."""
    here, inside, depth, open_, opening, n = None, 0, 0, [], False, 0

    def left_over():
        """What a range leaves open."""
        kind = MIDDLE if opening else BEGINNING
        return [(here[0], here[1], n, kind, ",".join(open_))] if open_ else []

    for batch in batches:
        rows = []
        for file, start, run in _runs(batch):
            if here != (file, start):
                rows += left_over()
                here, open_, n = (file, start), [], 0
                inside, depth = int(run.column("state")[0].as_py()), int(run.column("depth")[0].as_py())
                opening = bool(inside) or depth > 1  # goes on with an element of an earlier range
            odd, out, into = (run.column(c).to_numpy().astype(np.int64) for c in ("odd", "outside", "inside"))
            after = (inside + np.cumsum(odd)) % 2
            level = depth + np.cumsum(np.where((after + odd) % 2 == 1, into, out))
            before = np.concatenate([[depth], level[:-1]])
            first = start == 0 and n == 0 and not open_
            if (before[int(first):] <= 0).any():
                raise ValueError(f"{file} goes on after the end of its array")
            texts = run.column("value").to_pylist()
            if first:
                texts[0] = texts[0].lstrip("﻿ \t\r\n").removeprefix("[")
            if level[-1] <= 0 and not after[-1]:
                texts[-1] = texts[-1].rstrip().removesuffix("]")
            ends = np.flatnonzero((after == 0) & (level <= 1))
            at = 0
            for end in ends.tolist():
                text = ",".join([*open_, *texts[at : end + 1]])
                rows.append((file, start, n, END if opening else WHOLE, text))
                open_, opening, at, n = [], False, end + 1, n + 1
            open_ += texts[at:]
            inside, depth = int(after[-1]), int(level[-1])
        yield _batch(rows)
    if here:
        yield _batch(left_over())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 5, kinds)],
                                      ["file", "start", "n", "kind", "value"])


def range_states(spark: SparkSession, path: str) -> DataFrame:
    """A row per byte range: file, start, its first sign, and the state (inside a string, depth) before and after it."""
    effects = _pieces(spark, path).mapInArrow(_effects, EFFECT)
    order = W.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    flips = effects.withColumn("state", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    change = flips.withColumn("change", F.when(F.col("state") == 1, F.col("inside")).otherwise(F.col("outside")))
    return change.select("file", "start", "first", F.col("state").cast("int").alias("state"),
                         F.coalesce(F.sum("change").over(earlier), F.lit(0)).cast("int").alias("depth"),
                         ((F.col("state") + F.col("odd")) % 2).cast("int").alias("state_after"),
                         F.sum("change").over(order).cast("int").alias("depth_after"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, n, value)``: the JSON text of every element; (start, n) is its order in the file.

    A file that is not one array from its first to its last sign is an error. An
    empty array has no elements.
    """
    states = cut_lineage(range_states(spark, path))
    last = W.partitionBy("file").orderBy(F.desc("start"))
    ends = states.withColumn("_k", F.row_number().over(last))
    bad = ends.where(((F.col("start") == 0) & (F.col("first") != "[")) | (
        (F.col("_k") == 1) & ((F.col("state_after") != 0) | (F.col("depth_after") != 0)))).head()
    if bad:
        raise ValueError(f"{bad['file']} is not one whole JSON array")
    known = states.select("file", "start", "state", "depth")
    pieces = _pieces(spark, path).withColumn("_row", F.monotonically_increasing_id())
    if known.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        placed = pieces.join(F.broadcast(known), ["file", "start"])  # keeps the order of the pieces
    else:
        placed = pieces.join(known, ["file", "start"]).sortWithinPartitions("file", "start", "_row")
    texts = cut_lineage(placed.drop("_row").mapInArrow(_texts, TEXTS))
    parts = texts.where(F.col("kind") != WHOLE)
    at = W.partitionBy("file").orderBy("start", F.col("kind") == BEGINNING)
    grouped = parts.withColumn("_element", F.sum((F.col("kind") == BEGINNING).cast("int")).over(at))
    whole = grouped.groupBy("file", "_element").agg(F.sort_array(F.collect_list(F.struct(  # the fragments of one element
        "start", (F.col("kind") == BEGINNING).cast("int").alias("last"), "n", "value"))).alias("p"))
    joined = whole.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["n"].alias("n"),
                          F.array_join(F.col("p")["value"], ",").alias("value"))
    every = texts.where(F.col("kind") == WHOLE).select("file", "start", "n", "value").unionByName(joined)
    return every.where(F.trim(F.translate("value", "\t\r\n", "   ")) != "")


def read_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of arrays, parsed strictly: an element that does not parse is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return array_elements(spark, path).select(parsed.alias("_record")).select("_record.*")


def write_arrays(df: DataFrame, path: str) -> None:
    """Every partition as one file that is one JSON array, an element a line."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.binary_join_element_wise(",", batch.column(0), "")
            if first:
                text = pa.concat_arrays([pc.binary_join_element_wise("[", batch.column(0).slice(0, 1), ""), text.slice(1)])
            first = False
            yield pa.RecordBatch.from_arrays([text], ["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    options = {"ignoreNullFields": "false"}
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("value")).mapInArrow(
        lines, "value string").write.text(path)
