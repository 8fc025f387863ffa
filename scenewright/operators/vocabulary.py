"""Vocabularies, and texts as token ids.

Lists are looked up a chunk of rows at a time: a task numbers the distinct
values of a chunk, only these are joined to the vocabulary, and the numbers are
replaced by what was found. A frequent token is one row a chunk, not one a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from scenewright.functions.tokens import MASK, PAD, tokenize
from scenewright.operators.joins import null_safe_join
from scenewright.operators.ranking import global_rank
from scenewright.session import cut_lineage, scratch_folder

#: Values of a chunk; one row may have more.
CHUNK_VALUES = 1_000_000


def build_vocab(df: DataFrame, text: str, min_freq: int = 1) -> DataFrame:
    """``(token, id)``: padding 0, mask 1, then tokens in code point order."""
    counted = df.select(F.explode(tokenize(F.col(text))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"))
    kept = counted.where((F.col("n") >= min_freq) & ~F.col("token").isin(PAD, MASK)).select("token")
    ranked = global_rank(cut_lineage(kept), ["token"], "id").select("token", (F.col("id") + 2).alias("id"))
    special = df.sparkSession.createDataFrame([(PAD, 0), (MASK, 1)], "token string, id bigint")
    return special.unionByName(ranked)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ``(key, values)``: the distinct values in a row of their own, then every row as numbers of these."""
    for batch in batches:
        key, values = batch.column(0), batch.column(1)
        ends = values.offsets.to_numpy()
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_VALUES, side="right")) - 1)
            some = values.slice(at, end - at)
            coded = some.flatten().dictionary_encode()
            bounds = np.append(0, np.cumsum(np.where(some.is_null(), 0, some.value_lengths().fill_null(0).to_numpy())))
            numbers = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), coded.indices)
            chunk = uuid.uuid4().int >> 65
            names = ["_chunk", batch.schema.names[0], "_numbers", "_distinct"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.nulls(1, key.type), pa.nulls(1, numbers.type),
                 pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)], names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(end - at, chunk)), key.slice(at, end - at), numbers,
                 pa.nulls(end - at, pa.list_(coded.dictionary.type))], names)
            at = end


def _looked_up(df: DataFrame, key: str, values: str, table: DataFrame, unknown: Column | None = None) -> DataFrame:
    """``(key, _found)``: every value of a list replaced by ``_to`` of the row of ``table`` with that ``_from``.

    Lists without values are empty. Rows of one key are merged by position.
    """
    given = df.select(key, values)
    chunks = StructType([StructField("_chunk", LongType()), StructField(key, given.schema[key].dataType),
                         StructField("_numbers", ArrayType(IntegerType())),
                         StructField("_distinct", given.schema[values].dataType)])
    at = scratch_folder(df.sparkSession, "chunks")
    given.mapInArrow(_numbered, chunks).write.parquet(at)
    coded, again = (df.sparkSession.read.schema(chunks).parquet(at) for _ in range(2))
    words = again.where("_distinct IS NOT NULL").select(F.col("_chunk").alias("_of"), F.posexplode("_distinct").alias("_i", "_from"))
    to = F.col("_to") if unknown is None else F.coalesce("_to", unknown)
    found = words.join(table.select("_from", "_to"), "_from", "left").groupBy("_of").agg(
        F.array_sort(F.collect_list(F.struct("_i", to.alias("_to"))))["_to"].alias("_to"))
    rows = coded.where("_numbers IS NOT NULL").select("_chunk", key, "_numbers")
    kind = ArrayType(table.schema["_to"].dataType)

    def replaced(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        keys, numbers = left.column(key), left.column("_numbers").combine_chunks()
        flat = numbers.flatten()
        if right.num_rows:
            flat = right.column("_to").combine_chunks().flatten().take(flat)
        else:  # a chunk without values
            flat = pa.nulls(len(flat), right.schema.field("_to").type.value_type)
        ends = np.append(0, np.cumsum(numbers.value_lengths().to_numpy())).astype(np.int32)
        return pa.Table.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "_found"])

    out = rows.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(
        replaced, StructType([StructField(key, given.schema[key].dataType), StructField("_found", kind)]))
    repeated = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if repeated.isEmpty():
        return out
    marked = cut_lineage(null_safe_join(out, repeated.withColumn("_again", F.lit(True)), [key], "left"))
    placed = F.transform("_found", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    merged = marked.where("_again").groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(placed)))["x"].alias("_found"))
    return marked.where("_again IS NULL").select(key, "_found").unionByName(merged)


def encode(df: DataFrame, vocab: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """``(key, ids)``; an unknown token is an error unless ``strict`` is off. No tokens, no ids."""
    words = vocab.select(F.col("token").alias("_from"), F.col("id").alias("_to"))
    unknown = F.raise_error(F.concat(F.lit("unknown token: "), F.col("_from"))).cast("bigint") if strict else None
    tokens = df.select(key, tokenize(F.col(text)).alias("_tokens"))
    return _looked_up(tokens, key, "_tokens", words, unknown).select(key, F.col("_found").alias("ids"))


def decode(df: DataFrame, vocab: DataFrame, key: str, ids: str) -> DataFrame:
    """``(key, decoded)``: tokens joined by blanks."""
    words = vocab.select(F.col("id").alias("_from"), F.col("token").alias("_to"))
    return _looked_up(df, key, ids, words).select(key, F.array_join("_found", " ").alias("decoded"))
