"""Readers for samples, logs and summary documents."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from scenewright.session import scratch_folder
from scenewright.sources.tree import find_files, system, task_count

SAMPLE = "prompt STRING, scene ARRAY<ARRAY<INT>>, caption STRING"
DIRECTED = ("sample ARRAY<ARRAY<INT>>, data STRUCT<entrance_direction:STRING,"
            "exit_direction:STRING>")
RUN_LOG = ("epoch INT, loss DOUBLE, lr DOUBLE, step BIGINT, timestamp STRING, val_loss DOUBLE, "
           "_corrupt_record STRING")


#: Files up to this size are read whole, many by one task; larger ones by Spark's text reader, which splits their lines.
SMALL = 32 << 20
#: Bytes of files that a task is dealt.
DEALT = 64 << 20
TEXTS = "file_path string, kind string, value string, error string"


def _strict(batches):
    """(path, error) of files that are not exactly one JSON value."""
    for batch in batches:
        bad = []
        for path, text in zip(batch["file_path"], batch["value"]):
            try:
                json.loads(text)
            except ValueError as e:
                bad.append((path, str(e)))
        yield pd.DataFrame(bad, columns=["file_path", "error"])


def _kind(line: str) -> str:
    """``whole`` or ``lines``, from the first line that is not blank."""
    return "whole" if line.startswith("[") or line.startswith("{") and not line.endswith("}") else "lines"


def _broken(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def _first_line(source) -> str:
    """The first line of a large file that is not blank."""
    letters, held, done = codecs.getincrementaldecoder("utf-8")("replace"), "", False
    while not done:
        data = source.read(1 << 20)
        done = not data
        lines = _broken(held + letters.decode(data, done))
        held = lines.pop()
        for line in [*lines, held] if done else lines:
            if line.strip(" "):
                return line.strip(" ")
    return ""


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of small JSON-lines files, other small files as one text; of large files only the kind."""
    names = ["file_path", "kind", "value", "error"]

    def rows():
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, inner, _ = system(path)
                with found.open_input_stream(inner) as source:
                    if size > SMALL:
                        first = _first_line(source)
                        if first:
                            yield path, f"large {_kind(first)}", None, None
                        continue
                    text = source.read().decode(errors="replace")
                lines = _broken(text)
                first = next((x.strip(" ") for x in lines if x.strip(" ")), "")
                if first and _kind(first) == "lines":
                    for line in lines:
                        if line.strip(" "):
                            yield path, "lines", line, None
                elif first:
                    try:
                        json.loads(text)
                    except ValueError as e:
                        yield path, "whole", None, str(e)
                    else:
                        yield path, "whole", text, None

    held, room = [], 0
    for row in rows():
        held.append(row)
        room += len(row[2] or "")
        if len(held) == 5000 or room > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)


def _not_one_value(path: str, error: str) -> ValueError:
    return ValueError(f"{unquote(path)} is neither JSON lines nor one JSON value: {error}")


def _dealt(spark: SparkSession, path: str) -> DataFrame | None:
    """Texts of all files, read by tasks that are dealt many files; none if Spark has to list the path itself."""
    try:
        system(path)
    except (pa.ArrowException, ValueError, OSError):  # a store that only Spark reads
        return None
    files = find_files(spark, path)
    total = files.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("nested").alias("nested")).head()
    if not total["n"] or total["nested"]:  # nothing there, or folders that may stand for columns
        return None
    tasks = max(task_count(spark), -(-(total["bytes"] or 0) // DEALT))
    at = f"{scratch_folder(spark, 'texts')}/texts"
    files.select("path", "bytes").repartition(tasks, "path").mapInArrow(_contents, TEXTS).write.parquet(at)
    return spark.read.parquet(at)


def _by_format(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(lines of JSON-lines files, texts of other JSON files) as ``file_path, value``, none if there are no such files.

    Decided for every file by its first line that is not blank. A file of the
    second kind that is not one JSON value as a whole is an error, for the
    reader would stop at the end of the first value.
    """
    texts = _dealt(spark, path)
    if texts is None:
        lines = spark.read.text(path).select(
            "_metadata.file_path", F.trim("value").alias("v"),
            F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at")).where("v <> ''")
        first = lines.groupBy("file_path").agg(F.min_by("v", "at").alias("v"))
        found = first.select("file_path", (F.col("v").startswith("[") | (
            F.col("v").startswith("{") & ~F.col("v").endswith("}"))).alias("spread")).collect()  # a row per file
        large = {kind: sorted(unquote(r["file_path"]) for r in found if r["spread"] == (kind == "whole"))
                 for kind in ("lines", "whole")}
    else:
        bad = texts.where("error IS NOT NULL").head()
        if bad:
            raise _not_one_value(bad["file_path"], bad["error"])
        found = texts.where("kind LIKE 'large %'").select("file_path", "kind").collect()  # large files are few
        large = {kind: sorted(r["file_path"] for r in found if r["kind"] == f"large {kind}") for kind in ("lines", "whole")}
    if large["whole"]:
        bad = spark.read.text(large["whole"], wholetext=True).select("_metadata.file_path", "value").mapInPandas(
            _strict, "file_path string, error string").head()
        if bad:
            raise _not_one_value(bad["file_path"], bad["error"])
    have = set() if texts is None else {r["kind"] for r in texts.select("kind").distinct().collect()}
    out = []
    for kind in ("lines", "whole"):
        part = texts.where(F.col("kind") == kind).select("file_path", "value") if kind in have else None
        if large[kind]:
            rest = spark.read.text(large[kind], wholetext=kind == "whole").select("_metadata.file_path", "value")
            part = rest if part is None else part.unionByName(rest)
        out.append(part)
    return out[0], out[1]


def _parse(reader: DataFrameReader, texts: DataFrame) -> DataFrame:
    """What Spark's JSON reader makes of texts; a text that is an array is a row per element."""
    spark = texts.sparkSession
    strings = getattr(texts.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.json(strings), spark)


def _check_lines(lines: DataFrame) -> None:
    bad = lines.select("file_path", F.trim("value").alias("v")).where("v <> ''").where(F.try_parse_json("v").isNull()).head()
    if bad:
        raise ValueError(f"{unquote(bad['file_path'])} has a line that is no JSON: {bad['v'][:80]}")


def read_samples(spark: SparkSession, path: str, directed: bool = False, drop_empty: bool = True
                 ) -> DataFrame:
    """Samples from JSON arrays or JSON lines, file by file; a line that is no JSON is an error."""
    lines, others = _by_format(spark, path)
    if lines is not None:
        _check_lines(lines)
    schema = DIRECTED if directed else SAMPLE
    parts = [_parse(spark.read.schema(schema), x) for x in (lines, others) if x is not None]
    df = parts[0] if parts else spark.read.schema(schema).json([])
    for part in parts[1:]:
        df = df.unionByName(part)
    scene = "sample" if directed else "scene"
    return df.where(F.size(scene) > 0) if drop_empty else df


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """``(position, scene)`` from a file that is one array of id grids."""
    text = spark.read.text(path, wholetext=True)
    grids = F.from_json("value", "ARRAY<ARRAY<ARRAY<INT>>>")
    return text.select(F.posexplode(grids).alias("position", "scene"))


def read_jsonl(spark: SparkSession, path: str, schema: str = RUN_LOG, bad_lines: str = "skip"
               ) -> DataFrame:
    """JSON lines; malformed ones are skipped, raised or kept (``_corrupt_record``)."""
    mode = {"skip": "DROPMALFORMED", "raise": "FAILFAST", "keep": "PERMISSIVE"}[bad_lines]
    if bad_lines != "keep":
        schema = schema.replace(", _corrupt_record STRING", "")
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(number, caption, scores)`` of records whose key is ``Caption <n>``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    entry = F.from_json("value", "MAP<STRING,STRING>")
    parsed = lines.select(entry.alias("m")).where("m IS NOT NULL")
    named = F.map_entries(F.map_filter("m", lambda k, v: k.rlike(r"^Caption \d+$")))
    return parsed.select(F.get(named, F.lit(0)).alias("e"), "m").where("e IS NOT NULL").select(
        F.regexp_extract("e.key", r"(\d+)", 1).cast("int").alias("number"),
        F.col("e.value").alias("caption"),
        F.transform_values(F.map_filter("m", lambda k, v: ~k.rlike(r"^Caption \d+$")),
                           lambda k, v: v.try_cast("double")).alias("scores"))


def read_json_or_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Every file as what it is: a JSON array or object, or JSON lines (malformed lines are left out)."""
    lines, others = _by_format(spark, path)
    parts = [] if lines is None else [_parse(spark.read.option("mode", "DROPMALFORMED"), lines)]
    if others is not None:
        parts.append(_parse(spark.read, others))
    if not parts:
        return spark.read.option("mode", "DROPMALFORMED").json([])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def flatten_group_stats(df: DataFrame, group: str) -> DataFrame:
    """One row per model, per individual time, per element of the first numeric
    list, or the record itself, whichever comes first."""
    types = dict(df.dtypes)
    if types.get("models", "").startswith("array<struct"):
        return df.select(group, F.explode_outer("models").alias("m")).select(group, "m.*")
    lists = [c for c, t in df.dtypes if t in ("array<double>", "array<bigint>", "array<int>")]
    chosen = "individual_times" if "individual_times" in lists else next(iter(lists), None)
    if chosen is None:
        return df
    return df.withColumn(chosen, F.explode_outer(chosen))
