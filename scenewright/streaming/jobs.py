"""Incremental jobs: tail a log, track the best epoch, resume work, caption arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenewright.operators.captioner import platformer_caption


def stream_logs(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100,
                **options: str) -> DataFrame:
    """JSON-lines log files as a stream; each appended batch must be a file of its own."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).json(path)


def tail_log(log: DataFrame, epoch: str, left: str, right: str | None = None, start: int = 0
             ) -> DataFrame:
    """``(series, epoch, value)`` from ``start`` on; the right key only where present."""
    series = [F.struct(F.lit(left).alias("series"), F.col(left).cast("double").alias("value"))]
    if right is not None:
        series.append(F.when(F.col(right).isNotNull(), F.struct(
            F.lit(right).alias("series"), F.col(right).cast("double").alias("value"))))
    rows = log.where(F.col(epoch) >= start).select(
        F.col(epoch).alias("epoch"), F.explode(F.array_compact(F.array(*series))).alias("s"))
    return rows.select("s.series", "epoch", "s.value")


def live_best(log: DataFrame, run: list[str], epoch: str, loss: str) -> DataFrame:
    """Best loss, the epoch that first reached it, and epochs since, per run.

    A strict improvement is the first time a minimum is reached, so three
    mergeable aggregates suffice and files may arrive in any order.
    """
    best = F.min(F.when(F.col(loss).isNotNull(), F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))))
    return log.groupBy(*run).agg(best.alias("b"), F.max(epoch).alias("last_epoch")).select(
        *run, F.col("b.loss").alias("best_loss"), F.col("b.epoch").alias("best_epoch"),
        (F.col("last_epoch") - F.col("b.epoch")).alias("since_best"))


def stop_signals(log: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """``(run, stop_epoch)`` of runs that have gone ``patience`` epochs without improving.

    The state of a run is its rows, for a late one may reset the patience or take
    a stop back. So files may arrive in any order; the result is the whole
    aggregate (complete mode). Of several rows of an epoch the least loss counts.
    """
    value = F.col(loss).cast("double")
    none = F.lit(float("nan"))  # sorts after all losses and never improves
    rows = F.sort_array(F.collect_list(F.when(F.col(epoch).isNotNull(), F.struct(
        F.col(epoch).cast("long").alias("e"), F.coalesce(value, none).alias("v")))))

    def follow(s: Column, row: Column) -> Column:
        better = ~F.isnan(row["v"]) & (row["v"] < s["best"])
        stops = F.when(~better & (row["e"] - s["at"] >= patience), row["e"])
        return F.when(s["stop"].isNotNull(), s).otherwise(F.struct(
            F.when(better, row["v"]).otherwise(s["best"]).alias("best"),
            F.when(better, row["e"]).otherwise(s["at"]).alias("at"), stops.alias("stop")))

    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).cast("long").alias("at"),
                     F.lit(None).cast("long").alias("stop"))
    return log.groupBy(run).agg(rows.alias("_rows")).select(
        run, F.aggregate("_rows", start, follow)["stop"].alias("stop_epoch")).where("stop_epoch IS NOT NULL")


def caption_stream(scenes: DataFrame, absence: bool = False) -> DataFrame:
    """Caption scenes as they arrive; stateless and free of shuffles."""
    return platformer_caption(scenes, absence)


def unfinished(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose result is not there yet."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def run_resumable(work: DataFrame, evaluate, keys: list[str], results: str, checkpoint: str
                  ) -> StreamingQuery:
    """Evaluate only new keys and append the results, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, and a
    key finished by an earlier batch is skipped.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates(keys)
        try:
            done = spark.read.parquet(results).where(F.col("batch") != batch_id)
            todo = unfinished(todo, done, keys)
        except Exception as e:  # noqa: BLE001 - the first batch finds no results
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        evaluate(todo).write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    return work.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is available now to parquet and wait."""
    stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the complete aggregate in parquet, replaced by every batch."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(put).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
