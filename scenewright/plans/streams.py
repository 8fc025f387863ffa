"""Queries that run a stream over the tables to its end and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.plans.platformer_sql import captions
from scenewright.session import scratch_folder
from scenewright.streaming import jobs as J


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = X.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _log(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("-", "event_type", "user_id").alias("run"), F.col("event_id").alias("epoch"),
                     F.col("value").alias("loss"),
                     F.when(F.col("value") < 30, F.get_json_object("props", "$.k").cast("int")).alias("score"))


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_folder(spark, "tail")
    rows = J.tail_log(_log(_stream(spark, sf_dir, "events")), "epoch", "loss", "score", start=100)
    J.write_available(rows, f"{at}/rows", f"{at}/state")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_folder(spark, "best")
    rows = J.live_best(_log(_stream(spark, sf_dir, "events")), ["run"], "epoch", "loss")
    J.replace_available(rows, f"{at}/rows", f"{at}/state")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_folder(spark, "stop")
    rows = J.stop_signals(_log(_stream(spark, sf_dir, "events")), "run", "epoch", "loss", 500)
    J.replace_available(rows, f"{at}/rows", f"{at}/state")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_folder(spark, "resume")
    work = _log(_stream(spark, sf_dir, "events")).select("run", "epoch", "loss")
    done = _log(X.table(spark, sf_dir, "events")).where("loss < 10").select("run", "epoch", "loss")
    score = lambda df: df.withColumn("score", F.round(1 / (1 + F.col("loss")), 6))
    score(done).write.parquet(f"{at}/rows/batch=-1")
    J.run_resumable(work, score, ["run", "epoch"], f"{at}/rows", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("run", "epoch", "score", (F.col("batch") == -1).alias("old"))


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_folder(spark, "captions")
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    rows = J.caption_stream(X.scenes_from_text(docs, "platformer").select("scene_id", "rows"))
    rows = rows.select("scene_id", "caption")
    J.write_available(rows, f"{at}/rows", f"{at}/state")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


EV = """WITH l AS (SELECT event_type || '-' || user_id AS run, event_id AS epoch, value AS loss,
  CASE WHEN value < 30 THEN CAST(json_extract(props, '$.k') AS INT) END AS score FROM events)
"""
QUERIES = {
    "j01_tail_log": (tailed, EV + """SELECT 'loss' AS series, epoch, loss AS value FROM l WHERE epoch >= 100
UNION ALL SELECT 'score', epoch, score::DOUBLE FROM l WHERE epoch >= 100 AND score IS NOT NULL"""),
    "j02_live_best": (best, EV + """, b AS (SELECT run, min(loss) AS best_loss, max(epoch) AS le FROM l GROUP BY run)
SELECT b.run, best_loss, min(epoch) AS best_epoch, any_value(le) - min(epoch) AS since_best FROM b JOIN l ON l.run = b.run AND l.loss = best_loss GROUP BY b.run, best_loss"""),
    "j02_stop_signals": (stopped, EV + """, i AS (SELECT *, loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS imp FROM l),
b AS (SELECT *, max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS be FROM i)
SELECT run, min(epoch) AS stop_epoch FROM b WHERE NOT imp AND epoch - be >= 500 GROUP BY run"""),
    "j03_resume_evaluation": (resumed, EV + "SELECT run, epoch, round(1 / (1 + loss), 6) AS score, loss < 10 AS old FROM l"),
    "j04_stream_scene_captions": (captioned, captions() + "SELECT scene_id, caption FROM captions"),
}
