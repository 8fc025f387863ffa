"""Queries over folders and files: a tree of runs is written from events, then listed, read and tailed.

Every event type and user is a run folder. Its log has a line per event; which
runs lack a summary, have a cut or incomplete one, or samples without prompts
follows from the user's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.operators import runs as R
from scenewright.session import scratch_folder
from scenewright.sources import samples as S
from scenewright.sources import tree as T
from scenewright.sources.growing import growing_records
from scenewright.streaming import jobs as J

RECORD = "epoch BIGINT, cents BIGINT"
SUMMARY = "best_epoch BIGINT, cents BIGINT"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = (F.when(F.col("event_type") == "click", "-conditional-regular")
             .when(F.col("event_type") == "view", "-conditional-absence")
             .when(F.col("event_type") == "signup", "-fdm-").when(F.col("event_type") == "error", "-wgan")
             .otherwise("-other"))
    return X.table(spark, sf_dir, "events").select(
        F.concat("event_type", style, F.col("user_id").cast("string")).alias("run"), "user_id", "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _text(lines: Column, start: str = "", between: str = "\n", end: str = "\n") -> Column:
    return F.concat(F.lit(start), F.array_join(lines, between), F.lit(end))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per run with its lines in order of events, as a run's log is one file."""
    line = F.format_string('{"epoch": %d, "cents": %d}', "event_id", "cents")
    entry = F.format_string('{"prompt": %s, "scene": [[%d]]}', F.when(F.col("user_id") % 7 == 3, "null").otherwise(
        F.concat(F.lit('"[, ] '), F.col("event_id").cast("string"), F.lit('"'))), "event_id")
    rows = _events(spark, sf_dir).groupBy("run", "user_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"), entry.alias("entry")))).alias("rows"),
        F.min(F.struct("cents", "event_id")).alias("best"))
    return rows.select("run", "user_id", F.col("rows.line").alias("lines"), F.col("rows.entry").alias("entries"), "best")


def run_tree(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Write the tree; ``(path, bytes)`` of what was written."""
    whole = F.format_string('{"best_epoch": %d, "cents": %d}', "best.event_id", "best.cents")
    summary = (F.when(F.col("user_id") % 10 == 1, F.substring(whole, 1, 10))
               .when(F.col("user_id") % 10 == 2, F.format_string('{"cents": %d}', "best.cents")).otherwise(whole))
    entries = F.when(F.col("user_id") % 9 == 4, F.slice("entries", 2, 1 << 30)).otherwise(F.col("entries"))

    def file(name: str, content: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.concat(F.lit(f"{root}/"), "run", F.lit(name)).alias("path"), content.alias("content")))

    files = F.array_compact(F.array(
        file("/training_log.jsonl", _text(F.col("lines")), F.lit(True)),
        file("/best_model_info.json", summary, F.col("user_id") % 10 != 0),
        file("/samples/samples.json", _text(entries, "[", ",\n", "]"), F.col("user_id") % 5 != 0),
        file("/checkpoint-1", F.lit(None).cast("string"), F.col("user_id") % 2 == 0)))
    return T.write_tree(_runs(spark, sf_dir).select(F.explode(files).alias("f")).select("f.*"))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    root = T.plain(f"{scratch_folder(spark, 'runs')}/tree")
    run_tree(spark, sf_dir, root)
    listing = T.list_tree(spark, root)
    return listing, listing.where((F.col("parent") == root) & F.col("is_dir")), root


def _run_of(path: str, root: str) -> Column:
    return F.substring_index(F.substring(path, len(root) + 2, 1 << 30), "/", 1)


def listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs found on disk with their files and bytes; empty folders count as folders."""
    listing, folders, root = _listed(spark, sf_dir)
    sizes = listing.where(F.col("parent") != root).groupBy(_run_of("path", root).alias("name")).agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"),
        F.sum(F.when(~F.col("is_dir"), F.col("bytes"))).alias("bytes"),
        F.count_if(F.col("modified").isNull()).alias("undated"))
    return R.discover_runs(folders, "path").join(sizes, "name")


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files by the beginning of their name, without logs."""
    listing, _, root = _listed(spark, sf_dir)
    return listing.where(T.selected(listing, ["samples", "training"], ["LOG"])).select(
        _run_of("path", root).alias("run"), "name", "bytes")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected samples of every run against the files that are there and what is in them."""
    listing, folders, root = _listed(spark, sf_dir)
    runs = folders.select(F.col("name").alias("run"))
    per_run = _events(spark, sf_dir).groupBy("run").agg(F.count("*").cast("bigint").alias("expected"))
    kinds = F.array(*[F.struct(F.lit(a).alias("artefact"), F.lit(p).alias("needs_prompt"))
                      for a, p in (("samples.json", True), ("training_log.jsonl", False))])
    manifest = runs.join(per_run, "run").select("run", "expected", F.explode(kinds).alias("k")).select(
        "run", "expected", "k.*")
    files = listing.where(F.col("name").isin("samples.json", "training_log.jsonl"))
    found = T.count_entries(files).select(
        _run_of("path", root).alias("run"), F.substring_index("path", "/", -1).alias("artefact"), "found",
        F.coalesce("has_prompt", F.lit(False)).alias("has_prompt"))
    return R.audit(manifest, found)


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    listing, folders, root = _listed(spark, sf_dir)
    return T.read_summaries(folders, listing, "best_model_info.json", ("best_epoch",)), root


def skipped_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose summary cannot be used, with the reason and the byte."""
    found, root = _summaries(spark, sf_dir)
    return T.skipped(found).select(_run_of("run", root).alias("run"), "status", "reason", "at")


def usable_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, root = _summaries(spark, sf_dir)
    return T.usable(found, SUMMARY).select(_run_of("run", root).alias("run"), "best_epoch", "cents")


def input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of run: found, read and skipped by reason."""
    found, root = _summaries(spark, sf_dir)
    return found.groupBy(F.substring_index(_run_of("run", root), "-", 1).alias("kind")).agg(
        F.count("*").alias("found"), F.count_if(F.col("status") == "read").alias("used"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
        F.count_if(F.col("status") == "incomplete").alias("incomplete"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all runs, an array per file."""
    _, _, root = _listed(spark, sf_dir)
    return S.read_samples(spark, f"{root}/*/samples/samples.json").select("prompt", F.col("scene")[0][0].alias("cell"))


def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs (JSON lines) and samples (arrays) by one reader, told apart by their content."""
    _, _, root = _listed(spark, sf_dir)
    rows = S.read_json_or_jsonl(spark, f"{root}/*/{{training_log.jsonl,samples/samples.json}}")
    return rows.select("epoch", "cents", "prompt", F.col("scene")[0][0].alias("cell"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose key holds the caption's number, between lines of another kind."""
    root = scratch_folder(spark, "numbered")
    record = F.format_string('{"Caption %d": "%s", "score": %d, "note": "none"}', "event_id", "run", "cents")
    lines = F.array_sort(F.collect_list(F.struct("event_id", record.alias("line"))))["line"]
    text = F.concat(F.lit('{"settings": "none"}\n\nno record\n'), _text(lines))
    T.write_tree(_events(spark, sf_dir).groupBy("run").agg(text.alias("content")).select(
        F.concat(F.lit(f"{root}/"), "run", F.lit(".jsonl")).alias("path"), "content"))
    return S.read_numbered(spark, root).select(
        "number", "caption", F.col("scores")["score"].cast("bigint").alias("score"),
        F.col("scores")["note"].isNull().alias("note_is_null"))


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs are read when they are half there, cut within a line, and again when they have grown to the end."""
    at = scratch_folder(spark, "growing")
    runs = _runs(spark, sf_dir).select(F.concat(F.lit(f"{at}/logs/"), "run", F.lit(".jsonl")).alias("path"),
                                       _text(F.col("lines")).alias("content"))
    half = F.expr("substring(content, 1, length(content) div 2)")
    rows = None
    for content in (half, F.col("content")):
        T.write_tree(runs.select("path", content.alias("content")))
        rows = growing_records(spark, f"{at}/logs", RECORD).select(
            F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("run"), "at", "epoch", "cents")
        J.write_available(rows, f"{at}/rows", f"{at}/state")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


RUN = """WITH e AS (SELECT event_type || CASE event_type WHEN 'click' THEN '-conditional-regular'
  WHEN 'view' THEN '-conditional-absence' WHEN 'signup' THEN '-fdm-' WHEN 'error' THEN '-wgan' ELSE '-other' END || user_id AS run,
  event_type, user_id, event_id, round(value * 100)::BIGINT AS cents FROM events),
l AS (SELECT *, '{"epoch": ' || event_id || ', "cents": ' || cents || '}' || chr(10) AS line,
  '{"prompt": ' || CASE WHEN user_id % 7 = 3 THEN 'null' ELSE '"[, ] ' || event_id || '"' END
  || ', "scene": [[' || event_id || ']]}' AS entry, row_number() OVER (PARTITION BY run ORDER BY event_id) AS i FROM e),
s AS (SELECT run, any_value(event_type) AS kind_of, any_value(user_id) AS u, count(*) AS n, sum(length(line))::BIGINT AS log_bytes,
  count(CASE WHEN user_id % 9 <> 4 OR i > 1 THEN 1 END) AS n_entries,
  coalesce(sum(CASE WHEN user_id % 9 <> 4 OR i > 1 THEN length(entry) END), 0)::BIGINT AS entry_bytes,
  min(struct_pack(c := cents, e := event_id)) AS b FROM l GROUP BY run),
f AS (SELECT *, 2 + entry_bytes + 2 * greatest(n_entries - 1, 0) AS sample_bytes,
  length('{"best_epoch": ' || b.e || ', "cents": ' || b.c || '}') AS whole_bytes, length('{"cents": ' || b.c || '}') AS part_bytes FROM s)
"""
STATUS = """, r AS (SELECT *, CASE u % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'incomplete' ELSE 'read' END AS status FROM f)
"""
SAMPLE = """SELECT {0}CASE WHEN user_id % 7 <> 3 THEN '[, ] ' || event_id END AS prompt, event_id::INT AS cell
FROM l WHERE user_id % 5 <> 0 AND (user_id % 9 <> 4 OR i > 1)"""
QUERIES = {
    "a04_read_samples": (samples, RUN + SAMPLE.format("")),
    "a05_numbered_records": (numbered, RUN + "SELECT event_id::INT AS number, run AS caption, cents AS score, true AS note_is_null FROM e"),
    "a06_mixed_formats": (mixed_formats, RUN + SAMPLE.format("NULL::BIGINT AS epoch, NULL::BIGINT AS cents, ").replace(
        "event_id::INT", "event_id") + " UNION ALL SELECT event_id, cents, NULL, NULL FROM l"),
    "a07_listed_runs": (listed_runs, RUN + r"""SELECT run AS name, CASE kind_of WHEN 'signup' THEN 'fdm' WHEN 'error' THEN 'wgan' ELSE 'conditional' END AS kind,
  u::INT AS run, regexp_replace(run, '[0-9]+$', '') AS "group", CASE WHEN kind_of = 'view' THEN 'absence' ELSE 'regular' END AS style,
  1 + (u % 10 <> 0)::BIGINT + (u % 5 <> 0)::BIGINT AS files, (u % 5 <> 0)::BIGINT + (u % 2 = 0)::BIGINT AS folders,
  log_bytes + CASE u % 10 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN part_bytes ELSE whole_bytes END
  + CASE WHEN u % 5 <> 0 THEN sample_bytes ELSE 0 END AS bytes, 0::BIGINT AS undated
FROM f WHERE kind_of IN ('click', 'view', 'signup', 'error')"""),
    "a11_listed_files": (selected_files, RUN + "SELECT run, 'samples.json' AS name, sample_bytes AS bytes FROM f WHERE u % 5 <> 0"),
    "f12_listed_audit": (audited, RUN + """SELECT run, 'training_log.jsonl' AS artefact, NULL::VARCHAR AS message FROM f
UNION ALL SELECT run, 'samples.json', CASE WHEN u % 5 = 0 THEN 'missing: samples.json'
  WHEN n_entries <> n THEN 'expected ' || n || ' but found ' || n_entries WHEN u % 7 = 3 THEN 'missing prompt' END FROM f"""),
    "g11_skipped_inputs": (skipped_inputs, RUN + STATUS + """SELECT run, status, CASE status WHEN 'missing' THEN 'no summary'
  WHEN 'incomplete' THEN 'no best_epoch' ELSE 'Unterminated string starting at' END AS reason,
  CASE status WHEN 'unreadable' THEN 1::BIGINT END AS "at" FROM r WHERE status <> 'read'"""),
    "g11_usable_inputs": (usable_inputs, RUN + STATUS + "SELECT run, b.e AS best_epoch, b.c AS cents FROM r WHERE status = 'read'"),
    "g11_input_counts": (input_counts, RUN + STATUS + """SELECT kind_of AS kind, count(*) AS found, count(CASE WHEN status = 'read' THEN 1 END) AS used,
  count(CASE WHEN status = 'missing' THEN 1 END) AS missing, count(CASE WHEN status = 'unreadable' THEN 1 END) AS unreadable,
  count(CASE WHEN status = 'incomplete' THEN 1 END) AS incomplete FROM r GROUP BY kind_of"""),
    "j01_tail_growing": (tailed, RUN + """SELECT run, coalesce(sum(length(line)) OVER (PARTITION BY run ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at", event_id AS epoch, cents FROM l"""),
}
