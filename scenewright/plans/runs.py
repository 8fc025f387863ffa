"""Queries of experiment-run analytics, over logs derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions.quantity import clock
from scenewright.games import PLATFORMER, T_975
from scenewright.operators import runs as R
from scenewright.operators import splits as SP
from scenewright.operators.joins import lookup_join
from scenewright.plans.captions import PAIRS
from scenewright.session import cut_lineage

RUN = ["grp", "run"]
L = "WITH " + X.LOG_SQL
SEC = lambda c: f"epoch(date_trunc('second', {c}))::BIGINT"
CLOCK = lambda c: f"format('{{:02d}}:{{:02d}}:{{:02d}}', CAST(floor({c}) AS BIGINT) // 3600, CAST(floor({c}) AS BIGINT) % 3600 // 60, CAST(floor({c}) AS BIGINT) % 60)"  # noqa: E731,E501


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_per_epoch(X.score_log(spark, sf_dir), RUN, "epoch", "line_no", "score")


def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.first_last(X.run_log(spark, sf_dir), RUN, "epoch", "ts")
    return out.select(*RUN, R.seconds(F.col("first_ts")).alias("first_sec"),
                      R.seconds(F.col("last_ts")).alias("last_sec"), "lines", "usable")


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_epochs(X.run_log(spark, sf_dir), RUN, "epoch", "loss")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.early_stop_epochs(X.run_log(spark, sf_dir), RUN, "epoch", "loss", 4)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (F.when(F.col("event_type") == "click", "-conditional-regular")
             .when(F.col("event_type") == "view", "-conditional-absence")
             .when(F.col("event_type") == "signup", "-fdm-").when(F.col("event_type") == "error", "-wgan")
             .otherwise("-other"))
    return X.table(spark, sf_dir, "events").select(
        F.concat(F.lit("/runs/"), "event_type", kinds, F.col("user_id").cast("string")).alias("path"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discover_runs(_named(spark, sf_dir).distinct(), "path")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = X.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("grp"),
        F.concat(F.lit("out/checkpoint-"), F.col("event_id").cast("string")).alias("path"))
    return R.latest_checkpoint(paths, ["grp"], "path")


def final_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types with long names have a finished model."""
    events = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "event_id")
    steps_ = events.select("grp", F.format_string("out/checkpoint-%d", "event_id").alias("path"))
    models = events.where(F.length("grp") > 5).select("grp", F.lit("out/unet").alias("path")).distinct()
    return R.latest_checkpoint(steps_.unionByName(models), ["grp"], "path", final="unet")


def unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is expected to have a log of each event type."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    expected = X.table(spark, sf_dir, "customer").select(
        F.explode(F.array(*map(F.lit, kinds))).alias("grp"), F.col("c_custkey").alias("run"))
    return R.unusable_logs(expected, X.run_log(spark, sf_dir), RUN, "loss")


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.zip_prompts(X.pairs(spark, sf_dir).select("sample_id", "prompt"), docs, ["sample_id"],
                         ["source", "doc_id"], "prompt")


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.run_log(spark, sf_dir).withColumnRenamed("run", "file")
    return R.truncate_log(log, ["grp"], "file", "ts", "epoch", 5).select("grp", "file", "epoch", "loss")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.run_log(spark, sf_dir).withColumn(
        "step", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    return R.last_step(log, RUN, "epoch", "step")


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.run_log(spark, sf_dir)
    return R.run_durations(log, R.best_epochs(log, RUN, "epoch", "loss"), RUN, "epoch", "epoch", "ts")


def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.runtime_stats(cut_lineage(_durations(spark, sf_dir)), ["grp"], "total", ["run"])
    return rounded(out.select("grp", "n", "mean", "std", "stderr", "median", "q1", "q3", "min", "max",
                              "median_clock", "max_clock"), "mean", "std", "stderr", "median", "q1", "q3")


def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.best_model_stats(cut_lineage(best(spark, sf_dir)), ["grp"], ["run"], ["best_epoch", "best_loss"])
    return rounded(out, "best_epoch_avg", "best_epoch_median", "best_loss_avg", "best_loss_median")


def _curve(require_all: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = R.curve_aggregate(last_scores(spark, sf_dir), ["grp"], "run", "epoch", "score", require_all)
        return rounded(out, "mean", "std").withColumn("half_width", F.round("half_width", 4))
    return run


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("v"))
    out = facts.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    out = out.withColumn("half_width", R.half_width(F.col("std"), F.col("n")))
    return rounded(out, "mean", "std").withColumn("half_width", F.round("half_width", 4))


MODES = {"conditional": {"random", "real", "short"}, "fdm": {"random", "real"}}


def defect_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken pipes per model (source) and mode; whole percentages, so the first check finds something."""
    low = F.lower("generated")
    said = X.pairs(spark, sf_dir, "source").select(
        "source", F.when(F.length("source") % 2 == 0, "conditional").otherwise("fdm").alias("kind"),
        F.get(F.array(*map(F.lit, ("random", "real", "short"))), (F.col("sample_id") % 3).cast("int")).alias("mode"),
        (F.col("sample_id") % 5).alias("run"), low.contains("pipe").alias("item"), low.contains("broken pipe").alias("bad"))
    runs = said.groupBy("source", "kind", "mode", "run").agg(
        F.count("*").alias("total"), F.count_if("item").alias("items"), F.count_if("bad").alias("broken"))
    runs = runs.withColumn("percent", F.floor(100.0 * F.col("broken") / F.col("total")).cast("double"))
    out = R.model_mode_matrix(runs, "source", "kind", "mode", MODES, "percent", "broken", "items", "total")
    return rounded(out, "mean", "std", "background").withColumn("half_width", F.round("half_width", 4))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("level"), "event_id",
        F.create_map(F.col("event_type"), F.col("value")).alias("metrics"))
    return R.keyed_run_stats(runs, "level", "event_id", "metrics")


def keyed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(keyed(spark, sf_dir), "mean", "std", "median")


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.overall_averages(keyed(spark, sf_dir)), "mean")


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = R.score_spread(X.score_log(spark, sf_dir), ["grp", "run"], "score", ["line_no"])
    means = cut_lineage(per.select("grp", "run", "mean"))  # one row per run, used twice
    over = R.score_spread(means, ["grp"], "mean", ["run"])
    return rounded(over, "mean", "std", "low", "high", "median")


def five(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return rounded(R.five_numbers(facts, ["o_orderpriority"], "o_totalprice", ["o_orderkey"]),
                   "low", "q1", "median", "q3", "high")


def _files(cumulative: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), "value")
        return rounded(R.rollup_files(scores, "file", "value", cumulative), "mean")
    return run


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.pairs(spark, sf_dir).select(
        (F.col("sample_id") % 7).alias("epoch"),
        F.explode(F.arrays_zip(F.split("prompt", " ").alias("want"), F.split("generated", " ").alias("got"))).alias("x"))
    seen = made.where("x.want IS NOT NULL").groupBy("epoch").agg(
        F.count_if(F.col("x.want") == F.col("x.got")).alias("correct"), F.count("*").alias("total"))
    return seen.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).agg(
        F.count("*").alias("samples"), F.count_if(F.col("prompt").contains("broken")).alias("excluded"),
        F.count_if(F.col("prompt").contains("broken pipe")).alias("broken_pipe"),
        F.count_if(F.col("prompt").contains("broken cannon")).alias("broken_cannon"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).where(~F.col("prompt").contains("broken")).select("sample_id", "prompt")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    prompts = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.length("text").alias("prompt_length"))
    answers = talk.where("role <> 'user'").select("conv_id", "turn", F.length("text").alias("answer_length"))
    return prompts.join(answers, ["conv_id", "turn"])


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group"), "c_nationkey", "c_acctbal")
    means = facts.groupBy("group", "c_nationkey").agg(F.avg("c_acctbal").alias("t"))
    groups = means.groupBy("group").agg(
        F.avg("t").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("c_nationkey", "t"))),
                                              lambda x: x["t"]).alias("times"))
    groups = groups.withColumns({
        "best_mean": F.when(F.col("group") != "BUILDING", F.col("mean") / 2),
        "best_times": F.when(F.col("group") != "BUILDING", F.transform("times", lambda x: x / 2))})
    wanted = spark.createDataFrame([("AUTOMOBILE", "BUILDING", "A+B"), ("MACHINERY", "FURNITURE", "M+F"),
                                    ("MACHINERY", "ABSENT", "M+?")], "first string, second string, combined string")
    out = R.combine_stages(groups, F.broadcast(wanted))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("combined", "missing", F.round("mean", 6).alias("mean"), total("times").alias("times"),
                      F.round("best_mean", 6).alias("best_mean"), total("best_times").alias("best_times"))


def newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = X.table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    old = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderpriority").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"))
    return R.prefer_new(new, old, "c_custkey")


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.run_log(spark, sf_dir)
    out = R.attach_log(R.best_epochs(log, RUN, "epoch", "loss"), log, RUN, "epoch", "epoch", "ts")
    return out.select(*RUN, "best_epoch", R.seconds(F.col("best_ts")).alias("best_sec"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = X.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("run"), F.explode(F.array(*map(F.lit, SEGMENTS))).alias("artefact"),
        F.lit(12).alias("expected"), F.lit(True).alias("needs_prompt"))
    found = X.table(spark, sf_dir, "customer").groupBy(
        F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("artefact")).agg(
        F.count("*").alias("found"), (F.min("c_acctbal") > -900).alias("has_prompt"))
    return R.audit(manifest, found)


def valid_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    modes = spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "5-LOW")],
                                  "o_orderstatus string, o_orderpriority string")
    return orders.join(F.broadcast(modes), ["o_orderstatus", "o_orderpriority"], "left_semi").groupBy(
        "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.systematic_sample(X.table(spark, sf_dir, "documents").select("source", "doc_id"),
                                ["source", "doc_id"], 100)


def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.random_limit(X.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 5)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.split(X.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0)


TOPIC_WORDS = [t for t in PLATFORMER.topics if "broken" not in t]


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.pairs(spark, sf_dir).select("sample_id", "prompt")
    return SP.split_coverage(SP.split(pairs, "sample_id", 0), "prompt", TOPIC_WORDS)


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics that only the training split speaks of at first, and one that nothing speaks of."""
    pairs = SP.split(X.pairs(spark, sf_dir).select("sample_id", "prompt"), "sample_id", 0)
    rare = F.col("prompt").contains("tower") | F.col("prompt").contains("cannon")
    pairs = cut_lineage(pairs.withColumn("split", F.when(rare, "train").otherwise(F.col("split"))))
    words = [*TOPIC_WORDS, "volcano"]
    moved, left = SP.repair_coverage(pairs, "sample_id", "prompt", words)
    missing = left.select("split", "topic", F.lit(True).alias("_open"))
    return SP.split_coverage(moved, "prompt", words).join(missing, ["split", "topic"], "left").select(
        "split", "topic", "present", F.coalesce("_open", F.lit(False)).alias("open"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").select("o_orderkey", clock(F.col("o_totalprice")).alias("clock"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = last_scores(spark, sf_dir)
    done = scores.where("score < 0.05").select("grp", "run", "epoch")
    return scores.join(done, ["grp", "run", "epoch"], "left_anti")


_T = "CASE " + " ".join(f"WHEN n={i + 2} THEN {v}" for i, v in enumerate(T_975)) + " END"
_Z = "1.959963984540054"
_EXP = (f"({_Z} + ({_Z}**3 + {_Z}) / 4 / (n-1) + (5*{_Z}**5 + 16*{_Z}**3 + 3*{_Z}) / 96 / (n-1)**2 "
        f"+ (3*{_Z}**7 + 19*{_Z}**5 + 17*{_Z}**3 - 15*{_Z}) / 384 / (n-1)**3)")
HALF = f"round(CASE WHEN n > 1 THEN coalesce({_T}, {_EXP}) * std / sqrt(n) ELSE 0 END, 4)"
LAST = L + """, last_score AS (SELECT grp, run, epoch, max_by(score, line_no) AS score FROM fx_score_log GROUP BY ALL)"""
IMPROVED = L + """, imp AS (SELECT *, loss < coalesce(min(loss) OVER (PARTITION BY grp, run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS improved FROM fx_run_log),
best AS (SELECT grp, run, max(epoch) FILTER (improved) AS best_epoch, min(loss) AS best_loss FROM imp GROUP BY grp, run)"""
DUR = IMPROVED + f""", ends AS (SELECT grp, run, min_by({SEC('ts')}, epoch) AS a, max_by({SEC('ts')}, epoch) AS z
  FROM fx_run_log GROUP BY grp, run HAVING count(*) >= 2),
hit AS (SELECT l.grp, l.run, min_by({SEC('l.ts')}, l.epoch) AS b FROM fx_run_log l JOIN best USING (grp, run)
  WHERE l.epoch = best_epoch AND l.epoch > 0 GROUP BY l.grp, l.run),
dur AS (SELECT e.grp, e.run, (z - a)::DOUBLE AS total, (b - a)::DOUBLE AS to_best FROM ends e LEFT JOIN hit USING (grp, run))"""
KEYED = """WITH k AS (SELECT user_id AS level, event_type AS key, avg(value) AS mean, median(value) AS median,
  stddev_pop(value) AS std FROM events GROUP BY ALL)"""
SPLIT_SQL = """sp AS (SELECT {id} AS sample_id, CASE WHEN rn < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
    WHEN rn < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {id}, row_number() OVER (ORDER BY md5('0:' || {id}), {id}) - 1 AS rn, count(*) OVER () AS n FROM {t}))"""

QUERIES = {
    "a07_discover_runs": (discovered, """
WITH n AS (SELECT DISTINCT event_type || CASE event_type WHEN 'click' THEN '-conditional-regular' WHEN 'view' THEN '-conditional-absence'
  WHEN 'signup' THEN '-fdm-' WHEN 'error' THEN '-wgan' ELSE '-other' END || user_id AS name FROM events)
SELECT name, CASE WHEN contains(name, '-conditional-') THEN 'conditional' WHEN contains(name, 'fdm') THEN 'fdm' ELSE 'wgan' END AS kind,
  CAST(regexp_extract(name, '(\\d+)$', 1) AS INT) AS run, regexp_replace(name, '\\d+$', '') AS "group",
  CASE WHEN contains(name, 'absence') THEN 'absence' ELSE 'regular' END AS style FROM n WHERE NOT contains(name, '-other')"""),
    "b06_drop_broken": (kept, PAIRS + " SELECT sample_id, prompt FROM fx_pairs WHERE NOT contains(prompt, 'broken')"),
    "b09_format_duration": (clocks, f"SELECT o_orderkey, {CLOCK('o_totalprice')} AS clock FROM orders"),
    "f06_zip_prompts": (turns, """SELECT a.conv_id, b.turn, length(a.text) AS prompt_length, length(b.text) AS answer_length
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role <> 'user'"""),
    "f06_zip_by_position": (zipped, PAIRS + """
SELECT doc_id, source, prompt FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS i FROM documents)
JOIN (SELECT prompt, row_number() OVER (ORDER BY sample_id) AS i FROM fx_pairs) USING (i)"""),
    "f07_combine_stages": (stages, """
WITH m AS (SELECT c_mktsegment AS g, c_nationkey AS k, avg(c_acctbal) AS t FROM customer GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM m),
w AS (SELECT * FROM (VALUES ('AUTOMOBILE','BUILDING','A+B'), ('MACHINERY','FURNITURE','M+F'), ('MACHINERY','ABSENT','M+?')) v(f, s, combined)),
av AS (SELECT g, avg(t) AS mean FROM m GROUP BY g),
z AS (SELECT w.combined, sum(a.t + b.t) AS times, sum(a.t / 2 + CASE WHEN w.s = 'BUILDING' THEN b.t ELSE b.t / 2 END) AS best
  FROM w JOIN s a ON a.g = w.f JOIN s b ON b.g = w.s AND b.i = a.i GROUP BY w.combined)
SELECT w.combined, x.g IS NULL OR y.g IS NULL AS missing, round(x.mean + y.mean, 6) AS mean, round(times, 4) AS times,
  round(x.mean / 2 + CASE WHEN w.s = 'BUILDING' THEN y.mean ELSE coalesce(y.mean / 2, 0) END, 6) AS best_mean, round(best, 4) AS best_times
FROM w LEFT JOIN av x ON x.g = w.f LEFT JOIN av y ON y.g = w.s LEFT JOIN z ON z.combined = w.combined"""),
    "f08_prefer_new_format": (newer, """
WITH o AS (SELECT o_custkey AS c_custkey, min(o_orderpriority) AS s, max(o_totalprice) AS b FROM orders GROUP BY 1),
n AS (SELECT c_custkey, c_mktsegment AS s, c_acctbal AS b FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, CASE WHEN n.s IS NOT NULL THEN n.s ELSE o.s END AS c_mktsegment, CASE WHEN n.s IS NOT NULL THEN n.b ELSE o.b END AS c_acctbal
FROM n FULL JOIN o USING (c_custkey)"""),
    "f11_attach_log_to_summary": (attached, DUR + """
SELECT best.grp, best.run, best_epoch, b AS best_sec FROM best LEFT JOIN hit USING (grp, run)"""),
    "f12_audit_manifest": (audited, """
WITH m AS (SELECT n_nationkey AS run, a AS artefact FROM nation, (SELECT DISTINCT c_mktsegment AS a FROM customer)),
o AS (SELECT c_nationkey AS run, c_mktsegment AS artefact, count(*) AS found, min(c_acctbal) > -900 AS hp FROM customer GROUP BY 1, 2)
SELECT run, artefact, CASE WHEN found IS NULL THEN 'missing: ' || artefact WHEN found <> 12 THEN 'expected 12 but found ' || found
  WHEN NOT hp THEN 'missing prompt' END AS message FROM m LEFT JOIN o USING (run, artefact)"""),
    "f13_valid_modes": (valid_modes, """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
WHERE (o_orderstatus, o_orderpriority) IN (('F','1-URGENT'), ('F','2-HIGH'), ('O','5-LOW')) GROUP BY 1, 2"""),
    "g07_per_level_run_stats": (keyed_stats, KEYED + """
SELECT level, key, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std FROM k"""),
    "g08_overall_averages": (overall, KEYED + " SELECT key, round(avg(mean), 6) AS mean FROM k GROUP BY key"),
    "g09_runtime_stats": (runtime, DUR + f"""
SELECT grp, count(*) AS n, round(avg(total), 6) AS mean, round(stddev_pop(total), 6) AS std,
  round(stddev_pop(total) / sqrt(count(*)), 6) AS stderr, round(median(total), 6) AS median,
  round(quantile_cont(total, 0.25), 6) AS q1, round(quantile_cont(total, 0.75), 6) AS q3, min(total) AS "min", max(total) AS "max",
  {CLOCK('median(total)')} AS median_clock, {CLOCK('max(total)')} AS max_clock FROM dur GROUP BY grp"""),
    "g10_time_to_best": (_durations, DUR + " SELECT grp, run, total, to_best FROM dur"),
    "g10_unusable_logs": (unusable, """
WITH x AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS grp, c_custkey AS run FROM customer),
s AS (SELECT event_type AS grp, user_id AS run, count(*) AS lines, count(value) AS losses FROM events GROUP BY 1, 2)
SELECT grp, run, CASE WHEN lines IS NULL THEN 'no log' WHEN lines < 2 THEN 'fewer than two lines' ELSE 'no loss' END AS reason
FROM x LEFT JOIN s USING (grp, run) WHERE lines IS NULL OR lines < 2 OR losses = 0"""),
    "g11_best_model_stats": (model_stats, IMPROVED + """
SELECT grp, count(*) AS models, round(avg(best_epoch), 6) AS best_epoch_avg, round(avg(best_loss), 6) AS best_loss_avg,
  round(median(best_epoch), 6) AS best_epoch_median, round(median(best_loss), 6) AS best_loss_median FROM best GROUP BY grp"""),
    "g12_curve_aggregate": (_curve(True), LAST + f""",
p AS (SELECT grp, epoch, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, count(*) AS n FROM last_score GROUP BY grp, epoch)
SELECT grp, epoch, round(mean, 6) AS mean, round(std, 6) AS std, n, {HALF} AS half_width FROM p
WHERE n = (SELECT count(DISTINCT run) FROM last_score s WHERE s.grp = p.grp)"""),
    "g12_curve_any_run": (_curve(False), LAST + f""",
p AS (SELECT grp, epoch, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, count(*) AS n FROM last_score GROUP BY grp, epoch)
SELECT grp, epoch, round(mean, 6) AS mean, round(std, 6) AS std, n, {HALF} AS half_width FROM p"""),
    "g13_t_confidence_interval": (matrix, f"""
WITH p AS (SELECT lang, source, count(*) AS n, avg(n_chars) AS mean, coalesce(stddev_samp(n_chars), 0) AS std FROM documents GROUP BY ALL)
SELECT lang, source, n, round(mean, 6) AS mean, round(std, 6) AS std, {HALF} AS half_width FROM p"""),
    "g14_model_mode_matrix": (defect_matrix, PAIRS + f""",
said AS (SELECT source, length(source) % 2 = 0 AS conditional, (['random', 'real', 'short'])[sample_id % 3 + 1] AS mode,
  sample_id % 5 AS run, lower(generated) AS g FROM fx_pairs JOIN documents ON doc_id = sample_id),
r AS (SELECT source, mode, run, count(*) AS total, count(*) FILTER (contains(g, 'pipe')) AS items,
  count(*) FILTER (contains(g, 'broken pipe')) AS broken FROM said WHERE conditional OR mode <> 'short' GROUP BY ALL),
v AS (SELECT *, floor(100.0::DOUBLE * broken / total) AS percent, 100.0::DOUBLE * items / total AS share FROM r),
p AS (SELECT source, mode, count(percent) AS n, avg(percent) AS mean, coalesce(stddev_samp(percent), 0) AS std,
  avg(share) AS background, 0 AS incomplete,
  count(*) FILTER (abs(percent - 100.0::DOUBLE * broken / total) > 1e-3) AS off_percent,
  count(*) FILTER (broken > items OR items > total) AS off_range, count(*) FILTER (share < percent) AS off_background
  FROM v GROUP BY ALL)
SELECT source, mode, n, round(mean, 6) AS mean, round(std, 6) AS std, round(background, 6) AS background, incomplete,
  off_percent, off_range, off_background, {HALF} AS half_width FROM p"""),
    "g16_distribution": (five, """
SELECT o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS median,
  round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1"""),
    "g17_order_tolerance_stats": (spread, L + """,
p AS (SELECT grp, run, avg(score) AS m FROM fx_score_log GROUP BY grp, run)
SELECT grp, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(min(m), 6) AS low, round(max(m), 6) AS high,
  count(*) AS n, round(median(m), 6) AS median FROM p GROUP BY grp"""),
    "g17b_order_tolerance_rollup": (_files(False), """
SELECT event_type AS file, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1"""),
    "g17b_cumulative_rollup": (_files(True), """
WITH f AS (SELECT event_type AS file, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT file, sum(n) OVER w AS n, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean, min(lo) OVER w AS low, max(hi) OVER w AS high
FROM f WINDOW w AS (ORDER BY file)"""),
    "g22_prediction_accuracy": (accuracy, PAIRS + """,
w AS (SELECT sample_id % 7 AS epoch, string_split(prompt, ' ') AS a, string_split(generated, ' ') AS b FROM fx_pairs),
x AS (SELECT epoch, a[i] AS want, b[i] AS got FROM (SELECT epoch, a, b, unnest(range(1, len(a) + 1)) AS i FROM w))
SELECT epoch, count(*) FILTER (want = got) AS correct, count(*) AS total, round(count(*) FILTER (want = got) / count(*), 6) AS accuracy
FROM x GROUP BY epoch"""),
    "g23_excluded_counts": (excluded, PAIRS + """
SELECT count(*) AS samples, count(*) FILTER (contains(prompt, 'broken')) AS excluded,
  count(*) FILTER (contains(prompt, 'broken pipe')) AS broken_pipe, count(*) FILTER (contains(prompt, 'broken cannon')) AS broken_cannon FROM fx_pairs"""),
    "h01_last_per_epoch": (last_scores, LAST + " SELECT grp, run, epoch, score FROM last_score"),
    "h02_first_last_entry": (first_last, L + f"""
SELECT grp, run, min_by({SEC('ts')}, epoch) AS first_sec, max_by({SEC('ts')}, epoch) AS last_sec, count(*) AS lines, count(*) >= 2 AS usable
FROM fx_run_log GROUP BY grp, run"""),
    "h03_running_best": (best, IMPROVED + " SELECT grp, run, best_epoch, best_loss FROM best"),
    "h04_early_stop_epoch": (stops, IMPROVED + """,
b AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY grp, run ORDER BY epoch) AS be FROM imp)
SELECT grp, run, min(epoch) FILTER (NOT improved AND epoch - coalesce(be, 0) >= 4) AS stop_epoch FROM b GROUP BY grp, run"""),
    "h05_latest_checkpoint": (checkpoints, """
SELECT event_type AS grp, 'out/checkpoint-' || max(event_id) AS path, max(event_id) AS epoch FROM events GROUP BY 1"""),
    "h05_final_model": (final_models, """
SELECT event_type AS grp, CASE WHEN length(event_type) > 5 THEN 'out' ELSE 'out/checkpoint-' || max(event_id) END AS path,
  max(event_id) + CASE WHEN length(event_type) > 5 THEN 1 ELSE 0 END AS epoch FROM events GROUP BY event_type"""),
    "h06_truncate_log": (truncated, L + """,
f AS (SELECT grp, run, max(ts) AS m FROM fx_run_log GROUP BY grp, run), n AS (SELECT grp, max_by(run, (m, run)) AS run FROM f GROUP BY grp)
SELECT grp, run AS file, epoch, loss FROM fx_run_log JOIN n USING (grp, run) WHERE epoch <= 5"""),
    "h07_last_step": (steps, L + """
SELECT grp, run, coalesce(max_by(event_id, epoch) FILTER (event_id % 3 > 0), 0) AS step FROM fx_run_log GROUP BY grp, run"""),
    "h08_systematic_sample": (sampled, """
WITH p AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos, count(*) OVER () // 101 AS step FROM documents)
SELECT source, doc_id FROM p WHERE pos % step = 0 AND pos // step BETWEEN 1 AND 100"""),
    "h09_random_limit": (random_rows, "SELECT doc_id, source FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 100"),
    "h10_split": (split, "WITH " + SPLIT_SQL.format(id="doc_id", t="documents") + " SELECT sample_id AS doc_id, split FROM sp"),
    "h11_split_coverage": (coverage, PAIRS + "," + SPLIT_SQL.format(id="sample_id", t="fx_pairs") + """
SELECT split, topic, bool_or(contains(prompt, topic)) AS present FROM fx_pairs JOIN sp USING (sample_id),
  (SELECT unnest([""" + ", ".join(f"'{t}'" for t in TOPIC_WORDS) + """]) AS topic) GROUP BY split, topic"""),
    "h12_repair_coverage": (repaired, PAIRS + """
SELECT split, topic, n >= 3 AS present, n < 3 AS open FROM (SELECT unnest(['train', 'val', 'test']) AS split),
  (SELECT topic, count(*) FILTER (contains(prompt, topic)) AS n FROM fx_pairs, (SELECT unnest(["""
        + ", ".join(f"'{t}'" for t in [*TOPIC_WORDS, "volcano"]) + """]) AS topic) GROUP BY topic)"""),
    "i04_unfinished_epochs": (finished, LAST + " SELECT * FROM last_score WHERE NOT score < 0.05"),
}
