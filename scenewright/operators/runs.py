"""Experiment-run analytics: logs, learning curves, runtimes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.functions.quantity import clock
from scenewright.games import T_975
from scenewright.operators.joins import lookup_join, null_safe_join
from scenewright.operators.ranking import global_rank, group_quantiles

CHUNK = 1024  # epochs per piece of a running scan


def last_per_epoch(log: DataFrame, run: list[str], epoch: str, line: str, value: str) -> DataFrame:
    """One value per run and epoch: the one on the last line."""
    return log.groupBy(*run, epoch).agg(F.max_by(value, line).alias(value))


def first_last(log: DataFrame, run: list[str], line: str, ts: str) -> DataFrame:
    """First and last timestamp per run; a log of a single line is not usable."""
    return log.groupBy(*run).agg(
        F.min_by(ts, line).alias("first_ts"), F.max_by(ts, line).alias("last_ts"),
        F.count("*").alias("lines"), (F.count("*") >= 2).alias("usable"))


def seconds(ts: Column) -> Column:
    """Whole seconds of a wall-clock time, whatever zone the session is in."""
    text = F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return F.unix_timestamp(F.concat(text, F.lit(" +0000")), "yyyy-MM-dd HH:mm:ss xx")


def running_extreme(log: DataFrame, run: list[str], epoch: str, value: Column, name: str,
                    smallest: bool, include_current: bool = False) -> DataFrame:
    """Best value of the earlier epochs of the run (or up to the current one).

    Runs are scanned in pieces of ``CHUNK`` epochs that start from the best of
    the pieces before them, so one very long run is spread over many tasks.
    """
    best = F.min if smallest else F.max
    pick = F.least if smallest else F.greatest
    pieces = log.withColumns({"_v": value, "_piece": F.floor(F.col(epoch) / CHUNK)})
    totals = pieces.groupBy(*run, "_piece").agg(best("_v").alias("_best"))
    before = totals.select(*run, "_piece", best("_best").over(
        W.partitionBy(*run).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = best("_v").over(W.partitionBy(*run, "_piece").orderBy(epoch).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1))
    whole = pieces.withColumn("_inside", inside)
    whole = null_safe_join(whole, before, [*run, "_piece"])
    return whole.withColumn(
        name, pick("_inside", "_before")).drop("_v", "_piece", "_inside", "_before")


def with_improvement(log: DataFrame, run: list[str], epoch: str, loss: str) -> DataFrame:
    """Add ``improved`` (strictly below every earlier loss)."""
    seen = running_extreme(log, run, epoch, F.col(loss), "_seen", smallest=True)
    return seen.withColumn("improved", F.coalesce(
        F.col(loss) < F.coalesce("_seen", F.lit(float("inf"))), F.lit(False))).drop("_seen")


def best_epochs(log: DataFrame, run: list[str], epoch: str, loss: str) -> DataFrame:
    """Epoch of the last improvement and the best loss, per run."""
    return with_improvement(log, run, epoch, loss).groupBy(*run).agg(
        F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
        F.min(loss).alias("best_loss"))


def early_stop_epochs(log: DataFrame, run: list[str], epoch: str, loss: str, patience: int
                      ) -> DataFrame:
    """First epoch without improvement for ``patience`` epochs; null if never."""
    flagged = with_improvement(log, run, epoch, loss)
    known = running_extreme(flagged, run, epoch, F.when(F.col("improved"), F.col(epoch)),
                            "best_so_far", smallest=False, include_current=True)
    stops = ~F.col("improved") & (F.col(epoch) - F.coalesce("best_so_far", F.lit(0)) >= patience)
    return known.groupBy(*run).agg(F.min(F.when(stops, F.col(epoch))).alias("stop_epoch"))


def checkpoints(paths: DataFrame, run: list[str], path: str, final: str | None = None) -> DataFrame:
    """``(run, path, epoch)`` of every checkpoint folder.

    A folder called ``final`` marks its parent as the finished model, one epoch
    after the run's last checkpoint; without any checkpoint its epoch is 0.
    """
    number = F.regexp_extract(path, r"checkpoint-(\d+)", 1)
    found = paths.where(number != "").select(*run, F.col(path).alias("path"), number.try_cast("bigint").alias("epoch"))
    if final is None:
        return found
    last = found.groupBy(*run).agg(F.max("epoch").alias("_last"))
    done = paths.where(F.regexp_extract(path, r"([^/]+)/*$", 1) == final).select(
        *run, F.regexp_replace(path, r"/[^/]+/*$", "").alias("path")).distinct()
    models = null_safe_join(done, last, run, "left").select(*run, "path", (F.coalesce("_last", F.lit(-1)) + 1).alias("epoch"))
    return found.unionByName(models)


def latest_checkpoint(paths: DataFrame, run: list[str], path: str, final: str | None = None) -> DataFrame:
    return checkpoints(paths, run, path, final).groupBy(*run).agg(
        F.max_by("path", F.struct("epoch", "path")).alias("path"), F.max("epoch").alias("epoch"))


def unusable_logs(expected: DataFrame, log: DataFrame, run: list[str], loss: str) -> DataFrame:
    """``(run, reason)`` of the expected runs whose log is missing, too short or without a loss."""
    seen = log.groupBy(*run).agg(F.count("*").alias("_lines"), F.count(loss).alias("_losses"))
    reason = (F.when(F.col("_lines").isNull(), "no log").when(F.col("_lines") < 2, "fewer than two lines")
              .when(F.col("_losses") == 0, "no loss"))
    return null_safe_join(expected.select(*run).distinct(), seen, run, "left").select(
        *run, reason.alias("reason")).where("reason IS NOT NULL")


def zip_prompts(source: DataFrame, target: DataFrame, source_order: list[str], target_order: list[str],
                caption: str, into: str = "prompt") -> DataFrame:
    """Give each target row the caption of the source row at the same position.

    Both sides must have as many rows; the orders must identify rows.
    """
    n, m = source.count(), target.count()
    if n != m:
        raise ValueError(f"{n} source rows and {m} target rows: prompts cannot be added")
    left = global_rank(target, target_order, "_at")
    right = global_rank(source, source_order, "_at").select("_at", F.col(caption).alias(into))
    return left.drop(into).join(right, "_at").drop("_at")


def truncate_log(log: DataFrame, run: list[str], file: str, modified: str, epoch: str, upto: int
                 ) -> DataFrame:
    """Rows of the most recently changed log file of each run, up to an epoch."""
    files = log.groupBy(*run, file).agg(F.max(modified).alias("_m"))
    newest = files.groupBy(*run).agg(F.max_by(file, F.struct("_m", file)).alias(file))
    return lookup_join(log.where(F.col(epoch) <= upto), newest, [*run, file])


def last_step(log: DataFrame, run: list[str], line: str, step: str) -> DataFrame:
    known = F.when(F.col(step).isNotNull(), F.struct(line, step))
    return log.groupBy(*run).agg(F.coalesce(F.max(known)[step], F.lit(0)).alias("step"))


def attach_log(best: DataFrame, log: DataFrame, run: list[str], epoch: str, line: str, ts: str) -> DataFrame:
    """Add ``best_ts``, the time of the first log line of each run's best epoch.

    Only lines after a run's first one count; a run without such a line, or
    without any log, stays with a null time.
    """
    firsts = log.groupBy(*run).agg(F.min(line).alias("_first"))
    keyed = lookup_join(lookup_join(log, best.select(*run, "best_epoch"), run), firsts, run)
    at_best = keyed.where((F.col(epoch) == F.col("best_epoch")) & (F.col(line) > F.col("_first"))
                          ).groupBy(*run).agg(F.min_by(ts, line).alias("best_ts"))
    return null_safe_join(best, at_best, run, "left")


def run_durations(log: DataFrame, best: DataFrame, run: list[str], epoch: str, line: str, ts: str
                  ) -> DataFrame:
    """Total and time-to-best seconds per usable run.

    The best epoch is looked up on the lines after the first one, so a best
    epoch that only the first line has yields no time to best.
    """
    ends = first_last(log, run, line, ts).where("usable")
    at_best = attach_log(best.select(*run, "best_epoch"), log, run, epoch, line, ts)
    joined = null_safe_join(ends, at_best.select(*run, "best_ts"), run, "left")
    return joined.select(
        *run, (seconds(F.col("last_ts")) - seconds(F.col("first_ts"))).cast("double").alias("total"),
        (seconds(F.col("best_ts")) - seconds(F.col("first_ts"))).cast("double").alias("to_best"))


def runtime_stats(durations: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """Mean, population deviation, standard error, quartiles, range and clock texts."""
    moments = durations.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = group_quantiles(durations, by, value, tie, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = null_safe_join(moments, quartiles, by).withColumn("stderr", F.col("std") / F.sqrt("n"))
    names = ["mean", "std", "stderr", "median", "q1", "q3", "min", "max"]
    return out.select(*by, "n", *names, *[clock(F.col(c)).alias(f"{c}_clock") for c in names])


def t_quantile(df: Column) -> Column:
    """0.975 quantile of Student's t; a series expansion beyond 30 degrees."""
    table = F.array(*[F.lit(v) for v in T_975])
    z = 1.959963984540054
    expansion = (
        F.lit(z) + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / df**2
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / df**3
    )
    return F.when(df <= 0, 0.0).when(df <= len(T_975), F.get(table, (df - 1).cast("int"))).otherwise(
        expansion)


def half_width(std: Column, n: Column) -> Column:
    """Half the 95 % confidence interval of a mean; 0 below two values."""
    return F.when(n > 1, t_quantile(n - 1) * std / F.sqrt(n)).otherwise(0.0)


def model_mode_matrix(runs: DataFrame, model: str, kind: str, mode: str, valid: dict[str, set[str]], percent: str,
                      broken: str, items: str, total: str) -> DataFrame:
    """Mean defect percentage, interval and background share per model and mode.

    ``runs`` has one row per run; ``valid`` says which modes a kind of model has,
    others are left out. The background is the share of scenes that have the item
    at all. Inconsistent runs are counted, not dropped: ``incomplete`` (a number is
    missing), ``off_percent`` (the percentage is not broken / total),
    ``off_range`` (not broken <= items <= total), ``off_background`` (the share
    is below the percentage).
    """
    c = {n: F.col(n) for n in (percent, broken, items, total)}
    known = F.lit(False)
    for k, modes in sorted(valid.items()):
        known = known | ((F.col(kind) == k) & F.col(mode).isin(sorted(modes)))
    share = lambda part: F.when(c[total] != 0, 100.0 * part / c[total]).otherwise(
        F.when(c[total] == 0, 0.0))
    missing = c[percent].isNull() | c[broken].isNull() | c[items].isNull() | c[total].isNull()
    out = runs.where(known).groupBy(model, mode).agg(
        F.count(percent).alias("n"), F.avg(percent).alias("mean"),
        F.coalesce(F.stddev_samp(percent), F.lit(0.0)).alias("std"), F.avg(share(c[items])).alias("background"),
        F.count_if(missing).alias("incomplete"),
        F.count_if(F.abs(c[percent] - share(c[broken])) > 1e-3).alias("off_percent"),
        F.count_if((c[broken] > c[items]) | (c[items] > c[total])).alias("off_range"),
        F.count_if(share(c[items]) < c[percent]).alias("off_background"))
    return out.withColumn("half_width", half_width(F.col("std"), F.col("n")))


def curve_aggregate(scores: DataFrame, group: list[str], run: str, epoch: str, score: str,
                    require_all: bool = True) -> DataFrame:
    """Mean, sample deviation, count and interval per epoch across runs.

    ``scores`` holds one score per run and epoch. With ``require_all`` only
    epochs that every run of the group has are kept.
    """
    points = scores.groupBy(*group, epoch).agg(
        F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        F.count("*").alias("n"))
    points = points.withColumn("half_width", half_width(F.col("std"), F.col("n")))
    if not require_all:
        return points
    runs = scores.select(*group, run).distinct().groupBy(*group).agg(F.count("*").alias("_runs"))
    return lookup_join(points, runs, group).where("n = _runs").drop("_runs")


def best_model_stats(summaries: DataFrame, by: list[str], tie: list[str], values: list[str]
                     ) -> DataFrame:
    """Count, and mean and median of each value ignoring nulls, per group."""
    out = summaries.groupBy(*by).agg(
        F.count("*").alias("models"), *[F.avg(v).alias(f"{v}_avg") for v in values])
    for v in values:
        out = null_safe_join(out, group_quantiles(summaries, by, v, tie, {f"{v}_median": 0.5}), by, "left")
    return out


def keyed_run_stats(runs: DataFrame, level: str, run: str, metrics: str) -> DataFrame:
    """Per level and key over repeated runs: mean, median, population deviation."""
    facts = runs.select(level, run, F.explode(metrics).alias("key", "value"))
    by = [level, "key"]
    medians = group_quantiles(facts, by, "value", [run], {"median": 0.5})
    moments = facts.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return null_safe_join(moments, medians, by)


def overall_averages(per_level: DataFrame) -> DataFrame:
    """Unweighted mean over levels of the per-level means."""
    return per_level.groupBy("key").agg(F.avg("mean").alias("mean"))


def score_spread(scores: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """Mean, population deviation, minimum, maximum, median and count per group."""
    stats = scores.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"),
        F.max(value).alias("high"), F.count("*").alias("n"))
    return null_safe_join(stats, group_quantiles(scores, by, value, tie, {"median": 0.5}), by)


def five_numbers(facts: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    return group_quantiles(facts, by, value, tie, {
        "low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def rollup_files(scores: DataFrame, file: str, value: str, cumulative: bool = False) -> DataFrame:
    """Statistics per file; ``cumulative`` also counts all files before in name order."""
    sums = scores.groupBy(file).agg(F.count("*").alias("n"), F.sum(value).alias("s"),
                                    F.min(value).alias("low"), F.max(value).alias("high"))
    if cumulative:
        w = W.orderBy(file).rowsBetween(W.unboundedPreceding, 0)  # one row per file
        sums = sums.select(file, F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"),
                           F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))
    return sums.select(file, "n", (F.col("s") / F.col("n")).alias("mean"), "low", "high")


def combine_stages(groups: DataFrame, stage_pairs: DataFrame) -> DataFrame:
    """Add two run groups stage by stage.

    ``groups`` has ``group, mean, times, best_mean, best_times``; ``stage_pairs``
    ``(first, second, combined)``. Lists add element by element up to the
    shorter one; a second stage without best times counts in full. ``missing``
    says whether a side was not found.
    """
    side = lambda p: groups.select(F.col("group").alias(p), *[
        F.col(c).alias(f"{p}_{c}") for c in ("mean", "times", "best_mean", "best_times")])
    both = stage_pairs.join(side("first"), "first", "left").join(side("second"), "second", "left")
    second_best = F.coalesce("second_best_times", "second_times")

    def add(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x + y)

    has_best = F.col("first_best_times").isNotNull()
    return both.select(
        "combined", (F.col("first_mean").isNull() | F.col("second_mean").isNull()).alias("missing"),
        (F.col("first_mean") + F.col("second_mean")).alias("mean"),
        add(F.col("first_times"), F.col("second_times")).alias("times"),
        F.when(has_best, F.coalesce("first_best_mean", F.lit(0.0)) + F.coalesce(
            "second_best_mean", "second_mean", F.lit(0.0))).alias("best_mean"),
        F.when(has_best, add(F.col("first_best_times"), second_best)).alias("best_times"))


def prefer_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of both sets by key; where both have one, the new one wins."""
    values = [c for c in new.columns if c != key]
    joined = new.alias("n").join(old.alias("o"), key, "full_outer")
    return joined.select(key, *[F.when(F.col(f"n.{values[0]}").isNotNull(), F.col(f"n.{c}")).otherwise(
        F.col(f"o.{c}")).alias(c) for c in values])


def audit(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Compare expected artefacts with observed counts.

    ``manifest`` has ``run, artefact, expected, needs_prompt``; ``observed``
    ``run, artefact, found, has_prompt``. ``message`` is null when complete.
    """
    joined = manifest.join(observed, ["run", "artefact"], "left")
    return joined.select(
        "run", "artefact",
        F.when(F.col("found").isNull(), F.concat(F.lit("missing: "), "artefact"))
        .when(F.col("found") != F.col("expected"), F.concat(
            F.lit("expected "), F.col("expected").cast("string"), F.lit(" but found "),
            F.col("found").cast("string")))
        .when(F.col("needs_prompt") & ~F.col("has_prompt"), "missing prompt").alias("message"))


def discover_runs(paths: DataFrame, path: str, unnumbered: str | None = None) -> DataFrame:
    """Group, run number, type and caption style from directory names.

    Conditional runs end with their number. Names that contain ``unnumbered``
    count as runs, too, as run 0 if they have no number.
    """
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    number = F.regexp_extract("name", r"(\d+)(?!.*\d)", 1)
    kind = (F.when(F.col("name").rlike("-conditional-.*[0-9]$|-conditional-[0-9]$"), "conditional")
            .when(F.col("name").contains("fdm"), "fdm").when(F.col("name").rlike(r"unconditional\d+$"),
                                                             "unconditional")
            .when(F.col("name").rlike(r"wgan\d+$"), "wgan"))
    if unnumbered is not None:
        kind = kind.when(F.col("name").contains(unnumbered), "unnumbered")
    named = paths.select(name.alias("name")).withColumns({
        "kind": kind, "run": F.when(number == "", 0).otherwise(F.expr("try_cast(regexp_extract(name, "
                                                                      "'(\\\\d+)(?!.*\\\\d)', 1) AS int)"))})
    return named.where("kind IS NOT NULL").select(
        "name", "kind", "run", F.regexp_replace("name", r"\d+(?!.*\d).*$", "").alias("group"),
        F.when(F.lower("name").contains("absence"), "absence").otherwise("regular").alias("style"))
