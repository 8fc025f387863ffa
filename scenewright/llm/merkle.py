"""Merkle dataset manifest by lag and lead windows.

A row is hashed to a leaf; leaves of a group ascend by key and every ``fanout``
consecutive nodes become one until a single subroot is left; the subroots of all
groups, in the order of the groups, give the root in the same way.

Nodes carry their position in the group. Aligned chunks of ``fanout ** HEIGHT``
nodes are the window partitions, so a group of any size is spread over many
tasks. Inside a chunk one sort serves all levels: a node of level ``l`` sits on
the row of its first leaf, so its siblings are the rows ``fanout ** l`` before or
after (times one to ``fanout - 1``). These fixed-offset lags and leads are masked
by the node's slot in its run and by the run's length; rows of first children
hash the parents. The last chunk roots of a pass are the nodes of the next one,
which is that much smaller. The way back joins each chunk's path to its rows.

Positions come from one range exchange (with a random last key, so that equal
rows can be split) and the row counts of its partitions.

Defined cases: a null field is ``-`` and an empty one ``0:``; a null group is a
group of its own, before all others; null keys come first; rows with equal keys
are ordered by their leaf, so repeated rows are neighbours and any of them may
take either place; a very long text is hashed where it is read and never moved;
an empty table gives no rows; only the named columns are read, whatever else the
table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.llm.corpus import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one sort of the nodes serves; chunks hold fanout ** HEIGHT nodes.
HEIGHT = 8
ROWS_PER_RANGE = 1 << 20
#: monotonically_increasing_id holds the partition above this many bits.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, run: digest(run["before"], h, run["after"]))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def positions(rows: DataFrame, order: list[str], most_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``pos``, the 0-based place in group ``g`` by ``order``, and ``n``, the rows of the group."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most_rows))
    keys = ["g", *order]
    placed = (rows.withColumn("_salt", F.rand(11)).repartitionByRange(ranges, *keys, "_salt")
              .sortWithinPartitions(*keys, "_salt").drop("_salt")
              .withColumn("_id", F.monotonically_increasing_id()))
    placed = (stored(placed, "merkle-order").withColumn("_range", F.shiftright("_id", ROW_BITS))
              .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    runs = placed.groupBy("_range", "g").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = W.partitionBy("g")
    starts = runs.select(
        "_range", "g", "_first", F.sum("_n").over(group).alias("n"),
        F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (placed.join(starts, ["_range", "g"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_id", "_range", "_at", "_first", "_before"))


def _climb(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """Add ``chunk``, ``path`` (the siblings of each level inside the chunk) and ``top`` (the chunk's root)."""
    pos, n, d = F.col("pos"), F.col("n"), F.col("_d")
    whole = lambda a, b: F.floor(a / b)
    at = W.partitionBy("g", "chunk").orderBy("pos")
    rows = nodes.withColumn("chunk", whole(pos, F.lit(fanout**height))).withColumn("_d", F.col("digest"))
    for level in range(height):
        step = fanout**level
        index, count = whole(pos, F.lit(step)), F.ceil(n / F.lit(step))
        slot = index % fanout
        here = (pos % step == 0) & (count > 1)
        none = F.lit("")
        before = [F.when(slot >= j, F.lag("_d", j * step).over(at)).otherwise(none) for j in range(fanout - 1, 0, -1)]
        after = [F.when((slot + j < fanout) & (index + j < count), F.lead("_d", j * step).over(at)).otherwise(none)
                 for j in range(1, fanout)]
        rows = rows.withColumns({f"_b{level}": F.when(here, F.concat(*before)), f"_a{level}": F.when(here, F.concat(*after))})
        rows = rows.withColumn("_d", F.when(here & (slot == 0), digest(d, F.col(f"_a{level}"))).when(count == 1, d))
    so_far = at.rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [f"_{side}{level}" for level in range(height) for side in "ba"]
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in [*names, "_d"]})
    path = F.array(*[F.when(F.col(f"_b{level}").isNotNull(), F.struct(F.col(f"_b{level}").alias("before"), F.col(f"_a{level}").alias("after")))
                     for level in range(height)])
    return rows.withColumn("path", F.array_compact(path)).withColumnRenamed("_d", "top").drop(*names)


def _levels(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The nodes, then the chunk roots of each pass, until every group has one."""
    width = fanout**height
    stages, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops = (_climb(stages[-1].select("g", "pos", "n", "digest"), fanout, height).where(F.col("pos") % width == 0)
                .select("g", F.col("chunk").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("digest")))
        stages.append(stored(tops, "merkle-level"))
        most = -(-most // width)
    return stages


def _paths(stages: list[DataFrame], above: DataFrame, fanout: int, height: int) -> DataFrame:
    """Rows of the lowest level with their whole path; ``above`` has g, path and what else a group hands down."""
    handed = [c for c in above.columns if c not in ("g", "path")]
    upper = above.withColumn("pos", F.lit(0).cast("long"))
    for i, nodes in reversed([*enumerate(stages[:-1])]):
        upper = upper.select("g", F.col("pos").alias("chunk"), F.col("path").alias("_up"), *handed)
        upper = _climb(nodes, fanout, height).join(upper, ["g", "chunk"]).withColumn("path", F.concat("path", "_up")).drop("_up", "chunk", "top")
        if i:
            upper = upper.drop("n", "digest")
    if len(stages) == 1:  # every group is a lone row
        upper = stages[0].join(upper.drop("pos"), "g")
    return upper


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", fanout: int = 2,
             changes: dict[str, dict[str, Column]] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: key, leaf, path (siblings before and after, from the leaf up), subroot and root.

    ``changes`` names further leaves of the same row with some fields replaced,
    to be checked against the manifest.
    """
    column = {c: F.col(f"`{c}`") for c in fields}
    others = {name: leaf([change.get(c, column[c]) for c in fields]).alias(name) for name, change in (changes or {}).items()}
    # a null group sorts and joins as the empty string, others behind a mark
    leaves = stored(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),
        F.col(f"`{key}`").alias("key"), leaf([column[c] for c in fields]).alias("digest"), *others.values()), "merkle-leaves")
    stages = _levels(positions(leaves, ["key", "digest"]), fanout, height)
    subroots = stages[-1].where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("member"), "digest")
    roots = _levels(positions(subroots, ["member"]), fanout, height)
    top = roots[-1].select("g", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    above = _paths(roots, top, fanout, height).select(F.col("member").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    return _paths(stages, above, fanout, height).select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), *others, "path", "subroot", "root")
