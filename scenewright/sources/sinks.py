"""Writers: samples, JSON lines and ASCII levels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What to do when the target exists, by name.
MODES = {"fail": "errorifexists", "skip": "ignore", "replace": "overwrite", "append": "append"}


def write_samples(df: DataFrame, path: str, if_exists: str = "fail") -> None:
    """JSON lines, one sample per line."""
    df.write.mode(MODES[if_exists]).json(path, ignoreNullFields=False)


def write_versioned(df: DataFrame, path: str, version: str) -> str:
    """Keep what is there: every version gets its own folder."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").json(target)
    return target


def write_backed_up(df: DataFrame, path: str, backup: str) -> None:
    """JSON lines; what is there is copied to ``backup`` first, replacing an older copy."""
    try:
        df.sparkSession.read.text(path).write.mode("overwrite").text(backup)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def ascii_text(rows: Column, last_rows: int | None = None) -> Column:
    """A scene as text, one line per row; optionally only the lowest rows."""
    shown = rows if last_rows is None else F.slice(
        rows, F.greatest(F.lit(1), F.size(rows) - last_rows + 1), F.lit(last_rows))
    return F.array_join(shown, "\n")


def write_ascii(df: DataFrame, path: str, last_rows: int | None = None, if_exists: str = "fail") -> None:
    """Text files whose records are scenes separated by a blank line."""
    df.select(F.concat(ascii_text(F.col("rows"), last_rows), F.lit("\n"))).write.mode(
        MODES[if_exists]).text(path)
