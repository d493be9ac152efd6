"""Refusals. A gate runs one action over violation rows and names them, before anything is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SHOWN = 20


class Refused(ValueError):
    """A result that must not be published."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with the first offending rows if there are any."""
    rows = violations.take(SHOWN + 1)
    if rows:
        listed = "; ".join(str(r.asDict()) for r in rows[:SHOWN])
        raise Refused(f"{message}: {listed}{' ...' if len(rows) > SHOWN else ''}")


def require_aligned(alignment: DataFrame) -> None:
    require_empty(alignment.where(~F.col("aligned")), "languages are not line-aligned")


def require_sentences(sizes: DataFrame, corpora: Sequence[str]) -> None:
    """Every corpus in use has at least one baseline sentence."""
    have = {r["corpus"] for r in sizes.where(F.col("n_sentences") > 0).collect()}
    empty = sorted(set(corpora) - have)
    if empty:
        raise Refused(f"corpora without sentences: {empty}")


def require_chars(agg: DataFrame) -> None:
    require_empty(agg.where(F.coalesce("total_chars", F.lit(0)) == 0).select("corpus", "counter_id", "lang"),
                  "rows without characters cannot form a per-character cost")


def require_finite(frame: DataFrame, value: str, keys: Sequence[str]) -> None:
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    require_empty(frame.where(bad).select(*keys), f"non-finite {value}")


def require_published(deltas: DataFrame) -> None:
    """A published value without a measurement, or outside the tolerance, is a failure."""
    require_empty(deltas.where(F.col("delta").isNull()), "published premiums without a measurement")
    require_empty(deltas.where(~F.col("passes")), "premiums that miss the published values")


def missing(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def registry_differences(declared: DataFrame, found: DataFrame, key: str, what: str) -> DataFrame:
    """Two registries of one thing: what only one of them lists."""
    a = missing(declared, found, [key]).select(F.lit(f"{what} declared but absent").alias("issue"), F.col(key).alias("id"))
    b = missing(found, declared, [key]).select(F.lit(f"{what} present but undeclared").alias("issue"), F.col(key).alias("id"))
    return a.unionByName(b)
