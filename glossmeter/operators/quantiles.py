"""Exact quantiles with linear interpolation, without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here equal
values are merged first (with map-side combine), values are put into narrow bins by their
leading bits, and only the bins that contain a wanted rank are looked into. All steps are
ordinary aggregations and windows over (group, bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Bins are relative: 2**BIN_BITS of them per factor of two.
BIN_BITS = 10
_PER_OCTAVE = 1 << BIN_BITS

# Bin that grows with the value, from its binary exponent and leading mantissa bits. log2 may
# land a step low or high next to a power of two; clamping the mantissa keeps bins ordered.
_EXPONENT = "floor(log2(abs(_v)))"
_MANTISSA = (f"least(greatest(floor((abs(_v) / power(2D, {_EXPONENT}) - 1D) * {_PER_OCTAVE}), 0), {_PER_OCTAVE - 1})")
_BIN = (f"cast(CASE WHEN _v = 0D THEN 0 ELSE signum(_v) * (({_EXPONENT} + 1100) * {_PER_OCTAVE} + {_MANTISSA} + 1) END "
        "AS bigint) AS _bin")


def quantiles(rows: DataFrame, group: Sequence[str], value: str,
              points: dict[str, float], mean: str | None = None, count: str | None = None) -> DataFrame:
    """One row per group with the quantile columns named in ``points``.

    Null values do not count. ``mean`` and ``count`` name optional extra columns.
    """
    merged = (rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
              .selectExpr(*group, "_v", "_c", _BIN))
    bins = merged.groupBy(*group, "_bin").agg(F.expr("sum(_c) AS _c"), F.expr("sum(_v * _c) AS _s"))
    keys = ", ".join(group)
    before = f"(PARTITION BY {keys} ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = bins.selectExpr(*group, "_bin", "_c", f"sum(_c) OVER (PARTITION BY {keys}) AS _n",
                             f"sum(_s) OVER (PARTITION BY {keys}) AS _total",
                             f"coalesce(sum(_c) OVER {before}, 0) AS _start")
    places = [f"{float(q)!r}D * (_n - 1)" for q in points.values()]
    ranks = [f"{side}({at})" for at in places for side in ("floor", "ceil")]
    hit = " OR ".join(f"({r} >= _start AND {r} < _start + _c)" for r in ranks)
    wanted = marked.where(hit).select(*group, "_bin", "_n", "_total", "_start")
    upto = f"(PARTITION BY {keys}, _bin ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = merged.join(wanted, [*group, "_bin"]).selectExpr(
        *group, "_v", "_n", "_total", "_c", f"_start + sum(_c) OVER {upto} AS _hi")
    picks = [F.expr(f"max(CASE WHEN {r} >= _hi - _c AND {r} < _hi THEN _v END) AS _r{i}") for i, r in enumerate(ranks)]
    found = placed.groupBy(*group).agg(F.expr("max(_n) AS _n"), F.expr("max(_total) AS _total"), *picks)
    out = [f"_r{2 * i} + (_r{2 * i + 1} - _r{2 * i}) * ({at} - floor({at})) AS {name}"
           for i, (name, at) in enumerate(zip(points, places))]
    if count:
        out.insert(0, f"_n AS {count}")
    if mean:
        out.append(f"_total / _n AS {mean}")
    return found.selectExpr(*group, *out)
