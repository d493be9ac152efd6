"""Incremental runs: keep stored rows that were not measured again, and refuse doubtful ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from glossmeter.dims import Dimensions

AXES = {"counter": "counter_id", "corpus": "corpus", "language": "lang"}


def known_values(dims: Dimensions) -> dict[str, list[str]]:
    return {"counter_id": dims.counter_ids(), "corpus": list(dims.corpora), "lang": list(dims.languages)}


def carried(prior: DataFrame, dims: Dimensions, selected: Sequence[str], ran: Sequence[str]) -> DataFrame:
    """Stored rows that stay: configured on every axis and not measured in this pass.

    A row counts as measured when its corpus was selected and its counter ran. The tests are
    plain membership filters, so they reach the scan and prune partitions by corpus or counter.
    """
    measured = F.col("corpus").isin(list(selected)) & F.col("counter_id").isin(list(ran))
    rows = prior.where(~measured)
    for column, values in known_values(dims).items():
        rows = rows.where(F.col(column).isin(values))
    return rows


def merge(prior: DataFrame | None, measured: DataFrame | None, dims: Dimensions,
          selected: Sequence[str], ran: Sequence[str]) -> DataFrame | None:
    """Carried rows plus measured rows, by column name; either side may be absent."""
    kept = carried(prior, dims, selected, ran) if prior is not None else None
    if kept is None or measured is None:
        return kept if measured is None else measured
    return kept.unionByName(measured, allowMissingColumns=True)


def purged(prior: DataFrame, dims: Dimensions) -> DataFrame:
    """Stored values no longer configured, per axis."""
    known = known_values(dims)
    tagged = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(column).alias("value"),
                                F.col(column).isin(known[column]).alias("known"))
                       for axis, column in AXES.items()])
    return (prior.select(F.explode(tagged).alias("_e")).where(~F.col("_e.known"))
            .select("_e.axis", "_e.value").distinct())


def stale_specs(rows: DataFrame, counters: DataFrame) -> DataFrame:
    """Carried counters whose rows were measured on another spec than the matrix names now."""
    if "spec" not in rows.columns:
        return rows.limit(0).select("counter_id", F.lit("").alias("recorded_spec"), F.lit("").alias("current_spec"))
    recorded = rows.where(F.col("spec").isNotNull()).select("counter_id", F.col("spec").alias("recorded_spec")).distinct()
    return (recorded.join(counters.select("counter_id", F.col("spec").alias("current_spec")), "counter_id")
            .where(F.col("recorded_spec") != F.col("current_spec")))


def unrecorded_specs(rows: DataFrame) -> DataFrame:
    """Counters whose rows record no spec at all."""
    spec = F.col("spec") if "spec" in rows.columns else F.lit(None).cast("string")
    return (rows.groupBy("counter_id").agg(F.count(spec).alias("_n"))
            .where(F.col("_n") == 0).select("counter_id"))


def changed_corpora(before: DataFrame, now: DataFrame) -> DataFrame:
    """Corpora whose fingerprint differs from the recorded one; unrecorded ones are not judged."""
    was = before.select("corpus", F.col("fingerprint").alias("_was"))
    return now.join(was, "corpus").where(F.col("_was").isNotNull() & (F.col("_was") != F.col("fingerprint"))) \
        .select("corpus", F.col("_was").alias("recorded"), "fingerprint")


def lost_distributions(agg: DataFrame, raw: DataFrame) -> DataFrame:
    """Counters with totals but no per-sentence rows."""
    ids = agg.select("counter_id").distinct()
    return ids.join(raw.select("counter_id").distinct(), "counter_id", "left_anti")


def measured_on_summary(agg: DataFrame) -> DataFrame:
    """One date per counter, ``mixed: ...`` for several, ``unrecorded`` for none."""
    stamp = F.col("measured_on") if "measured_on" in agg.columns else F.lit(None).cast("string")
    dates = agg.groupBy("counter_id").agg(F.sort_array(F.collect_set(stamp)).alias("_d"))
    text = (F.when(F.size("_d") == 0, "unrecorded").when(F.size("_d") == 1, F.element_at("_d", 1))
            .otherwise(F.concat(F.lit("mixed: "), F.array_join("_d", ", "))))
    return dates.select("counter_id", F.when(F.size("_d") == 0, "unrecorded").otherwise(text).alias("measured_on"))


def coverage(rows: DataFrame, configured: Sequence[str], last: str) -> DataFrame:
    """One row that says what the stored numbers rest on, from one pass over the rows.

    Counters in the dataset, those measured on the date of the last pass and those carried from before it, configured
    ones without rows, the dates of each counter, corpora and languages, and the languages that a counter lacks somewhere.
    """
    stamp = F.coalesce(F.col("measured_on") if "measured_on" in rows.columns else F.lit(None).cast("string"), F.lit("unrecorded"))
    per = rows.groupBy("counter_id").agg(
        F.array_join(F.sort_array(F.collect_set(stamp)), "|").alias("dates"), F.bool_or(F.coalesce(stamp == last, F.lit(False))).alias("fresh"),
        F.collect_set("corpus").alias("corpora"), F.collect_set("lang").alias("langs"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct("corpus", "lang")).alias("cells"))
    name = F.col("counter_id")

    def listed(values):
        return F.array_join(F.sort_array(values), ",")

    together = per.agg(
        listed(F.collect_list(name)).alias("counters_in_dataset"), listed(F.collect_list(F.when(F.col("fresh"), name))).alias("counters_measured_last_pass"),
        listed(F.collect_list(F.when(~F.col("fresh"), name))).alias("counters_carried_forward"),
        listed(F.collect_list(F.concat(name, F.lit("="), "dates"))).alias("measured_on_by_counter"),
        F.array_distinct(F.flatten(F.collect_list("corpora"))).alias("_corpora"), F.array_distinct(F.flatten(F.collect_list("langs"))).alias("_langs"),
        F.collect_list(F.struct(name, "cells")).alias("_cells"), F.collect_list(name).alias("_known"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    whole = F.size("_corpora") * F.size("_langs")
    return together.select(
        "counters_in_dataset", "counters_measured_last_pass", "counters_carried_forward",
        listed(F.array_except(F.array(*[F.lit(c) for c in configured]).cast("array<string>"), "_known")).alias("counters_without_rows"),
        "measured_on_by_counter", listed(F.col("_corpora")).alias("corpora"), listed(F.col("_langs")).alias("langs"),
        listed(F.transform(F.filter("_cells", lambda c: c["cells"] < whole), lambda c: c["counter_id"])).alias("counters_with_gaps"), "n_rows")
