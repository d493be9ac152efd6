"""Premium against a baseline language: aggregate ratios and per-sentence distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from glossmeter import dims
from glossmeter.counters import TextCounter
from glossmeter.functions.numbers import ratio, round_even
from glossmeter.functions.text import sql_text
from glossmeter.operators.quantiles import quantiles

POINTS = {"premium_median": 0.50, "premium_p10": 0.10, "premium_p25": 0.25,
          "premium_p75": 0.75, "premium_p90": 0.90}


def missing_cells(agg: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Configured languages a counter has no aggregate row for, per corpus."""
    declared = F.array(*[F.lit(l) for l in languages])
    covered = agg.groupBy("corpus", "counter_id").agg(F.collect_set("lang").alias("_have"))
    return covered.select("corpus", "counter_id",
                          F.explode(F.array_except(declared, F.col("_have"))).alias("lang"))


def aggregate_premium(agg: DataFrame, languages: DataFrame, baseline: str) -> DataFrame:
    """total(lang) / total(baseline) on envelope-inclusive totals, 4 decimals."""
    base = (agg.where(F.col("lang") == baseline)
            .select("corpus", "counter_id", F.col("total_tokens").alias("_base")))
    return (agg.join(base, ["corpus", "counter_id"])
            .join(languages.select("lang", "language"), "lang")
            .select("corpus", "counter_id", "lang", "language",
                    round_even(ratio(F.col("total_tokens"), F.col("_base")), 4).alias("premium_aggregate")))


def sentence_ratios(raw: DataFrame, baseline: str) -> DataFrame:
    """lang / baseline tokens of the same sentence, from stored raw counts.

    Content tokens are used, or the inclusive count of a row that predates them. Sentences the
    baseline lacks or counts as 0 drop out. One shuffle; a window group is one sentence.
    """
    tokens = F.col("n_tokens")
    if "n_tokens_content" in raw.columns:
        tokens = F.coalesce("n_tokens_content", "n_tokens")
    sentence = Window.partitionBy("corpus", "counter_id", "sentence_idx")
    base = F.max(F.when(F.col("lang") == baseline, F.col("_tok"))).over(sentence)
    return (raw.select("corpus", "counter_id", "lang", "sentence_idx", tokens.alias("_tok"))
            .withColumn("ratio", ratio(F.col("_tok"), base))
            .where(F.col("ratio").isNotNull()).drop("_tok"))


def unit_ratios(counted: DataFrame, counters: Sequence[TextCounter], baseline: str,
                sample: int = dims.API_SAMPLE) -> DataFrame:
    """Same as :func:`sentence_ratios`, straight from counted units.

    All counters of a sentence travel in one row, so the shuffle moves one row per unit and
    not one per unit and counter.
    """
    tokens = [f"_t{i}" for i in range(len(counters))]
    bases = [f"max(CASE WHEN lang = {sql_text(baseline)} THEN {t} END) OVER (PARTITION BY corpus, sentence_idx) AS _b{i}"
             for i, t in enumerate(tokens)]
    entries = []
    for i, c in enumerate(counters):
        sampled = f" AND sentence_idx < {sample}" if c.is_api else ""
        entries.append(f"CASE WHEN _t{i} IS NOT NULL AND _b{i} <> 0{sampled} THEN "
                       f"named_struct('counter_id', {sql_text(c.counter_id)}, 'ratio', cast(_t{i} AS double) / _b{i}) END")
    rows = counted.selectExpr("corpus", "lang", "sentence_idx", *tokens, *bases).selectExpr(
        "corpus", "lang", "sentence_idx", f"inline(array_compact(array({', '.join(entries)})))")
    return rows.select("corpus", "counter_id", "lang", "sentence_idx", "ratio")


def distribution(ratios: DataFrame) -> DataFrame:
    """Sample size, quantiles and mean of the ratios, 4 decimals."""
    found = quantiles(ratios, ["corpus", "counter_id", "lang"], "ratio", POINTS,
                      mean="premium_mean", count="distribution_n")
    rounded = [round_even(F.col(c), 4).alias(c) for c in (*POINTS, "premium_mean")]
    return found.select("corpus", "counter_id", "lang", "distribution_n", *rounded)


def premium_table(agg: DataFrame, ratios: DataFrame, sizes: DataFrame, languages: DataFrame,
                  baseline: str) -> DataFrame:
    """One row per corpus x counter x language; a distribution only where it was measured."""
    n = F.coalesce("n_sentences", F.lit(0))
    full = F.col("distribution_n") >= n
    basis = F.when(full, F.lit("full sweep")).when(F.col("distribution_n").isNotNull(), F.concat(
        F.lit("head slice [:"), F.col("distribution_n"),
        F.lit("], topically clustered — not a random sample")))
    table = (aggregate_premium(agg, languages, baseline)
             .join(sizes, "corpus", "left")
             .join(distribution(ratios), ["corpus", "counter_id", "lang"], "left"))
    return table.select(
        "corpus", "counter_id", "lang", "language", "premium_aggregate",
        F.concat(F.lit("full corpus ("), n, F.lit(" sentences, one count per language)")).alias("aggregate_basis"),
        "distribution_n", basis.alias("distribution_basis"), *POINTS, "premium_mean")


def premium_pivot(premium: DataFrame, counters: Sequence[str], value: str = "premium_aggregate") -> DataFrame:
    """Languages down, counters across."""
    return (premium.groupBy("corpus", "lang")
            .pivot("counter_id", list(counters)).agg(F.max(value)))


def headline_map(premium: DataFrame, baseline: str) -> DataFrame:
    """corpus -> counter -> language -> premium, as a nested map per corpus."""
    inner = (premium.where(F.col("lang") != baseline).groupBy("corpus", "counter_id")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(
                 F.struct("language", "premium_aggregate")))).alias("by_language")))
    return inner.groupBy("corpus").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("counter_id", F.col("by_language"))), _by_first)).alias("headline"))


def _by_first(a, b):
    return F.when(a["counter_id"] < b["counter_id"], -1).when(a["counter_id"] > b["counter_id"], 1).otherwise(0)


def published_deltas(agg: DataFrame, published: DataFrame, counter_id: str, corpus: str, baseline: str,
                     tolerance: float = dims.PUBLISHED_TOLERANCE) -> DataFrame:
    """Measured premium minus the published one, on unrounded ratios; strict tolerance.

    A published language without a measurement keeps its row with nulls, so a shrunken check
    can be refused (see gates.require_published).
    """
    rows = agg.where((F.col("corpus") == corpus) & (F.col("counter_id") == counter_id))
    base = rows.where(F.col("lang") == baseline).select("counter_id", F.col("total_tokens").alias("_base"))
    ours = rows.join(base, "counter_id").select("lang", ratio(F.col("total_tokens"), F.col("_base")).alias("_ours"))
    delta = F.col("_ours") - F.col("published")
    return (published.join(ours, "lang", "left")
            .select("lang", "published", round_even(F.col("_ours"), 4).alias("ours"),
                    round_even(delta, 6).alias("delta"), (F.abs(delta) < tolerance).alias("passes")))
