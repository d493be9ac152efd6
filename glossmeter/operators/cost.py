"""Cost per 1,000 characters and per sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossmeter import dims
from glossmeter.functions.numbers import ratio, round_even


def cost_table(agg: DataFrame, sizes: DataFrame, prices: DataFrame, languages: DataFrame,
               usd_to_vnd: float = dims.USD_TO_VND) -> DataFrame:
    """Token density and cost under both denominators.

    Every output is rounded once, from the unrounded value. No price means no cost, never 0.
    """
    joined = (agg.join(sizes, "corpus", "left").join(prices, "counter_id", "left")
              .join(languages.select("lang", "language"), "lang", "left"))
    per_1k = ratio(F.col("total_tokens"), F.col("total_chars")) * 1000.0
    per_sentence = ratio(F.col("total_tokens"), F.col("n_sentences"))
    usd = F.col("input_usd_per_mtok") / 1_000_000.0
    return joined.select(
        "corpus", "counter_id", "lang",
        F.coalesce("language", F.concat("lang", F.lit(" (retired)"))).alias("language"),
        round_even(per_1k, 2).alias("tokens_per_1k_chars"),
        round_even(per_sentence, 2).alias("tokens_per_sentence"),
        F.col("input_usd_per_mtok").alias("price_usd_per_mtok"),
        F.coalesce("confidence", F.lit("unknown")).alias("price_confidence"),
        round_even(per_1k * usd, 6).alias("cost_usd_per_1k_chars"),
        round_even(per_1k * usd * usd_to_vnd, 2).alias("cost_vnd_per_1k_chars"),
        round_even(per_sentence * usd, 8).alias("cost_usd_per_sentence"),
        round_even(per_sentence * usd * usd_to_vnd, 4).alias("cost_vnd_per_sentence"))


def priced(cost: DataFrame) -> DataFrame:
    return cost.where(F.col("cost_usd_per_1k_chars").isNotNull())
