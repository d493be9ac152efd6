"""Chart data: column orders, series, scales, captions and figure names.

Inputs are result tables (corpora x counters x languages), whose size the configuration fixes;
orders over all counters are therefore taken in one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glossmeter import dims
from glossmeter.functions import colour
from glossmeter.functions.numbers import locale_date, locale_money, locale_number, ratio, round_even
from glossmeter.messages import confidence, message


# -- labels and orders ---------------------------------------------------------------------

def label() -> Column:
    """Short label of a counter."""
    return F.coalesce(F.nullif("headline_display", F.lit("")), F.col("display"))


def family_label() -> Column:
    """Label naming every model a column covers."""
    return F.coalesce(F.nullif("family_display", F.lit("")), label())


def labels(counters: DataFrame) -> DataFrame:
    return counters.select("counter_id", label().alias("label"), family_label().alias("family_label"))


def family() -> Column:
    """The headline counter whose tokenizer a counter shares: itself unless folded."""
    return F.when(F.col("headline"), F.col("counter_id")).otherwise(
        F.coalesce(F.nullif("flagship_group", F.lit("")), F.col("counter_id")))


def rank_keys(frame: DataFrame, value: str, corpora: DataFrame, lead: str) -> DataFrame:
    """Lead-language value per counter from the preferred corpus, completed from the others."""
    rows = (frame.where((F.col("lang") == lead) & F.col(value).isNotNull())
            .join(corpora.select("corpus", "preference"), "corpus"))
    first = Window.partitionBy("counter_id").orderBy("preference")
    return (rows.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
            .select("counter_id", F.col("corpus").alias("rank_corpus"), F.col(value).alias("rank_key")))


def _ordered(ids: DataFrame, ranks: DataFrame) -> DataFrame:
    order = Window.orderBy(F.asc_nulls_last("rank_key"), "counter_id")
    return (ids.join(ranks, "counter_id", "left")
            .select("counter_id", "rank_key", F.row_number().over(order).cast("bigint").alias("pos")))


def headline_order(premium: DataFrame, counters: DataFrame, corpora: DataFrame, lead: str) -> DataFrame:
    """Headline counters in the data by lead-language premium; unranked ones last."""
    ids = counters.where("headline").select("counter_id").join(
        premium.select("counter_id").distinct(), "counter_id", "left_semi")
    return _ordered(ids, rank_keys(premium, "premium_aggregate", corpora, lead))


def priced_order(cost: DataFrame, counters: DataFrame, corpora: DataFrame, lead: str) -> DataFrame:
    """Counters with a cost anywhere, folded or not, by lead-language cost."""
    priced = cost.where(F.col("cost_usd_per_1k_chars").isNotNull()).select("counter_id").distinct()
    ids = counters.select("counter_id").join(priced, "counter_id", "left_semi")
    return _ordered(ids, rank_keys(cost, "cost_usd_per_1k_chars", corpora, lead))


# -- chart data ----------------------------------------------------------------------------

def series(frame: DataFrame, order: DataFrame, value: str, scale: float = 1.0,
           langs: Sequence[str] | None = None) -> DataFrame:
    """Values of a grouped chart: the ordered counters x languages of every corpus."""
    rows = frame if langs is None else frame.where(F.col("lang").isin(list(langs)))
    return (rows.join(order.select("counter_id", "pos"), "counter_id")
            .select("corpus", "counter_id", "lang", "pos", (F.col(value) * scale).alias("value")))


def undrawn(frame: DataFrame, drawn: DataFrame, counters: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Measured headline counters (priced ones, if prices are given) a chart would leave out."""
    expected = frame.select("corpus", "counter_id").distinct().join(
        counters.where("headline").select("counter_id"), "counter_id", "left_semi")
    if prices is not None:
        expected = expected.join(prices.where(F.col("input_usd_per_mtok").isNotNull()).select("counter_id"),
                                 "counter_id", "left_semi")
    return expected.join(drawn.select("corpus", "counter_id").distinct(), ["corpus", "counter_id"], "left_anti")


def group_extremes(rows: DataFrame) -> DataFrame:
    """The labelled bar of every group: the tallest, the first drawn on a tie."""
    order = Window.partitionBy("corpus", "lang").orderBy(F.desc("value"), "pos")
    return (rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1)
            .select("corpus", "lang", "counter_id", "value"))


def heat_scale(cells: DataFrame) -> DataFrame:
    """Place of each cell on its corpus's scale.

    Diverging and symmetric in log around 1 when the cells straddle it; otherwise one-sided
    and linear from or to 1.
    """
    every = Window.partitionBy("corpus")
    v = F.col("value")
    low, high = F.min(v).over(every), F.max(v).over(every)
    cells = cells.withColumn("_low", low).withColumn("_high", high)
    span = F.greatest(F.abs(F.ln("_low")), F.abs(F.ln("_high")))
    straddles = (F.col("_low") < 1.0) & (F.col("_high") > 1.0)
    kind = F.when(straddles, "diverging").when(F.col("_low") >= 1.0, "dearer").otherwise("cheaper")
    place = (F.when(straddles, F.lit(0.5) + F.ln(v) / (F.lit(2.0) * span))
             .when(F.col("_low") >= 1.0, ratio(v - 1.0, F.col("_high") - 1.0))
             .otherwise(ratio(v - F.col("_low"), F.lit(1.0) - F.col("_low"))))
    return cells.select("corpus", "counter_id", "lang", "value", kind.alias("scale"),
                        round_even(place, 6).alias("place"))


def cost_ladder(cost: DataFrame, order: DataFrame, lead: str) -> DataFrame:
    """Lead-language cost of 1,000 units, cheapest first."""
    rows = (cost.where((F.col("lang") == lead) & F.col("cost_usd_per_sentence").isNotNull())
            .join(order.select("counter_id", F.col("pos").alias("_order")), "counter_id")
            .withColumn("usd_per_1k_units", F.col("cost_usd_per_sentence") * 1000.0))
    place = Window.partitionBy("corpus").orderBy("usd_per_1k_units", "_order")
    return rows.select("corpus", "counter_id", "usd_per_1k_units",
                       F.row_number().over(place).cast("bigint").alias("pos"))


def cost_spread(ladder: DataFrame) -> DataFrame:
    """Dearest over cheapest step of the ladder."""
    return ladder.groupBy("corpus").agg(
        F.min("usd_per_1k_units").alias("cheapest"), F.max("usd_per_1k_units").alias("dearest"),
        round_even(F.max("usd_per_1k_units") / F.min("usd_per_1k_units"), 6).alias("spread"))


def tax_gap(cost: DataFrame, order: DataFrame, baseline: str, lead: str) -> DataFrame:
    """Baseline and lead cost of 1,000 units per counter; pairs without both, or with a 0, drop out."""
    value = F.col("cost_usd_per_sentence") * 1000.0
    both = cost.groupBy("corpus", "counter_id").agg(
        F.max(F.when(F.col("lang") == baseline, value)).alias("baseline_usd"),
        F.max(F.when(F.col("lang") == lead, value)).alias("lead_usd"))
    rows = (both.where((F.col("baseline_usd") != 0) & (F.col("lead_usd") != 0))
            .join(order.select("counter_id", F.col("pos").alias("_order")), "counter_id"))
    place = Window.partitionBy("corpus").orderBy("lead_usd", "_order")
    return rows.select("corpus", "counter_id", "baseline_usd", "lead_usd",
                       (F.col("lead_usd") - F.col("baseline_usd")).alias("gap_usd"),
                       (F.col("lead_usd") / F.col("baseline_usd")).alias("gap_ratio"),
                       F.row_number().over(place).cast("bigint").alias("pos"))


def widest_gaps(gaps: DataFrame) -> DataFrame:
    """Counter with the largest difference and the one with the largest ratio, first on ties."""
    by_gap = F.max_by("counter_id", F.struct("gap_usd", -F.col("pos")))
    by_ratio = F.max_by("counter_id", F.struct("gap_ratio", -F.col("pos")))
    return gaps.groupBy("corpus").agg(by_gap.alias("widest"), by_ratio.alias("steepest"))


# -- captions ------------------------------------------------------------------------------

def _in_order(text: Column, order: Column, sep: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("s"))))["s"], sep)


def fold_legend(folds: DataFrame, counters: DataFrame, prices: DataFrame, order: DataFrame) -> DataFrame:
    """``flagship = member = ...`` per drawn headline column and corpus.

    Members are priced, measured on another spec than the column, and verified identical.
    """
    flags = counters.select(F.col("counter_id").alias("flagship_group"), F.col("spec").alias("_spec"),
                            label().alias("_flag"))
    members = (folds.where("identical")
               .join(counters.where(F.col("fold_reason") == "shared")
                     .select("counter_id", "spec", "ord", label().alias("_label")), "counter_id")
               .join(prices.where(F.col("input_usd_per_mtok").isNotNull()).select("counter_id"), "counter_id", "left_semi")
               .join(flags, "flagship_group").where(F.col("spec") != F.col("_spec"))
               .join(order.select(F.col("counter_id").alias("flagship_group"), "pos"), "flagship_group"))
    return (members.groupBy("corpus", "flagship_group", "pos", "_flag")
            .agg(_in_order(F.col("_label"), F.col("ord"), " = ").alias("_members"))
            .select("corpus", "flagship_group", "pos",
                    F.concat("_flag", F.lit(" = "), "_members").alias("legend")))


def same_tokens_different_price(folds: DataFrame, cost: DataFrame, counters: DataFrame, prices: DataFrame,
                                order: DataFrame, locale: str = "en") -> DataFrame:
    """Priced counters of one verified tokenizer with their prices, where there are several."""
    drawn = (cost.select("corpus", "counter_id").distinct()
             .join(order.select("counter_id", "pos"), "counter_id")
             .join(counters, "counter_id")
             .join(prices.where(F.col("input_usd_per_mtok").isNotNull())
                   .select("counter_id", "input_usd_per_mtok"), "counter_id")
             .withColumn("_family", family())
             .join(folds.select("corpus", "counter_id", "identical"), ["corpus", "counter_id"], "left")
             .where((F.col("_family") == F.col("counter_id")) | F.col("identical")))
    entry = F.concat(label(), F.lit(" "), locale_money(F.col("input_usd_per_mtok"), locale))
    groups = drawn.groupBy("corpus", "_family").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), _in_order(entry, F.col("pos"), " / ").alias("_part"))
    return (groups.where(F.col("n") > 1).groupBy("corpus")
            .agg(_in_order(F.col("_part"), F.col("pos"), "; ").alias("parts")))


def hedged_prices(cost: DataFrame, counters: DataFrame, prices: DataFrame, order: DataFrame,
                  locale: str = "en") -> DataFrame:
    """Drawn prices that are not graded high, named with their grade."""
    rows = (cost.select("corpus", "counter_id").distinct().join(order.select("counter_id", "pos"), "counter_id")
            .join(counters.select("counter_id", label().alias("_label")), "counter_id")
            .join(prices.where(F.col("input_usd_per_mtok").isNotNull() & (F.col("confidence") != "high")), "counter_id"))
    entry = F.concat("_label", F.lit(" ("), confidence(F.col("confidence"), locale), F.lit(")"))
    return rows.groupBy("corpus").agg(_in_order(entry, F.col("pos"), ", ").alias("named"))


def price_dates(cost: DataFrame, prices: DataFrame, locale: str = "en") -> DataFrame:
    """As-of stamp of the prices in use, a range if they differ."""
    used = prices.where(F.col("input_usd_per_mtok").isNotNull()).select("counter_id", "as_of")
    span = (cost.select("corpus", "counter_id").distinct().join(used, "counter_id", "left").groupBy("corpus")
            .agg(F.coalesce(F.min("as_of"), F.lit(dims.PRICING_AS_OF)).alias("_from"),
                 F.coalesce(F.max("as_of"), F.lit(dims.PRICING_AS_OF)).alias("_to")))
    first, last = locale_date(F.col("_from"), locale), locale_date(F.col("_to"), locale)
    return span.select("corpus", F.when(F.col("_from") == F.col("_to"), first)
                       .otherwise(F.concat(first, F.lit("–"), last)).alias("as_of"))


def unpriced_headlines(cost: DataFrame, counters: DataFrame, prices: DataFrame) -> DataFrame:
    """Measured headline counters without a list price, named in matrix order."""
    rows = (cost.select("corpus", "counter_id").distinct()
            .join(counters.where("headline").select("counter_id", "ord", label().alias("_label")), "counter_id")
            .join(prices.where(F.col("input_usd_per_mtok").isNotNull()), "counter_id", "left_anti"))
    return rows.groupBy("corpus").agg(_in_order(F.col("_label"), F.col("ord"), ", ").alias("names"))


def cost_captions(cost: DataFrame, folds: DataFrame, counters: DataFrame, prices: DataFrame, order: DataFrame,
                  locale: str, usd_to_vnd: float = dims.USD_TO_VND) -> DataFrame:
    """Caption lines (corpus, line, text) under the per-character cost chart; lines without content are left out."""
    rate = locale_number(F.lit(float(int(usd_to_vnd))), 0, locale)
    head = price_dates(cost, prices, locale).select("corpus", message(
        locale, "cap_usd_per_1m_chars", as_of=F.col("as_of"), rate=rate).alias("text"))
    hedged = hedged_prices(cost, counters, prices, order, locale).select("corpus", message(
        locale, "cap_price_confidence", named=F.col("named")).alias("text"))
    same = same_tokens_different_price(folds, cost, counters, prices, order, locale).select("corpus", message(
        locale, "cap_same_tokens", parts=F.col("parts")).alias("text"))
    unpriced = unpriced_headlines(cost, counters, prices).select("corpus", message(
        locale, "cap_unpriced", names=F.col("names")).alias("text"))
    lines = [rows.withColumn("line", F.lit(i)) for i, rows in enumerate((head, hedged, same, unpriced))]
    return reduce(DataFrame.unionByName, lines)


def gap_caption(gaps: DataFrame, counters: DataFrame, units: DataFrame, locale: str) -> DataFrame:
    """Caption of the gap chart: widest difference and steepest ratio, which need not be one counter."""
    named = gaps.join(labels(counters), "counter_id")
    cell = F.struct("label", "gap_usd", "gap_ratio")
    picks = named.groupBy("corpus").agg(F.max_by(cell, F.struct("gap_usd", -F.col("pos"))).alias("w"),
                                        F.max_by(cell, F.struct("gap_ratio", -F.col("pos"))).alias("s"))
    text = message(locale, "cap_dumbbell_gaps", unit=F.col("unit"), widest=F.col("w.label"), steepest=F.col("s.label"),
                   widest_delta=locale_money(F.col("w.gap_usd"), locale, 4), widest_ratio=locale_number(F.col("w.gap_ratio"), 2, locale),
                   steepest_delta=locale_money(F.col("s.gap_usd"), locale, 4), steepest_ratio=locale_number(F.col("s.gap_ratio"), 2, locale))
    return picks.join(units, "corpus").select("corpus", text.alias("text"))


# -- palette -------------------------------------------------------------------------------

def adjacent_fills(drawn: DataFrame, fills: DataFrame) -> DataFrame:
    """Neighbouring fills of every drawn order (chart, counter_id, pos), per theme.

    Families are compared across, not within: two steps of one hue are one tokenizer.
    """
    order = Window.partitionBy("theme", "chart").orderBy("pos")
    pairs = (drawn.join(fills, "counter_id")
             .withColumn("next_id", F.lead("counter_id").over(order))
             .withColumn("next_fill", F.lead("fill").over(order))
             .withColumn("next_slot", F.lead("slot").over(order))
             .where(F.col("next_id").isNotNull() & (F.col("slot") != F.col("next_slot"))))
    normal = colour.delta_e(F.col("fill"), F.col("next_fill"))
    worst = colour.worst_delta_e(F.col("fill"), F.col("next_fill"))
    return (pairs.select("theme", "chart", "pos", "counter_id", "next_id",
                         round_even(normal, 4).alias("delta_e"), round_even(worst, 4).alias("delta_e_cvd"))
            .withColumn("distinct", (F.col("delta_e") >= dims.MIN_NORMAL_DE)
                        & (F.col("delta_e_cvd") >= dims.MIN_CVD_DE)))


def ramp_steps(drawn: DataFrame, fills: DataFrame, prices: DataFrame) -> DataFrame:
    """Lightness steps inside each family by rising price; dearer has to be darker by a margin."""
    rows = (drawn.select("counter_id").distinct().join(fills, "counter_id")
            .join(prices.where(F.col("input_usd_per_mtok").isNotNull())
                  .select("counter_id", "input_usd_per_mtok"), "counter_id")
            .withColumn("lightness", colour.lightness(F.col("fill"))))
    order = Window.partitionBy("theme", "slot").orderBy("input_usd_per_mtok", "counter_id")
    step = F.lag("lightness").over(order) - F.col("lightness")
    return (rows.withColumn("cheaper_id", F.lag("counter_id").over(order))
            .withColumn("step", round_even(step, 6)).where(F.col("cheaper_id").isNotNull())
            .select("theme", "cheaper_id", "counter_id", "step", (F.col("step") >= dims.MIN_RAMP_STEP).alias("ordered")))


def fill_contrast(drawn: DataFrame, fills: DataFrame) -> DataFrame:
    """Contrast of every drawn fill against the surface of its theme."""
    rows = drawn.select("counter_id").distinct().join(fills, "counter_id")
    return (rows.select("theme", "counter_id", "fill",
                        round_even(colour.contrast(F.col("fill"), F.col("surface")), 4).alias("contrast"))
            .withColumn("readable", F.col("contrast") >= dims.MIN_FILL_CONTRAST))


# -- figure names --------------------------------------------------------------------------

def figure_stem(figure: Column, corpus: Column, locale_suffix: Column, theme_suffix: Column) -> Column:
    """Figure name: prefix, corpus, locale suffix, theme suffix."""
    return F.concat(figure, corpus, locale_suffix, theme_suffix)


def stem_corpus(stem: Column) -> Column:
    """Corpus named by a figure stem, null for names no figure has. Longest prefix wins."""
    rest = F.lit(None).cast("string")
    for prefix in reversed(dims.FIGURE_PREFIXES):
        rest = F.when(F.startswith(stem, F.lit(prefix)), F.substring(stem, len(prefix) + 1, 1 << 20)).otherwise(rest)
    for suffixes in (dims.THEME_SUFFIXES, dims.LOCALE_SUFFIXES):
        endings = "|".join(s for s in suffixes.values() if s)
        rest = F.regexp_replace(rest, f"({endings})$", "")
    return rest


def stale_stems(stems: DataFrame, live: DataFrame) -> DataFrame:
    """Stems of figures whose corpus is no longer in the data."""
    named = stems.withColumn("corpus", stem_corpus(F.col("stem"))).where(F.coalesce("corpus", F.lit("")) != "")
    return named.join(live.select("corpus").distinct(), "corpus", "left_anti")
