"""Premium, coincidence, charts, palette and configuration."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from glossmeter import dims as D
from glossmeter.functions import colour
from glossmeter.operators import carry, charts, coincidence, cost, gates, premium

RAW = "corpus string, counter_id string, lang string, sentence_idx bigint, n_tokens bigint, n_tokens_content bigint"
CONTENT = "corpus string, counter_id string, lang string, content_tokens bigint"


def test_ratios_drop_what_the_baseline_cannot_divide(spark):
    rows = [("c", "a", "en", 0, 4, 2), ("c", "a", "xx", 0, 7, 5), ("c", "a", "en", 1, 4, None), ("c", "a", "xx", 1, 8, None),
            ("c", "a", "en", 2, 9, 0), ("c", "a", "xx", 2, 9, 3), ("c", "a", "en", 3, 9, 0), ("c", "a", "xx", 3, 9, 0),
            ("c", "a", "xx", 4, 1, 1), ("c", "a", "en", 5, 1, 1)]
    got = premium.sentence_ratios(spark.createDataFrame(rows, RAW), "en").where("lang = 'xx'").collect()
    assert {r.sentence_idx: r.ratio for r in got} == {0: 2.5, 1: 2.0}
    old = spark.createDataFrame([r[:5] for r in rows[:2]], RAW.rsplit(",", 1)[0])
    assert {r.lang: r.ratio for r in premium.sentence_ratios(old, "en").collect()} == {"en": 1.0, "xx": 1.75}


def test_premium_without_sentences_leaves_the_distribution_blank(spark):
    agg = spark.createDataFrame([("c", "a", "en", 10, 5), ("c", "a", "xx", 25, 5)],
                                "corpus string, counter_id string, lang string, total_tokens bigint, total_chars bigint")
    langs = spark.createDataFrame([("en", "English"), ("xx", "Xish")], "lang string, language string")
    none = spark.createDataFrame([], "corpus string, counter_id string, lang string, ratio double")
    sizes = spark.createDataFrame([], "corpus string, n_sentences bigint")
    row = premium.premium_table(agg, none, sizes, langs, "en").where("lang = 'xx'").first()
    assert row.premium_aggregate == 2.5 and row.distribution_n is None and row.distribution_basis is None and row.premium_median is None
    assert row.aggregate_basis == "full corpus (0 sentences, one count per language)"


def test_published_check_is_strict_and_refuses_to_shrink(spark):
    agg = spark.createDataFrame([("f", "k", "en", 1000), ("f", "k", "vi", 2454), ("f", "k", "de", 1586)],
                                "corpus string, counter_id string, lang string, total_tokens bigint")
    def check(published):
        df = spark.createDataFrame(list(published.items()), "lang string, published double")
        return premium.published_deltas(agg, df, "k", "f", "en")
    good = {r.lang: (r.ours, r.delta, r.passes) for r in check({"vi": 2.45, "de": 1.58}).collect()}
    assert good["vi"] == (2.454, 0.004, True) and not good["de"][2]
    with pytest.raises(gates.Refused, match="miss"):
        gates.require_published(check({"de": 1.58}))
    with pytest.raises(gates.Refused, match="without a measurement"):
        gates.require_published(check({"vi": 2.45, "zh": 1.91}))
    gates.require_published(check({"vi": 2.45}))


def test_cost_needs_a_price_and_marks_retired_languages(spark):
    agg = spark.createDataFrame([("c", "p", "en", 250, 1000), ("c", "u", "old", 250, 1000)],
                                "corpus string, counter_id string, lang string, total_tokens bigint, total_chars bigint")
    sizes = spark.createDataFrame([("c", 10)], "corpus string, n_sentences bigint")
    prices = spark.createDataFrame([("p", 2.0, "d", "high", "")], "counter_id string, input_usd_per_mtok double, as_of string, confidence string, source string")
    langs = spark.createDataFrame([("en", "English")], "lang string, language string")
    rows = {r.counter_id: r for r in cost.cost_table(agg, sizes, prices, langs, 25890.0).collect()}
    assert rows["p"].tokens_per_1k_chars == 250.0 and rows["p"].tokens_per_sentence == 25.0
    assert (rows["p"].cost_usd_per_1k_chars, rows["p"].cost_vnd_per_1k_chars) == (0.0005, 12.94)
    assert (rows["p"].cost_usd_per_sentence, rows["p"].cost_vnd_per_sentence) == (0.00005, 1.2945)
    assert rows["u"].language == "old (retired)" and rows["u"].price_confidence == "unknown" and rows["u"].cost_usd_per_sentence is None
    with pytest.raises(gates.Refused):
        gates.require_chars(agg.withColumn("total_chars", F.lit(0)))


def _content(spark, table):
    return spark.createDataFrame([(c, k, l, n) for (c, k), ls in table.items() for l, n in ls.items()], CONTENT)


def test_coincidence_rules(spark):
    full = {"en": 1, "de": 2}
    content = _content(spark, {("x", "a"): full, ("x", "b"): full, ("x", "part"): {"en": 1}, ("x", "other"): {"en": 9, "de": 2},
                               ("x", "lone"): {"fr": 3},
                               ("y", "a"): full, ("y", "b"): {"en": 1, "de": 3}, ("y", "other"): full, ("y", "part"): {"de": 7}})
    # "lone" makes fr a language of corpus x, so no counter covers x completely
    assert {(r.corpus, r.counter_a, r.counter_b) for r in coincidence.identical_pairs(content).collect()} == {("y", "a", "other")}
    open_pairs = {(r.corpus, r.counter_a, r.counter_b): r.identical_on for r in coincidence.incomparable_pairs(content).collect()}
    assert open_pairs == {("x", "a", "b"): "de,en", ("x", "a", "part"): "en", ("x", "b", "part"): "en"}

    two = content.where("counter_id in ('a', 'b', 'other')").unionByName(_content(spark, {("y", "c"): full, ("x", "c"): full}))
    pairs = coincidence.identical_pairs(two)
    shared = {(r.counter_a, r.counter_b): (r.corpora, r.everywhere) for r in coincidence.shared_pairs(pairs, two).collect()}
    assert shared == {("a", "b"): ("x", False), ("a", "c"): ("x,y", True), ("a", "other"): ("y", False),
                      ("b", "c"): ("x", False), ("c", "other"): ("y", False)}


def test_carry_axes_and_vintages(spark):
    dims = D.Dimensions(languages={"en": "English"}, baseline="en", lead="en", corpora={"c": "C", "d": "D"}, published={},
                        counters=(D.Counter("k", "K", "", "native", "live", "k"), D.Counter("m", "M", "", "native", "live", "m")),
                        prices=(D.Price("k", None, "", "unknown"), D.Price("m", None, "", "unknown")), slots={}, tints={"light": {}, "dark": {}})
    prior = spark.createDataFrame([("c", "k", "en", "k", "d1"), ("c", "m", "en", None, None), ("d", "k", "en", "k0", "d0"),
                                   ("c", "gone", "en", "g", "d0"), ("e", "k", "en", "k", "d0"), ("c", "m", "xx", "m", "d0")],
                                  "corpus string, counter_id string, lang string, spec string, measured_on string")
    kept = carry.carried(prior, dims, ["c"], ["k"])
    assert {(r.corpus, r.counter_id) for r in kept.collect()} == {("c", "m"), ("d", "k")}
    assert {(r.axis, r.value) for r in carry.purged(prior, dims).collect()} == {("counter", "gone"), ("corpus", "e"), ("language", "xx")}
    assert [(r.counter_id, r.recorded_spec) for r in carry.stale_specs(kept, dims.counters_df(spark)).collect()] == [("k", "k0")]
    assert [r.counter_id for r in carry.unrecorded_specs(kept).collect()] == ["m"]
    new = spark.createDataFrame([("c", "k", "en", "k", "d2")], prior.schema)
    merged = carry.merge(prior, new, dims, ["c"], ["k"])
    assert {r.counter_id: r.measured_on for r in carry.measured_on_summary(merged).collect()} == {"k": "mixed: d0, d2", "m": "unrecorded"}
    assert carry.merge(None, new, dims, [], []) is new and carry.merge(None, None, dims, [], []) is None
    assert carry.changed_corpora(spark.createDataFrame([("c", "1"), ("d", None)], "corpus string, fingerprint string"),
                                 spark.createDataFrame([("c", "2"), ("d", "3"), ("e", "4")], "corpus string, fingerprint string")).collect()[0].corpus == "c"


CALIBRATION = [      # fixed values: colour pairs with normal and worst simulated distance
    ("#e34948", "#eda100", 20.8, 15.3), ("#4a3aa7", "#fe7a73", 39.3, 29.2), ("#008300", "#eda100", 30.3, 16.2),
    ("#6c62d2", "#36a231", 33.3, 27.8), ("#008300", "#6c62d2", 32.9, 26.5), ("#eda100", "#4a3aa7", 45.9, 41.0),
    ("#59c253", "#36a231", 10.0, 10.0), ("#36a231", "#008300", 9.9, 9.9), ("#fe7a73", "#e34948", 11.3, 10.7),
    ("#e34948", "#b51221", 12.9, 12.9), ("#6c62d2", "#4a3aa7", 13.0, 11.9)]


def test_colour_distances_are_calibrated(spark):
    df = spark.createDataFrame(CALIBRATION, "a string, b string, normal double, worst double")
    for r in df.select("*", colour.delta_e(F.col("a"), F.col("b")).alias("n"), colour.worst_delta_e(F.col("a"), F.col("b")).alias("w")).collect():
        assert abs(r.n - r.normal) <= 0.05 and abs(r.w - r.worst) <= 0.05, r
    row = spark.sql("select '#000000' a, '#ffffff' b").select(colour.contrast(F.col("a"), F.col("b"))).first()
    assert abs(row[0] - 21.0) < 1e-9


def test_palette_of_the_matrix_is_readable_and_ordinal(spark):
    dims = D.Dimensions()
    drawn = dims.counters_df(spark).select("counter_id")
    fills = dims.fills_df(spark)
    assert all(r.readable for r in charts.fill_contrast(drawn, fills).collect())
    steps = charts.ramp_steps(drawn, fills, dims.prices_df(spark)).collect()
    assert steps and all(r.ordered for r in steps)
    order = ["qwen", "gpt", "gemini", "cl100k_base", "claude", "gemini-3-8-flash"]
    chart = spark.createDataFrame([("bars", c, i) for i, c in enumerate(order)], "chart string, counter_id string, pos bigint")
    pairs = charts.adjacent_fills(chart, fills).collect()
    assert len(pairs) == 2 * (len(order) - 1) and all(r.delta_e > 0 for r in pairs)


def test_figure_names_round_trip(spark):
    dims, rows = D.Dimensions(), []
    for figure in D.FIGURE_PREFIXES:
        for corpus in dims.corpora:
            for locale in D.LOCALE_SUFFIXES.values():
                for theme in D.THEME_SUFFIXES.values():
                    rows.append((figure, corpus, locale, theme))
    df = spark.createDataFrame(rows, "f string, corpus string, l string, t string")
    stems = df.select(charts.figure_stem(F.col("f"), F.col("corpus"), F.col("l"), F.col("t")).alias("stem"), "corpus")
    assert stems.where(charts.stem_corpus(F.col("stem")) != F.col("corpus")).count() == 0
    assert stems.where("stem = 'fig-premium-heatmap-flores-vi-dark'").count() == 1
    live = spark.createDataFrame([("flores",)], "corpus string")
    stale = charts.stale_stems(stems.select("stem").unionByName(spark.createDataFrame([("notes-massive",)], "stem string")), live)
    assert {r.corpus for r in stale.collect()} == {"massive"} and stale.count() == len(rows) // 2


def test_orders_ranks_and_scales(spark):
    dims = D.Dimensions()
    counters, corpora = dims.counters_df(spark), dims.corpora_df(spark)
    rows = [("flores", "gpt", "vie_Latn", 1.5), ("massive", "gpt", "vie_Latn", 0.5), ("massive", "qwen", "vie_Latn", 1.2),
            ("flores", "claude", "eng_Latn", 1.0), ("flores", "gpt-6-luna", "vie_Latn", 0.1)]
    table = spark.createDataFrame(rows, "corpus string, counter_id string, lang string, premium_aggregate double")
    order = charts.headline_order(table, counters, corpora, "vie_Latn").orderBy("pos").collect()
    assert [(r.counter_id, r.rank_key) for r in order] == [("qwen", 1.2), ("gpt", 1.5), ("claude", None)]
    cells = [("c", "k", "a", 2.0), ("c", "k", "b", 0.5), ("c", "k", "d", 1.0), ("up", "k", "a", 1.0), ("up", "k", "b", 3.0), ("down", "k", "a", 0.5)]
    scale = {(r.corpus, r.lang): (r.scale, r.place) for r in charts.heat_scale(
        spark.createDataFrame(cells, "corpus string, counter_id string, lang string, value double")).collect()}
    assert scale == {("c", "a"): ("diverging", 1.0), ("c", "b"): ("diverging", 0.0), ("c", "d"): ("diverging", 0.5),
                     ("up", "a"): ("dearer", 0.0), ("up", "b"): ("dearer", 1.0), ("down", "a"): ("cheaper", 0.0)}


def test_captions_are_checked_against_the_counts(spark):
    dims = D.Dimensions()
    counters, prices, corpora = dims.counters_df(spark), dims.prices_df(spark), dims.corpora_df(spark)
    same, off = {"eng_Latn": 5, "vie_Latn": 9}, {"eng_Latn": 5, "vie_Latn": 8}
    content = _content(spark, {("flores", "gpt"): same, ("flores", "gpt-6-astra"): same, ("flores", "gpt-6-luna"): off,
                               ("flores", "o200k_base"): same, ("flores", "qwen"): same})
    folds = coincidence.fold_identity(content, counters)
    order = spark.createDataFrame([("gpt", 1), ("gpt-6-astra", 2), ("gpt-6-luna", 3)], "counter_id string, pos bigint")
    assert [r.legend for r in charts.fold_legend(folds, counters, prices, order).collect()] == ["GPT-6.1 Sol = GPT-6 Astra"]
    costs = content.select("corpus", "counter_id").distinct()
    assert charts.same_tokens_different_price(folds, costs, counters, prices, order).first().parts == "GPT-6.1 Sol $2 / GPT-6 Astra $10"
    assert charts.unpriced_headlines(costs, counters, prices).first().names == "Qwen 3.8"
    assert charts.price_dates(costs, prices, "vi").first().as_of == "19/10/2026"
    assert charts.hedged_prices(costs, counters, prices, order).count() == 0
    hedged = prices.withColumn("confidence", F.when(F.col("counter_id") == "gpt", "medium").otherwise(F.col("confidence")))
    assert charts.hedged_prices(costs, counters, hedged, order).first().named == "GPT-6.1 Sol (medium)"


def test_gap_drops_missing_and_zero_pairs(spark):
    rows = [("c", "a", "en", 0.001), ("c", "a", "vi", 0.003), ("c", "b", "en", 0.0), ("c", "b", "vi", 0.1), ("c", "d", "vi", 0.2),
            ("c", "e", "en", 0.01), ("c", "e", "vi", 0.02)]
    costs = spark.createDataFrame(rows, "corpus string, counter_id string, lang string, cost_usd_per_sentence double")
    order = spark.createDataFrame([(k, i) for i, k in enumerate("abde")], "counter_id string, pos bigint")
    gaps = charts.tax_gap(costs, order, "en", "vi")
    assert [r.counter_id for r in gaps.orderBy("pos").collect()] == ["a", "e"]
    assert tuple(charts.widest_gaps(gaps).first()) == ("c", "e", "a")


def test_configuration_is_refused_when_registries_disagree():
    base = D.Dimensions()
    assert [c.counter_id for c in base.counters][:2] == ["cl100k_base", "gpt"] and len(base.counters) == 14
    for change, words in (
            ({"counters": base.counters + (base.counters[1],)}, "more than once"),
            ({"prices": base.prices + (D.Price("ghost", 1.0, "", "high"),)}, "prices without a counter"),
            ({"prices": base.prices[1:]}, "without a price row"),
            ({"counters": base.counters[:2] + (dataclasses.replace(base.counters[2], flagship_group="nope"),) + base.counters[3:]}, "does not exist"),
            ({"counters": base.counters[:2] + (dataclasses.replace(base.counters[2], fold_reason="old"),) + base.counters[3:]}, "fold reasons"),
            ({"published": {"xxx": 1.0}}, "published values"),
            ({"slots": {"gpt": 9}}, "outside the palette")):
        with pytest.raises(ValueError, match=words):
            dataclasses.replace(base, **change)


def test_gates_name_offenders(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", float("inf"))], "k string, v double")
    with pytest.raises(gates.Refused, match="'b'"):
        gates.require_finite(df, "v", ["k"])
    gates.require_finite(df.where("k = 'a'"), "v", ["k"])
    assert {r.k for r in gates.duplicates(df.unionByName(df.where("k = 'a'")), ["k"]).collect()} == {"a"}


def test_coverage_in_one_pass(spark):
    from glossmeter.operators import carry
    rows = [("c", "a", "x", "d2"), ("c", "a", "y", "d2"), ("d", "a", "x", "d1"), ("d", "a", "y", "d1"), ("c", "b", "x", None), ("d", "b", "x", "d1")]
    got = carry.coverage(spark.createDataFrame(rows, "corpus string, counter_id string, lang string, measured_on string"), ["a", "b", "z"], "d2").first().asDict()
    assert got == {"counters_in_dataset": "a,b", "counters_measured_last_pass": "a", "counters_carried_forward": "b", "counters_without_rows": "z",
                   "measured_on_by_counter": "a=d1|d2,b=d1|unrecorded", "corpora": "c,d", "langs": "x,y", "counters_with_gaps": "b", "n_rows": 6}
    assert carry.coverage(spark.createDataFrame([], "corpus string, counter_id string, lang string"), ["a"], "d").first()["n_rows"] == 0
