"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glossmeter import dims
from glossmeter.functions import numbers as N, text as T
from glossmeter.operators import (bpe, carry, charts, coincidence, cost, fingerprint, gates, indexing, measure, merges,
                                  parity, premium, slices)
from glossmeter.plans import workload as W
from glossmeter.plans.workload import DIMS, Workload
from glossmeter.session import ship
from glossmeter.sources import lines, tables
from glossmeter.stage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Workload(ship(spark), sf_dir))
    return build


# -- corpora -------------------------------------------------------------------------------

@query
def corpus_lines(w: Workload) -> DataFrame:
    docs = w.documents.select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_idx", "text"))
    return docs.select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"),
                       T.char_count(F.col("text")).alias("n_chars"), "text")


@query
def blank_line_check(w: Workload) -> DataFrame:
    found = F.filter(F.transform(T.split_lines(F.col("text")), lambda l, i: F.when(T.is_blank(l), i)),
                     lambda i: i.isNotNull())
    rows = w.documents.select("doc_id", found.alias("_at")).where(F.size("_at") > 0)
    return rows.select("doc_id", F.size("_at").cast("bigint").alias("n_blank"),
                       F.array_join(F.col("_at").cast("array<string>"), ",").alias("blank_at"))


@query
def units(w: Workload) -> DataFrame:
    keys = tables.numbered(w.units.select("corpus", "lang", "unit_key", T.char_count(F.col("text")).alias("n_chars")))
    return keys.select("corpus", "lang", "sentence_idx", F.col("unit_key").alias("doc_id"), "n_chars")


@query
def corpus_concat_splits(w: Workload) -> DataFrame:
    rows = w.units.select("lang", F.when(F.col("corpus") == "core", 0).otherwise(1).alias("split"), "unit_key")
    return (indexing.concat_splits(rows, ["lang"], "split", "unit_key", "sentence_idx")
            .select("lang", "sentence_idx", F.col("unit_key").alias("doc_id")))


@query
def example_pick(w: Workload) -> DataFrame:
    picked = corpus_concat_splits(w).where(F.col("sentence_idx").isin(list(dims.EXAMPLE_LINES)))
    text = w.table("documents").select("doc_id", F.md5("text").alias("text_md5"))
    return picked.join(text, "doc_id").select("lang", "sentence_idx", "doc_id", "text_md5")


@query
def language_discovery(w: Workload) -> DataFrame:
    paths = w.table("documents").select(
        F.concat(F.lit("root/dev/"), F.col("source"), F.lit("_"), F.col("lang"), F.lit(".dev")).alias("path"))
    found = lines.file_languages(paths)
    return found.select("lang", F.row_number().over(Window.orderBy("lang")).cast("bigint").alias("pos"))


@query
def alignment_check(w: Workload) -> DataFrame:
    return measure.alignment(w.units)


@query
def corpus_size(w: Workload) -> DataFrame:
    return w.sizes


@query
def corpus_fingerprint(w: Workload) -> DataFrame:
    leaves = tables.numbered(w.units.select("corpus", "lang", "unit_key", F.sha2("text", 256).alias("digest")))
    return fingerprint.corpus_fingerprints(leaves, list(DIMS.languages))


@query
def flat_fingerprint(w: Workload) -> DataFrame:
    return fingerprint.flat_fingerprints(w.units, list(DIMS.languages))


@query
def fingerprint_gate(w: Workload) -> DataFrame:
    # the recorded version of one register had another ending
    earlier = F.when(F.col("corpus") == "core", F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    # one scan of the texts for both versions
    leaves = staged(tables.numbered(w.units.select("corpus", "lang", "unit_key", F.sha2("text", 256).alias("digest"),
                                                   F.sha2(earlier, 256).alias("earlier"))))
    now, before = (staged(fingerprint.corpus_fingerprints(leaves.withColumn("digest", F.col(c)), list(DIMS.languages)))
                   for c in ("digest", "earlier"))
    changed = carry.changed_corpora(before, now).select("corpus")
    return now.select("corpus").join(changed.withColumn("changed", F.lit(True)), "corpus", "left") \
        .select("corpus", F.coalesce("changed", F.lit(False)).alias("changed"))


# -- scalar text operators -----------------------------------------------------------------

# Composed letters of the tables and their decomposed forms (base letter, combining mark).
DECOMPOSED = {c: unicodedata.normalize("NFD", c) for c in "éèêçäöüñóíáÉ"}


@query
def nfc_normalize(w: Workload) -> DataFrame:
    raw = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), DECOMPOSED.items(), F.col("text"))
    rows = w.documents.select("doc_id", raw.alias("_raw")).withColumn("_nfc", T.nfc(F.col("_raw")))
    return rows.select("doc_id", T.char_count(F.col("_raw")).alias("n_raw"), T.char_count(F.col("_nfc")).alias("n_nfc"),
                       F.md5("_nfc").alias("nfc_md5"))


@query
def char_count(w: Workload) -> DataFrame:
    return w.documents.select("doc_id", T.char_count(T.nfc(F.col("text"))).alias("n_code_points"), "n_chars")


@query
def utf32_count(w: Workload) -> DataFrame:
    return w.table("conversations").select("conv_id", "turn", F.size(T.code_points(F.col("text"))).cast("bigint").alias("n_tokens"))


@query
def utf32_encode(w: Workload) -> DataFrame:
    ids = T.code_points(F.col("text"))
    return w.documents.select("doc_id", ids.alias("_ids")).select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_tokens"), F.array_max("_ids").alias("max_token"),
        F.md5(F.array_join(F.col("_ids").cast("array<string>"), ",")).alias("ids_md5"))


@query
def utf32_decode(w: Workload) -> DataFrame:
    decoded = T.from_code_points(T.code_points(F.col("text")))
    return w.documents.select("doc_id", F.md5(decoded).alias("text_md5"))


@query
def utf8_byte_count(w: Workload) -> DataFrame:
    return w.documents.select("doc_id", T.byte_count(F.col("text")).alias("n_tokens"))


@query
def word_count(w: Workload) -> DataFrame:
    return w.documents.select("doc_id", T.word_count(F.col("text")).alias("n_tokens"))


@query
def markup_count(w: Workload) -> DataFrame:
    """Markup is content: pages are counted as they are, tags included."""
    text = T.nfc(F.col("html"))
    return w.table("pages").select("page_id", T.char_count(text).alias("n_chars"), T.byte_count(text).alias("n_bytes"),
                                   T.word_count(text).alias("n_words"))


@query
def unknown_count(w: Workload) -> DataFrame:
    n, known = T.char_count(F.col("text")), T.ascii_count(F.col("text"))
    return w.documents.select("doc_id", n.alias("n_tokens"), T.unknown_count(n, n, known).alias("n_unknown"))


@query
def array_subsequence_removal(w: Workload) -> DataFrame:
    ids = T.remove_subsequence(T.code_points(F.col("text")), [ord("t"), ord("h")])
    return w.documents.select("doc_id", ids.alias("_ids")).select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_left"), F.md5(T.from_code_points(F.col("_ids"))).alias("left_md5"))


# -- measurement ---------------------------------------------------------------------------

@query
def joined_count(w: Workload) -> DataFrame:
    rows = w.totals.where(F.col("counter_id").isin("words", "utf32", "utf8"))
    return rows.groupBy("corpus", "lang").pivot("counter_id", ["words", "utf32", "utf8"]).agg(F.max("total_tokens"))


@query
def aggregate_counts(w: Workload) -> DataFrame:
    return w.agg


@query
def raw_counts(w: Workload) -> DataFrame:
    return w.raw


@query
def head_slice(w: Workload) -> DataFrame:
    api = [c.counter_id for c in W.COUNTERS if c.is_api]
    return w.raw.where(F.col("counter_id").isin(api)).select("corpus", "counter_id", "lang", "sentence_idx", "n_tokens")


@query
def envelope_strip(w: Workload) -> DataFrame:
    return w.raw.where(F.col("envelope_tokens") > 0).select(
        "corpus", "counter_id", "lang", "sentence_idx",
        (F.col("n_tokens") - F.col("envelope_tokens")).alias("n_tokens_content"))


@query
def envelope_floor(w: Workload) -> DataFrame:
    """Every source as an endpoint: a probe its texts never use costs two tokens."""
    used = [F.bool_or(F.contains("text", F.lit(p))).alias(f"_p{i}") for i, p in enumerate(dims.ENVELOPE_PROBES)]
    seen = w.documents.groupBy("source").agg(*used)
    cost_of = F.array(*[F.struct(F.lit(p).alias("probe"), (F.length("source") + F.when(F.col(f"_p{i}"), 1).otherwise(2))
                                 .cast("bigint").alias("n_tokens")) for i, p in enumerate(dims.ENVELOPE_PROBES)])
    probes = seen.select("source", F.explode(cost_of).alias("_e")).select("source", "_e.*")
    return measure.envelope_floors(probes, ["source"])


@query
def envelope_carry(w: Workload) -> DataFrame:
    return measure.carried_envelopes(w.raw)


@query
def scripted_api_count(w: Workload) -> DataFrame:
    """The remote-counter path with a scripted client in place of an endpoint."""
    from glossmeter.counters import remote_expr
    counted = remote_expr(lambda: (lambda s: len(s) + 8), concurrency=4)
    return w.table("conversations").select("conv_id", "turn", counted("text").alias("n_tokens"))


@query
def content_totals(w: Workload) -> DataFrame:
    return w.content.select("corpus", "counter_id", "lang", "total_tokens", "content_tokens")


# -- premium and cost ----------------------------------------------------------------------

@query
def premium_aggregate(w: Workload) -> DataFrame:
    return w.premium


@query
def per_sentence_ratio(w: Workload) -> DataFrame:
    ratios = premium.sentence_ratios(w.raw, DIMS.baseline)
    return ratios.select("corpus", "counter_id", "lang", "sentence_idx", N.round_even(F.col("ratio"), 6).alias("ratio"))


@query
def premium_distribution(w: Workload) -> DataFrame:
    return premium.distribution(w.ratios)


@query
def premium_table(w: Workload) -> DataFrame:
    counted = w.staged
    agg = measure.additive_totals(counted, W.COUNTERS, W.MEASURED_ON)
    ratios = premium.unit_ratios(counted, W.COUNTERS, DIMS.baseline)
    sizes = measure.corpus_sizes(counted, DIMS.baseline)
    return premium.premium_table(agg, ratios, sizes, w.languages, DIMS.baseline)


@query
def premium_pivot(w: Workload) -> DataFrame:
    return premium.premium_pivot(w.premium, DIMS.counter_ids())


@query
def headline_map(w: Workload) -> DataFrame:
    nested = premium.headline_map(w.premium, DIMS.baseline)
    entry = F.transform(F.map_entries("headline"), lambda c: F.concat(
        c["key"], F.lit(":"), F.array_join(F.transform(F.map_entries(c["value"]), lambda l: F.concat(
            l["key"], F.lit("="), N.fixed(l["value"], 4))), ",")))
    return nested.select("corpus", F.array_join(entry, ";").alias("headline"))


@query
def cost_table(w: Workload) -> DataFrame:
    return w.cost


@query
def priced_only(w: Workload) -> DataFrame:
    return cost.priced(w.cost)


@query
def oracle_delta(w: Workload) -> DataFrame:
    """Measured premiums against the lengths the table itself publishes, at two decimals."""
    docs = w.table("documents").where(F.length("source") <= 4)
    sums = docs.groupBy("lang").agg(F.sum("n_chars").alias("_n"), F.count(F.lit(1)).alias("_k"))
    total = F.col("_n") + F.col("_k") - 1
    base = sums.where(F.col("lang") == DIMS.baseline).select(total).scalar()
    published = sums.where(F.col("lang") != DIMS.baseline).select(
        "lang", N.round_even(N.ratio(total, base), 2).alias("published"))
    return premium.published_deltas(w.totals, published, "utf32", "core", DIMS.baseline)


@query
def coverage(w: Workload) -> DataFrame:
    deltas = oracle_delta(w)
    ids = w.totals.agg(F.array_join(F.sort_array(F.collect_set("counter_id")), ",").alias("counters"),
                    F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return ids.select("*", deltas.agg(F.max(F.abs("delta"))).scalar().alias("oracle_max_abs_delta"),
                      deltas.agg(F.bool_and("passes")).scalar().alias("oracle_passes"))


# -- coincidence ---------------------------------------------------------------------------

@query
def coincidence_pairs(w: Workload) -> DataFrame:
    return coincidence.identical_pairs(w.content_with_ragged)


@query
def coincidence_incomparable(w: Workload) -> DataFrame:
    return coincidence.incomparable_pairs(w.content_with_ragged)


@query
def shared_everywhere(w: Workload) -> DataFrame:
    return coincidence.shared_pairs(w.pairs, w.content).where("everywhere").select("counter_a", "counter_b")


@query
def shared_partial(w: Workload) -> DataFrame:
    return coincidence.shared_pairs(w.pairs, w.content).where("not everywhere").select("counter_a", "counter_b", "corpora")


@query
def identical_pair(w: Workload) -> DataFrame:
    return w.folds


# -- incremental runs ----------------------------------------------------------------------

def _prior(w: Workload) -> DataFrame:
    """Stored rows of an earlier pass: an older date, a retired counter, an older spec, no date for one."""
    old = w.totals.withColumn("measured_on", F.when(F.col("counter_id") != "utf8-api", F.lit("2026-07-27"))) \
        .withColumn("spec", F.when(F.col("counter_id") == "utf8", F.lit("utf8-v1")).otherwise(F.col("spec")))
    ghost = old.where(F.col("counter_id") == "words").withColumn("counter_id", F.lit("retired"))
    return old.unionByName(ghost)


def _pass_dims() -> dims.Dimensions:
    """The configuration of the later pass: one language fewer."""
    return dims.Dimensions(languages={k: v for k, v in W.LANGUAGES.items() if k != "es"}, baseline="en", lead="fr",
                           corpora=W.CORPORA, preferred_corpus="core", counters=W.MATRIX, prices=W.PRICES,
                           published={}, slots=W.SLOTS, tints=DIMS.tints)


SELECTED, RAN = ["core"], ["words", "utf32"]


def _merged(w: Workload) -> DataFrame:
    now = w.totals.where(F.col("corpus").isin(SELECTED) & F.col("counter_id").isin(RAN) & (F.col("lang") != "es"))
    return carry.merge(_prior(w), now, _pass_dims(), SELECTED, RAN)


@query
def carry_forward(w: Workload) -> DataFrame:
    return _merged(w)


@query
def purge_report(w: Workload) -> DataFrame:
    return carry.purged(_prior(w), _pass_dims())


@query
def provenance_gate(w: Workload) -> DataFrame:
    return carry.stale_specs(carry.carried(_prior(w), _pass_dims(), SELECTED, RAN), w.counters)


@query
def lost_distribution(w: Workload) -> DataFrame:
    raw = measure.raw_counts(w.staged, W.COUNTERS, W.MEASURED_ON).where(F.col("envelope_tokens") == 0)
    return carry.lost_distributions(measure.additive_totals(w.staged, W.COUNTERS, W.MEASURED_ON), raw)


@query
def measured_on_summary(w: Workload) -> DataFrame:
    return carry.measured_on_summary(_merged(w))


@query
def coverage_block(w: Workload) -> DataFrame:
    """What the merged totals rest on, and whether the check against published premiums passes."""
    deltas = oracle_delta(w).agg(F.max(F.abs("delta")).alias("oracle_max_abs_delta"), F.bool_and("passes").alias("oracle_passes"))
    block = carry.coverage(_merged(w), [*W.DIMS.counter_ids(), "utf32-partial"], W.MEASURED_ON)
    return block.select("*", F.lit(dims.PUBLISHED_TOLERANCE).alias("oracle_tolerance"),
                        deltas.select("oracle_max_abs_delta").scalar().alias("oracle_max_abs_delta"), deltas.select("oracle_passes").scalar().alias("oracle_passes"))


@query
def canonical_order(w: Workload) -> DataFrame:
    """Place of every aggregate row in the written table (few rows, fixed by the configuration)."""
    order = Window.orderBy("corpus", "counter_id", "lang")
    return w.totals.select("corpus", "counter_id", "lang", F.row_number().over(order).cast("bigint").alias("pos"))


# -- gates ---------------------------------------------------------------------------------

@query
def coverage_gap(w: Workload) -> DataFrame:
    return premium.missing_cells(w.totals_with_ragged, list(DIMS.languages))


@query
def registry_antijoin(w: Workload) -> DataFrame:
    declared = w.spark.createDataFrame([(s,) for s in ("en", "fr", "it")], "lang string")
    langs = gates.registry_differences(declared, w.table("documents"), "lang", "language")
    prices = gates.registry_differences(w.prices, w.content_with_ragged, "counter_id", "counter")
    return langs.unionByName(prices)


@query
def duplicate_ids(w: Workload) -> DataFrame:
    return gates.duplicates(w.table("conversations"), ["conv_id", "role"])


@query
def drawn_coverage(w: Workload) -> DataFrame:
    """Measured headline counters that the dollar order leaves out, when prices do not excuse it."""
    order = charts.priced_order(w.costs, w.counters, w.corpora, DIMS.lead)
    drawn = charts.series(w.costs, order, "cost_usd_per_1k_chars")
    return charts.undrawn(w.costs, drawn, w.counters)


# -- parity tables -------------------------------------------------------------------------

@query
def tokenization_lengths(w: Workload) -> DataFrame:
    return parity.wide(w.lengths, W.PARITY_NAMES)


@query
def language_map_join(w: Workload) -> DataFrame:
    """Names of the codes that have a labelled document; codes without a name drop out."""
    rows = parity.named(w.lengths.drop("language"), w.labelled_map)
    return rows.select("lang", "language", "tokenizer", "n_tokens", "n_unknown")


@query
def unknown_fraction(w: Workload) -> DataFrame:
    rows = parity.with_unknown_share(w.lengths)
    return rows.select("language", "tokenizer", N.round_even(F.col("unknown_fraction"), 8).alias("unknown_fraction"))


@query
def unknown_mask(w: Workload) -> DataFrame:
    rows = parity.masked(w.lengths)
    return rows.select("language", "tokenizer", F.coalesce(F.col("n_tokens").cast("string"), F.lit(dims.MASK)).alias("cell"))


@query
def masked_table_read(w: Workload) -> DataFrame:
    cells = parity.wide(parity.masked(w.lengths), W.PARITY_NAMES)
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(dims.MASK)) for c in W.PARITY_NAMES]
    return tables.parse_masked(cells.select(F.concat_ws(",", "language", *values).alias("value")), W.PARITY_NAMES)


@query
def normalize_by_target(w: Workload) -> DataFrame:
    return w.relative.select("language", "tokenizer", "target_language", N.round_even(F.col("relative"), 8).alias("relative"))


@query
def print_table_pages(w: Workload) -> DataFrame:
    return parity.print_pages(w.relative, columns_per_page=2)


@query
def top_k_premium(w: Workload) -> DataFrame:
    return parity.cheapest(w.relative, "UTF-32").withColumn("relative", N.round_even(F.col("relative"), 8))


# -- parallel slices -----------------------------------------------------------------------

LOCALES = 3


@query
def jsonl_partition_filter(w: Workload) -> DataFrame:
    return slices.clean_utterances(tables.parse_records(w.record_lines))


@query
def parallel_intersection(w: Workload) -> DataFrame:
    return slices.parallel_slice(w.utterances, LOCALES).select("locale", "order", "utt")


@query
def locale_drop_counts(w: Workload) -> DataFrame:
    return slices.dropped_per_locale(w.utterances, LOCALES)


# -- orders, charts and captions -----------------------------------------------------------

def _priced(w: Workload) -> DataFrame:
    return w.priced_order


def _headline(w: Workload) -> DataFrame:
    return w.headline_order


@query
def rank_across_corpora(w: Workload) -> DataFrame:
    # one counter is measured in the other corpus only
    frame = w.premium.where((F.col("counter_id") != "utf8") | (F.col("corpus") == "extended"))
    return charts.rank_keys(frame, "premium_aggregate", w.corpora, DIMS.lead)


@query
def headline_order(w: Workload) -> DataFrame:
    return _headline(w)


@query
def priced_order(w: Workload) -> DataFrame:
    return _priced(w)


@query
def chart_premium_heatmap(w: Workload) -> DataFrame:
    contrast = [l for l in DIMS.languages if l != DIMS.baseline]
    return charts.series(w.premium, _headline(w), "premium_aggregate", langs=contrast)


@query
def heatmap_scale(w: Workload) -> DataFrame:
    return charts.heat_scale(chart_premium_heatmap(w))


@query
def chart_cost_driver(w: Workload) -> DataFrame:
    return charts.series(w.costs, _headline(w), "tokens_per_1k_chars")


@query
def chart_usd_per_1m_chars(w: Workload) -> DataFrame:
    rows = charts.series(w.costs, _priced(w), "cost_usd_per_1k_chars", 1000.0)
    return rows.withColumn("value", N.round_even(F.col("value"), 6))


@query
def chart_usd_per_1k_units(w: Workload) -> DataFrame:
    rows = charts.series(w.costs, _priced(w), "cost_usd_per_sentence", 1000.0)
    return rows.withColumn("value", N.round_even(F.col("value"), 6))


@query
def group_extreme(w: Workload) -> DataFrame:
    return charts.group_extremes(chart_cost_driver(w))


def _ladder(w: Workload) -> DataFrame:
    return charts.cost_ladder(w.costs, _priced(w), DIMS.lead)


@query
def cost_ladder(w: Workload) -> DataFrame:
    return _ladder(w).withColumn("usd_per_1k_units", N.round_even(F.col("usd_per_1k_units"), 6))


@query
def cost_spread(w: Workload) -> DataFrame:
    rows = charts.cost_spread(_ladder(w))
    return rows.select("corpus", *[N.round_even(F.col(c), 6).alias(c) for c in ("cheapest", "dearest")], "spread")


def _gaps(w: Workload) -> DataFrame:
    return charts.tax_gap(w.costs, _priced(w), DIMS.baseline, DIMS.lead)


@query
def tax_gap(w: Workload) -> DataFrame:
    columns = ("baseline_usd", "lead_usd", "gap_usd", "gap_ratio")
    return _gaps(w).select("corpus", "counter_id", *[N.round_even(F.col(c), 6).alias(c) for c in columns], "pos")


@query
def widest_gaps(w: Workload) -> DataFrame:
    return charts.widest_gaps(_gaps(w))


@query
def label_fallback(w: Workload) -> DataFrame:
    return w.totals.select("counter_id").distinct().join(charts.labels(w.counters), "counter_id")


@query
def fold_legend(w: Workload) -> DataFrame:
    return charts.fold_legend(w.folds, w.counters, w.prices, _headline(w))


@query
def same_tokens_diff_price(w: Workload) -> DataFrame:
    return charts.same_tokens_different_price(w.folds, w.costs, w.counters, w.prices, _priced(w))


@query
def price_confidence_note(w: Workload) -> DataFrame:
    return charts.hedged_prices(w.costs, w.counters, w.prices, _priced(w))


@query
def unpriced_note(w: Workload) -> DataFrame:
    return charts.unpriced_headlines(w.costs, w.counters, w.prices)


@query
def price_as_of(w: Workload) -> DataFrame:
    en = charts.price_dates(w.costs, w.prices, "en")
    vi = charts.price_dates(w.costs, w.prices, "vi").withColumnRenamed("as_of", "as_of_vi")
    return en.join(vi, "corpus")


@query
def chart_captions(w: Workload) -> DataFrame:
    order, folds = staged(_priced(w)), staged(w.folds)
    both = [charts.cost_captions(w.costs, folds, w.counters, w.prices, order, locale).withColumn("locale", F.lit(locale))
            for locale in ("en", "vi")]
    return both[0].unionByName(both[1])


@query
def gap_caption(w: Workload) -> DataFrame:
    units = w.corpora.select("corpus", F.lit("document").alias("unit"))
    return charts.gap_caption(_gaps(w), w.counters, units, "en")


@query
def locale_number_format(w: Workload) -> DataFrame:
    vnd, usd = F.col("cost_vnd_per_1k_chars") * 1000.0, F.col("price_usd_per_mtok")
    rows = w.costs.where(F.col("cost_usd_per_1k_chars").isNotNull())
    return rows.select("corpus", "counter_id", "lang",
                       *[f.alias(f"{name}_{loc}") for loc in ("en", "vi") for name, f in (
                           ("number", N.locale_number(vnd, 2, loc)), ("money", N.locale_money(usd, loc)),
                           ("compact", N.locale_compact(F.col("tokens_per_1k_chars"), loc)))])


# -- palette -------------------------------------------------------------------------------

def _drawn(w: Workload) -> DataFrame:
    """Every drawn order: dollar bars, tokenizer bars and the ladder of each corpus."""
    bars = _priced(w).select(F.lit("dollar bars").alias("chart"), "counter_id", "pos")
    tokenizers = _headline(w).select(F.lit("tokenizer bars").alias("chart"), "counter_id", "pos")
    ladder = _ladder(w).select(F.concat(F.lit("ladder "), "corpus").alias("chart"), "counter_id", "pos")
    return staged(bars.unionByName(tokenizers).unionByName(ladder))


@query
def adjacent_pairs(w: Workload) -> DataFrame:
    return charts.adjacent_fills(_drawn(w), w.fills)


@query
def ramp_monotone(w: Workload) -> DataFrame:
    return charts.ramp_steps(_drawn(w), w.fills, w.prices)


@query
def wcag_contrast(w: Workload) -> DataFrame:
    return charts.fill_contrast(_drawn(w), w.fills)


@query
def figure_stem_prune(w: Workload) -> DataFrame:
    """Figure names of every source, against the sources that still have Spanish text."""
    sources = w.table("documents").select(F.col("source").alias("corpus")).distinct()
    parts = sources
    for name, values in (("figure", dims.FIGURE_PREFIXES), ("locale", dims.LOCALE_SUFFIXES.values()),
                         ("theme", dims.THEME_SUFFIXES.values())):
        parts = parts.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    stems = parts.select(charts.figure_stem(F.col("figure"), F.col("corpus"), F.col("locale"), F.col("theme")).alias("stem"))
    labelled = w.table("labels").where(F.col("toxic") == 1).select("doc_id")
    live = (w.table("documents").join(labelled, "doc_id", "left_semi")
            .where(F.col("lang") != "en").select(F.col("source").alias("corpus")))
    return charts.stale_stems(stems, live)


# -- byte-pair vocabularies ----------------------------------------------------------------

#: Tokens of the vocabulary that the byte-pair queries use, and the sizes that the sweep takes of it.
VOCABULARY_SIZE, SWEEP_STEPS = 4096, 20


def _vocabulary(w: Workload) -> DataFrame:
    return bpe.prefix_vocabulary(w.documents.select("text"), VOCABULARY_SIZE)


@query
def vocab_slice(w: Workload) -> DataFrame:
    return bpe.vocabulary_slice(_vocabulary(w), 256, VOCABULARY_SIZE).select("rank", "token_hex")


@query
def bpe_count(w: Workload) -> DataFrame:
    ranks = bpe.share(w.spark, bpe.collect_ranks(_vocabulary(w)))
    return w.documents.select("doc_id", bpe.count_column(ranks)(T.nfc(F.col("text"))).alias("n_tokens"))


@query
def bpe_byte_count(w: Workload) -> DataFrame:
    """A vocabulary of single bytes: as many tokens as UTF-8 bytes."""
    ranks = bpe.share(w.spark, bpe.collect_ranks(bpe.truncate(_vocabulary(w), 256)))
    return w.documents.select("doc_id", bpe.count_column(ranks)("text").alias("n_tokens"))


@query
def bpe_joined_count(w: Workload) -> DataFrame:
    ranks = bpe.share(w.spark, bpe.collect_ranks(_vocabulary(w)))
    return bpe.vocabulary_counter("bpe", "bpe", ranks).joined_totals(w.units)


@query
def vocab_sweep(w: Workload) -> DataFrame:
    """Tokens needed at twenty vocabulary sizes, from the single bytes to the whole vocabulary."""
    found = bpe.collect_ranks(_vocabulary(w))
    ranks = bpe.share(w.spark, found)
    sizes = [256 + (len(found) - 256) * i / (SWEEP_STEPS - 1) for i in range(SWEEP_STEPS)]
    return merges.tokens_by_size(bpe.piece_counts(w.documents, ["lang"]), ["lang"], ranks, sizes)


@query
def token_text_alignment(w: Workload) -> DataFrame:
    ranks = bpe.share(w.spark, bpe.collect_ranks(_vocabulary(w)))
    rows = w.documents.select("doc_id", bpe.align_column(ranks)("text").alias("_g"))
    return rows.select("doc_id", F.size("_g").cast("bigint").alias("n_groups"),
                       F.aggregate("_g", F.lit(0).cast("bigint"), lambda n, g: n + F.size(g["tokens"])).alias("n_tokens"),
                       F.md5(F.array_join(F.col("_g.text"), "")).alias("text_md5"))


@query
def latex_alignment(w: Workload) -> DataFrame:
    ranks = bpe.share(w.spark, bpe.collect_ranks(_vocabulary(w)))
    rows = w.table("benchmark").select("item_id", bpe.align_column(ranks)("text").alias("_g"))
    return rows.select("item_id", bpe.latex_rows(F.col("_g")).alias("latex"))
