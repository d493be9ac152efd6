"""The three stages of an evaluation: measure, derive, present.

Each stage reads and writes tables; gates run before a write, except the one that reports
counters which could have been measured and were not: it fails after the write, because the
rows of the others are good.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter import dims as D
from glossmeter.counters import TextCounter, build
from glossmeter.functions import text as T
from glossmeter.operators import carry, charts, coincidence, cost, fingerprint, gates, measure, parity, premium
from glossmeter.session import ship
from glossmeter.sources import tables
from glossmeter.sources.snapshots import Snapshots
from glossmeter.stage import staged
from glossmeter.tokenizers import CodecTokenizer, codec_lengths

# A counter, or a function that makes one by talking to an endpoint first, or None and a reason.
Builder = Callable[[D.Counter], tuple[TextCounter | Callable[[], TextCounter] | None, str]]


@dataclass
class Results:
    """Where the result tables of an evaluation live."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        ship(self.spark)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def stored(self, name: str, schema: str) -> DataFrame | None:
        return tables.read_csv_optional(self.spark, self.path(f"{name}.csv"), schema)

    @property
    def raw(self) -> DataFrame | None:
        return self.stored("raw_counts", tables.RAW_SCHEMA)

    @property
    def agg(self) -> DataFrame | None:
        return self.stored("aggregate_counts", tables.AGG_SCHEMA)

    @property
    def manifest(self) -> dict:
        return tables.read_json(self.spark, self.path("run_manifest.json"))

    def write(self, rows: DataFrame, name: str) -> None:
        tables.write_result(rows, self.path(f"{name}.csv"))

    def recorded(self, dims: D.Dimensions) -> list[DataFrame]:
        """Tables that name the spec of stored rows."""
        return [t for t in (self.raw, self.agg) if t is not None]

    def settle(self, got: Measured, dims: D.Dimensions, selected: Sequence[str]) -> Settled:
        """Put what was measured and what stays together."""
        prior_raw = self.raw
        agg = carry.merge(self.agg, got.agg, dims, selected, got.ran)
        raw = carry.merge(prior_raw, got.raw, dims, selected, got.ran)
        if agg is None or agg.isEmpty():
            raise gates.Refused("nothing was measured and nothing is stored; an empty dataset is not written")
        # the stored tables are inputs of the merge and its target, so it is written elsewhere first
        agg = staged(agg)
        raw = staged(raw) if raw is not None else None
        lost = carry.lost_distributions(agg, raw) if raw is not None else agg.select("counter_id").distinct()
        frames = {}
        if raw is not None and "envelope_tokens" in raw.columns:
            frames = {r["counter_id"]: r["envelope_tokens"] for r in measure.carried_envelopes(raw).collect()}
        return Settled(agg, raw, sorted(r["counter_id"] for r in lost.collect()), prior_raw is not None, frames)

    def publish(self, settled: Settled, got: Measured, dims: D.Dimensions, selected: Sequence[str], manifest: dict) -> None:
        self.write(settled.agg, "aggregate_counts")
        if settled.raw is not None:
            self.write(settled.raw, "raw_counts")
        tables.write_json(self.spark, manifest, self.path("run_manifest.json"))


class SnapshotResults(Results):
    """Result tables as snapshots: a pass writes its own partitions, and all of it becomes visible at once.

    The version is pinned when it is first looked at; ``refresh`` goes on to the latest.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.versions = Snapshots(spark, root)
        self.refresh()

    def refresh(self) -> None:
        self.snapshot = self.versions.open()

    @property
    def raw(self) -> DataFrame | None:
        return self.snapshot.table("raw_counts")

    @property
    def agg(self) -> DataFrame | None:
        return self.snapshot.table("aggregate_counts")

    @property
    def manifest(self) -> dict:
        return self.snapshot.manifest

    def recorded(self, dims: D.Dimensions) -> list[DataFrame]:
        """From the version's document, which keeps the specs of every partition; no fact is read."""
        parts = [p for t in ("raw_counts", "aggregate_counts") for p in self.snapshot.parts(t)]
        rows = [(p["corpus"], p["counter_id"], dims.baseline, spec) for p in parts for spec in p["specs"]]
        return [self.spark.createDataFrame(rows, "corpus string, counter_id string, lang string, spec string")]

    def _stays(self, got: Measured, dims: D.Dimensions, selected: Sequence[str]) -> Callable[[dict], bool]:
        known, again = carry.known_values(dims), {(c, n) for c in selected for n in got.ran}
        return lambda p: p["corpus"] in known["corpus"] and p["counter_id"] in known["counter_id"] and (p["corpus"], p["counter_id"]) not in again

    def settle(self, got: Measured, dims: D.Dimensions, selected: Sequence[str]) -> Settled:
        agg = carry.merge(self.agg, got.agg, dims, selected, got.ran)
        if agg is None or agg.isEmpty():
            raise gates.Refused("nothing was measured and nothing is stored; an empty dataset is not written")
        agg, stays = staged(agg), self._stays(got, dims, selected)      # a row per corpus, counter and language
        kept = [p for p in self.snapshot.parts("raw_counts") if stays(p)]
        frames = {p["counter_id"]: p["envelope"] for p in kept if p["envelope"] is not None}
        counters = {p["counter_id"] for p in kept} | (set(got.ran) if got.raw is not None else set())
        lost = sorted({r["counter_id"] for r in agg.select("counter_id").distinct().collect()} - counters)
        return Settled(agg, got.raw, lost, bool(self.snapshot.parts("raw_counts")), frames)

    def publish(self, settled: Settled, got: Measured, dims: D.Dimensions, selected: Sequence[str], manifest: dict) -> None:
        self.snapshot = self.versions.publish(self.snapshot, {"aggregate_counts": got.agg, "raw_counts": got.raw}, self._stays(got, dims, selected),
                                              manifest, list(dims.languages))


@dataclass
class Settled:
    """A pass and what stays of the passes before it: totals, facts, counters without facts, frames by facts."""

    agg: DataFrame
    raw: DataFrame | None
    lost: list[str]
    had_raw: bool
    frames: dict[str, int]


@dataclass
class Measured:
    """What the counters of a pass produced."""

    raw: DataFrame | None = None
    agg: DataFrame | None = None
    built: list[str] = field(default_factory=list)
    ran: list[str] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)
    frames: dict[str, int] = field(default_factory=dict)
    probes: dict[str, dict[str, int]] = field(default_factory=dict)


def _append(rows: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if rows is None else rows.unionByName(more, allowMissingColumns=True)


def _run(units: DataFrame, counters: Sequence[TextCounter], measured_on: str,
         sample: int) -> tuple[DataFrame, DataFrame]:
    """Raw and aggregate rows of counters measured together, as written tables."""
    keys = ["corpus", "lang", "sentence_idx"]
    if all(c.joiner is not None for c in counters):
        counted = staged(measure.count_units(units, counters, keys))
        return (measure.raw_counts(counted, counters, measured_on, sample),
                measure.additive_totals(counted, counters, measured_on))
    (counter,) = counters
    head = units.where(F.col("sentence_idx") < sample) if counter.is_api else units
    raw = measure.raw_counts(measure.count_units(head, counters, keys), counters, measured_on, sample)
    return staged(raw), staged(measure.joined_totals(units, counter, measured_on))


def measure_counters(units: DataFrame, matrix: Sequence[D.Counter], builder: Builder, measured_on: str,
                     sample: int = D.API_SAMPLE) -> Measured:
    """Run every counter that can be built over numbered units.

    Additive counters share one pass over the text. Any other counter, and each one of a
    shared pass that failed, is measured into written tables of its own, so a counter that
    breaks midway leaves nothing behind and takes no other with it. Only the kind of a failure
    is recorded: messages of remote clients may carry addresses and keys.
    """
    out = Measured()
    ready: list[tuple[D.Counter, TextCounter]] = []

    def skip(counter: D.Counter, reason: str) -> None:
        out.skipped.append({"counter": counter.counter_id, "status": counter.status, "reason": reason})

    def keep(pairs, raw: DataFrame, agg: DataFrame) -> None:
        out.raw, out.agg = _append(out.raw, raw), _append(out.agg, agg)
        for counter, made in pairs:
            out.ran.append(counter.counter_id)
            out.frames[counter.counter_id] = made.frame
            if made.probes:
                out.probes[counter.counter_id] = dict(made.probes)

    for counter in matrix:
        try:
            made, reason = builder(counter)
        except Exception as error:
            made, reason = None, f"failed to construct: {type(error).__name__}"
        if made is None:
            skip(counter, reason)
            continue
        out.built.append(counter.counter_id)
        try:
            ready.append((counter, made() if callable(made) else made))
        except Exception as error:
            skip(counter, f"errored at run: {type(error).__name__}")
    additive = [(c, m) for c, m in ready if m.joiner is not None]
    alone = [(c, m) for c, m in ready if m.joiner is None]
    if len(additive) > 1:
        try:
            keep(additive, *_run(units, [m for _, m in additive], measured_on, sample))
            additive = []
        except Exception:
            pass        # one of them is at fault; find it below
    for counter, made in additive + alone:
        try:
            keep([(counter, made)], *_run(units, [made], measured_on, sample))
        except Exception as error:
            skip(counter, f"errored at run: {type(error).__name__}")
    out.ran.sort(key=[c.counter_id for c in matrix].index)
    return out


def unit_index(units: DataFrame) -> DataFrame:
    """(corpus, lang, sentence_idx, digest, blank) as a written table.

    One pass over the text; sizes, alignment, blank lines and fingerprints are read from it.
    """
    text = F.col("text")
    return staged(units.select("corpus", "lang", "sentence_idx", F.sha2(text, 256).alias("digest"),
                               T.is_blank(text).alias("blank")))


def _fingerprints(index: DataFrame, languages: Sequence[str]) -> dict[str, dict]:
    found = fingerprint.corpus_fingerprints(index, languages).collect()
    return {r["corpus"]: {"n_sentences": r["n_sentences"], "fingerprint": r["fingerprint"]} for r in found}


def measure_pass(results: Results, units: DataFrame, dims: D.Dimensions, builder: Builder = build,
                 corpora: str | Sequence[str] | None = None, counters: str | Sequence[str] | None = None,
                 measured_on: str | None = None, sample: int = D.API_SAMPLE) -> dict:
    """Measure the selected corpora and counters and merge them with what is stored.

    ``units`` holds every configured corpus (corpus, lang, sentence_idx, text). Returns the
    manifest.
    """
    spark = results.spark
    selected = D.select(corpora, dims.corpora, "corpora")
    chosen = D.select(counters, dims.counter_ids(), "counters")
    measured_on = measured_on or datetime.date.today().isoformat()
    languages = list(dims.languages)

    units = units.where(F.col("lang").isin(languages) & F.col("corpus").isin(list(dims.corpora)))
    mine = units.where(F.col("corpus").isin(selected))
    index = unit_index(units)
    chosen_index = index.where(F.col("corpus").isin(selected))
    gates.require_sentences(measure.corpus_sizes(index, dims.baseline), selected)
    gates.require_aligned(measure.alignment(chosen_index))
    gates.require_empty(chosen_index.where("blank").select("corpus", "lang", "sentence_idx"),
                        "blank lines would shift the alignment")
    prints = _fingerprints(index, languages)

    prior_raw, prior_agg, prior = results.raw, results.agg, results.manifest
    whole = set(selected) == set(dims.corpora) and set(chosen) == set(dims.counter_ids())
    if not whole and (prior_raw is None or prior_agg is None):
        raise gates.Refused("a subset is selected but no stored dataset holds the rest; measure everything first")

    got = measure_counters(mine, [c for c in dims.counters if c.counter_id in chosen], builder, measured_on, sample)

    notes: list[str] = []
    base_rows = prior_agg if prior_agg is not None else prior_raw
    kept_counters: list[str] = []
    kept_corpora: list[str] = []
    if base_rows is not None:
        notes += [f"purged {r['axis']} {r['value']}" for r in carry.purged(base_rows, dims).collect()]
        recorded = prior.get("corpora_fingerprint", {})
        for corpus in sorted(set(dims.corpora) - set(selected)):
            was, now = recorded.get(corpus, {}).get("fingerprint"), prints.get(corpus, {}).get("fingerprint")
            if was and now and was != now:
                raise gates.Refused(f"corpus {corpus!r} changed since its stored rows were measured; measure it again")
        kept = carry.carried(base_rows, dims, selected, got.ran)
        kept_counters = sorted({r[0] for r in kept.select("counter_id").distinct().collect()} - set(got.ran))
        kept_corpora = sorted({r[0] for r in kept.select("corpus").distinct().collect()} - set(selected))
        matrix = dims.counters_df(spark)
        for stored in results.recorded(dims):
            gates.require_empty(carry.stale_specs(carry.carried(stored, dims, selected, got.ran), matrix),
                                "stored rows were measured on another spec than the matrix names")
        notes += [f"provenance unrecorded for {r['counter_id']}"
                  for r in carry.unrecorded_specs(kept.where(F.col("counter_id").isin(kept_counters))).collect()]

    settled = results.settle(got, dims, selected)
    agg, lost = settled.agg, settled.lost
    if lost and settled.had_raw:
        raise gates.Refused(f"counters {lost} have totals but no per-sentence rows")
    if lost:
        notes.append(f"no per-sentence rows for {', '.join(lost)}: their distribution will be blank")

    frames = {**settled.frames, **got.frames}
    probes = {**{c: p for c, p in prior.get("envelope_probe_frames_by_counter", {}).items() if c in kept_counters},
              **got.probes}
    exhausted = sorted(set(got.built) - set(got.ran))
    manifest = {
        "corpora": dict(dims.corpora),
        "corpora_measured_this_pass": {c: prints[c]["n_sentences"] for c in selected},
        "corpora_carried_forward": kept_corpora,
        "corpora_fingerprint": {c: prints[c] for c in sorted(prints)},
        "languages": dict(dims.languages),
        "baseline_language": dims.baseline,
        "counters_ran": got.ran,
        "counters_carried_forward": kept_counters,
        "counters_skipped": got.skipped,
        "measured_on_by_counter": {r["counter_id"]: r["measured_on"] for r in
                                   carry.measured_on_summary(agg).orderBy("counter_id").collect()},
        "counters_without_per_sentence_rows": lost,
        "envelope_tokens_by_counter": dict(sorted(frames.items())),
        "envelope_probe_frames_by_counter": dict(sorted(probes.items())),
        "api_per_sentence_subsample": sample,
        "versions": tables.library_versions(),
        "notes": notes,
    }
    results.publish(settled, got, dims, selected, manifest)
    if exhausted:
        raise gates.Refused(f"counters {exhausted} were available but produced nothing; their stored rows are stale")
    return manifest


def frames_df(spark: SparkSession, manifest: Mapping) -> DataFrame:
    return spark.createDataFrame(sorted(manifest.get("envelope_tokens_by_counter", {}).items()),
                                 "counter_id string, envelope_tokens bigint")


def analyze(results: Results, units: DataFrame, dims: D.Dimensions) -> dict:
    """Derive premium and cost tables and the summary from the stored counts."""
    spark, manifest = results.spark, results.manifest
    languages = list(dims.languages)
    recorded = manifest.get("corpora_fingerprint", {})
    index = unit_index(units.where(F.col("lang").isin(languages)))
    if recorded:
        now = _fingerprints(index, languages)
        changed = sorted(c for c, was in recorded.items()
                         if c in dims.corpora and was.get("fingerprint") != now.get(c, {}).get("fingerprint"))
        if changed:
            raise gates.Refused(f"corpora {changed} changed since the counts were measured; measure them again")
    agg, raw = results.agg, results.raw
    if agg is None:
        raise gates.Refused("no aggregate counts are stored")
    raw = raw if raw is not None else spark.createDataFrame([], tables.RAW_SCHEMA)
    names, prices = dims.languages_df(spark), dims.prices_df(spark)
    sizes = measure.corpus_sizes(index, dims.baseline)
    gates.require_empty(premium.missing_cells(agg, languages), "counters without rows for configured languages")
    gates.require_sentences(sizes, [r["corpus"] for r in agg.select("corpus").distinct().collect()])
    gates.require_chars(agg)

    table = staged(premium.premium_table(agg, premium.sentence_ratios(raw, dims.baseline), sizes, names, dims.baseline))
    results.write(table, "premium_by_language")
    costs = staged(cost.cost_table(agg, sizes, prices, names))
    results.write(costs, "cost_by_language")

    checked = []
    if dims.published:
        deltas = premium.published_deltas(agg, dims.published_df(spark), dims.published_counter,
                                          dims.preferred_corpus, dims.baseline)
        gates.require_empty(deltas.where(F.col("delta").isNull()), "published premiums without a measurement")
        checked = deltas.collect()
    worst = max((abs(r["delta"]) for r in checked), default=None)
    content = measure.content_totals(agg, frames_df(spark, manifest))
    pairs = staged(coincidence.identical_pairs(content))
    shared = coincidence.shared_pairs(pairs, content).orderBy("counter_a", "counter_b").collect()
    headline = premium.headline_map(table, dims.baseline).collect()
    summary = {
        "premium_vs": dims.languages[dims.baseline],
        "corpora": dict(dims.corpora),
        "headline_premiums_aggregate_by_corpus": {r["corpus"]: r["headline"] for r in headline},
        "published_check": {dims.languages[r["lang"]]: {"published": r["published"], "ours": r["ours"],
                                                        "delta": r["delta"]} for r in checked},
        "tokenizer_coincidence_check": {
            "corpora_checked": sorted(r["corpus"] for r in agg.select("corpus").distinct().collect()),
            "shared_in_all_corpora": [[r["counter_a"], r["counter_b"]] for r in shared if r["everywhere"]],
            "coincident_in_some_corpora": [{"pair": [r["counter_a"], r["counter_b"]], "corpora": r["corpora"].split(",")}
                                           for r in shared if not r["everywhere"]],
            "incomparable_coverage": [r.asDict() for r in coincidence.incomparable_pairs(content).collect()],
            "raw_equality_by_corpus": {r["corpus"]: sorted(r["p"]) for r in pairs.groupBy("corpus").agg(
                F.collect_list(F.array("counter_a", "counter_b")).alias("p")).collect()},
        },
        "coverage": {
            "counters_in_dataset": sorted(r["counter_id"] for r in agg.select("counter_id").distinct().collect()),
            "counters_measured_last_pass": manifest.get("counters_ran", []),
            "counters_carried_forward": manifest.get("counters_carried_forward", []),
            "counters_skipped": [s.get("counter") for s in manifest.get("counters_skipped", [])],
            "measured_on_by_counter": manifest.get("measured_on_by_counter", {}),
            "corpora_fingerprint": recorded,
            "manifest_present": bool(manifest),
            "versions": manifest.get("versions", {}),
            "published_max_abs_delta": worst,
            "published_tolerance": D.PUBLISHED_TOLERANCE,
            "published_passes": None if worst is None else all(r["passes"] for r in checked),
        },
        "pricing_as_of": D.PRICING_AS_OF,
        "usd_to_vnd": D.USD_TO_VND,
    }
    tables.write_json(spark, summary, results.path("summary.json"))
    return summary


def chart_tables(results: Results, dims: D.Dimensions) -> dict[str, DataFrame]:
    """Data, order and captions of every chart, from the stored result tables."""
    spark = results.spark
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(results.path(f"{name}.csv"))
    table, costs = read("premium_by_language"), read("cost_by_language")
    agg = results.agg
    counters, prices, corpora = dims.counters_df(spark), dims.prices_df(spark), dims.corpora_df(spark)
    order = staged(charts.headline_order(table, counters, corpora, dims.lead))
    priced = staged(charts.priced_order(costs, counters, corpora, dims.lead))
    folds = staged(coincidence.fold_identity(measure.content_totals(agg, frames_df(spark, results.manifest)), counters))
    contrast = [l for l in dims.languages if l != dims.baseline]
    heat = charts.series(table, order, "premium_aggregate", langs=contrast)
    driver = charts.series(costs, order, "tokens_per_1k_chars")
    dollars = charts.series(costs, priced, "cost_usd_per_1k_chars", 1000.0)
    units = charts.series(costs, priced, "cost_usd_per_sentence", 1000.0)
    keys = ["corpus", "counter_id", "lang"]
    for drawn in (heat, driver, dollars, units):
        gates.require_finite(drawn, "value", keys)
    gates.require_empty(charts.undrawn(table, heat, counters), "the premium chart leaves out measured counters")
    gates.require_empty(charts.undrawn(costs, dollars, counters, prices), "the dollar chart leaves out priced counters")
    ladder = charts.cost_ladder(costs, priced, dims.lead)
    gaps = charts.tax_gap(costs, priced, dims.baseline, dims.lead)
    return {
        "premium_heatmap": charts.heat_scale(heat), "cost_driver": driver, "usd_per_1m_chars": dollars,
        "usd_per_1k_units": units, "cost_ladder": ladder, "cost_spread": charts.cost_spread(ladder), "tax_gap": gaps,
        "widest_gaps": charts.widest_gaps(gaps), "fold_legend": charts.fold_legend(folds, counters, prices, order),
        "same_tokens": charts.same_tokens_different_price(folds, costs, counters, prices, priced),
        "hedged_prices": charts.hedged_prices(costs, counters, prices, priced),
        "unpriced": charts.unpriced_headlines(costs, counters, prices), "price_dates": charts.price_dates(costs, prices),
    }


def parity_tables(results: Results, units: DataFrame, language_map: DataFrame,
                  additive: Sequence[parity.ParityTokenizer],
                  codecs: Sequence[CodecTokenizer] = ()) -> dict[str, DataFrame]:
    """Lengths, unknown tokens, unknown shares and validated lengths of every language, wide.

    Tokenizers become columns in the given order; languages without a name drop out.
    """
    cells = parity.parity_lengths(units, additive)
    if codecs:
        cells = cells.unionByName(codec_lengths(units, codecs, len(additive)))
    cells = staged(parity.with_unknown_share(parity.named(cells, language_map)))
    names = [t.name for t in (*additive, *codecs)]
    valid = parity.masked(cells).withColumn("cell", F.coalesce(F.col("n_tokens").cast("string"), F.lit(D.MASK)))
    out = {
        "tokenization_lengths": parity.wide(cells, names),
        "tokenization_unknown": parity.wide(cells, names, "n_unknown"),
        "tokenization_unknown_fraction": parity.wide(cells, names, "unknown_fraction"),
        "tokenization_lengths_validated": parity.wide(valid, names, "cell"),
    }
    for name, rows in out.items():
        rows.orderBy("language").write.mode("overwrite").option("header", True).csv(results.path(f"{name}.csv"))
    return out


def parallel_corpus(records: DataFrame, n_locales: int, root: str) -> None:
    """Build the aligned line files of a parallel corpus from parsed records."""
    from glossmeter.operators.indexing import number_rows
    from glossmeter.operators.slices import clean_utterances, parallel_slice
    from glossmeter.sources.lines import write_lines
    kept = parallel_slice(staged(clean_utterances(records)), n_locales)
    rows = kept.select(F.col("locale").alias("lang"), "order", F.col("utt").alias("text"))
    write_lines(number_rows(rows, ["lang"], "order", "sentence_idx"), root)
