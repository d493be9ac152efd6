import dataclasses

import pytest
from pyspark.sql import functions as F

from glossmeter import counters as C, dims as D
from glossmeter.functions import text as T
from glossmeter.operators import gates
from glossmeter.plans import lifecycle as L

CORPUS = {"eng_Latn": ["one", "two"], "vie_Latn": ["mot", "hai"]}


def _units(spark, corpus=CORPUS, name="flores"):
    rows = [(name, lang, i, s) for lang, ss in corpus.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "corpus string, lang string, sentence_idx bigint, text string")


def _dims(**kw):
    base = dict(languages={"eng_Latn": "English", "vie_Latn": "Vietnamese"}, corpora={"flores": "FLORES+"},
                counters=(D.Counter("alpha", "Alpha", "X", "native", "live", "a"),
                          D.Counter("beta", "Beta", "X", "native", "live", "b")),
                prices=(D.Price("alpha", 1.0, "2026-10-19", "high"), D.Price("beta", None, "2026-10-19", "unknown")),
                published={}, slots={}, tints={"light": {}, "dark": {}})
    return D.Dimensions(**{**base, **kw})


def _builder(fail=(), broken=(), crash=()):
    def make(counter):
        if counter.counter_id in fail:
            return None, "unavailable in this test"
        if counter.counter_id in crash:
            raise RuntimeError("construction failed with secret=123")
        factor = {"alpha": 1, "beta": 2}[counter.counter_id]
        expr = lambda t: T.char_count(t) * factor
        if counter.counter_id in broken:
            expr = lambda t: F.when(t == "hai", F.raise_error(F.lit("429"))).otherwise(T.char_count(t)).cast("bigint")
        return C.TextCounter(counter.counter_id, counter.spec, expr, factor), ""
    return make


def _rows(frame, counter=None):
    frame = frame if counter is None else frame.where(F.col("counter_id") == counter)
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(params=[L.Results, L.SnapshotResults])
def results(spark, tmp_path, request):
    return request.param(spark, str(tmp_path / "results"))


def test_carry_forward_keeps_rows_of_counters_that_cannot_run(spark, results):
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    before = _rows(results.agg, "beta")
    assert [r[5] for r in _rows(results.agg, "alpha")] == [7, 7]        # "one two"
    manifest = L.measure_pass(results, units, _dims(), _builder(fail={"beta"}), measured_on="2026-02-02")
    assert _rows(results.agg, "beta") == before
    assert manifest["counters_carried_forward"] == ["beta"] and manifest["counters_ran"] == ["alpha"]
    assert manifest["measured_on_by_counter"] == {"alpha": "2026-02-02", "beta": "2026-01-01"}


def test_a_counter_that_breaks_midway_is_rolled_back_and_fails_the_pass(spark, results):
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    before = _rows(results.agg, "beta")
    with pytest.raises(gates.Refused, match="beta"):
        L.measure_pass(results, units, _dims(), _builder(broken={"beta"}), measured_on="2026-02-02")
    assert _rows(results.agg, "beta") == before
    assert {r.measured_on for r in results.agg.where("counter_id = 'alpha'").collect()} == {"2026-02-02"}
    reason = results.manifest["counters_skipped"][0]["reason"]
    assert reason.startswith("errored at run: ") and "429" not in reason


def test_a_counter_that_cannot_be_constructed_costs_only_itself(spark, results):
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    L.measure_pass(results, units, _dims(), _builder(crash={"beta"}), measured_on="2026-01-01")
    assert {r.counter_id for r in results.agg.collect()} == {"alpha", "beta"}
    assert "secret" not in str(results.manifest)


def test_one_missing_table_does_not_discard_the_other(spark, results, tmp_path):
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    before = _rows(results.agg, "beta")
    partial = L.Results(spark, str(tmp_path / "partial"))
    partial.write(results.agg, "aggregate_counts")
    results = partial
    manifest = L.measure_pass(results, units, _dims(), _builder(fail={"beta"}), measured_on="2026-01-01")
    assert _rows(results.agg, "beta") == before
    assert manifest["counters_without_per_sentence_rows"] == ["beta"]


def test_empty_results_and_empty_corpora_are_refused(spark, results):
    with pytest.raises(gates.Refused, match="empty"):
        L.measure_pass(results, _units(spark), _dims(), _builder(fail={"alpha", "beta"}))
    L.measure_pass(results, _units(spark), _dims(), _builder(), measured_on="2026-01-01")
    with pytest.raises(gates.Refused, match="without sentences"):
        L.measure_pass(results, _units(spark).where("false"), _dims(), _builder())
    assert results.agg.count() == 4


def test_rows_of_another_spec_are_refused(spark, results):
    L.measure_pass(results, _units(spark), _dims(), _builder(), measured_on="2026-01-01")
    moved = _dims(counters=(_dims().counters[0], dataclasses.replace(_dims().counters[1], spec="b-v2")))
    with pytest.raises(gates.Refused, match="spec"):
        L.measure_pass(results, _units(spark), moved, _builder(fail={"beta"}))


def test_order_does_not_depend_on_what_a_pass_measured(spark, results):
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    full = [tuple(r) for r in results.agg.collect()]
    L.measure_pass(results, units, _dims(), _builder(), counters="beta", measured_on="2026-01-01")
    assert [tuple(r) for r in results.agg.collect()] == full


def test_selectors_and_subsets(spark, results):
    with pytest.raises(gates.Refused, match="subset"):
        L.measure_pass(results, _units(spark), _dims(), _builder(), counters="beta")
    with pytest.raises(ValueError, match="names nothing"):
        D.select(",", ["a"], "counters")
    with pytest.raises(ValueError, match="unknown"):
        D.select("a,z", ["a"], "counters")
    assert D.select(" ", ["a", "b"], "counters") == ["a", "b"]


def test_misaligned_corpus_is_refused(spark, results):
    with pytest.raises(gates.Refused, match="aligned"):
        L.measure_pass(results, _units(spark, {"eng_Latn": ["a", "b"], "vie_Latn": ["c"]}), _dims(), _builder())


def test_blank_lines_are_refused(spark, results):
    with pytest.raises(gates.Refused, match="blank.*'sentence_idx': 1"):
        L.measure_pass(results, _units(spark, {"eng_Latn": ["a", "b"], "vie_Latn": ["c", "\u3000"]}), _dims(), _builder())


def test_changed_corpus_is_refused_by_later_stages(spark, results):
    two = {"flores": "FLORES+", "massive": "MASSIVE"}
    units = _units(spark).unionByName(_units(spark, name="massive"))
    dims = _dims(corpora=two)
    L.measure_pass(results, units, dims, _builder(), measured_on="2026-01-01")
    edited = _units(spark).unionByName(_units(spark, {"eng_Latn": ["one", "2"], "vie_Latn": ["mot", "hai"]}, "massive"))
    with pytest.raises(gates.Refused, match="massive"):
        L.measure_pass(results, edited, dims, _builder(), corpora="flores", measured_on="2026-01-02")
    with pytest.raises(gates.Refused, match="massive"):
        L.analyze(results, edited, dims)


def test_retired_counters_and_languages_are_purged(spark, results):
    L.measure_pass(results, _units(spark), _dims(), _builder(), measured_on="2026-01-01")
    fewer = _dims(languages={"eng_Latn": "English"}, lead="eng_Latn", counters=_dims().counters[:1],
                  prices=_dims().prices[:1])
    manifest = L.measure_pass(results, _units(spark), fewer, _builder(), measured_on="2026-01-02")
    assert {"purged counter beta", "purged language vie_Latn"} <= set(manifest["notes"])
    assert {(r.counter_id, r.lang) for r in results.agg.collect()} == {("alpha", "eng_Latn")}


def _scripted(frame, fail=False):
    def call(text):
        if fail:
            raise RuntimeError("down")
        return len(text) + frame
    return call


def test_api_counts_land_on_their_own_sentences_and_keep_their_probes(spark, results):
    corpus = {"eng_Latn": ["a", "bb", "ccc", "dddd"], "vie_Latn": ["e", "ff", "ggg", "hhhh"]}
    units = _units(spark, corpus)
    api = lambda c: ((lambda: C.api_counter(c.counter_id, c.spec, lambda: _scripted(8), pause=0)), "")
    builder = lambda c: api(c) if c.counter_id == "beta" else _builder()(c)
    manifest = L.measure_pass(results, units, _dims(), builder, measured_on="2026-01-01", sample=3)
    assert manifest["envelope_tokens_by_counter"] == {"alpha": 0, "beta": 8}
    rows = results.raw.where("counter_id = 'beta'").collect()
    assert len(rows) == 6 and all(r.n_tokens == r.n_chars + 8 and r.n_tokens_content == r.n_chars for r in rows)
    assert {r.total_tokens for r in results.agg.where("counter_id = 'beta'").collect()} == {13 + 8}
    probes = manifest["envelope_probe_frames_by_counter"]["beta"]
    assert probes["x"] == 8
    later = L.measure_pass(results, units, _dims(), _builder(fail={"beta"}), measured_on="2026-01-02", sample=3)
    assert later["envelope_probe_frames_by_counter"]["beta"] == probes
    assert later["envelope_tokens_by_counter"]["beta"] == 8


def test_an_endpoint_that_fails_its_probe_is_exhausted_not_skipped(spark, results):
    dead = lambda c: ((lambda: C.api_counter(c.counter_id, c.spec, lambda: _scripted(8, True), pause=0)), "")
    builder = lambda c: dead(c) if c.counter_id == "beta" else _builder()(c)
    with pytest.raises(gates.Refused, match="beta"):
        L.measure_pass(results, _units(spark), _dims(), builder)
    assert {r.counter_id for r in results.agg.collect()} == {"alpha"}


def test_analysis_and_charts_from_stored_tables(spark, results):
    dims = _dims()
    L.measure_pass(results, _units(spark), dims, _builder(), measured_on="2026-01-01")
    summary = L.analyze(results, _units(spark), dims)
    assert summary["headline_premiums_aggregate_by_corpus"] == {
        "flores": {"alpha": {"Vietnamese": 1.0}, "beta": {"Vietnamese": 1.0}}}
    table = spark.read.option("header", True).csv(results.path("premium_by_language.csv")).collect()
    assert len(table) == 4 and {r.distribution_basis for r in table} == {"full sweep"}
    charts = L.chart_tables(results, dims)
    assert [r.counter_id for r in charts["cost_ladder"].collect()] == ["alpha"]
    assert charts["unpriced"].first()["names"] == "Beta"
    for frame in charts.values():
        frame.collect()
