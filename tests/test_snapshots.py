"""Publication of facts by snapshot: a pass is seen whole or not at all."""

import os

import pytest

from glossmeter.operators import gates
from glossmeter.plans import lifecycle as L
from glossmeter.sources import snapshots as S
from tests.test_lifecycle import _builder, _dims, _rows, _units

SCHEMA = "corpus string, counter_id string, lang string, spec string, n long"


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_a_pass_over_one_counter_touches_only_its_partitions(spark, tmp_path):
    results = L.SnapshotResults(spark, str(tmp_path))
    units = _units(spark)
    L.measure_pass(results, units, _dims(), _builder(), measured_on="2026-01-01")
    before, old = _files(tmp_path), _rows(results.raw, "beta")
    # without the stored facts of the other counter, a pass that read them would fail
    hidden = [f for f in before if "raw_counts" in f and "counter_id=beta" in f]
    assert hidden
    for f in hidden:
        os.rename(f, f + ".hidden")
    L.measure_pass(results, units, _dims(), _builder(), counters="alpha", measured_on="2026-02-02")
    for f in hidden:
        os.rename(f + ".hidden", f)
    after = _files(tmp_path)
    assert all(after[f] == t for f, t in before.items())                    # nothing is rewritten
    fresh = after.keys() - before.keys()
    assert fresh and all("counter_id=alpha" in f for f in fresh)
    assert _rows(results.raw, "beta") == old
    assert {r.measured_on for r in results.raw.where("counter_id = 'alpha'").collect()} == {"2026-02-02"}


@pytest.mark.parametrize("step", ["first table", "between the tables", "before the switch", "at the switch"])
def test_a_killed_pass_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    results = L.SnapshotResults(spark, str(tmp_path))
    L.measure_pass(results, _units(spark), _dims(), _builder(), measured_on="2026-01-01")
    reader = L.SnapshotResults(spark, str(tmp_path))
    want = _rows(reader.raw), _rows(reader.agg), reader.manifest
    calls = []

    def killed(at, real):
        def run(*args):
            calls.append(args)
            if len(calls) == at:
                if step == "first table":
                    args[1].write.parquet(f"{tmp_path}/{args[2]}/{args[3]}/corpus=half")         # a part of its files
                raise KeyboardInterrupt("killed")
            return real(*args)
        return run

    where, at = {"first table": ("_write", 1), "between the tables": ("_write", 2), "before the switch": ("_rename", 1), "at the switch": ("_rename", 1)}[step]
    real = getattr(S.Snapshots, where)
    monkeypatch.setattr(S.Snapshots, where, killed(at, real))
    with pytest.raises(KeyboardInterrupt):
        L.measure_pass(results, _units(spark), _dims(), _builder(), counters="alpha", measured_on="2026-02-02")
    monkeypatch.undo()
    for seen in (reader, L.SnapshotResults(spark, str(tmp_path))):
        assert (_rows(seen.raw), _rows(seen.agg), seen.manifest) == want
    # and the next pass goes through
    results.refresh()
    L.measure_pass(results, _units(spark), _dims(), _builder(), counters="alpha", measured_on="2026-03-03")
    assert {r.measured_on for r in L.SnapshotResults(spark, str(tmp_path)).agg.where("counter_id = 'alpha'").collect()} == {"2026-03-03"}
    assert (_rows(reader.raw), _rows(reader.agg), reader.manifest) == want       # a reader keeps its version
    reader.refresh()
    assert reader.manifest["measured_on_by_counter"]["alpha"] == "2026-03-03"


def test_two_passes_at_once(spark, tmp_path):
    versions = S.Snapshots(spark, str(tmp_path))
    base = versions.open()
    rows = lambda n: spark.createDataFrame([("c", "a", "x", "s", n)], SCHEMA)
    versions.publish(base, {"t": rows(1)}, lambda p: True, {"by": 1})
    with pytest.raises(ValueError, match="another pass"):
        versions.publish(base, {"t": rows(2)}, lambda p: True, {"by": 2})
    assert versions.open().manifest == {"by": 1} and versions.open().table("t").first().n == 1
    with pytest.raises(ValueError, match="kept and written"):
        versions.publish(versions.open(), {"t": rows(3)}, lambda p: True, {})
    assert versions.open(0).table("t") is None
    with pytest.raises(ValueError, match="no version"):
        versions.open(7)


def test_later_columns_and_old_versions(spark, tmp_path):
    versions = S.Snapshots(spark, str(tmp_path))
    first = versions.publish(versions.open(), {"t": spark.createDataFrame([("c", "a", "x", "s", 1), ("c d/e", "b", "x", "s", 2)], SCHEMA)}, lambda p: False, {})
    wider = spark.createDataFrame([("c", "a", "x", "s", 5, 7)], SCHEMA + ", more long")
    second = versions.publish(first, {"t": wider}, lambda p: p["counter_id"] != "a", {})
    got = sorted(tuple(r) for r in second.table("t").select("corpus", "counter_id", "n", "more").collect())
    assert got == [("c", "a", 5, 7), ("c d/e", "b", 2, None)]
    assert [(p["counter_id"], p["rows"], p["specs"]) for p in second.parts("t")] == [("a", 1, ["s"]), ("b", 1, ["s"])]
    third = versions.publish(second, {}, lambda p: p["counter_id"] == "b", {}, ["y"])
    assert third.table("t").count() == 0 and versions.open(1).table("t").count() == 2       # language x is no longer there
    versions.expire(keep=2)
    assert versions._versions() == [2, 3] and versions.open(2).table("t").count() == 2
    versions.expire(keep=1)
    assert len([f for f in _files(tmp_path) if "counter_id=a" in f and "v00000002" in f]) == 0


def test_an_empty_dataset_is_not_published(spark, tmp_path):
    results = L.SnapshotResults(spark, str(tmp_path))
    with pytest.raises(gates.Refused):
        L.measure_pass(results, _units(spark), _dims(), _builder(fail={"alpha", "beta"}))
    assert results.versions._versions() == [] and results.raw is None and results.manifest == {}
