import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glossmeter.operators.indexing import concat_splits, number_rows
from glossmeter.operators.quantiles import quantiles


def _ids(spark):
    rng = np.random.default_rng(1)
    ids = rng.choice(5000, size=900, replace=False)
    rows = [("hot" if i % 3 else "cold", int(k)) for i, k in enumerate(ids)]
    return rows, spark.createDataFrame(rows, "g string, id bigint")


def test_positions_match_a_plain_window(spark):
    rows, df = _ids(spark)
    want = {}
    for g in ("hot", "cold"):
        for i, k in enumerate(sorted(k for h, k in rows if h == g)):
            want[(g, k)] = i
    for bits, levels in ((20, 1), (4, 1), (3, 2), (2, 3)):
        got = {(r.g, r.id): r.at for r in number_rows(df, ["g"], "id", "at", bits, levels).collect()}
        assert got == want, (bits, levels)


def test_splits_are_laid_end_to_end(spark):
    rows = [("en", s, k) for s in (0, 1) for k in range(5 - s)]
    got = concat_splits(spark.createDataFrame(rows, "lang string, split int, id bigint"), ["lang"], "split", "id", "at", 1)
    assert {(r.split, r.id): r.at for r in got.collect()} == {(s, k): s * 5 + k for _, s, k in rows}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"hot": rng.integers(1, 60, 4000) / rng.integers(1, 40, 4000), "one": np.array([2.5]),
            "pair": np.array([1.0, 2.0]), "signed": rng.normal(0, 3, 501), "flat": np.full(77, 4.0)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = {"p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9}
    got = {r.g: r for r in quantiles(df, ["g"], "v", points, mean="m", count="n").collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g].n == len(vs)
        assert abs(got[g].m - vs.mean()) < 1e-9
        for name, q in points.items():
            assert abs(got[g][name] - np.quantile(vs, q)) < 1e-9, (g, name)


def test_quantiles_use_no_single_group_sort(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    plan = quantiles(df, ["g"], "v", {"p50": .5})._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
