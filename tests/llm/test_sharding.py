import random

from glossmeter.llm import sharding as S
from pyspark.sql import functions as F


def shard(docs, shards=5, **more):
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.xxhash64(text).alias("_t"), F.xxhash64("doc_id").alias("_d"))
    return S.histogram_sort(rows, [F.col("_t"), F.col("_d")], F.octet_length(text).cast("long") + 8, shards, **more).collect()


def test_bytes_are_near_equal_and_slots_have_no_gaps(spark):
    # a third of the rows have one text
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 8))
                                    .otherwise(F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("text"))
    rows = shard(docs)
    total = sum(r["size"] for r in rows)
    assert len(rows) == 6000
    for s in range(5):
        mine = [r for r in rows if r["shard"] == s]
        assert abs(sum(r["size"] for r in mine) - total / 5) < 0.01 * total / 5 + 200
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    spans = {}
    for r in rows:
        spans.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) - 1 for s in spans.values()) <= 4       # only texts on a boundary are cut


def test_odd_rows(odd, nothing):
    rows = shard(odd, 3)
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] == 1} == {8}
    assert shard(nothing) == []


def test_plan_has_no_python(spark, odd):
    text = F.coalesce("text", F.lit(""))
    rows = odd.select("doc_id", F.xxhash64(text).alias("_t"), F.xxhash64("doc_id").alias("_d"), text.alias("t"))
    plan = S.histogram_sort(rows, [F.col("_t"), F.col("_d")], F.octet_length("t").cast("long"), 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_splitters_against_a_full_sort(spark):
    """Shards are stretches of the sorted keys, cut at the row nearest to each target, ties and huge rows included."""
    rng = random.Random(3)
    rows = [(rng.choice([-2 ** 63, -1, 0, 5, 2 ** 63 - 1, rng.randint(-2 ** 63, 2 ** 63 - 1)]), rng.randint(-5, 5), rng.choice([1, 8, 9, 50, 4000])) for _ in range(700)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, a long, b long, n long").repartition(3)
    got = {r["doc_id"]: r["shard"] for r in S.histogram_sort(docs, [F.col("a"), F.col("b")], F.col("n"), 7, tolerance=0.0).collect()}
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    shards = [got[i] for i in order]
    # rows of equal keys may be cut in any order among them
    for i, j in zip(order, order[1:]):
        assert rows[i][:2] == rows[j][:2] or got[i] <= got[j]
    total, size = sum(r[2] for r in rows), [0] * 7
    for i, s in zip(order, shards):
        size[s] += rows[i][2]
    for k in range(1, 7):
        assert abs(sum(size[:k]) - total * k // 7) <= 2000        # half of the largest row
