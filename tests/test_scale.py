"""Plans and keys that have to hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from glossmeter.operators import bpe
from glossmeter.plans import oracle
from glossmeter.sources import lines, tables
from glossmeter.stage import SPREAD, small, spread


def test_lines_are_numbered_without_moving_text(spark, tmp_path):
    whole = [f"line {i}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(whole) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.read_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = {(r["path"][-5], r["line_idx"]): r["text"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {**{("a", i): t for i, t in enumerate(whole)}, ("b", 0): "one", ("b", 1): "", ("b", 2): "three"}
    # only the table of splits is exchanged, to be broadcast
    assert "Window" not in plan and not re.search(r"Exchange (hash|range)partitioning", plan)


def test_positions_of_hashed_keys(spark):
    units = spark.range(2000).select(F.lit("c").alias("corpus"), F.lit("l").alias("lang"), F.xxhash64("id").alias("unit_key"))
    rows = tables.numbered(units).orderBy("unit_key").collect()
    assert [r["sentence_idx"] for r in rows] == list(range(2000))


def test_every_word_shapes_the_vocabulary(spark):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    texts = spark.createDataFrame([(" ".join(words) + " zebra",)], "text string")
    tokens = {bytes(r["token"]).decode() for r in bpe.prefix_vocabulary(texts, 100_000).where("rank > 255").collect()}
    assert {" zebra", "aaa", " hhh"} <= tokens and len(tokens) > len(words)
    short = bpe.collect_ranks(bpe.prefix_vocabulary(texts, 300))
    assert len(short) == 300
    for token, rank in short.items():
        assert len(token) == 1 or rank > 255 and (short.get(token[:-1], 1 << 60) < rank)


def test_spread_is_off_unless_asked_for(spark):
    rows = spark.range(100, numPartitions=1)
    assert spread(rows, "id").rdd.getNumPartitions() == 1
    spark.conf.set(SPREAD, "3")
    try:
        assert spread(rows, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(SPREAD)


def test_broadcast_only_of_small_tables(spark):
    rows = spark.range(10)
    assert "ResolvedHint" in small(rows)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small(rows, 9)._jdf.queryExecution().analyzed().toString()


def test_sql_carries_only_the_steps_it_needs():
    assert oracle.ORACLE["premium_aggregate"].count(" AS ") < oracle._PRELUDE.count(" AS ") / 2
    assert "words_by_weight" not in oracle.ORACLE["premium_aggregate"]


@pytest.mark.parametrize("places", [{"a": ("flat", "/x")}, {"a": ("flat", "/x"), "b": ("flat", "/y"), "c": ("flat", "/z")}])
def test_corpora_and_places_name_the_same_things(spark, places):
    with pytest.raises(KeyError):
        lines.load_corpora(spark, places, ["a", "b"], ["x"])


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from glossmeter.stage import small, staged
    rows = staged(spark.range(1000).selectExpr("id", "repeat(uuid(), 20) AS text"))
    hinted = lambda frame: "broadcast" in frame._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small(rows)) and not hinted(rows)
    assert not hinted(small(rows, most=999)) and not hinted(small(rows, most_bytes=1000))


def test_scratch_tables_are_removed(spark, tmp_path):
    import os

    from glossmeter.stage import scratch, stage_dir, staged
    kept = staged(spark.range(3))
    before = set(os.listdir(stage_dir(spark)))
    with scratch(spark):
        inside = staged(spark.range(5))
        with scratch(spark):
            staged(spark.range(7))
        inside.write.parquet(f"{tmp_path}/out")
        with scratch(spark):
            outer = staged(staged(spark.range(9)).where("id > 1"), keep=True)
        assert outer.count() == 7
    assert set(os.listdir(stage_dir(spark))) == before
    assert kept.count() == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_shuffle_files_of_finished_writes_are_swept(spark):
    import time

    from glossmeter.stage import staged, sweep
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    kept = staged(spark.range(100_000).repartition(7, "id"))
    before, until = held(), time.time() + 20
    assert before
    sweep(spark)
    while held() >= before and time.time() < until:
        time.sleep(0.2)
    assert held() < before and kept.count() == 100_000
