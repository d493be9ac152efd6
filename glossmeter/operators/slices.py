"""Parallel slices: utterances that exist in every locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossmeter.functions import text as T


def clean_utterances(records: DataFrame, partition: str = "dev") -> DataFrame:
    """(locale, id, utt) from parsed records (locale, id, partition, utt, pos).

    Keeps one partition, strips and normalises, drops empty and newline-bearing utterances;
    of a repeated id the last survivor counts.
    """
    rows = (records.where(F.col("partition") == partition)
            .withColumn("utt", T.nfc(T.strip_space(F.col("utt"))))
            .where((F.col("utt") != "") & ~F.contains("utt", F.lit("\n"))))
    return rows.groupBy("locale", "id").agg(F.max_by("utt", "pos").alias("utt"))


def parallel_slice(utterances: DataFrame, n_locales: int) -> DataFrame:
    """Utterances whose id exists in all locales, ordered by the numeric id."""
    common = (utterances.groupBy("id").agg(F.count_distinct("locale").alias("_n"))
              .where(F.col("_n") == n_locales).select("id"))
    return utterances.join(common, "id", "left_semi").withColumn("order", F.col("id").cast("bigint"))


def dropped_per_locale(utterances: DataFrame, n_locales: int) -> DataFrame:
    """Utterances each locale loses to the intersection."""
    kept = parallel_slice(utterances, n_locales).select("locale", "id", F.lit(1).alias("_kept"))
    return (utterances.select("locale", "id").join(kept, ["locale", "id"], "left")
            .groupBy("locale").agg(F.count(F.lit(1)).alias("n_utterances"), F.count("_kept").alias("n_kept"))
            .withColumn("n_dropped", F.col("n_utterances") - F.col("n_kept")))
