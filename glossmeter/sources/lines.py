"""Line-aligned corpus files: one sentence per line, aligned across languages by position."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glossmeter.functions import text as T
from glossmeter.stage import small, staged


def _present(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def require_file(spark: SparkSession, path: str, corpus: str, lang: str) -> str:
    """The path, or an error that names what lacks it and the way out."""
    if not _present(spark, path):
        raise FileNotFoundError(f"{corpus}: no file for language {lang!r} at {path}; add the aligned file "
                                "or leave the language out of the configuration")
    return path


def read_lines(spark: SparkSession, path: str | Sequence[str], keep_terminal: bool = False) -> DataFrame:
    """(path, line_idx, text) of text files, in the order of the file.

    Any newline style ends a line and nothing is filtered, so positions hold. A byte order mark
    is skipped by the reader. Files are read in splits; the lines of a split are read one after
    another, so a line's place in it follows from the ids that Spark gives as it reads, and a split
    starts at the number of lines before it. Only a row per split is put together: no text moves.
    ``keep_terminal`` adds the empty piece that follows a terminal newline.
    """
    meta = ["_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size"]
    rows = spark.read.text(path).select(
        F.col(meta[0]).alias("path"), F.col(meta[1]).alias("_block"), F.col(meta[2]).alias("_size"),
        F.col("value").alias("text"), F.monotonically_increasing_id().alias("_at"))
    sizes = staged(rows.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(sizes.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    lines = (rows.join(small(starts), ["path", "_block"])
             .select("path", (F.col("_at") + F.col("_shift")).cast("bigint").alias("line_idx"), "text"))
    if not keep_terminal:
        return lines
    # A file ends in a newline if it has as many line feeds as lines. Reading by line feed
    # leaves carriage returns in place, so the bytes beside the feeds are all accounted for.
    fed = spark.read.text(path, lineSep="\n").select(
        F.col(meta[0]).alias("path"), F.col(meta[2]).alias("_size"), F.octet_length("value").alias("_b"))
    ended = (fed.groupBy("path", "_size").agg(F.sum("_b").alias("_bytes"), F.count(F.lit(1)).alias("_lines"))
             .where(F.col("_size") - F.col("_bytes") >= F.col("_lines")).select("path"))
    tail = (sizes.groupBy("path").agg(F.sum("_n").alias("line_idx"))
            .join(ended, "path", "left_semi").withColumn("text", F.lit("")))
    return lines.unionByName(tail)


def blank_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions of blank lines; any of them would shift the alignment."""
    return lines.where(T.is_blank(F.col("text"))).select(*keys)


def split_corpus(spark: SparkSession, root: str, corpus: str, languages: Sequence[str],
                 splits: Sequence[tuple[str, str]] = (("dev", "dev"), ("devtest", "devtest")),
                 normalise: bool = True, keep_terminal: bool = False) -> DataFrame:
    """Units of a corpus kept as ``root/<split>/<lang>.<ext>``, splits end to end in order."""
    paths = [require_file(spark, os.path.join(root, d, f"{lang}.{ext}"), corpus, lang)
             for d, ext in splits for lang in languages]
    place = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    split = reduce(lambda acc, item: F.when(place == item[1][0], F.lit(item[0])).otherwise(acc),
                   enumerate(splits), F.lit(None).cast("int"))
    lines = read_lines(spark, paths, keep_terminal).select(
        F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1).alias("lang"), split.alias("_split"), "line_idx", "text")
    sizes = lines.groupBy("lang", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("lang").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lang", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    text = T.nfc(F.col("text")) if normalise else F.col("text")
    return (lines.join(starts, ["lang", "_split"])
            .select(F.lit(corpus).alias("corpus"), "lang",
                    (F.col("line_idx") + F.col("_base")).cast("bigint").alias("sentence_idx"), text.alias("text")))


def flat_corpus(spark: SparkSession, root: str, corpus: str, languages: Sequence[str]) -> DataFrame:
    """Units of a corpus kept as ``root/<lang>.txt``."""
    paths = [require_file(spark, os.path.join(root, f"{lang}.txt"), corpus, lang) for lang in languages]
    return read_lines(spark, paths).select(
        F.lit(corpus).alias("corpus"), F.regexp_extract("path", r"/([^/]+)\.txt$", 1).alias("lang"),
        F.col("line_idx").alias("sentence_idx"), T.nfc(F.col("text")).alias("text"))


LAYOUTS = {"splits": split_corpus, "flat": flat_corpus}


def load_corpora(spark: SparkSession, places: Mapping[str, tuple[str, str]], corpora: Sequence[str],
                 languages: Sequence[str]) -> DataFrame:
    """Units of several corpora from ``{corpus: (layout, root)}``.

    The places and the configured corpora have to name the same things.
    """
    declared, placed = set(corpora), set(places)
    if declared - placed:
        raise KeyError(f"corpora without a place: {sorted(declared - placed)} (known: {sorted(placed)})")
    if placed - declared:
        raise KeyError(f"places of corpora that are not configured: {sorted(placed - declared)} (known: {sorted(declared)})")
    parts = [LAYOUTS[places[c][0]](spark, places[c][1], c, list(languages)) for c in corpora]
    return reduce(DataFrame.unionByName, parts)


def languages_in(spark: SparkSession, root: str, extension: str = "dev") -> DataFrame:
    """Language codes that have a file in a folder, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(root)
    return file_languages(files.select("path"), extension)


def file_languages(paths: DataFrame, extension: str = "dev") -> DataFrame:
    """Language codes from file paths, sorted."""
    code = F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1)
    return paths.select(code.alias("lang")).where(F.col("lang") != "").distinct().orderBy("lang")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A list of language codes, one per line, trimmed."""
    return read_lines(spark, path).select(T.strip_space(F.col("text")).alias("lang"))


def write_lines(units: DataFrame, root: str) -> None:
    """Aligned line files, one folder per language, in sentence order.

    Each language is range-partitioned by position, so part files read in name order give
    the corpus; no language has to pass through one task.
    """
    (units.repartitionByRange("lang", "sentence_idx").sortWithinPartitions("lang", "sentence_idx")
     .select("lang", "text").write.mode("overwrite").partitionBy("lang").text(root))
