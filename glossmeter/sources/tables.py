"""Tabular sources and sinks: unit tables, JSON lines, result tables, manifests."""

from __future__ import annotations

import json
import platform
import re
from collections.abc import Mapping, Sequence
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmeter.dims import MASK
from glossmeter.operators.indexing import number_rows
from glossmeter.sources.lines import _present, read_lines
from glossmeter.stage import small, staged

RAW_SCHEMA = ("corpus string, counter_id string, lang string, spec string, measured_on string, "
              "sentence_idx bigint, n_tokens bigint, n_tokens_content bigint, envelope_tokens bigint, n_chars bigint")
AGG_SCHEMA = ("corpus string, counter_id string, lang string, spec string, measured_on string, "
              "total_tokens bigint, total_chars bigint")
RECORD_SCHEMA = "id string, locale string, partition string, utt string"

SORT_KEYS = ("corpus", "counter_id", "lang", "sentence_idx")


def keyed_units(table: DataFrame, corpus: Column, lang: Column, key: str, text: str = "text") -> DataFrame:
    """Units of a table with a unique integer key, not numbered yet.

    Count first, then number: the counts are narrow, the text is not.
    """
    return table.select(corpus.alias("corpus"), lang.alias("lang"), F.col(key).alias("unit_key"),
                        F.col(text).alias("text"))


def numbered(rows: DataFrame) -> DataFrame:
    """Give units, or counts of units, their sentence_idx."""
    return number_rows(rows, ["corpus", "lang"], "unit_key", "sentence_idx", levels=2)


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines (value, pos) to records; unreadable lines give null fields and drop out later."""
    parsed = F.from_json(F.col(column), RECORD_SCHEMA)
    return lines.select(parsed.alias("_r"), "pos").select("_r.*", "pos")


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of JSON-lines files; ``pos`` settles repeated ids: the last one wins.

    Order is that of the files, as they are named and by name inside a folder, and of the lines in them,
    however the reader packs files into splits. Only names of files and a row per split are put together.
    """
    lines = read_lines(spark, list(paths))
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    named = [(i, re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", p).rstrip("/")) for i, p in enumerate(paths)]
    given = F.least(*[F.when((plain == p) | plain.startswith(f"{p}/"), i) for i, p in named], F.lit(len(named)), F.lit(len(named)))
    files = staged(lines.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("given", given))
    before = F.sum("n").over(Window.orderBy("given", "path").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(files.select("path", F.coalesce(before, F.lit(0)).alias("_start")))
    rows = lines.join(small(starts), "path").select(F.col("text").alias("value"), (F.col("_start") + F.col("line_idx")).alias("pos"))
    return parse_records(rows)


def read_csv_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A result table, or None if it is absent. Columns the file lacks are left out."""
    if not _present(spark, path):
        return None
    header = spark.read.option("header", True).csv(path).columns
    types = dict(part.strip().split(" ") for part in schema.split(","))
    if "corpus" not in header:
        raise ValueError(f"{path} has no corpus column; its rows cannot be told apart by corpus")
    known = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.option("header", True).schema(known).csv(path)


def sort_canonical(rows: DataFrame) -> DataFrame:
    """Rows in canonical order on the keys they have."""
    return rows.orderBy(*[k for k in SORT_KEYS if k in rows.columns])


def write_result(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result table in canonical order as range-partitioned part files."""
    writer = sort_canonical(rows).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Facts at scale: Parquet, partitioned by the columns later passes select on.

    With dynamic overwrite a pass replaces only the corpora and counters it wrote. Rows are dealt
    by range, so a language with most rows is several tasks.
    """
    (rows.repartitionByRange(*[k for k in SORT_KEYS if k in rows.columns]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "counter_id").parquet(path))


def parse_masked(lines: DataFrame, columns: Sequence[str], column: str = "value") -> DataFrame:
    """CSV lines ``language,cell,...`` with masked cells to numbers with nulls."""
    schema = "language string, " + ", ".join(f"`{c}` double" for c in columns)
    parsed = F.from_csv(F.col(column), schema, {"nullValue": MASK})
    return lines.select(parsed.alias("_r")).select("_r.*")


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """A validated parity table: masked cells become null, rows sort by language."""
    columns = spark.read.option("header", True).csv(path).columns
    schema = ", ".join([f"`{columns[0]}` string"] + [f"`{c}` double" for c in columns[1:]])
    rows = spark.read.option("header", True).option("nullValue", MASK).schema(schema).csv(path)
    return rows.withColumnRenamed(columns[0], "language").orderBy("language")


def read_language_map(spark: SparkSession, path: str) -> DataFrame:
    """(lang, language) from a CSV with the name first and the code second."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    name, code = rows.columns[0], rows.columns[1]
    return rows.select(F.trim(code).alias("lang"), F.trim(name).alias("language"))


def _filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document on any file system; empty if it is absent or unreadable."""
    if not _present(spark, path):
        return {}
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        found = json.loads(rows[0]["value"]) if rows else {}
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def write_json(spark: SparkSession, document: Mapping, path: str) -> None:
    """A small JSON document as one named file, indented, not escaped."""
    place, fs = _filesystem(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(json.dumps(document, indent=2, ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()


def library_versions(names: Sequence[str] = ("pyspark", "pandas", "pyarrow", "numpy", "tiktoken", "tokenizers",
                                             "transformers", "anthropic", "openai", "google-genai")) -> dict[str, str]:
    """Versions of every library that can move a number."""
    found = {"python": platform.python_version()}
    for name in names:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = "not installed"
    return found
