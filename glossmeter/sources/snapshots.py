"""Result tables published by snapshot.

A version is one small document that says which folder holds each partition (corpus and counter) of each
table. A pass writes its own partitions into a new folder, looks at what was written, and then adds
the next version's document by an atomic rename that never replaces one. Until then readers see the
old version, whole; afterwards the new one, whole: the tables and the manifest change together. What a pass did not
measure is pointed at, neither read nor written. A reader keeps the version it opened.

On stores whose rename is a copy, use a file system layer that makes it atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.sources import tables
from glossmeter.sources.lines import _present

KEYS = ("corpus", "counter_id")


@dataclass(frozen=True)
class Snapshot:
    """One version of the tables; number 0 is the empty one before the first."""

    spark: SparkSession
    root: str
    number: int
    document: dict

    @property
    def manifest(self) -> dict:
        return self.document.get("manifest", {})

    def parts(self, table: str) -> list[dict]:
        """Partitions: corpus, counter_id, folder, rows, specs, envelope."""
        return self.document.get("tables", {}).get(table, {}).get("parts", [])

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table, pruned to the partitions of this version; None if it has none."""
        parts = self.parts(name)
        if not parts:
            return None
        schema = self.document["tables"][name]["schema"]
        found = []
        for folder in sorted({p["folder"] for p in parts}):
            mine = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(k) == p[k] for k in KEYS]) for p in parts if p["folder"] == folder])
            found.append(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{folder}").where(mine))
        # partition columns come back last; the schema has the table's order
        rows = reduce(DataFrame.unionByName, found).select(*[field.split(" ", 1)[0] for field in schema.split(", ")])
        languages = self.document.get("languages")
        return rows if languages is None else rows.where(F.col("lang").isin(languages))


class Snapshots:
    """The versions under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        folder = f"{self.root}/_versions"
        if not _present(self.spark, folder):
            return []
        place, fs = tables._filesystem(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _path(self, number: int) -> str:
        return f"{self.root}/_versions/{number:08d}.json"

    def open(self, number: int | None = None) -> Snapshot:
        """A version, the latest if none is named."""
        known = self._versions()
        number = number if number is not None else (known[-1] if known else 0)
        if number and number not in known:
            raise ValueError(f"there is no version {number}")
        return Snapshot(self.spark, self.root, number, tables.read_json(self.spark, self._path(number)) if number else {})

    def publish(self, base: Snapshot, new: Mapping[str, DataFrame | None], keep: Callable[[dict], bool], manifest: dict,
                languages: list[str] | None = None) -> Snapshot:
        """Add the version in which the partitions of ``new`` replace those that ``keep`` does not hold on to.

        Refused if another pass has published since ``base`` was opened, or if a partition is both kept and new.
        """
        folder = f"v{base.number + 1:08d}-{uuid.uuid4().hex[:12]}"
        found = {}
        for name in sorted({*new, *base.document.get("tables", {})}):
            rows, old = new.get(name), base.document.get("tables", {}).get(name, {})
            parts, schema = [p for p in base.parts(name) if keep(p)], old.get("schema")
            if rows is not None:
                written = self._write(rows, name, folder)
                both = {tuple(p[k] for k in KEYS) for p in parts} & {tuple(p[k] for k in KEYS) for p in written}
                if both:
                    raise ValueError(f"partitions {sorted(both)} of {name} are kept and written anew")
                parts += written
                fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]
                known = dict(x.split(" ", 1) for x in schema.split(", ")) if schema else {}
                # rows of older versions lack later columns; they read as null
                schema = ", ".join(f"{c} {t}" for c, t in {**known, **dict(fields)}.items())
            if parts:
                found[name] = {"schema": schema, "parts": sorted(parts, key=lambda p: tuple(p[k] for k in KEYS))}
        document = {"tables": found, "manifest": manifest, "languages": languages}
        draft = f"{self.root}/_versions/.draft-{uuid.uuid4().hex}"
        tables.write_json(self.spark, document, draft)
        self._rename(draft, self._path(base.number + 1))
        return Snapshot(self.spark, self.root, base.number + 1, document)

    def _write(self, rows: DataFrame, name: str, folder: str) -> list[dict]:
        """Write partitions, dealt by range, and describe what was written."""
        path = f"{self.root}/{name}/{folder}"
        (rows.repartitionByRange(*[k for k in tables.SORT_KEYS if k in rows.columns]).write.partitionBy(*KEYS).parquet(path))
        spec = F.col("spec") if "spec" in rows.columns else F.lit(None).cast("string")
        frame = F.col("envelope_tokens") if "envelope_tokens" in rows.columns else F.lit(None).cast("long")
        written = self.spark.read.schema(rows.schema).parquet(path).groupBy(*KEYS).agg(
            F.count("*").alias("rows"), F.sort_array(F.collect_set(spec)).alias("specs"), F.min(frame).alias("envelope"))
        return [{**r.asDict(), "folder": folder} for r in written.collect()]           # a row per corpus and counter

    def _rename(self, source: str, target: str) -> None:
        jvm = self.spark.sparkContext._jvm
        place, _ = tables._filesystem(self.spark, source)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else jvm.java.io.File("/").toURI(),
                                                                    self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(place, jvm.org.apache.hadoop.fs.Path(target), none)
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise ValueError("another pass has published a version meanwhile; measure again on top of it") from None
            raise

    def expire(self, keep: int) -> None:
        """Drop all but the last versions and the folders that none of them names."""
        known = self._versions()
        if keep < 1:
            raise ValueError("at least one version stays")
        stay = [self.open(n) for n in known[-keep:]]
        used = {(t, p["folder"]) for s in stay for t in s.document["tables"] for p in s.parts(t)}
        for number in known[:-keep]:
            old = self.open(number)
            for t in old.document["tables"]:
                for folder in {p["folder"] for p in old.parts(t)}:
                    if (t, folder) not in used:
                        place, fs = tables._filesystem(self.spark, f"{self.root}/{t}/{folder}")
                        fs.delete(place, True)
            place, fs = tables._filesystem(self.spark, self._path(number))
            fs.delete(place, False)
