"""Content fingerprints of corpora.

A running hash over a whole language is one task by nature. The fingerprint is a hash tree
instead: one digest per sentence, digests of neighbouring sentences hashed together, and so
on up to one root per language. It changes whenever a text or an order changes, and every
level is an aggregation over at most ``2**FANOUT_BITS`` digests per group.
"""

from __future__ import annotations

import _hashlib
import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossmeter.counters import order_key
from glossmeter.stage import staged

FANOUT_BITS = 14
LEVELS = 3      # 2**42 sentences per language


def language_roots(digests: DataFrame) -> DataFrame:
    """(corpus, lang, n_sentences, root) from the SHA-256 ``digest`` of every sentence.

    Digests are taken where the text is scanned, so the text itself is not shuffled.
    """
    level = digests.select("corpus", "lang", F.col("sentence_idx").alias("_at"),
                           F.col("digest").alias("_d"), F.lit(1).cast("bigint").alias("_n"))
    for _ in range(LEVELS):
        ordered = F.array_sort(F.collect_list(F.struct("_at", "_d")))
        level = (level.withColumn("_up", F.shiftright("_at", FANOUT_BITS))
                 .groupBy("corpus", "lang", "_up")
                 .agg(ordered.alias("_l"), F.sum("_n").alias("_n"))
                 .select("corpus", "lang", F.col("_up").alias("_at"),
                         F.sha2(F.array_join("_l._d", ""), 256).alias("_d"), "_n"))
    return level.select("corpus", "lang", F.col("_n").alias("n_sentences"), F.col("_d").alias("root"))


def corpus_fingerprints(digests: DataFrame, languages: Sequence[str]) -> DataFrame:
    """One fingerprint per corpus: its language roots in configured order."""
    roots = language_roots(digests.where(F.col("lang").isin(list(languages))))
    place = F.array_position(F.array(*[F.lit(l) for l in languages]), F.col("lang"))
    ordered = F.array_sort(F.collect_list(F.struct(
        place.alias("at"), F.concat_ws(":", "lang", F.col("n_sentences"), "root").alias("leaf"))))
    return roots.groupBy("corpus").agg(
        F.max(F.when(F.col("lang") == languages[0], F.col("n_sentences"))).alias("n_sentences"),
        F.sha2(F.array_join(ordered["leaf"], "|"), 256).alias("fingerprint"))


#: Bytes of text that one task of a flat fingerprint goes through.
PART_BYTES = 64 << 20


class Running:
    """A SHA-256 whose state can be handed on, which ``hashlib`` gives no way to: OpenSSL's, as Python itself is linked to it."""

    _SIZE = 112                 # of OpenSSL's SHA256_CTX

    def __init__(self, state: bytes | None = None):
        self._lib = ctypes.CDLL(_hashlib.__file__)
        for name, kinds in (("Init", [ctypes.c_void_p]), ("Update", [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]),
                            ("Final", [ctypes.c_char_p, ctypes.c_void_p])):
            getattr(self._lib, f"SHA256_{name}").argtypes = kinds
        self._held = ctypes.create_string_buffer(state or self._SIZE, self._SIZE)
        if state is None:
            self._lib.SHA256_Init(self._held)

    @property
    def state(self) -> bytes:
        return self._held.raw

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._held, data, len(data))

    def hexdigest(self) -> str:
        out, held = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, self._SIZE)
        self._lib.SHA256_Final(out, held)
        return out.raw.hex()


def flat_fingerprints(units: DataFrame, languages: Sequence[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(corpus, sha256) in the flat layout of earlier manifests: ``lang NUL lines NUL`` per language.

    Only for comparing with such a manifest. A running hash can't be put together from parts, so the sentences are
    put in order by ranges of about ``part_bytes``, and one range after the other goes on from the state, a hundred
    bytes, that the one before has left. A task reads one range, however long a corpus is.
    """
    order = order_key(units)
    place = F.array_position(F.array(*[F.lit(l) for l in languages]), F.col("lang"))
    rows = units.where(F.col("lang").isin(list(languages))).select("corpus", place.alias("place"), F.col(order).alias("at"), "text")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = staged(rows.repartitionByRange(size // part_bytes + 1, "corpus", "place", "at").withColumn("part", F.spark_partition_id()), by="part")
    names = [l.encode() for l in languages]

    def going_on(held):
        def run(batches):
            corpus, at, running = (held[0], held[1], Running(held[2])) if held else (None, None, None)

            def told(*values):
                return pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema)

            schema = pa.schema([("corpus", pa.string()), ("sha256", pa.string()), ("place", pa.int64()), ("state", pa.binary())])
            for batch in batches:
                for name, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if running is None or name != corpus:
                        if running is not None:
                            running.update(b"\0")
                            yield told(corpus, running.hexdigest(), None, None)
                        corpus, at, running = name, place, Running()
                        running.update(names[place - 1] + b"\0")
                    elif place != at:
                        at = place
                        running.update(b"\0" + names[place - 1] + b"\0")
                    else:
                        running.update(b"\n")
                    running.update((text or "").encode())
            if running is not None:
                yield told(corpus, None, at, running.state)
        return run

    done, held = [], None
    for part in range((parts.agg(F.max("part")).first()[0] or 0) + 1):
        ordered = parts.where(F.col("part") == part).coalesce(1).sortWithinPartitions("corpus", "place", "at").select("corpus", "place", "text")
        for r in ordered.mapInArrow(going_on(held), "corpus string, sha256 string, place long, state binary").collect():
            if r["state"] is None:
                done.append((r["corpus"], r["sha256"]))
            else:
                held = (r["corpus"], r["place"], bytes(r["state"]))
    if held:
        last = Running(held[2])
        last.update(b"\0")
        done.append((held[0], last.hexdigest()))
    return units.sparkSession.createDataFrame(done, "corpus string, sha256 string")
