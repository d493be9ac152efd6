"""What the operators of this subpackage share: words, hashes, staged tables, checked broadcasts, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmeter.session import ship
from glossmeter.stage import small, staged

#: Documents that one step of a batch function holds as arrays at once, and the bytes it may hold.
STEP_ROWS, STEP_BYTES = 2048, 8 << 20
#: The same for functions that make many arrays of the length of all words; these are faster while they fit a cache.
WORD_ROWS, WORD_BYTES = 512, 2 << 20

#: A word is a run of characters other than the space and U+0009 to U+000D; as a Java pattern for SQL functions.
SPACES = r"[\x20\x09-\x0D]+"


class Hashes(dict):
    """word -> 64-bit hash, filled as words are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Of a worker; emptied when it has grown. What is in it changes no result.
_HASHES = Hashes()
_MOST_HASHES = 200_000

#: What a worker remembers from batch to batch, by who remembers it: how to forget it.
_MEMORIES: dict[str, Callable[[], object]] = {"hashes": _HASHES.clear}
_remembering = "hashes"


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc


def give_back() -> None:
    """Return to the system what this worker has freed; an idle worker keeps it otherwise, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def remembers(name: str, forget: Callable[[], object]) -> None:
    """Say that an operator is at work in this worker; what others remember is forgotten, as their stage is over."""
    global _remembering
    if name != _remembering:
        for other in _MEMORIES.values():
            other()
        give_back()
        _MEMORIES[name], _remembering = forget, name


def word_hashes(words: list[bytes]) -> np.ndarray:
    remembers("hashes", _HASHES.clear)
    if len(_HASHES) > _MOST_HASHES:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, in order; a shorter sequence is one run as a whole."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = mix(total + words[k:n - width + 1 + k] + np.uint64(0x9E3779B97F4A7C15))
    return total


def steps(rows: list[bytes | None], most_rows: int = STEP_ROWS, most_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that keep within the limits; a row over the limit is a range of its own."""
    start = held = 0
    for i, row in enumerate(rows):
        size = len(row or b"")
        if i > start and (held + size > most_bytes or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(rows):
        yield start, len(rows)


def text_steps(texts: pa.Array, most_rows: int = WORD_ROWS, most_bytes: int = WORD_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of rows as of steps(), and their texts, so that a batch is not held a second time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in steps([range(n) for n in size.tolist()], most_rows, most_bytes):
        yield a, b, texts.slice(a, b - a).to_pylist()
    give_back()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text as UTF-8 bytes in `_text`."""
    return docs.select(*keep, F.col("text").cast("binary").alias("_text"))


def over_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | Callable, schema: str) -> DataFrame:
    """Run a function of one Arrow batch over all batches."""
    def run(batches):
        for batch in batches:
            yield from work(batch)
    return frame.mapInArrow(run, schema)


#: Mark a staged table for broadcast if it is small by rows and bytes; otherwise Spark joins it by a shuffle.
checked_broadcast = small


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with so many more underscores before it that the frame has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def null_safe_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def flat(lists: list[list]) -> chain:
    return chain.from_iterable(lists)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component) for every node of an edge; component: its smallest node.

    Alternates large-star and small-star steps. A node with very many neighbours is no single task's
    list: its smallest neighbour is a map-side minimum, and the join back may be split by Spark. Each
    step is a written table, so lineage stays short and a lost executor costs one step.
    """
    e = staged(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
               .where("u is not null and v is not null and u <> v").distinct())
    while True:
        # large star: all larger neighbours of a node go to its smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = staged(large.join(low, "v").select("v", "u", "m")
                       .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
                                                 F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("s"))
                       .select("s.u", "s.v").where("u <> v").distinct())
        # done when every node hangs on one root and no root hangs on another
        tangled = small.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() \
            or small.join(small.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        e = small
        if not tangled:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
