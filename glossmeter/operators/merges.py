"""Size sweeps of a byte-pair vocabulary from one trace of merges per piece.

Encoding a piece merges pairs in the order of their ranks, so under a vocabulary cut at a rank it does
the same merges up to there. One pass over a piece tells at which ranks its length drops; its length
at any size is its bytes less the drops below that size. Sums of drops per rank are a small table, and
every size is a range sum over it. Where a vocabulary is not in merge order, a piece can merge back to a
lower rank; such a piece is encoded at each of its own ranks instead, so the drops are right for any
vocabulary with the 256 single bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DROPS = "array<struct<rank:bigint,tokens:bigint>>"


def merge_ranks(piece: bytes, ranks: Mapping[bytes, int], below: float = float("inf")) -> list[int]:
    """Ranks of the merges of a piece, in the order in which they are done: the lowest first, and of equal ones the leftmost."""
    n = len(piece)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))       # of the part that begins at each byte
    heap = []

    def offer(i: int) -> None:
        if stop[i] < n:
            rank = ranks.get(piece[i:stop[stop[i]]])
            if rank is not None and rank < below:
                heapq.heappush(heap, (rank, i, stop[stop[i]]))

    for i in range(n - 1):
        offer(i)
    done = []
    while heap:
        rank, i, end = heapq.heappop(heap)
        j = stop[i]
        if j < 0 or j >= n or stop[j] != end:
            continue                                        # one of the two parts has been merged otherwise
        stop[i], stop[j] = end, -1
        if end < n:
            before[end] = i
        done.append(rank)
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return done


def drops(piece: bytes, ranks: Mapping[bytes, int]) -> list[tuple[int, int]]:
    """(rank, by how many tokens the piece is shorter once the vocabulary has that rank), by rank."""
    own = ranks.get(piece, float("inf"))                    # a piece that is a token is one token, however it merges
    done = merge_ranks(piece, ranks, own)
    if any(a > b for a, b in zip(done, done[1:])):
        parts = {piece[i:j] for i in range(len(piece)) for j in range(i + 2, len(piece) + 1)}
        steps, length, out = sorted({r for p in parts if (r := ranks.get(p)) is not None and r < own}), len(piece), []
        for rank in steps:
            now = len(piece) - len(merge_ranks(piece, ranks, rank + 1))
            if now != length:
                out.append((rank, length - now))
            length = now
    else:
        counts: dict[int, int] = {}
        for rank in done:
            counts[rank] = counts.get(rank, 0) + 1
        out, length = sorted(counts.items()), len(piece) - len(done)
    if own != float("inf") and length > 1:
        out.append((own, length - 1))
    return out


def merge_traces(pieces: DataFrame, ranks) -> DataFrame:
    """(piece, n_bytes, drops) of distinct pieces; ranks: a shared vocabulary."""
    def work(batches):
        vocabulary = ranks.value
        for batch in batches:
            texts = [p.encode() for p in batch.column(0).to_pylist()]
            found = [[{"rank": r, "tokens": k} for r, k in drops(t, vocabulary)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array(found, pa.list_(pa.struct([("rank", pa.int64()), ("tokens", pa.int64())])))],
                                             names=["piece", "n_bytes", "drops"])

    return pieces.select("piece").mapInArrow(work, f"piece string, n_bytes long, drops {DROPS}")


def drop_sums(pieces: DataFrame, group: Sequence[str], ranks) -> DataFrame:
    """(group, rank, tokens): by how much a group's count falls at each rank; rank -1: its bytes, as a negative fall.

    All groups that hold a piece come together in one row, so a piece is traced once. The number of tasks is
    set here, since small rows carry much work.
    """
    spark = pieces.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = F.collect_list(F.struct(*group, "n")).alias("held")
    once = pieces.repartition(tasks, "piece").groupBy("piece").agg(held)

    def work(batches):
        vocabulary = ranks.value
        for batch in batches:
            texts = [p.encode() for p in batch.column(0).to_pylist()]
            found = [[{"rank": -1, "tokens": -len(t)}, *({"rank": r, "tokens": k} for r, k in drops(t, vocabulary))] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.struct([("rank", pa.int64()), ("tokens", pa.int64())])))], names=["held", "drops"])

    schema = f"held {once.schema['held'].dataType.simpleString()}, drops {DROPS}"
    rows = once.mapInArrow(work, schema).select(F.explode("held").alias("h"), "drops").select("h.*", F.explode("drops").alias("d"))
    return rows.groupBy(*group, F.col("d.rank").alias("rank")).agg(F.sum(F.col("n") * F.col("d.tokens")).alias("tokens"))


def tokens_by_size(pieces: DataFrame, group: Sequence[str], ranks, sizes: Sequence[float]) -> DataFrame:
    """(group, vocab_size, n_tokens) for every truncation of the vocabulary (at least the single bytes)."""
    sums = drop_sums(pieces, group, ranks)
    cuts = [float(s) for s in sizes]
    totals = sums.groupBy(*group).agg(*[(-F.sum(F.when(F.col("rank") < cut, F.col("tokens")))).alias(f"_s{i}") for i, cut in enumerate(cuts)])
    entries = F.array(*[F.struct(F.lit(cut).alias("vocab_size"), F.col(f"_s{i}").alias("n_tokens")) for i, cut in enumerate(cuts)])
    return totals.select(*group, F.explode(entries).alias("_e")).select(*group, "_e.vocab_size", "_e.n_tokens")
