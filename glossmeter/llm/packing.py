"""Packing by non-negative least squares over shallow length combinations.

Every text is encoded once and cut into windows of 1024 ids; what is left over makes a histogram of at
most 1023 lengths, whatever the size of the corpus. All pairs and triples of lengths that fill a window
exactly are enumerated, their repeat counts are solved against the histogram by projected gradients,
rounded down, and raised again while the stock lasts. The residue is packed greedily: whole pieces,
longest first into the tightest gap, as long as this fills a window nearly; pieces that no such
combination takes are laid end to end and cut where a window ends, and the last of them at powers of two,
so no length that is too common leaves padding behind.

The plan speaks of lengths and repeat counts only; each piece finds its sequence from its rank among the
pieces of its length, by a search in the plan's arrays. The plan has at most as many entries as there are
combinations and lengths, so it may travel with the tasks. Ranks need no task that sees all pieces of a
length: a piece is numbered inside its partition, partitions are counted per length, and their starts are
running sums over these counts. Texts move nowhere; ids of a piece are kept until it is known whether it
is cut, and moved only for lengths that are.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on its own; an
empty table gives an empty result. A sequence that ends at a power of two needs no padding; all others
are padded to 1024.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glossmeter.llm.common import documents, over_batches, text_steps
from glossmeter.llm.encoding import default_tokenizer, encoder
from glossmeter.stage import staged

WINDOW, END = 1024, 0
#: Rounds of the solver; more make the rounded plan no better.
ROUNDS = 300
#: Padding that a sequence of whole residual pieces may have; with more, its pieces are cut instead.
GAP = 8

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, _part long, _rank long, _ids binary"


def combinations(window: int = WINDOW) -> np.ndarray:
    """Rows (a, b, c) of lengths with a >= b >= c >= 0, b > 0, that fill a window; c = 0 for pairs."""
    c = np.arange(window // 3 + 1)
    rows = []
    for x in c:
        b = np.arange(max(x, 1), (window - x) // 2 + 1)
        rows.append(np.stack([window - x - b, b, np.full(len(b), x)], 1))
    return np.concatenate(rows)


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x with A x near the histogram, by projected gradients with momentum.

    A[l, j]: how often combination j uses length l.
    """
    size = len(histogram)
    if not len(combos):
        return np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0

    def used(x):
        out = sum(np.bincount(combos[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    # the largest eigenvalue of A'A, by powers
    v = np.ones(len(combos))
    for _ in range(12):
        w = used(v)
        v = w[combos].sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        gap = used(y) - target
        new = np.maximum(0, y - gap[combos].sum(1) / top)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of sequences, how often each is made, and the stock that is to be cut.

    Kinds: rows of lengths, padded with 0.
    """
    stock = histogram.astype(np.int64).copy()
    combos = combinations(window)
    combos = combos[((stock[combos] > 0) | (combos == 0)).all(1)]        # of lengths that there are
    wanted = solve(stock, combos)
    kinds: list[tuple[int, ...]] = []
    repeats: list[int] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for length in set(lengths):
            times = min(times, stock[length] // lengths.count(length))
        if times > 0:
            for length in lengths:
                stock[length] -= times
            kinds.append(lengths)
            repeats.append(int(times))

    def of(j: int) -> tuple[int, ...]:
        return tuple(int(v) for v in combos[j] if v)

    floor = np.floor(wanted + 1e-9).astype(np.int64)
    for j in np.flatnonzero(floor):
        take(of(j), int(floor[j]))
    # what rounding took off goes back, largest shares first, while the stock lasts
    share = wanted - floor
    order = np.argsort(-share, kind="stable")
    for j in order[share[order] > 1e-3]:
        take(of(j), 1)
    # residue: the longest left, then again and again the longest that fits
    left = stock.copy()
    while left[1:].any():
        room, lengths, rest = window, [], left.copy()
        while (fit := np.flatnonzero(rest[1:room + 1])).size:
            lengths.append(int(fit[-1]) + 1)
            rest[lengths[-1]] -= 1
            room -= lengths[-1]
        times = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        for v in lengths:
            left[v] -= times
        if room <= GAP:
            take(tuple(lengths), times)
    width = max(map(len, kinds), default=1)
    table = np.array([k + (0,) * (width - len(k)) for k in kinds], np.int64).reshape(-1, width)
    return table, np.array(repeats, np.int64), stock


class Stream:
    """The pieces that are cut, end to end, shortest first: where a stretch of the stream goes."""

    def __init__(self, histogram: np.ndarray, stock: np.ndarray, first: int, window: int = WINDOW):
        self.whole = histogram - stock                        # ranks below are taken by the plan
        tokens = stock * np.arange(len(stock))
        self.base, self.first, self.window = np.cumsum(tokens) - tokens, first, window
        total = int(tokens.sum())
        self.full = total // window * window
        # the rest is cut into powers of two, longest first
        ends = [self.full]
        for bit in range(window.bit_length() - 1, -1, -1):
            if (total - self.full) >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.tail = ends

    def stretches(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of each part."""
        at = int(self.base[length]) + (rank - int(self.whole[length])) * length
        stop, out, done = at + length, [], 0
        while at < stop:
            if at < self.full:
                n, inside = divmod(at, self.window)
                end = at - inside + self.window
            else:
                k = next(i for i in range(len(self.tail) - 1) if at < self.tail[i + 1])
                n, inside, end = self.full // self.window + k, at - self.tail[k], self.tail[k + 1]
            size = min(end, stop) - at
            out.append((done, size, self.first + n, inside))
            at, done = at + size, done + size
        return out


class Lookup:
    """From (length, rank) to sequence and offset, for sequences numbered from `first`."""

    def __init__(self, kinds: np.ndarray, repeats: np.ndarray, first: int):
        starts = first + np.cumsum(repeats) - repeats
        offset = np.cumsum(kinds, 1) - kinds
        kind, slot = np.nonzero(kinds)
        length = kinds[kind, slot]
        order = np.argsort(length, kind="stable")             # places of a length lie together, in plan order
        self.length, kind, slot = length[order], kind[order], slot[order]
        times = repeats[kind]
        before = np.cumsum(times) - times
        head = np.searchsorted(self.length, self.length)      # the first place of the same length
        self.rank = before - before[head] if len(head) else before
        self.start, self.offset = starts[kind], offset[kind, slot]
        # one ascending key over (length, first rank)
        self.scale = int(times.sum()) + 1
        self.key = self.length * self.scale + self.rank

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * self.scale + rank, side="right") - 1
        return self.start[at] + rank - self.rank[at], self.offset[at]


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most a window, with the checksum of their ids and their rank in their partition.

    Pieces shorter than a window also have their ids.
    """
    tail = np.array([END], "<u4").tobytes()

    def run(batches):
        seen, part = np.zeros(window + 1, np.int64), None
        cut = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() >> 33 if part is None and len(ids) else part
            for a, b, texts in text_steps(batch.column(1), 256, 1 << 19):
                out = [[] for _ in range(6)]
                for doc, packed in zip(ids[a:b], cut.encode([(t or "") for t in texts])):
                    packed += tail
                    total = len(packed) // 4
                    for start in range(0, total, window):
                        piece = packed[4 * start:4 * (start + window)]
                        n = len(piece) // 4
                        for column, value in zip(out, (doc, start, n, zlib.crc32(piece), total, piece if n < window else None)):
                            column.append(value)
                length = np.array(out[2], np.int64)
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
                rank += seen[length]
                seen += np.bincount(length, minlength=window + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(length, pa.int32()),
                    pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()),
                    pa.array(np.full(len(length), part, np.int64)), pa.array(rank), pa.array(out[5], pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_rank", "_ids"])

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and offset."""
    pieces = staged(cut_pieces(docs, tokenizer or default_tokenizer(), window))
    counts = staged(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")))
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most `window` rows
        histogram[row["length"]] = row["n"]
    full, histogram = int(histogram[window]), histogram[:window]
    kinds, repeats, stock = plan(histogram, window)
    find = Lookup(kinds, repeats, first=full)
    stream = Stream(histogram, stock, first=full + int(repeats.sum()), window=window)
    cut_lengths = np.flatnonzero(stock).tolist()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))

    def place(batch: pa.RecordBatch):
        doc, start, length, crc, tokens, own, first, ids = batch.columns
        length, start, crc = length.to_numpy().astype(np.int64), start.to_numpy(), crc.to_numpy()
        rank = first.to_numpy() + own.to_numpy()
        cut = np.zeros(len(rank), bool)
        part = length < window
        cut[part] = rank[part] >= stream.whole[length[part]]
        sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
        part &= ~cut
        if part.any():
            sequence[part], offset[part] = find(length[part], rank[part])
        whole, row, parts = ~cut, np.flatnonzero(cut), []
        for i in row:
            packed = ids[int(i)].as_py()
            parts += [(i, start[i] + a, n, zlib.crc32(packed[4 * a:4 * (a + n)]), s, o)
                      for a, n, s, o in stream.stretches(int(length[i]), int(rank[i]))]
        extra = np.array(parts, np.int64).reshape(-1, 6)
        pick = pa.array(np.concatenate([np.flatnonzero(whole), extra[:, 0]]))

        def both(values, k):
            return pa.array(np.concatenate([values[whole], extra[:, k]]))

        yield pa.RecordBatch.from_arrays(
            [doc.take(pick), both(start, 1), both(length, 2), both(crc, 3), tokens.take(pick), both(sequence, 4), both(offset, 5)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = pieces.join(starts, ["length", "_part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank", "_first",
        F.when(F.col("length").isin(cut_lengths), F.col("_ids")).alias("_ids"))
    return over_batches(placed, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                       "sequence_id long, offset long")


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
