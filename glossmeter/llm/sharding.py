"""Histogram sort: shards of near equal bytes, by counting below candidate boundaries and one exchange.

Rows are ordered by a composite key: the hash of the text, so that equal texts lie together, then the
hash of the id, then the place in the staged table, which tells repeated rows apart. A splitter is a
point of this order. Each round counts the exact bytes in 256 cells below every splitter that is still
open, in one aggregation over narrow rows, and either puts the splitter on the cell edge within the
tolerance of its target or opens the cell that holds the target; a cell of one row is not opened. Only counts come to the driver: 256
for each open splitter. A group of equal texts is cut only where it is too heavy to lie on one side.

Defined results: a null text has no bytes and counts 8; null ids are keys like others; repeated rows
are rows of their own; an empty table gives an empty result; other columns are passed over. Only
DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmeter.llm.common import documents
from glossmeter.stage import staged

KEYS = ("_k1", "_k2", "_k3")
BITS, DIGIT = 64 * len(KEYS), 8
SHARDS = 24
#: Bytes, as a share of a shard, by which a splitter may miss its target.
TOLERANCE = 0.001
#: Rows numbered together; bounds the rows of one window.
CELL_ROWS = 20_000
_SIGN = 1 << 63


@dataclass
class Splitter:
    target: int
    prefix: int = 0             # the digits that are known
    level: int = 0
    below: int = 0              # bytes of all rows before the open cell
    edge: int | None = None     # where it was put: a number of BITS bits


def _word(value: int, k: int) -> int:
    """Part k of a composite key as the signed number that the column holds."""
    return ((value >> (BITS - 64 * (k + 1))) & (2 ** 64 - 1)) - _SIGN


def _digit(level: int) -> Column:
    k, at = divmod(level * DIGIT, 64)
    flipped = F.col(KEYS[k]).bitwiseXOR(F.lit(-_SIGN))
    return F.shiftrightunsigned(flipped, 64 - DIGIT - at).bitwiseAND(F.lit(2 ** DIGIT - 1)).cast("int")


def _inside(s: Splitter) -> Column:
    """Rows in the splitter's open cell."""
    known = s.level * DIGIT
    low, high = s.prefix << (BITS - known), ((s.prefix + 1) << (BITS - known)) - 1
    test = F.lit(True)
    for k, name in enumerate(KEYS):
        if known <= 64 * k:
            break
        test = test & F.col(name).between(_word(low, k), _word(high, k))
    return test


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Boundaries of the shards as composite keys, ascending. keyed: KEYS and `size`."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    every = [Splitter(total * j // shards) for j in range(1, shards)]
    allowed = tolerance * total / shards
    while opened := [s for s in every if s.edge is None]:
        cells = {(s.level, s.prefix): s for s in opened}
        counts: dict[tuple[int, int], dict[int, tuple[int, int]]] = {c: {} for c in cells}
        for level in {level for level, _ in cells}:
            names = [c for c in cells if c[0] == level]
            cell = F.coalesce(*[F.when(_inside(cells[c]), F.lit(i)) for i, c in enumerate(names)])
            got = (keyed.select(cell.alias("cell"), _digit(level).alias("digit"), "size").where("cell is not null")
                   .groupBy("cell", "digit").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
            for row in got.collect():                       # at most 256 for each open splitter
                counts[names[row["cell"]]][row["digit"]] = row["size"], row["n"]
        for s in opened:
            low, found = s.below, counts[(s.level, s.prefix)]
            for digit in sorted(found):
                high, n = low + found[digit][0], found[digit][1]
                if high >= s.target:
                    break
                low = high
            else:                                            # an empty table
                digit, high, n = 0, low, 0
            near_low = s.target - low <= high - s.target
            shift = BITS - (s.level + 1) * DIGIT
            if min(s.target - low, high - s.target) <= allowed or n < 2 or shift == 0:
                s.edge = ((s.prefix << DIGIT) + digit + (0 if near_low else 1)) << shift
            else:
                s.prefix, s.level, s.below = (s.prefix << DIGIT) + digit, s.level + 1, low
    return sorted(s.edge for s in every)


def _at_or_after(edge: int) -> Column:
    if edge >= 2 ** BITS:
        return F.lit(False)
    words = [_word(edge, k) for k in range(len(KEYS))]
    test = F.col(KEYS[-1]) >= words[-1]
    for name, word in list(zip(KEYS, words))[-2::-1]:
        test = (F.col(name) > word) | ((F.col(name) == word) & test)
    return test


def _place(edges: list[int], first: int = 0) -> Column:
    """Number of edges at or before a row, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(_at_or_after(edges[mid]), _place(edges[mid + 1:], first + mid + 1)).otherwise(_place(edges[:mid], first))


def histogram_sort(rows: DataFrame, keys: list[Column], size: Column, shards: int = SHARDS,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """Rows with `shard` and `slot` (from 0 without gaps in each shard). keys: two long columns."""
    keyed = staged(rows.withColumns({"_k1": keys[0], "_k2": keys[1], "_k3": F.monotonically_increasing_id(), "size": size}))
    edges = splitters(keyed, shards, tolerance)
    n = keyed.count()
    cells = max(1, -(-n // (shards * CELL_ROWS)))
    placed = keyed.withColumns({"shard": _place(edges), "_cell": F.pmod(F.xxhash64("_k3"), F.lit(cells)).cast("int")})
    # slots: the cells of a shard follow one another, and rows are numbered inside a cell
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(*KEYS)) - 1
    numbered = placed.withColumn("_inside", inside).join(starts, ["shard", "_cell"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_inside")).drop(*KEYS, "_cell", "_start", "_inside")


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).cast("long").alias("_bytes"),
        F.xxhash64(text).alias("_t"), F.xxhash64("doc_id").alias("_d"))
    out = histogram_sort(rows, [F.col("_t"), F.col("_d")], F.col("_bytes") + 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
