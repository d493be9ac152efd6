"""Repair of conversations by the cheapest edits, over a grammar of their role and fault sequences.

A row's role initial and first fault make a symbol. Legal conversations are those of a small automaton, so
the cheapest edits of a sequence are a shortest path, and a sequence is a matrix: for each state before it and
each after it, the least cost and, of the cheapest, the ASCII-least audit. Matrices are combined by
(min, +). Over the same rows no cheapest audit is the beginning of another between the same states, as it would
lack insertions that cost; so the least audits of the parts make the least of the whole.

Conversations repeat each other's sequences. The distinct ones are compressed by Re-Pair: in each round the
most frequent pairs of neighbours become symbols of their own, counted over all sequences. A rule's matrix
is made once from its two sides, its audits being ropes that share their parts, and serves every conversation
that holds the rule. The numbers of rounds and rules are bounded; what they leave is multiplied symbol by
symbol, so the bounds change no result.

Order: rows are dealt by ranges of (conversation, turn, role, text), so a very long conversation is several
tasks' work; it becomes blocks of BLOCK symbols, whose matrices are multiplied in groups of FAN. Texts are
moved once more at the end, for the digest of the repaired conversation: rows stream past their audit in
order, and a task holds no conversation. A SHA-256 digest can't be put together from parts, so one
conversation's is one stream; the audit is one value of a row.

Defined results: nulls of a row, also in the damage key, are one space; a null conversation id is a conversation
of its own; rows of one turn are ordered by role and text; repeated rows are duplicates of the first; empty and
very long texts are texts; without rows after damage all numbers are 0; an empty table gives an empty result;
other columns are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmeter.llm.common import checked_broadcast, over_batches
from glossmeter.session import ship
from glossmeter.stage import staged

SPACE = " \t\n\x0b\x0c\r"
#: Symbols of a block of a long conversation; blocks that are multiplied at once.
BLOCK, FAN = 4096, 16
#: Rounds of Re-Pair, pairs that one round may replace, and characters that a rope keeps in one piece.
ROUNDS, PAIRS, FLAT = 14, 256, 256
RULES = ROUNDS * PAIRS

# -- the automaton and the edits -------------------------------------------------------------------

#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. Legal: 0 and 3.
STATES, LEGAL = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a row may be given, or that may be put in, in each state.
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INITIALS = "sua"                                             # a fourth stands for all others
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
SYMBOLS = 16                                                 # initial * 4 + fault


class Rope:
    """A string put together from shared parts, with a hash by which two of them are compared."""

    __slots__ = ("size", "hash", "flat", "left", "right")
    PRIME, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self, flat: str | None, left: "Rope | None" = None, right: "Rope | None" = None):
        self.flat, self.left, self.right = flat, left, right
        if flat is not None:
            self.size, self.hash = len(flat), _hash(flat)
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.PRIME) + right.hash) % self.PRIME

    def __add__(self, other: "Rope") -> "Rope":
        if not self.size or not other.size:
            return other if not self.size else self
        if self.size + other.size <= FLAT and self.flat is not None and other.flat is not None:
            return Rope(self.flat + other.flat)
        return Rope(None, self, other)

    def prefix_hash(self, n: int) -> int:
        done, node = 0, self
        while n:
            if node.flat is not None:
                return (done * pow(self.BASE, n, self.PRIME) + _hash(node.flat[:n])) % self.PRIME
            if n < node.left.size:
                node = node.left
                continue
            done = (done * pow(self.BASE, node.left.size, self.PRIME) + node.left.hash) % self.PRIME
            n, node = n - node.left.size, node.right
        return done

    def char(self, at: int) -> str:
        node = self
        while node.flat is None:
            if at < node.left.size:
                node = node.left
            else:
                at, node = at - node.left.size, node.right
        return node.flat[at]

    def __lt__(self, other: "Rope") -> bool:
        if self.flat is not None and other.flat is not None:
            return self.flat < other.flat
        low, high = 0, min(self.size, other.size)            # of the longest common beginning
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix_hash(middle) == other.prefix_hash(middle):
                low = middle
            else:
                high = middle - 1
        if low == min(self.size, other.size):
            return self.size < other.size
        return self.char(low) < other.char(low)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.flat is not None:
                out.append(node.flat)
            else:
                stack += [node.right, node.left]
        return "".join(out)


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * Rope.BASE + ord(c) + 1) % Rope.PRIME
    return value


#: 4 x 4 entries, row by row: None or (cost, audit).
Matrix = list


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    if a is None or b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]):
        return b
    return a


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            found = None
            ways = [(x[i * STATES + m], y[m * STATES + k]) for m in range(STATES)]
            ways = [(a[0] + b[0], a[1], b[1]) for a, b in ways if a is not None and b is not None]
            if ways:
                least = min(w[0] for w in ways)
                for cost, a, b in ways:
                    if cost == least:
                        found = better(found, (cost, a + b))
            out[i * STATES + k] = found
    return out


@lru_cache(None)
def insertions(state: int) -> list[tuple[int, int]]:
    """(state, rows put in) that insertions alone reach; no state twice, as that only costs."""
    out, n = [(state, 0)], 0
    while True:
        state, n = NEXT[state, WANTED[state]], n + 1
        if state in [s for s, _ in out]:
            return out
        out.append((state, n))


@lru_cache(None)
def symbol_matrix(symbol: int) -> Matrix:
    """Insertions, and then what is done with the row."""
    initial, fault = (INITIALS + "?")[symbol // 4], symbol % 4
    out: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        for j, n in insertions(i):
            ways = [(DELETE, "D", j)]
            if fault in (NO_FAULT, CUT):
                extra = TRUNCATED if fault == CUT else 0
                if (j, initial) in NEXT:
                    ways.append((extra, "K", NEXT[j, initial]))
                ways.append((REROLE + extra, "R", NEXT[j, WANTED[j]]))
            for cost, edit, k in ways:
                out[i * STATES + k] = better(out[i * STATES + k], (n * INSERT + cost, Rope("I" * n + edit)))
    return out


def ended(x: Matrix) -> tuple[int, str]:
    """The cheapest way from nothing to a legal end, with insertions after the last row."""
    found = None
    for j in range(STATES):
        if x[j] is not None:
            for k, n in insertions(j):
                if k in LEGAL:
                    found = better(found, (x[j][0] + n * INSERT, x[j][1] + Rope("I" * n)))
    return found[0], str(found[1])


UNIT: Matrix = [(0, Rope("")) if i == k else None for i in range(STATES) for k in range(STATES)]


# -- the grammar ---------------------------------------------------------------------------------

@dataclass
class Grammar:
    """Rules: symbol SYMBOLS + i stands for the pair rules[i]. Later rules may use earlier ones; rounds tells where a round begins."""

    rules: list[tuple[int, int]]
    rounds: list[int]

    def __post_init__(self):
        self.matrices: dict[int, Matrix] = {}

    def matrix(self, symbol: int) -> Matrix:
        """Of a symbol, from the bottom up; made once."""
        if symbol < SYMBOLS:
            return symbol_matrix(symbol)
        found = self.matrices.get(symbol)
        if found is None:
            left, right = self.rules[symbol - SYMBOLS]
            found = self.matrices[symbol] = product(self.matrix(left), self.matrix(right))
        return found

    def compress(self, sequence: list[int]) -> list[int]:
        for a, b in zip(self.rounds, [*self.rounds[1:], len(self.rules)]):
            names = {pair: SYMBOLS + i for i, pair in enumerate(self.rules[a:b], a)}
            sequence = replaced(sequence, names)
        return sequence

    def evaluate(self, sequence: list[int]) -> Matrix:
        """The matrix of a compressed sequence."""
        out = UNIT
        for symbol in sequence:
            out = product(out, self.matrix(symbol))
        return out


def replaced(sequence: list[int], names: dict[tuple[int, int], int]) -> list[int]:
    """Pairs with a name, from the left, by their names."""
    out, i, last = [], 0, len(sequence) - 1
    while i <= last:
        name = names.get((sequence[i], sequence[i + 1])) if i < last else None
        out.append(sequence[i] if name is None else name)
        i += 1 if name is None else 2
    return out


def pair_counts(sequence: list[int], counts: Counter) -> None:
    """Add the pairs of neighbours; of a run of one symbol, every other pair."""
    run = 0
    for a, b in zip(sequence, sequence[1:]):
        run = run + 1 if a == b else 0
        if run % 2 or not run:
            counts[a, b] += 1


def chosen(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of pairs with counts, frequent ones first, those that can be replaced in one round: none begins as another ends."""
    firsts, lasts, out = set(), set(), []
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in lasts and b not in firsts:
            firsts.add(a)
            lasts.add(b)
            out.append((a, b))
    return out


def learn(sequences: DataFrame) -> Grammar:
    """Re-Pair over distinct sequences (a column of symbols, a byte each). A round is a job; the driver sees PAIRS rows of it."""
    packed = staged(sequences.select(F.col("sequence").alias("_s")))
    grammar = Grammar([], [])
    for _ in range(ROUNDS):
        first = (grammar.rounds or [0])[-1]
        names, begun = {pair: SYMBOLS + i for i, pair in enumerate(grammar.rules[first:], first)}, not grammar.rules

        def rewrite(batch: pa.RecordBatch, names=names, begun=begun):
            found = [list(raw) if begun else replaced(np.frombuffer(raw, np.int32).tolist(), names) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(f, np.int32).tobytes() for f in found], pa.binary())], names=["_s"])

        def count(batch: pa.RecordBatch):
            counts: Counter = Counter()
            for raw in batch.column(0).to_pylist():
                pair_counts(np.frombuffer(raw, np.int32).tolist(), counts)
            rows = [(a, b, n) for (a, b), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "n"])

        packed = staged(over_batches(packed, rewrite, "_s binary"))
        rows = (over_batches(packed, count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
                .where("n > 1").orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect())
        found = chosen([(r["a"], r["b"], r["n"]) for r in rows])
        if not found:
            break
        grammar.rounds.append(len(grammar.rules))
        grammar.rules += found
    return grammar


# -- rows, faults and sequences --------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text): rows after damage. conv: the id as text, a space for null."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    plain = rows.select(conv.alias("conv"), "conv_id", "turn", kind.alias("_kind"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return (plain.where("_kind <> 0").select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), "_kind")
            .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_kind"))


def symbol_of(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (place * 4 + fault).cast("int")


def sequences_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, block, sequence) in the order of (part, block), and (conv, gaps).

    Equal rows are counted first, so a row repeated very often is one row with a number.
    """
    turns = staged(rows.where("_copy = 0").groupBy("conv", "turn").agg(F.count("*").alias("n")))
    gaps = turns.where("turn is not null").groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # rows of one turn are ordered by their texts, too; others need not carry them
    ties = staged(turns.where("n > 1").select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn")))
    same = (F.col("conv") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NO_FAULT)
    kinds = (rows.join(checked_broadcast(ties), same, "left")
             .select("conv", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), fault.alias("fault"),
                     F.when(F.col("_conv").isNotNull(), F.col("text")).alias("tie"))
             .groupBy("conv", "turn", "role", "digest", "fault", "tie").agg(F.count("*").alias("n")))
    kinds = staged(kinds)
    first = (kinds.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first")))
    met = kinds.join(first, (F.col("conv") == F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    opens = F.col("turn").eqNullSafe(F.col("_first.turn"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    ordered = (met.select("conv", "turn", "role", "tie", "digest", F.when(opens, symbol_of(F.col("role"), F.col("fault"))).alias("opening"),
                          symbol_of(F.col("role"), again).alias("symbol"), (F.col("n") - opens.cast("int")).alias("times"))
               .repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.asc_nulls_first("tie"), "digest")
               .sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", F.asc_nulls_first("tie"), "digest")
               .select("conv", F.spark_partition_id().alias("part"), "opening", "symbol", "times"))

    def cut(batches):
        conv, block, held, part = None, 0, bytearray(), 0
        out: list[tuple] = []

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()),
                                               pa.array([o[3] for o in out], pa.binary())], names=["conv", "part", "block", "sequence"])
            out.clear()
            return made

        for batch in batches:
            for name, part, opening, symbol, times in zip(*(c.to_pylist() for c in batch.columns)):
                if name != conv:
                    if held:
                        out.append((conv, part, block, bytes(held)))
                    conv, block, held = name, 0, bytearray()
                if opening is not None:
                    held.append(opening)
                while times or len(held) >= BLOCK:
                    take = min(times, BLOCK - len(held)) if len(held) < BLOCK else 0
                    held += bytes([symbol]) * take
                    times -= take
                    if len(held) >= BLOCK:
                        out.append((conv, part, block, bytes(held)))
                        block, held = block + 1, bytearray()
                        if len(out) >= 1024:
                            yield batch_of()
            if out:
                yield batch_of()
        if held:
            out.append((conv, part, block, bytes(held)))
        if out:
            yield batch_of()

    return staged(ordered.mapInArrow(cut, "conv string, part int, block long, sequence binary")), gaps


LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def counts_of(sequence: bytes) -> tuple[int, int, int, int]:
    faults = Counter(s & 3 for s in sequence)
    illegal = sum((a >> 2, b >> 2) not in LEGAL_PAIRS for a, b in zip(sequence, sequence[1:]))
    return faults[BLANK], faults[DUPLICATE], faults[CUT], illegal


_GRAMMARS: dict[str, Grammar] = {}


def evaluated(distinct: DataFrame, grammar: Grammar) -> DataFrame:
    """(sequence, counts, cost, audit) of distinct sequences; with `whole` false also the matrix, as costs and audits."""
    shared = distinct.sparkSession.sparkContext.broadcast((grammar.rules, grammar.rounds))
    name = str(hash((tuple(grammar.rules), tuple(grammar.rounds))))

    def work(batch: pa.RecordBatch):
        if name not in _GRAMMARS:
            _GRAMMARS.clear()
            _GRAMMARS[name] = Grammar(*shared.value)
        own = _GRAMMARS[name]
        sequences, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        counts, cost, audit, costs, audits = [], [], [], [], []
        for raw, alone in zip(sequences, whole):
            matrix = own.evaluate(own.compress(list(raw)))
            counts.append(counts_of(raw))
            least = ended(matrix) if alone else (None, None)
            cost.append(least[0])
            audit.append(least[1])
            costs.append(None if alone else [-1 if e is None else e[0] for e in matrix])
            audits.append(None if alone else ["" if e is None else str(e[1]) for e in matrix])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
             pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
            names=["sequence", "whole", *COUNTS, "cost", "audit", "costs", "audits"])

    return over_batches(distinct.select("sequence", "whole"), work, "sequence binary, whole boolean, blank long, duplicate long, truncated long, "
                        "illegal long, cost long, audit string, costs array<long>, audits array<string>")


def multiplied(blocks: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit) of conversations of several blocks. blocks: (conv, place, first, last, counts, costs, audits)."""
    schema = "conv string, place long, first int, last int, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"

    def group(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("place")
        matrix, numbers, last = UNIT, np.zeros(4, np.int64), None
        for row in found.itertuples():
            matrix = product(matrix, [None if c < 0 else (int(c), Rope(a)) for c, a in zip(row.costs, row.audits)])
            numbers += np.array([getattr(row, c) for c in COUNTS])
            numbers[3] += last is not None and (last >> 2, row.first >> 2) not in LEGAL_PAIRS
            last = row.last
        return pd.DataFrame([{"conv": found["conv"].iloc[0], "place": int(found["place"].iloc[0]) // FAN, "first": int(found["first"].iloc[0]), "last": int(last),
                              **dict(zip(COUNTS, map(int, numbers))), "costs": [-1 if e is None else e[0] for e in matrix],
                              "audits": ["" if e is None else str(e[1]) for e in matrix]}])

    while True:
        many = blocks.agg(F.max("place").alias("most")).first()["most"]
        if not many:
            break
        blocks = staged(blocks.groupBy("conv", F.floor(F.col("place") / FAN).alias("_group")).applyInPandas(group, schema))

    def close(batch: pa.RecordBatch):
        ends = [ended([None if c < 0 else (c, Rope(a)) for c, a in zip(cs, texts)]) for cs, texts in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.string())],
                                         names=["conv", *COUNTS, "cost", "audit"])

    return over_batches(blocks.select("conv", *COUNTS, "costs", "audits"), close,
                        "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, counts, cost, audit) of every conversation that has rows. rows: as damaged() gives them."""
    blocks, gaps = sequences_of(rows)
    of_conv = blocks.groupBy("conv").agg((F.count("*") == 1).alias("whole"))
    marked = staged(blocks.join(of_conv, "conv"))
    distinct = staged(marked.select("sequence", "whole").distinct())
    known = staged(evaluated(distinct, learn(distinct.select("sequence").distinct())))
    alone = marked.where("whole").join(known.where("whole").drop("whole", "costs", "audits"), "sequence").select("conv", *COUNTS, "cost", "audit")
    place = F.row_number().over(Window.partitionBy("conv").orderBy("part", "block")) - 1
    ends = [F.conv(F.hex(F.substring("sequence", at, 1)), 16, 10).cast("int").alias(n) for n, at in (("first", 1), ("last", -1))]
    parts = marked.where("not whole").select("conv", place.cast("long").alias("place"), *ends, "sequence")
    long = staged(parts.join(known.where("not whole").drop("whole", "cost", "audit"), "sequence")
                  .select("conv", "place", "first", "last", *COUNTS, "costs", "audits"))
    return alone.unionByName(multiplied(long)).join(gaps, "conv", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


# -- repaired conversations ------------------------------------------------------------------------

def repaired(rows: DataFrame, plans: DataFrame, of_line, schema: str, names: list[str]) -> DataFrame:
    """What of_line makes of each conversation's plan and its repaired lines, which it is given as a stream.

    plans: one row per conversation with `conv`, `audit` and the columns `names`; rows: as damaged() gives them.
    of_line: called without arguments, gives an object with `add(line)` and `row(plan)`.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    heads = plans.select("conv", F.lit(0).alias("_kind"), *none, F.struct("audit", *names).alias("plan"))
    tails = rows.select("conv", F.lit(1).alias("_kind"), "turn", "role", "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    stream = (heads.unionByName(tails).repartition("conv").sortWithinPartitions("conv", "_kind", F.asc_nulls_first("turn"), "role", "text")
              .select("role", "text", "plan"))
    order = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        plan, made, at, state, out = None, None, 0, 0, []

        def put_in():
            nonlocal at, state
            while at < len(plan["audit"]) and plan["audit"][at] == "I":
                made.add(f"{NAMES[WANTED[state]]}:")
                state, at = NEXT[state, WANTED[state]], at + 1

        for batch in batches:
            for role, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                if head is not None:
                    if plan is not None:
                        put_in()
                        out.append(made.row(plan))
                    plan, made, at, state = head, of_line(), 0, 0
                    continue
                put_in()
                edit, at = plan["audit"][at], at + 1
                if edit != "D":
                    initial = role[:1] if edit == "K" else WANTED[state]
                    state = NEXT[state, initial]
                    made.add(f"{role if edit == 'K' else NAMES[initial]}:{text}")
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(order, o)) for o in out], arrow)
                out = []
        if plan is not None:
            put_in()
            out.append(made.row(plan))
            yield pa.RecordBatch.from_pylist([dict(zip(order, o)) for o in out], arrow)

    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(",")])
    return stream.mapInArrow(run, schema)


class Digest:
    """SHA-256 of lines, as they come."""

    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.hash.update(("\n" + line if self.begun else line).encode())
        self.begun = True

    def row(self, plan: dict) -> tuple:
        return (*(plan[c] for c in ("conv_id", "gaps", *COUNTS, "cost", "audit")), self.hash.hexdigest())


class Lines(Digest):
    """The lines themselves, for a conversation that may be held."""

    def __init__(self):
        self.lines: list[str] = []

    def add(self, line: str) -> None:
        self.lines.append(line)

    def row(self, plan: dict) -> tuple:
        return plan["conv_id"], plan["cost"], plan["audit"], "\n".join(self.lines)


def plans_of(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, conv_id, gaps, counts, cost, audit) of every conversation, without rows too."""
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = every.join(edits(rows), "conv", "left")
    return staged(found.select("conv", "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")),
                               F.coalesce("audit", F.lit("")).alias("audit")))


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, cost, audit, repaired): the repaired text of every conversation, one line a row."""
    rows = damaged(conversations) if rows is None else rows
    return repaired(rows, plans_of(conversations, rows), Lines, "conv_id long, cost long, audit string, repaired string", ["conv_id", "cost"])


def repair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, edits and digests of the damaged conversations."""
    conversations = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    return repaired(rows, plans_of(conversations, rows), Digest, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                    "audit string, repaired_sha256 string", ["conv_id", "gaps", *COUNTS, "cost"])
