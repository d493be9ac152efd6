"""Jaccard join of shingle sets by signature trees.

Documents are reduced to their sets of three-word shingles; equal sets are one. The trees' upper levels
are found without comparing anything: sets of similar size are cut into parts of the token space, by a
number of spare parts more than linked sets can differ in tokens. So linked sets agree in more than the spare
parts (pigeonhole), and each set may pass over as many of its parts as are spare: the ones that most sets
have, so that a formula in many texts brings nothing together. The least common part in which two linked sets
agree is passed over by neither. Sets that agree in a part that is left belong to one tree; no link can run
between trees. Inside a tree, nodes hold the OR of their members' token bitmaps and the range of their
sizes, and a dual traversal prunes pairs of nodes by the largest overlap that these allow, and pairs that
are connected already. What is left is compared exactly.

A tree may hold a third of all documents. So each member is first compared with the tree's smallest one;
members linked to it are connected and need no comparison among themselves. The others, and what they
are compared with, are cut into blocks by size and hash, and pairs of blocks are traversed as tasks of
their own. What a task emits is a spanning forest of its links, at most one a member.

Defined results: a text without words has an empty set, is linked with nothing and is its own component;
fewer than three words are one shingle; a component is named by its smallest id, ids that are null are
left out of that, and a null id gets its component's name; repeated rows are one set; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.llm.common import as_bytes, checked_broadcast, components, documents, free_name, mix, over_batches, shingle_hashes, text_steps, word_hashes
from glossmeter.stage import scratch, staged

WIDTH = 3
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Parts beyond those that linked sets need to agree in one: so many, and this share of the tokens they may differ in.
SPARE, SPARE_SHARE = 4, 4
#: Members of a block, of a node, and the children of an inner node; bits of a bitmap.
BLOCK, LEAF, FAN, BITS = 512, 16, 4, 2048
#: Bytes of tokens of a block, and of the small trees that one piece of work takes.
BLOCK_BYTES, WORK_BYTES = 8 << 20, 8 << 20
#: From so many sets on, keys count as equally common; and the place of empty parts, which are passed over first.
COMMON, EMPTY = 4096, 1 << 20
#: Sets whose keys are handed on at once.
STEP_SETS = 2048


# -- sets and the parts they are cut into --------------------------------------------------------

def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a whole text's shingles, ascending."""
    return np.unique(shingle_hashes(word_hashes((text or b"").lower().split()), width))


def set_id(tokens: np.ndarray) -> int | None:
    """A name for a set: 63 bits of a hash of all its tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1 if len(tokens) else None


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, largest size) of the classes in which a set of n tokens may meet an equal or larger partner."""
    found, c, low, most = [], 0, 1, n * 100 // percent
    while low <= most:
        next_low = max(low + 1, math.ceil(low * 1.3))
        if next_low > n:
            found.append((c, next_low - 1))
        c, low = c + 1, next_low
    return found


def part_keys(tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of a set, a size class in the lowest byte of each; and for each key how many of its class may be passed over.

    Linked, unequal sets share more keys of a class than either may pass over. A part without tokens is no key and
    uses up one that may be passed over; where there are more such parts than spare ones, they are keys like
    others, marked by a negative number, and only they may be passed over.
    """
    out, may, high, mixed = [], [], tokens >> np.uint64(32), mix(tokens)
    for c, most in size_classes(len(tokens), percent):
        # linked sets of at most `most` tokens differ in at most this many
        apart = 2 * most * (100 - percent) // (100 + percent)
        if apart == 0:
            continue
        spare = SPARE + apart // SPARE_SHARE
        k = apart + 1 + spare
        part = (high * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(part, prepend=~part[:1]))
        sums, name = np.add.reduceat(mixed, starts), part[starts]
        empty = k - len(starts)
        drop = np.full(len(starts), spare - empty)
        if empty > spare:
            filled, drop = np.zeros(k, np.uint64), np.full(k, -spare)
            filled[name], drop[name] = sums, 0
            sums, name = filled, np.arange(k, dtype=np.uint64)
        out.append(mix(sums + mix(name + np.uint64(c << 32))) & ~np.uint64(255) | np.uint64(c))
        may.append(drop)
    return (np.concatenate(out), np.concatenate(may)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sets(docs: DataFrame, width: int, percent: int, *keep: str) -> DataFrame:
    """(doc_id, kept columns, sid, n_shingles, keys): keys packed, with their numbers, once for each set that a batch meets. Kept: longs."""
    named = ["doc_id", *keep]

    def packed(tokens: np.ndarray) -> bytes:
        keys, may = part_keys(tokens, percent)
        return keys.tobytes() + may.astype(np.int32).tobytes()

    def work(batch: pa.RecordBatch):
        seen = set()
        for a, b, texts in text_steps(batch.column(len(named))):
            sids, sizes, keys = [], [], []
            for text in texts:
                tokens = shingle_set(text, width)
                sid = set_id(tokens)
                sids.append(sid)
                sizes.append(len(tokens))
                keys.append(packed(tokens) if sid is not None and sid not in seen else None)
                seen.add(sid)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(named))), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.binary())], names=[*named, "sid", "n_shingles", "keys"])

    return over_batches(as_bytes(docs, *named), work, f"{' long, '.join(named)} long, sid long, n_shingles long, keys binary")


def telling_keys(found: DataFrame) -> DataFrame:
    """(key, sid): keys that several sets share, without those that each set may pass over.

    How common a key is, is counted while the rows stream past in order of their keys, up to COMMON. Keys
    whose sets are all equal go at once, and they are nearly all.
    """
    def rows_of(batch: pa.RecordBatch):
        packed = [(s, np.frombuffer(k, np.uint64, len(k) // 12), np.frombuffer(k, np.int32, -1, len(k) // 12 * 8))
                  for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if k]
        for a in range(0, len(packed), STEP_SETS):
            part = packed[a:a + STEP_SETS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([k for _, k, _ in part]).view(np.int64)), pa.array(np.repeat(np.array([s for s, *_ in part], np.int64), [len(k) for _, k, _ in part])),
                 pa.array(np.concatenate([m for *_, m in part]))], names=["key", "sid", "may"])

    def counted(batches):
        held: list[np.ndarray] = []                    # rows of the last key, until it is known how many there are
        size, flushed = 0, False

        def out_of(key, sid, may, common):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid), pa.array(may.astype(np.int32)),
                                               pa.array(np.where(may < 0, EMPTY, common).astype(np.int32))], names=["key", "sid", "may", "common"])

        def close():
            rows = np.concatenate(held, 1)
            return out_of(*rows, np.full(rows.shape[1], min(size, COMMON)))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            new = np.ones(rows.shape[1], bool)
            new[1:] = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
            if held:
                new[0] = (rows[:2, 0] != held[-1][:2, -1]).any()
            rows = rows[:, new]
            if not rows.shape[1]:
                continue
            edge = np.flatnonzero(np.diff(rows[0])) + 1
            start = 0
            if held and rows[0, 0] == held[-1][0, -1]:     # the last key goes on
                start = int(edge[0]) if len(edge) else rows.shape[1]
                size += start
                if size >= COMMON:                         # common enough: its rows need not be held
                    if not flushed:
                        yield close()
                    yield out_of(*rows[:, :start], np.full(start, COMMON))
                    held, flushed = [rows[:, start - 1:start]], True
                else:
                    held.append(rows[:, :start])
            if start == rows.shape[1]:
                continue
            if held and size > 1 and not flushed:
                yield close()
            # keys that begin and end here, and the one that may go on
            last = int(edge[-1]) if len(edge) else 0
            last = max(last, start)
            inner = rows[:, start:last]
            if inner.shape[1]:
                begins = np.flatnonzero(np.diff(inner[0], prepend=~inner[0, :1]))
                times = np.diff(np.append(begins, inner.shape[1]))
                times = np.repeat(times, times)
                yield out_of(*inner[:, times > 1], np.minimum(times[times > 1], COMMON))
            held, size, flushed = [rows[:, last:]], rows.shape[1] - last, False
            if size >= COMMON:
                yield close()
                held, flushed = [rows[:, -1:]], True
        if held and size > 1 and not flushed:
            yield close()

    rows = over_batches(found.where("keys is not null").select("sid", "keys"), rows_of, "key long, sid long, may int")
    shared = rows.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(counted, "key long, sid long, may int, common int")
    # of each set and class, without the most common keys
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("common"), "key")))
    drop = F.when(F.min("may") < 0, F.least(-F.min("may"), F.count_if(F.col("may") < 0).cast("int"))).otherwise(F.max("may")).alias("drop")
    return (shared.groupBy("sid", F.col("key").bitwiseAND(255).alias("class")).agg(ranked.alias("ranked"), drop)
            .select("sid", F.explode(F.slice("ranked", F.col("drop") + 1, F.greatest(F.size("ranked") - F.col("drop"), F.lit(0)))).alias("r"))
            .select(F.col("r.key").alias("key"), "sid"))


def connected(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets with a key in common. rows: (key, sid), each once."""
    def connect(batches):
        last, center = None, None
        for batch in batches:
            key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.diff(key, prepend=~key[:1]) != 0
            if last is not None and key[0] == last:
                new[0] = False
            head = np.concatenate([[center if center is not None else -1], sid[new]])[np.cumsum(new)]
            edge = np.unique(np.stack([head, sid], 1)[~new], axis=0)
            last, center = key[-1], head[-1]
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(connect, "a long, b long")


def shared_keys(found: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets with a key in common; (a, a) for a set met again.

    found: (sid, key). Sets that share a key inside a batch are connected there, and one of them
    goes on, so that a key of very many sets is a few rows; these are sorted by key and connected as
    they stream past.
    """
    def keyed(batch: pa.RecordBatch):
        sid, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.argsort(key, kind="stable")
        key, sid = key[order], sid[order]
        new = np.diff(key, prepend=~key[:1]) != 0
        head = sid[new][np.cumsum(new) - 1]
        edge = np.unique(np.stack([head, sid], 1)[~new], axis=0) if not new.all() else np.zeros((0, 2), np.int64)
        where = np.concatenate([key[new], mix(edge[:, 1].astype(np.uint64)).view(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.concatenate([head[new], edge[:, 0]])),
                                          pa.array(np.concatenate([np.full(new.sum(), -1), edge[:, 1]]))], names=["key", "a", "b"])

    def connect(batches):
        last, center = None, None
        for batch in batches:
            key, a, b = (batch.column(i).to_numpy() for i in range(3))
            plain = b < 0
            key, sid = key[plain], a[plain]
            edges = [np.stack([a[~plain], b[~plain]], 1)]
            if len(key):
                new = np.diff(key, prepend=~key[:1]) != 0
                if last is not None and key[0] == last:
                    new[0] = False
                centers = np.concatenate([[center if center is not None else -1], sid[new]])
                head = centers[np.cumsum(new)]
                edges.append(np.stack([head, sid], 1)[~new])
                last, center = key[-1], head[-1]
            edge = np.concatenate(edges)
            edge = np.unique(edge, axis=0) if len(edge) > 1 else edge
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], names=["a", "b"])

    rows = over_batches(found.where("key is not null").select("sid", "key"), keyed, "key long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(connect, "a long, b long")


# -- trees ---------------------------------------------------------------------------------------

class Tree:
    """Nodes over a few sets, from the leaves up: OR of bitmaps, size range, and tokens that bits hide."""

    def __init__(self, members: list[np.ndarray]):
        self.order = sorted(range(len(members)), key=lambda i: int(members[i][0]))     # alike sets begin alike
        self.sets = [members[i] for i in self.order]
        rows = np.zeros((len(members), BITS // 8), np.uint8)
        size = np.array([len(m) for m in self.sets])
        for i, m in enumerate(self.sets):
            bits = np.zeros(BITS, bool)
            bits[m >> np.uint64(64 - BITS.bit_length() + 1)] = True
            rows[i] = np.packbits(bits)
        self.bits, self.size = rows.view(np.uint64), size
        self.hidden = size - np.bitwise_count(self.bits).sum(1)
        bounds = [(i, min(i + LEAF, len(members))) for i in range(0, len(members), LEAF)]
        self.nodes, level = [], []                             # (first, stop, children, bits, least, most, hidden)
        for a, b in bounds:
            level.append(self._node(a, b, ()))
        while len(level) > 1:
            level = [self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], tuple(g))
                     for g in (level[i:i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]

    def _node(self, a: int, b: int, children: tuple[int, ...]) -> int:
        self.nodes.append((a, b, children, np.bitwise_or.reduce(self.bits[a:b]), self.size[a:b].min(), self.size[a:b].max(),
                           self.hidden[a:b].max()))
        return len(self.nodes) - 1


class Forest:
    """Connected members, by union and find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def may_link(bits_a, least_a, most_a, hidden_a, bits_b, least_b, most_b, hidden_b, percent: int) -> bool:
    """Whether sizes and the largest overlap that the bitmaps allow leave room for a link."""
    if 100 * most_a < percent * least_b or 100 * most_b < percent * least_a:
        return False
    most = int(np.bitwise_count(bits_a & bits_b).sum()) + min(hidden_a, hidden_b)
    return (100 + percent) * most >= percent * (least_a + least_b)


def traverse(x: Tree, y: Tree, forest: Forest, at_x: int, at_y: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between members of two trees (or of one with itself) that connect what was not connected.

    at_x, at_y: numbers of the trees' first members in the forest; members are in the trees' order.
    """
    links, stack = [], [(x.root, y.root)]
    while stack:
        i, j = stack.pop()
        a, b = x.nodes[i], y.nodes[j]
        if not may_link(*a[3:], *b[3:], percent):
            continue
        if a[2] or b[2]:
            # open the larger node; a node paired with itself opens both
            if x is y and i == j:
                stack += [(p, q) for p in a[2] for q in a[2] if p <= q]
            elif a[2] and (not b[2] or a[1] - a[0] >= b[1] - b[0]):
                stack += [(p, j) for p in a[2]]
            else:
                stack += [(i, q) for q in b[2]]
            continue
        for p in range(a[0], a[1]):
            for q in range(max(b[0], p + 1) if x is y else b[0], b[1]):
                if forest.find(at_x + p) == forest.find(at_y + q):
                    continue
                if may_link(x.bits[p], x.size[p], x.size[p], x.hidden[p], y.bits[q], y.size[q], y.size[q], y.hidden[q], percent) \
                        and linked(x.sets[p], y.sets[q], percent):
                    forest.join(at_x + p, at_y + q)
                    links.append((p, q))
    return links


def block_links(left: dict[int, np.ndarray], right: dict[int, np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (as names of sets) between two blocks, or inside one."""
    names = list(left)
    x = Tree([left[n] for n in names])
    if right is None:
        found = traverse(x, x, Forest(len(names)), 0, 0, percent)
        return [(names[x.order[p]], names[x.order[q]]) for p, q in found]
    others = list(right)
    y = Tree([right[n] for n in others])
    found = traverse(x, y, Forest(len(names) + len(others)), 0, len(names), percent)
    return [(names[x.order[p]], others[y.order[q]]) for p, q in found]


# -- the join ------------------------------------------------------------------------------------

def tokens_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, tokens) of the wanted sets: wanted has sid and the id of one document with that set."""
    ids = staged(wanted.select(F.col("doc_id").alias("_id"), F.col("sid").alias("_sid")))
    rows = docs.select("doc_id", "text").join(checked_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")))

    def work(batch: pa.RecordBatch):
        sids = batch.column(0).to_pylist()
        for a, b, texts in text_steps(batch.column(1)):
            found = [(s, t.tobytes()) for s, t in ((s, shingle_set(text, width)) for s, text in zip(sids[a:b], texts)) if set_id(t) == s]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())],
                                             names=["sid", "tokens"])

    return over_batches(as_bytes(rows, "_sid"), work, "sid long, tokens binary")


def leader_links(members: DataFrame, percent: int) -> DataFrame:
    """Members linked with the smallest set of their tree: (sid, tree)."""
    leaders = members.where("sid = tree").select(F.col("tree"), F.col("tokens").alias("other")).dropDuplicates(["tree"])

    def work(batch: pa.RecordBatch):
        keep = [linked(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent)
                for a, b in zip(batch.column(2), batch.column(3))]
        yield batch.select(["sid", "tree"]).filter(pa.array(keep, pa.bool_()))

    pairs = members.where("sid <> tree").join(leaders, "tree").select("sid", "tree", "tokens", "other")
    return over_batches(pairs, work, "sid long, tree long")


def other_links(members: DataFrame, close: DataFrame, percent: int, compare=block_links, block: int | None = None) -> DataFrame:
    """Links of members that are not linked with their tree's smallest set: (a, b).

    compare: finds the links between two blocks of members, or inside one. block: members of one.
    """
    block = block or BLOCK
    marked = members.select("sid", "tree", F.octet_length("tokens").alias("bytes")).join(
        close.select("sid", F.lit(True).alias("close")), "sid", "left").withColumn("core", (F.col("sid") == F.col("tree")) | F.coalesce("close", F.lit(False)))
    counts = staged(marked.groupBy("tree").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.count_if(~F.col("core")).alias("rest")).where("rest > 0 and n > 2"))
    small = (F.col("n") <= block) & (F.col("all") <= BLOCK_BYTES)
    works = (counts.where(small).agg(F.sum("all").alias("all")).first()["all"] or 0) // WORK_BYTES * 4 + 64
    # blocks: by kind, by size so that only the same and the next one can link, and by hash
    size = F.floor(F.log(F.col("bytes") / 8) / F.lit(math.log(100 / percent))).cast("int")
    inside = marked.join(counts.select("tree", small.alias("small")), "tree").withColumn("size", size)
    per = inside.groupBy("tree", "core", "size").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("cut"))
    placed = staged(inside.join(per, ["tree", "core", "size"]).select(
        "sid", "tree", "core", "size", "small", F.pmod(F.xxhash64("sid"), "cut").cast("int").alias("part")).distinct())
    blocks = staged(placed.select("tree", "core", "size", "part", "small").distinct())
    x, y = blocks.alias("x"), blocks.alias("y")
    order = lambda s: F.struct(f"{s}.core", f"{s}.size", f"{s}.part")
    pairs = x.join(y, (F.col("x.tree") == F.col("y.tree")) & (F.abs(F.col("x.size") - F.col("y.size")) <= 1)
                   & ~(F.col("x.core") & F.col("y.core")) & (order("x") <= order("y")))
    # a small tree is compared in one piece of work with other small trees; a large one pair by pair
    pair = F.xxhash64("x.tree", "x.core", "x.size", "x.part", "y.core", "y.size", "y.part")
    work_at = F.when(F.col("x.small"), F.pmod(F.xxhash64("x.tree"), F.lit(works))).otherwise(pair)
    pairs = staged(pairs.select(F.col("x.tree").alias("tree"), pair.alias("pair"), work_at.alias("work"),
                                F.array(*[F.struct(F.col(f"{s}.core").alias("core"), F.col(f"{s}.size").alias("size"), F.col(f"{s}.part").alias("part"),
                                                   F.lit(s == "y").alias("right")) for s in "xy"]).alias("sides"))
                   .select("tree", "pair", "work", F.explode("sides").alias("s")).select("tree", "pair", "work", "s.*").distinct())
    rows = (members.select("sid", "tokens").join(placed.select("sid", "tree", "core", "size", "part"), "sid")
            .join(pairs, ["tree", "core", "size", "part"]).select("work", "pair", "right", "sid", "tokens"))

    def work(found: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, group in found.groupby("pair"):
            sides = [{}, {}]
            for right, sid, tokens in zip(group["right"], group["sid"], group["tokens"]):
                sides[right][sid] = np.frombuffer(tokens, np.uint64)
            same = sides[0].keys() == sides[1].keys()
            links += compare(sides[0], None if same else sides[1], percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("work").applyInPandas(work, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    found, joined = groups_of(docs.select("doc_id", "text"), width, percent)
    named = (found.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
             .join(joined, "sid", "left").withColumn("_group", F.coalesce("_group", "sid")))
    names = named.groupBy("_group").agg(F.min("least").alias("component_id"))
    by_set = named.join(names, "_group").select("sid", "component_id")
    return (found.select("doc_id", "sid", "n_shingles").join(by_set, "sid", "left")
            .select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def groups_of(docs: DataFrame, width: int, percent: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and (sid, _group) of those that are linked."""
    with scratch(docs.sparkSession):                        # keys and tokens go as soon as the links are known
        wide = staged(sets(docs, width, percent, *keep))
        found = staged(wide.drop("keys"), keep=True)
        trees = staged(components(connected(staged(telling_keys(wide)))))
        chosen = (found.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
                  .join(trees.select(F.col("node").alias("sid")), "sid", "left_semi"))
        members = staged(tokens_of(docs, chosen, width).join(trees.select(F.col("node").alias("sid"), F.col("component").alias("tree")), "sid"))
        close = staged(leader_links(members, percent))
        links = close.select(F.col("sid").alias("a"), F.col("tree").alias("b")).unionByName(other_links(members, close, percent))
        joined = staged(components(links).select(F.col("node").alias("sid"), F.col("component").alias("_group")), keep=True)
    return found, joined


def join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each group of linked documents, the row of the smallest (id, hash of the text). Columns stay, whatever their names.

    Rows without an id are not weighed against those with one; of each group of them, one row stays. Rows that
    repeat an id, or its absence, and the text become one.
    """
    found, joined = groups_of(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), width, percent, "text_hash")
    rows = found.select("doc_id", "text_hash", "sid").join(joined, "sid", "left").withColumn("_group", F.coalesce("_group", "sid"))
    no_id = F.col("doc_id").isNull().alias("_no_id")
    first = rows.where("_group is not null").groupBy("_group", no_id).agg(F.min(F.struct("doc_id", "text_hash")).alias("_first"))
    own, hashed = free_name(docs, "_id"), free_name(docs, "_hash")
    gone = staged(rows.withColumn("_no_id", no_id).join(first, ["_group", "_no_id"])
                  .where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("_first")))
                  .select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(hashed))
    left = docs.join(checked_broadcast(gone), same, "left_anti")
    twice = staged(found.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).agg(F.count("*").alias("n"))
                   .where("n > 1").select(own, hashed))
    once = left.join(checked_broadcast(twice), same, "left_anti")
    several = (left.join(checked_broadcast(twice), same, "left_semi").withColumn(hashed, F.xxhash64("text"))
               .dropDuplicates(["doc_id", hashed]).drop(hashed))
    return once.unionByName(several)


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
class AS (SELECT list_sort(s) AS s, min(doc_id) AS c FROM s GROUP BY 1),
t AS (SELECT c, len(s) AS n, unnest(s) AS t FROM class),
pair AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c < b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
         GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE comp.component_id END AS component_id
FROM s JOIN class ON list_sort(s.s) = class.s JOIN comp ON comp.a = class.c
"""
