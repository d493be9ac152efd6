import random
from collections import Counter

import numpy as np
import pytest

from glossmeter.llm import signature_tree as S
from glossmeter.llm.common import components


def components_of(names, links):
    up = {n: n for n in names}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


@pytest.fixture(scope="module")
def token_sets():
    """Sets of many sizes with partners at and around the threshold."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    found = {}
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 9, 12, 15, 25, 40, 80, 200, 400]))]
        for k in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25)) if k else 0):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(vocab)]])
            tokens = S.shingle_set(" ".join(copy).encode())
            if len(tokens):
                found[S.set_id(tokens)] = tokens
    return found


def all_links(sets, percent=90):
    names = list(sets)
    return [(a, b) for i, a in enumerate(names) for b in names[:i] if S.linked(sets[a], sets[b], percent)]


def packed(sid, tokens, percent):
    keys, may = S.part_keys(tokens, percent)
    return sid, bytearray(keys.tobytes() + may.astype(np.int32).tobytes())


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_telling_part(spark, token_sets, percent):
    """Among unrelated sets with a formula in common, too: it brings no link to nothing, and nothing together."""
    rng, token_sets = random.Random(3), dict(token_sets)
    formula = " ".join(f"f{i}" for i in range(14))
    for _ in range(300):
        words = " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.choice([40, 90, 150])))
        for text in (f"{words} {formula}", f"{words} x{rng.random()} {formula}"):
            tokens = S.shingle_set(text.encode())
            token_sets[S.set_id(tokens)] = tokens
    rows = [packed(n, t, percent) for n, t in token_sets.items()]
    keys = {}
    for r in S.telling_keys(spark.createDataFrame(rows + rows[:50], "sid long, keys binary")).collect():
        keys.setdefault(r["sid"], set()).add(r["key"])
    links = all_links(token_sets, percent)
    assert len(links) > 300
    assert all(keys[a] & keys[b] for a, b in links)
    if percent == 80:
        largest = Counter(components_of(list(token_sets), [(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]]).values()).most_common(1)
        assert largest[0][1] < 60


def test_counting_keys_in_batches(spark):
    """Keys of many more sets than are held, over many batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        def row(sid, *keys):
            return sid, bytearray(np.array([k << 8 for k in keys], np.uint64).tobytes() + np.full(len(keys), 1, np.int32).tobytes())
        rows = [row(s, 1, 2 + s % 2000, 10 ** 6 + s) for s in range(9000)] + [row(5, 1, 7)]
        got = sorted((r["key"] >> 8, r["sid"]) for r in S.telling_keys(spark.createDataFrame(rows, "sid long, keys binary")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((2 + s % 2000, s) for s in range(9000))     # of each, the most common key is passed over


def test_traversal_loses_no_link(token_sets):
    names = list(token_sets)
    truth = components_of(names, all_links(token_sets))
    assert components_of(names, S.block_links(token_sets, None)) == truth
    left, right = ({n: token_sets[n] for n in names[k::2]} for k in (0, 1))
    assert components_of(names, S.block_links(left, right) + S.block_links(left, None) + S.block_links(right, None)) == truth


def test_join_against_brute_force(spark, corpus, odd, nothing):
    docs = corpus.unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    sets = {i: S.shingle_set((r["text"] or "").encode()) for i, r in enumerate(rows)}
    full = {i: t for i, t in sets.items() if len(t)}
    group = components_of(list(full), [(i, j) for i in full for j in full if i < j and S.linked(full[i], full[j])])
    least = {}
    for i, g in group.items():
        if rows[i]["doc_id"] is not None:
            least[g] = min(least.get(g, 1 << 60), rows[i]["doc_id"])
    want = sorted(((r["doc_id"], len(sets[i]), least.get(group[i]) if i in group else r["doc_id"]) for i, r in enumerate(rows)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.jaccard_components(docs).collect()), key=str)
    assert got == want
    assert S.jaccard_components(nothing).count() == 0


def test_one_of_each_group_stays(spark, corpus, odd):
    docs = odd.unionByName(corpus.selectExpr("doc_id + 1000 as doc_id", "text"), allowMissingColumns=True)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # 1000 and 1001 are copies of 5 and 7; 1101 and the 111x of 1100; the row without an id stays
    assert sorted(ids, key=str) == sorted([1, 2, 3, 5, 6, 7, 8, None, *range(1002, 1025), 1100, 1200, 1201, 1202], key=str)


def test_blocks_of_a_large_tree(spark, monkeypatch):
    """A tree over several blocks, whose members are linked in a chain and not with its smallest."""
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = np.random.default_rng(1)
    tokens, base = {}, np.unique(rng.integers(0, 2 ** 63, 400).astype(np.uint64))
    for k in range(60):
        base = base.copy()
        base[rng.integers(0, len(base), 14)] = rng.integers(0, 2 ** 63, 14).astype(np.uint64)
        tokens[int(S.set_id(np.unique(base)))] = np.unique(base)
    tree = min(tokens)
    members = spark.createDataFrame([(s, bytearray(t.tobytes()), tree) for s, t in tokens.items()], "sid long, tokens binary, tree long")
    close = S.leader_links(members, 90)
    links = [(r[0], r[1]) for r in close.collect()] + [(r["a"], r["b"]) for r in S.other_links(members, close, 90).collect()]
    assert components_of(list(tokens), links) == components_of(list(tokens), all_links(tokens))
    assert len(links) < 8 * len(tokens)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of(nodes, [e for e in edges if e[0] != e[1]])


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (None, c + " end"), (None, b)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("1", "a"), ("5", "b"), ("None", "b"), ("None", "c")]
