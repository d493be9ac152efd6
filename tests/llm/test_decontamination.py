import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmeter.llm import decontamination as D


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(600)]
    items = {k: [rng.choice(vocab) for _ in range(rng.choice([15, 30, 45]))] for k in range(12)}
    items[12] = ["too", "short"]
    items[13] = list(items[0])
    docs = {}
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if i % 3:
            leak = list(items[i % 12])
            for _ in range(i % 3 - 1):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = leak if i % 5 else leak[:len(leak) // 2]
        docs[i] = " ".join(words)
    docs[70] = " ".join(items[1][:-1])                        # shorter than the item
    return docs, {k: " ".join(v) for k, v in items.items()}


def shingles(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def weigh(counter):
    return sum(sum(map(len, k)) * n for k, n in counter.items())


def brute(docs, items):
    found = {}
    for d, text in docs.items():
        words = text.lower().split()
        for i, item in items.items():
            known = shingles(item.lower().split())
            n = len(item.split())
            best = max(((lambda w: weigh(w & known) / max(1, weigh(w | known)))(shingles(words[s:s + n])) for s in range(max(1, len(words) - n + 1))))
            if best >= 0.8:
                found[d, i] = best
    return found


def test_windows_against_brute_force(spark, leaks):
    docs, items = leaks
    got = D.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                         spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == pytest.approx(want)
    assert len(want) > 15 and all(r["distance"] <= D.RADIUS for r in got)


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, D.RADIUS)):
            b ^= 1 << bit
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    pairs = spark.createDataFrame(rows, "i long, a long, b long").select("i", D.blocks(F.col("a")).alias("x"), D.blocks(F.col("b")).alias("y"))
    assert pairs.where(F.size(F.array_intersect("x", "y")) == 0).count() == 0


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    hashes, weights = rng.integers(-2 ** 63, 2 ** 63, 40), rng.integers(1, 60, 40)
    rows = spark.createDataFrame([(0, int(h), int(w)) for h, w in zip(hashes, weights)], "k int, hash long, weight long")
    bits = (hashes.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = sum(1 << k for k in range(64) if 2 * int((bits[:, k].astype(int) * weights).sum()) > int(weights.sum()))
    assert D.fingerprints(rows, ["k"]).first()["print"] % (1 << 64) == want


def test_odd_rows(spark, odd, nothing, prose):
    items = spark.createDataFrame([(1, prose["base"]), (2, None), (None, prose["base"]), (3, ""), (1, prose["base"])], "item_id long, text string")
    rows = D.contaminated(odd, items).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in rows] == [(None, 1, 0, 1.0)]
    kept = D.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert D.keep_clean(nothing, items).count() == 0 and D.contaminated(odd, items.limit(0)).count() == 0
