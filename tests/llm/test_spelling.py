import random
import re
import zlib
from collections import Counter

import numpy as np

from glossmeter.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_force(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def test_neighbours_are_met_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(6, 8))) for _ in range(400)})
    key, near = {}, {}
    for places, letters, n in S.by_length(words):
        rows = S.reduced(letters, n)
        for i, k in zip(places, S.reduced_keys(rows)):
            key[words[i]] = int(k)
        at, found = S.neighbours(rows)
        for i, k in zip(at, found):
            near.setdefault(words[places[i]], []).append(int(k))
    spelled = {}
    for places, letters, n in S.by_length(words):
        for i, row in zip(places, S.reduced(letters, n).tolist()):
            spelled[words[i]] = tuple(row)
    for a in words:
        for b in words:
            meets = near[a].count(key[b]) + near[b].count(key[a])
            assert meets == one_edit(spelled[a], spelled[b])
            if one_edit(a, b):
                assert meets or key[a] == key[b]
    assert all(len(v) == len(set(v)) for v in near.values())


def test_against_brute_force(spark, odd, nothing):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeéèßÀ") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    common = {s: rng.choice([1, 2, 8, 40]) for s in stems}

    def spell(s):
        if rng.random() < 0.15:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "x", "ab"]) + s[at + 1:]
        return s.upper() if rng.random() < 0.05 else s
    rows = [(i, rng.choice(" .-\n").join(spell(s) for s in rng.choices(stems, [common[s] for s in stems], k=60))) for i in range(160)]
    rows += [(None, " ".join(stems)), (None, " ".join(stems)), (900, None), (901, ""), (902, "short x" * 9)]
    # a chain of forms, each five times as often as the one before it
    rows += [(1000 + i, t) for i, t in enumerate(["qqqqqq " * 5 + "qqqqqw " * 30, "qqqqww " * 200, "qqqwww " * 1200])]
    want = brute_force(rows)
    got = sorted((tuple(r) for r in S.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[0])
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    assert S.group_variants(nothing).count() == 0
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in S.group_variants(odd).collect()) == brute_force(plain)


def test_handing_on_counts_changes_nothing(spark):
    rows = [(i, f"wordone wordtwo{chr(97 + i % 20)} wordthree") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, S.count_words(docs).collect()))
    assert sorted(map(tuple, S.count_words(docs, gathered=4).collect())) == whole
    assert np.array_equal(S.powers(3), np.array([1, int(S._BASE), int(S._BASE) ** 2 % 2 ** 64], np.uint64))


def test_query(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    assert S.group_documents(spark, str(tmp_path)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
