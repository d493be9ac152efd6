import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from glossmeter.llm import token_counts as C
from glossmeter.llm.encoding import default_tokenizer


def test_rule_for_tokens_across_sections():
    start, stop = np.array([0, 4, 5, 9]), np.array([3, 4, 8, 12])
    place, several = C.allot(np.array([0, 3, 2, 6, 7, 1]), np.array([3, 4, 7, 8, 11, 11]), start, stop)
    # inside; only a break; mostly in the third; inside; equal shares go to the earlier; most of the middle
    assert place.tolist() == [0, 0, 2, 2, 3, 2] and several.tolist() == [False, False, True, False, True, True]


def test_counts_add_up(spark, odd, nothing, prose):
    texts = {1: "a b\n\nc\nd e f", 2: "\n\n", 3: None, 4: prose["base"].replace(" w1", "\nw1"), 5: "x\r\n y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain, rows = Tokenizer.from_file(default_tokenizer()), defaultdict(list)
    for r in C.attribute(docs).collect():
        rows[r["doc_id"]].append(r)
    for doc, text in texts.items():
        total = len(plain.encode(text or "", add_special_tokens=False).ids)
        assert sum(r["n_tokens"] for r in rows[doc]) == total == rows[doc][0]["doc_tokens"]
        lines = (text or "").split("\n")
        assert [(text or "")[r["start_char"]:r["end_char"]] for r in sorted(rows[doc], key=lambda r: r["section"])] == lines
    assert C.attribute(odd).where("doc_id = 5 and section = 0").count() == 2
    assert C.attribute(nothing).count() == 0


def test_every_token_against_brute_force(spark):
    """The section of each token by its overlap with every line, one after another."""
    rng = random.Random(2)
    atoms = ["a", "word", " ", "\n", "\n\n", "é", "漢字", "🙂", "...", "\t\n ", "\r\n", "12"]
    texts = {i: "".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for i in range(150)}
    plain, want = Tokenizer.from_file(default_tokenizer()), {}
    for doc, text in texts.items():
        spans, at = [], 0
        for line in text.split("\n"):
            spans.append((at, at + len(line)))
            at += len(line) + 1
        counts = [0] * len(spans)
        for low, high in plain.encode(text, add_special_tokens=False).offsets:
            shared = [min(b, high) - max(a, low) for a, b in spans]
            if max(shared) > 0:
                counts[shared.index(max(shared))] += 1
            else:                                            # only a break: the last line with characters before it, or the first of all
                solid = [k for k, (a, b) in enumerate(spans) if b > a]
                before = [k for k in solid if spans[k][1] <= low]
                counts[before[-1] if before else solid[0] if solid else 0] += 1
        for k, n in enumerate(counts):
            want[doc, k] = n
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in C.attribute(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want
