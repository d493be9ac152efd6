import random

import pytest

from glossmeter.llm import repetition as R


def brute(words, width):
    """(covered words, longest repeat) by comparing all pairs of positions."""
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= width:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    return len(covered), longest


def test_suffix_arrays_find_what_all_pairs_find():
    rng, texts = random.Random(3), [None, b"", b"  ", b"a " * 50, b"a b c " * 30]
    for t in range(120):
        words = [rng.choice("ab" if t % 3 else "abcdef") for _ in range(rng.randint(0, 50))]
        texts.append(" ".join(words + words[3:18] + ["x"] + words[5:16] if t % 4 == 0 else words).encode())
    got = R.measure(texts)
    for i, text in enumerate(texts):
        assert (got["covered_words"][i], got["longest_repeat"][i]) == brute((text or b"").split(), R.MIN_REPEAT), text


def test_base_measures():
    text = "Ä b|c\n\n# x\nÄ b|c\n \t \none two three four five one two three four five".encode()
    got = {k: v[0] for k, v in R.measure([text]).items()}
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (16, 48, 3, 1, 10)
    assert got["base_failed"] and not got["kept"]


def test_rows_and_columns(odd, nothing):
    kept = R.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "5", "7", "None"]     # 6 repeats itself
    assert R.keep_good(nothing).count() == 0
    rows = {r["doc_id"]: r for r in R.quality(odd.select("doc_id", "text"), ["doc_id"]).collect()}
    assert rows[1]["n_words"] == rows[3]["n_words"] == 0 and rows[6]["longest_repeat"] == 55_000
