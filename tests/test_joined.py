"""Joined counts from merged runs, and sweeps from merge traces."""

import base64
import random

import pytest
import regex

from glossmeter import counters, dims
from glossmeter.operators import bpe, joined, merges

#: Patterns that tie white space, line breaks and digits to their neighbours in different ways.
PATTERNS = {
    "spaces": bpe.SPLIT_PATTERN,
    "breaks": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "words": r"\S+|\s+",
}


def sentences(seed, n):
    rng = random.Random(seed)
    atoms = ["a", "the", "é", "12345", "!!", "...", "\n", "\r\n", "  ", "\t", "'s", "漢", " ", "x"]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("name", PATTERNS)
def test_merging_is_exact_in_any_order(name):
    """Runs merged from the left, from the right and as a tree count what one pass over the joined text does."""
    joiner = joined.Joiner(PATTERNS[name], lambda piece: 1 + len(piece) // 3)
    for seed in range(120):
        texts = sentences(seed, random.Random(seed).randint(1, 14))
        want = sum(1 + len(p) // 3 for p in regex.findall(PATTERNS[name], " ".join(texts)))
        runs = [joiner.run(t) for t in texts]
        left = runs[0]
        for r in runs[1:]:
            left = joiner.merge(left, r)
        right = runs[-1]
        for r in runs[-2::-1]:
            right = joiner.merge(r, right)
        tree = runs
        while len(tree) > 1:
            tree = [joiner.merge(*tree[i:i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
        assert [joiner.total(r) for r in (left, right, tree[0])] == [want] * 3, texts


def test_what_a_run_holds_stays_short():
    joiner = joined.Joiner(PATTERNS["breaks"], len)
    held = joiner.run("one two three four")
    for k in range(500):
        held = joiner.merge(held, joiner.run(f"some words {k} in a line.\n"))
    assert len(held.left) + len(held.ahead) + len(held.right) < 60


def test_a_pattern_that_reaches_over_words_is_refused():
    joiner = joined.Joiner(r"\w+ \w+|\s|.", len)
    with pytest.raises(ValueError, match="joins pieces"):
        runs = [joiner.run(t) for t in ["aa bb cc dd ee", "ff gg hh ii jj kk", "ll mm nn oo"]]
        joiner.total(joiner.merge(joiner.merge(runs[0], runs[1]), runs[2]))
        raise AssertionError("not refused")


@pytest.mark.parametrize("name", PATTERNS)
def test_totals_of_a_table(spark, name):
    rows = [(corpus, lang, i, t) for corpus in ("c", "d") for lang in ("x", "y") for i, t in enumerate(sentences(f"{corpus}{lang}", 150))]
    rows.append(("c", "single", 0, "only one"))
    units = spark.createDataFrame(rows, "corpus string, lang string, sentence_idx long, text string").repartition(7)
    pattern = PATTERNS[name]
    got = {(r.corpus, r.lang): r.total for r in joined.joined_totals(units, lambda: (pattern, len)).collect()}
    texts = {}
    for corpus, lang, _, t in rows:
        texts.setdefault((corpus, lang), []).append(t)
    assert got == {k: sum(map(len, regex.findall(pattern, " ".join(v)))) for k, v in texts.items()}


def test_counter_of_a_ranks_file(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b" the": 258}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    counter, why = counters.build(dims.Counter("own", "Own", "Nobody", "ranks_file", "live", str(path)))
    assert not why
    units = spark.createDataFrame([("c", "x", i, t) for i, t in enumerate(["the other", "the the", " the"])], "corpus string, lang string, sentence_idx long, text string")
    assert counter.joined_totals(units).first().total == 9      # the| |o|the|r| the| the| | the
    assert [r[0] for r in units.select(counter.content(units.text)).collect()] == [5, 2, 1]
    path.write_text("dGg= 256\n")
    assert counters.build(dims.Counter("own", "Own", "Nobody", "ranks_file", "live", str(path)))[1].endswith("(ValueError)")
    assert "unavailable" in counters.build(dims.Counter("own", "Own", "Nobody", "ranks_file", "live", str(tmp_path / "none")))[1]


def plain_count(piece, ranks):
    if piece in ranks:
        return 1
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("ordered", [True, False])
def test_drops_at_every_size(ordered):
    """Also under vocabularies that are in no merge order."""
    rng = random.Random(4)
    tokens = set()
    while len(tokens) < 60:
        tokens.add("".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode())
    tokens = sorted(tokens, key=(lambda t: (len(t), t)) if ordered else lambda t: rng.random())
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
    for _ in range(300):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))).encode()
        found = merges.drops(piece, ranks)
        for size in range(256, 320, 3):
            cut = {t: r for t, r in ranks.items() if r < size}
            assert len(piece) - sum(k for r, k in found if r < size) == plain_count(piece, cut)


def test_long_pieces_are_traced_in_proportion():
    ranks = {b"ab": 256, b"abab": 257}
    assert merges.drops(b"ab" * 50_000, ranks) == [(256, 50_000), (257, 25_000)]


def test_trace_table(spark):
    ranks = bpe.share(spark, {bytes([b]): b for b in range(256)} | {b"ab": 256})
    rows = merges.merge_traces(spark.createDataFrame([("abab",), ("é",)], "piece string"), ranks).collect()
    assert {(r.piece, r.n_bytes, tuple(map(tuple, r.drops))) for r in rows} == {("abab", 4, ((256, 2),)), ("é", 2, ())}


def test_texts_are_split_once(spark):
    """Dealing out by ranges looks at its input twice; what it looks at is a written table."""
    units = spark.createDataFrame([("c", "x", i, "one two three") for i in range(50)], "corpus string, lang string, sentence_idx long, text string")
    found = joined.joined_totals(units, lambda: (PATTERNS["spaces"], len))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.first().total == 50 * 14 - 1


def test_only_the_beginning_of_a_text_is_split_for_its_safe_place():
    joiner = joined.Joiner(PATTERNS["breaks"], len)
    made, real = [], joiner.pattern
    joiner.pattern = type("Seen", (), {"groups": 0, "findall": real.findall, "finditer": lambda self, *at: (made.append(m) or m for m in real.finditer(*at))})()
    run = joiner.run("some words in a line " * 1000)
    assert len(made) < 10 and run.tokens > 20_000
