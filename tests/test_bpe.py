import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from glossmeter.operators import bpe, merges

TEXTS = ["abab c", "the cat  sat", " lead", "tail  ", "\ttab\tx ", "é🙂 漢字 don't we'll", "a\nb\n\nc", "x", "12 34,5!?", "  both  "]


def _merge(piece: bytes, ranks):
    """Byte-pair encoding by the book: merge the pair of lowest rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        pairs = [p for p in pairs if p[0] is not None]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def _encode(text, ranks):
    return [t for p in regex.findall(bpe.SPLIT_PATTERN, text) for t in _merge(p.encode(), ranks)]


@pytest.fixture(scope="module")
def vocabulary(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 3 + ["the the cat catalogue", "abab abba"]], "text string")
    return bpe.prefix_vocabulary(docs, 400).cache()


@pytest.fixture(scope="module")
def ranks(vocabulary):
    return bpe.collect_ranks(vocabulary)


@pytest.fixture(scope="module")
def shared(spark, ranks):
    return bpe.share(spark, ranks)


def _texts(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def test_vocabulary_is_dense_and_starts_with_the_bytes(ranks):
    assert sorted(ranks.values()) == list(range(len(ranks)))
    assert all(ranks[bytes([b])] == b for b in range(256))


def test_counts_and_ids_match_brute_force(spark, ranks, shared):
    rows = _texts(spark).select("i", bpe.encode_column(shared)("text").alias("ids"), bpe.count_column(shared)("text").alias("n")).collect()
    for r in rows:
        assert r.ids == _encode(TEXTS[r.i], ranks)
        assert r.n == len(r.ids)


def test_tiny_vocabulary(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    ids = _texts(spark, ["abab c"]).select(bpe.encode_column(bpe.share(spark, ranks))("text")).first()[0]
    assert ids == [256, 256, 32, 99]


def test_special_token_text_is_refused(spark, shared):
    special = bpe.encode_column(shared, special={"<|end|>": 100000})
    with pytest.raises(Exception, match="special"):
        _texts(spark, ["a <|end|>"]).select(special("text")).collect()


def test_sweep_matches_brute_force(spark, ranks, shared):
    df = _texts(spark).withColumn("lang", F.when(F.col("i") % 2 == 0, "a").otherwise("b"))
    sizes = [256, 270, 1e6]
    got = {(r.lang, r.vocab_size): r.n_tokens for r in merges.tokens_by_size(bpe.piece_counts(df, ["lang"]), ["lang"], shared, sizes).collect()}
    for size in sizes:
        cut = {t: r for t, r in ranks.items() if r < size}
        for lang, par in (("a", 0), ("b", 1)):
            assert got[lang, size] == sum(len(_encode(t, cut)) for i, t in enumerate(TEXTS) if i % 2 == par)


def test_joined_total_equals_the_count_of_the_joined_text(spark, ranks, shared):
    counter = bpe.vocabulary_counter("bpe", "bpe", shared)
    rng = np.random.default_rng(3)
    corpora = {"fixed": TEXTS, "turned": TEXTS[::-1], "one": ["  only "],
               "random": ["".join(rng.choice(list("ab \t9!é"), 12)) + "z" + "".join(rng.choice(list(" \tx"), 3)) for _ in range(40)]}
    rows = [("c", name, 10 * i, t) for name, ts in corpora.items() for i, t in enumerate(ts)]
    for key in ("unit_key", "sentence_idx"):
        step = 10 if key == "unit_key" else 1
        units = spark.createDataFrame([(c, n, k // 10 * step, t) for c, n, k, t in rows], f"corpus string, lang string, {key} bigint, text string")
        got = {r.lang: r.total for r in counter.joined_totals(units).collect()}
        assert got == {name: len(_encode(" ".join(ts), ranks)) for name, ts in corpora.items()}


def _align_by_the_book(ids, decode):
    groups, buffer = [], []
    for t in ids:
        buffer.append(t)
        text = decode(buffer)
        if len(text) > 1 or (len(text) == 1 and text != "�"):
            groups.append((list(buffer), text))
            buffer = []
    return groups


def test_alignment_matches_the_buffering_rule(spark, ranks, shared):
    by_rank = {r: t for t, r in ranks.items()}
    decode = lambda ids: b"".join(by_rank[i] for i in ids).decode("utf-8", errors="replace")
    texts = [*TEXTS, "�", "a�b", "日本語🙂🙂é"]
    for r in _texts(spark, texts).select("i", bpe.align_column(shared)("text").alias("g")).collect():
        want = _align_by_the_book(_encode(texts[r.i], ranks), decode)
        assert [(list(g.tokens), g.text) for g in r.g] == want
        assert bpe.align(_encode(texts[r.i], ranks), decode) == want


def test_alignment_takes_a_large_batch_in_parts(spark, shared):
    texts = pa.array([None, "", *[f"many words of text {k} " * 40 for k in range(3000)], "long one " * 300_000])
    parts = [*bpe.align_column(shared).func(iter([texts]))]
    assert sum(map(len, parts)) == len(texts)
    assert max(p.nbytes for p in parts[:-1]) < 40 << 20 and len(parts) > 3
    joined = [None if g is None else "".join(x["text"] for x in g) for p in parts for g in p.to_pylist()]
    assert joined == [t or "" for t in texts.to_pylist()]


def test_examples_and_latex(spark, shared):
    g = bpe.align_column(shared)("text")
    df = _texts(spark, ["é x"]).select("text", g.alias("g"))
    row = df.select(bpe.example_record(F.col("text"), F.col("g"), F.lit(1)).alias("e"), bpe.latex_rows(F.col("g")).alias("l"),
                    bpe.reverse_aligned(F.col("g")).alias("r")).first()
    assert row.e.text == "é x" and "".join(row.e.tokens_text) == "é x"
    assert row.e.num_tokens == sum(len(t) for t in row.e.tokens) and row.e.unknown_fraction == 1 / row.e.num_tokens
    assert row.l.endswith("\n") and row.l.count("\\wrapword{") >= 2
    assert [x.text for x in row.r] == row.e.tokens_text[::-1]


def test_slices_and_truncation(vocabulary):
    assert [r.token_hex for r in bpe.vocabulary_slice(vocabulary, 97, 99).orderBy("rank").collect()] == ["61", "62"]
    assert bpe.truncate(vocabulary, 256).count() == 256


def test_vocabulary_over_the_limit_is_refused(vocabulary):
    with pytest.raises(ValueError, match="more than 10"):
        bpe.collect_ranks(vocabulary, limit=10)


def test_coloured_rows_line_up(spark, shared):
    ids = bpe.encode_column(shared)("text")
    df = _texts(spark, ["xé the"]).select(ids.alias("ids")).withColumn("texts", bpe.token_texts_column(shared)("ids"))
    row = df.select("ids", "texts", bpe.coloured_rows(F.col("ids"), F.col("texts")).alias("c")).first()
    plain = lambda s: regex.sub(r"\x1b\[\d+m", "", s)
    assert len(plain(row.c.ids)) == len(plain(row.c.texts)) == sum(max(len(str(i)), len(t)) for i, t in zip(row.ids, row.texts))
    assert row.c.ids.startswith("\x1b[41m" + str(row.ids[0])) and row.c.ids.count("\x1b[0m") == len(row.ids)
