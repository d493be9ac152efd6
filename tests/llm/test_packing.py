import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from glossmeter.llm import packing as P
from glossmeter.llm.encoding import Encoder, default_tokenizer

ODD = ["", " ", "a  b", "\n a\tb 　c", "don't  stop", "é à", "日本 語\n\n🙂 x", "<|endoftext|> a b", "x\x1c y", "ends \n"]


@pytest.mark.parametrize("spans", [False, True])
def test_encoder_equals_the_library(prose, spans):
    texts = ODD + prose["plain"]
    plain, own = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer())
    for text, got in zip(texts, own.encode(texts, spans)):
        want = plain.encode(text, add_special_tokens=False)
        if spans:
            assert list(zip(*(x.tolist() for x in got))) == want.offsets, text
        else:
            assert got == np.array(want.ids, "<u4").tobytes(), text


def test_a_word_is_encoded_once_whatever_follows_it():
    rng, own, plain = random.Random(3), Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    own.encode(["a wonderful, b wonderful. c wonderful's d wonderful\nThe wonderful"])
    assert [w for w in own.word_ids if w.startswith("wonder")] == ["wonderful"]
    odd = ["naïve²,x aΩ, ǅ é.é ×a ÷, b's 12,3a", *("".join(rng.choices(" \n\tab'sé×.,-1²Ω日\u0301 \x1c", k=rng.randrange(1, 14))) for _ in range(3000))]
    for text, got in zip(odd, own.encode(odd)):
        assert got == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def rebuild(rows, texts):
    """Check that every id lies in one piece and sequences are whole; the padding."""
    plain, docs, sequences = Tokenizer.from_file(default_tokenizer()), defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert docs.keys() == texts.keys()
    for doc, pieces in docs.items():
        ids = [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_pieces_and_sequences(spark, corpus, odd, nothing):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert rebuild(P.pack(corpus).collect(), texts) <= 200
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert rebuild(P.pack(one).collect(), {r["doc_id"]: r["text"] for r in one.collect()}) <= 200
    assert P.pack(odd).selectExpr("sum(length) n").first()["n"] > 0
    assert P.pack(nothing).count() == 0


def test_a_length_that_is_too_common_is_cut():
    histogram = np.zeros(1024, np.int64)
    histogram[700] = 5000
    kinds, repeats, stock = P.plan(histogram)
    stream = P.Stream(histogram, stock, first=0)
    filled = defaultdict(int)
    for rank in range(5000 - int(stock[700]), 5000):
        parts = stream.stretches(700, rank)
        assert sum(p[1] for p in parts) == 700 and [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts[:-1])]))
        for _, size, sequence, _ in parts:
            filled[sequence] += size
    assert all(n & (n - 1) == 0 for n in filled.values())


def test_solver_fills_what_can_be_filled():
    histogram = np.zeros(1024, np.int64)
    histogram[[600, 424, 300, 512]] = 70, 40, 30, 10
    histogram[124] = 30
    _, _, stock = P.plan(histogram)
    assert stock.sum() == 0
