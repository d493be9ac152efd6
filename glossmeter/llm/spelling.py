"""Spelling variants: words one edit apart, and the form that each is a variant of.

Letters are hashed to SYMBOLS symbols, so a word becomes a word of a small alphabet. Two words one edit apart
have reduced words that are equal or one edit apart. The one-edit neighbourhood of each distinct reduced word is
generated and joined with the reduced words that occur; the words behind two that meet are verified on
their letters. A replacement is generated from the smaller symbol only and a pair of unequal length from the
longer word only, so each meeting comes up once. Reduced words are told by a 64-bit polynomial hash, of
which a neighbour's is a sum away; that two of them collide costs a verification and changes no result.

Words are counted where the texts are read; what is shuffled is words with their counts, then hashes. A key holds
the words of one reduced form, of which there are SYMBOLS ** length, so no key grows with the corpus as
its most frequent word does; a word has a bounded number of one-edit neighbours. Forms occur five times
as often as their variants, so chains of forms are short; their ends are found by doubling.

A planted misspelling is part of the input's definition: of a run whose crc32 with its document's id is
divisible by 199, one letter is missing in that document. A null id counts as empty there.

Defined results: null and empty texts have no words; very long texts and runs are counted whole; repeated
rows count each; of near words of equal count, the smallest in code-point order is the form; an empty table
gives an empty result; other columns are ignored, so none can clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.llm.common import documents, mix, over_batches
from glossmeter.stage import staged

#: Symbols that letters are hashed to; code points of the shortest word; occurrences of the rarest.
SYMBOLS, MIN_LETTERS, MIN_TIMES = 8, 6, 5
#: How many times as often as its variant a form occurs; of the divisor's multiples, runs are misspelt.
TIMES, DIVISOR = 5, 199
#: Distinct words that a task gathers before it hands on their counts, and reduced letters that are handled at once.
GATHERED, STEP_LETTERS = 400_000, 100_000

# in UTF-8, U+00C0 to U+00FF are C3 and one more byte; shorter runs can't become words by losing a letter
_RUN = re.compile(b"(?:[A-Za-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LETTERS)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def misspell(doc: int | None, run: bytes, divisor: int = DIVISOR) -> bytes | None:
    """The run without one letter, or None if it stays as it is."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc is None else b"%d" % doc, run))
    if h % divisor:
        return None
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def count_words(docs: DataFrame, divisor: int = DIVISOR, gathered: int = GATHERED) -> DataFrame:
    """(word, n): words of at least MIN_LETTERS letters that occur MIN_TIMES or more."""
    def run(batches):
        held: Counter[bytes] = Counter()

        def handed():
            kept = [(w, n) for w, n in held.items() if n and (len(w) >= 2 * MIN_LETTERS or len(w.decode()) >= MIN_LETTERS)]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                runs = _RUN.findall((text or b"").lower())
                held.update(runs)
                # the checksum of the id goes on over each run
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word in [w for w in set(runs) if zlib.crc32(w, start) % divisor == 0]:
                    times = runs.count(word)
                    held[word] -= times
                    held[misspell(doc, word, divisor)] += times
                if len(held) > gathered:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TIMES)


def symbol(code_points: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The symbol of each letter, from 1."""
    return (mix(code_points.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]))[:n]


def reduced(words: np.ndarray, length: int, symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols of words of one length, a row each. words: code points, one word after another."""
    return symbol(words, symbols).reshape(-1, length)


def reduced_keys(rows: np.ndarray) -> np.ndarray:
    """Hash of each reduced word (a row of symbols)."""
    return named((rows * powers(rows.shape[1])).sum(1, dtype=np.uint64), rows.shape[1])


def named(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + mix(np.array([length], np.uint64)))


def neighbours(rows: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(row number, hash) of the neighbours of reduced words of one length: each with a larger symbol at a place, each without a symbol."""
    count, n = rows.shape
    power = powers(n)
    terms = rows * power
    total = terms.sum(1, dtype=np.uint64)
    at, found = [], []
    for x in range(2, symbols + 1):
        row, place = np.nonzero(rows < x)
        at.append(row)
        found.append(named(total[row] + (np.uint64(x) - rows[row, place]) * power[place], n))
    # without the symbol at a place: those before it stay, those after it move down by one
    before = np.cumsum(terms, 1) - terms
    moved = rows[:, 1:] * power[:n - 1]
    after = np.zeros_like(terms)
    after[:, :-1] = np.cumsum(moved[:, ::-1], 1)[:, ::-1]
    other = np.ones(rows.shape, bool)
    other[:, 1:] = rows[:, 1:] != rows[:, :-1]                # of a run of equal symbols, the first stands for all
    row, place = np.nonzero(other)
    at.append(row)
    found.append(named(before[row, place] + after[row, place], n - 1))
    return np.concatenate(at), np.concatenate(found)


def by_length(words: list[str]):
    """(places, code points) of the words of each length, in pieces of bounded size."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        places = np.flatnonzero(size == n)
        per = max(1, STEP_LETTERS // int(n))
        for a in range(0, len(places), per):
            part = places[a:a + per]
            yield part, np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32), int(n)


def with_keys(words: DataFrame) -> DataFrame:
    """(word, n, key): key: the hash of the reduced word."""
    def work(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        key = np.zeros(len(texts), np.uint64)
        for places, letters, n in by_length(texts):
            key[places] = reduced_keys(reduced(letters, n))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=["word", "n", "key"])

    return over_batches(words.select("word", "n"), work, "word string, n long, key long")


def probes(words: DataFrame) -> DataFrame:
    """(key, near): hashes of the neighbours of every reduced word. words: one for each reduced word."""
    def work(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for places, letters, n in by_length(texts):
            rows = reduced(letters, n)
            at, near = neighbours(rows)
            yield pa.RecordBatch.from_arrays([pa.array(reduced_keys(rows)[at].view(np.int64)), pa.array(near.view(np.int64))], names=["key", "near"])

    return over_batches(words.select("word"), work, "key long, near long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once. words: (word, n, key), a written table."""
    groups = words.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("n"))
    met = (probes(groups.select("word")).join(groups.select(F.col("key").alias("near")), "near")
           .select(F.least("key", "near").alias("u"), F.greatest("key", "near").alias("v")).where("u <> v").distinct())
    links = staged(met.unionByName(groups.where("n > 1").select(F.col("key").alias("u"), F.col("key").alias("v"))))
    a, b = (words.select(F.col("key").alias(k), F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for k, w in (("u", "a"), ("v", "b")))
    pairs = links.join(a, "u").join(b, "v").where("u <> v or a < b")
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain. forms: (word, form)."""
    at = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = staged(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
                         .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = further.select("word", "root")
        if not further.where("_moved").limit(1).count():
            return at


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word. words: (word, n), each word once."""
    words = staged(with_keys(words))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("form_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best"))
    chosen = F.col("best.less") * -1 >= F.col("n") * TIMES
    found = staged(words.select("word", "n").join(best, "word", "left")
                   .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """Variants of all words of the texts."""
    return variants(staged(count_words(docs)))


def group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir))
