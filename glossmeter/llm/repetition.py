"""Quality rules with repetition found by suffix arrays.

A document fails the base rules with fewer than 10 words, or when words in repeated five-word windows
are over 20 % of all. The method's verdict looks at maximal repeated substrings of words: suffixes are
sorted by prefix doubling, the longest common prefix of neighbours in that order gives the intervals of
suffixes that share a repeat, each suffix is covered as far as its deepest interval reaches, and the
spans are united. The covered share of the words and the longest repeat are limited.

Only positions whose window of MIN_REPEAT words occurs twice in their document can start a repeat that
counts, so only these are sorted; a text without repeats costs one pass. A batch of documents is sorted
as one sequence, in which windows of different documents never compare equal.

Defined results: null, empty and blank texts have no words and fail; repeated rows are judged one by
one; texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.llm.common import as_bytes, documents, mix, over_batches, text_steps, word_hashes

MIN_WORDS = 10
BASE_WINDOW, BASE_SHARE = 5, 20
#: A repeated substring counts from this many words.
MIN_REPEAT = 5
#: Limits of the verdict: share of words covered by repeats, and words of the longest repeat.
MAX_COVERED, MAX_REPEAT = 0.15, 50

SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that begin a window inside their document, and the windows' hashes, told apart by document."""
    at = np.flatnonzero(np.arange(len(words)) + width <= ends)
    total = mix(doc[at].astype(np.uint64) + _STEP)
    for k in range(width):
        total = mix(total + words[at + k] + _STEP)
    return at, total


def twice_found(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(len(keys), bool)
    again = again[np.flatnonzero(np.diff(again, prepend=again[:1] - np.uint64(1)))]
    return again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys


def repeats(words: np.ndarray, ends: np.ndarray, at: np.ndarray, keys: np.ndarray,
            width: int = MIN_REPEAT) -> np.ndarray:
    """Words of the longest repeated substring that starts at each of the positions `at`.

    at, keys: the positions whose window of `width` words occurs twice in its document, and its hash.
    """
    n = len(at)
    if n == 0:
        return at

    def window(start):
        """The `width` words from each start, as columns; 0 past the end of the document."""
        cells = start[:, None] + np.arange(width)
        return np.where(cells < ends[at][:, None], words[np.minimum(cells, len(words) - 1)], np.uint64(0)).T

    def ranked(order, new):
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    # rank by the first `width` words; equal windows of different documents have different keys
    order = np.lexsort((keys, *window(at)[::-1]))
    rank = ranked(order, np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
    place = np.full(len(words) + 1, -1, np.int64)
    place[at] = np.arange(n)
    levels, span = [rank], width
    while len(rank) > rank.max() + 1:
        # prefix doubling: by the first 2 * span words. Where the words that follow are no repeat, the
        # position is alone in its rank, and still sorted by these words
        follows = np.minimum(at + span, len(words))
        next_place = np.where(at + span < ends[at], place[follows], -1)
        second = np.where(next_place < 0, n + np.arange(n), rank[next_place])
        order = np.lexsort((second, *window(follows)[::-1], rank))
        new = (np.diff(rank[order], prepend=-1) != 0) | (np.diff(second[order], prepend=-1) != 0)
        rank = ranked(order, new)
        levels.append(rank)
        span *= 2
    # common prefixes of neighbours in the suffix array, by going down the levels
    order = np.argsort(rank)
    left, right = at[order[:-1]], at[order[1:]]
    stop_left, stop_right = ends[left], ends[right]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = place[left], place[right]
        same = (i >= 0) & (j >= 0) & (left < stop_left) & (right < stop_right) & (stop_left == stop_right)
        same[same] = levels[level][i[same]] == levels[level][j[same]]
        step = same * (width << level)
        common, left, right = common + step, np.minimum(left + step, len(words)), np.minimum(right + step, len(words))
    going = common > 0                                     # fewer than `width` words are left in common
    for _ in range(width - 1):
        going = going & (left < stop_left) & (right < stop_right)
        going[going] = words[left[going]] == words[right[going]]
        common, left, right = common + going, left + going, right + going
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def union_words(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` positions lie in one of the spans."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + lengths, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """All measures of a few documents at once."""
    split = [(t or b"").split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    total, docs = int(n_words.sum()), len(texts)
    words = np.concatenate([word_hashes(w) for w in split]) if docs else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(docs), n_words)
    ends = np.repeat(np.cumsum(n_words), n_words)

    def by_doc(mask):
        return np.bincount(doc[mask], minlength=docs).astype(np.int64)

    at, keys = window_hashes(words, doc, ends, BASE_WINDOW)
    again = at[twice_found(keys)]
    n_repeat = by_doc(union_words(again, np.full(len(again), BASE_WINDOW), total))
    if MIN_REPEAT != BASE_WINDOW:
        at, keys = window_hashes(words, doc, ends, MIN_REPEAT)
    found = twice_found(keys)
    at, keys = at[found], keys[found]
    longest = repeats(words, ends, at, keys)
    covered = by_doc(union_words(at, longest, total))
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[at], longest)
    chars = np.array([len(b"".join(w).decode("utf-8", "replace")) for w in split], np.int64)
    symbols = np.array([len(t or b"") - len((t or b"").translate(None, SYMBOLS)) for t in texts], np.int64)
    dup_lines = np.array([_dup_lines(t or b"") for t in texts], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_SHARE * n_words)
    kept = ~failed & (covered <= MAX_COVERED * n_words) & (most <= MAX_REPEAT)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "covered_words": covered, "longest_repeat": most}


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x and not x.isspace()]
    return len(lines) - len(set(lines))


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean, covered_words long, longest_repeat long")


def quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document: the columns of `keep` and the measures."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), MEASURES])

    def work(batch: pa.RecordBatch):
        for a, b, texts in text_steps(batch.column(batch.num_columns - 1)):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))),
                                              *map(pa.array, found.values())], names=[*keep, *found])

    return over_batches(as_bytes(docs, *keep), work, schema)


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns, whatever these are called."""
    names = docs.columns
    safe = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)])
    place = [n.lower() for n in names].index("text")

    def work(batch: pa.RecordBatch):
        for a, b, texts in text_steps(batch.column(place).cast(pa.binary())):
            yield batch.slice(a, b - a).filter(pa.array(measure(texts)["kept"]))

    kept = over_batches(safe, work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema))
    return kept.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])

