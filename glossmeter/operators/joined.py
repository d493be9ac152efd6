"""Counts of whole corpora whose pieces may reach over the borders of sentences.

A counter with a split pattern counts piece by piece, but a piece may begin in one sentence and end in
the next, so the count of ``" ".join(sentences)`` is no sum. A run of sentences is therefore summarised
by three things: its text up to a place at which every way of entering the run has begun a piece, the
tokens of the pieces between, and its text from the last visible piece on, which may go on. Two
neighbouring runs make one: only the text around their border is split again. The merge is associative,
so sentences are summarised where they are scanned, their short ends are put in order by ranges, each
task folds its stretch, and the stretches of a language are folded at the end. No text of a sentence
moves but its ends, and no row holds a language.

Exact for any split pattern without look-behind whose match is decided by the text up to the next
visible character, line breaks that cling to punctuation included. A run entered at a place it did not
foresee is refused, never counted wrongly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from glossmeter.counters import TextCounter, order_key
from glossmeter.stage import staged

#: Made once per task: the split pattern, and a function from a piece to its number of tokens.
Splitter = Callable[[], tuple[str, Callable[[str], int]]]

#: Pieces whose counts a task remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Run:
    """Summary of neighbouring sentences. ``right`` is None while no inner piece is certain; ``left`` is then all text.

    ahead: what follows ``left``, as far as its last piece may look.
    """

    left: str
    ahead: str = ""
    tokens: int = 0
    right: str | None = None


class Counts(dict):
    """piece -> its tokens, filled as pieces are met."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.count(piece)
        return n


class Joiner:
    """Summarises and merges runs for one split pattern."""

    def __init__(self, pattern: str, count: Callable[[str], int], sep: str = " "):
        self.pattern, self.sep, self.known = regex.compile(pattern), sep, Counts(count)

    def tokens(self, pieces: Iterable[str]) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        return sum(map(self.known.__getitem__, pieces))

    def matches(self, text: str, at: int = 0) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text, at) if m.end() > m.start()]

    def last_visible(self, text: str, spans: list[tuple[int, int]]) -> int:
        """The last piece with a visible character; 0 if there is none."""
        return next((k for k in range(len(spans) - 1, -1, -1) if text[slice(*spans[k])].strip()), 0)

    def pieces(self, text: str, at: int) -> list[str]:
        found = self.pattern.findall(text, at) if not self.pattern.groups else [m.group() for m in self.pattern.finditer(text, at)]
        return [*filter(None, found)]

    def safe_start(self, text: str, entries: int) -> int | None:
        """The first place at which every way of entering has begun a piece; only the beginning of the text is split."""
        met, ahead = [], (m.start() for m in self.pattern.finditer(text) if m.end() > m.start())
        safe = next((s for s in ahead if met.append(s) or s > entries), None)
        for entry in range(1, entries + 1):
            if safe is None:
                break
            for m in self.pattern.finditer(text, entry):
                if m.start() > entries:
                    while met[-1] < m.start() and (more := next(ahead, None)) is not None:
                        met.append(more)
                    if m.start() in met:
                        safe = max(safe, m.start())
                        break
            else:
                safe = None
        return safe

    def run(self, sentence: str) -> Run:
        text = self.sep + sentence
        entries = len(text) - len(text.lstrip())            # the piece before may end behind any white space
        begin = self.safe_start(text, entries)
        if begin is None:
            return Run(sentence)
        pieces = self.pieces(text, begin)
        last = next((k for k in range(len(pieces) - 1, -1, -1) if pieces[k].strip()), 0)
        if not last:
            return Run(sentence)
        size = sum(map(len, pieces))
        if begin + size == len(text):                       # the pieces are all of the text
            second, end = begin + len(pieces[0]) + len(pieces[1]), len(text) - sum(map(len, pieces[last:]))
        else:
            spans = self.matches(text, begin)
            second, end = spans[1][1], spans[last][0]
        return Run(text[len(self.sep):begin], text[begin:second], self.tokens(pieces[:last]), text[end:])

    def _until(self, text: str, ahead: str) -> int:
        """Tokens of a text whose end is known to begin a piece."""
        spans = self.matches(text + ahead)
        if not any(start == len(text) for start, _ in spans):
            raise ValueError("the split pattern joins pieces over a space and the word behind it")
        return self.tokens(text[a:b] for a, b in spans if a < len(text))

    def merge(self, a: Run, b: Run) -> Run:
        if a.right is None:
            text = a.left + self.sep + b.left
            return self.run(text) if b.right is None else replace(b, left=text)
        if b.right is not None:
            return Run(a.left, a.ahead, a.tokens + self._until(a.right + self.sep + b.left, b.ahead) + b.tokens, b.right)
        text = a.right + self.sep + b.left
        spans = self.matches(text)
        last = self.last_visible(text, spans)
        more = self.tokens(text[x:y] for x, y in spans[:last])
        return Run(a.left, a.ahead, a.tokens + more, text[spans[last][0]:] if spans else text)

    def total(self, run: Run) -> int:
        """Tokens of a run that stands alone."""
        whole = self.tokens(run.left[a:b] for a, b in self.matches(run.left)) if run.right is None else None
        if whole is not None:
            return whole
        return self._until(run.left, run.ahead) + run.tokens + self.tokens(run.right[a:b] for a, b in self.matches(run.right))


RUN = "left string, ahead string, tokens long, right string"


def joined_totals(units: DataFrame, splitter: Splitter, sep: str = " ") -> DataFrame:
    """(corpus, lang, total): tokens of every language's sentences, joined in order."""
    order = order_key(units)

    def summarise(batches):
        joiner = Joiner(*splitter(), sep)
        for batch in batches:
            runs = [joiner.run(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([getattr(r, c) for r in runs], t) for c, t in
                                       (("left", pa.string()), ("ahead", pa.string()), ("tokens", pa.int64()), ("right", pa.string())))],
                names=["corpus", "lang", "at", "left", "ahead", "tokens", "right"])

    def fold(batches):
        joiner, key, held = Joiner(*splitter(), sep), None, None
        for batch in batches:
            out = []
            for corpus, lang, _, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if (corpus, lang) != key:
                    if held is not None:
                        out.append((*key, held))
                    key, held = (corpus, lang), Run(*parts)
                else:
                    held = joiner.merge(held, Run(*parts))
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([(*key, held)])

    def _batch(out):
        return pa.RecordBatch.from_pylist([{"corpus": c, "lang": x, "left": r.left, "ahead": r.ahead, "tokens": r.tokens, "right": r.right} for c, x, r in out],
                                          pa.schema([("corpus", pa.string()), ("lang", pa.string()), ("left", pa.string()), ("ahead", pa.string()),
                                                     ("tokens", pa.int64()), ("right", pa.string())]))

    def finish(found: pd.DataFrame) -> pd.DataFrame:
        joiner, held = Joiner(*splitter(), sep), None
        for row in found.sort_values("part").itertuples():
            part = Run(row.left, row.ahead, int(row.tokens), row.right if isinstance(row.right, str) else None)
            held = part if held is None else joiner.merge(held, part)
        return pd.DataFrame({"corpus": found["corpus"].iloc[:1], "lang": found["lang"].iloc[:1], "total": [joiner.total(held)]})

    # written, as dealing out by ranges looks at its input twice, and the texts are to be split once
    ends = staged(units.select(F.col("corpus").cast("string").alias("corpus"), F.col("lang").cast("string").alias("lang"), F.col(order).cast("long").alias("at"), "text")
                  .mapInArrow(summarise, f"corpus string, lang string, at long, {RUN}"))
    folded = (ends.repartitionByRange("corpus", "lang", "at").sortWithinPartitions("corpus", "lang", "at")
              .mapInArrow(fold, f"corpus string, lang string, {RUN}").withColumn("part", F.spark_partition_id()))
    return folded.groupBy("corpus", "lang").applyInPandas(finish, "corpus string, lang string, total long")


@dataclass(frozen=True)
class PieceCounter(TextCounter):
    """Counter that splits a text into pieces and counts each by itself; corpus totals are merged from runs."""

    splitter: Splitter | None = None

    def joined_totals(self, units: DataFrame) -> DataFrame:
        return joined_totals(units, self.splitter)
