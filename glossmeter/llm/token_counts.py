"""Token counts of sections, from the spans of the tokens of whole documents.

A document is encoded once, as a whole. Its sections are its lines; their spans and the tokens' spans,
both in characters, are joined as intervals. A token that overlaps one section counts there. One that
overlaps several counts where most of its characters lie, and in the earlier of equals. One that overlaps
none, as a line break does, counts in the last section before it that has characters, or the first such
section where there is none before. So the counts of a document's sections add up to its tokens.

Defined results: a null text is like an empty one: one empty section with no tokens; a text of line
breaks only counts its tokens in its first section; repeated rows are counted each on its own; texts of
any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glossmeter.llm.common import documents, over_batches, steps
from glossmeter.llm.encoding import default_tokenizer, encoder


def sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each line and the one after its last."""
    length = np.fromiter(map(len, text.split("\n")), np.int64)
    stop = np.cumsum(length + 1) - 1
    return stop - length, stop


def allot(low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether the token overlaps several.

    low, high: spans of the tokens. start, stop: spans of the sections, ascending and apart.
    """
    solid = np.flatnonzero(stop > start)
    if not len(solid):
        return np.zeros(len(low), np.int64), np.zeros(len(low), bool)
    begin, end = start[solid], stop[solid]
    first = np.searchsorted(end, low, side="right")           # the first that ends after the token begins
    last = np.searchsorted(begin, high, side="left") - 1      # the last that begins before it ends
    several = first < last
    place = np.where(first > last, np.maximum(first - 1, 0), first)
    for i in np.flatnonzero(several):
        span = np.arange(first[i], last[i] + 1)
        shared = np.minimum(end[span], high[i]) - np.maximum(begin[span], low[i])
        place[i] = span[np.argmax(shared)]
    return solid[place], several


def attribute(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per document and section."""
    tokenizer = tokenizer or default_tokenizer()

    def work(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in steps(texts):
            out = [[] for _ in range(7)]
            for doc, text, (low, high) in zip(ids[a:b], texts[a:b], encoder(tokenizer).encode(texts[a:b], spans=True)):
                start, stop = sections(text)
                place, several = allot(low, high, start, stop)
                count = np.bincount(place, minlength=len(start))
                crossing = np.bincount(place[several], minlength=len(start))
                for column, values in zip(out, ([doc] * len(start), range(len(start)), start.tolist(), stop.tolist(),
                                                count.tolist(), crossing.tolist(), [len(low)] * len(start))):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 5))],
                names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    return over_batches(docs.select("doc_id", "text"), work,
                        "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(documents(spark, sf_dir))
