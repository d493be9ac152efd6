"""Cumulative-link ordinal regression: severity grades from sparse text features.

A document has grade 0 (fine), 1 (poor) or 2 (toxic). One weight vector over hashed words is shared by
all thresholds; P(grade > k) = sigmoid(w.x - b_k) with b_0 <= b_1. The model is fitted on a bounded
sample of labelled documents (SAMPLE, those with the smallest hash of their id), in which grades weigh
the same; every document is then scored in one pass, and its expected severity is the sum of the
P(grade > k). A document is called toxic when P(grade > 1) > 0.5.

Features: the distinct words of the whole text, lower-cased, without punctuation at their ends, and the
beginnings of these words, hashed into BUCKETS; a bucket counts when MIN_DOCS sampled documents have it
and its share of documents differs between the grades by more than chance.

Defined results: null, empty and blank texts have no features and get the severity of the thresholds
alone; a document with several labels is learnt from with each; labels without a document are passed over;
with no labels all severities are 0; repeated rows are scored each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.llm.common import as_bytes, checked_broadcast, documents, over_batches, steps
from glossmeter.stage import staged

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Hash buckets; documents that must have a bucket; grades.
BUCKETS, MIN_DOCS, GRADES = 1 << 20, 4, 3
#: Standard deviations by which a bucket must stand out in a grade; the fit's rounds, rate and penalty.
CHANCE = 6.0
ROUNDS, RATE, PENALTY = 200, 0.05, 1e-4
#: Bytes of the beginnings of words that are features beside the words.
HEADS = (4, 5, 6)
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"


class _Buckets(dict):
    """word -> its buckets: the word itself and how it begins."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        clean = word.strip(_EDGES) or word
        heads = {clean[:n] + b"*" for n in HEADS if len(clean) > n}
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(x) % BUCKETS for x in (clean, *heads))
        return value


_BUCKETS = _Buckets()


def features(text: bytes | None) -> np.ndarray:
    """Distinct buckets of a whole text."""
    if len(_BUCKETS) > 300_000:
        _BUCKETS.clear()
    return np.array(list(set().union(*map(_BUCKETS.__getitem__, set((text or b"").lower().split())))), np.int64)


@dataclass
class Model:
    weights: np.ndarray         # one per bucket
    cuts: np.ndarray            # ascending, one per threshold

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.cuts, -40, 40)))


def rows_with(rows: list[np.ndarray], buckets: int) -> np.ndarray:
    """Rows that have each bucket; a part of the rows at a time, so that all are not held a second time."""
    out = np.zeros(buckets, np.int64)
    for i in range(0, len(rows), 1000):
        out += np.bincount(np.concatenate(rows[i:i + 1000]), minlength=buckets)
    return out


def fit(rows: list[np.ndarray], grades: np.ndarray, buckets: int = BUCKETS) -> Model:
    """Minimise the balanced negative log likelihood with an L2 penalty, by Adam on all rows."""
    n_docs = rows_with(rows, buckets)
    # buckets whose share of documents differs between the grades by more than chance
    used = np.flatnonzero(n_docs >= MIN_DOCS)
    rate, apart = n_docs[used] / max(1, len(rows)), np.zeros(len(used))
    for grade in range(GRADES):
        own = [rows[i] for i in np.flatnonzero(grades == grade)]
        if own:
            seen = rows_with(own, buckets)[used]
            apart = np.maximum(apart, np.abs(seen / len(own) - rate) / np.sqrt(rate * (1 - rate) / len(own) + 1e-12))
    used = used[apart >= CHANCE]
    index = np.full(buckets, -1)
    index[used] = np.arange(len(used))
    kept = [x[x >= 0] for x in (index[r] for r in rows)]
    sizes = np.array([len(x) for x in kept])
    flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(kept)), sizes)
    per_grade = np.bincount(grades, minlength=GRADES)
    weight = 1 / np.maximum(1, per_grade)[grades]
    weight /= weight.sum()
    # parameters: weights, the first cut, and the logarithms of the steps between cuts
    p = np.zeros(len(used) + GRADES - 1)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, ROUNDS + 1):
        w, gaps = p[:len(used)], np.exp(p[len(used) + 1:])
        cuts = p[len(used)] + np.concatenate(([0], np.cumsum(gaps)))
        margin = np.bincount(row, w[flat], len(kept))
        up = 1 / (1 + np.exp(-np.clip(margin[:, None] - cuts, -40, 40)))          # P(grade > k)
        edge = np.concatenate([np.ones((len(kept), 1)), up, np.zeros((len(kept), 1))], 1)
        here = np.arange(len(kept))
        chance = np.maximum(edge[here, grades] - edge[here, grades + 1], 1e-12)
        slope = edge * (1 - edge)
        d_up = np.zeros_like(edge)
        d_up[here, grades] += slope[here, grades] / chance
        d_up[here, grades + 1] -= slope[here, grades + 1] / chance
        d_up *= -weight[:, None]
        d_margin = d_up.sum(1)
        d_cuts = -d_up[:, 1:-1].sum(0)
        grad = np.concatenate([np.bincount(flat, d_margin[row], len(used)) + PENALTY * w, [d_cuts.sum()],
                               np.cumsum(d_cuts[::-1])[::-1][1:] * gaps])
        first += 0.1 * (grad - first)
        second += 0.01 * (grad ** 2 - second)
        p = p - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-10)
    full = np.zeros(buckets)
    full[used] = p[:len(used)]
    return Model(full, p[len(used)] + np.concatenate(([0], np.cumsum(np.exp(p[len(used) + 1:])))))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(grade, features) of at most `most` labelled documents."""
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    chosen = (labels.where("doc_id is not null and toxic is not null").select("doc_id", grade.alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most))

    def work(batch: pa.RecordBatch):
        for a, b in steps(texts := batch.column(1).to_pylist()):
            packed = [features(t).astype(np.int32).tobytes() for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())],
                                             names=["grade", "features"])

    rows = docs.select("doc_id", "text").join(checked_broadcast(staged(chosen)), "doc_id")
    return over_batches(as_bytes(rows, "grade"), work, "grade int, features binary")


def learn(rows: DataFrame) -> Model | None:
    """Fit on a bounded sample, in one task; None without rows."""
    def work(found):
        model = fit([np.frombuffer(x, np.int32) for x in found["features"]], found["grade"].to_numpy())
        used = np.flatnonzero(model.weights)
        return pd.DataFrame({"used": [used.tolist()], "weights": [model.weights[used].tolist()], "cuts": [model.cuts.tolist()]})

    got = rows.groupBy().applyInPandas(work, "used array<long>, weights array<double>, cuts array<double>").first()
    if got is None:
        return None
    weights = np.zeros(BUCKETS)
    weights[got["used"]] = got["weights"]
    return Model(weights, np.array(got["cuts"]))


class _Telling(dict):
    """word -> those of its buckets that have a weight."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = tuple(b for b in _Buckets().__missing__(word) if self.weights[b])
        return value


def severity(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """One row per document: the columns of `keep`, its severity and the chances of the grades."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep),
                        "expected_severity double, p_poor double, p_toxic double, grade int, toxic boolean"])

    def run(batches):
        telling = _Telling(model.weights) if model else None
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in steps(texts):
                up = np.zeros((b - a, GRADES - 1))
                if model:
                    found = [list(set().union(*map(telling.__getitem__, set((t or b"").lower().split())))) for t in texts[a:b]]
                    up = model.above(np.array([model.weights[x].sum() if x else 0.0 for x in found]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(up.sum(1)), pa.array(up[:, 0]),
                     pa.array(up[:, 1]), pa.array((up > 0.5).sum(1), pa.int32()), pa.array(up[:, 1] > 0.5)],
                    names=[*keep, "expected_severity", "p_poor", "p_toxic", "grade", "toxic"])

    return as_bytes(docs, *keep).mapInArrow(run, schema)


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return severity(docs, learn(sample(docs, labels)), ["doc_id"])
