"""Measurement: units x counters -> raw and aggregate counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from glossmeter import dims
from glossmeter.counters import TextCounter
from glossmeter.functions import frames
from glossmeter.functions.text import sql_text

RAW_KEYS = ["corpus", "counter_id", "lang", "sentence_idx"]
AGG_KEYS = ["corpus", "counter_id", "lang"]


def count_units(units: DataFrame, counters: Sequence[TextCounter], keep: Sequence[str]) -> DataFrame:
    """One narrow row per unit: the ``keep`` columns, ``n_chars`` and one count per counter.

    All counts of a text are taken where it is scanned, so nothing later moves text.
    """
    cols = []
    for i, c in enumerate(counters):
        n = c.content(F.col("text"))
        cols.append((F.when(c.covers(), n) if c.covers else n).alias(f"_t{i}"))
    return units.select(*keep, F.char_length("text").cast("bigint").alias("n_chars"), *cols)


def raw_counts(counted: DataFrame, counters: Sequence[TextCounter], measured_on: str,
               sample: int = dims.API_SAMPLE) -> DataFrame:
    """Per-sentence counts, long.

    ``counted`` is the result of :func:`count_units` with corpus, lang and sentence_idx. API
    counters are measured on the head of a corpus only; the others on all of it.
    """
    entries = []
    for i, c in enumerate(counters):
        sampled = f" AND sentence_idx < {sample}" if c.is_api else ""
        entries.append(f"CASE WHEN _t{i} IS NOT NULL{sampled} THEN named_struct("
                       f"'counter_id', {sql_text(c.counter_id)}, 'spec', {sql_text(c.spec)}, 'measured_on', {sql_text(measured_on)}, "
                       f"'n_tokens', _t{i} + {c.frame}, 'n_tokens_content', _t{i}, "
                       f"'envelope_tokens', {c.frame}L) END")
    rows = counted.selectExpr("corpus", "lang", "sentence_idx", "n_chars",
                              f"inline(array_compact(array({', '.join(entries)})))")
    return rows.select("corpus", "counter_id", "lang", "spec", "measured_on", "sentence_idx",
                       "n_tokens", "n_tokens_content", "envelope_tokens", "n_chars")


AGG_COLUMNS = ["corpus", "counter_id", "lang", "spec", "measured_on", "total_tokens", "total_chars"]


def additive_totals(counted: DataFrame, counters: Sequence[TextCounter], measured_on: str) -> DataFrame:
    """Aggregate rows of additive counters from counted units: one aggregation, map-side combined."""
    sums, entries = ["sum(n_chars) AS total_chars"], []
    for i, c in enumerate(counters):
        if c.joiner is None:
            continue
        sums += [f"sum(_t{i}) AS _s{i}", f"count(_t{i}) AS _n{i}"]
        entries.append(f"CASE WHEN _n{i} > 0 THEN named_struct('counter_id', {sql_text(c.counter_id)}, 'spec', {sql_text(c.spec)}, "
                       f"'measured_on', {sql_text(measured_on)}, "
                       f"'total_tokens', _s{i} + {c.joiner} * (_n{i} - 1) + {c.frame}) END")
    totals = counted.groupBy("corpus", "lang").agg(*[F.expr(e) for e in sums])
    long = totals.selectExpr("corpus", "lang", "total_chars", f"inline(array_compact(array({', '.join(entries)})))")
    return long.select(*AGG_COLUMNS)


def joined_totals(units: DataFrame, counter: TextCounter, measured_on: str) -> DataFrame:
    """Aggregate rows of a counter that has to see the joined corpus; units need sentence_idx."""
    chars = units.groupBy("corpus", "lang").agg(F.sum(F.char_length("text").cast("bigint")).alias("total_chars"))
    rows = counter.joined_totals(units).join(chars, ["corpus", "lang"])
    return rows.select("corpus", F.lit(counter.counter_id).alias("counter_id"), "lang",
                       F.lit(counter.spec).alias("spec"), F.lit(measured_on).alias("measured_on"),
                       (F.col("total") + F.lit(counter.frame)).cast("bigint").alias("total_tokens"), "total_chars")


def aggregate_counts(units: DataFrame, counters: Sequence[TextCounter], measured_on: str) -> DataFrame:
    """One count of the joined corpus per corpus x counter x language, long.

    ``total_tokens`` counts ``" ".join(sentences)`` in one call, frame included;
    ``total_chars`` sums the sentences and leaves the joining spaces out.
    """
    additive = [c for c in counters if c.joiner is not None]
    parts = [joined_totals(units, c, measured_on) for c in counters if c.joiner is None]
    if additive:
        parts.append(additive_totals(count_units(units, additive, ["corpus", "lang"]), additive, measured_on))
    return reduce(DataFrame.unionByName, parts)


def content_totals(agg: DataFrame, frames: DataFrame) -> DataFrame:
    """Aggregate rows with the counter's envelope taken off once: one call, one frame."""
    known = frames.select("counter_id", "envelope_tokens")
    return (agg.join(known, "counter_id", "left")
            .withColumn("content_tokens", F.col("total_tokens") - F.coalesce("envelope_tokens", F.lit(0)))
            .drop("envelope_tokens"))


def corpus_sizes(units: DataFrame, baseline: str) -> DataFrame:
    """Sentences per corpus, counted on the baseline language."""
    return (units.where(F.col("lang") == baseline).groupBy("corpus")
            .agg(F.count(F.lit(1)).alias("n_sentences")))


def alignment(units: DataFrame) -> DataFrame:
    """Sentence count per corpus and language, and whether the languages of a corpus agree."""
    sizes = units.groupBy("corpus", "lang").agg(F.count(F.lit(1)).alias("n_sentences"))
    span = sizes.groupBy("corpus").agg((F.min("n_sentences") == F.max("n_sentences")).alias("aligned"))
    return sizes.join(span, "corpus").select("corpus", "lang", "n_sentences", "aligned")


def envelope_floors(probes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Frame per endpoint from rows (group, probe, n_tokens): floor, agreement and verdict."""
    return frames.settle_rows(probes, group)


def carried_envelopes(raw: DataFrame) -> DataFrame:
    """Frame of every counter as its raw rows record it; counters that record none drop out."""
    return (raw.groupBy("counter_id").agg(F.min("envelope_tokens").alias("envelope_tokens"))
            .where(F.col("envelope_tokens").isNotNull()))
