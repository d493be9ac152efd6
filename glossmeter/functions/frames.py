"""The fixed frame that an endpoint wraps around each text, told from single-character probes.

What a probe costs beyond its one token is the frame, or more if its character takes several
tokens. So the cheapest probes show the frame, provided that enough of them are equally cheap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from glossmeter import dims


@dataclass(frozen=True)
class Frame:
    tokens: int
    probes: int
    agreeing: int

    @property
    def verdict(self) -> str:
        if self.agreeing < dims.ENVELOPE_MIN_AGREEING:
            return "ambiguous"
        return "ok" if 0 <= self.tokens <= dims.ENVELOPE_MAX_PLAUSIBLE else "implausible"


def settle(beyond: Mapping[str, int]) -> Frame:
    """Frame from {probe: tokens beyond its one}."""
    votes = Counter(beyond.values())
    tokens = min(votes)
    return Frame(tokens, len(beyond), votes[tokens])


def settle_rows(probes: DataFrame, group: Sequence[str], tokens: str = "n_tokens") -> DataFrame:
    """The same for rows (group, probe, tokens): one row per group, from one pass over the probes."""
    votes = (probes.groupBy(*group, (F.col(tokens) - dims.ENVELOPE_PROBE_TOKENS).alias("_beyond"))
             .agg(F.count(F.lit(1)).alias("_votes")))
    found = votes.groupBy(*group).agg(F.min("_beyond").alias("envelope_tokens"), F.sum("_votes").alias("n_probes"),
                                      F.min_by("_votes", "_beyond").alias("n_agreeing"))
    return found.withColumn("verdict", _verdict(F.col("envelope_tokens"), F.col("n_agreeing")))


def _verdict(tokens: Column, agreeing: Column) -> Column:
    return (F.when(agreeing < dims.ENVELOPE_MIN_AGREEING, "ambiguous")
            .when(tokens.between(0, dims.ENVELOPE_MAX_PLAUSIBLE), "ok").otherwise("implausible"))
