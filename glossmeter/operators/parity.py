"""Parity tables: tokenization lengths of every language, unknown shares, relative lengths."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from glossmeter import dims
from glossmeter.functions import text as T
from glossmeter.functions.numbers import fixed, ratio


@dataclass(frozen=True)
class ParityTokenizer:
    """Additive tokenizer of the parity tables.

    ``known_chars`` counts the characters that survive decoding without the unknown token;
    None means the tokenizer has no unknown token.
    """

    name: str
    expr: Callable[[Column], Column]
    joiner: int
    known_chars: Callable[[Column], Column] | None = None


def parity_lengths(units: DataFrame, tokenizers: Sequence[ParityTokenizer]) -> DataFrame:
    """(lang, tokenizer, n_tokens, n_unknown) of the joined text of each language, long."""
    text = F.col("text")
    cols, aggs = [F.char_length(text).cast("bigint").alias("_len")], [F.sum("_len").alias("_len"),
                                                                     F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(tokenizers):
        cols.append(t.expr(text).alias(f"_t{i}"))
        aggs.append(F.sum(f"_t{i}").alias(f"_t{i}"))
        if t.known_chars:
            cols.append(t.known_chars(text).alias(f"_k{i}"))
            aggs.append(F.sum(f"_k{i}").alias(f"_k{i}"))
    sums = units.select("lang", *cols).groupBy("lang").agg(*aggs)
    spaces = F.col("_n") - 1
    entries = []
    for i, t in enumerate(tokenizers):
        tokens = (F.col(f"_t{i}") + spaces * t.joiner).cast("bigint")
        unknown = F.lit(0).cast("bigint")
        if t.known_chars:
            unknown = T.unknown_count(tokens, F.col("_len") + spaces, F.col(f"_k{i}") + spaces)
        entries.append(F.struct(F.lit(t.name).alias("tokenizer"), F.lit(i).alias("ord"),
                                tokens.alias("n_tokens"), unknown.alias("n_unknown")))
    return sums.select("lang", F.explode(F.array(*entries)).alias("_e")).select("lang", "_e.*")


def named(lengths: DataFrame, language_map: DataFrame) -> DataFrame:
    """Language codes to names; codes without a name drop out."""
    return lengths.join(language_map.select("lang", F.trim("language").alias("language")), "lang")


def with_unknown_share(lengths: DataFrame) -> DataFrame:
    return lengths.withColumn("unknown_fraction", ratio(F.col("n_unknown"), F.col("n_tokens")))


def masked(lengths: DataFrame, limit: float = dims.UNKNOWN_LIMIT) -> DataFrame:
    """Lengths with the cells of too large an unknown share set to null."""
    shares = with_unknown_share(lengths)
    return shares.withColumn("n_tokens", F.when(F.col("unknown_fraction") > limit, None).otherwise(F.col("n_tokens")))


def relative(lengths: DataFrame, targets: Mapping[str, str], default: str = dims.TARGET_DEFAULT) -> DataFrame:
    """Every length over the length of its tokenizer's own target language.

    A masked or missing target cell makes the whole column null.
    """
    target = F.lit(default)
    for name, language in targets.items():
        target = F.when(F.col("tokenizer") == name, F.lit(language)).otherwise(target)
    cells = lengths.withColumn("target_language", target)
    base = (lengths.withColumn("_target", target).where(F.col("language") == F.col("_target"))
            .select("tokenizer", F.col("n_tokens").alias("_base")))
    return (cells.join(base, "tokenizer", "left")
            .withColumn("relative", ratio(F.col("n_tokens"), F.col("_base"))).drop("_base"))


def wide(cells: DataFrame, tokenizers: Sequence[str], value: str = "n_tokens") -> DataFrame:
    """One row per language, one column per tokenizer."""
    return cells.groupBy("language").pivot("tokenizer", list(tokenizers)).agg(F.max(value))


def cheapest(cells: DataFrame, tokenizer: str, k: int = 50) -> DataFrame:
    """The k languages with the smallest relative length under one tokenizer."""
    return (cells.where((F.col("tokenizer") == tokenizer) & F.col("relative").isNotNull())
            .orderBy("relative", "language").limit(k).select("language", "tokenizer", "relative"))


def print_pages(cells: DataFrame, rows_per_page: int = 68, columns_per_page: int = 11) -> DataFrame:
    """Cells of the printed table: page, place and text; two column halves, three row bands.

    Row order is by language name. The window runs over the list of languages, a dimension.
    """
    names = cells.select("language").distinct().withColumn(
        "row", (F.row_number().over(Window.orderBy("language")) - 1).cast("bigint"))
    band = F.least(F.floor(F.col("row") / rows_per_page), F.lit(2))
    half = F.when(F.col("ord") < columns_per_page, 0).otherwise(1)
    return (cells.join(names, "language")
            .select((band * 2 + half + 1).cast("bigint").alias("page"), "row", "language", "tokenizer",
                    F.coalesce(fixed(F.col("relative"), 2), F.lit("---")).alias("cell")))
