"""Which counters give identical content totals, and where that can be said.

Inputs are content totals: one row per corpus x counter x language, so their number is fixed
by the configuration. Pairs come from equi-joins on equal totals, never from a product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _signatures(content: DataFrame) -> DataFrame:
    """Per corpus and counter: its totals in language order, and whether it covers the corpus."""
    rows = content.groupBy("corpus", "counter_id").agg(
        F.array_sort(F.collect_list(F.struct("lang", "content_tokens"))).alias("totals"))
    every = content.groupBy("corpus").agg(F.count_distinct("lang").alias("_all"))
    return rows.join(every, "corpus").select(
        "corpus", "counter_id", "totals", F.col("totals.lang").alias("langs"),
        (F.size("totals") == F.col("_all")).alias("complete"))


def identical_pairs(content: DataFrame) -> DataFrame:
    """Counter pairs with equal totals in every language of a corpus."""
    sig = _signatures(content).where("complete")
    a = sig.select("corpus", F.col("counter_id").alias("counter_a"), "totals")
    b = sig.select("corpus", F.col("counter_id").alias("counter_b"), "totals")
    return (a.join(b, ["corpus", "totals"]).where(F.col("counter_a") < F.col("counter_b"))
            .select("corpus", "counter_a", "counter_b", F.size("totals").cast("bigint").alias("n_langs")))


def incomparable_pairs(content: DataFrame) -> DataFrame:
    """Pairs that agree wherever both were measured but cover different languages.

    Not evidence of a shared tokenizer, so they are listed apart.
    """
    cells = content.select("corpus", "lang", "content_tokens", "counter_id")
    a, b = cells.withColumnRenamed("counter_id", "counter_a"), cells.withColumnRenamed("counter_id", "counter_b")
    equal = (a.join(b, ["corpus", "lang", "content_tokens"]).where(F.col("counter_a") < F.col("counter_b"))
             .groupBy("corpus", "counter_a", "counter_b")
             .agg(F.sort_array(F.collect_set("lang")).alias("_same")))
    sig = _signatures(content)
    for side in ("a", "b"):
        equal = equal.join(sig.select("corpus", F.col("counter_id").alias(f"counter_{side}"),
                                      F.col("langs").alias(f"_langs_{side}"),
                                      F.col("complete").alias(f"_complete_{side}")),
                           ["corpus", f"counter_{side}"])
    shared = F.array_intersect("_langs_a", "_langs_b")
    return (equal.where(~(F.col("_complete_a") & F.col("_complete_b")))
            .where(F.size("_same") == F.size(shared))
            .select("corpus", "counter_a", "counter_b", F.array_join("_same", ",").alias("identical_on")))


def shared_pairs(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """Identical pairs with the corpora they hold in; ``everywhere`` only if that is all of them."""
    n = content.agg(F.count_distinct("corpus")).scalar()
    by_pair = pairs.groupBy("counter_a", "counter_b").agg(F.sort_array(F.collect_set("corpus")).alias("_c"))
    return by_pair.select(
        "counter_a", "counter_b", F.array_join("_c", ",").alias("corpora"),
        (F.size("_c") == n).alias("everywhere"))


def fold_identity(content: DataFrame, counters: DataFrame) -> DataFrame:
    """For every folded counter and corpus: are its totals those of its flagship?

    A language one of the two lacks makes the answer no.
    """
    folds = counters.where(F.col("flagship_group") != "").select("counter_id", "flagship_group")
    cells = content.select("corpus", "counter_id", "lang", "content_tokens")
    member = cells.join(folds, "counter_id")
    flag = cells.select("corpus", F.col("counter_id").alias("flagship_group"), "lang",
                        F.col("content_tokens").alias("_flag"))
    langs = cells.groupBy("corpus").agg(F.count_distinct("lang").alias("_all"))
    agree = (member.join(flag, ["corpus", "flagship_group", "lang"], "left")
             .groupBy("corpus", "counter_id", "flagship_group")
             .agg(F.count_if(F.col("content_tokens") == F.col("_flag")).alias("_same")))
    return agree.join(langs, "corpus").select(
        "corpus", "counter_id", "flagship_group", (F.col("_same") == F.col("_all")).alias("identical"))
