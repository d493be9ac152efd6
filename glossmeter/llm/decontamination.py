"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted similarity.

A document is contaminated by an item of n words if one of its windows of n words (or the whole of a
shorter document) has a weighted Jaccard similarity of at least 0.8 with it, over the multisets of
five-word shingles, a shingle weighing as many as it has characters, and their 64-bit SimHash fingerprints,
of the same weights, differ in at most RADIUS bits. Fingerprints are cut into RADIUS + 1 blocks: two
within the radius agree in a whole block, so an equi-join on (item, block, bits) misses none. Survivors
are verified exactly.

Windows are made only where they can pass. A window that passes lacks at most a fifth of the item's weight,
so it holds one of the item's rarest shingles that together weigh more than that: documents are scanned
for those, which are few, and broadcast only while they are. For the documents found, a window is
fingerprinted if the item's shingles in it weigh enough.

Defined results: null and empty texts have no windows; items of fewer than five words are too short to be
told from chance and match nothing; repeated rows of a document are one; equal items each match; documents
without an id are matched under the null id; empty tables give an empty result. Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmeter.llm.common import SPACES, checked_broadcast, documents, free_name
from glossmeter.stage import staged

WIDTH = 5
#: Least weighted similarity, in hundredths, and most differing bits.
PERCENT, RADIUS = 80, 15
_BLANKS = " \t\n\x0b\x0c\r"
_LANES = (1 << 32) | 1


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(_BLANKS)), SPACES)


def _each(array: Column, of) -> Column:
    """An expression of an array that is evaluated once."""
    return F.transform(F.array(array), of)[0]


def _windows(w: Column, of) -> Column:
    n = F.size(w)
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), of)).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column) -> Column:
    """Hash of each five-word shingle, in order."""
    return _each(words(text), lambda w: _windows(w, lambda i: F.xxhash64(*[w[i + k] for k in range(WIDTH)])))


def shingle_weights(text: Column) -> Column:
    """Characters of each five-word shingle, in order."""
    return _each(words(text), lambda w: _windows(w, lambda i: sum((F.char_length(w[i + k]) for k in range(1, WIDTH)), F.char_length(w[i])).cast("bigint")))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit SimHash of the weighted hashes of each key: columns `hash` and `weight` in, `print` out.

    The votes for bits k and k + 32 are counted in the two halves of one number.
    """
    votes = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"_{k}") for k in range(32)]
    counted = rows.groupBy(*keys).agg(F.sum("weight").alias("_all"), *votes)

    def bit(votes: Column, k: int) -> Column:
        return F.when(2 * votes > F.col("_all"), F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))

    whole = F.lit(0).cast("bigint")
    for k in range(32):
        whole = whole.bitwiseOR(bit(F.col(f"_{k}").bitwiseAND(F.lit((1 << 32) - 1)), k)).bitwiseOR(bit(F.shiftrightunsigned(f"_{k}", 32), k + 32))
    return counted.select(*keys, whole.alias("print"))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(number, bits) of radius + 1 blocks of near equal width."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, size, hash, weight, times, total): the distinct shingles of each item."""
    text = items.where("item_id is not null").select("item_id", "text").distinct()
    rows = (text.select("item_id", F.size(words(F.col("text"))).alias("size"),
                        F.explode(F.arrays_zip(shingle_hashes(F.col("text")).alias("h"), shingle_weights(F.col("text")).alias("w"))).alias("s"))
            .select("item_id", "size", F.col("s.h").alias("hash"), F.col("s.w").alias("weight"))
            .groupBy("item_id", "size", "hash", "weight").agg(F.count("*").alias("times")))
    return rows.withColumn("total", F.sum(F.col("weight") * F.col("times")).over(Window.partitionBy("item_id", "size")))


def telling(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rarest shingles of each item of which a window that passes holds at least one: (hash, item_id, size)."""
    common = shingles.groupBy("hash").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item_id", "size").orderBy("items", "hash", "weight").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("weight") * F.col("times")).over(order), F.lit(0))
    return (shingles.join(common, "hash").withColumn("_before", before)
            .where(100 * F.col("_before") <= (100 - percent) * F.col("total")).select("hash", "item_id", "size"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Best window of each contaminated (document, item): (doc_id, text_hash, item_id, start_word, n_words, distance, similarity)."""
    docs = docs.select("doc_id", "text").where("text is not null")
    shingles = staged(item_shingles(items))
    rare = staged(telling(shingles, percent))
    # one pass over all texts
    asked = checked_broadcast(staged(rare.select("hash").distinct()))
    key = F.xxhash64("text").alias("_text")
    met = (docs.select("doc_id", key, F.explode(shingle_hashes(F.col("text"))).alias("hash")).join(asked, "hash")
           .select("doc_id", "_text", "hash").distinct())
    pairs = staged(met.join(rare, "hash").select("doc_id", "_text", "item_id", "size").distinct())
    # the shingles of the documents found
    ids = staged(pairs.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).distinct())
    wanted = docs.join(checked_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_semi")
    found = staged(wanted.select("doc_id", key, F.size(words(F.col("text"))).alias("n"), shingle_hashes(F.col("text")).alias("h"),
                                 shingle_weights(F.col("text")).alias("w")).dropDuplicates(["doc_id", "_text"]))
    # windows in which the item's shingles weigh enough
    shingle = found.select("doc_id", "_text", "n", F.posexplode(F.arrays_zip("h", "w")).alias("at", "s")) \
        .select("doc_id", "_text", "n", "at", F.col("s.h").alias("hash"), F.col("s.w").alias("weight"))
    same_doc = F.col("p._text").eqNullSafe(F.col("f._text")) & F.col("p.doc_id").eqNullSafe(F.col("f.doc_id"))
    hits = (shingle.alias("f").join(checked_broadcast(pairs).alias("p"), same_doc)
            .join(checked_broadcast(shingles.select("item_id", "size", "hash", "total")).alias("i"),
                  (F.col("p.item_id") == F.col("i.item_id")) & (F.col("p.size") == F.col("i.size")) & (F.col("f.hash") == F.col("i.hash")))
            .select("f.doc_id", "f._text", "f.n", "f.at", "f.weight", "p.item_id", "p.size", "i.total"))
    low = F.greatest(F.col("at") - F.col("size") + WIDTH, F.lit(0))
    high = F.least(F.col("at"), F.greatest(F.col("n") - F.col("size"), F.lit(0)))
    windows = staged(hits.select("doc_id", "_text", "item_id", "size", "total", "weight", F.explode(
        F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("start"))
        .groupBy("doc_id", "_text", "item_id", "size", "total", "start").agg(F.sum("weight").alias("_met"))
        .where(100 * F.col("_met") >= percent * F.col("total")).drop("_met"))
    # their fingerprints and the items'
    name = ["doc_id", "_text", "item_id", "size", "start"]
    inside = staged(checked_broadcast(windows).alias("p").join(found.alias("f"), same_doc)
                    .select("p.doc_id", "p._text", "p.item_id", "p.size", "p.start", "p.total",
                            F.slice(F.arrays_zip("f.h", "f.w"), F.col("p.start") + 1, F.col("p.size") - WIDTH + 1).alias("s")))
    prints = fingerprints(inside.select(*name, F.explode("s").alias("s")).select(*name, F.col("s.h").alias("hash"), F.col("s.w").alias("weight")), name)
    known = fingerprints(shingles.select("item_id", "size", "hash", (F.col("weight") * F.col("times")).alias("weight")), ["item_id", "size"])
    indexed = prints.select(*name, "print", F.explode(blocks(F.col("print"), radius)).alias("b")).select(*name, "print", "b.*")
    index = known.select("item_id", "size", F.col("print").alias("_item"), F.explode(blocks(F.col("print"), radius)).alias("b")) \
        .select("item_id", "size", "_item", "b.*")
    near = staged(indexed.join(index, ["item_id", "size", "block", "bits"])
                  .select(*name, F.bit_count(F.col("print").bitwiseXOR(F.col("_item"))).alias("distance"))
                  .where(F.col("distance") <= radius).distinct())
    # the exact similarity of the survivors; their shingles are dealt once, before they are unfolded
    window = [*name, "total", "distance"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in name]
    met = (inside.alias("a").join(checked_broadcast(near).alias("n"), same).select("a.*", "n.distance").repartition(*name)
           .select(*window, F.explode("s").alias("s")).select(*window, F.col("s.h").alias("hash"), F.col("s.w").alias("weight"))
           .groupBy(*window, "hash", "weight").agg(F.count("*").alias("here")))
    of_item = checked_broadcast(shingles.select("item_id", "size", "hash", "times"))
    scored = (met.join(of_item, ["item_id", "size", "hash"], "left").groupBy(*window)
              .agg(F.sum(F.col("weight") * F.least("here", F.coalesce("times", F.lit(0)))).alias("_both"),
                   F.sum(F.col("weight") * F.col("here")).alias("_window"))
              .withColumn("_union", F.col("_window") + F.col("total") - F.col("_both"))
              .where(100 * F.col("_both") >= percent * F.col("_union"))
              .withColumn("similarity", F.col("_both") / F.col("_union")))
    best = scored.groupBy("doc_id", "_text", "item_id").agg(
        F.max_by(F.struct("start", "size", "distance", "similarity"), F.struct("similarity", -F.col("start"), F.col("size"))).alias("b"))
    return best.select("doc_id", F.col("_text").alias("text_hash"), "item_id", F.col("b.start").cast("long").alias("start_word"), F.col("b.size").cast("long").alias("n_words"),
                       F.col("b.distance").cast("long").alias("distance"), F.col("b.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that no item contaminates, with their columns, whatever these are called."""
    own, text = free_name(docs, "_bad_id"), free_name(docs, "_bad_text")
    bad = staged(contaminated(docs, items).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct())
    return docs.join(checked_broadcast(bad), F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def decontaminate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
