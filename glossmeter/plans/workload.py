"""The registered workload: the analytics over the given tables.

``documents`` is read as two registers (short and long source names) in four languages, with
English as the baseline; position in a register and language is the order of ``doc_id``.
Languages have different numbers of documents, so coverage is ragged, as in a corpus under
construction. The counters are exact column expressions; two of them stand for endpoints
that wrap each call in a fixed frame and are sampled on the head of a corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.counters import TextCounter, byte_counter, code_point_counter, word_counter
from glossmeter.dims import Counter, Dimensions, Price
from glossmeter.functions import text as T
from glossmeter.operators import charts, coincidence, cost, measure, parity, premium, slices
from glossmeter.sources.tables import keyed_units, numbered, parse_records
from glossmeter.stage import spread, staged

MEASURED_ON = "2026-10-19"

LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
CORPORA = {"core": "Core sources", "extended": "Extended sources"}

MATRIX = (
    Counter("words", "Word runs", "native", "native", "live", "words", headline_display="Words"),
    Counter("utf32", "UTF-32 code points", "native", "native", "live", "utf32",
            headline_display="Code points", family_display="Code points / API / lite"),
    Counter("utf32-api", "Code points API (shared)", "native", "native", "live", "utf32-api",
            False, "Code points API", "", "utf32", "shared"),
    Counter("utf32-lite", "Code points lite", "native", "native", "live", "utf32-lite",
            False, "", "", "utf32", "shared"),
    Counter("utf8", "UTF-8 bytes", "native", "native", "live", "utf8", headline_display="Bytes"),
    Counter("utf8-api", "Bytes API (shared)", "native", "native", "live", "utf8-api",
            False, "Bytes API", "", "utf8", "shared"),
)
PRICES = (
    Price("words", None, "2026-10-19", "unknown"),
    Price("utf32", 2.00, "2026-10-19", "high"),
    Price("utf32-api", 10.00, "2026-10-19", "high"),
    Price("utf32-lite", 0.10, "2026-10-01", "high"),
    Price("utf8", 0.75, "2026-09-30", "medium"),
    Price("utf8-api", 0.30, "2026-10-19", "high"),
)
SLOTS = {"utf32": 0, "words": 3, "utf8": 7}
_STEPS = {"utf32-api": "#0059b5", "utf32-lite": "#5e99e5", "utf8-api": "#f06d67"}

DIMS = Dimensions(languages=LANGUAGES, baseline="en", lead="fr", corpora=CORPORA, preferred_corpus="core",
                  counters=MATRIX, prices=PRICES, published={}, published_counter="utf32", slots=SLOTS,
                  tints={"light": _STEPS, "dark": _STEPS})


def _lite(text):
    """Code points in one register, bytes in the other: coincides with each in one corpus only."""
    return F.when(F.col("corpus") == "core", T.char_count(text)).otherwise(T.byte_count(text))


COUNTERS = (
    word_counter("words"),
    code_point_counter("utf32"),
    code_point_counter("utf32-api", spec="utf32-api", frame=8, is_api=True),
    TextCounter("utf32-lite", "utf32-lite", _lite, 1),
    byte_counter("utf8"),
    byte_counter("utf8-api", spec="utf8-api", frame=6, is_api=True),
)
# Measured in all languages but one; not part of the matrix.
RAGGED = code_point_counter("utf32-partial", spec="utf32-partial", covers=lambda: F.col("lang") != "es")

# Tokenizers of the parity tables; the third knows ASCII only, the rest have no unknown token.
PARITY = (
    parity.ParityTokenizer("UTF-32", T.char_count, 1),
    parity.ParityTokenizer("ByT5", T.byte_count, 1),
    parity.ParityTokenizer("ASCII", T.char_count, 1, T.ascii_count),
    parity.ParityTokenizer("Words", T.word_count, 0),
)
PARITY_NAMES = [t.name for t in PARITY]
PARITY_TARGETS = {"ByT5": "French src3", "ASCII": "English src2"}
PARITY_DEFAULT = "English src0"


@dataclass
class Workload:
    """Base frames over one data folder, built on demand and lazily."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def units(self) -> DataFrame:
        """Normalised units with their key, not numbered."""
        register = F.when(F.length("source") <= 4, "core").otherwise("extended")
        rows = keyed_units(self.documents, register, F.col("lang"), "doc_id")
        return rows.withColumn("text", T.nfc(F.col("text")))

    @cached_property
    def counted(self) -> DataFrame:
        """One narrow row per unit with all counts, numbered."""
        return numbered(measure.count_units(self.units, COUNTERS, ["corpus", "lang", "unit_key"]))

    @cached_property
    def staged(self) -> DataFrame:
        """``counted`` as a written table, for queries that use it more than once.

        The text is scanned once; everything after reads narrow counts.
        """
        return staged(self.counted)

    @cached_property
    def raw(self) -> DataFrame:
        return measure.raw_counts(self.counted, COUNTERS, MEASURED_ON)

    @cached_property
    def agg(self) -> DataFrame:
        return measure.aggregate_counts(self.units, COUNTERS, MEASURED_ON)

    @cached_property
    def totals(self) -> DataFrame:
        """``agg`` as a written table: the few rows all later tables and charts start from."""
        return staged(self.agg)

    @cached_property
    def sizes(self) -> DataFrame:
        return staged(measure.corpus_sizes(self.units, DIMS.baseline))

    @cached_property
    def frames(self) -> DataFrame:
        return self.spark.createDataFrame([(c.counter_id, c.frame) for c in (*COUNTERS, RAGGED)],
                                          "counter_id string, envelope_tokens bigint")

    @cached_property
    def content(self) -> DataFrame:
        return measure.content_totals(self.totals, self.frames)

    @cached_property
    def totals_with_ragged(self) -> DataFrame:
        return staged(measure.aggregate_counts(self.units, (*COUNTERS, RAGGED), MEASURED_ON))

    @cached_property
    def content_with_ragged(self) -> DataFrame:
        return measure.content_totals(self.totals_with_ragged, self.frames)

    @cached_property
    def languages(self) -> DataFrame:
        return DIMS.languages_df(self.spark)

    @cached_property
    def counters(self) -> DataFrame:
        return DIMS.counters_df(self.spark)

    @cached_property
    def prices(self) -> DataFrame:
        return DIMS.prices_df(self.spark)

    @cached_property
    def corpora(self) -> DataFrame:
        return DIMS.corpora_df(self.spark)

    @cached_property
    def fills(self) -> DataFrame:
        return DIMS.fills_df(self.spark)

    @cached_property
    def ratios(self) -> DataFrame:
        return premium.unit_ratios(self.counted, COUNTERS, DIMS.baseline)

    @cached_property
    def premium(self) -> DataFrame:
        return premium.aggregate_premium(self.totals, self.languages, DIMS.baseline)

    @cached_property
    def cost(self) -> DataFrame:
        return cost.cost_table(self.totals, self.sizes, self.prices, self.languages)

    @cached_property
    def costs(self) -> DataFrame:
        """``cost`` as a written table, for charts that look at it from several sides."""
        return staged(self.cost)

    @cached_property
    def priced_order(self) -> DataFrame:
        return charts.priced_order(self.costs, self.counters, self.corpora, DIMS.lead)

    @cached_property
    def headline_order(self) -> DataFrame:
        return charts.headline_order(self.premium, self.counters, self.corpora, DIMS.lead)

    @cached_property
    def pairs(self) -> DataFrame:
        return coincidence.identical_pairs(self.content)

    @cached_property
    def folds(self) -> DataFrame:
        return coincidence.fold_identity(self.content, self.counters)

    # -- parity tables: every (language, source) is one row ----------------------------------

    @cached_property
    def parity_units(self) -> DataFrame:
        return self.documents.select(F.concat_ws("_", "lang", "source").alias("lang"),
                                     T.nfc(F.col("text")).alias("text"))

    @cached_property
    def language_map(self) -> DataFrame:
        """A name for every code."""
        return self._names(self.table("documents"))

    @cached_property
    def labelled_map(self) -> DataFrame:
        """Names of the codes that have a labelled document."""
        return self._names(self.table("documents").join(self.table("labels").select("doc_id"), "doc_id", "left_semi"))

    def _names(self, docs: DataFrame) -> DataFrame:
        name = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.col("lang"))
        return docs.select(F.concat_ws("_", "lang", "source").alias("lang"),
                           F.concat_ws(" ", name, "source").alias("language")).distinct()

    @cached_property
    def lengths(self) -> DataFrame:
        return staged(parity.named(parity.parity_lengths(self.parity_units, PARITY), self.language_map))

    @cached_property
    def relative(self) -> DataFrame:
        return parity.relative(parity.masked(self.lengths), PARITY_TARGETS, PARITY_DEFAULT)

    # -- conversations as records of three locales --------------------------------------------

    @cached_property
    def record_lines(self) -> DataFrame:
        """JSON lines, one per turn; the role is the locale and the turn the place in the file.

        Opening turns have their line breaks replaced; later ones keep them and are dropped.
        """
        utt = F.when(F.col("turn") < 2, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
        record = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("locale"),
                          F.when(F.col("turn") <= 3, "dev").otherwise("test").alias("partition"), utt.alias("utt"))
        return self.table("conversations").select(F.to_json(record).alias("value"), F.col("turn").alias("pos"))

    @cached_property
    def utterances(self) -> DataFrame:
        """Clean utterances as a written table; the slice looks at them twice."""
        return staged(slices.clean_utterances(parse_records(self.record_lines)))
