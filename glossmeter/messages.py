"""Message catalogue of the charts in two locales, its checks, and filled-in messages."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The sentences of the charts. Whole sentences, never fragments, since word order
# and plurals differ between locales.
MESSAGES = {
    "en": {
        "ylabel_usd_per_1m_chars": "USD per 1,000,000 input characters",
        "ylabel_usd_per_1k_units": "USD per 1,000 {unit}s",
        "ylabel_tokens_per_1k_chars": "Tokens per 1,000 NFC characters",
        "xlabel_vi_ladder": "USD per 1,000 {unit}s of Vietnamese input",
        "xlabel_dumbbell": "USD per 1,000 {unit}s — same content, both languages",
        "title_heatmap": "Tokens the same {unit} needs, compared with English",
        "title_cost_driver": "Cost driver: tokens per 1,000 characters — {corpus} (lower = cheaper)",
        "title_dollar_chars": "Serving cost: USD per 1M input characters — {corpus} (price × tokens; lower = cheaper)",
        "title_dollar_units": "Serving cost: USD per 1,000 {unit}s — {corpus} (price × tokens per {unit}; lower = cheaper)",
        "title_vi_ladder": "What serving Vietnamese costs — {corpus} ({spread}× between the cheapest and dearest tier)",
        "title_vi_tax": "The Vietnamese tax in money — {corpus} (each line is what the same content costs extra in Vietnamese)",
        "cbar_premium": "× English tokens (1.00 = same as English)",
        "legend_baseline_lang": "English (same content)",
        "legend_lead_lang": "Vietnamese",
        "cap_corpus": "Data: {corpus}, the same content in each language",
        "cap_shared_tokenizer": "{names}: identical token counts (one shared tokenizer)",
        "cap_cl100k": "{label}: the 2023 tokenizer, shown for comparison",
        "cap_price_confidence": "Not every price is high-confidence — {named}",
        "cap_same_tokens": "Same tokens, different price: {parts} (per 1M input tokens)",
        "confidence_high": "high",
        "confidence_medium": "medium",
        "confidence_low": "low",
        "confidence_unknown": "unknown",
        "cap_unpriced": "{names} omitted — no serving list price",
        "cap_usd_per_1m_chars": "USD to serve 1,000,000 input characters — input list price ({as_of}); VND = USD × {rate}",
        "cap_usd_per_1k_units": "USD to serve 1,000 {unit}s — parallel corpus, so the SAME content across languages "
                                "(price × tokens per {unit}); input list price ({as_of}); VND = USD × {rate}",
        "cap_read_against": "Read against the per-character chart: a dense script (Chinese) needs few characters, so "
                            "per-character overstates its cost; per {unit} it ranks far lower.",
        "cap_dumbbell_gaps": "Widest gap: {widest}, +{widest_delta} per 1,000 {unit}s ({widest_ratio}×). Steepest ratio: "
                             "{steepest} at {steepest_ratio}× — only +{steepest_delta}, because a cheap model with an "
                             "inefficient tokenizer is costly in proportion and small in money.",
        "cap_dumbbell_axes": "The two are different axes: the tokenizer sets the ratio, the serving tier sets the size of "
                             "the bill it applies to.",
    },
    "vi": {
        "ylabel_usd_per_1m_chars": "USD trên 1.000.000 ký tự đầu vào",
        "ylabel_usd_per_1k_units": "USD trên 1.000 {unit}",
        "ylabel_tokens_per_1k_chars": "Token trên 1.000 ký tự NFC",
        "xlabel_vi_ladder": "USD trên 1.000 {unit} đầu vào tiếng Việt",
        "xlabel_dumbbell": "USD trên 1.000 {unit} — cùng một nội dung, cả hai ngôn ngữ",
        "title_heatmap": "Mỗi {unit} cần bao nhiêu token so với tiếng Anh",
        "title_cost_driver": "Yếu tố sinh chi phí: token trên 1.000 ký tự — {corpus} (thấp hơn = rẻ hơn)",
        "title_dollar_chars": "Chi phí phục vụ: USD trên 1 triệu ký tự đầu vào — {corpus} (giá × số token; thấp hơn = rẻ hơn)",
        "title_dollar_units": "Chi phí phục vụ: USD trên 1.000 {unit} — {corpus} (giá × số token mỗi {unit}; thấp hơn = rẻ hơn)",
        "title_vi_ladder": "Phục vụ tiếng Việt tốn bao nhiêu — {corpus} (chênh {spread}× giữa bậc rẻ nhất và bậc đắt nhất)",
        "title_vi_tax": "Thuế tiếng Việt tính bằng tiền — {corpus} (mỗi đoạn nối là phần cùng một nội dung tốn thêm khi viết "
                        "bằng tiếng Việt)",
        "cbar_premium": "× số token tiếng Anh (1,00 = ngang bằng)",
        "legend_baseline_lang": "Tiếng Anh (cùng nội dung)",
        "legend_lead_lang": "Tiếng Việt",
        "cap_corpus": "Dữ liệu: {corpus}, nội dung tương đương ở mọi ngôn ngữ",
        "cap_shared_tokenizer": "{names}: số token giống hệt nhau (dùng chung bộ tách token)",
        "cap_cl100k": "{label}: bộ tách token năm 2023, để so sánh",
        "cap_price_confidence": "Không phải mọi mức giá đều độ tin cậy cao — {named}",
        "cap_same_tokens": "Cùng số token, khác giá: {parts} (trên 1 triệu token đầu vào)",
        "confidence_high": "cao",
        "confidence_medium": "trung bình",
        "confidence_low": "thấp",
        "confidence_unknown": "chưa rõ",
        "cap_unpriced": "{names} được bỏ ra ngoài — không có giá niêm yết để phục vụ",
        "cap_usd_per_1m_chars": "USD để phục vụ 1.000.000 ký tự đầu vào — giá niêm yết đầu vào ({as_of}); VND = USD × {rate}",
        "cap_usd_per_1k_units": "USD để phục vụ 1.000 {unit} — kho ngữ liệu song song, nên là CÙNG MỘT nội dung trên mọi ngôn "
                                "ngữ (giá × số token mỗi {unit}); giá niêm yết đầu vào ({as_of}); VND = USD × {rate}",
        "cap_read_against": "Đọc cùng biểu đồ tính theo ký tự: một hệ chữ cô đọng (tiếng Trung) cần ít ký tự, nên cách tính "
                            "theo ký tự thổi phồng chi phí của nó; tính theo {unit} thì nó xếp thấp hơn hẳn.",
        "cap_dumbbell_gaps": "Khoảng cách lớn nhất: {widest}, +{widest_delta} trên 1.000 {unit} ({widest_ratio}×). Tỷ lệ dốc "
                             "nhất: {steepest} ở {steepest_ratio}× — nhưng chỉ +{steepest_delta}, vì một mô hình rẻ với bộ "
                             "tách token kém hiệu quả thì tốn kém về tỷ lệ và nhỏ về tiền.",
        "cap_dumbbell_axes": "Đây là hai trục khác nhau: bộ tách token định ra tỷ lệ, còn bậc phục vụ định ra độ lớn của hóa "
                             "đơn mà tỷ lệ ấy áp lên.",
    },
}
LANGUAGE_NAMES = {
    "en": {"eng_Latn": "English", "vie_Latn": "Vietnamese", "zho_Hans": "Chinese (Simplified)", "rus_Cyrl": "Russian",
           "deu_Latn": "German"},
    "vi": {"eng_Latn": "Tiếng Anh", "vie_Latn": "Tiếng Việt", "zho_Hans": "Tiếng Trung (giản thể)", "rus_Cyrl": "Tiếng Nga",
           "deu_Latn": "Tiếng Đức"},
}
UNITS = {"en": {"flores": "sentence", "massive": "message"}, "vi": {"flores": "câu", "massive": "tin nhắn"}}
# End of fixed values.


def catalogue_df(spark: SparkSession, messages: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The catalogue as a table (locale, key, text)."""
    rows = [(locale, key, text) for locale, entries in (messages or MESSAGES).items() for key, text in entries.items()]
    return spark.createDataFrame(rows, "locale string, key string, text string")


def catalogue_problems(catalogue: DataFrame, locales: Sequence[str] = tuple(MESSAGES), base: str = "en") -> DataFrame:
    """(locale, key, problem): keys missing or unknown, other placeholders than the base, empty text."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{(\w+)\}"), F.lit(1))))
    by_key = catalogue.withColumn("names", names).groupBy("key").agg(
        F.collect_set("locale").alias("have"),
        F.max(F.when(F.col("locale") == base, F.col("names"))).alias("base_names"),
        F.collect_list(F.struct("locale", "names", "text")).alias("cells"))
    in_base = F.array_contains("have", base)
    missing = by_key.where(in_base).select(
        F.explode(F.array_except(F.array(*[F.lit(l) for l in locales]), F.col("have"))).alias("locale"), "key",
        F.lit("missing").alias("problem"))
    problem = (F.when(F.trim("c.text") == "", "empty").when(~in_base, "unknown")
               .when(F.col("c.names") != F.col("base_names"), "placeholders"))
    other = (by_key.select("key", "have", "base_names", F.explode("cells").alias("c"))
             .select(F.col("c.locale").alias("locale"), "key", problem.alias("problem")).where(F.col("problem").isNotNull()))
    return missing.unionByName(other)


def message(locale: str, key: str, **values: Column | str) -> Column:
    """A message with columns for its placeholders; an unknown key or a lacking value is an error."""
    parts = []
    for literal, name, _, _ in Formatter().parse(MESSAGES[locale][key]):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)


def confidence(grade: Column, locale: str) -> Column:
    """A price grade in the words of a locale; null for a grade without wording."""
    word = F.lit(None).cast("string")
    for name in ("high", "medium", "low", "unknown"):
        word = F.when(grade == name, MESSAGES[locale][f"confidence_{name}"]).otherwise(word)
    return word
