"""The same results in DuckDB SQL, written from the definitions and not from the Spark plans.

Joined corpora are really joined here, positions are plain window numbers, quantiles are the
engine's own, and text is counted on the joined string.
"""

from __future__ import annotations

import re
import unicodedata

from glossmeter import dims
from glossmeter.functions.colour import CVD_MATRICES
from glossmeter.functions.text import BLANK_PATTERN
from glossmeter.plans import workload as W


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_LANGS = ", ".join(f"'{l}'" for l in W.LANGUAGES)
_FAMILY = {c.counter_id: c.counter_id if c.headline else c.flagship_group for c in W.MATRIX}
_FILLS = [(theme, c, W.SLOTS[f], W.DIMS.tints[theme].get(c, series[W.SLOTS[f]]), dims.SURFACES[theme])
          for theme, series in dims.SERIES.items() for c, f in _FAMILY.items()]

# counter -> (count on a sentence, frame, measured on a head slice only). The slice is written with
# BETWEEN: DuckDB 2.0 answers "row_number() - 1 < n" over a shared CTE one row short.
_SENTENCE = {
    "words": ("words", 0, False),
    "utf32": ("utf32", 0, False),
    "utf32-api": ("utf32", 8, True),
    "utf32-lite": ("CASE WHEN corpus = 'core' THEN utf32 ELSE utf8 END", 0, False),
    "utf8": ("utf8", 0, False),
    "utf8-api": ("utf8", 6, True),
}

_WORD = r"[\p{L}\p{N}_]+"

_RAW = " UNION ALL ".join(
    f"SELECT corpus, '{c}' AS counter_id, lang, '{c}' AS spec, '{W.MEASURED_ON}' AS measured_on, sentence_idx, "
    f"CAST({n} + {frame} AS BIGINT) AS n_tokens, CAST({n} AS BIGINT) AS n_tokens_content, "
    f"CAST({frame} AS BIGINT) AS envelope_tokens, n_chars FROM counted"
    + (f" WHERE sentence_idx BETWEEN 0 AND {dims.API_SAMPLE - 1}" if api else "")
    for c, (n, frame, api) in _SENTENCE.items())

_AGG = " UNION ALL ".join(
    f"SELECT corpus, '{c}' AS counter_id, lang, '{c}' AS spec, '{W.MEASURED_ON}' AS measured_on, "
    f"CAST({n} + {frame} AS BIGINT) AS total_tokens, total_chars FROM joined_counts"
    for c, (n, frame, _) in _SENTENCE.items())

_SIMULATED = "".join(
    f" UNION ALL SELECT h, '{kind}', [" + ", ".join(
        f"least(1.0, greatest(0.0, {a}::DOUBLE * l[1] + {b}::DOUBLE * l[2] + {c}::DOUBLE * l[3]))" for a, b, c in matrix)
    + "] FROM linear" for kind, matrix in CVD_MATRICES.items())

_UNITS = r"""
units AS (
  SELECT corpus, lang, doc_id, nfc_normalize(text) AS text,
         row_number() OVER (PARTITION BY corpus, lang ORDER BY doc_id) - 1 AS sentence_idx
  FROM (SELECT *, CASE WHEN length(source) <= 4 THEN 'core' ELSE 'extended' END AS corpus FROM documents)),

counted AS (
  SELECT corpus, lang, sentence_idx, length(text) AS n_chars, length(text) AS utf32, strlen(text) AS utf8,
         len(regexp_extract_all(text, '%(word)s')) AS words FROM units),
joined AS (
  SELECT corpus, lang, string_agg(text, ' ' ORDER BY sentence_idx) AS body,
         CAST(sum(length(text)) AS BIGINT) AS total_chars FROM units GROUP BY corpus, lang),
joined_counts AS (
  SELECT corpus, lang, total_chars, length(body) AS utf32, strlen(body) AS utf8,
         len(regexp_extract_all(body, '%(word)s')) AS words FROM joined),
languages AS (SELECT * FROM (VALUES %(languages)s) t(lang, language)),
counters AS (SELECT * FROM (VALUES %(counters)s)
             t(counter_id, display, spec, headline, headline_display, family_display, flagship_group, fold_reason, ord)),
prices AS (SELECT * FROM (VALUES %(prices)s) t(counter_id, usd, as_of, confidence)),
fills AS (SELECT * FROM (VALUES %(fills)s) t(theme, counter_id, slot, fill, surface)),
labels_of AS (
  SELECT *, CASE WHEN headline_display = '' THEN display ELSE headline_display END AS label FROM counters),
sizes AS (SELECT corpus, count(*) AS n_sentences FROM units WHERE lang = 'en' GROUP BY corpus),
raw AS (%(raw)s),
agg AS (%(agg)s),
ragged AS (SELECT corpus, 'utf32-partial' AS counter_id, lang, 'utf32-partial' AS spec, '%(on)s' AS measured_on,
                  CAST(utf32 AS BIGINT) AS total_tokens, total_chars FROM joined_counts WHERE lang <> 'es'),
frames AS (SELECT counter_id, max(envelope_tokens) AS frame FROM raw GROUP BY counter_id),
content AS (SELECT a.*, a.total_tokens - coalesce(f.frame, 0) AS content_tokens
            FROM agg a LEFT JOIN frames f USING (counter_id)),
content_ragged AS (SELECT corpus, counter_id, lang, content_tokens FROM content
                   UNION ALL SELECT corpus, counter_id, lang, total_tokens FROM ragged),
premium AS (
  SELECT a.corpus, a.counter_id, a.lang, l.language,
         round_even(CAST(a.total_tokens AS DOUBLE) / nullif(b.total_tokens, 0) * 10000, 0) / 10000 AS premium_aggregate
  FROM agg a JOIN agg b ON a.corpus = b.corpus AND a.counter_id = b.counter_id AND b.lang = 'en'
  JOIN languages l ON a.lang = l.lang),
ratios AS (
  SELECT a.corpus, a.counter_id, a.lang, a.sentence_idx,
         CAST(a.n_tokens_content AS DOUBLE) / b.n_tokens_content AS ratio
  FROM raw a JOIN raw b ON a.corpus = b.corpus AND a.counter_id = b.counter_id AND a.sentence_idx = b.sentence_idx
   AND b.lang = 'en' WHERE b.n_tokens_content <> 0),
dist AS (
  SELECT corpus, counter_id, lang, count(*) AS distribution_n,
         round_even(quantile_cont(ratio, 0.5) * 10000, 0) / 10000 AS premium_median,
         round_even(quantile_cont(ratio, 0.1) * 10000, 0) / 10000 AS premium_p10,
         round_even(quantile_cont(ratio, 0.25) * 10000, 0) / 10000 AS premium_p25,
         round_even(quantile_cont(ratio, 0.75) * 10000, 0) / 10000 AS premium_p75,
         round_even(quantile_cont(ratio, 0.9) * 10000, 0) / 10000 AS premium_p90,
         round_even(avg(ratio) * 10000, 0) / 10000 AS premium_mean
  FROM ratios GROUP BY corpus, counter_id, lang),
exact_cost AS (
  SELECT a.corpus, a.counter_id, a.lang, l.language, p.usd, p.confidence,
         CAST(a.total_tokens AS DOUBLE) / a.total_chars * 1000 AS per_1k,
         CAST(a.total_tokens AS DOUBLE) / s.n_sentences AS per_sentence
  FROM agg a LEFT JOIN sizes s USING (corpus) LEFT JOIN prices p USING (counter_id) LEFT JOIN languages l USING (lang)),
cost AS (
  SELECT corpus, counter_id, lang, coalesce(language, lang || ' (retired)') AS language,
         round_even(per_1k * 100, 0) / 100 AS tokens_per_1k_chars,
         round_even(per_sentence * 100, 0) / 100 AS tokens_per_sentence,
         usd AS price_usd_per_mtok, coalesce(confidence, 'unknown') AS price_confidence,
         round_even(per_1k * (usd / 1000000) * 1000000, 0) / 1000000 AS cost_usd_per_1k_chars,
         round_even(per_1k * (usd / 1000000) * %(fx)s * 100, 0) / 100 AS cost_vnd_per_1k_chars,
         round_even(per_sentence * (usd / 1000000) * 100000000, 0) / 100000000 AS cost_usd_per_sentence,
         round_even(per_sentence * (usd / 1000000) * %(fx)s * 10000, 0) / 10000 AS cost_vnd_per_sentence
  FROM exact_cost),
wide_content AS (SELECT corpus, counter_id, string_agg(lang || '=' || content_tokens, ',' ORDER BY lang) AS sig,
                        count(*) AS n_langs FROM content_ragged GROUP BY corpus, counter_id),
pairs AS (
  SELECT a.corpus, a.counter_id AS counter_a, b.counter_id AS counter_b, a.n_langs
  FROM wide_content a JOIN wide_content b ON a.corpus = b.corpus AND a.counter_id < b.counter_id
  WHERE a.sig = b.sig AND a.n_langs = 4),
folds AS (
  SELECT m.corpus, m.counter_id, c.flagship_group, m.sig = f.sig AND m.n_langs = 4 AS identical
  FROM wide_content m JOIN counters c ON m.counter_id = c.counter_id AND c.flagship_group <> ''
  JOIN wide_content f ON f.corpus = m.corpus AND f.counter_id = c.flagship_group),
premium_rank AS (
  SELECT counter_id, arg_min(premium_aggregate, corpus) AS rank_key FROM premium WHERE lang = 'fr' GROUP BY counter_id),
headline_pos AS (
  SELECT c.counter_id, r.rank_key, row_number() OVER (ORDER BY r.rank_key NULLS LAST, c.counter_id) AS pos
  FROM counters c LEFT JOIN premium_rank r USING (counter_id)
  WHERE c.headline AND c.counter_id IN (SELECT counter_id FROM premium)),
cost_rank AS (
  SELECT counter_id, arg_min(cost_usd_per_1k_chars, corpus) AS rank_key FROM cost
  WHERE lang = 'fr' AND cost_usd_per_1k_chars IS NOT NULL GROUP BY counter_id),
priced_pos AS (
  SELECT c.counter_id, r.rank_key, row_number() OVER (ORDER BY r.rank_key NULLS LAST, c.counter_id) AS pos
  FROM counters c LEFT JOIN cost_rank r USING (counter_id)
  WHERE c.counter_id IN (SELECT counter_id FROM cost WHERE cost_usd_per_1k_chars IS NOT NULL)),
ladder AS (
  SELECT corpus, counter_id, cost_usd_per_sentence * 1000.0 AS v,
         row_number() OVER (PARTITION BY corpus ORDER BY cost_usd_per_sentence, p.pos) AS pos
  FROM cost JOIN priced_pos p USING (counter_id) WHERE lang = 'fr' AND cost_usd_per_sentence IS NOT NULL),
gaps AS (
  SELECT corpus, counter_id, b, v, v - b AS gap, v / b AS rel, row_number() OVER (PARTITION BY corpus ORDER BY v, p.pos) AS pos
  FROM (SELECT e.corpus, e.counter_id, e.cost_usd_per_sentence * 1000.0 AS b, f.cost_usd_per_sentence * 1000.0 AS v
        FROM cost e JOIN cost f ON e.corpus = f.corpus AND e.counter_id = f.counter_id AND e.lang = 'en' AND f.lang = 'fr')
  JOIN priced_pos p USING (counter_id) WHERE b <> 0 AND v <> 0),
heat AS (SELECT corpus, counter_id, lang, pos, premium_aggregate AS value
         FROM premium JOIN headline_pos USING (counter_id) WHERE lang <> 'en'),
drawn AS (
  SELECT 'dollar bars' AS chart, counter_id, pos FROM priced_pos
  UNION ALL SELECT 'tokenizer bars', counter_id, pos FROM headline_pos
  UNION ALL SELECT 'ladder ' || corpus, counter_id, pos FROM ladder),
channels AS (
  SELECT DISTINCT h, list_transform([2, 4, 6], lambda i: CAST(('0x' || substr(h, i, 2)) AS INT) / 255.0::DOUBLE) AS c
  FROM (SELECT fill AS h FROM fills UNION SELECT surface FROM fills)),
linear AS (SELECT h, list_transform(c, lambda v: CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS l
           FROM channels),
views AS (SELECT h, 'normal' AS kind, l FROM linear%(simulated)s),
cone AS (SELECT h, kind, cbrt(0.4122214708::DOUBLE * l[1] + 0.5363325363::DOUBLE * l[2] + 0.0514459929::DOUBLE * l[3]) AS x,
                cbrt(0.2119034982::DOUBLE * l[1] + 0.6806995451::DOUBLE * l[2] + 0.1073969566::DOUBLE * l[3]) AS y,
                cbrt(0.0883024619::DOUBLE * l[1] + 0.2817188376::DOUBLE * l[2] + 0.6299787005::DOUBLE * l[3]) AS z FROM views),
lab AS (SELECT h, kind, 0.2104542553::DOUBLE * x + 0.7936177850::DOUBLE * y - 0.0040720468::DOUBLE * z AS l,
               1.9779984951::DOUBLE * x - 2.4285922050::DOUBLE * y + 0.4505937099::DOUBLE * z AS a,
               0.0259040371::DOUBLE * x + 0.7827717662::DOUBLE * y - 0.8086757660::DOUBLE * z AS b FROM cone),
codes AS (SELECT lang || '_' || source AS code, nfc_normalize(text) AS text, doc_id FROM documents),
code_text AS (SELECT code, string_agg(text, ' ' ORDER BY doc_id) AS body FROM codes GROUP BY code),
code_names AS (
  SELECT DISTINCT lang || '_' || source AS code, language || ' ' || source AS language
  FROM documents JOIN languages USING (lang)),
lengths AS (
  SELECT code AS lang, language, t.tokenizer, t.ord, CAST(t.n AS BIGINT) AS n_tokens, CAST(t.u AS BIGINT) AS n_unknown
  FROM (SELECT *, length(body) AS n32, length(regexp_replace(body, '[^\x00-\x7F]', '', 'g')) AS known FROM code_text)
  JOIN code_names USING (code),
  LATERAL (VALUES ('UTF-32', 0, n32, 0), ('ByT5', 1, strlen(body), 0),
                  ('ASCII', 2, n32, greatest(0, n32 * (n32 - known) // n32)),
                  ('Words', 3, len(regexp_extract_all(body, '%(word)s')), 0)) t(tokenizer, ord, n, u)),
masked AS (SELECT *, CASE WHEN CAST(n_unknown AS DOUBLE) / n_tokens > 0.1 THEN NULL ELSE n_tokens END AS cell FROM lengths),
relative AS (
  SELECT m.language, m.tokenizer, m.ord, g.target_language, CAST(m.cell AS DOUBLE) / nullif(b.cell, 0) AS relative
  FROM masked m JOIN (VALUES ('UTF-32', 'English src0'), ('ByT5', 'French src3'), ('ASCII', 'English src2'),
                             ('Words', 'English src0')) g(tokenizer, target_language) ON m.tokenizer = g.tokenizer
  LEFT JOIN masked b ON b.tokenizer = m.tokenizer AND b.language = g.target_language),
utterances AS (
  SELECT role AS locale, CAST(conv_id AS VARCHAR) AS id, arg_max(utt, turn) AS utt
  FROM (SELECT *, nfc_normalize(trim(CASE WHEN turn < 2 THEN replace(text, chr(10), ' ') ELSE text END,
                                     ' ' || chr(9) || chr(10) || chr(13))) AS utt FROM conversations WHERE turn <= 3)
  WHERE utt <> '' AND NOT contains(utt, chr(10)) GROUP BY role, conv_id),
common_ids AS (SELECT id FROM utterances GROUP BY id HAVING count(DISTINCT locale) = 3),
prior AS (
  SELECT corpus, counter_id, lang, CASE WHEN counter_id = 'utf8' THEN 'utf8-v1' ELSE spec END AS spec,
         CASE WHEN counter_id = 'utf8-api' THEN NULL ELSE '2026-07-27' END AS measured_on, total_tokens, total_chars FROM agg
  UNION ALL SELECT corpus, 'retired', lang, spec, '2026-07-27', total_tokens, total_chars FROM agg WHERE counter_id = 'words'),
kept AS (
  SELECT * FROM prior WHERE NOT (corpus = 'core' AND counter_id IN ('words', 'utf32'))
   AND counter_id <> 'retired' AND lang <> 'es'),
merged AS (
  SELECT * FROM kept UNION ALL
  SELECT * FROM agg WHERE corpus = 'core' AND counter_id IN ('words', 'utf32') AND lang <> 'es'),
words_by_weight AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{L}+')) AS word FROM documents)
  GROUP BY word),
prefixes AS (
  SELECT p, sum(n) AS n FROM (SELECT n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i))) AS p
                              FROM words_by_weight) WHERE strlen(p) > 1 GROUP BY p),
ranked AS (SELECT 255 + row_number() OVER (ORDER BY n DESC, length(p), p) AS rank, hex(encode(p)) AS token_hex FROM prefixes),
leaf AS (SELECT corpus, lang, sentence_idx, sha256(text) AS d,
                sha256(CASE WHEN corpus = 'core' THEN text ELSE text || ' ' END) AS before FROM units),
tree1 AS (SELECT corpus, lang, sentence_idx // 16384 AS k, count(*) AS n,
                 sha256(string_agg(d, '' ORDER BY sentence_idx)) AS d FROM leaf GROUP BY ALL),
tree2 AS (SELECT corpus, lang, k // 16384 AS k, sum(n) AS n, sha256(string_agg(d, '' ORDER BY k)) AS d FROM tree1
          GROUP BY corpus, lang, tree1.k // 16384),
tree3 AS (SELECT corpus, lang, sum(n) AS n, sha256(string_agg(d, '' ORDER BY k)) AS d FROM tree2 GROUP BY corpus, lang)
"""

_PRELUDE = "WITH " + _UNITS % {
    "word": _WORD, "simulated": _SIMULATED, "on": W.MEASURED_ON, "raw": _RAW, "agg": _AGG, "fx": f"{dims.USD_TO_VND}::DOUBLE",
    "languages": _values(W.LANGUAGES.items()), "fills": _values(_FILLS),
    "counters": _values((c.counter_id, c.display, c.spec, c.headline, c.headline_display, c.family_display,
                         c.flagship_group, c.fold_reason, c.ord) for c in W.DIMS.counters),
    "prices": _values((p.counter_id, p.input_usd_per_mtok, p.as_of, p.confidence) for p in W.PRICES),
}


def _r(expr: str, digits: int) -> str:
    return f"round_even(({expr}) * {10 ** digits}, 0) / {10 ** digits}"


_NFD = "text"
for _c in "éèêçäöüñóíáÉ":
    _d = unicodedata.normalize("NFD", _c)
    _NFD = f"replace({_NFD}, '{_c}', '{_d[0]}' || chr({ord(_d[1])}))"

_LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
_LINES = f"(CASE WHEN list_last({_LINES}) = '' THEN list_slice({_LINES}, 1, len({_LINES}) - 1) ELSE {_LINES} END)"

_COST_COLUMNS = ("corpus, counter_id, lang, language, tokens_per_1k_chars, tokens_per_sentence, price_usd_per_mtok, "
                 "price_confidence, cost_usd_per_1k_chars, cost_vnd_per_1k_chars, cost_usd_per_sentence, cost_vnd_per_sentence")

_DELTA = f"""
SELECT lang, published, {_r('ours', 4)} AS ours, {_r('ours - published', 6)} AS delta, abs(ours - published) < 0.005 AS passes
FROM (SELECT d.lang, {_r('CAST(d.n AS DOUBLE) / e.n', 2)} AS published,
             CAST(a.total_tokens AS DOUBLE) / b.total_tokens AS ours
      FROM (SELECT lang, sum(n_chars) + count(*) - 1 AS n FROM documents WHERE length(source) <= 4 GROUP BY lang) d,
           (SELECT sum(n_chars) + count(*) - 1 AS n FROM documents WHERE length(source) <= 4 AND lang = 'en') e,
           agg a, agg b
      WHERE d.lang <> 'en' AND a.lang = d.lang AND a.corpus = 'core' AND a.counter_id = 'utf32'
        AND b.lang = 'en' AND b.corpus = 'core' AND b.counter_id = 'utf32')"""

_SWAP = "replace(replace(replace({x}, ',', '#'), '.', ','), '#', '.')"


def _number(x: str, digits: int, vi: bool) -> str:
    text = f"format('{{:,.{digits}f}}', CAST({_r(x, digits)} AS DOUBLE))"
    return _SWAP.format(x=text) if vi else text


def _money(x: str, vi: bool) -> str:
    body = f"CASE WHEN {x} = floor({x}) THEN {_number(x, 0, vi)} ELSE {_number(x, 2, vi)} END"
    return f"({body}) || ' USD'" if vi else f"'$' || ({body})"


def _compact(x: str, vi: bool) -> str:
    return f"CASE WHEN {x} >= 100 THEN {_number(x, 0, vi)} WHEN {x} >= 10 THEN {_number(x, 1, vi)} ELSE {_number(x, 2, vi)} END"


_FOLDED = """
SELECT f.corpus, f.flagship_group, h.pos, g.label || ' = ' || string_agg(m.label, ' = ' ORDER BY m.ord) AS legend
FROM folds f JOIN labels_of m ON f.counter_id = m.counter_id JOIN labels_of g ON g.counter_id = f.flagship_group
JOIN prices p ON p.counter_id = m.counter_id JOIN headline_pos h ON h.counter_id = f.flagship_group
WHERE f.identical AND m.fold_reason = 'shared' AND p.usd IS NOT NULL AND m.spec <> g.spec
GROUP BY f.corpus, f.flagship_group, h.pos, g.label"""

def _same_tokens(vi: bool) -> str:
    return f"""
SELECT corpus, string_agg(part, '; ' ORDER BY pos) AS parts FROM (
  SELECT corpus, family, min(pos) AS pos, string_agg(label || ' ' || {_money('usd', vi)}, ' / ' ORDER BY pos) AS part
  FROM (SELECT c.corpus, o.pos, l.label, p.usd, CASE WHEN l.headline THEN l.counter_id ELSE l.flagship_group END AS family,
               l.counter_id
        FROM (SELECT DISTINCT corpus, counter_id FROM cost) c JOIN priced_pos o USING (counter_id)
        JOIN labels_of l USING (counter_id) JOIN prices p USING (counter_id) WHERE p.usd IS NOT NULL) d
  WHERE family = counter_id OR EXISTS (SELECT 1 FROM folds f WHERE f.corpus = d.corpus AND f.counter_id = d.counter_id AND f.identical)
  GROUP BY corpus, family HAVING count(*) > 1) GROUP BY corpus"""

_HEDGED = """
SELECT corpus, string_agg(label || ' (' || {grade} || ')', ', ' ORDER BY pos) AS named
FROM (SELECT DISTINCT corpus, counter_id FROM cost) JOIN priced_pos USING (counter_id) JOIN labels_of USING (counter_id)
JOIN prices USING (counter_id) WHERE usd IS NOT NULL AND confidence <> 'high' GROUP BY corpus"""

_UNPRICED = """
SELECT corpus, string_agg(label, ', ' ORDER BY ord) AS names FROM (SELECT DISTINCT corpus, counter_id FROM cost)
JOIN labels_of USING (counter_id) JOIN prices USING (counter_id) WHERE headline AND usd IS NULL GROUP BY corpus"""

_DATES = """
SELECT corpus, min(as_of) || '–' || max(as_of) AS as_of,
       strftime(min(as_of)::DATE, '%-d/%-m/%Y') || '–' || strftime(max(as_of)::DATE, '%-d/%-m/%Y') AS as_of_vi
FROM cost JOIN prices USING (counter_id) WHERE usd IS NOT NULL GROUP BY corpus"""

_CAPTIONS = f"""
SELECT corpus, 0 AS line, 'en' AS locale, 'USD to serve 1,000,000 input characters — input list price (' || as_of || '); VND = USD × 25,890' AS text FROM ({_DATES})
UNION ALL SELECT corpus, 1, 'en', 'Not every price is high-confidence — ' || named FROM ({_HEDGED.format(grade='confidence')})
UNION ALL SELECT corpus, 2, 'en', 'Same tokens, different price: ' || parts || ' (per 1M input tokens)' FROM ({_same_tokens(False)})
UNION ALL SELECT corpus, 3, 'en', names || ' omitted — no serving list price' FROM ({_UNPRICED})
UNION ALL SELECT corpus, 0, 'vi', 'USD để phục vụ 1.000.000 ký tự đầu vào — giá niêm yết đầu vào (' || as_of_vi || '); VND = USD × 25.890' FROM ({_DATES})
UNION ALL SELECT corpus, 1, 'vi', 'Không phải mọi mức giá đều độ tin cậy cao — ' || named FROM ({_HEDGED.format(grade="CASE confidence WHEN 'medium' THEN 'trung bình' WHEN 'low' THEN 'thấp' ELSE 'chưa rõ' END")})
UNION ALL SELECT corpus, 2, 'vi', 'Cùng số token, khác giá: ' || parts || ' (trên 1 triệu token đầu vào)' FROM ({_same_tokens(True)})
UNION ALL SELECT corpus, 3, 'vi', names || ' được bỏ ra ngoài — không có giá niêm yết để phục vụ' FROM ({_UNPRICED})"""

_GAP_CAPTION = f"""
SELECT corpus, 'Widest gap: ' || w.label || ', +$' || {_number('w.gap', 4, False)} || ' per 1,000 documents (' || {_number('w.rel', 2, False)}
  || '×). Steepest ratio: ' || s.label || ' at ' || {_number('s.rel', 2, False)} || '× — only +$' || {_number('s.gap', 4, False)}
  || ', because a cheap model with an inefficient tokenizer is costly in proportion and small in money.' AS text
FROM (SELECT corpus, arg_max(c, (gap, -pos)) AS w, arg_max(c, (rel, -pos)) AS s FROM (
  SELECT corpus, gap, rel, pos, {{'label': label, 'gap': gap, 'rel': rel}} AS c FROM gaps JOIN labels_of USING (counter_id)) GROUP BY corpus)"""

_STALE = r"""
SELECT corpus, f || corpus || l || t AS stem
FROM (SELECT DISTINCT source AS corpus FROM documents),
     (VALUES %s) a(f), (VALUES (''), ('-vi')) b(l), (VALUES (''), ('-dark')) c(t)
WHERE corpus NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang <> 'en')
""" % ", ".join(f"('{p}')" for p in dims.FIGURE_PREFIXES)

_PROBES = " UNION ALL ".join(
    f"SELECT source, '{p}' AS probe, length(source) + CASE WHEN bool_or(contains(text, '{p}')) THEN 1 ELSE 2 END - 1 AS frame "
    f"FROM documents GROUP BY source" for p in dims.ENVELOPE_PROBES)

# Queries that use the shared prelude.
_DERIVED = {
    "units": "SELECT corpus, lang, sentence_idx, doc_id, length(text) AS n_chars FROM units",
    "alignment_check": """
        SELECT corpus, lang, n AS n_sentences, min(n) OVER (PARTITION BY corpus) = max(n) OVER (PARTITION BY corpus) AS aligned
        FROM (SELECT corpus, lang, count(*) AS n FROM units GROUP BY corpus, lang)""",
    "corpus_size": "SELECT corpus, n_sentences FROM sizes",
    "corpus_fingerprint": f"""
        SELECT corpus, CAST(max(n) FILTER (WHERE lang = 'en') AS BIGINT) AS n_sentences,
               sha256(string_agg(lang || ':' || n || ':' || d, '|' ORDER BY list_position([{_LANGS}], lang))) AS fingerprint
        FROM tree3 GROUP BY corpus""",
    "flat_fingerprint": """
        SELECT corpus, sha256(string_agg(lang || chr(0) || lines || chr(0), '' ORDER BY ord)) AS sha256 FROM (
          SELECT corpus, lang, string_agg(text, chr(10) ORDER BY sentence_idx) AS lines FROM units GROUP BY corpus, lang)
        JOIN (SELECT lang, list_position(['en', 'de', 'fr', 'es'], lang) AS ord FROM languages) USING (lang) GROUP BY corpus""",
    "fingerprint_gate": "SELECT corpus, bool_or(d <> before) AS changed FROM leaf GROUP BY corpus",
    "joined_count": "SELECT corpus, lang, words, utf32, utf8 FROM joined_counts",
    "aggregate_counts": "SELECT * FROM agg",
    "raw_counts": "SELECT * FROM raw",
    "head_slice": "SELECT corpus, counter_id, lang, sentence_idx, n_tokens FROM raw WHERE counter_id LIKE '%-api'",
    "envelope_strip": """SELECT corpus, counter_id, lang, sentence_idx, n_tokens - envelope_tokens AS n_tokens_content
                         FROM raw WHERE envelope_tokens > 0""",
    "envelope_carry": "SELECT counter_id, frame AS envelope_tokens FROM frames",
    "content_totals": "SELECT corpus, counter_id, lang, total_tokens, content_tokens FROM content",
    "premium_aggregate": "SELECT * FROM premium",
    "per_sentence_ratio": f"SELECT corpus, counter_id, lang, sentence_idx, {_r('ratio', 6)} AS ratio FROM ratios",
    "premium_distribution": "SELECT * FROM dist",
    "premium_table": """
        SELECT p.*, 'full corpus (' || s.n_sentences || ' sentences, one count per language)' AS aggregate_basis,
               d.distribution_n, CASE WHEN d.distribution_n IS NULL THEN NULL WHEN d.distribution_n >= s.n_sentences
                 THEN 'full sweep' ELSE 'head slice [:' || d.distribution_n || '], topically clustered — not a random sample' END
                 AS distribution_basis,
               premium_median, premium_p10, premium_p25, premium_p75, premium_p90, premium_mean
        FROM premium p JOIN sizes s USING (corpus) LEFT JOIN dist d USING (corpus, counter_id, lang)""",
    "premium_pivot": "SELECT corpus, lang, " + ", ".join(
        f"max(premium_aggregate) FILTER (WHERE counter_id = '{c.counter_id}') AS \"{c.counter_id}\"" for c in W.MATRIX)
        + " FROM premium GROUP BY corpus, lang",
    "headline_map": """
        SELECT corpus, string_agg(counter_id || ':' || by_language, ';' ORDER BY counter_id) AS headline FROM (
          SELECT corpus, counter_id, string_agg(language || '=' || printf('%.4f', premium_aggregate), ',' ORDER BY language) AS by_language
          FROM premium WHERE lang <> 'en' GROUP BY corpus, counter_id) GROUP BY corpus""",
    "cost_table": f"SELECT {_COST_COLUMNS} FROM cost",
    "priced_only": f"SELECT {_COST_COLUMNS} FROM cost WHERE cost_usd_per_1k_chars IS NOT NULL",
    "oracle_delta": _DELTA,
    "coverage": f"""
        SELECT (SELECT string_agg(DISTINCT counter_id, ',' ORDER BY counter_id) FROM agg) AS counters,
               (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM agg) AS langs,
               max(abs(delta)) AS oracle_max_abs_delta, bool_and(passes) AS oracle_passes FROM ({_DELTA})""",
    "coincidence_pairs": "SELECT * FROM pairs",
    "coincidence_incomparable": """
        SELECT a.corpus, a.counter_id AS counter_a, b.counter_id AS counter_b, string_agg(a.lang, ',' ORDER BY a.lang) AS identical_on
        FROM content_ragged a JOIN content_ragged b ON a.corpus = b.corpus AND a.lang = b.lang AND a.counter_id < b.counter_id
        JOIN wide_content x ON x.corpus = a.corpus AND x.counter_id = a.counter_id
        JOIN wide_content y ON y.corpus = b.corpus AND y.counter_id = b.counter_id
        WHERE x.n_langs < 4 OR y.n_langs < 4
        GROUP BY ALL HAVING bool_and(a.content_tokens = b.content_tokens)""",
    "shared_everywhere": "SELECT counter_a, counter_b FROM pairs GROUP BY ALL HAVING count(*) = 2",
    "shared_partial": "SELECT counter_a, counter_b, string_agg(corpus, ',') AS corpora FROM pairs GROUP BY counter_a, counter_b HAVING count(*) = 1",
    "identical_pair": "SELECT * FROM folds",
    "carry_forward": "SELECT corpus, counter_id, lang, spec, measured_on, total_tokens, total_chars FROM merged",
    "purge_report": """SELECT DISTINCT 'language' AS axis, lang AS value FROM prior WHERE lang NOT IN ('en', 'de', 'fr')
                       UNION ALL SELECT DISTINCT 'counter', counter_id FROM prior WHERE counter_id = 'retired'""",
    "provenance_gate": """SELECT DISTINCT k.counter_id, k.spec AS recorded_spec, c.spec AS current_spec
                          FROM kept k JOIN counters c USING (counter_id) WHERE k.spec <> c.spec""",
    "lost_distribution": """SELECT DISTINCT counter_id FROM agg
                            WHERE counter_id NOT IN (SELECT counter_id FROM raw WHERE envelope_tokens = 0)""",
    "measured_on_summary": """
        SELECT counter_id, CASE count(DISTINCT measured_on) WHEN 0 THEN 'unrecorded' WHEN 1 THEN min(measured_on)
               ELSE 'mixed: ' || string_agg(DISTINCT measured_on, ', ' ORDER BY measured_on) END AS measured_on
        FROM merged GROUP BY counter_id""",
    "coverage_block": f"""
        SELECT string_agg(counter_id, ',' ORDER BY counter_id) AS counters_in_dataset,
               coalesce(string_agg(counter_id, ',' ORDER BY counter_id) FILTER (WHERE fresh), '') AS counters_measured_last_pass,
               coalesce(string_agg(counter_id, ',' ORDER BY counter_id) FILTER (WHERE NOT fresh), '') AS counters_carried_forward,
               coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT counter_id AS c FROM counters UNION SELECT 'utf32-partial')
                         WHERE c NOT IN (SELECT counter_id FROM merged)), '') AS counters_without_rows,
               string_agg(counter_id || '=' || dates, ',' ORDER BY counter_id || '=' || dates) AS measured_on_by_counter,
               (SELECT string_agg(DISTINCT corpus, ',' ORDER BY corpus) FROM merged) AS corpora,
               (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM merged) AS langs,
               coalesce(string_agg(counter_id, ',' ORDER BY counter_id) FILTER (WHERE cells < whole), '') AS counters_with_gaps,
               CAST(sum(n) AS BIGINT) AS n_rows, {dims.PUBLISHED_TOLERANCE}::DOUBLE AS oracle_tolerance,
               (SELECT max(abs(delta)) FROM ({_DELTA})) AS oracle_max_abs_delta, (SELECT bool_and(passes) FROM ({_DELTA})) AS oracle_passes
        FROM (SELECT counter_id, string_agg(DISTINCT coalesce(measured_on, 'unrecorded'), '|' ORDER BY coalesce(measured_on, 'unrecorded')) AS dates,
                     bool_or(coalesce(measured_on = '2026-10-19', false)) AS fresh, count(*) AS n, count(DISTINCT corpus || ',' || lang) AS cells,
                     (SELECT count(DISTINCT corpus) * count(DISTINCT lang) FROM merged) AS whole
              FROM merged GROUP BY counter_id)""",
    "canonical_order": "SELECT corpus, counter_id, lang, row_number() OVER (ORDER BY corpus, counter_id, lang) AS pos FROM agg",
    "coverage_gap": """
        SELECT x.corpus, x.counter_id, l.lang FROM (SELECT DISTINCT corpus, counter_id FROM content_ragged) x, languages l
        WHERE NOT EXISTS (SELECT 1 FROM content_ragged c WHERE c.corpus = x.corpus AND c.counter_id = x.counter_id AND c.lang = l.lang)""",
    "registry_antijoin": """
        SELECT 'language declared but absent' AS issue, l AS id FROM (VALUES ('en'), ('fr'), ('it')) t(l)
        WHERE l NOT IN (SELECT lang FROM documents)
        UNION ALL SELECT DISTINCT 'language present but undeclared', lang FROM documents WHERE lang NOT IN ('en', 'fr', 'it')
        UNION ALL SELECT 'counter declared but absent', counter_id FROM prices
                  WHERE counter_id NOT IN (SELECT counter_id FROM content_ragged)
        UNION ALL SELECT DISTINCT 'counter present but undeclared', counter_id FROM content_ragged
                  WHERE counter_id NOT IN (SELECT counter_id FROM prices)""",
    "drawn_coverage": """SELECT DISTINCT corpus, counter_id FROM cost JOIN counters USING (counter_id)
                         WHERE headline AND counter_id NOT IN (SELECT counter_id FROM priced_pos)""",
    "tokenization_lengths": "SELECT language, " + ", ".join(
        f"max(n_tokens) FILTER (WHERE tokenizer = '{t}') AS \"{t}\"" for t in W.PARITY_NAMES) + " FROM lengths GROUP BY language",
    "language_map_join": """SELECT lang, language, tokenizer, n_tokens, n_unknown FROM lengths
                            WHERE lang IN (SELECT d.lang || '_' || source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "unknown_fraction": f"SELECT language, tokenizer, {_r('CAST(n_unknown AS DOUBLE) / n_tokens', 8)} AS unknown_fraction FROM lengths",
    "unknown_mask": f"SELECT language, tokenizer, coalesce(CAST(cell AS VARCHAR), '{dims.MASK}') AS cell FROM masked",
    "masked_table_read": "SELECT language, " + ", ".join(
        f"CAST(max(cell) FILTER (WHERE tokenizer = '{t}') AS DOUBLE) AS \"{t}\"" for t in W.PARITY_NAMES) + " FROM masked GROUP BY language",
    "normalize_by_target": f"SELECT language, tokenizer, target_language, {_r('relative', 8)} AS relative FROM relative",
    "print_table_pages": f"""
        SELECT CAST(least(r // 68, 2) * 2 + CASE WHEN ord < 2 THEN 0 ELSE 1 END + 1 AS BIGINT) AS page, r AS row, language, tokenizer,
               coalesce(printf('%.2f', {_r('relative', 2)}), '---') AS cell
        FROM relative JOIN (SELECT language, row_number() OVER (ORDER BY language) - 1 AS r
                            FROM (SELECT DISTINCT language FROM lengths)) USING (language)""",
    "top_k_premium": f"""
        SELECT language, tokenizer, {_r('relative', 8)} AS relative FROM relative
        WHERE tokenizer = 'UTF-32' AND relative IS NOT NULL ORDER BY relative.relative, language LIMIT 50""",
    "jsonl_partition_filter": "SELECT locale, id, utt FROM utterances",
    "parallel_intersection": """SELECT locale, CAST(id AS BIGINT) AS "order", utt FROM utterances WHERE id IN (FROM common_ids)""",
    "locale_drop_counts": """
        SELECT locale, count(*) AS n_utterances, count(*) FILTER (WHERE id IN (FROM common_ids)) AS n_kept,
               count(*) FILTER (WHERE id NOT IN (FROM common_ids)) AS n_dropped FROM utterances GROUP BY locale""",
    "rank_across_corpora": """
        SELECT counter_id, CASE WHEN counter_id = 'utf8' THEN 'extended' ELSE 'core' END AS rank_corpus, premium_aggregate AS rank_key
        FROM premium WHERE lang = 'fr' AND corpus = CASE WHEN counter_id = 'utf8' THEN 'extended' ELSE 'core' END""",
    "headline_order": "SELECT counter_id, rank_key, pos FROM headline_pos",
    "priced_order": "SELECT counter_id, rank_key, pos FROM priced_pos",
    "chart_premium_heatmap": "SELECT corpus, counter_id, lang, pos, value FROM heat",
    "heatmap_scale": f"""
        SELECT corpus, counter_id, lang, value,
               CASE WHEN lo < 1 AND hi > 1 THEN 'diverging' WHEN lo >= 1 THEN 'dearer' ELSE 'cheaper' END AS scale,
               {_r('CASE WHEN lo < 1 AND hi > 1 THEN 0.5 + ln(value) / (2 * greatest(abs(ln(lo)), abs(ln(hi)))) '
                   'WHEN lo >= 1 THEN (value - 1) / nullif(hi - 1, 0) ELSE (value - lo) / nullif(1 - lo, 0) END', 6)} AS place
        FROM heat JOIN (SELECT corpus, min(value) AS lo, max(value) AS hi FROM heat GROUP BY corpus) USING (corpus)""",
    "chart_cost_driver": """SELECT corpus, counter_id, lang, pos, tokens_per_1k_chars AS value
                            FROM cost JOIN headline_pos USING (counter_id)""",
    "chart_usd_per_1m_chars": f"""SELECT corpus, counter_id, lang, pos, {_r('cost_usd_per_1k_chars * 1000.0::DOUBLE', 6)} AS value
                                  FROM cost JOIN priced_pos USING (counter_id)""",
    "chart_usd_per_1k_units": f"""SELECT corpus, counter_id, lang, pos, {_r('cost_usd_per_sentence * 1000.0::DOUBLE', 6)} AS value
                                  FROM cost JOIN priced_pos USING (counter_id)""",
    "group_extreme": """
        SELECT corpus, lang, arg_max(counter_id, (value, -pos)) AS counter_id, max(value) AS value
        FROM (SELECT corpus, counter_id, lang, pos, tokens_per_1k_chars AS value FROM cost JOIN headline_pos USING (counter_id))
        GROUP BY corpus, lang""",
    "cost_ladder": f"SELECT corpus, counter_id, {_r('v', 6)} AS usd_per_1k_units, pos FROM ladder",
    "cost_spread": f"SELECT corpus, {_r('min(v)', 6)} AS cheapest, {_r('max(v)', 6)} AS dearest, {_r('max(v) / min(v)', 6)} AS spread FROM ladder GROUP BY corpus",
    "tax_gap": f"SELECT corpus, counter_id, {_r('b', 6)} AS baseline_usd, {_r('v', 6)} AS lead_usd, {_r('gap', 6)} AS gap_usd, {_r('rel', 6)} AS gap_ratio, pos FROM gaps",
    "widest_gaps": """SELECT corpus, arg_max(counter_id, (gap, -pos)) AS widest, arg_max(counter_id, (rel, -pos)) AS steepest
                      FROM gaps GROUP BY corpus""",
    "label_fallback": """SELECT counter_id, label, CASE WHEN family_display = '' THEN label ELSE family_display END AS family_label
                         FROM labels_of WHERE counter_id IN (SELECT counter_id FROM agg)""",
    "fold_legend": _FOLDED,
    "same_tokens_diff_price": _same_tokens(False),
    "price_confidence_note": _HEDGED.format(grade="confidence"),
    "unpriced_note": _UNPRICED,
    "price_as_of": _DATES,
    "chart_captions": _CAPTIONS,
    "gap_caption": _GAP_CAPTION,
    "locale_number_format": "SELECT corpus, counter_id, lang, " + ", ".join(
        f"{_number('cost_vnd_per_1k_chars * 1000', 2, vi)} AS number_{loc}, {_money('price_usd_per_mtok', vi)} AS money_{loc}, "
        f"{_compact('tokens_per_1k_chars', vi)} AS compact_{loc}" for loc, vi in (("en", False), ("vi", True)))
        + " FROM cost WHERE cost_usd_per_1k_chars IS NOT NULL",
    "adjacent_pairs": f"""
        SELECT theme, chart, pos, counter_id, next_id, delta_e, delta_e_cvd, delta_e >= 15 AND delta_e_cvd >= 8 AS "distinct" FROM (
          SELECT p.theme, p.chart, p.pos, p.counter_id, p.next_id,
                 {_r("max(100 * sqrt((x.l-y.l)**2 + (x.a-y.a)**2 + (x.b-y.b)**2)) FILTER (WHERE x.kind = 'normal')", 4)} AS delta_e,
                 {_r("min(100 * sqrt((x.l-y.l)**2 + (x.a-y.a)**2 + (x.b-y.b)**2)) FILTER (WHERE x.kind <> 'normal')", 4)} AS delta_e_cvd
          FROM (SELECT f.theme, a.chart, a.pos, a.counter_id, f.fill, f.slot, b.counter_id AS next_id, g.fill AS next_fill, g.slot AS next_slot
                FROM drawn a JOIN drawn b ON a.chart = b.chart AND b.pos = a.pos + 1 JOIN fills f ON f.counter_id = a.counter_id
                JOIN fills g ON g.counter_id = b.counter_id AND g.theme = f.theme) p
          JOIN lab x ON x.h = p.fill JOIN lab y ON y.h = p.next_fill AND y.kind = x.kind WHERE p.slot <> p.next_slot
          GROUP BY ALL)""",
    "ramp_monotone": f"""
        SELECT theme, cheaper_id, counter_id, step, step >= 0.06 AS ordered FROM (
          SELECT theme, counter_id, lag(counter_id) OVER w AS cheaper_id, {_r('lag(l) OVER w - l', 6)} AS step
          FROM (SELECT DISTINCT counter_id FROM drawn) JOIN fills USING (counter_id) JOIN prices USING (counter_id)
          JOIN lab ON lab.h = fill AND lab.kind = 'normal' WHERE usd IS NOT NULL
          WINDOW w AS (PARTITION BY theme, slot ORDER BY usd, counter_id)) WHERE cheaper_id IS NOT NULL""",
    "wcag_contrast": f"""
        SELECT theme, counter_id, fill, contrast, contrast >= 2.0 AS readable FROM (
          SELECT theme, counter_id, fill, {_r('(greatest(p, q) + 0.05) / (least(p, q) + 0.05)', 4)} AS contrast
          FROM (SELECT theme, counter_id, fill, 0.2126::DOUBLE * a.l[1] + 0.7152::DOUBLE * a.l[2] + 0.0722::DOUBLE * a.l[3] AS p,
                       0.2126::DOUBLE * b.l[1] + 0.7152::DOUBLE * b.l[2] + 0.0722::DOUBLE * b.l[3] AS q
                FROM (SELECT DISTINCT counter_id FROM drawn) JOIN fills USING (counter_id)
                JOIN linear a ON a.h = fill JOIN linear b ON b.h = surface))""",
    "vocab_slice": "SELECT rank, token_hex FROM ranked WHERE rank < 4096",
}

# White space as the split pattern sees it, for a character class.
_WHITE = r"\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _encoded(source: str, then: str) -> str:
    """A query over the byte-pair tokens of texts. source: (key, text).

    cut: (key, place, piece), the pieces of each text. merged: (piece, own, parts, rank), one row per merge with the
    tokens after it in hexadecimal, and one of rank -1 before all. A piece that is a token (of rank own) is one
    token however it merges. left_over: after the last merge below that rank. encoded: (piece, parts).
    The split pattern leaves the last white space of a run to the word behind it; a mark set before it says so.
    """
    return rf"""
        SELECT * FROM (WITH RECURSIVE source AS ({source}),
        cut AS (SELECT key, unnest(p) AS piece, generate_subscripts(p, 1) AS place FROM (
          SELECT key, regexp_extract_all(regexp_replace(text, '([{_WHITE}])([{_WHITE}][^{_WHITE}])', '\1' || chr(1) || '\2', 'g'),
            '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}\x01]+|[{_WHITE}]+') AS p FROM source)),
        own AS (SELECT piece, min(rank) AS own FROM (SELECT DISTINCT piece FROM cut) LEFT JOIN vocabulary ON token_hex = hex(encode(piece)) GROUP BY piece),
        merged(piece, own, parts, rank) AS (
          SELECT piece, own, regexp_extract_all(hex(encode(piece)), '..'), -1::BIGINT FROM own
          UNION ALL
          SELECT piece, own, parts[1:spot - 1] || [parts[spot] || parts[spot + 1]] || parts[spot + 2:], low FROM (
            SELECT piece, any_value(own) AS own, any_value(parts) AS parts, arg_min(i, v.rank * 1000000 + i) AS spot, min(v.rank)::BIGINT AS low
            FROM (SELECT piece, own, parts, unnest(range(1, len(parts))) AS i FROM merged) JOIN vocabulary v
              ON token_hex = parts[i] || parts[i + 1] AND v.rank < coalesce(own, 1000000)
            GROUP BY piece)),
        left_over AS (SELECT piece, any_value(own) AS own, arg_min(parts, len(parts)) AS parts FROM merged GROUP BY piece),
        encoded AS (SELECT piece, CASE WHEN own IS NULL THEN parts ELSE [hex(encode(piece))] END AS parts FROM left_over)
        {then})"""


def _inside(part: str) -> str:
    """A token that is a byte inside a character goes on with the group before it."""
    return f"(len({part}) = 2 AND {part}[1] IN ('8', '9', 'A', 'B'))"


_DERIVED |= {
    "bpe_count": _encoded("SELECT doc_id AS key, nfc_normalize(text) AS text FROM documents", """
        SELECT key AS doc_id, CAST(sum(len(parts)) AS BIGINT) AS n_tokens FROM cut JOIN encoded USING (piece) GROUP BY key"""),
    "bpe_joined_count": _encoded("""
          SELECT {'corpus': corpus, 'lang': lang} AS key, string_agg(text, ' ' ORDER BY doc_id) AS text FROM units GROUP BY corpus, lang""", """
        SELECT key.corpus AS corpus, key.lang AS lang, CAST(sum(len(parts)) AS BIGINT) AS total FROM cut JOIN encoded USING (piece) GROUP BY key"""),
    # Ranks mostly rise as a piece merges, so a size is a range sum over its merges; the few pieces that merge back to
    # a lower rank are merged at each size anew.
    "vocab_sweep": _encoded("SELECT lang AS key, text FROM documents", """,
        cuts AS (SELECT 256 + 3840 * i / 19 AS vocab_size FROM range(20) r(i)),
        counts AS (SELECT key AS lang, piece, count(*) AS n FROM cut GROUP BY ALL),
        odd AS (SELECT DISTINCT piece FROM (SELECT piece, rank < lag(rank) OVER (PARTITION BY piece ORDER BY len(parts) DESC) AS back FROM merged) WHERE back),
        redo(piece, vocab_size, own, parts) AS (
          SELECT piece, vocab_size, own, regexp_extract_all(hex(encode(piece)), '..') FROM own CROSS JOIN cuts WHERE piece IN (FROM odd)
          UNION ALL
          SELECT piece, vocab_size, own, parts[1:spot - 1] || [parts[spot] || parts[spot + 1]] || parts[spot + 2:] FROM (
            SELECT piece, vocab_size, any_value(own) AS own, any_value(parts) AS parts, arg_min(i, v.rank * 1000000 + i) AS spot
            FROM (SELECT piece, vocab_size, own, parts, unnest(range(1, len(parts))) AS i FROM redo) JOIN vocabulary v
              ON token_hex = parts[i] || parts[i + 1] AND v.rank < vocab_size
            GROUP BY piece, vocab_size)),
        redone AS (SELECT lang, vocab_size, sum(n * k) AS again FROM counts JOIN (
          SELECT piece, vocab_size, CASE WHEN any_value(own) < vocab_size THEN 1 ELSE min(len(parts)) END AS k FROM redo GROUP BY piece, vocab_size) USING (piece)
          GROUP BY lang, vocab_size),
        bytes AS (SELECT lang, sum(CASE WHEN piece NOT IN (FROM odd) THEN n * strlen(piece) ELSE 0 END) AS bytes FROM counts GROUP BY lang),
        steps AS (SELECT piece, rank, 1 AS k FROM merged WHERE rank >= 0 UNION ALL SELECT piece, own, len(parts) - 1 FROM left_over WHERE own IS NOT NULL),
        falls AS (SELECT lang, rank, sum(n * k) AS fall FROM counts JOIN steps USING (piece) WHERE piece NOT IN (FROM odd) GROUP BY ALL)
        SELECT lang, vocab_size, CAST(any_value(bytes) - coalesce(sum(fall) FILTER (WHERE rank < vocab_size), 0) + coalesce(any_value(again), 0) AS BIGINT) AS n_tokens
        FROM bytes CROSS JOIN cuts LEFT JOIN redone USING (lang, vocab_size) LEFT JOIN falls USING (lang) GROUP BY lang, vocab_size"""),
    "token_text_alignment": _encoded("SELECT doc_id AS key, text FROM documents", f"""
        SELECT doc_id, coalesce(n_groups, 0) AS n_groups, coalesce(n_tokens, 0) AS n_tokens, md5(text) AS text_md5 FROM documents LEFT JOIN (
          SELECT key AS doc_id, CAST(sum(len(list_filter(parts, lambda x: NOT {_inside('x')}))) AS BIGINT) AS n_groups,
                 CAST(sum(len(parts)) AS BIGINT) AS n_tokens
          FROM cut JOIN encoded USING (piece) GROUP BY key) USING (doc_id)"""),
    "latex_alignment": _encoded("SELECT item_id AS key, text FROM benchmark", rf"""
        SELECT item_id, string_agg(codes, ' & ' ORDER BY grp) || '\\' || chr(10) || string_agg('\wrapword{{' || text || '}}', ' & ' ORDER BY grp) || chr(10) AS latex
        FROM (SELECT item_id, grp, decode(unhex(string_agg(part, '' ORDER BY place, i))) AS text,
                     string_agg(CASE WHEN n = 1 THEN '\wrapword{{' WHEN k = 1 THEN '\wrapwordleft{{' WHEN k = n THEN '\wrapwordright{{'
                                     ELSE '\wrapwordcenter{{' END || rank || '}}', '' ORDER BY place, i) AS codes
              FROM (SELECT *, count(*) OVER (PARTITION BY item_id, grp) AS n, row_number() OVER (PARTITION BY item_id, grp ORDER BY place, i) AS k
                    FROM (SELECT key AS item_id, place, i, part, count(*) FILTER (WHERE NOT {_inside('part')}) OVER (PARTITION BY key ORDER BY place, i) AS grp
                          FROM (SELECT key, place, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut JOIN encoded USING (piece)))
                    JOIN (SELECT rank, token_hex AS part FROM vocabulary UNION ALL SELECT b, printf('%02X', b) FROM range(256) r(b)) USING (part))
              GROUP BY item_id, grp) GROUP BY item_id"""),
}

_CONCAT = """
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY length(source) > 4, doc_id) - 1 AS sentence_idx, doc_id
    FROM documents"""

# Queries straight over the tables.
_PLAIN = {
    "corpus_lines": f"""
        SELECT doc_id, i AS line_idx, length(l) AS n_chars, l AS text
        FROM (SELECT doc_id, unnest({_LINES}) AS l, unnest(range(len({_LINES}))) AS i FROM documents)""",
    "blank_line_check": f"""
        SELECT doc_id, count(*) AS n_blank, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS blank_at
        FROM (SELECT doc_id, unnest({_LINES}) AS l, unnest(range(len({_LINES}))) AS i FROM documents)
        WHERE regexp_matches(l, '{BLANK_PATTERN}') GROUP BY doc_id""",
    "corpus_concat_splits": _CONCAT,
    "example_pick": f"""
        SELECT lang, sentence_idx, doc_id, md5(text) AS text_md5 FROM ({_CONCAT}) JOIN documents USING (doc_id, lang)
        WHERE sentence_idx IN {dims.EXAMPLE_LINES}""",
    "language_discovery": """
        SELECT lang, row_number() OVER (ORDER BY lang) AS pos
        FROM (SELECT DISTINCT source || '_' || lang AS lang FROM documents)""",
    "nfc_normalize": f"""
        SELECT doc_id, length(r) AS n_raw, length(nfc_normalize(r)) AS n_nfc, md5(nfc_normalize(r)) AS nfc_md5
        FROM (SELECT doc_id, {_NFD} AS r FROM documents)""",
    "char_count": "SELECT doc_id, length(nfc_normalize(text)) AS n_code_points, n_chars FROM documents",
    "utf32_count": "SELECT conv_id, turn, length(text) AS n_tokens FROM conversations",
    "utf32_encode": """
        SELECT doc_id, len(ids) AS n_tokens, list_max(ids) AS max_token, md5(array_to_string(ids, ',')) AS ids_md5
        FROM (SELECT doc_id, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS ids FROM documents)""",
    "utf32_decode": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "utf8_byte_count": "SELECT doc_id, strlen(text) AS n_tokens FROM documents",
    "word_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}')) AS n_tokens FROM documents",
    "markup_count": f"""SELECT page_id, length(html) AS n_chars, strlen(html) AS n_bytes,
                               len(regexp_extract_all(html, '{_WORD}')) AS n_words FROM pages""",
    "unknown_count": r"""
        SELECT doc_id, length(text) AS n_tokens,
               CAST(greatest(0, length(text) * (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) // length(text)) AS BIGINT) AS n_unknown
        FROM documents""",
    "array_subsequence_removal": """
        SELECT doc_id, length(replace(text, 'th', '')) AS n_left, md5(replace(text, 'th', '')) AS left_md5 FROM documents""",
    "envelope_floor": f"""
        SELECT source, f AS envelope_tokens, n AS n_probes, a AS n_agreeing,
               CASE WHEN a < 4 THEN 'ambiguous' WHEN f NOT BETWEEN 0 AND 64 THEN 'implausible' ELSE 'ok' END AS verdict
        FROM (SELECT source, min(frame) AS f, count(*) AS n, count(*) FILTER (WHERE frame = low) AS a
              FROM (SELECT *, min(frame) OVER (PARTITION BY source) AS low FROM ({_PROBES})) GROUP BY source)""",
    "scripted_api_count": "SELECT conv_id, turn, length(text) + 8 AS n_tokens FROM conversations",
    "duplicate_ids": "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1",
    "figure_stem_prune": _STALE,
    "bpe_byte_count": "SELECT doc_id, strlen(text) AS n_tokens FROM documents",
}

#: Steps that many others look at; computed once in a statement.
_SHARED = ("units", "joined_counts", "counted", "raw", "agg", "vocabulary")


def _steps(prelude: str) -> dict[str, str]:
    """name -> "name AS (...)" of the steps of a WITH clause, in order."""
    found, at = {}, 0
    for start in re.finditer(r"(?m)(?:^|, )(\w+)(?:\([\w, ]+\))? AS \(", prelude):
        if start.start() < at:
            continue                                        # inside a step
        depth, i, quoted = 0, prelude.index("(", start.end() - 1), False
        while depth or i < start.end():
            c = prelude[i]
            quoted ^= c == "'"
            depth += (c == "(") - (c == ")") if not quoted else 0
            i += 1
        found[start[1]], at = prelude[start.start():i].lstrip(", \n"), i
    return found


_STEPS = _steps(_PRELUDE.removeprefix("WITH "))
_STEPS["vocabulary"] = "vocabulary AS (SELECT rank, token_hex FROM ranked WHERE rank < 4096)"


def _with_needed(body: str) -> str:
    """A query with the steps it needs before it, and no others."""
    needed, text = set(), [body]
    while text:
        words = set(re.findall(r"\w+", text.pop()))
        for name in (words & _STEPS.keys()) - needed:
            needed.add(name)
            text.append(_STEPS[name])
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) if n in _SHARED else s for n, s in _STEPS.items() if n in needed]
    return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + body


ORACLE = {**{name: _with_needed(body) for name, body in _DERIVED.items()}, **_PLAIN}
