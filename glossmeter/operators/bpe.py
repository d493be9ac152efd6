"""Byte-pair vocabularies: slices, counts, size sweeps and token-to-text alignment.

A vocabulary is a table (token BINARY, rank BIGINT) of bounded size; it is checked and then
shipped to the workers once. Text is cut into pieces by the split pattern in the JVM; since
merges never cross a piece, equal pieces are merged first and each is encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from glossmeter.operators.joined import PieceCounter, Splitter

# Fixed value: the split pattern of the gpt2 / r50k / p50k encodings.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_VOCABULARY = 2_000_000


def collect_ranks(vocabulary: DataFrame, limit: int = MAX_VOCABULARY) -> dict[bytes, int]:
    """Vocabulary table as a dict for broadcasting; refused over the limit."""
    rows = vocabulary.select("token", "rank").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"vocabulary has more than {limit} tokens")
    return {bytes(r["token"]): int(r["rank"]) for r in rows}


def truncate(vocabulary: DataFrame, size: float) -> DataFrame:
    """Tokens with rank below ``size``."""
    return vocabulary.where(F.col("rank") < size)


def vocabulary_slice(vocabulary: DataFrame, start: int, stop: int) -> DataFrame:
    """Tokens by rank range, ready for display."""
    return (vocabulary.where((F.col("rank") >= start) & (F.col("rank") < stop))
            .select("rank", F.hex("token").alias("token_hex"), F.decode("token", "UTF-8").alias("text")))


def byte_vocabulary(spark) -> DataFrame:
    """The 256 single bytes, the base every byte-pair vocabulary needs."""
    return spark.range(256).select(
        F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").alias("rank"))


def prefix_vocabulary(texts: DataFrame, size: int) -> DataFrame:
    """Vocabulary of ``size`` tokens from the data itself, where no vocabulary file is at hand.

    The single bytes, then the heaviest prefixes of all words (leading space included). A
    prefix weighs as much as all words that begin with it, and of equal weights the shorter
    comes first; so the next shorter prefix always has a lower rank, and each token can be
    reached by merging it with a following one. Every word of the texts counts; the size is
    that of the vocabulary, and only that many prefixes are ranked.
    """
    words = (texts.select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
             .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    prefixes = (words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")),
                                                     lambda i: F.substr(F.col("word"), F.lit(1), i))).alias("prefix"))
                .groupBy("prefix").agg(F.sum("n").alias("n"))
                .where(F.octet_length("prefix") > 1))
    order = [F.desc("n"), F.char_length("prefix"), F.col("prefix")]
    kept = prefixes.orderBy(*order).limit(max(0, size - 256))
    place = F.row_number().over(Window.orderBy(*order))
    longer = kept.select(F.encode("prefix", "UTF-8").alias("token"), (place + 255).cast("bigint").alias("rank"))
    return byte_vocabulary(texts.sparkSession).unionByName(longer)


# -- encoders on the workers ---------------------------------------------------------------

_encodings: dict[tuple, object] = {}
MAX_ENCODERS = 64       # kept per worker process


def _encoding(ranks, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """Encoder of a broadcast vocabulary, built once per worker process."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern, special)
    if key not in _encodings:
        import tiktoken
        if len(_encodings) >= MAX_ENCODERS:
            _encodings.clear()
        _encodings[key] = tiktoken.Encoding("custom", pat_str=pattern, mergeable_ranks=ranks.value,
                                            special_tokens=dict(special))
    return _encodings[key]


class _Ranks:
    """Picklable handle of a broadcast vocabulary."""

    def __init__(self, broadcast, key: str):
        self._broadcast, self.id = broadcast, key

    @property
    def value(self) -> dict[bytes, int]:
        return self._broadcast.value


def share(spark, ranks: Mapping[bytes, int]) -> _Ranks:
    """Broadcast a (size-checked) vocabulary."""
    digest = hashlib.sha256()
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        digest.update(token + b"\0" + str(rank).encode() + b"\0")
    return _Ranks(spark.sparkContext.broadcast(dict(ranks)), digest.hexdigest())


_WHOLE = r"[\s\S]+"     # a piece is encoded as it is, without splitting again


def encode_column(ranks: _Ranks, pattern: str = SPLIT_PATTERN,
                  special: Mapping[str, int] | None = None) -> Callable[[Column], Column]:
    """Token ids of whole texts. Text holding a special token's string raises, as in tiktoken."""
    specials = tuple(sorted((special or {}).items()))

    @F.pandas_udf(ArrayType(LongType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoding(ranks, pattern, specials)
        for batch in batches:
            yield batch.map(encoder.encode, na_action="ignore")
    return encode


def count_column(ranks: _Ranks, pattern: str = SPLIT_PATTERN,
                 special: Mapping[str, int] | None = None) -> Callable[[Column], Column]:
    """Token counts of whole texts; only the count travels back."""
    specials = tuple(sorted((special or {}).items()))

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoding(ranks, pattern, specials)
        for batch in batches:
            yield batch.map(lambda s: len(encoder.encode_to_numpy(s)), na_action="ignore").astype("Int64")
    return count


def piece_counts(texts: DataFrame, group: Sequence[str], text: str = "text",
                 pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(group, piece, n): the distinct pieces of all texts of a group, merged map-side."""
    pieces = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))
    return (texts.select(*group, F.explode(pieces).alias("piece"))
            .groupBy(*group, "piece").agg(F.count(F.lit(1)).alias("n")))


def splitter(ranks: _Ranks, pattern: str = SPLIT_PATTERN) -> Splitter:
    """The split pattern, and the tokens of one piece, for totals that are merged from runs of sentences."""
    def make():
        encoder = _encoding(ranks, _WHOLE)
        return pattern, lambda piece: len(encoder.encode_ordinary(piece))
    return make


def vocabulary_counter(counter_id: str, spec: str, ranks: _Ranks, pattern: str = SPLIT_PATTERN) -> PieceCounter:
    return PieceCounter(counter_id, spec, count_column(ranks, pattern), joiner=None, splitter=splitter(ranks, pattern))


def read_ranks(spark, path: str) -> DataFrame:
    """Vocabulary table of a ranks file: lines of a token in base 64 and its rank."""
    parts = F.split(F.trim("value"), " ")
    return (spark.read.text(path).where(F.trim("value") != "")
            .select(F.unbase64(parts[0]).alias("token"), parts[1].cast("bigint").alias("rank")))


def ranks_file_counter(spark, counter_id: str, path: str, pattern: str = SPLIT_PATTERN) -> PieceCounter:
    """Counter over a ranks file in any store that Spark reads. Single bytes that it lacks are an error."""
    ranks = collect_ranks(read_ranks(spark, path))
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"ranks file {path} lacks {len(missing)} single bytes")
    return vocabulary_counter(counter_id, path, share(spark, ranks), pattern)


# -- alignment -----------------------------------------------------------------------------

ALIGNED = "array<struct<tokens:array<bigint>,text:string>>"
INCOMPLETE = "\ufffd"


def align(tokens: Iterable[int], decode: Callable[[list[int]], str]) -> list[tuple[list[int], str]]:
    """Group tokens until they decode to text; a rest that never does is dropped."""
    groups, pending = [], []
    for token in tokens:
        pending = [*pending, int(token)]
        try:
            text = decode(pending)
        except UnicodeDecodeError:
            groups.append((pending, ""))
            pending = []
            continue
        if text and text != INCOMPLETE:
            groups.append((pending, text))
            pending = []
    return groups


class _Aligner:
    """Alignment of many texts under one vocabulary.

    Tokens that decode on their own, nearly all of them, are groups of one; only the places in
    between walk through the buffering rule. A group is named by a code: its token, or a
    number past the vocabulary for a text put together here.
    """

    def __init__(self, encoder):
        self.encoder = encoder
        alone = [encoder.decode([t]) for t in range(encoder.n_vocab)]
        self.texts = pa.array(alone, pa.string())
        self.whole = np.array([bool(t) and t != INCOMPLETE for t in alone])
        self.forget()

    def forget(self) -> None:
        """Start a batch: nothing put together in earlier ones is kept."""
        self.known: dict[bytes, int] = {}       # codes of put-together groups, by their tokens
        self.extra: list[str] = []

    def _group(self, ids: np.ndarray, at: int) -> tuple[int, int] | None:
        """(end, code) of the group that starts at a token which does not decode alone."""
        for end in range(at + 2, len(ids) + 1):
            key = ids[at:end].tobytes()
            code = self.known.get(key)
            if code is None:
                text = self.encoder.decode(ids[at:end].tolist())
                if not text or text == INCOMPLETE:
                    continue
                code = self.known[key] = len(self.texts) + len(self.extra)
                self.extra.append(text)
            return end, code
        return None

    def groups(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, group sizes and group codes of one text, dropped rest excluded."""
        ids = self.encoder.encode_to_numpy(text).astype(np.int64)
        starts, sizes, codes, at = [], [], [], 0
        for odd in np.flatnonzero(~self.whole[ids]).tolist():
            if odd < at:
                continue
            found = self._group(ids, odd)
            if found is None:
                ids = ids[:odd]
                break
            at, code = found
            starts.append(odd)
            sizes.append(at - odd)
            codes.append(code)
        if not starts:
            return ids, np.ones(len(ids), dtype=np.int64), ids
        size, code, kept = np.ones(len(ids), dtype=np.int64), ids.copy(), np.ones(len(ids), dtype=bool)
        size[starts], code[starts] = sizes, codes
        for start, n in zip(starts, sizes):
            kept[start + 1:start + n] = False
        return ids, size[kept], code[kept]

    def texts_of(self, codes: np.ndarray) -> pa.Array:
        """Texts of groups; those that were put together stand behind the vocabulary's."""
        alone = codes < len(self.texts)
        if alone.all():
            return self.texts.take(pa.array(codes))
        used = np.unique(codes[alone])
        known = pa.concat_arrays([self.texts.take(pa.array(used)), pa.array(self.extra, pa.string())])
        place = np.where(alone, np.searchsorted(used, codes), codes - len(self.texts) + len(used))
        return known.take(pa.array(place))


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


#: Bytes of the texts that are aligned together.
ALIGNED_BYTES = 1 << 20


def _parts(texts: pa.Array, most: int = ALIGNED_BYTES) -> Iterator[pa.Array]:
    """A batch in parts of so many bytes; a text over the limit is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def align_column(ranks: _Ranks, pattern: str = SPLIT_PATTERN) -> Callable[[Column], Column]:
    """Whole texts to their aligned (tokens, text) groups."""
    @F.arrow_udf(ALIGNED)
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _Aligner(_encoding(ranks, pattern))
        for texts in (part for batch in batches for part in _parts(batch)):
            aligner.forget()
            parts = [aligner.groups(s or "") for s in texts.to_pylist()]
            none = np.zeros(0, dtype=np.int64)
            ids, sizes, codes = (np.concatenate([p[k] for p in parts] or [none]) for k in range(3))
            tokens = pa.ListArray.from_arrays(_offsets(sizes), pa.array(ids))
            groups = pa.StructArray.from_arrays([tokens, aligner.texts_of(codes)], ["tokens", "text"])
            yield pa.ListArray.from_arrays(_offsets([len(p[1]) for p in parts]), groups)
    return aligned


def token_texts_column(ranks: _Ranks, pattern: str = SPLIT_PATTERN) -> Callable[[Column], Column]:
    """Token id arrays to the text of each token on its own."""
    @F.pandas_udf(ArrayType(StringType()))
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        aligner = _Aligner(_encoding(ranks, pattern))
        for batch in batches:
            yield batch.map(lambda ids: aligner.texts.take(pa.array(ids, pa.int64())).to_pylist(), na_action="ignore")
    return texts


# Terminal backgrounds the tokens of the two display rows cycle through.
TOKEN_COLOURS = ("\x1b[41m", "\x1b[42m", "\x1b[44m", "\x1b[45m", "\x1b[46m")
COLOUR_END = "\x1b[0m"


def coloured_rows(ids: Column, texts: Column) -> Column:
    """Struct (ids, texts) of two terminal rows whose cells line up, padded with ``~``."""
    colours = F.array(*[F.lit(c) for c in TOKEN_COLOURS])
    cells = F.arrays_zip(ids.cast("array<string>").alias("i"), texts.alias("t"))

    def row(field: str) -> Column:
        def cell(z, at):
            width = F.greatest(F.char_length(z["i"]), F.char_length(z["t"]))
            return F.concat(F.element_at(colours, at % len(TOKEN_COLOURS) + 1), z[field],
                            F.repeat(F.lit("~"), width - F.char_length(z[field])), F.lit(COLOUR_END))
        return F.array_join(F.transform(cells, cell), "")
    return F.struct(row("i").alias("ids"), row("t").alias("texts"))


def reverse_aligned(groups: Column) -> Column:
    """Right-to-left display order."""
    return F.reverse(groups)


def example_record(text: Column, groups: Column, n_unknown: Column) -> Column:
    """Example entry: text, token groups, number of aligned tokens and unknown share."""
    n = F.aggregate(groups, F.lit(0).cast("bigint"), lambda acc, g: acc + F.size(g["tokens"]))
    return F.struct(text.alias("text"), F.transform(groups, lambda g: g["text"]).alias("tokens_text"),
                    F.transform(groups, lambda g: g["tokens"]).alias("tokens"), n.alias("num_tokens"),
                    (n_unknown.cast("double") / F.nullif(n, F.lit(0))).alias("unknown_fraction"))


def latex_rows(groups: Column) -> Column:
    """Body of the LaTeX alignment table: a row of boxed token ids over a row of texts."""
    def boxed(g: Column) -> Column:
        last = F.size(g["tokens"]) - 1
        return F.array_join(F.transform(g["tokens"], lambda t, i: F.concat(
            F.when(last == 0, "\\wrapword{").when(i == 0, "\\wrapwordleft{")
            .when(i == last, "\\wrapwordright{").otherwise("\\wrapwordcenter{"),
            t.cast("string"), F.lit("}"))), "")
    codes = F.array_join(F.transform(groups, boxed), " & ")
    words = F.array_join(F.transform(groups, lambda g: F.concat(F.lit("\\wrapword{"), g["text"], F.lit("}"))), " & ")
    return F.concat(codes, F.lit("\\\\\n"), words, F.lit("\n"))
