"""Tokenizers of the parity tables: encode, decode, and what stands for unknown text.

A tokenizer is named by a spec; the object itself is made once per worker process from model
files or an installed library. Nothing stands in for one that is not available.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glossmeter.counters import joined_text
from glossmeter.functions import text as T

# Parity table names and where their models come from.
HF_MODELS = {
    "Glot500": "cis-lmu/glot500-base",
    "NLLB": "facebook/nllb-200-distilled-600M",
    "Qwen": "Qwen/Qwen-7B-Chat",
    "LLAMA": "meta-llama/Llama-2-7b-chat-hf",
    "RoBERTa": "roberta-base",
    "GottBERT": "uklfr/gottbert-base",
    "CamemBERT": "camembert-base",
    "PhoBERT": "vinai/phobert-base",
    "RoCBert": "weiweishi/roc-bert-base-zh",
    "XLM-RoBERTa": "xlm-roberta-base",
    "M2M100": "facebook/m2m100_418M",
    "MBart50": "facebook/mbart-large-50",
    "mT5": "google/mt5-small",
    "FlanT5": "google/flan-t5-xxl",
    "ByT5": "google/byt5-base",
    "CANINE": "google/canine-c",
    "BLOOM": "bigscience/bloom",
    "ArabicBERT": "asafaya/bert-base-arabic",
    "MuRIL": "google/muril-base-cased",
    "BERT Japanese": "cl-tohoku/bert-base-japanese",
}
TIKTOKEN_NAMES = {"GPT-2": "gpt2", "r50k_base": "r50k_base", "p50k_base": "p50k_base", "p50k_edit": "p50k_edit",
                  "cl100k_base": "cl100k_base"}
SEAMLESS_UNKNOWN = (248059, 1)


@dataclass(frozen=True)
class Codec:
    """Encode and decode functions, and the token (or token sequence) that marks unknown text."""

    encode: Callable[[str], Sequence[int]]
    decode: Callable[[list[int]], str]
    unknown: tuple[int, ...] = ()


def without(ids: Sequence[int], marks: Sequence[int]) -> list[int]:
    """Tokens without the unknown mark, whole tokens only, left to right."""
    ids, marks = list(ids), list(marks)
    if len(marks) == 1:
        return [i for i in ids if i != marks[0]]
    out, at = [], 0
    while at < len(ids):
        if marks and ids[at:at + len(marks)] == marks:
            at += len(marks)
        else:
            out.append(ids[at])
            at += 1
    return out


def from_tiktoken(name: str) -> Codec:
    import tiktoken
    encoding = tiktoken.get_encoding(name)
    return Codec(encoding.encode, encoding.decode)


def from_transformers(model: str) -> Codec:
    from transformers import AutoTokenizer
    tok = AutoTokenizer.from_pretrained(model, trust_remote_code=model.startswith("Qwen/"))
    unknown = () if tok.unk_token is None else (tok.convert_tokens_to_ids(tok.unk_token),)
    return Codec(lambda s: tok.convert_tokens_to_ids(tok.tokenize(s)), tok.decode, unknown)


def from_tokenizers_file(path: str, unknown_token: str | None = None) -> Codec:
    """Model file of the tokenizers library."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    mark = tok.token_to_id(unknown_token) if unknown_token else None
    return Codec(lambda s: tok.encode(s, add_special_tokens=False).ids,
                 lambda ids: tok.decode(ids, skip_special_tokens=False), () if mark is None else (mark,))


def from_sentencepiece_file(path: str) -> Codec:
    import sentencepiece
    tok = sentencepiece.SentencePieceProcessor(model_file=path)
    return Codec(tok.encode, tok.decode, (tok.unk_id(),))


_made: dict[str, Codec] = {}


@dataclass(frozen=True)
class CodecTokenizer:
    """Parity tokenizer over a codec; has to see the joined text of a language."""

    name: str
    make: Callable[[], Codec]

    def _codec(self) -> Codec:
        if self.name not in _made:
            _made[self.name] = self.make()
        return _made[self.name]

    def counts(self) -> Callable[[Column], Column]:
        """Struct column (n_tokens, n_known_chars) of whole texts."""
        @F.pandas_udf("n_tokens bigint, n_known_chars bigint")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = self._codec()
            for batch in batches:
                rows = []
                for s in batch:
                    ids = list(codec.encode(s))
                    known = len(codec.decode(without(ids, codec.unknown))) if codec.unknown else len(s)
                    rows.append((len(ids), known))
                yield pd.DataFrame(rows, columns=["n_tokens", "n_known_chars"])
        return count


def codec_lengths(units: DataFrame, tokenizers: Sequence[CodecTokenizer], first: int = 0) -> DataFrame:
    """(lang, tokenizer, ord, n_tokens, n_unknown) of the joined text of each language, long.

    A language has to fit one row (see joined_text); additive tokenizers have no such bound.
    """
    joined = joined_text(units.withColumn("corpus", F.lit("all"))).select("lang", "text")
    entries = []
    for i, t in enumerate(tokenizers):
        joined = joined.withColumn(f"_c{i}", t.counts()("text"))
        n = F.col(f"_c{i}.n_tokens")
        unknown = T.unknown_count(n, F.char_length("text").cast("bigint"), F.col(f"_c{i}.n_known_chars"))
        entries.append(F.struct(F.lit(t.name).alias("tokenizer"), F.lit(first + i).alias("ord"),
                                n.alias("n_tokens"), unknown.alias("n_unknown")))
    return joined.select("lang", F.explode(F.array(*entries)).alias("_e")).select("lang", "_e.*")


def available(name: str) -> tuple[CodecTokenizer | None, str]:
    """A registered tokenizer, or the reason it cannot be made here."""
    if name in TIKTOKEN_NAMES:
        spec = TIKTOKEN_NAMES[name]
        try:
            from_tiktoken(spec)
        except Exception as error:
            return None, f"encoding {spec!r} is unavailable ({type(error).__name__})"
        return CodecTokenizer(name, lambda: from_tiktoken(spec)), ""
    if name in HF_MODELS:
        try:
            import transformers  # noqa: F401
        except ImportError:
            return None, "transformers is not installed"
        return CodecTokenizer(name, lambda: from_transformers(HF_MODELS[name])), ""
    if name == "SeamlessM4T":
        return None, "needs a fairseq-style encoder; pass a Codec with unknown=SEAMLESS_UNKNOWN"
    return None, f"unknown tokenizer {name!r}"
