"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) model.

A sequence of pieces is the model's encoding exactly when each piece encodes to itself and no merge crosses
the border of two neighbours: the merges inside two neighbours happen in the same order beside other text as
they do in the two alone, so the first merge that crosses a border would also happen there. So encoding needs
no queue of merges. From the left, the longest piece that an Aho-Corasick automaton finds at a place is taken
if it is compatible with the piece before it, which is found by re-merging the two; if not, the next shorter
one; with none left, the place is marked in a field of failed ones, and the last piece is taken back. A
place is marked once, so the work is linear.

Characters that are no piece are pieces of their own here and become their UTF-8 bytes at the end. Where no
piece of the model has two characters beside each other, no merge crosses the place between them; so a text
is cut before space marks, and stretches before signs where they allow it, and what was met before is not
encoded again. What a worker remembers changes no result.

Texts are encoded where they are read; nothing is shuffled. Decoding goes by the ids alone.

Defined results: a null or empty text is the begin and end ids and decodes to the empty text; very long texts
and long stretches without a space take time in proportion to their length; repeated rows, ties and null ids
are rows like others; an empty table gives an empty result; other columns are ignored, so none can clash.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmeter.llm.common import documents, over_batches, remembers, steps

MARK = "▁"
#: Stretches and pairs of pieces that a worker remembers, and characters of the longest such stretch.
REMEMBERED, PAIRS, LONGEST = 400_000, 1_000_000, 64
#: Ids from here on stand for characters that are no piece.
CHARACTER = 1 << 24

_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and ids of a model file; encodes and decodes texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats
        proto = formats.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind, rule = formats.ModelProto.SentencePiece, proto.normalizer_spec
        if proto.trainer_spec.model_type != formats.TrainerSpec.BPE or rule.precompiled_charsmap or rule.remove_extra_whitespaces \
                or not rule.add_dummy_prefix or not rule.escape_whitespaces or not proto.trainer_spec.byte_fallback \
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("a merge model with byte fallback, the space mark in front, and no other normalisation is needed")
        self.begin, self.end, self.unknown = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        self.texts = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.byte_ids, self.visible, self.byte_of = [0] * 256, [b""] * len(self.texts), {}
        own: dict[str, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i], self.visible[i] = i, value, bytes([value])
            elif p.type == kind.NORMAL:
                self.visible[i] = p.piece.replace(MARK, " ").encode()
                own[p.piece] = i
            elif p.type == kind.UNKNOWN:
                self.visible[i] = proto.trainer_spec.unk_surface.encode()
        self.is_byte = np.zeros(len(self.texts), bool)
        self.is_byte[list(self.byte_of)] = True
        # pieces that merging can reach; others are never in an encoding
        self.own = {t: i for t, i in own.items() if self._reached(t)}
        # where no piece has two characters beside each other, no merge crosses the place between them
        before: dict[str, set[str]] = {c: set() for c in f"{MARK}\n\t\r{string.punctuation}"}
        for text in self.own:
            for x, y in zip(text, text[1:]):
                if y in before:
                    before[y].add(x)
        self.by_spaces = before.pop(MARK) <= {MARK}
        alike: dict[str, str] = {}
        for sign, others in before.items():
            key = "".join(sorted(others))
            alike[key] = alike.get(key, "") + sign
        ways = "|".join([(f"(?<![{re.escape(o)}])" if o else "") + f"(?=[{re.escape(signs)}])" for o, signs in alike.items()])
        self.parts = re.compile(f"(?=[{re.escape(''.join(before))}])(?:{ways})")
        #: a character of no piece, so that no match runs over it
        self.gap = next(c for c in map(chr, range(0x110000)) if not any(c in t for t in self.own))
        self.length = [len(t) for t in self.texts]
        self.sizes = np.array(self.length, np.int64)
        self.single = np.arange(CHARACTER, CHARACTER + 0x110000)
        self.single[[ord(t) for t in self.own if len(t) == 1]] = [i for t, i in self.own.items() if len(t) == 1]
        self.shorter = {i: self._shorter(t) for t, i in self.own.items()}
        self.matches = ahocorasick.Automaton()
        for text, i in self.own.items():
            if len(text) > 1:
                self.matches.add_word(text, i)
        self.matches.make_automaton()
        self.known: dict[str, bytes] = {}                    # of stretches, without their first space mark
        self.known_parts: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- merging, which decides which pieces and pairs are possible ------------------------------

    def _merge(self, parts: list[str], border: int | None = None) -> list[str] | None:
        """Merge neighbours, the highest score first and the leftmost of equal ones; None once a merge crosses the border (in characters)."""
        scores = self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            if border is not None:
                start = sum(map(len, parts[:at]))
                if start < border < start + len(parts[at]) + len(parts[at + 1]):
                    return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _reached(self, text: str) -> bool:
        return len(text) == 1 or len(self._merge(list(text))) == 1

    def _shorter(self, text: str) -> int:
        """The next shorter piece that a piece begins with; -1 for a single character."""
        for n in range(len(text) - 1, 0, -1):
            if text[:n] in self.own:
                return self.own[text[:n]]
        return CHARACTER + ord(text[0]) if len(text) > 1 else -1

    def text_of(self, i: int) -> str:
        return chr(i - CHARACTER) if i >= CHARACTER else self.texts[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of two pieces merges to the two."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.text_of(a), self.text_of(b)
            found = self.pairs[a, b] = self._merge(list(x + y), len(x)) is not None
        return found

    # -- encoding --------------------------------------------------------------------------------

    def _longest(self, text: str) -> list[int]:
        """The longest piece that begins at each character."""
        found = self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        hits = np.fromiter(chain.from_iterable(self.matches.iter(text)), np.int64).reshape(-1, 2)
        found[hits[:, 0] - self.sizes[hits[:, 1]] + 1] = hits[:, 1]      # later matches of a place are longer
        return found.tolist()

    def _walk(self, longest: list[int], start: int, stop: int) -> list[int]:
        """Pieces of a stretch, by backtracking."""
        length, shorter, pairs = self.length, self.shorter, self.pairs
        taken: list[int] = []
        failed = bytearray(stop - start + 1)
        at, piece = start, longest[start]
        while True:
            if piece >= 0:
                end = at + (length[piece] if piece < CHARACTER else 1)
                if not failed[end - start]:
                    fits = not taken or pairs.get((taken[-1], piece))
                    if fits is None:
                        fits = self.compatible(taken[-1], piece)
                    if fits:
                        taken.append(piece)
                        if end == stop:
                            return taken
                        at, piece = end, longest[end]
                        continue
                piece = shorter[piece] if piece < CHARACTER else -1
            else:
                failed[at - start] = 1
                piece = taken.pop()
                at -= length[piece] if piece < CHARACTER else 1
                piece = shorter[piece] if piece < CHARACTER else -1

    def _ids(self, pieces: list[int]) -> bytes:
        if max(pieces) >= CHARACTER:
            pieces = [i for p in pieces for i in ((p,) if p < CHARACTER else map(self.byte_ids.__getitem__, chr(p - CHARACTER).encode()))]
        return array("I", pieces).tobytes()

    def _stretches(self, text: str) -> list[str]:
        """Parts of a text that encode by themselves, each without the space mark before it."""
        marked = text.replace(MARK, " ")
        parts = marked.split(" ")
        if "" in parts:
            parts = [p[1:] for p in _STRETCH.findall(MARK + marked.replace(" ", MARK))]
        return parts

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, by one run of the automaton."""
        longest, at, out = self._longest("".join([p + self.gap for p in parts])), 0, []
        for part in parts:
            stop = at + len(part)
            out.append(self._ids(self._walk(longest, at, stop)))
            at = stop + 1
        return out

    def _remembered(self, stretches: list[str]) -> None:
        """Encode new stretches by their parts."""
        cut = [self.parts.split(MARK + s) for s in stretches]
        fresh = list({p for parts in cut for p in parts}.difference(self.known_parts))
        for a in range(0, len(fresh), 4096):
            self.known_parts.update(zip(fresh[a:a + 4096], self._learn(fresh[a:a + 4096])))
        self.known.update(zip(stretches, [b"".join(map(self.known_parts.__getitem__, parts)) for parts in cut]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text: its ids, with those of begin and end, as little-endian unsigned 32-bit numbers."""
        known = self.known
        for held in (known, self.known_parts):
            if len(held) > REMEMBERED:
                held.clear()
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        if not self.by_spaces:
            return [head + (self._learn([MARK + t.replace(" ", MARK)])[0] if t else b"") + tail for t in texts]
        split = [self._stretches(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(known)
        long = [p for p in fresh if len(p) > LONGEST]
        fresh.difference_update(long)
        self._remembered(list(fresh))
        here = {p: self._learn([MARK + p])[0] for p in long}
        look = known.__getitem__ if not here else lambda p: here[p] if p in here else known[p]
        return [b"".join([head, *map(look, parts), tail]) for parts in split]

    # -- decoding --------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8. Bytes that make no character become U+FFFD each."""
        visible, fresh = self.visible, True
        out: list[bytes] = []
        ids = np.asarray(ids)
        if not len(ids):
            return b""
        edges = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            run = ids[start:stop].tolist()
            parts = list(map(visible.__getitem__, run))
            if self.is_byte[run[0]]:
                out.append(_characters(b"".join(parts)))
                fresh = False
                continue
            for k, i in enumerate(run):
                if not fresh:
                    break
                # the space mark that encoding put in front goes
                if self.texts[i].startswith(MARK) and i in self.shorter:
                    parts[k], fresh = parts[k][1:], False
                elif parts[k]:
                    fresh = False
            out += parts
        return b"".join(out)


def _characters(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[at:at + n].decode()
            except UnicodeDecodeError:
                continue
            if at + n <= len(raw):
                out.append(raw[at:at + n])
                at += n
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker and file."""
    remembers("pieces", _MODELS.clear)
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every text; ids: packed little-endian unsigned 32-bit numbers."""
    path = path or default_model()

    def work(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        pieces = model(path)
        for a, b in steps(texts):
            ids = pieces.encode([t or "" for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()),
                                              pa.array([pieces.decode(np.frombuffer(i, "<u4")).decode() for i in ids], pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    return over_batches(docs.select("doc_id", "text"), work, "doc_id long, ids binary, decoded string")


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded texts."""
    return encode(documents(spark, sf_dir)).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
