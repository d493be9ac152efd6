"""Byte-pair ids and character spans of whole texts, by pieces that are encoded once.

The tokenizer first cuts a text by its pattern and then encodes each piece by itself. A space between
two characters that are no white space always begins a piece, so a text cut before such spaces encodes
to the chunks' ids one after another, and a chunk seen before needs no second encoding. A mark or line
break behind a letter begins a piece too, so a word is encoded once whatever follows it. Texts with the
string of a special token are encoded as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from operator import is_not

import numpy as np
from tokenizers import Tokenizer

from glossmeter.llm.common import remembers

_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: A word, and what follows it from a mark or line break on.
_WORD = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~\n].*)?", re.S)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# Spark deals the texts to cores already; the tokenizer's own threads only wait for one another.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks that are encoded together, and half of what a worker remembers: chunks, and words that most of them are made of.
GROUP, REMEMBERED, WORDS = 2000, 160_000, 60_000


class Recent(dict):
    """What was met of late. When it has grown to `most`, it begins anew; what is met again comes over from the time before, the rest goes.

    Most chunks are met once, so a memory that keeps what comes again may be small.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def lacks(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that are unknown; what is known from before comes over."""
        out = []
        for key in keys:
            if key not in self:
                value = self.before.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out

    def shrink(self) -> None:
        if len(self) > self.most:
            self.before.clear()
            self.before.update(self)
            self.clear()


class Encoder:
    """Ids, and spans in characters, of texts. What is remembered changes no result."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in a byte-level vocabulary each character of an entry stands for a byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, i in vocabulary.items():
            self.n_bytes[i] = len(entry)
        self.ids, self.spans = Recent(REMEMBERED), Recent(REMEMBERED)
        self.first_ids = Recent(REMEMBERED)                   # of what has no space before it: begins a text, or follows a word
        self.word_ids = Recent(WORDS)                         # of words, after a space
        # a word is one piece, so its bytes may go to the model at once; how the tokenizer writes the bytes of each letter
        self.letters = {} if self.tokenizer.normalizer else {
            ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in [" ", *re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x250))))]}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks: list[str], spans: bool) -> None:
        """Encode chunks, each after a space, in one call and remember the ids (or spans) of each.

        Spans are counted from the space. A token that holds a part of a character's bytes spans it.
        """
        joined = "".join([" " + c for c in chunks])
        ids = self._ids(joined)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        raw = np.frombuffer(joined.encode(), np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)              # the first byte of each character
        ends = np.append(first, len(raw))[np.cumsum(size)]
        after = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(after, ends) + 1                   # tokens up to and with the chunk
        if spans:
            char = np.cumsum((raw & 0xC0) != 0x80) - 1
            base = np.repeat(np.cumsum(size) - size, np.diff(last, prepend=0))
            low = char[np.concatenate(([0], after[:-1]))] - base
            high = char[after - 1] + 1 - base
            packed, width, known = np.stack([low, high], 1).astype(np.int32).tobytes(), 8, self.spans
        else:
            packed, width, known = ids.tobytes(), 4, self.ids
        cut = (last * width).tolist()
        known.update(zip(chunks, [packed[i:j] for i, j in zip([0, *cut], cut)]))

    def _learn_ids(self, chunks: list[str]) -> None:
        """Encode chunks, each after a space, and remember the ids of each: those of its word and of what follows it."""
        cut = [(c, *m.groups()) for c in chunks if (m := _WORD.fullmatch(c))] if self.letters else []
        words = self.word_ids.lacks({w for _, w, _ in cut})
        found = map(self.tokenizer.model.tokenize, [(" " + w).translate(self.letters) for w in words])
        self.word_ids.update(zip(words, [array("I", [t.id for t in f]).tobytes() for f in found]))
        self._learn_first({rest for _, _, rest in cut if rest})
        self.ids.update([(c, self.word_ids[w] + self.first_ids[rest] if rest else self.word_ids[w]) for c, w, rest in cut])
        others = [c for c in chunks if c not in self.ids]
        if others:
            self._learn(others, False)

    def _learn_first(self, parts: set[str]) -> None:
        """Encode parts, each without a space before it, and remember their ids."""
        parts = self.first_ids.lacks(parts)
        for i in range(0, len(parts), GROUP):
            found = self.tokenizer.encode_batch_fast(parts[i:i + GROUP], add_special_tokens=False)
            self.first_ids.update(zip(parts[i:], [np.array(f.ids, np.uint32).tobytes() for f in found]))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(got.ids, np.uint32).tobytes(), np.array(got.offsets, np.int32).tobytes()

    def _cut(self, text: str, known: Recent, fresh: set[str]) -> tuple[list[str], list] | None:
        """Chunks between the spaces that begin a piece, and what is known of each, the new ones also to `fresh`; None if the text is to be encoded as it is."""
        if not text or any(s in text for s in self.special):
            return None
        chunks = text.split(" ")
        found = [*map(known.get, chunks)]
        new = [c for c, f in zip(chunks, found) if f is None]
        if "" in new or any(map(is_not, map(str.strip, new), new)):       # strip gives the very string if there is nothing to strip
            chunks = _CUT.split(text)
            if chunks[0][:1].isspace():
                return None
            found = [*map(known.get, chunks)]
            new = [c for c, f in zip(chunks[1:], found[1:]) if f is None]
        fresh.update(new)
        return chunks, found

    def encode(self, texts: list[str], spans: bool = False) -> list:
        """Per text: its ids as little-endian unsigned 32-bit numbers, or with `spans` the starts and ends of its tokens."""
        known = self.spans if spans else self.ids
        for held in (known, self.first_ids, self.word_ids):
            held.shrink()
        fresh: set[str] = set()
        cuts = [self._cut(t, known, fresh) for t in texts]
        new = known.lacks(fresh)
        for i in range(0, len(new), GROUP):
            self._learn(new[i:i + GROUP], True) if spans else self._learn_ids(new[i:i + GROUP])
        if not spans:
            self._learn_first({c[0][0] for c in cuts if c})
        return [(self._spans if spans else self._packed)(t, c) for t, c in zip(texts, cuts)]

    def _packed(self, text: str, cut: tuple[list[str], list] | None) -> bytes:
        if cut is None:
            return self._whole(text)[0] if text else b""
        chunks, found = cut
        parts = [self.ids[c] if f is None else f for c, f in zip(chunks[1:], found[1:])]
        return b"".join([self.first_ids[chunks[0]], *parts])

    def _spans(self, text: str, cut: tuple[list[str], list] | None) -> tuple[np.ndarray, np.ndarray]:
        if cut is None:
            parts, base = [self._whole(text)[1]] if text else [b""], 0
        else:
            chunks, found = cut
            parts = [self._whole(chunks[0])[1], *(self.spans[c] if f is None else f for c, f in zip(chunks[1:], found[1:]))]
            size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
            size[0] -= 1
            base = np.repeat(np.cumsum(size) - size, np.fromiter(map(len, parts), np.int64, len(parts)) // 8)[:, None]
        both = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2) + base
        return both[:, 0], both[:, 1]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    remembers("encoders", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
