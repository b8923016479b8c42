"""Token ids of whole texts, by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np

#: Pieces that one worker remembers, texts learned from together, and characters of a text cut at a time.
REMEMBER, TOGETHER, SLICE = 1_000_000, 200, 1 << 20
_LETTERS = "a-zß-öø-įı-ɏ"
#: Texts in which lower-casing and normalisation change single letters only, and their pre-tokens.
_PLAIN = re.compile(f"[\\t\\n\\r -~À-ÖØ-öø-įı-ɏ]*")
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\\[-`{{-~]+")


class _Numbers(dict):
    """Numbers pieces by first sight; `new` has those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of texts exactly as the tokenizer's own `encode`, as little-endian bytes of `width` each.

    A tokenizer whose pre-tokens never span a space encodes a text piece by piece; pieces repeat, so each one is
    encoded once and remembered, up to a bound. Where the tokenizer lower-cases, marks word ends and parts words,
    digits and marks, the pieces of plain texts are its pre-tokens, and new words are encoded many at a time;
    elsewhere they are the chunks between spaces. Any other tokenizer encodes each text itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_chunk = self._same("One, two  three\nfour", ["One,", "two", "three", "four"])
        self.by_piece = bool(self.ends.any()) and self._same("It's Ünder-12!? ''don't", ["it", "'s", "ünder", "-", "1", "2", "!?", "''", "don", "'t"])
        self._forget()

    def _forget(self) -> None:
        """Start with no pieces: a number for each, and where its ids lie in one array."""
        self.numbers, self.used = _Numbers(), 0
        self.start, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=f"<u{self.width}")

    def _same(self, text: str, parts: list[str]) -> bool:
        whole, each = self._each([text]), self._each(parts)
        return whole[0] == b"".join(each)

    def encode(self, text: str | None) -> bytes:
        """Ids of the text without special tokens added; null counts as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """`encode` of each text, learning the new pieces of many texts together."""
        for i in range(0, len(texts), TOGETHER):
            some = [t or "" for t in texts[i : i + TOGETHER]]
            if not self.by_chunk:
                yield from self._each(some)
                continue
            cut = [[p for part in _slices(t) for p in self._pieces(part)] for t in some]
            if len(self.numbers) > REMEMBER:
                self._forget()
            n = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
            self._learn(self.numbers.new)
            self.numbers.new = []
            size = self.size[n]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.start[n] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
            ends = (upto[np.cumsum([0, *map(len, cut)])] * self.width).tolist()
            yield from (ids[x:y] for x, y in zip(ends, ends[1:]))

    def _pieces(self, text: str) -> list[str]:
        if self.by_piece and not any(t in text for t in self.special) and _PLAIN.fullmatch(text):
            return _PIECE.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; their numbers follow those of all before."""
        word = [self.by_piece and p.isalpha() and _PLAIN.fullmatch(p) is not None for p in pieces]
        many, each = self._many([p for p, w in zip(pieces, word) if w]), self._each([p for p, w in zip(pieces, word) if not w])
        found = [next(many) if w else None for w in word]
        rest = iter(each)
        found = [next(rest) if f is None else f for f in found]
        size = np.array([len(f) for f in found], dtype=np.int64) // self.width
        first, last = len(self.numbers) - len(pieces), len(self.numbers)
        ids = np.frombuffer(b"".join(found), f"<u{self.width}")
        self.start, self.size, self.ids = _room(self.start, last), _room(self.size, last), _room(self.ids, self.used + len(ids))
        self.size[first:last], self.start[first:last] = size, self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _many(self, words: list[str]) -> Iterator[bytes]:
        """Words that are one pre-token each, encoded as one text and parted at the word ends."""
        if not words:
            return
        ids = np.frombuffer(self._each([" ".join(words)])[0], f"<u{self.width}")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            yield from self._each(words)
            return
        data, at = ids.tobytes(), 0
        for cut in (cuts * self.width).tolist():
            yield data[at:cut]
            at = cut

    def id(self, number: int) -> bytes:
        return array(self.code, [number]).tobytes()


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it has n places."""
    if n <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), dtype=values.dtype)])


def _slices(text: str) -> Iterator[str]:
    """Parts of the text, cut at spaces after SLICE characters each."""
    at = 0
    while len(text) - at > SLICE and (cut := text.find(" ", at + SLICE)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


@cache
def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    return Encoder(path)


def default_tokenizer() -> str:
    """The vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
