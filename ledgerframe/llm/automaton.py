"""Byte-pair encoding by a token automaton: merges compiled one gadget after another, words encoded and decoded along its arcs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.llm.tokens import _PIECE, _PLAIN, _slices, default_tokenizer

#: Pieces and chunks, and prefixes of words, that one worker remembers; texts whose ids are gathered together.
REMEMBER, TOGETHER = 500_000, 200
#: More than any symbol's number: a table's key is the state or prefix times this, plus the symbol.
WIDE = 1 << 24


class TokenAutomaton:
    """Deterministic automaton over tokens whose paths are exactly the encodings of words.

    It starts as one state with an arc to itself for every base symbol, which is every symbol string. The gadget of a
    merge u v goes in, rule by rule: the arcs of u, which all led to one state q, lead to a new state that is q without
    its arc v, and every state with an arc u gets an arc uv to where v leads from q. So the state reached by a token
    depends on that token alone (`target`), there is one state a merge at most, and a word has one path.

    A state is kept as what it lacks: the state it was copied from, the arc taken out and the rule that did it. An arc
    uv is there where u was when uv was born. `row` expands a state's chain of copies into a table, once it is needed.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.born = dict.fromkeys(base, -1)
        self.left: dict[int, int] = {}
        self.target = dict.fromkeys(base, 0)
        self.parent, self.removed, self.rule = [-1], [-1], [-1]
        for k, (u, v, uv) in enumerate(merges):
            if u not in self.born or v not in self.born or uv in self.born:
                raise ValueError(f"merge {k} has a part that no earlier merge makes, or a result that one has made")
            q = self.target[u]
            leads = self.target[v]
            self.parent.append(q)
            self.removed.append(v)
            self.rule.append(k)
            self.target[u] = len(self.parent) - 1
            self.born[uv], self.left[uv], self.target[uv] = k, u, leads
        self.rows: dict[int, dict[int, int]] = {0: {}}

    def row(self, state: int) -> dict[int, int]:
        """The state's table: each token whose arc was taken out on the way to it, and by which rule."""
        if (found := self.rows.get(state)) is None:
            found, at = {}, state
            while at:
                found[self.removed[at]] = self.rule[at]
                at = self.parent[at]
            self.rows[state] = found
        return found

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the token may follow: no token that it grew from at its left end had lost its arc when the next one was born."""
        row = self.row(state)
        if token in row:
            return False
        left, born = self.left, self.born
        while row and (grown := left.get(token)) is not None:
            if (rule := row.get(grown)) is not None and born[token] >= rule:
                return False
            token = grown
        return True


class Codec:
    """A BPE vocabulary's automaton with its spelling: `encode_word` goes from symbols to tokens, `decode` from tokens to labels.

    Arcs that end at a symbol are found by a table of the tokens' spellings from their last symbol backwards. As every
    prefix of a word has one path, one arc at most into each symbol leaves a state that the walk has reached.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE vocabularies have this automaton")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.decoder is not None:
            raise ValueError("labels are what decoding gives only where the vocabulary names no decoder")
        self.suffix, self.vocabulary = model["end_of_word_suffix"] or "", model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {u + v for u, v in merges}
        base = {t: i for t, i in self.vocabulary.items() if t not in made}
        number = self.vocabulary
        self.automaton = TokenAutomaton(list(base.values()), [(number[u], number[v], number[u + v]) for u, v in merges])
        spelled = {i: (i,) for i in base.values()}
        for u, v in merges:
            spelled[number[u + v]] = spelled[number[u]] + spelled[number[v]]
        self.base, self.back, self.ending = base, {}, {}
        self._prefixes()
        nodes = 1
        for token, symbols in spelled.items():
            node = 0
            for s in reversed(symbols):
                if (after := self.back.get(node * WIDE + s)) is None:
                    after = self.back[node * WIDE + s] = nodes
                    nodes += 1
                node = after
            self.ending[node] = token
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = [""] * (max([*self.vocabulary.values(), *added]) + 1)
        for t, i in chain(self.vocabulary.items(), self.special.items()):
            self.labels[i] = t
        self.by_piece = self._plain()
        self._forget()

    def _plain(self) -> bool:
        """Whether the pieces of plain texts are this tokenizer's pre-tokens."""
        text = "It's Ünder-12!? ''don't \tÀé"
        return bool(self.suffix) and [p for p, _ in self._split(text)] == [self._bytes(p) for p in _PIECE.findall(text.lower())]

    def _forget(self) -> None:
        """Start with no pieces: each has a number, by which its ids are found in one array."""
        self.numbers: dict[str, int] = {}
        self.chunks: dict[str, list[int]] = {}
        self.start, self.size, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4"), 0

    def _split(self, text: str) -> list:
        """Pre-tokens of a text, spelled in the vocabulary's symbols."""
        normal = self.tokenizer.normalizer
        text = normal.normalize_str(text) if normal else text
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if text else []

    @staticmethod
    def _bytes(piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(byte_symbols().__getitem__, piece.encode("utf-8", "surrogatepass")))

    def _prefixes(self) -> None:
        """Start the table of word prefixes: transitions by (prefix, symbol), and each prefix's way back along its path."""
        self.steps: dict[int, int] = {}
        self.up, self.symbol, self.token, self.before, self.state = [-1], [-1], [-1], [-1], [0]

    def _arc_into(self, at: int, symbol: int) -> tuple[int, int]:
        """The token whose arc ends at the symbol after prefix `at`, and the prefix where that arc starts."""
        back, ending, state, before, has_arc = self.back, self.ending, self.state, self.symbol, self.automaton.has_arc
        node = back[symbol]
        while True:
            token = ending.get(node)
            if token is not None and has_arc(state[at], token):
                return token, at
            node = back.get(node * WIDE + before[at])
            if node is None:
                raise ValueError("no path: the merges are not in an order that the automaton can keep")
            at = self.up[at]

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-token in the vocabulary's symbols; symbols outside it are left out.

        Prefixes that other words have shared are transitions of the table; a new one is computed once.
        """
        if len(self.up) > REMEMBER:
            self._prefixes()
        symbols = [*word[:-1], word[-1] + self.suffix] if word else []
        symbols = [self.base[s] for s in symbols if s in self.base]
        if not symbols:
            return []
        at, steps = 0, self.steps
        for s in symbols[:-1]:
            after = steps.get(at * WIDE + s)
            if after is None:
                token, start = self._arc_into(at, s)
                after = steps[at * WIDE + s] = len(self.up)
                for column, value in zip((self.up, self.symbol, self.token, self.before, self.state), (at, s, token, start, self.automaton.target[token])):
                    column.append(value)
            at = after
        token, at = self._arc_into(at, symbols[-1])
        tokens = [token]
        while at:
            tokens.append(self.token[at])
            at = self.before[at]
        return tokens[::-1]

    def _number(self, piece: str, ids: list[int]) -> int:
        n = self.numbers[piece] = len(self.numbers)
        if n == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n], self.size[n] = self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return n

    def _plain_numbers(self, text: str) -> list[int]:
        pieces, known = _PIECE.findall(text.lower()), self.numbers
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            for p in pieces:
                if p not in known:
                    self._number(p, self.encode_word(self._bytes(p)))
            return list(map(known.__getitem__, pieces))

    def _chunk_numbers(self, chunk: str) -> list[int]:
        if (found := self.chunks.get(chunk)) is None:
            found = []
            for word, _ in self._split(chunk):
                key = "\0" + word  # spelled in symbols, apart from plain pieces
                found.append(self.numbers[key] if key in self.numbers else self._number(key, self.encode_word(word)))
            self.chunks[chunk] = found
        return found

    def _pieces(self, text: str) -> Iterator[int]:
        """Numbers of the text's pieces. No pre-token spans a space, a line end or a special token."""
        for part in self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]:
            if part in self.special:
                key = "\1" + part
                yield self.numbers[key] if key in self.numbers else self._number(key, [self.special[part]])
            else:
                for some in _slices(part):
                    if self.by_piece and _PLAIN.fullmatch(some):
                        yield from self._plain_numbers(some)
                    else:
                        for chunk in some.replace("\n", " ").split(" "):
                            if chunk:
                                yield from self._chunk_numbers(chunk)

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text without special tokens added, as little-endian unsigned 32-bit numbers; null counts as empty."""
        for i in range(0, len(texts), TOGETHER):
            if len(self.numbers) + len(self.chunks) > REMEMBER:
                self._forget()
            cut = [list(self._pieces(t or "")) for t in texts[i : i + TOGETHER]]
            n = np.fromiter(chain.from_iterable(cut), np.int64, sum(map(len, cut)))
            size = self.size[n]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.start[n] - upto[:-1], size) + np.arange(upto[-1])]
            yield from np.split(ids, upto[np.cumsum([len(c) for c in cut])][:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The labels of a path's arcs, a space between two."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


@cache
def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is a visible Latin-1 character, else the next of those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(other)) for b in range(256)]


@cache
def codec(path: str) -> Codec:
    """This worker's codec for the file."""
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, whole: bool = True) -> DataFrame:
    """Each row's whole text (doc_id, text) as token ids, and what those ids decode to.

    One row per input row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers),
    decoded_sha256 (of the decoded text in UTF-8), and if `whole`, ids (array<int>) and decoded too. Null and empty texts
    have no ids and decode to an empty text; texts of any length are encoded whole. Null ids, ties and repeated rows are
    rows like others; other columns, whatever their names, don't matter. No rows give no rows.
    """
    path = tokenizer or default_tokenizer()

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                some = batch.iloc[first : first + TOGETHER]
                rows = []
                for ids in coder.encode_all(some["text"].tolist()):
                    text = coder.decode(ids)
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, ids.astype("<i4"), text) if whole else row)
                frame = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(rows[0])])
                frame.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield frame

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else "")
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(one, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
