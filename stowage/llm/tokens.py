"""Exact byte-level BPE of whole corpora in linear time, and back.

A text is cut by the tokenizer's pattern; each piece is encoded by a backtracking search: an Aho-Corasick automaton
over the vocabulary gives the longest token at every byte, a table of shorter prefixes gives the next choice, and a token may
follow another only if no merge would have crossed their border (the pair-compatibility table, filled on demand). The
first path that reaches the end is the one that merging by rank gives, and no byte is left twice by a dead end, so very long
pieces take linear time. Decoding slices one byte string through a table of offsets.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import busy

#: Folder of public tokenizer files; read by the driver only, the tables travel as a broadcast of a few MB.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
# Fixed value: the public pattern that cuts texts for these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this many characters are remembered, so many of them at a time.
REMEMBER_CHARS, REMEMBER = 48, 200_000
NONE = -1


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id of a .tiktoken file, whose ids are ranks without gaps."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"ids of {path} have gaps")
    return [tokens[i] for i in range(len(tokens))]


def halves(tokens: list[bytes]) -> np.ndarray:
    """For each token the two tokens whose merge made it; single bytes have themselves twice."""
    rank = {t: i for i, t in enumerate(tokens)}
    split = np.empty((len(tokens), 2), dtype=np.int32)
    for number, token in enumerate(tokens):
        if len(token) == 1:
            split[number] = number
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], len(tokens)) if rank.get(parts[i] + parts[i + 1], number) < number else len(tokens))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        split[number] = rank[parts[0]], rank[parts[1]]
    return split


class Encoder:
    """Tables of one vocabulary. Build on the driver, send, and call on the workers."""

    def __init__(self, tokens: list[bytes], split: np.ndarray | None = None):
        self.tokens = tokens
        self.split = halves(tokens) if split is None else split
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "split": self.split}

    def __setstate__(self, state):
        self.__init__(state["tokens"], state["split"])

    def _prepare(self) -> None:
        self.number = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = [len(t) for t in self.tokens]
        self.left, self.right = (self.split[:, k].tolist() for k in (0, 1))
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if len(self.tokens[i]) > 1}
        self.shorter = [NONE] * len(self.tokens)
        automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            automaton.add_word(token.decode("latin-1"), i)
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in self.number:
                    self.shorter[i] = self.number[token[:end]]
                    break
        automaton.make_automaton()
        self.automaton = automaton
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.compatible: dict[int, bool] = {}
        self._ready = True

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging by rank leaves a border between the two tokens."""
        key = first * len(self.tokens) + second
        answer = self.compatible.get(key)
        if answer is None:
            if len(self.compatible) > 4 * REMEMBER:
                self.compatible.clear()
            answer = self.compatible[key] = self._border_stays(first, second)
        return answer

    def _border_stays(self, first: int, second: int) -> bool:
        """Undo merges from the latest back; a merge across the border that comes before the next undone one breaks it."""
        until = len(self.tokens)
        while True:
            across = self.merged.get((first, second))
            if across is not None and across < until:
                return False
            can_first, can_second = self.lengths[first] > 1, self.lengths[second] > 1
            if can_first and (first > second or not can_second):
                # a tie in time goes to the left neighbour: the merge that made `first` came first
                until, first = first, self.right[first]
            elif can_second:
                until, second = second + 1, self.left[second]
            else:
                return True

    def _piece(self, data: bytes) -> list[int]:
        whole = self.number.get(data)
        if whole is not None:
            return [whole]
        longest = [NONE] * len(data)
        lengths = self.lengths
        for end, token in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - lengths[token]
            best = longest[start]
            if best == NONE or lengths[token] > lengths[best]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(len(data) + 1)
        at, token = 0, longest[0]
        while at < len(data):
            last = out[-1] if out else NONE
            while token != NONE:
                end = at + lengths[token]
                if not dead[end] and (last == NONE or self.may_follow(last, token)):
                    break
                token = self.shorter[token]
            if token != NONE:
                out.append(token)
                at += lengths[token]
                if at < len(data):
                    token = longest[at]
            else:
                if not out:
                    raise ValueError("a byte has no token")
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one. Strings of special tokens are ordinary text."""
        if not text:
            return []
        if not self._ready:
            self._prepare()
        out: list[int] = []
        known = self.known
        for piece in self.cut.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece.encode())
                if len(piece) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


class Decoder:
    """All tokens' bytes in one array and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, gathered at once."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        return self.data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)].tobytes()


def encoder_of(name: str = TOKENIZER, folder: str = TOKENIZERS) -> Encoder:
    key = os.path.join(folder, f"{name}.tiktoken")
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_vocabulary(key))
    return _ENCODERS[key]


_ENCODERS: dict[str, Encoder] = {}


def _lists(rows: Iterable[list[int]]) -> pa.Array:
    offsets, values = [0], []
    for ids in rows:
        values.extend(ids)
        offsets.append(len(values))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """`df` with a column of token ids. Null and empty texts give an empty list, blank ones are encoded; every row stays.

    A column named like `ids` is replaced. Very long texts take linear time.
    """
    shared = df.sparkSession.sparkContext.broadcast(encoder_of(name, folder))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = shared.value
        return _lists(encoder.encode(t) for t in texts.to_pylist())

    return busy(df).withColumn(ids, encode(F.col(text)))


def decoded(df: DataFrame, ids: Column, name: str = TOKENIZER, folder: str = TOKENIZERS) -> Column:
    """The text of a list of ids; null for null. Ids outside the vocabulary are an error."""
    shared = df.sparkSession.sparkContext.broadcast(encoder_of(name, folder).tokens)
    made: list[Decoder] = []

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        if not made:
            made.append(Decoder(shared.value))
        return pa.array([None if x is None else made[0].decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return decode(ids)
