"""Exact byte-level BPE encoding in linear time, by backtracking over longest Aho-Corasick matches.

A token sequence is the BPE encoding of its bytes exactly if every neighbouring pair of tokens is compatible, that is,
if encoding the two tokens' bytes together gives these two tokens again. The encoder takes the longest token at each
place, checks it against the token before, falls back to shorter tokens, and steps back where none fits. A place that
was found a dead end is never entered again, hence linear time. Compatibility follows from a table of how each token
splits into its two halves and a table of which pairs merge.

Nulls and empty texts: an empty list of ids (0 tokens). Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.session import bounded_file, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pre-tokenisation pattern published with this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file may not be larger than this, as it is sent to every executor.
MOST_VOCABULARY_BYTES = 16 << 20
#: Distinct pieces a Python worker remembers before it starts anew; bounds its memory, not the result.
REMEMBERED = 150_000


class Vocabulary:
    """Tables of a byte-level BPE vocabulary given as lines of base64 token and rank, in order of merging."""

    def __init__(self, content: bytes):
        token_of = {}
        for line in content.splitlines():
            if line:
                text, rank = line.split()
                token_of[int(rank)] = base64.b64decode(text)
        self.size = max(token_of) + 1
        self.tokens = [token_of.get(i, b"") for i in range(self.size)]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self._offset_table()
        self._merge_tables()
        self._automaton()

    def _offset_table(self) -> None:
        """All tokens' bytes in one buffer, with the offset of each: what decoding reads."""
        self.buffer = b"".join(self.tokens)
        self.offsets = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.length = [len(t) for t in self.tokens]

    def _merge_tables(self) -> None:
        ids = self.ids
        self.halves = [(i, i) for i in range(self.size)]  # a single byte has no halves
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * self.size  # the longest token that is a proper prefix
        for i, token in enumerate(self.tokens):
            n = len(token)
            for k in range(n - 1, 0, -1):
                left = ids.get(token[:k])
                if left is None:
                    continue
                if self.shorter[i] < 0:
                    self.shorter[i] = left
                right = ids.get(token[k:])
                if right is not None and left < i and right < i and self.compatible(left, right):
                    self.halves[i] = (left, right)
                    self.merged[left, right] = i
                    break
            if self.shorter[i] < 0:
                for k in range(n - 1, 0, -1):
                    if token[:k] in ids:
                        self.shorter[i] = ids[token[:k]]
                        break

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border would have come before the merges inside the two tokens.

        The later of the two merges is undone step by step; a pair at the border that merges before the step just
        undone would have been taken first, so the two tokens could not both have come about.
        """
        merged, halves = self.merged, self.halves
        before = self.size + 1
        while True:
            across = merged.get((left, right))
            if across is not None and across < before:
                return False
            left_inner, right_inner = halves[left][1], halves[right][0]
            if left > right and left_inner != left:
                before, left = left, left_inner
            elif right_inner != right and (right >= left or left_inner == left):
                before, right = right + 1, right_inner
            elif left_inner != left:
                before, left = left, left_inner
            else:
                return True

    def _automaton(self) -> None:
        """Over reversed tokens: one pass over a reversed piece gives the longest token that starts at each place."""
        a = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            if token:
                a.add_word(token[::-1].decode("latin-1"), i)
        a.make_automaton()
        self.automaton = a

    def encode_bytes(self, data: bytes) -> list[int]:
        n = len(data)
        whole = self.ids.get(data)
        if whole is not None and (n == 1 or self.halves[whole][0] != whole):
            return [whole]
        longest = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            start = n - 1 - end
            if longest[start] < 0 or self.length[token] > self.length[longest[start]]:
                longest[start] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + self.length[token]] and (last < 0 or self.compatible(last, token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            elif last >= 0:  # a dead end: never come back to this place
                open_[at] = 0
                out.pop()
                at -= self.length[last]
                token = last
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def decode(self, ids) -> bytes:
        o, b = self.offsets, self.buffer
        return b"".join([b[o[i] : o[i + 1]] for i in ids])


class Encoder(dict):
    """Piece of text to its ids. Pieces recur, so each distinct one is encoded once per worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        super().__init__()
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self.vocabulary.encode_bytes(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0


_encoders: dict[int, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """One encoder per worker and vocabulary; building it takes about a second."""
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(content))
    return _encoders[key]


def texts_of(column) -> list:
    """Python strings of an Arrow column; bytes that aren't UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each row's text. Narrow: no shuffle, only the two columns are read."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(bounded_file(vocabulary, MOST_VOCABULARY_BYTES))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(sent.value).encode
        for batch in batches:
            lists = [encode(t) for t in texts_of(batch.column(1))]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            values = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) without building the ids."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(bounded_file(vocabulary, MOST_VOCABULARY_BYTES))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder_of(sent.value).count
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([count(t) for t in texts_of(batch.column(1))], pa.int64())], ["id", "n_tokens"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the inverse of encode_corpus; a null list gives null, an empty one the empty text."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(bounded_file(vocabulary, MOST_VOCABULARY_BYTES))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder_of(sent.value).vocabulary.decode
        for batch in batches:
            texts = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
