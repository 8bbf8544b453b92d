"""Byte-level BPE encoding and decoding on padded matrices of pieces.

A text is cut into pieces by the tokenizer's pattern and every piece is encoded by itself. The pieces that a block
of texts holds and the task does not know yet are encoded together: those of similar length are rows of one padded
matrix of token ids. In a round every row merges its leftmost pair of minimum rank; the row gets one column
shorter, and rows without a pair left leave the matrix. Ranks of pairs come from an open-addressing hash table held
in arrays. Decoding puts the bytes of the ids together again.

A piece of more than LONG bytes is a matrix of one row. There a round merges all pairs of the minimum rank that do
not overlap, from the left, if no pair that arises on the way has a lower rank (then the order is that of single
merges); otherwise it merges the leftmost one only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import ranges, row_blocks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Bytes of text whose pieces are looked up together, and characters of a text that are cut into pieces at a time.
TEXT_BLOCK = 2 << 20
SECTION = 1 << 20
# Pieces and ids that a task remembers between blocks, and the longest piece that it remembers, in characters.
PIECES, IDS, PIECE_LENGTH = 500_000, 4 << 20, 64
# Cells of a matrix, and the longest piece that shares one.
CELLS = 1 << 17
LONG = 256
# Ids that are decoded at a time.
DECODED = 1 << 18
PAD = -1
NONE = np.iinfo(np.int32).max

# The White_Space characters of Unicode, which `\s` of the tokenizer's pattern means.
SPACE = r"\t-\r \x85\xa0  -     　"
# The letters and numbers up to U+024F. There is no other kind of letter or number below.
LETTER, NUMBER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾"


def _pattern(letter: str, number: str) -> str:
    """The tokenizer's pattern with its classes written out. A contraction begins with ', which starts no run of
    letters, so the most frequent case can come first."""
    return (
        rf" ?[{letter}]+|'(?:[smtd]|re|ve|ll)| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


_LATIN = re.compile(_pattern(LETTER, NUMBER))
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
# A blank between two other characters always begins a piece.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def sections(text: str) -> Iterator[str]:
    """The text in runs of about SECTION characters that end where a piece ends."""
    at = 0
    while len(text) - at > SECTION and (seam := _SEAM.search(text, at + SECTION)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


def pieces_of(text: str) -> list[str]:
    return (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


class PairTable:
    """Rank of the token that two neighbouring tokens make, by an open-addressing table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()).bit_length()
        pairs = [
            (ranks[token[:cut]] << self.width | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.bits = max(4, (8 * len(pairs)).bit_length())
        keys = np.array([p[0] for p in pairs], dtype=np.int64)
        values = np.array([p[1] for p in pairs], dtype=np.int32)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.probes, slot = 0, self._slot(keys)
        while len(keys):
            self.probes += 1
            # Of the pairs that want one free slot the first gets it; the others try the next slot.
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], values[taken]
            left = np.ones(len(keys), dtype=bool)
            left[taken] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the two make no token or one of them is padding."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel()
        out = np.full(left.shape, NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[open_] << self.width | right[open_]
        slot = self._slot(keys)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            open_, keys, slot = open_[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Encoder:
    def __init__(self, vocabulary: bytes):
        """`vocabulary`: lines of a base64 token and its rank, which is also its id."""
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t}
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in tokens])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self._forget()

    def _forget(self) -> None:
        """`known`: place of a piece's ids in `flat`, by `start` and `size`."""
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (ids[at : at + DECODED] for at in range(0, len(ids), DECODED))
        return b"".join([self.token_bytes[ranges(self.token_start[i], self.token_size[i])].tobytes() for i in parts])

    def merged_rows(self, tokens: np.ndarray) -> np.ndarray:
        """The ids of every row of a padded matrix of bytes' ids, padded again."""
        out = np.full(tokens.shape, PAD, dtype=np.int32)
        place = np.arange(len(tokens))
        ranks = np.full(tokens.shape, NONE, dtype=np.int32)
        ranks[:, :-1] = self.pairs.ranks(tokens[:, :-1], tokens[:, 1:])
        while len(tokens):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(tokens)), at]
            on = least != NONE
            if not on.all():
                out[place[~on], : tokens.shape[1]] = tokens[~on]
                tokens, ranks, place, at, least = tokens[on], ranks[on], place[on], at[on], least[on]
                if not len(tokens):
                    break
            row, last = np.arange(len(tokens)), tokens.shape[1] - 2
            tokens[row, at] = least
            stays = np.ones(tokens.shape, dtype=bool)
            stays[row, at + 1] = False
            tokens, ranks = tokens[stays].reshape(len(row), -1), ranks[stays].reshape(len(row), -1)
            after = np.where(at < last, tokens[row, np.minimum(at + 1, last)], PAD)
            inner = np.flatnonzero(at)
            before = tokens[inner, at[inner] - 1]
            found = self.pairs.ranks(np.concatenate([least, before]), np.concatenate([after, least[inner]]))
            ranks[row, at], ranks[inner, at[inner] - 1] = found[: len(row)], found[len(row) :]
        return out

    def merged_long(self, tokens: np.ndarray) -> np.ndarray:
        """The ids of one long row."""
        ranks = self.pairs.ranks(tokens, np.append(tokens[1:], PAD))
        while (least := ranks.min(initial=NONE)) != NONE:
            at = np.flatnonzero(ranks == least)
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            while True:
                follows = np.append(tokens, [PAD, PAD])[at + 2]
                adjacent = np.diff(at, prepend=-9) == 2
                before = np.where(adjacent, least, np.where(at > 0, tokens[at - 1], PAD))
                met = min(self.pairs.ranks(np.full_like(follows, least), follows).min(), self.pairs.ranks(before, np.full_like(before, least)).min())
                if met > least or len(at) == 1:
                    break
                at = at[:1]
            tokens[at] = least
            stays = np.ones(len(tokens), dtype=bool)
            stays[at + 1] = False
            tokens, ranks = tokens[stays], ranks[stays]
            at = at - np.arange(len(at))
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            ranks[touched] = self.pairs.ranks(tokens[touched], np.append(tokens, PAD)[touched + 1])
        return tokens

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has. A piece that is a token is that token."""
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(PAD)), dtype=np.int32, count=len(pieces))
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        # Lengths up to 8 have a matrix each, longer ones share one with the next 8 lengths.
        width = np.where(length <= 8, length, (length + 7) // 8 * 8)
        width[whole != PAD], width[(whole == PAD) & (length > LONG)] = 0, -1
        places, found = [np.flatnonzero(width == 0)], [(whole[width == 0], np.ones(np.count_nonzero(width == 0), dtype=np.int64))]
        for wide in np.unique(width[width > 0]).tolist():
            of_width = np.flatnonzero(width == wide)
            for at in range(0, len(of_width), CELLS // wide):
                some = of_width[at : at + CELLS // wide]
                codes = np.frombuffer(b"".join([pieces[i].ljust(wide, b"\0") for i in some.tolist()]), dtype=np.uint8)
                tokens = self.single[codes].reshape(len(some), wide)
                tokens[np.arange(wide) >= length[some][:, None]] = PAD
                rows = self.merged_rows(tokens)
                places.append(some)
                found.append((rows[rows != PAD], np.count_nonzero(rows != PAD, axis=1)))
        for i in np.flatnonzero(width == -1).tolist():
            ids = self.merged_long(self.single[np.frombuffer(pieces[i], dtype=np.uint8)])
            places.append(np.array([i]))
            found.append((ids, np.array([len(ids)])))
        flat, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(np.concatenate(places), kind="stable")
        start = np.cumsum(size) - size
        return flat[ranges(start[order], size[order])], size[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        cut = [[pieces_of(s) for s in sections(t)] for t in texts]
        column = pa.array(chain.from_iterable(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        pieces = column.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        unknown = np.flatnonzero(place < 0)
        new = [pieces[i] for i in unknown.tolist()]
        flat, size = self.encode_pieces([p.encode() for p in new])
        place[unknown] = len(self.start) + np.arange(len(new))
        self.known.update((p, i) for p, i in zip(new, place[unknown].tolist(), strict=True) if len(p) <= PIECE_LENGTH)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        each = place[column.indices.to_numpy()]
        ids = self.flat[ranges(self.start[each], self.size[each])]
        ends = np.cumsum([sum(map(len, text)) for text in cut], dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(self.size[each])))[ends]
        if len(self.known) > PIECES or len(self.flat) > IDS:
            self._forget()
        return ids, np.diff(upto, prepend=0)


def _column(data: bytes, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: the key, n_tokens, ids (array of int), decoded (binary).

    Null and empty texts have no ids and decode to nothing. Special tokens written in a text are ordinary text.
    Repeated rows are encoded each; an empty table gives no rows. Texts of any length are cut into sections where a
    piece ends; a single piece (a run without blanks) is held as a whole. Other columns are not read. The vocabulary,
    a file of fixed size, is broadcast.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(shared.value)
        encoder = _encoders[vocabulary]
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            ids, size = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            upto = np.concatenate(([0], np.cumsum(size)))
            width = np.diff(np.concatenate(([0], np.cumsum(encoder.token_size[ids])))[upto])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.ListArray.from_arrays(upto.astype(np.int32), ids), _column(encoder.decode(ids), width)],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, decoded binary").withColumnRenamed("id", key)
