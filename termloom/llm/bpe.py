"""Byte-pair encoding of whole texts by dynamic programming over prefixes, and decoding.

A word is a sequence of units: its bytes as printable characters, the last one marked as the word's end. For
every prefix of the word exactly one token can be the last of the prefix's encoding. An automaton over the
vocabulary names the tokens that end at each place; a token is the one looked for if it is the whole prefix,
or if it and the last token of the shorter prefix before it stay as they are when encoded together. That pair
test undoes merges along the two sides of the seam. Following the stored tokens back from the word's end
gives the ids, without any merge being carried out on the text.

The vocabulary file is read by the driver and sent to the tasks; its size is that of the file. Encoded words are
kept in caches of bounded size.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import row_blocks

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CHUNKS, PIECES, PAIRS = 150_000, 100_000, 200_000
TEXT_BLOCK = 1 << 20
END = 0xE000

# White space of the Unicode standard (fixed values); str.split() also cuts at 0x1C-0x1F.
_SPACES = "\t-\r \x85\xa0  -     　"
_SPACE_RUN = regex.compile(f"[{_SPACES}]+")
_ODD = regex.compile("[\x1c-\x1f]")
# Code points that the regex module calls letters or numbers and the tokenizers library, by an older table, does not.
_NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f"
)
# Capitals that the tokenizers library lower-cases and str.lower() does not know.
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_IS_NEWER = regex.compile(f"[{_NEWER}]")
_HAS_NEWER = regex.compile(f"[{_NEWER}{''.join(map(chr, _CAPITALS))}]")


def _byte_units() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else 256 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_UNITS = {b: unit for b, unit in enumerate(_byte_units()) if chr(b) != unit}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Cache:
    """Two generations: when the young one is full the old one goes, so frequent keys stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Encodes as the vocabulary file says: normaliser, pre-tokeniser pattern, merges, special tokens."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model, kinds = parsed["model"], [n["type"] for n in parsed["normalizer"]["normalizers"]]
        split, level = parsed["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != "</w>" or level["type"] != "ByteLevel" or not split["invert"]:
            raise ValueError("this encoder reads vocabularies of words in lower case with a word-end suffix")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACES))
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special_run = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.tokens = [""] * size
        for token, number in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[number] = token
        number = model["vocab"]
        # How a token came about: its two parts and the turn of that merge; units have none.
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.turn = [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for turn, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair = number[left], number[right]
            self.merge[pair] = turn
            whole = number[left + right]
            if self.parts[whole] is None:
                self.parts[whole], self.turn[whole] = pair, turn
        self.pairs: dict[int, bool] = {}
        self.chunks, self.pieces = Cache(CHUNKS), Cache(PIECES)
        self.automaton = ahocorasick.Automaton()
        for token, i in number.items():
            units = token[:-5] + chr(END + ord(token[-5])) if token.endswith("</w>") and len(token) > 4 else token
            # A token whose own parts do not stay together is never the result of an encoding.
            if self.parts[i] is None and len(units) == 1 or self.parts[i] is not None and self._kept(*self.parts[i], self.turn[i]):
                self.automaton.add_word(units, (i, len(units)))
        self.automaton.make_automaton()

    def _kept(self, left: int, right: int, end: int | None = None) -> bool:
        """Whether two neighbouring tokens have no merge across their seam, or none before turn `end`."""
        infinite = len(self.merge) + 1
        left_until = right_until = infinite if end is None else end
        while True:
            turn = self.merge.get((left, right))
            if turn is not None and turn < left_until and turn <= right_until and (end is None or turn < end):
                return False
            # Go back to before the later of the two tokens was made.
            if self.turn[left] < 0 and self.turn[right] < 0:
                return True
            if self.turn[left] > self.turn[right]:
                left_until, left = self.turn[left], self.parts[left][1]
            else:
                right_until, right = self.turn[right], self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 20 | right] = self._kept(left, right)
        return found

    def word_ids(self, units: str) -> list[int]:
        """Ids of one word given as units, the last one marked."""
        last, length = [-1] * len(units), [0] * len(units)
        known = self.pairs.get
        for end, (token, size) in self.automaton.iter(units):
            if last[end] < 0:
                if end < size:
                    kept = True
                elif (kept := known(last[end - size] << 20 | token)) is None:
                    kept = self.compatible(last[end - size], token)
                if kept:
                    last[end], length[end] = token, size
        ids, at = [], len(units) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            units = piece.encode("utf-8").decode("latin-1").translate(_UNITS)
            found = self.word_ids(units[:-1] + chr(END + ord(units[-1])))
            self.pieces.put(piece, found)
        return found

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or not _HAS_NEWER.search(chunk):
            return self.pattern.findall(chunk)
        # Newer letters and numbers are cut as marks, for which 0x00 stands.
        chunk = chunk.translate(_CAPITALS)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(_IS_NEWER.sub("\0", chunk))]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        if chunk.isascii() and chunk.isalpha():
            ids = self._piece(chunk)
        else:
            ids = [i for piece in self._pieces(chunk) for i in self._piece(piece)]
        found = packed(ids), self.decode(ids)
        self.chunks.put(chunk, found)
        return found

    def decode(self, ids) -> str:
        """Tokens joined by a space: the vocabulary names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and what they decode to."""
        parts: list[tuple[bytes, str]] = []
        sections = self.special_run.split(text) if self.special_run and "<|" in text else [text]
        for section in sections:
            if section in self.special:
                ids = [self.special[section]]
                parts.append((packed(ids), self.decode(ids)))
                continue
            if not section.isascii():
                section = unicodedata.normalize("NFC", section).replace("Σ", "σ")
            section = section.lower()
            chunks = _SPACE_RUN.split(section) if _ODD.search(section) else section.split()
            young, get, new = self.chunks.young, self.chunks.get, self._chunk
            for chunk in chunks:
                if (found := young.get(chunk)) is None:
                    found = get(chunk) or new(chunk)
                    young = self.chunks.young
                parts.append(found)
        # A chunk of marks that match nothing has no token and must not leave a gap in the joined text.
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])


_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: the key, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    Null and empty texts, and texts of white space only, have no ids and decode to an empty string. Special
    tokens written in a text are read as such; none are added. Repeated rows are encoded each; an empty table
    gives no rows. Other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(shared.value)
        encoder = _encoders[vocabulary]
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            pairs = [encoder.encode(t) if t else (b"", "") for t in batch.column(1).to_pylist()]
            ids = [p[0] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([p[1] for p in pairs], pa.string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", key)
