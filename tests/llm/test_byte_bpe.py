import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import byte_bpe

from .conftest import EDGES

RNG = random.Random(5)
ODD = [
    "", " ", "it's I'll 'x we'VE   x\t\ty \x1c \x85z", " \n \n" * 500, "a" * 300, "ab" * 5000, "日本語" * 2000, "x" * 299 + " " + "=" * 1000,
    "".join(RNG.choice("abc") for _ in range(3000)), "".join(RNG.choice("ACGT") for _ in range(20000)),
    base64.b64encode(RNG.randbytes(20000)).decode(), "<|endoftext|> x", "½ ² ٣ Ⅷ ǅ ﬁ é 🎉👩‍👩‍👧\x00\x07", "a 　  b c",
]


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(byte_bpe.VOCABULARY, "rb") as file:
        return byte_bpe.Encoder(file.read())


def same(encoder, library, texts):
    ids, size = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, size.tolist(), strict=True):
        found = ids[at : at + n]
        assert found.tolist() == library.encode_ordinary(text)
        assert encoder.decode(found) == text.encode()
        at += n
    assert at == len(ids)


def test_odd_texts(encoder, library):
    same(encoder, library, ODD)
    same(encoder, library, [])


def test_every_code_point(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(encoder, library, ["".join(f"a{c}1{c} {c}{c}" for c in points[k : k + 8192]) for k in range(0, len(points), 8192)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24FF), max_size=60), max_size=5))
def test_any_texts(encoder, library, texts):
    same(encoder, library, texts)


def test_bounds_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    monkeypatch.setattr(byte_bpe, "PIECE_LENGTH", 4)
    monkeypatch.setattr(byte_bpe, "SECTION", 7)
    monkeypatch.setattr(byte_bpe, "CELLS", 512)
    monkeypatch.setattr(byte_bpe, "LONG", 12)
    monkeypatch.setattr(byte_bpe, "DECODED", 5)
    for _ in range(2):
        same(encoder, library, ODD)


def test_rows(edges, nothing, library):
    found = byte_bpe.encode_decode(edges).collect()
    assert len(found) == len(EDGES)
    by_text = {}
    for key, text in EDGES:
        by_text.setdefault(key, set()).add(text or "")
    for row in found:
        assert row["n_tokens"] == len(row["ids"])
        assert any(row["ids"] == library.encode_ordinary(t) and row["decoded"] == t.encode() for t in by_text[row["doc_id"]])
    assert byte_bpe.encode_decode(nothing).collect() == []
