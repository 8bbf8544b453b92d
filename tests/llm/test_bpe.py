import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import bpe

from .conftest import EDGES

ODD = [
    "aaaaaaaa aaaa", "İstanbul ΣΑΣ Σ", "<|endoftext|> x<|startoftext|>y <|endof", "it's we'll %%%'s 123 4a5", "\x1c\x1d a\x85b\xa0c​d　e",
    "é é Å ﬁ", "日本語テキスト 🎉🎉👩‍👩‍👧", "a\x00b\x07c", "'S 'T I'M don'T", "﻿abc", "ǅ ẞ ŉ", "½ ² ٣", "",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def same(encoder, library, text):
    ids, decoded = encoder.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, library, text):
    same(encoder, library, text)


def test_random_words(encoder, library):
    rng = random.Random(1)
    for _ in range(3000):
        same(encoder, library, "".join(rng.choice("abcdehilnorst'sé ") for _ in range(rng.randint(1, 30))))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24FF), max_size=40))
def test_any_text(encoder, library, text):
    same(encoder, library, text)


def test_letters_newer_than_the_library(encoder, library):
    for letter in "\u1c89\ua7dc\U00016ea0\u088f\u0558\u058b\u0c5c\ua7ce\U00010940\U000323b0\U0003d000":
        for text in (f":{letter}", f"a{letter}b {letter}1", f"{letter}{letter}'s"):
            same(encoder, library, text)


def test_caches_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 3)
    encoder.chunks.size = encoder.pieces.size = 2
    encoder.pairs.clear()
    for _ in range(2):
        for text in ODD:
            same(encoder, library, text)


def test_rows(edges, nothing, library):
    found = bpe.encode_decode(edges).collect()
    assert len(found) == len(EDGES)
    by_text = {}
    for key, text in EDGES:
        by_text.setdefault(key, set()).add(text or "")
    for row in found:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["n_tokens"] == len(ids)
        assert any(
            ids == library.encode(t, add_special_tokens=False).ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)
            for t in by_text[row["doc_id"]]
        )
    assert bpe.encode_decode(nothing).collect() == []
