"""Ids by parts against ids of whole texts, on any text."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import tokens

ALPHABET = "abcXYZ éÉßſﬁµİıΣσςñ日本.,;:!?'’\"()-_<|>#$0123 \n\t\r\x0b\x0c\x1c\x85\xa0 ‍́\0"
NAMES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


@pytest.mark.parametrize(("name", "drops"), NAMES)
def test_any_text(name, drops):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    encode = tokens.encoder(path, drops)

    @settings(max_examples=1500, deadline=None)
    @given(st.text(st.sampled_from(ALPHABET) | st.characters(exclude_categories=["Cs"]), max_size=40))
    @example("<|endoftext|> a<|startoftext|>")
    @example("a.\nB c\n")
    @example(" \n")
    @example("a\n\xa0")
    @example("a\n\xa0\xa0b")
    @example("\n\xa0")
    def same(text):
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids

    same()


SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


@pytest.mark.parametrize(("name", "drops"), NAMES)
def test_runs_of_white_space(name, drops):
    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), tokens.encoder(path, drops)
    texts = [head + a + b + tail for a in SPACES for b in ["", *SPACES] for head in ("", "a", "a.") for tail in ("", "b", "\xa0b", " b", "\n")]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 10)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, coder = Tokenizer.from_file(path), tokens.PartEncoder(path, False)
    for i in range(30):
        text = f"word{i} and\nmore{i % 3}, of it"
        assert np.frombuffer(coder.batch([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(coder.known) < 25
