import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import ODD

from hindcast.llm.tokens import merge_table, text_counts, token_counts


@pytest.fixture(scope="module")
def library(byte_bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe)


def theirs(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_in_spark(documents, library, byte_bpe):
    got = sorted(map(tuple, token_counts(documents(ODD), byte_bpe).collect()), key=str)
    texts = [t or "" for _, t in ODD]
    counts = theirs(library, texts)
    want = [(i, len(t.encode()), n, n > 512) for (i, _), t, n in zip(ODD, texts, counts, strict=True)]
    assert got == sorted(want, key=str)


def test_no_rows(documents, byte_bpe):
    assert token_counts(documents([(1, "a")]).limit(0), byte_bpe).count() == 0


def test_every_code_point(library, byte_bpe):
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} b{c}{c}1 {c} x" for c in points]
    assert text_counts(texts, merge_table(byte_bpe), {}) == theirs(library, texts)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("aabcdeé \n'1!")), max_size=5))
def test_like_the_library(texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert text_counts(texts, merge_table(path("byte_bpe_50k.json")), {}) == theirs(library, texts)


def test_overlapping_places_merge_from_the_left(byte_bpe):
    table = merge_table(byte_bpe)
    assert table.counts([]).tolist() == []
    assert isinstance(table.counts([b"aaaaa"]), np.ndarray)
