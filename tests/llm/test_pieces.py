import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import ODD, prose

from hindcast.llm.pieces import Encoder, decode_pieces, encode_pieces, piece_model


def test_without_dropout_like_the_library(piece_bpe):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_bpe)
    texts = [" a", "  a  b ", "", "\n\n a\n", "<s></s><0x0A>", "don't, (stop).», x", prose(1, 200), "Ünïcödé 😀 text; 12.5%"]
    encoder = Encoder(piece_model(piece_bpe))
    assert [encoder.encode(t) for t in texts] == library.encode(texts)


@settings(deadline=None, max_examples=100)
@given(st.text(), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 5))
def test_any_text_comes_back(text, dropout, seed):
    from public_tokenizers import path

    text = text.encode("utf-8", "ignore").decode()
    model = piece_model(path("piece_bpe_32k.model"))
    assert model.decode(Encoder(model, dropout, seed, 3).encode(text, "7")) == text


def test_dropout_varies_with_the_seed_only(piece_bpe):
    model, text = piece_model(piece_bpe), "international understanding of tokenization " * 5
    plain = Encoder(model).encode(text)
    one, again, other = (Encoder(model, 0.3, s).encode(text) for s in (1, 1, 2))
    assert one == again != other
    assert len(one) > len(plain)
    assert len(Encoder(model, 1.0).encode(text)) == len(text) + 1


def test_a_word_splits_differently_from_place_to_place(documents, piece_bpe):
    """In one text and over texts; each possible split as often as with a draw for each candidate."""
    model, places = piece_model(piece_bpe), 20_000
    ids = Encoder(model, 0.1, 1).encode("understanding\n" * places, "7")
    splits = Counter(" ".join(model.bytes_of[i].decode() for i in ids).split("\n"))
    rng, drawn = random.Random(3), Counter()
    for _ in range(places):
        drops, (n, _) = (), model.encode_unit("understanding")
        at = 0
        while at < n:
            if rng.random() < 0.1:
                drops = (*drops, at)
                n = model.encode_unit("understanding", drops=drops)[0]
            at += 1
        drawn[" ".join(model.bytes_of[i].decode() for i in model.encode_unit("understanding", drops=drops)[1])] += 1
    common = {k.strip(): v for k, v in drawn.most_common(8)}
    found = Counter()
    for k, v in splits.items():
        found[k.strip()] += v
    assert len(splits) > 20
    assert all(abs(found[k] - v) < 5 * (2 * v) ** 0.5 for k, v in common.items())
    rows = encode_pieces(documents([(i, "understanding tokenization") for i in range(60)]), piece_bpe, 0.1, 1).collect()
    assert len({tuple(r.ids) for r in rows}) > 5 and all(r.lossless for r in rows)


def test_rate_out_of_range(piece_bpe):
    with pytest.raises(ValueError):
        Encoder(piece_model(piece_bpe), 1.5)


def test_round_trip_in_spark(documents, piece_bpe):
    docs = documents(ODD)
    encoded = encode_pieces(docs, piece_bpe, 0.2, 3, 2)
    rows = encoded.collect()
    assert len(rows) == len(ODD)
    assert all(r.lossless or r.ids is None for r in rows)
    assert [r.n_pieces for r in rows if r.ids is None] == [0]
    back = sorted(map(tuple, decode_pieces(encoded, piece_bpe).collect()), key=str)
    assert back == sorted(ODD, key=str)
    assert sorted(map(str, encode_pieces(docs.repartition(5), piece_bpe, 0.2, 3, 2).collect())) == sorted(map(str, rows))
    assert encode_pieces(docs.limit(0), piece_bpe).count() == 0


def test_short_units_merge_as_by_agenda(piece_bpe):
    """The same candidates, drops and ids; remembered splits are flat."""
    model = piece_model(piece_bpe)
    for unit in ("understanding", "▁aaaaaaa", "▁", "x", "▁日本語é", "▁bookkeeper's"):
        for gaps in ((0,), (1, 0, 0), (2, 1), (0, 0, 0, 0, 0, 0), (99,)):
            runs = []
            for encode in (model.encode_short, model.encode_unit):
                drops, left = [gaps[0]], iter((*gaps[1:], 99))
                runs.append((encode(unit, drops=drops, gap_after=left.__next__), drops))
            assert runs[0] == runs[1]
    encoder = Encoder(model, 0.3, 5)
    encoder.encode("understanding tokenization " * 40, "a")
    assert any(isinstance(k, tuple) for k in encoder.splits)
    assert all(type(n) is int and type(ids) is tuple for n, ids in encoder.splits.values())
