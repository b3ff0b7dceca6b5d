"""The agenda against the library, on whole texts of the test tables and on made-up ones."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pieces as P

MODEL = P.Encoder(P.public_model())


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | st.text(alphabet="ab ▁\n\u00a0é😀", max_size=40))
def test_any_text_encodes_and_decodes_as_the_library_does(text):
    n, ids, decoded = MODEL(text)
    own = [int(i) for i in ids.split()]
    assert own == [*MODEL.model.library.encode(text), MODEL.model.end] and n == len(own)
    assert decoded == MODEL.model.library.decode(own)


@pytest.mark.parametrize("text", ["", " ", "  ", "▁", "a" * 5000, " " * 3000, "\n" * 3000, "word " * 20_000, "\ufffd", "\x00", "long text without an end " * 30_000, "x" * 300_000])
def test_odd_texts(text):
    MODEL.check(text, *MODEL(text)[1:])


def test_full_memos_give_the_same_and_stay_small(monkeypatch):
    monkeypatch.setattr(P, "MEMO_BYTES", 3000)
    encoder = P.Encoder(P.public_model())
    for n in range(60):
        text = f"some word{n % 7} and others{n} " + "x" * (n * 20) + " 漢字"
        encoder.check(text, *encoder(text)[1:])
        memo = encoder.coded
        assert sum(250 + len(k) + len(v) for m in (memo, memo.old) for k, v in m.items()) <= 6000 and max(map(len, memo), default=0) <= P.MEMO_CHARS


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abcdehilmnorstuy ▁", max_size=24))
def test_short_units_merge_as_long_ones_do(text):
    model = MODEL.model
    want = model.library.encode(text)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "SHORT", 0)
        assert model.encode(text) == want
    assert model.encode(text) == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([3, 13, 200, 258, 130, 140, 190, 227, 500, 29871, 29892, 31000]), max_size=20))
def test_any_ids_decode_as_the_library_does(ids):
    assert MODEL.decode([*map(str, ids), "2"]) == MODEL.model.library.decode([*ids, 2])


def test_decoding_starts_from_ids():
    """The decoder is given other ids than the encoder found."""
    encoder = P.Encoder(P.public_model())
    encoder.coded["▁word"] = "".join(f"{i} " for i in encoder.model.encode_unit("▁other"))
    assert encoder("a word")[2] == "a other"


def test_query_digests(spark, tmp_path):
    rows = [(1, "Some words, and more."), (2, None), (3, ""), (1, "Some words, and more."), (None, "x")]
    got = P.digests(P.encode_pieces(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens long"))).collect()
    want = []
    for i, t in rows:
        ids = [*MODEL.model.library.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.model.library.decode(ids).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert P.encode_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []
