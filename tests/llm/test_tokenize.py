"""Token ids against whole-text encoding."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import tokenize
from factweave.llm.tokenize import cuts, decode, encode_text, encoder, token_ids, vocabulary_path

PATH = vocabulary_path()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a  1 \n\t'.,s好ñ🙂\x1c\x85\u200b", min_size=1, max_size=300), st.integers(8, 40), st.integers(2, 4))
def test_pieces_give_the_ids_of_the_text(text, size, overlap):
    ids, n = encode_text(text, PATH, size, overlap)
    assert ids == encoder(PATH).encode_ordinary(text) and n == len(cuts(text, size, overlap)) + 1


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=400))
def test_any_signs(text):
    assert encode_text(text, PATH, 16, 8)[0] == encoder(PATH).encode_ordinary(text)


def test_many_pieces(monkeypatch):
    monkeypatch.setattr(tokenize, "MANY_PIECES", 5)
    text = "It's 12 o'clock, 世界 " * 60
    ids, n = encode_text(text, PATH, 32, 12)
    assert list(ids) == encoder(PATH).encode_ordinary(text) and n > 20


def test_overlap_without_a_boundary():
    assert cuts("a" * 500, 40, 10) == [] and len(cuts("a" * 95 + " " + "b" * 200, 40, 20)) == 1


def test_operator(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["word ", "zwölf", " 好的", "\n\n", "  ", "'s ", "12.5"]) for _ in range(2000))
    texts = [None, "", "  ", "<|endoftext|> x", "a" * 900, "好" * 700, " " * 500, long, long, "it's\r\n\x00"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    done = token_ids(rows, chunk_chars=200, overlap_chars=20).collect()
    got = {r.doc_id: r.ids for r in done}
    pieces = {r.doc_id: r.pieces for r in done}
    assert pieces[0] == pieces[1] == 0 and pieces[2] == pieces[4] == 1 and pieces[7] > 20
    for i, t in enumerate(texts):
        assert got[i] == (encoder(PATH).encode_ordinary(t) if t else [])
        assert decode(got[i], PATH) == (t or "")
    assert token_ids(rows.limit(0)).count() == 0
