"""BPE and token counts against the libraries, and defined edge cases."""

import hashlib
import random
from functools import cache

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import bpe, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "   a", "a\n\n b", "<|endoftext|>", "x<|endoftext|> y<s></s>", "don't I'LL", "▁▁ ▁x", " \x85\x1c 　", "漢字かな🎉é", "é" * 300, "ab" * 3000, " " * 2000, "1234567890" * 5, "\x00"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(BYTES)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(BYTES)


@pytest.fixture(scope="module")
def model():
    return token_counts.PieceModel.load(PIECES)


def lexicon(codec, words):
    return bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({w: codec.merge(w) for w in words}), np.uint8))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does(text):
    lib, codec = _lib(), _codec()
    ids = next(bpe.Encoder(codec, lexicon(codec, [b" the", b"and"])).encode([text])).tolist()
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e\n▁é漢<>s/0x"), max_size=60))
def test_any_text_counts_as_the_library_does(text):
    assert _model().count(text) == len(_pieces().encode(text))


@cache
def _lib():
    return tokenizers.Tokenizer.from_file(BYTES)


@cache
def _codec():
    return bpe.Codec(BYTES)


@cache
def _model():
    return token_counts.PieceModel.load(PIECES)


@cache
def _pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_long_words_merge_alike(codec, model, pieces, library):
    rnd = random.Random(3)
    for n in (60, 129, 500, 4000):
        word = "".join(rnd.choice("abcdethnor") for _ in range(n))
        assert codec.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
        assert model.count(word) == len(pieces.encode(word))


def test_merging_in_step_is_merging_one_by_one(codec):
    rnd = random.Random(4)
    words = [bytes(rnd.choice(b" abcdehnorst") for _ in range(rnd.randint(0, 60))) for _ in range(2000)] + ["é漢".encode(), b"", b"a"]
    want = [codec.merge(w) for w in words]
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.merge_all(words)] == want
    assert codec.merge_all([]) == []


def test_decode_of_broken_bytes(codec, library):
    for ids in ([255, 128, 300], [codec.first[0xE6], codec.first[0x97]], [50256, 0], []):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(codec):
    words = [b"", b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "é".encode(), b"a" * 60]
    found = lexicon(codec, words)
    assert [None if x is None else np.frombuffer(x, "<i4").tolist() for x in found.find([*words, b"ta", b"tapss", b"zz"])] == [None, *(codec.merge(w) for w in words[1:]), None, None, None]
    small = lexicon(codec, [b"tap", b"taps", b"top", b"tops"])
    assert len(small.finals) == 5  # t, a|o, p, s and the end: suffixes are shared
    assert bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({}), np.uint8)).find([b"x"]) == [None]


def test_slices_cut_at_words():
    text = "ab  cd " * 50 + "x" * 40
    parts = list(token_counts.slices(text, " ", 20))
    assert "".join(parts) == text and len(parts) > 5
    assert all(p[0] == " " for p in parts[1:]) and not any(p.endswith(" ") for p in parts[:-1])


def test_slices_keep_white_space_together(codec, library):
    rnd = random.Random(7)
    for size in (1, 2, 5, 17):
        for _ in range(300):
            text = "".join(rnd.choice(["a", "b's", " ", " ", "\n", "\t", "\x85", "\xa0", "\u3000", "\x1c", "é", "1", "!"]) for _ in range(40))
            parts = list(bpe.slices(text, size))
            assert "".join(parts) == text and [t for p in parts for t in bpe.pretokens(p)] == bpe.pretokens(text)
    assert len(list(bpe.slices("ab cd " * 50, 20))) > 5
    line = "\n    return x"
    for shift in range(len(line)):  # the slice's end falls on each character of an indented line
        text = "x" * shift + line * ((1 << 20) // len(line) + 20)
        ids = next(bpe.Encoder(codec, lexicon(codec, [])).encode([text])).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proven(model):
    assert "▁the" in model.whole and all(len(model.merge(p)) == 1 for p in list(model.whole)[:500])
    with pytest.raises(ValueError, match="boundary"):
        token_counts.PieceModel({"a▁b": 0}).prove()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "y", 2), (0, texts[0], "x", 1)], "doc_id long, text string, ids string, n_tokens int")


def test_digests(spark, library):
    df = frame(spark, ODD)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(df, BYTES, size=20).collect()}
    want = set()
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe.digests(df, BYTES, size=20).count() == len(ODD) + 2


def test_encode_decode_round_trip(spark):
    df = frame(spark, ODD)
    coded = bpe.encode(df, BYTES, size=0)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(coded, BYTES).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in df.collect()}
    empty = df.filter("doc_id = 99")
    assert bpe.encode(empty, BYTES).count() == 0 and bpe.digests(empty, BYTES).count() == 0


def test_counts(spark, pieces):
    df = frame(spark, ODD)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, PIECES, limit=50).collect())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(pieces.encode(r["text"] or "")), n > 50) for r in df.collect())
    assert got == want
    assert token_counts.token_counts(df.filter("doc_id = 99"), PIECES).count() == 0
