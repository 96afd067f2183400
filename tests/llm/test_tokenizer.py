import os
import random

import pyarrow as pa
import pytest

from lodestone.llm import textcodes as tc
from lodestone.llm.queries import TOKENIZER
from lodestone.llm.tokenizer import BacktrackingBpe, PieceTable, decode, encode, encode_batch

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary")


@pytest.fixture(scope="module")
def bpe():
    return BacktrackingBpe(TOKENIZER)


@pytest.fixture(scope="module")
def exact(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=bpe.rank, special_tokens={})


@pytest.mark.parametrize("letters", ["ab", "abcdefgh e", "éaß漢字🙂 \n\x1c\x85　", "the in 's're'll 've'tis ''s \n\n", " \n\t  a1'.", "aaaab "])
def test_same_ids_as_merging_by_rank(bpe, exact, letters):
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(800)]
    got = encode_batch(pa.array(texts), PieceTable(bpe)).to_pylist()
    assert got == [exact.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x).decode() for x in got] == texts


@pytest.mark.parametrize("block", [16, 33])
def test_long_pieces_in_blocks(bpe, exact, monkeypatch, block):
    monkeypatch.setattr("lodestone.llm.tokenizer.BLOCK", block)
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(700)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éaß漢字", "the", "=-") for _ in range(20)]
    assert encode_batch(pa.array(texts), PieceTable(bpe)).to_pylist() == [exact.encode_ordinary(t) for t in texts]


def test_pieces_without_blank_are_linear(bpe, exact):
    for text in ("a" * 5_000, "ab" * 3_000, "漢" * 2_000, "=-" * 4_000):
        assert encode_batch(pa.array([text]), PieceTable(bpe)).to_pylist()[0] == exact.encode_ordinary(text)


def test_a_full_table_of_pieces_changes_nothing(bpe, monkeypatch):
    monkeypatch.setattr("lodestone.llm.tokenizer.KEPT_PIECES", 2)
    assert encode_batch(pa.array(["one two three"] * 3), PieceTable(bpe)).to_pylist() == encode_batch(pa.array(["one two three"] * 3), PieceTable(bpe)).to_pylist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_pieces_whose_polynomial_hashes_meet(bpe, exact, monkeypatch):
    """Hashes modulo 2^64 of these two differ in nothing; pieces are told apart even so."""
    one = thue_morse(1_024)
    texts = [one, one.translate(str.maketrans("ab", "ba")), one]
    assert encode_batch(pa.array(texts), PieceTable(bpe)).to_pylist() == [exact.encode_ordinary(t) for t in texts]
    texts = ["some words here", "and others 12", "some words here"] + texts
    monkeypatch.setattr("lodestone.llm.textcodes.span_hash", lambda prefix, start, end: (end - start).astype("uint64") * 0)
    assert encode_batch(pa.array(texts), PieceTable(bpe)).to_pylist() == [exact.encode_ordinary(t) for t in texts]


def test_span_hashes_tell_built_texts_apart():
    one = thue_morse(4_096)
    codes, begins = tc.codes_of(pa.array([one, one.translate(str.maketrans("ab", "ba")), one]))
    h = tc.span_hash(tc.prefix_hash(codes), begins[:-1], begins[1:])
    assert h[0] == h[2] != h[1]


def test_frames(spark, bpe):
    rows = [(1, "plain text", "x"), (2, None, "x"), (3, "", None), (4, " \n", "x"), (4, " \n", "x"), (None, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode(df, TOKENIZER)
    assert got.columns == ["doc_id", "ids"]
    by = [(r.doc_id, list(r.ids)) for r in got.collect()]
    assert len(by) == 6 and (2, []) in by and (3, []) in by
    assert all(i < 50256 for _, ids in by for i in ids)
    back = {r.doc_id: r.text for r in decode(got, TOKENIZER).collect()}
    assert back == {1: "plain text", 2: "", 3: "", 4: " \n", None: "<|endoftext|>"}
    assert encode(df.limit(0), TOKENIZER).count() == 0
