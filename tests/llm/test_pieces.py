"""Operator 13 against the sentencepiece library itself."""

import hashlib
import random

import pytest

pieces = pytest.importorskip("tessera.llm.pieces")
import public_tokenizers

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def made():
    return pieces.Pieces(PATH)


def odd_texts():
    rng = random.Random(5)
    alphabet = " ▁  abcdefgtheinon\n\t\r;(){}éüß日本🙂͸\x00\x7f"
    fixed = ["", " ", "  ", "a", "▁", "a▁b", "\n\n", "a\0b", "日本語 🙂", "x" * 3_000, " " * 300, "ab" * 500 + " ", "<s> </s> <unk> <0x41>", "\r\n;\r"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(1_500)]


def test_equal_to_the_library(made):
    texts = odd_texts()
    for text, ids in zip(texts, made.encode_batch(texts), strict=True):
        want = made.library.encode(text, add_eos=True)
        assert ids.tolist() == want, text
        assert made.decode(want).decode() == made.library.decode(want), text


def test_rows_and_heap_agree(made):
    rng = random.Random(2)
    segments = ["▁" * rng.randint(0, 3) + "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 25))) for _ in range(400)]
    assert made.rows(segments) == [made._alone(s) for s in segments]


def test_decodes_any_ids(made):
    rng = random.Random(3)
    for _ in range(1_500):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(100, 258), rng.randint(259, 31_999), 259]) for _ in range(rng.randint(0, 8))]
        assert made.decode(ids).decode() == made.library.decode(ids), ids


def test_cuts_are_safe_and_whole(made):
    texts = odd_texts()
    for text, parts in zip(texts, made.segments(texts), strict=True):
        assert "".join(parts) == made.marked(text)
    assert all(any(a + b in s for s in made.scores) for a, b in ("th", "he", "▁t"))
    assert made.segments(["the"])[0] == ["▁the"]


def test_memo_forgets_and_stays_right(made, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_SEGMENTS", 40)
    own = pieces.Pieces(PATH)
    rng = random.Random(4)
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(60)) for _ in range(4)]
        assert [i.tolist() for i in own.encode_batch(texts)] == own.library.encode(texts, add_eos=True)
        assert len(own.memo) <= 40


def test_a_difference_is_an_error(made, monkeypatch):
    own = pieces.Pieces(PATH)
    monkeypatch.setattr(own, "encode_segments", lambda segments: [made._spelt("x") for _ in segments])
    with pytest.raises(AssertionError, match="differ"):
        own.encode_batch(["hello there"])


def test_rows_of_a_table(spark, made):
    rows = [(1, "Hello wörld 🙂", "x", 9), (1, "Hello wörld 🙂", "x", 9), (2, None, None, None), (None, "", "y", 1), (3, "a  b\n" * 4_000, "z", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, pieces.digests(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = made.library.encode(text or "", add_eos=True)
        decoded = made.library.decode(ids)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = {r.doc_id: r for r in pieces.encode(docs, PATH).collect()}
    assert full[3].ids == made.library.encode(rows[4][1], add_eos=True) and full[3].decoded == rows[4][1]
    assert pieces.digests(docs.limit(0), PATH).count() == 0 and pieces.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, made):
    from tessera.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.QUERIES["op13_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = made.library.encode(d.text or "", add_eos=True)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(made.library.decode(ids).encode()).hexdigest()
