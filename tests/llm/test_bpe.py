"""Chunked encoding and decoding against the tokenizer itself."""

import hashlib
import random

import public_tokenizers
import pytest

from tessera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a ", "a" * 6000, "a\x01b \x01 c", "<|endoftext|>x foo<|startoftext|>", "<|ENDOFTEXT|> A", "é ́a b  c\x1cd it's  I'M we'LL 12 3.5", "日本語 " * 900, "İx ΑΣ ß ẞ", " x y　z", "🙂🙃 " * 700,
    "\n".join("word " * 50 for _ in range(40)),
]


def texts():
    rng = random.Random(2)
    shared = [" ".join("".join(rng.choices("abcdeéü'-ñ", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(6)]
    return ODD + [rng.choice([" ", "\t", ""]).join(rng.choices(shared, k=3)) + str(i) for i in range(40)]


@pytest.mark.parametrize(("bits", "least"), [(10, 256), (4, 1)])
def test_equals_tokenizer(bits, least):
    mine = bpe.ChunkedBpe(PATH, bits, least)
    for text in texts():
        want = mine.tokenizer.encode(text, add_special_tokens=False).ids
        assert mine.encode(text.encode()).tolist() == want, text[:80]
        assert mine.decode(want).decode() == mine.tokenizer.decode(want, skip_special_tokens=False)


def test_full_memos(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    mine = bpe.ChunkedBpe(PATH)
    for text in texts():
        assert mine.encode(text.encode()).tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_meet():
    """Texts that share a passage share its chunks, wherever it stands."""
    rng = random.Random(7)
    passage = " ".join(str(rng.random()) for _ in range(3000)).encode()
    a, b = bpe.chunks(b"one " + passage), bpe.chunks(b"quite another beginning " + passage)
    assert b"".join(a) == b"one " + passage and len(set(a) & set(b)) >= len(a) - 3
    for text in texts():
        assert all(c.decode() for c in bpe.chunks(text.encode()))


def test_frames(spark):
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, None, "n"), (3, "x y", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    own = bpe.ChunkedBpe(PATH)
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id != 3}
    for i, t, _ in rows:
        if i != 3:
            ids = own.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert by_id[i]["ids"] == ids and by_id[i].decoded == own.tokenizer.decode(ids, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.digests(docs, PATH).collect() if r.doc_id != 3}
    for i, r in by_id.items():
        assert digest[i].n_tokens == len(r["ids"])
        assert digest[i].ids_sha256 == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).collect() == []
