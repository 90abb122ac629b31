"""Held-out accuracy of the quality network, and its edge cases."""

import random
import zlib

import numpy as np
import xxhash

from tessera.llm import quality


def corpus(n):
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("th", "an", "er", "qu", "ou", "zé") for b in ("in", "on", "ly", "ea", "st")]
    rows = []
    for i in range(n):
        words, bad = [rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(8, 80))], rng.random() < 0.25
        if bad:
            how = rng.randint(0, 2)
            words = [w.upper() + "!!" for w in words] if how == 0 else [w + rng.choice(["%%%", "###"]) for w in words] if how == 1 else [words[k // 9] for k in range(len(words))]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_held_out(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(None, None, 0.0), (5000, "", 0.0), (5001, "x" * 200_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [i for i, _, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) >= 0.97


def test_degenerate(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert {r.score for r in got} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_random_indexing():
    """Table sums equal the plain definition."""
    import pyarrow as pa

    texts = [b"a B. c", b"d", b"a a !! a"]
    words = quality.Vocabulary([xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b.", b"!!")])
    out = next(quality._gather(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])]), words))
    table = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, quality.WIDTH) for x in out.column(1).to_pylist()])
    want, index = np.zeros_like(table), quality.index_vectors()
    for t in texts:
        form, lexical = words.units(t)
        assert [n if n < 3 else None for n in lexical.tolist()] == [{b"a": 0, b"b.": 1, b"!!": 2}.get(w.lower()) for w in t.split()]
        for i in range(len(form)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(form):
                    want[form[i]] += index[form[j]]
                    want[quality.FORMS + lexical[i]] += index[form[j]]
    assert (table == want).all()


def test_frequent_words_have_vectors_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A a b", "b c a", "d", None, ""] * 3)], "doc_id long, text string")
    words = quality.vocabulary(docs)
    assert list(words.numbers)[:2] == [xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b")] and len(words.numbers) == 3
    long = [b"x" * 11 + b"1" + b"-y", b"x" * 11 + b"1" + b"+y"]  # forms differ only behind the twelfth byte
    assert len({quality.Vocabulary([]).units(w)[0][0] for w in long}) == 2


def test_held_out_rows_of_the_supplied_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
