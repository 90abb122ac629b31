"""Queries over whole tables that have no SQL twin, against brute force."""

import random
import re

from tessera.operators import audit as A
from tessera.plans import catalog


def verdict(text):
    t = re.sub("[ \t\r\n\x0b\f]+", " ", text or "").strip(" ")
    letters = len(re.findall("[A-Za-z가-힣À-ÖØ-öø-ÿ]", t))
    if not t:
        return "empty"
    if re.search(r"^[=-]+ *\[?[A-Za-z]+ [0-9]+\]? *[=-]+$", t):
        return "page_marker"
    if len(re.findall(r"\.{4,}", t)) >= 2:
        return "toc"
    if letters < 10:
        return "short"
    if letters / len(t) < 0.3:
        return "few_letters"
    return "monotone" if len(set(t)) / len(t) < 0.15 else "ok"


def test_gate_of_all_lengths(spark, tmp_path):
    long = " ".join(f"{chr(0x4E00 + i)}" for i in range(500))
    texts = [
        None, "", "a short text of use", "plain words " * 60, "Chapter one ..... 3\nChapter two ..... 9\n" * 30, "1234567890 x " * 50, long,
        long + " abcdefghijklm", "".join(chr(0xAC00 + i) for i in range(700)), "=== [PAGE 3] ==="
    ]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reason for r in catalog.QUERIES["gate_all"](spark, str(tmp_path)).collect()}
    assert got == {i: verdict(t) for i, t in rows}
    assert {"toc", "few_letters", "monotone", "ok"} <= {got[i] for i, t in rows if t and len(t) >= 400} | {got[2]} and got[8] == "ok"


def test_gate_of_supplied_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.reason for r in catalog.QUERIES["gate_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: verdict(t) for i, t in docs.items()}


def test_self_hits_beyond_the_first_ids(spark, tmp_path):
    """Vectors after the first twenty that are all alike do not find themselves first."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)] if i < 20 else [1.0] * 8) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["self_hit_sample"](spark, str(tmp_path)).head()
    drawn = [r.vec_id for r in A.hash_sample(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, "vec_id", 7).collect()]
    assert got.sampled == len(set(drawn)) == 50 and got.first < 0.5
    assert got.first == round(sum(i <= 20 for i in drawn) / 50, 6) and got.top3 == round(sum(i <= 22 for i in drawn) / 50, 6)
