"""The stored index against plain BM25, and that it leaves blocks unopened."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.operators import fulltext


def plain(docs, cases, most):
    """Best documents by BM25 over all of them."""
    words = {d: re.findall("[0-9a-z가-힣_]+", (t or "").lower()) for d, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for case, terms in cases:
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws)
            own = [max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in sorted(set(terms)) if tf[t]]
            if own:
                scores[d] = round(sum(own), 9)
        out[case] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    common, rare = [f"w{i}" for i in range(40)], [f"rare{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(3, 60)) + rng.choices(rare[(i // 40) % 10 * 40 : (i // 40) % 10 * 40 + 40], k=rng.randint(0, 6)))) for i in range(1_600)]
    docs += [(5_000, None), (5_001, ""), (5_002, docs[3][1]), (5_003, "가나다 w1 W1 w1, w1!")]
    cases = [(c, rng.sample(rare, 3) + rng.sample(common, 1)) for c in range(25)] + [(90, ["nowhere"]), (91, []), (92, ["w1", "w1", "가나다"]), (93, ["w3"])]
    return docs, cases


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    docs, _ = corpus
    made = fulltext.Index(spark, str(tmp_path_factory.mktemp("index")))
    old = fulltext.RANGE_BITS
    fulltext.RANGE_BITS = 4
    try:
        made.add(spark.createDataFrame(docs[:900], "doc_id long, text string").repartition(3, "doc_id"))
        made.add(spark.createDataFrame(docs[900:], "doc_id long, text string").coalesce(2))
    finally:
        fulltext.RANGE_BITS = old
    return made


def check(got, want, cases):
    found = {}
    for r in got.orderBy("case", "rank").collect():
        found.setdefault(r.case, []).append((r.id, round(r.score, 6)))
    assert {c: found.get(c, []) for c, _ in cases} == {c: [(d, round(s, 6)) for d, s in want[c]] for c, _ in cases}


@pytest.mark.parametrize("most", [1, 5])
def test_equal_to_plain_bm25(spark, corpus, index, most):
    docs, cases = corpus
    asked = spark.createDataFrame(cases, "q int, terms array<string>")
    check(index.search(asked, "q", most), plain(docs, cases, most), cases)
    opened, touched = index.opened()
    assert 0 < opened < touched


def test_rare_terms_open_few_blocks(spark, corpus, index):
    docs, _ = corpus
    cases = [(1, ["rare5", "w0", "w1"])]
    check(index.search(spark.createDataFrame(cases, "q int, terms array<string>"), "q", 3), plain(docs, cases, 3), cases)
    opened, touched = index.opened()
    assert opened < touched / 3


def test_blocks_hold_every_posting_once_and_true_hulls(spark, corpus, index):
    docs, _ = corpus
    rows = index.blocks().collect()
    got = Counter((r.term, p.id, p.tf, p.dl) for r in rows for p in r.postings)
    want = Counter((t, d, n, len(ws)) for d, text in docs for ws in [re.findall("[0-9a-z가-힣_]+", (text or "").lower())] for t, n in Counter(ws).items())
    assert got == want and all(r.n == len(r.postings) <= 16 for r in rows)
    for r in rows:
        hull = {(h.tf, h.dl) for h in r.hull}
        pairs = {(p.tf, p.dl) for p in r.postings}
        assert hull == {a for a in pairs if not any(b != a and b[0] >= a[0] and b[1] <= a[1] for b in pairs)}


def test_many_terms_go_without_the_scan_filter(spark, corpus, index, monkeypatch):
    docs, cases = corpus
    monkeypatch.setattr(fulltext, "MOST_PUSHED", 2)
    asked = spark.createDataFrame(cases, "q int, terms array<string>")
    check(index.search(asked, "q", 2), plain(docs, cases, 2), cases)


def test_heads_are_read_without_postings(spark, corpus, index):
    asked = spark.createDataFrame(corpus[1], "q int, terms array<string>")
    plan = index._asked(asked, "q")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "hull" in line]
    assert scans and not any("postings" in line for line in scans)


def test_snippets_mark_what_was_asked(spark):
    docs = spark.createDataFrame([(1, "one two\nThree, four five"), (2, None)], "doc_id long, text string")
    cases = spark.createDataFrame([(7, ["three", "five"])], "q int, terms array<string>")
    hits = spark.createDataFrame([(7, 1), (7, 2)], "case int, id long")
    got = {r.id: r.snippet for r in fulltext.snippets(hits, docs, cases, "q", around=1).collect()}
    assert got == {1: "two <b>Three,</b>", 2: ""}
