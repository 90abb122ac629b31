"""Line de-duplication against brute force."""

import hashlib
import random

from tessera.llm import linededup


def one_edit(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow(rows):
    places = [(i, k, line.encode().split(), n) for n, (i, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    gone = {}
    for i, k, words, n in places:
        if i is not None and any(j is not None and (j, m) < (i, k) and one_edit(words, other) for j, m, other, _ in places):
            gone.setdefault(n, set()).add(k)
    return gone


def make_rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    lines = [rng.choices(vocab, k=rng.randint(1, 12)) for _ in range(40)]
    out = [(None, "a b c d e f"), (1, None), (2, ""), (3, "\n \n"), (500, "a a a a a a\na a a a a\na a a a a a a")]
    for i in rng.sample(range(10, 400), 120):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(lines))
            how = rng.randint(0, 5)
            if how == 0:
                line[rng.randrange(len(line))] = rng.choice(vocab)
            elif how == 1:
                line.insert(rng.randint(0, len(line)), rng.choice(vocab))
            elif how == 2:
                del line[rng.randrange(len(line))]
            text.append((" " * rng.randint(1, 2)).join(line))
        out.append((i, "\n".join(text)))
    out += [out[-1], (out[-2][0], out[-3][1])]
    return out


def test_report_and_clean(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, line string, row int")
    gone = slow(rows)
    assert gone
    want = []
    for n, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(n, ()))
        want.append((i, sum(bool(x.split()) for x in lines), len(gone.get(n, ())), hashlib.sha256(kept.encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = [tuple(r) for r in linededup.report(docs).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    texts = linededup.clean(docs)
    assert texts.columns == docs.columns
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in texts.collect()) == sorted(w[3] for w in want)


def test_empty(spark):
    assert linededup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text(spark):
    text = "\n".join(["word " * 20_000, "x" * 300_000, "word " * 20_001])
    got = linededup.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got[0].n_removed == 1


def test_within_one():
    rng = random.Random(8)
    for _ in range(3_000):
        a = rng.choices("abc", k=rng.randint(0, 7))
        b = rng.choices("abc", k=rng.randint(0, 7))
        one = a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or any(long[:i] + long[i + 1 :] == short for short, long in ((a, b), (b, a)) for i in range(len(long)))
        assert linededup.within_one([x.encode() for x in a], [x.encode() for x in b]) == one


def test_bitmap_lets_all_wanted_pass(spark):
    texts = spark.createDataFrame([(i, str(i)) for i in range(-50, 2_000)], "doc long, _text string")
    wanted = [-7, 0, 3, 1_999]
    kept = linededup.holding(texts, spark.createDataFrame([(i,) for i in wanted], "doc long")).collect()
    assert {r.doc for r in kept} >= set(wanted) and len(kept) < 20
    assert linededup.holding(texts, spark.createDataFrame([], "doc long")).count() == 0
