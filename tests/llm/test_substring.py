"""Substring de-duplication against brute force."""

import hashlib
import random

import numpy as np

from tessera.llm import substring


def slow(rows):
    """Per row: words, and the words that stay."""
    first = {}
    lists = [(t or "").encode().split() for _, t in rows]
    places = [(i, k, substring._tag((t or "").encode()), n) for n, (i, t) in enumerate(rows) if i is not None for k in range(len(lists[n]) - 19)]
    for p in sorted(places):
        first.setdefault(tuple(lists[p[3]][p[1] : p[1] + 20]), p[:3])
    out = []
    for n, (i, t) in enumerate(rows):
        gone = set()
        for k in range(len(lists[n]) - 19):
            if i is not None and first[tuple(lists[n][k : k + 20])] < (i, k, substring._tag((t or "").encode())):
                gone |= set(range(k, k + 20))
        kept = [w for k, w in enumerate(lists[n]) if k not in gone]
        out.append((i, len(lists[n]), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def make_rows():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(40)]
    passages = [rng.choices(vocab, k=rng.choice([18, 19, 20, 21, 25, 40, 90])) for _ in range(25)]
    out = [(None, "a " * 60), (None, "a " * 60), (1, None), (2, ""), (3, "x " * 50), (4, "x y " * 33), (5, "x " * 19), (6, "y x " * 40), (7, "a " * 61)]
    for i in rng.sample(range(8, 500), 150):
        text = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "odd"
            text += rng.choices(vocab, k=rng.randint(0, 10)) + part
        out.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    out += [(i + 500, t) for i, t in rng.sample(out[20:], 25)]
    out += [out[30], out[40], (out[31][0], out[33][1])]
    return out


def test_report(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, a int, words string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = sorted((tuple(r) for r in substring.report(docs).collect()), key=order)
    want = sorted(slow(rows), key=order)
    assert sum(w[2] for w in want) > 1000
    assert got == want


def test_repeats_within_one_text(spark):
    """Windows that repeat in one document only, overlapping or apart."""
    rng = random.Random(3)
    vocab = [f"u{i}" for i in range(5_000)]
    part = rng.sample(vocab, 40)
    rows = [(1, " ".join([*part, *rng.sample(vocab, 30), *part])), (2, " ".join(w for w in rng.sample(vocab, 6) for _ in range(30))), (3, " ".join(rng.sample(vocab, 90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(slow(rows))
    assert [w[2] > 0 for w in want] == [True, True, False]
    assert sorted(tuple(r) for r in substring.report(docs).collect()) == want


def test_empty_and_long(spark):
    assert substring.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "q" * 500_000 + " " + "w " * 30_000)], "doc_id long, text string")
    assert substring.report(docs).collect()[0].n_removed == 29_999


def test_automaton():
    rng = random.Random(2)
    for _ in range(40):
        automaton, before = substring.SuffixAutomaton(), []
        for _ in range(4):
            words = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
            subs = {tuple(b[i:j]) for b in before for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
            longest = lambda end, known, w=words: max((end + 1 - i for i in range(end + 1) if tuple(w[i : end + 1]) in known), default=0)
            assert automaton.statistics(words) == [longest(e, subs) for e in range(len(words))]
            inner = [longest(e, subs | {tuple(words[i:j]) for j in range(e + 1) for i in range(j)}) for e in range(len(words))]
            assert automaton.extend(words) == inner
            before.append(words)


def test_segments_meet():
    rng = random.Random(6)
    for _ in range(50):
        a = np.array([rng.randint(0, 3) for _ in range(60)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        anchor, start, count, twice = substring.segments(a)
        at = {w: (anchor[g], g) for g in range(len(anchor)) for w in range(start[g], start[g] + count[g])}
        for i in range(41):
            for j in range(i + 1, 41):
                if (a[i : i + 20] == a[j : j + 20]).all():
                    assert at[i][0] == at[j][0] and (at[i][1] != at[j][1] or twice[at[i][1]])


def test_anchors_are_dealt_out_twice_a_task():
    """Frequent anchors and copies have few rows at the anchor's place, and no document that needs them is lost."""
    import pyarrow as pa

    from tessera.llm import substring as S

    shared = " ".join(f"s{i}" for i in range(30))
    texts = [f"{shared} own{i} {' '.join(f'w{i}x{j}' for j in range(30))}".encode() for i in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs], pa.binary())], names=["doc", "_text"])
    rows = [r for b in S._anchors(iter([batch])) for r in b.to_pylist()]
    assert {r["doc"] for r in rows} == set(range(40))
    own = [set(S.segments(S.word_hashes(t.split()))[0].tolist()) for t in texts]
    everywhere = set.intersection(*own)
    assert everywhere
    places = {}
    for r in rows:
        places.setdefault(r["k"], []).append(r)
    for a in everywhere:
        assert len([r for r in places[a] if r["anchor"] is None]) == 2
    found = {}
    for r in rows:
        group = places[r["k"]]
        if len({x["tag"] for x in group}) > 1 or any(x["sure"] for x in group):
            found.setdefault(r["doc"], set()).add(r["k"] if r["anchor"] is None else r["anchor"])
    for i in range(40):
        assert found[i] == {a for a in own[i] if sum(a in o for o in own) > 1}


def test_forgetting_anchors_loses_nothing(spark, monkeypatch):
    import random

    from tessera.llm import substring as S

    monkeypatch.setattr(S, "REMEMBERED_ANCHORS", 3)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(25)]
    docs = [(i, " ".join([f"a{rng.randint(0, 50)}" for _ in range(40)] + passage * (i % 3 == 0) + [f"b{i}x{j}" for j in range(10)])) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in S.report(frame).collect()}
    starts, want = {}, {}
    for d, t in docs:
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            if starts.setdefault(tuple(w[k : k + 20]), (d, k)) < (d, k):
                gone |= set(range(k, k + 20))
        want[d] = len(gone)
    assert got == want and sum(want.values()) > 0
