"""SimHash components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def slow_print(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in prints}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [(0, None, "x"), (1, "", "x"), (2, "one Two", "x"), (3, "ONE two", "x"), (4, " \x1c word", "x")]
    for i in range(5, 60):
        base = rng.choices(words, k=rng.randint(3, 300))
        out.append((i * 10, " ".join(base), "y"))
        for c in range(rng.randint(0, 3)):
            copy = list(base)
            if c:
                copy[rng.randrange(len(copy))] = "changed"
            out.append((i * 10 + c + 1, "  ".join(copy), "y"))
    return out


def test_fingerprint(rows):
    for _, text, _ in rows:
        assert simhash.fingerprint((text or "").encode()) == slow_print(text)


@pytest.mark.parametrize("longest", [256, 2])
def test_components(spark, rows, longest):
    """With lists of 2 the midpoints do the work."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, longest=longest).collect()}
    prints = [(i, slow_print(t)) for i, t, _ in rows]
    expected = slow_components(prints)
    assert got == {i: (f"{p:016x}", expected[i]) for i, p in prints}


def test_close_prints(spark):
    """Many values around a few centres, so that lists are long for real."""
    rng = random.Random(1)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from tessera.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp long"), 16)).collect()}
    slow = slow_components(sorted((s, s % (1 << 64)) for (s,) in signed))
    assert {s: got.get(s, s) for (s,) in signed} == slow


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "zz yy")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id is None) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, False), (False, False), (True, False), (True, True)]
    assert simhash.keep_one(docs).count() == 4


def test_the_count_filter_rejects_pairs():
    """Of pairs that share a list many share no fourth byte; those are not compared bit by bit."""
    rng = np.random.RandomState(2)
    members = rng.randint(0, 2**63, 200).view(np.uint64)
    members = (members & ~np.uint64(0xFFFFFF)) | np.uint64(0xABCDEF)  # one list: three bytes agree
    words = members[:, None]
    shared = simhash.tally(words[:, None], words[None])[np.triu_indices(200, 1)]
    assert (shared >= 3).all() and (shared < simhash.LEAST_SHARED).mean() > 0.9
    u, v = simhash.forest(np.array([0, 15, 255, 1 << 60], np.int64))
    assert dict(zip(u.tolist(), v.tolist())) == {15: 0, 255: 0, 1 << 60: 0}


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5_000)]
    rows, pairs = [(0, ""), (1, None), (2, "few words"), (3, "FEW words"), (4, " ".join(rng.choices(words, k=30_000)))], []
    for i in range(100):
        base = rng.choices(words, k=rng.randint(60, 400))
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice([0.005, 0.01, 0.03, 0.05])))):
            copy[at] = rng.choice(words)
        rows += [(10 + 2 * i, " ".join(base)), (11 + 2 * i, " ".join(copy))]
        pairs.append((10 + 2 * i, jaccard(*[t for _, t in rows[-2:]])))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows + [(None, "few words")], "doc_id long, text string"), longest=64).collect()}
    assert got[0] == got[1] == 0 and got[2] == got[3] == 2 and got[4] == 4 and len(got) == len(rows)
    high = [i for i, j in pairs if j >= 0.8]
    assert high and sum(got[i + 1] == i for i in high) >= 0.9 * len(high)
    assert all(got[i + 1] == i + 1 for i, j in pairs if j < 0.8)


def test_a_large_group_of_near_copies(spark):
    """More members than a list pairs off: windows link them."""
    rng = random.Random(4)
    base = rng.choices([f"w{i}" for i in range(900)], k=200)
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), longest=50).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300


@pytest.mark.parametrize("longest", [1_024, 100])
def test_no_similar_pair_is_left_apart(spark, longest):
    """Pairs at 0.8 and just above, a passage that many texts share, near copies in a long list, and repeats that hide what differs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3_000)]
    passage = rng.choices(words, k=40)
    rows = []
    for i in range(150):
        n = rng.randint(40, 120)
        base = rng.choices(words, k=n) + passage
        at = rng.randrange(5, n - 5)  # words put in at one place leave all shingles but four
        more = len(base) // 4 - 9 - i % 3
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:at] + [f"x{i}_{k}" for k in range(more)] + base[at:]))]
    loop = "a b c d e " * 500
    rows += [(1000, loop + "one two three four five six seven eight"), (1001, loop + "nine ten eleven twelve more or less"), (1002, "only few"), (1003, "Only FEW")]
    split = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    likeness = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x, y in combinations(sorted(sets), 2)}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (x, y), j in likeness.items():
        if j >= 0.8:
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    assert sum(0.8 <= j < 0.84 for j in likeness.values()) > 50
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, longest=longest).collect()}
    assert got == {i: root(i) for i, _ in rows}


def test_sketches_bound_what_sets_share(spark):
    """Never below what two sets share, whatever their sizes, and low enough to rule out most pairs that are not similar."""
    from pyspark.sql import functions as F

    rng = np.random.RandomState(7)
    hashes = lambda n: rng.randint(0, 2**63, n).view(np.uint64) * np.uint64(2) + np.uint64(1)
    rows = []
    for n in [1, 2, 15, 16, 17, 63, 64, 65, 300, 1_030, 5_000] * 3:
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            a = np.unique(hashes(n))
            b = np.unique(np.concatenate([rng.permutation(a)[: round(share * n)], hashes(max(1, round((1.2 - share) * n)))]))
            rows.append((simhash.sketch(a).tolist(), simhash.sketch(b).tolist(), len(a), len(b), len(np.intersect1d(a, b))))
    made = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, na int, nb int, shared int")
    most = simhash.most_shared(F.col("a"), F.col("b"), F.col("na"), F.col("nb"))
    got = made.select("na", "nb", "shared", most.alias("most")).collect()
    assert all(r.shared <= r.most <= min(r.na, r.nb) for r in got)
    unlike = [r for r in got if r.na >= 300 and r.shared <= 0.6 * r.na]
    assert unlike and all(r.most < 0.8 / 1.8 * (r.na + r.nb) for r in unlike)


def test_few_sets_meet_in_pairs(spark, monkeypatch):
    """Texts with one first shingle in common are told apart by sketches: no set of theirs is sent anywhere."""
    asked = []
    whole = simhash.most_shared
    monkeypatch.setattr(simhash, "most_shared", lambda *x: asked.append(1) or whole(*x))
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3_000)]
    passage = rng.choices(words, k=30)
    rows = [(i, " ".join(passage + rng.choices(words, k=100))) for i in range(60)] + [(60, " ".join(passage)), (61, " ".join([*passage, "end"]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert asked and got == {i: min(i, 60) for i in range(62)}


def test_texts_with_a_passage_in_common_do_not_leave_in_pairs(spark, monkeypatch):
    """Of twenty passages each is in 60 texts: what any step makes follows the texts, not the pairs of them."""
    made, whole = [], simhash.map_arrow

    def counted(df, work, schema, *more):
        rows = df.sparkSession.sparkContext.accumulator(0)
        made.append((schema, rows))

        def run(batches):
            for batch in work(batches):
                rows.add(batch.num_rows)
                yield batch

        return whole(df, run, schema, *more)

    monkeypatch.setattr(simhash, "map_arrow", counted)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3_000)]
    passages = [rng.choices(words, k=30) for _ in range(20)]
    rows = [(i, " ".join(passages[i % 20] + rng.choices(words, k=40))) for i in range(1_200)]
    at = rows[1_100][1].split()
    rows += [(1_200, " ".join([*at, "one", "more"])), (1_201, " ".join(passages[0] * 3))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1_100 if i == 1_200 else i for i in range(1_202)}
    pairs = {schema: rows.value for schema, rows in made if "list" not in schema}
    assert pairs and max(pairs.values()) <= 3 * len(rows), pairs


def test_parities_bound_what_sets_do_not_share(spark):
    """Bits that differ are never more than members that one set alone has, also where widths differ, and many where sets are unlike."""
    import pyarrow as pa

    rng = np.random.RandomState(3)
    hashes = lambda n: rng.randint(0, 2**63, n).view(np.uint64)
    sets = []
    for n in (1, 2, 31, 120, 128, 129, 300, 1_000, 1_024, 1_025, 2_100, 9_000):
        for share in (0.0, 0.7, 0.9, 1.0):
            a = np.unique(hashes(n))
            sets += [a, np.unique(np.concatenate([rng.permutation(a)[: round(share * n)], hashes(max(1, round((1.2 - share) * n)))]))]
    zero = [0] * len(sets)
    columns = {"token": zero, "x": zero, "y": zero, "block": zero, "key": list(range(len(sets))), "root": list(range(len(sets))), "n": [len(s) for s in sets], "bits": [simhash.parities(s) for s in sets]}
    members = simhash._Members(pa.table(columns))
    x, y = (np.array(v) for v in zip(*combinations(range(len(sets)), 2), strict=True))
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    found = members.unlike(x, y)
    assert (found <= apart).all()
    total = members.n[x] + members.n[y]
    unlike = (apart >= 0.6 * total) & (np.minimum(members.n[x], members.n[y]) >= 0.8 * np.maximum(members.n[x], members.n[y])) & (total >= 600)
    assert unlike.any() and (found[unlike] > total[unlike] / 9).all()
    open_ = {tuple(p) for made in members.pairs(members.bounds(), 0.8) for p in made.tolist()}
    like = {(a, b) for a, b, d, t in zip(x.tolist(), y.tolist(), apart.tolist(), total.tolist(), strict=True) if (t - d) / 2 >= 0.8 * (t + d) / 2}
    assert like and like <= open_
