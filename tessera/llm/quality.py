"""Operator 4: quality by random-indexing word vectors and a small network.

Words are maximal runs of anything but ASCII white space.  The ``WORDS`` most
frequent lower-cased words of the whole corpus have a vector each; the others
share ``OTHERS`` vectors by hash.  Every word also has a form: its character
classes with letter and digit runs collapsed, marked when the word repeats the
one before.  Each form has a fixed sparse ternary index vector.  Random indexing
over the whole corpus adds up, for every word and every form, the index vectors
of the forms next to it; the tables have a fixed size, whatever the corpus.

A text is pooled to the means of its forms' and its words' unit vectors.  A network of two layers in numpy is fitted to the pooled vectors of
at most ``MOST_LABELLED`` labelled rows (smallest id hashes) outside the
held-out fold; a temperature fitted on a fifth of them calibrates its
probabilities.  Id, language, source and label are no inputs of a score.

Null and empty texts pool to zero vectors and score like any other.  Without
labelled rows of both kinds the score is the share of label 1, or 0.5.
Repeated rows repeat their score, null ids stay (they count as held out or not
by the crc32 of the empty text), an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, bytes_of, map_arrow

FORMS = 1024
WORDS, OTHERS = 4096, 1024
LEXICAL = WORDS + OTHERS
WIDTH = 32
NONZERO = 4
HIDDEN = 24
MOST_LABELLED = 12_000
STEPS = 300
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
MEMO_WORDS = 500_000
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 400_000
#: Rows of a vector table that travel together.
TABLE_BLOCK = 256

_CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"([aA0])\1+")


def index_vectors() -> np.ndarray:
    """The forms' sparse ternary index vectors, the same everywhere."""
    rng = np.random.RandomState(404)
    out = np.zeros((FORMS, WIDTH), np.int64)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


class Vocabulary:
    """The frequent words' numbers, by hash; remembers what it has looked up, up to a bound."""

    def __init__(self, hashes: list[int]) -> None:
        self.numbers = {h: n for n, h in enumerate(hashes)}
        self.memo: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"numbers": self.numbers, "memo": {}}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        for word in words:
            if word not in self.memo:
                h = xxhash.xxh3_64_intdigest(word.lower())
                form = zlib.crc32(_RUNS.sub(rb"\1", word.translate(_CLASSES))) % (FORMS // 2)
                # the hash's low half tells repeated words; then the word's number and its form
                self.memo[word] = (h & 0xFFFFFFFF) << 31 | self.numbers.get(h, WORDS + h % OTHERS) << 10 | form

    def units(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Forms and word numbers of a text."""
        words = text.split()
        try:
            raw = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)
            raw = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        form = raw & (FORMS - 1)
        form[1:] += (raw[1:] >> 31 == raw[:-1] >> 31) * (FORMS // 2)
        return form, raw >> 10 & (1 << 21) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of lower-cased words and how often they occur."""
    counts: Counter[bytes] = Counter()

    def emit() -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, counts)), ">u8").astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], names=["h", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.lower().split())
            if len(counts) >= COUNTED:
                yield emit()
                counts.clear()
    yield emit()


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The most frequent words of all of ``docs``; ties by hash."""
    counted = map_arrow(docs.select(bytes_of(text_col).alias("_text")), _count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    return Vocabulary([r.h & 0xFFFFFFFFFFFFFFFF for r in counted.orderBy(F.desc("c"), "h").limit(WORDS).collect()])


def _gather(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[pa.RecordBatch]:
    """One partition's sums of neighbouring index vectors, by block of table rows."""
    pairs = np.zeros((FORMS + LEXICAL) * FORMS, np.int64)
    found: list[np.ndarray] = []
    size = 0

    def count() -> None:
        if found:
            np.add(pairs, np.bincount(np.concatenate(found), minlength=len(pairs)), out=pairs)
            found.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            form, lexical = words.units(text)
            if len(form) > 1:
                for own in (form, lexical + FORMS):
                    found += [own[1:] * FORMS + form[:-1], own[:-1] * FORMS + form[1:]]
                size += len(form)
                if size > 500_000:
                    count()
                    size = 0
    count()
    # random indexing is linear: pair counts times index vectors, a few rows at a time
    index = index_vectors()
    table = np.concatenate([part @ index for part in np.split(pairs.reshape(-1, FORMS), (FORMS + LEXICAL) // TABLE_BLOCK)])
    starts = range(0, len(table), TABLE_BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array([s // TABLE_BLOCK for s in starts], pa.int32()), pa.array([table[s : s + TABLE_BLOCK].tobytes() for s in starts], pa.binary())], names=["block", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, words: Vocabulary, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all forms and words, from every text; a table of fixed size."""
    schema = "block int, sums binary"
    shared = docs.sparkSession.sparkContext.broadcast(words)
    parts = map_arrow(docs.select(bytes_of(text_col).alias("_text")), lambda batches: _gather(batches, shared.value), schema)
    rows = map_arrow(parts.repartition("block"), _add, schema).collect()
    table = np.zeros((FORMS + LEXICAL, WIDTH))
    for block, raw in rows:
        table[block * TABLE_BLOCK : (block + 1) * TABLE_BLOCK] += np.frombuffer(raw, np.int64).reshape(-1, WIDTH)
    length = np.sqrt((table * table).sum(1, keepdims=True))
    return np.where(length > 0, table / np.where(length > 0, length, 1), 0.0)


def pool(text: bytes, words: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    form, lexical = words.units(text)
    if not len(form):
        return np.zeros(2 * WIDTH)
    forms = np.bincount(form, minlength=FORMS) @ vectors[:FORMS]
    # sums over a text's own words, so that short texts cost little
    own, counts = np.unique(lexical, return_counts=True)
    return np.concatenate([forms, counts @ vectors[FORMS + own]]) / len(form)


class Network:
    """Two layers and a temperature; ``score`` gives P(label 1)."""

    def __init__(self, words: Vocabulary, vectors: np.ndarray, constant: float = 0.5) -> None:
        self.words, self.vectors, self.constant, self.parts = words, vectors, constant, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.parts
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.RandomState(11)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        rest, own = (order[:cut], order[cut:]) if len(y) >= 50 else (order, order)
        mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
        z, t = (x[own] - mean) / scale, y[own].astype(np.float64)
        p = [rng.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, STEPS + 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - t) / len(t)
            back = d[:, None] * p[2] * (1 - h * h)
            for k, g in enumerate((z.T @ back + 1e-5 * p[0], back.sum(0), h.T @ d + 1e-5 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.parts = (mean, scale, *p)
        logits, truth = self.logits(x[rest]), y[rest]
        loss = lambda temp: np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / temp).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self


def held_out(id_column: Column) -> Column:
    return bucket_of(id_column, FOLDS) == HELD_OUT


def pooled(docs: DataFrame, words: Vocabulary, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id_col, x``: pooled vector of every row."""
    key, shared = dict(docs.dtypes)[id_col], docs.sparkSession.sparkContext.broadcast((words, vectors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pool(t, *shared.value).tolist() for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=[id_col, "x"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Network:
    """Word vectors from all of ``docs``; the network from a bounded sample of labelled rows outside the held-out fold."""
    words = vocabulary(docs, text_col)
    vectors = word_vectors(docs, words, text_col)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    sample = known.orderBy(F.xxhash64(F.lit("fit"), F.col(id_col)), id_col).limit(most)
    own = docs.select(id_col, text_col).join(F.broadcast(sample.select(id_col)), id_col, "left_semi")  # at most ``most`` ids
    rows = pooled(own, words, vectors, id_col, text_col).join(sample, id_col).select(id_col, "x", "_label").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return Network(words, vectors).fit(np.array([r[1] for r in rows]).reshape(-1, 2 * WIDTH), np.array([r[2] for r in rows], np.int64))


def score(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    key, shared = dict(docs.dtypes)[id_col], docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            x = np.array([pool(t, model.words, model.vectors) for t in batch.column(2).to_pylist()]).reshape(-1, 2 * WIDTH)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return map_arrow(docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, held_out boolean, score double, predicted int")
