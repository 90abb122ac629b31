"""Operator 3: toxicity as a cumulative-link ordinal regression.

Severity has ordered grades 0 (clean), 1 (mild) and 2 (severe).  The labels say
only toxic or not; a toxic row's grade follows from how often it says so: among
the labelled rows, words and word beginnings that occur in many toxic and next to
no clean texts form a lexicon, and toxic rows in which words of it occur at least
``SEVERE_TIMES`` times, repeats included, are severe, the others mild.  Repeats are no feature of
the model, which sees only what occurs.

Features are sparse: which words (lower-cased maximal runs of letters, digits
and underscores, any script) and which word beginnings of four and five
characters occur in the whole text.  One weight vector is shared by all
thresholds: P(grade > k) = sigmoid(w . x - theta_k) with theta_0 < theta_1.
The model is fitted in numpy by full-batch gradient steps on at most
``MOST_LABELLED`` labelled rows per label value, those with the smallest id
hash; features are those of at least ``LEAST_ROWS`` of these rows whose share of
toxic rows is ``LEAST_SHIFT`` standard deviations from chance.  The fitted
table has at most ``MOST_FEATURES`` weights, which bounds what is broadcast.

Expected severity = P(grade > 0) + P(grade > 1), between 0 and 2.  A row is
toxic if P(grade > 0) >= 0.5.

Null and empty texts have no features and get the model's base severity, which
is below the threshold unless most labelled rows are toxic.  Without labelled
rows of both kinds everything scores 0.  Rows are scored one by one: repeated
rows repeat their result, a null id stays, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MOST_LABELLED = 4_000
LEAST_ROWS = 5
LEAST_SHIFT = 6.0
MOST_FEATURES = 20_000
SEVERE_TIMES = 3
STEPS = 500
PENALTY = 1e-4
BEGINNINGS = (4, 5)

_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words and, marked by a bar, beginnings of longer words."""
    words = set(_WORD.findall((text or "").lower()))
    for n in BEGINNINGS:
        words |= {w[:n] + "|" for w in words if len(w) > n and w[-1] != "|"}
    return words


class OrdinalModel:
    """Weights of known features and the ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: tuple[float, float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str | None) -> tuple[float, float]:
        """P(grade > 0) and P(grade > 1)."""
        if not self.weights:
            return 0.0, 0.0
        get = self.weights.get
        x = sum([get(f, 0.0) for f in sorted(features(text))])
        return tuple(float(1 / (1 + np.exp(np.clip(t - x, -50, 50)))) for t in self.thresholds)


def marks(word: str) -> tuple[str, ...]:
    """A word and its marked beginnings."""
    return (word, *[word[:n] + "|" for n in BEGINNINGS if len(word) > n])


def grades(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows, 2 for toxic ones in which lexicon words occur at least ``SEVERE_TIMES`` times, 1 for other toxic ones."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    of_bad, of_clean = Counter(), Counter()
    for own, b in zip(words, toxic, strict=True):
        (of_bad if b else of_clean).update({m for w in set(own) for m in marks(w)})
    bad, clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    lexicon = {m for m, n in of_bad.items() if n >= LEAST_ROWS and of_clean[m] / clean <= 0.02 * n / bad}
    return np.array([0 if not b else 1 + (sum(not lexicon.isdisjoint(marks(w)) for w in own) >= SEVERE_TIMES) for own, b in zip(words, toxic, strict=True)])


def fit(texts: list[str | None], toxic: list[int]) -> OrdinalModel:
    """Cumulative-link model of labelled rows; deterministic for a given order."""
    bad = np.array(toxic, bool)
    if not len(bad) or bad.all() or not bad.any():
        return OrdinalModel({}, (0.0, 0.0))
    numbers: dict[str, int] = {}
    found = [np.array(sorted(numbers.setdefault(f, len(numbers)) for f in sorted(features(t))), np.int32) for t in texts]
    every = list(numbers)
    del numbers
    grade = grades(texts, bad)
    seen = np.bincount(np.concatenate(found), minlength=len(every))
    of_bad = np.bincount(np.concatenate([x for x, b in zip(found, bad, strict=True) if b]), minlength=len(every))
    share = bad.mean()
    shift = np.abs(of_bad - seen * share) / np.sqrt((seen * share * (1 - share) * (1 - seen / (len(found) + 1))).clip(1e-9))
    order = np.lexsort((np.arange(len(every)), -shift))
    picked = order[(seen[order] >= LEAST_ROWS) & (shift[order] >= LEAST_SHIFT)][:MOST_FEATURES]
    names = [every[f] for f in picked]
    place = np.full(len(every), -1)
    place[picked] = np.arange(len(picked))
    cols = [place[x][place[x] >= 0] for x in found]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    cols = np.concatenate(cols)
    weights, first, gap = np.zeros(len(names)), 0.0, 0.0
    scale = 1 / np.sqrt(np.bincount(cols, minlength=len(names)).clip(1))  # steps suited to each feature's frequency
    balance = np.where(bad, 0.5 / bad.mean(), 0.5 / (1 - bad.mean()))
    speed = np.zeros_like(weights)
    for step in range(STEPS):
        x = np.bincount(rows, weights[cols], minlength=len(found))
        theta = np.array([first, first + np.exp(gap)])
        up = 1 / (1 + np.exp(np.clip(theta[:, None] - x, -50, 50)))
        # one logistic loss per threshold, with the weights shared
        miss = (up - (grade[None, :] > np.array([[0], [1]]))) * balance / len(found)
        slope = np.bincount(cols, miss.sum(0)[rows], minlength=len(names)) * scale**2 * 40 + PENALTY * weights
        speed = 0.9 * speed + slope
        weights -= speed
        first += 4 * miss.sum()
        gap += 4 * miss[1].sum() * np.exp(gap)
        gap = float(np.clip(gap, -3, 3))
    return OrdinalModel({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-9}, (float(first), float(first + np.exp(gap))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> list:
    """At most ``most`` rows per label value, by id hash: a bounded sample for the driver."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    order = F.xxhash64(F.lit("fit"), F.col(id_col))
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("_label") == value).orderBy(order, id_col).limit(most)
        picked = some if picked is None else picked.union(some)
    rows = docs.select(id_col, F.col(text_col).alias("_text")).join(picked, id_col).select(id_col, "_text", "_label").collect()
    return sorted(rows, key=lambda r: (r[0], r[1] or ""))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> OrdinalModel:
    rows = labelled(docs, labels, id_col, text_col, most=most)
    return fit([r["_text"] for r in rows], [r["_label"] for r in rows])


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, p_toxic, severity, toxic`` of every row."""
    key = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.above(t) for t in batch.column(1).to_pylist()]
            p = np.array([a for a, _ in found], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p + np.array([b for _, b in found], np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "p_toxic", "severity", "toxic"])

    return map_arrow(docs.select(id_col, text_col), work, f"`{id_col}` {key}, p_toxic double, severity double, toxic int")


def clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject; null texts stay."""
    from pyspark.sql.types import StructType

    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [t is None or shared.value.above(t)[0] < 0.5 for t in batch.column(names.index(text_col)).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, StructType(docs.schema.fields))
