"""Operator 5: exact substring de-duplication with suffix automata.

Words are maximal runs of anything but ASCII white space, unchanged.  A window
is ``WINDOW`` consecutive words of one document.  A word goes if a window that
covers it has a word sequence that also starts earlier: in a document with a
smaller id, or in the same one further to the front.  Windows are judged on the
input.

The reference that documents are matched against is the corpus itself, which no
broadcast can hold.  It is therefore cut into shards by content, and a shard's
automaton is built where the matching documents' text arrives:

1. A window's anchor is its smallest hash of ``ANCHOR`` consecutive words.
   Equal windows have equal anchors; a run of windows with one anchor is a
   segment.  Anchors that stand in one text only are settled: nothing repeats.
   A map task that meets an anchor in two texts knows, and tells it once.
2. Texts send their segments with repeated anchors to the anchor's shard.  Of
   equal texts only the one with the smallest id does; the others go as a whole
   if they have a window at all.  A map task settles segments that it has seen
   word for word at an earlier place and doesn't send them.
3. A shard reads an anchor's segments in the order of their places and keeps a
   suffix automaton of those before.  Matching statistics against it (for a
   segment with inner repeats: against it and the segment's own beginning) show
   the windows that occurred earlier; only segments with something new extend
   the automaton, so its size follows the different texts, not the copies.
4. Spans are merged per document and cut out.

Null texts have no words.  Rows with a null id keep their words and are no
reference.  Rows that repeat an id count as one document: equal rows get equal
results, different texts are ordered by start, then by their hash.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, map_arrow, sha256_hex
from .linededup import packed, unpack

WINDOW = 20
ANCHOR = 6
#: Segments that a map task remembers, so as not to send their repeats.
REMEMBERED = 150_000
#: Anchors (one a slot of a table) and texts that a map task remembers, so as not to deal out a frequent anchor again and again.
REMEMBERED_ANCHORS = 1_000_003

_BASE = 0x9E3779B97F4A7C15
_GRAM = np.array([pow(_BASE, k, 2**64) for k in range(64)], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def segments(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows and whether the anchor's words occur twice, per segment."""
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none.astype(bool)
    grams = np.zeros(n - anchor + 1, np.uint64)
    for k in range(anchor):
        grams += hashes[k : n - anchor + 1 + k] * _GRAM[k]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xA0761D6478BD642F)
    grams ^= grams >> np.uint64(29)
    width = window - anchor + 1
    left = right = np.arange(len(grams))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = left[: len(left) - step], left[step:]
        left = np.where(grams[b] < grams[a], b, a)
        a, b = right[: len(right) - step], right[step:]
        right = np.where(grams[b] <= grams[a], b, a)
        span += step
    least = grams[left]
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, len(least)))
    return least[starts].view(np.int64), starts, counts, right[starts + counts - 1] > left[starts]


class SuffixAutomaton:
    """Suffix automaton of several word sequences, grown word by word."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _add(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(word) == q:
                nxt[p][word] = clone
                p = link[p]
            return clone

        if (q := nxt[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def _step(self, state: int, size: int, word: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.length
        while state and word not in nxt[state]:
            state = link[state]
            size = length[state]
        to = nxt[state].get(word)
        return (0, 0) if to is None else (to, size + 1)

    def statistics(self, words: list[int]) -> list[int]:
        """Per word, the length of the longest suffix ending there that occurs in the automaton."""
        out, state, size = [], 0, 0
        for word in words:
            state, size = self._step(state, size, word)
            out.append(size)
        return out

    def extend(self, words: list[int]) -> list[int]:
        """As ``statistics``, counting occurrences that end before this one in ``words`` too; adds ``words``."""
        link, length = self.link, self.length
        out, state, size, last = [], 0, 0, 0
        for word in words:
            state, size = self._step(state, size, word)
            out.append(size)
            last = self._add(last, word)
            while state and length[link[state]] >= size:  # the state may have been split
                state = link[state]
        return out


def _spans(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """Word spans (from, to) covered by windows whose last word's statistic reaches the window."""
    ends = np.flatnonzero(np.array(sizes) >= window)
    if not len(ends):
        return []
    gaps = np.flatnonzero(np.diff(ends) > 1)
    first, last = ends[np.concatenate([[0], gaps + 1])], ends[np.concatenate([gaps, [len(ends) - 1]])]
    return [(int(a) - window + 1, int(b) + 1) for a, b in zip(first, last, strict=True)]


def _tag(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


_FOUND = {"k": pa.int64(), "anchor": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "sure": pa.bool_()}
_FOUND_SCHEMA = "k bigint, anchor bigint, doc bigint, tag bigint, sure boolean"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an anchor and a document, dealt by ``k``, which is the anchor (``anchor`` is null then) or anything.

    An anchor that the task has met in another text, or that stands twice in one, is
    ``sure`` to repeat.  The first such row still goes to the anchor's place, so that
    documents elsewhere learn of it; later ones of the task know enough and are dealt
    evenly, hence a frequent anchor has two rows a task at its place.  A text that the
    task has met in a document before is no original and has no rows.
    """
    size = REMEMBERED_ANCHORS
    held, text_of, state = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int8)  # state: 0 free, 1 met in one text, 2 known to repeat
    least: dict[int, int] = {}
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tag = _tag(text)
            if least.get(tag, doc + 1) <= doc:
                continue
            if len(least) >= size:
                least.clear()
            least[tag] = doc
            anchor, _, _, twice = segments(word_hashes(text.split()))
            if not len(anchor):
                continue
            anchor, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
            sure = (times > 1) | (np.bincount(which, twice) > 0)  # in two segments, or twice in one
            slot = (anchor.view(np.uint64) % np.uint64(size)).astype(np.int64)
            met = held[slot] == anchor
            known = met & (state[slot] == 2)
            sure |= known | (met & (state[slot] == 1) & (text_of[slot] != tag))
            told = ~known
            held[slot], text_of[slot], state[slot] = anchor, tag, 1 + sure
            spread = (anchor.view(np.uint64) * np.uint64(_BASE) + np.uint64(doc & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            columns = {"k": np.where(told, anchor, spread), "anchor": pa.array(anchor, mask=told), "doc": np.full(len(told), doc, np.int64), "tag": np.where(told, tag, 0), "sure": sure}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in _FOUND.items()], names=list(_FOUND))


def _joined(stream: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches: a text makes a small one."""
    held, size = [], 0
    for batch in stream:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_SENT = {"anchor": pa.int64(), "doc": pa.int64(), "start": pa.int32(), "tag": pa.int64(), "to": pa.int32(), "words": pa.binary()}
_SENT_SCHEMA = "anchor bigint, doc bigint, start int, tag bigint, to int, words binary"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc, _packed, anchors``: segments to be matched, and settled spans without words."""
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = unpack(text)
            tag, hashes = _tag(data), word_hashes(data.split())
            anchor, start, count, _ = segments(hashes)
            picked = np.flatnonzero(np.isin(anchor, np.array(wanted, np.int64)))
            out = {k: [] for k in _SENT}
            for g in picked.tolist():
                a = int(start[g])
                b = a + int(count[g]) + WINDOW - 1
                words = hashes[a:b].tobytes()
                key = xxhash.xxh3_128_digest(words)
                place = (doc, a)
                settled = seen.get(key, place) < place
                if not settled:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = place
                for k, v in zip(_SENT, (int(anchor[g]), doc, a, tag, b, None if settled else words), strict=True):
                    out[k].append(v)
            if out["doc"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _SENT.items()], names=list(_SENT))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by anchor and place: spans of words to take out."""
    held, automaton, first, known, last = None, None, None, set(), None
    for batch in batches:
        out = {"doc": [], "tag": [], "a": [], "b": []}
        columns = [batch.column(k).to_pylist() for k in ("anchor", "doc", "start", "tag", "words")]
        for anchor, doc, start, tag, raw in zip(*columns, strict=True):
            if anchor != held:
                held, automaton, first, known, last = anchor, None, None, set(), None
            if (doc, start, tag) == last:
                continue
            last = (doc, start, tag)
            words = np.frombuffer(raw, np.uint64).tolist()
            digest = xxhash.xxh3_128_digest(raw)
            if digest in known:
                spans = [(0, len(words))]
            elif first is None and automaton is None and len(set(words)) == len(words):
                first, spans = words, []  # nothing before it and no inner repeats: the automaton can wait
                known.add(digest)
            else:
                if automaton is None:
                    automaton = SuffixAutomaton()
                    if first is not None:
                        automaton.extend(first)
                known.add(digest)
                sizes = automaton.statistics(words)
                if min(sizes[WINDOW - 1 :]) < WINDOW:
                    sizes = automaton.extend(words)
                spans = _spans(sizes, WINDOW)
            for a, b in spans:
                for k, v in zip(out, (doc, tag, start + a, start + b), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc"], pa.int64()), pa.array(out["tag"], pa.int64()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32())], names=list(out))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, spans``: per document that loses words, its spans as (tag, a, b); a null a stands for the whole text.

    ``tag`` is the hash of the text that the span belongs to.
    """
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), bytes_of(text_col).alias("_text"))

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_tag(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc", "tag"])

    texts = cut(map_arrow(own, tags, "doc bigint, tag bigint"))
    first = texts.groupBy("tag").agg(F.min("doc").alias("first"))
    copies = texts.join(first, "tag").filter("doc > first").select("doc", "tag")
    # each task gives a place two rows at most for an anchor that it finds to repeat, so what meets there is small
    found = map_arrow(own, lambda b: _joined(_anchors(b)), _FOUND_SCHEMA)
    place = Window.partitionBy("k")
    apart = (F.min("tag").over(place) != F.max("tag").over(place)) | F.max("sure").over(place)
    originals = texts.join(first, "tag").filter("doc = first").select("doc").distinct()
    repeated = found.withColumn("apart", apart).filter("apart").select("doc", F.coalesce("anchor", "k").alias("anchor"))
    wanted = repeated.groupBy("doc").agg(F.collect_set("anchor").alias("anchors")).join(originals, "doc")
    sent = cut(map_arrow(packed(own.select("doc", F.col("_text").cast("string").alias("text")), "doc", "text").join(wanted, "doc").select("doc", "_packed", "anchors"), lambda b: _joined(_send(b)), _SENT_SCHEMA))
    shards = sent.filter("words is not null").select("anchor", "doc", "start", "tag", "words").repartition("anchor").sortWithinPartitions("anchor", "doc", "start", "tag")
    matched = map_arrow(shards, _match, "doc bigint, tag bigint, a int, b int", None)
    settled = sent.filter("words is null").select("doc", "tag", F.col("start").alias("a"), F.col("to").alias("b"))
    whole = copies.select("doc", "tag", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    every = matched.union(settled).union(whole)
    return every.groupBy("doc").agg(F.collect_list(F.struct("tag", "a", "b")).alias("spans"))


def kept_words(text: bytes, found: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not found or len(words) < WINDOW:
        return words, len(words)
    tag, gone = _tag(text), np.zeros(len(words) + 1, np.int64)
    for s in found:
        if s["tag"] == tag:
            gone[s["a"] or 0] += 1
            gone[len(words) if s["b"] is None else s["b"]] -= 1
    out = np.cumsum(gone)[:-1] > 0
    return [w for w, g in zip(words, out.tolist(), strict=True) if not g], len(words)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every row."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, n = kept_words(unpack(text), found)
                total.append(n)
                gone.append(n - len(words))
                kept.append(sha256_hex(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    joined = packed(docs, id_col, text_col).join(spans(docs, id_col, text_col).withColumnRenamed("doc", id_col), id_col, "left").select(id_col, "_packed", "spans")
    return map_arrow(joined, work, f"`{id_col}` {key}, n_words long, n_removed long, kept_sha256 string")


REPORT_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS s FROM d WHERE len(ws) >= {WINDOW})),
fst AS (SELECT k, min({{'a': doc_id, 'b': s}}) AS f FROM win GROUP BY k),
late AS (SELECT w.doc_id, w.s FROM win w JOIN fst ON fst.k = w.k WHERE fst.f < {{'a': w.doc_id, 'b': w.s}}),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM late, range(0, {WINDOW}) t(o)),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY x.p) AS t FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
