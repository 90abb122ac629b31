"""Operator 2: SimHash near-duplicate detection.

Fingerprints: words are maximal runs of anything but ASCII white space, with
A-Z lower-cased; each shingle of ``SHINGLE`` words, repeats included, is hashed
by XXH64 (seed 42); a bit is set if it is set in over half the hashes.

Search: a 64-bit fingerprint has eight byte positions.  Two fingerprints that
differ in at most four bits agree in at least four positions, so they share at
least four of the 56 combinations of three positions.  The inverted index holds
each distinct fingerprint under its positional bytes, three at a time.  In a
posting list each pair's shared positional bytes are tallied; pairs with the
guaranteed minimum of four (the list itself guarantees three) are verified by
their differing bits.  Verified pairs leave a list as a spanning forest: a
member and the smallest one that it is connected with.

Posting lists longer than ``LONG_LIST`` are not paired off.  Their members link
through midpoints instead: fingerprints differ in at most four bits exactly if
some value differs from each of them in at most two, so each member goes to its
2 081 midpoints and every midpoint links its members to the smallest.  The rows
are linear in the members and no link is lost.

Near copies by similarity (``similar_groups``, ``keep_one``) take shingles of five
words and link texts whose shingle sets have a Jaccard similarity of at least
0.8.  Such fingerprints differ in about a seventh of their bits, where 64 bits
say little: these have 256 bits in 32 byte positions, the index takes
``WIDE_LISTS`` fixed pairs of positions, the tally asks for ``WIDE_SHARED`` and the
verification for at most ``WIDE_BITS`` bits, and the nearest partner that each list
offers is verified on the shingle sets themselves.  Members of longer lists meet
those next to them in the order of their bytes, which differs from list to list.
This links large groups at little cost, but not every pair at 0.8 shares a list.

What it leaves apart meets in an exact way.  Shingles are put in one order for all
texts: those that stand first in more than ``FREQUENT`` texts come last, the others
by their hash.  Two sets of similarity 0.8 or more share a shingle of their first
fifths (``prefix``), so each group of texts with one set is listed under these.
What is in no list with another root and a size that allows the similarity is
done with.  The others take a small sketch of their set along, in which bits that
two sets do not agree on are a lower bound of what only one of them has
(``parities``): members of a list are told apart by these where they meet, and only
pairs that stay open leave it, not the pairs of all texts with a passage in common.
Larger sketches (``sketch``) rule out most of what is left, which go where the pair is
before any set does, and the sets verify the rest.  Lists longer than ``LONG_LIST`` are
dealt into blocks, every two of which meet.  So the groups are those of all links of
at least the similarity, and of no others.

Null texts count as empty.  Texts of fewer than ``SHINGLE`` words are one
shingle; texts without words have fingerprint zero and link like any other.
Rows with a null id get their fingerprint's component, null if nothing in it
has an id.  Repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, map_arrow
from .components import components
from .linededup import holding

SHINGLE = 4
MOST_BITS = 4
SEED = 42
LONG_LIST = 1_024
LEAST_SHARED = 8 - MOST_BITS

SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
WIDE_BITS, WIDE_SHARED, WIDE_LISTS = 54, 4, 48
#: Members of a long list of wide fingerprints that a member meets.
WIDE_WINDOW = 256
#: Shingles among the first ones of more sets than this go to the end of the order.
FREQUENT = 64

_TRIPLES = list(combinations(range(8), 3))
_PAIRS = [(a, b) for step in (1, 2, 3, 5, 7, 11) for a, b in zip(range(0, 32), [(a + step) % 32 for a in range(32)], strict=True)][::4][:WIDE_LISTS]
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_DEALT_BYTES = 256


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text given as UTF-8 bytes."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(line, SEED)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)  # big-endian
    if len(rows) < _DEALT_BYTES:
        ones = np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp bigint`` (the unsigned fingerprint as a signed long) of every row."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "fp"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, fp bigint")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: the list (which three positions and their bytes) and the fingerprint."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        rows = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8).astype(np.int64)
        lists = [rows[:, a] << 24 | rows[:, b] << 16 | rows[:, c] << 8 | n for n, (a, b, c) in enumerate(_TRIPLES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.tile(fps, len(_TRIPLES)))], names=["list", "fp"])


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared positional bytes of fingerprints given as 64-bit words (last axis: the words of one)."""
    apart = np.ascontiguousarray(a ^ b)
    return (apart.view(np.uint8).reshape(*apart.shape[:-1], 8 * apart.shape[-1]) == 0).sum(-1)


def _close(a: np.ndarray, b: np.ndarray, shared: int, bits: int) -> np.ndarray:
    """Which pairs pass the count filter and then the comparison of their bits."""
    out = tally(a, b) >= shared
    a, b = np.broadcast_arrays(a, b)
    out[out] = np.bitwise_count(a[out] ^ b[out]).sum(-1) <= bits
    return out


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one list's fingerprints: those that are connected with a smaller one, and the smallest such."""
    words = np.sort(members)[:, None].view(np.uint64)
    n = len(words)
    near = np.concatenate([_close(words[at : at + 128, None], words[None], LEAST_SHARED, MOST_BITS) for at in range(0, n, 128)])
    label = np.arange(n)
    while True:
        least = np.where(near, label, n).min(1)
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label < np.arange(n))
    return words[own, 0].view(np.int64), words[label[own], 0].view(np.int64)


def _lists(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """Per batch of entries sorted by list: both ends of lists of two, other lists up to ``longest``, parts of longer ones."""
    held_key, held, is_long = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), words_of(batch.column(1))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(bounds)
        inner = np.ones(len(sizes), bool)
        inner[[0, -1]] = False
        twos = bounds[:-1][inner & (sizes == 2)]
        lists, parts = [], []
        for g in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 2).tolist()}):
            key, members = int(keys[bounds[g]]), fps[bounds[g] : bounds[g + 1]]
            if key != held_key:
                if held is not None and not is_long and len(held) > 1:
                    lists.append(held)
                held_key, held, is_long = key, members[:0], False
            if is_long:
                parts.append((False, members))
                continue
            held = np.concatenate([held, members])
            if len(held) > longest:
                parts.append((True, held))
                held, is_long = held[:0], True
        yield fps[twos], fps[twos + 1], lists, parts
    if held is not None and not is_long and len(held) > 1:
        yield held[:0], held[:0], [held], []


def words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints (longs, or binaries of one length) as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return np.ascontiguousarray(column.to_numpy()).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _links(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by list: verified links ``(u, v)``, and ``(u, null)`` for each member of a long list."""
    for a, b, lists, parts in _lists(batches, longest):
        near = _close(a, b, LEAST_SHARED, MOST_BITS)
        linked = [(a[near, 0].view(np.int64), b[near, 0].view(np.int64)), *[forest(m[:, 0].view(np.int64)) for m in lists]]
        u, v = (np.concatenate(x) for x in zip(*linked, strict=True))
        hot = np.concatenate([np.empty(0, np.int64), *[m[:, 0].view(np.int64) for _, m in parts]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, hot])), pa.concat_arrays([pa.array(v), pa.nulls(len(hot), pa.int64())])], names=["u", "v"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << b for b in range(64)]
    flips = np.array([0, *one, *[a | b for a, b in combinations(one, 2)]], np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 256):
            some = fps[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["mid", "fp"])


def links(fps: DataFrame, longest: int = LONG_LIST) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``) whose components are exactly those of all links.

    Every pair within ``MOST_BITS`` bits is connected through a list that it shares, or,
    where all of these are long, through the smallest member at a midpoint.
    """
    found = cut(map_arrow(map_arrow(fps.select("fp"), _postings, "list bigint, fp bigint", None).repartition("list").sortWithinPartitions("list"), lambda rows: _links(rows, longest), "u bigint, v bigint", None))
    near = found.filter("v is not null").distinct()
    long_members = found.filter("v is null").select(F.col("u").alias("fp")).distinct()
    mids = map_arrow(long_members, _midpoints, "mid bigint, fp bigint", None)
    least = mids.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("mid", "v")
    through = mids.join(least, "mid").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return near.union(through)


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``fp, component_id``: the least id of each fingerprint's component, from ``fp, least`` and links ``u, v``.

    What meets by component or fingerprint is read back from tables, so that a
    large component's or class's partition can be split.
    """
    joined = cut(components(found).withColumnRenamed("node", "fp").join(classes, "fp"))
    smallest = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = joined.join(smallest, "root").select("fp", "component_id")
    return cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, longest: int = LONG_LIST) -> DataFrame:
    """``id_col, fingerprint string, component_id`` of every row; the id must be an integer."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    return prints.join(_labelled(classes, links(classes, longest)), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(data: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; none for a text without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size, n = min(shingle, len(words)), max(1, len(words) - shingle + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):  # odd factors and shifts: each word's place counts
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def prefix(members: np.ndarray, last: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Of a set (sorted hashes) the first in the common order, in which ``last`` (sorted) stand at the end: so many that similar sets share one of them."""
    n = len(members)
    if len(last):
        at = np.minimum(np.searchsorted(last, members), len(last) - 1)
        late = last[at] == members
        members = np.concatenate([members[~late], members[late]])
    return members[: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0]


def sketch(members: np.ndarray) -> np.ndarray:
    """Bits of a set of hashes, at least four for each, in a power of two of words: a bit is set if it is a member's last digits."""
    words = 1 << max(0, (4 * len(members) - 1).bit_length() - 6)
    bits = np.zeros(64 * words, np.uint8)
    bits[(members & np.uint64(64 * words - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_shared(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """No more than this can two sets of these sketches and sizes share: each bit that only one sketch has stands for a member that only it has."""

    def folded(own: Column, other: Column) -> Column:
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(own)

    def only(own: Column, other: Column) -> Column:
        return F.aggregate(F.zip_with(own, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda total, one: total + one)

    left, right = folded(a, b), folded(b, a)
    return F.least(na - only(left, right), nb - only(right, left))


def parities(members: np.ndarray) -> bytes:
    """Bits of a set of hashes, in a power of two of words: whether the members with these last digits are odd in number.

    Each bit that two sets do not agree on stands for a member that only one of them has.  About a bit a member is enough
    to tell unlike sets apart, half a bit where there are many.
    """
    n = len(members)
    bits = 64 << max(1, ((n if n <= 1_024 else n // 2 + 1) - 1).bit_length() - 6)
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


#: Pairs, and words of their bits, that are looked at in one go.
_PAIRS_AT_ONCE, _WORDS_AT_ONCE = 1 << 18, 1 << 21


class _Members:
    """Members of blocks of lists, sorted by these, as columns."""

    def __init__(self, rows: pa.Table) -> None:
        self.token, self.x, self.y, self.block, self.key, self.root, self.n = (rows.column(c).to_numpy() for c in ("token", "x", "y", "block", "key", "root", "n"))
        bits = rows.column("bits").to_pylist()
        self.words = np.frombuffer(b"".join(bits), np.uint64)
        self.width = np.fromiter((len(b) // 8 for b in bits), np.int64, len(bits))
        self.at = np.cumsum(self.width) - self.width

    def bounds(self) -> np.ndarray:
        new = (np.diff(self.token) != 0) | (np.diff(self.x) != 0) | (np.diff(self.y) != 0)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(self.token)]])

    def unlike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that members ``a`` and ``b`` do not agree on; of two widths the larger is folded."""
        out = np.empty(len(a), np.int64)
        turned = self.width[a] > self.width[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        kinds = self.width[a] << 32 | self.width[b]
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            narrow, wide = kind >> 32, kind & 0xFFFFFFFF
            step = max(1, _WORDS_AT_ONCE // wide)
            for some in (own[k : k + step] for k in range(0, len(own), step)):
                left = self.words[self.at[a[some], None] + np.arange(narrow)]
                right = self.words[self.at[b[some], None] + np.arange(wide)]
                while right.shape[1] > narrow:
                    right = right[:, : right.shape[1] // 2] ^ right[:, right.shape[1] // 2 :]
                out[some] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
        return out

    def pairs(self, bounds: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
        """Keys of the pairs of one list and other roots that sizes and bits leave open."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        later = ends - np.arange(bounds[0], bounds[-1]) - 1
        total = np.cumsum(later)
        start = 0
        while start < len(later):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS_AT_ONCE, "right")))
            counts = later[start:stop]
            a = np.repeat(np.arange(start, stop), counts) + bounds[0]
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = stop
            na, nb = self.n[a], self.n[b]
            fits = (self.root[a] != self.root[b]) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & ((self.x[a] == self.y[a]) | (self.block[a] != self.block[b]))
            a, b = a[fits], b[fits]
            # so similar sets have no more members that only one of them has
            near = self.unlike(a, b) <= (1 - similarity) / (1 + similarity) * (self.n[a] + self.n[b]) + 1e-9
            a, b = self.key[a[near]], self.key[b[near]]
            if len(a):
                yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def _open_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Over members sorted by list and blocks: the pairs ``u, v`` that may be so similar."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
        members = _Members(rows.combine_chunks())
        bounds = members.bounds()
        last = rows.slice(bounds[-2])
        if len(bounds) > 2:
            for pairs in members.pairs(bounds[:-1], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])
    if last is not None:
        members = _Members(last.combine_chunks())
        for pairs in members.pairs(members.bounds(), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def shared_entries(entries: DataFrame, longest: int = LONG_LIST, similarity: float = SIMILARITY) -> DataFrame:
    """``token, key, root, n, blocks``: entries that meet another size which allows the similarity, in lists that more than one root is in, and into how many blocks a list is dealt."""
    of_list = Window.partitionBy("token")
    by_size = of_list.orderBy("n")
    # in the order of sizes the next ones are the likest
    near = (F.lag("n").over(by_size) >= similarity * F.col("n") - 1e-9) | (F.col("n") >= similarity * F.lead("n").over(by_size) - 1e-9)
    met = entries.select("token", "key", "root", "n", near.alias("_near")).filter("_near")
    told = met.select("token", "key", "root", "n", F.min("root").over(of_list).alias("_least"), F.max("root").over(of_list).alias("_most"), F.count("*").over(of_list).alias("_c"))
    return told.filter(F.col("_least") < F.col("_most")).select("token", "key", "root", "n", F.ceil(F.col("_c") / longest).cast("long").alias("blocks"))


def candidates(shared: DataFrame, bits: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``u, v``: the keys of ``token, key, root, n, blocks`` that may be so similar and have different roots; ``bits`` holds the parities by key.

    Pairs are told apart where a list, or two blocks of a long one, meet; only those that stay open leave it.
    """
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = shared.join(bits, "key").withColumn("block", block).withColumn("other", other)
    met = dealt.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key", "root", "n", "bits")
    listed = met.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return map_arrow(listed, lambda rows: _open_pairs(rows, similarity), "u bigint, v bigint", None).distinct()


def wide_print(hashes: np.ndarray) -> bytes:
    """256 bits: each set if it is set in over half of the shingles' mixed hashes."""
    if not len(hashes):
        return bytes(32)
    mixed = np.empty((len(hashes), 4), np.uint64)
    for k in range(4):
        x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[:, k] = x ^ (x >> np.uint64(32))
    rows = mixed.view(np.uint8).reshape(-1, 32)
    if len(rows) < _DEALT_BYTES:
        ones = np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(32)])
    return np.packbits(ones * 2 > len(rows)).tobytes()


def _wide_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of wide fingerprints; the bytes are turned so that each list has an order of its own."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 32)
        for n, (a, b) in enumerate(_PAIRS):
            keys = rows[:, a].astype(np.int64) << 24 | rows[:, b].astype(np.int64) << 16 | n
            turned = np.ascontiguousarray(np.roll(rows, -a - 1, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in turned], pa.binary())], names=["list", "fp"])


def _nearest(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Over wide entries sorted by list and bytes: each member with its nearest partner in the list, if that is close enough."""

    def partners(members: np.ndarray, new: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the members from ``new`` on, against all of them."""
        out = []
        for at in range(new, len(members), 64):
            own = members[at : at + 64]
            near = _close(own[:, None], members[None], WIDE_SHARED, WIDE_BITS)
            near[np.arange(len(own)), np.arange(at, at + len(own))] = False
            some = np.flatnonzero(near.any(1))
            apart = np.where(near[some], np.bitwise_count(own[some, None] ^ members[None]).sum(-1, dtype=np.int64), 999)
            out.append((own[some], members[apart.argmin(1)]))
        return out

    def names(words: np.ndarray, key: int) -> np.ndarray:
        return np.roll(words.view(np.uint8).reshape(-1, 32), _PAIRS[key][0] + 1, axis=1)

    held_key, held = None, np.empty((0, 4), np.uint64)
    for batch in batches:
        u, v = [np.empty((0, 32), np.uint8)], [np.empty((0, 32), np.uint8)]
        if batch.num_rows:
            keys, fps = batch.column(0).to_numpy(), words_of(batch.column(1))
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(bounds)
            inner = np.ones(len(sizes), bool)
            inner[[0, -1]] = False
            twos = bounds[:-1][inner & (sizes == 2)]
            a, b = fps[twos], fps[twos + 1]
            near = _close(a, b, WIDE_SHARED, WIDE_BITS)
            for n in np.unique(keys[twos] & 255).tolist():
                mine = near & (keys[twos] & 255 == n)
                u.append(names(a[mine], n)), v.append(names(b[mine], n))
            for g in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 2).tolist()}):
                key = int(keys[bounds[g]])
                if key != held_key:
                    held_key, held = key, held[:0]
                for at in range(bounds[g], bounds[g + 1], longest):  # what came before in the list is met as far as the window reaches
                    some = fps[at : min(at + longest, bounds[g + 1])]
                    together = np.concatenate([held, some])
                    for x, y in partners(together, len(held)):
                        u.append(names(x, key & 255)), v.append(names(y, key & 255))
                    held = together[-WIDE_WINDOW:]
        left, right = ([x.tobytes() for x in np.concatenate(side)] for side in (u, v))
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in zip(left, right, strict=True)], pa.binary()), pa.array([max(p) for p in zip(left, right, strict=True)], pa.binary())], names=["u", "v"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, longest: int = LONG_LIST) -> DataFrame:
    """``id_col, component_id``: the least id of those that links of at least ``similarity`` lead to, for rows with an id (an integer).

    Texts with the same shingles count as copies; texts without words are copies of one another.
    """
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text"))

    def set_of(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The set's key, its members and the shingles with repeats."""
        hashes = shingle_hashes(text, shingle)
        members = np.unique(hashes)
        return xxhash.xxh3_64_intdigest(members.tobytes()), members, hashes

    def keys(found: list[tuple]) -> pa.Array:
        return pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64))

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, wide_print(hashes)) for key, _, hashes in map(set_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), keys(found), pa.array([f[1] for f in found], pa.binary())], names=["doc", "key", "wide"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([keys(found), pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64()))], names=["key", "shingles"])

    def sketches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([keys(found), pa.array([len(f[1]) for f in found], pa.int32()), pa.array([sketch(f[1]) for f in found], pa.list_(pa.int64()))], names=["key", "n", "bits"])

    def parities_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([keys(found), pa.array([parities(f[1]) for f in found], pa.binary())], names=["key", "bits"])

    def prefixes_of(last: np.ndarray):
        shared = docs.sparkSession.sparkContext.broadcast(last)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [set_of(t) for t in batch.column(1).to_pylist()]
                firsts = pa.array([prefix(f[1], shared.value, similarity).view(np.int64) for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([keys(found), pa.array([len(f[1]) for f in found], pa.int32()), firsts], names=["key", "n", "firsts"])

        return work

    def texts_of(wanted: DataFrame) -> DataFrame:
        return holding(own, cut(wanted)).select("doc", bytes_of("_text").alias("_text"))

    def of_keys(wanted: DataFrame, work: Callable, row: str) -> DataFrame:
        """What ``work`` makes of the texts of these classes, once for each."""
        made = map_arrow(texts_of(wanted.distinct().join(classes, "key").select(F.col("least").alias("doc"))), work, row)
        return cut(made.groupBy("key").agg(*[F.first(n).alias(n) for n in made.columns if n != "key"]))

    def of_pairs(pairs: DataFrame, work: Callable, row: str) -> DataFrame:
        return of_keys(pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))), work, row)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave the similarity open; a sketch has at most an eighth of a set's bytes, and few pairs stay."""
        made = of_pairs(pairs, sketches_of, "key bigint, n int, bits array<bigint>")
        both = pairs.join(made.select(F.col("key").alias("u"), F.col("n").alias("na"), F.col("bits").alias("a")), "u").join(made.select(F.col("key").alias("v"), F.col("n").alias("nb"), F.col("bits").alias("b")), "v")
        most = most_shared(F.col("a"), F.col("b"), F.col("na"), F.col("nb"))
        return cut(both.filter(most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9).select("u", "v"))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = of_pairs(pairs, sets_of, "key bigint, shingles array<bigint>")
        both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))  # the sets stay in the JVM: a batch of pairs of them would be large
        return cut(both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v"))

    prints = cut(map_arrow(own.select("doc", bytes_of("_text").alias("_text")), prints_of, "doc bigint, key bigint, wide binary"))
    classes = cut(prints.groupBy("key").agg(F.min("doc").alias("least"), F.min("wide").alias("wide")))
    # by fingerprints: sets with one print are linked with the least of them, and these with the nearest in each list
    of_print = classes.groupBy("wide").agg(F.min("key").alias("first"))
    listed = map_arrow(of_print.select(F.col("wide").alias("fp")), _wide_postings, "list bigint, fp binary").repartition("list").sortWithinPartitions("list", "fp")
    near = map_arrow(listed, lambda rows: _nearest(rows, longest), "u binary, v binary", None).distinct()
    first = lambda n: of_print.select(F.col("wide").alias(n), F.col("first").alias(f"{n}_key"))
    met = near.join(first("u"), "u").join(first("v"), "v").select(F.col("u_key").alias("u"), F.col("v_key").alias("v"))
    same = classes.join(of_print, "wide").filter(F.col("key") != F.col("first")).select(F.col("first").alias("u"), F.col("key").alias("v"))
    sure = verified(cut(met.union(same)))
    # by first shingles: what may be similar and is not yet connected
    roots = cut(components(sure))
    texts = texts_of(classes.select(F.col("least").alias("doc")))
    row = "key bigint, n int, firsts array<bigint>"
    none = np.empty(0, np.uint64)
    often = map_arrow(texts, prefixes_of(none), row).select(F.explode("firsts").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT).toArrow()  # one for each FREQUENT entries at most
    last = np.sort(often.column("token").to_numpy().astype(np.int64).view(np.uint64))
    rooted = map_arrow(texts, prefixes_of(last), row).join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    entries = rooted.select("key", F.coalesce("root", "key").alias("root"), "n", F.explode("firsts").alias("token"))
    shared = cut(shared_entries(entries, longest, similarity))
    open_ = cut(candidates(shared, of_keys(shared.select("key"), parities_of, "key bigint, bits binary"), similarity))
    links_ = sure.union(verified(possible(open_)))
    return prints.join(_labelled(classes.select(F.col("key").alias("fp"), "least"), links_), prints["key"] == F.col("fp")).select(F.col("doc").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group of near copies has a smaller id; rows with a null id stay."""
    gone = similar_groups(docs, id_col, text_col).filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
