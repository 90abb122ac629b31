"""Operator 9: maximum-inner-product search with score-aware 4-bit codes.

Nearness is the cosine in double precision, i.e. the inner product of unit
vectors.  A product quantiser splits the dimensions into blocks of
``BLOCK`` and codes each with one of 16 centroids.  Centroids are fitted with
the anisotropic loss: the residual's part parallel to the vector costs
``PARALLEL`` times its other part, because it is what changes large inner
products.  Assignment is by coordinate descent over blocks, the centroids then
solve the weighted least-squares problem exactly; both alternate on a bounded
sample (the ``SAMPLE`` vectors with the smallest id hash).  Every vector is
coded and scanned.

Search: vectors are coded once, and their codes packed with them into rows of up to
``CODES_PER_BLOCK`` and dealt into groups.  Groups of queries meet groups of codes:
16-entry tables per query and code block give approximate scores by lookups over
the packed 4-bit codes.  Of a group the ``RERANK`` best of each query get their
exact measure, and the k-th of these is a bar.  A code's score is off by at most
the length of what the code leaves of its unit vector, which is kept beside it:
every vector whose score and this length together reach the bar is measured as
well.  So no vector that is among the k nearest is missed, whatever the rows are
like; where codes tell little, as in tight clusters, more vectors are measured.
The k best of each group leave the task with their exact measure and are ranked.
The query set is a fixed share of the rows, so comparisons grow with their
product; what is shuffled is each vector with its code once for every group of
queries, and each query once for every group of codes.
Nothing that grows with the data is collected or broadcast.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id.  Rows that
repeat an id are rows of their own, as queries and as candidates.  Ties go to
the smaller id; of equal vectors only the k + 1 with the smallest ids are
candidates, as the others can't be among the k.  Fewer candidates than k: all
are returned; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 1
CENTROIDS = 16
PARALLEL = 4.0
SAMPLE = 10_000
ROUNDS = 6
RERANK = 96
#: Codes in a packed row, and in a group that a task scans (of 64 dimensions; of longer vectors fewer).
CODES_PER_BLOCK = 1_024
CODES_PER_GROUP = 65_536
#: Groups of codes are made smaller, down to ``LEAST_CODES``, until there are so many: few rows still make several tasks.
GROUPS, LEAST_CODES = 24, 2_048
#: Queries in a group: all of them within these bounds.
QUERIES_PER_GROUP = (64, 16_384)
#: Queries that are scanned together, and how far sums of products in another order may lie apart.
TOGETHER = 16
ROUNDING = 1e-9


class Codebook:
    """Centroids (blocks x 16 x BLOCK) of an anisotropic product quantiser."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    @staticmethod
    def fit(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Codebook:
        rng = np.random.RandomState(seed)
        n, dims = sample.shape
        blocks = -(-dims // BLOCK)
        padded = np.zeros((n, blocks * BLOCK))
        padded[:, :dims] = sample
        parts = padded.reshape(n, blocks, BLOCK)
        centroids = np.empty((blocks, CENTROIDS, BLOCK))
        for b in range(blocks):
            centroids[b] = parts[rng.choice(n, CENTROIDS, replace=n < CENTROIDS), b]
        book = Codebook(centroids)
        codes = book._nearest(parts)
        for _ in range(rounds):
            book._solve(parts, codes)
            codes = book._descend(parts, codes)
        return book

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        codes = np.empty(parts.shape[:2], np.uint8)
        for b in range(parts.shape[1]):
            codes[:, b] = ((parts[:, b, None] - self.centroids[b]) ** 2).sum(-1).argmin(1)
        return codes

    def _descend(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """One sweep over blocks: each takes the centroid with the least |r|^2 + (PARALLEL - 1) (r . x)^2."""
        codes = codes.copy()
        rest = sum(((parts[:, b] - self.centroids[b][codes[:, b]]) * parts[:, b]).sum(1) for b in range(parts.shape[1]))
        for b in range(parts.shape[1]):
            off = parts[:, b, None] - self.centroids[b]
            along = (off * parts[:, b, None]).sum(-1)
            rows = np.arange(len(parts))
            other = rest - along[rows, codes[:, b]]
            loss = (off**2).sum(-1) + (PARALLEL - 1) * (other[:, None] + along) ** 2
            codes[:, b] = loss.argmin(1)
            rest = other + along[rows, codes[:, b]]
        return codes

    def _solve(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Centroids of one block at a time that minimise the anisotropic loss with the others held."""
        rest = sum(((parts[:, b] - self.centroids[b][codes[:, b]]) * parts[:, b]).sum(1) for b in range(parts.shape[1]))
        for b in range(parts.shape[1]):
            own = parts[:, b]
            along = ((own - self.centroids[b][codes[:, b]]) * own).sum(1)
            other = rest - along
            for c in range(CENTROIDS):
                x = own[codes[:, b] == c]
                if len(x):
                    left = len(x) * np.eye(BLOCK) + (PARALLEL - 1) * x.T @ x
                    right = x.sum(0) + (PARALLEL - 1) * x.T @ ((x**2).sum(1) + other[codes[:, b] == c])
                    self.centroids[b, c] = np.linalg.solve(left, right)
            rest = other + ((own - self.centroids[b][codes[:, b]]) * own).sum(1)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """4-bit codes, two to a byte (blocks padded to an even number)."""
        blocks = len(self.centroids)
        padded = np.zeros((len(vectors), blocks * BLOCK))
        padded[:, : vectors.shape[1]] = vectors
        parts = padded.reshape(len(vectors), blocks, BLOCK)
        codes = self._descend(parts, self._nearest(parts))
        if blocks % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries x vectors) by table lookups over the packed codes."""
        blocks = len(self.centroids)
        padded = np.zeros((len(queries), blocks * BLOCK))
        padded[:, : queries.shape[1]] = queries
        tables = np.einsum("qbd,bcd->bqc", padded.reshape(len(queries), blocks, BLOCK), self.centroids).astype(np.float32)
        scores = np.zeros((len(queries), len(packed)), np.float32)
        for byte in range(packed.shape[1]):  # the tables of a byte's two codes as one
            both = tables[2 * byte]
            if 2 * byte + 1 < blocks:
                both = (tables[2 * byte + 1][:, :, None] + both[:, None]).reshape(len(queries), -1)
            scores += np.take(both, packed[:, byte], axis=1)
        return scores

    def off(self, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """How far ``scan`` may be from the inner product of each vector with any unit vector."""
        blocks = len(self.centroids)
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :blocks]
        meant = self.centroids[np.arange(blocks), codes].reshape(len(packed), -1)
        meant[:, : vectors.shape[1]] -= vectors
        left = np.sqrt((meant * meant).sum(1))
        return (left * 1.000_001 + 3e-7 * (blocks * BLOCK + 8) * (1 + left)).astype(np.float32)  # and float32 rounding of the tables and their sums


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def exact_cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; one query may stand for all rows."""
    queries, vectors = _scaled(queries), _scaled(vectors)
    return (vectors * queries).sum(1) / (np.sqrt((queries * queries).sum(-1)) * np.sqrt((vectors * vectors).sum(1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: the rows that take part."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def coded(rows: DataFrame, book: Codebook, dims: int) -> DataFrame:
    """``block, rs, ids, codes, off, vs``: packed blocks of row numbers, ids, codes, what these may be off and the vectors of ``r, id, v``."""
    shared = rows.sparkSession.sparkContext.broadcast(book)
    kind = _kind(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def pack(parts: list) -> pa.RecordBatch:
            joined = [np.concatenate(x).tobytes() for x in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in joined]], names=["block", *PACKED])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CODES_PER_BLOCK // 4)):
                some = batch.slice(at, max(1, CODES_PER_BLOCK // 4))
                vs = _matrix(some.column(2), dims)
                units = _unit(vs)
                codes = shared.value.encode(units)
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), codes, shared.value.off(units, codes), vs.astype(kind)))
                n += some.num_rows
                if n > CODES_PER_BLOCK - CODES_PER_BLOCK // 4:
                    yield pack(held)
                    held, n, block = [], 0, block + 1
        if n:
            yield pack(held)

    return rows.select("r", "id", "v").mapInArrow(work, "block long, " + ", ".join(f"{n} binary" for n in PACKED))


PACKED = ("rs", "ids", "codes", "off", "vs")


def _kind(rows: DataFrame) -> type:
    """The type that holds the components of ``v`` as they are."""
    return np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64


def nearest(book: Codebook, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rs: np.ndarray, ids: np.ndarray, codes: np.ndarray, off: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of queries and of their k nearest vectors, and the exact measure; rows with a query's number are left out."""
    asked, units = _unit(queries), _unit(vectors)
    for at in range(0, len(own), TOGETHER):
        q = asked[at : at + TOGETHER]
        scores = book.scan(q, codes)
        scores[own[at : at + TOGETHER, None] == rs] = -np.inf
        if len(rs) > rerank:
            first = np.argpartition(-scores, rerank - 1, axis=1)[:, :rerank]
            measured = np.einsum("qd,qnd->qn", q, units[first])
            measured[~np.isfinite(np.take_along_axis(scores, first, 1))] = -np.inf
            bar = -np.partition(-measured, k - 1, axis=1)[:, k - 1] - ROUNDING
            open_ = scores + off >= bar[:, None].astype(np.float32) - np.float32(1e-6)
            open_ &= np.isfinite(scores)
        else:
            open_ = np.isfinite(scores)
        some = np.flatnonzero(open_.any(0))
        if not len(some):
            continue
        found = np.where(open_[:, some], q @ units[some].T, -np.inf)
        if len(some) > k:
            found[found < -np.partition(-found, k - 1, axis=1)[:, k - 1 : k] - ROUNDING] = -np.inf
        a, b = np.nonzero(np.isfinite(found))
        b = some[b]
        score = np.concatenate([exact_cosine(queries[at + a[n : n + 65_536]], vectors[b[n : n + 65_536]]) for n in range(0, len(a), 65_536)])
        order = np.lexsort((rs[b], ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < k
        yield at + a[kept], b[kept], score[kept]


def _nearest_codes(book: Codebook, k: int, rerank: int, dims: int, kind: type):
    """Cogrouped function: a block of queries meets some blocks of codes; of each query the k nearest leave."""

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        out = {"q": [], "query_id": [], "r": [], "vec_id": [], "score": []}
        if q.num_rows and c.num_rows:
            own, names = q.column("r").to_numpy(), q.column("id").to_numpy()
            queries = np.concatenate([_matrix(x, dims) for x in q.column("v").chunks])
            types = (np.int64, np.int64, np.uint8, np.float32, kind)
            rs, ids, codes, off, vs = (np.frombuffer(b"".join(c.column(n).to_pylist()), t) for n, t in zip(PACKED, types, strict=True))
            vectors = vs.astype(np.float64).reshape(len(rs), dims)
            for a, b, score in nearest(book, queries, own, vectors, rs, ids, codes.reshape(len(rs), -1), off, k, rerank):
                for n, x in zip(out, (own[a], names[a], rs[b], ids[b], score), strict=True):
                    out[n].append(x)
        return pa.table({n: np.concatenate([np.empty(0, np.float64 if n == "score" else np.int64), *x]) for n, x in out.items()})

    return meet


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row for which ``is_query(id column)`` holds, itself left out."""
    every = usable(vectors, id_col, vector_col)
    sizes = every.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes[0]["dims"]
    every = cut(every.filter(F.size("v") == dims).withColumn("r", F.monotonically_increasing_id()))  # written once: a row keeps its number
    sample = every.orderBy(F.xxhash64(F.lit("sample"), "id"), "id", "r").limit(SAMPLE).select("v").toPandas()
    book = Codebook.fit(_unit(np.array(sample["v"].tolist(), np.float64)))
    queries = every.filter(is_query(F.col("id")))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id", "r"))
    codes = cut(coded(every.withColumn("copy", copy).filter(F.col("copy") <= k + 1), book, dims))
    asked, total = queries.count(), int(codes.agg(F.coalesce(F.sum(F.octet_length("rs")), F.lit(0))).head()[0]) // 8
    per_query = min(max(asked, QUERIES_PER_GROUP[0]), QUERIES_PER_GROUP[1])
    per_code = min(CODES_PER_GROUP, max(1, CODES_PER_GROUP * 64 // dims), max(LEAST_CODES, total // GROUPS))
    q_groups, v_groups = max(1, -(-asked // per_query)), max(1, -(-total // per_code))

    # each group of queries meets each group of codes once: rows carry both numbers
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("r", "id", "v", F.pmod(F.xxhash64("r"), F.lit(q_groups)).cast("int").alias("qb"), numbers(v_groups).alias("vb"))
    right = codes.select(*PACKED, F.pmod(F.xxhash64("block"), F.lit(v_groups)).cast("int").alias("vb"), numbers(q_groups).alias("qb"))
    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_nearest_codes(book, k, max(rerank, k), dims, _kind(every)), "q long, query_id long, r long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "r"))
    return met.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def exact_search_sql(modulus: int, k: int) -> str:
    """Brute force over the same rows, for comparison."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT * FROM v WHERE vec_id % {modulus} = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
