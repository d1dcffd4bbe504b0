"""Vector search: exact top-k in blocks, thresholds, random-plane signatures with probes, index differences."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.rules import given
from engramlake.operators import ids as of_ids

#: Queries that a task holds at a time, numbers in a block of the base where both are dealt into blocks, and the scores of a tile: queries by vectors.
BLOCK, BASE_BLOCK, TILE = 4096, 1 << 22, (256, 8192)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """A vector of length 1; zero and non-finite vectors stop the query."""
    ok = lambda norm: norm.isNotNull() & (norm > 0) & (norm < float("inf"))
    return given(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(ok(norm), x / norm).otherwise(F.raise_error(F.lit("a vector has no direction")))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(q_ids: np.ndarray, q: np.ndarray, q_of: np.ndarray, ids: np.ndarray, x: np.ndarray, x_of: np.ndarray, k: int, least: float, digits: int, planes: Planes | None = None, radius: int = 0, known: np.ndarray | None = None) -> pa.RecordBatch:
    """The k best rows of ``x`` with its owner for each query; ties go to the smaller id. With ``planes``, only rows in a bucket within ``radius`` of the query's.

    Scores are made a TILE at a time, and of later tiles only those are looked at that reach a query's k-th best so far.
    ``known``: what each query's k-th best scores already; what is below it may be left out.
    """
    alike, out = q_ids.dtype.kind == ids.dtype.kind, []
    code = np.unique(np.concatenate([q_ids, ids]) if alike else ids, return_inverse=True)[1]  # ids as numbers of the same order
    q_code, x_code = (code[: len(q_ids)], code[len(q_ids) :]) if alike else (np.full(len(q_ids), -1), code)
    owned = len(x_of) and ((x_of != x_of[0]).any() or (q_of != x_of[0]).any())
    q_sig, x_sig = (planes.signatures(v)[0] if planes else None for v in (q, x))
    for lo in range(0, len(q_ids), TILE[0]):
        mine = slice(lo, lo + TILE[0])
        n = len(q_ids[mine])
        edge = np.full(n, -np.inf) if known is None else known[mine].copy()
        row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        near = planes.within(q_sig[mine], radius) if planes else None
        for at in range(0, len(ids), TILE[1]):
            part = slice(at, at + TILE[1])
            s = q[mine] @ x[part].T
            s[q_code[mine, None] == x_code[None, part]] = -np.inf
            if owned:
                s[q_of[mine, None] != x_of[None, part]] = -np.inf
            if planes:
                s[~planes.shared(near, x_sig[part], n)] = -np.inf
            if s.shape[1] > k and np.isinf(edge).any():
                edge = np.maximum(edge, np.partition(s, -k, axis=1)[:, -k])
            r, c = np.nonzero(s >= (np.maximum(edge, max(least, -1e300)) - 10.0**-digits)[:, None])  # and what rounds up to that
            row, col, score = np.concatenate([row, r]), np.concatenate([col, c + at]), np.concatenate([score, np.round(s[r, c], digits)])
            order = np.lexsort((x_code[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, np.arange(n))
            keep = (np.arange(len(row)) - first[row] < k) & (score >= least)
            row, col, score = row[keep], col[keep], score[keep]
            full = np.bincount(row, minlength=n) == k
            edge[full] = np.maximum(edge[full], score[np.searchsorted(row, np.flatnonzero(full), "right") - 1])
        out.append((q_ids[mine][row], ids[col], score))
    cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(q_ids.dtype)), pa.array(cols[1].astype(ids.dtype)), pa.array(cols[2].astype(np.float64))], ["query_id", "id", "score"])


def top_k(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, block: int = BLOCK, digits: int = 6, planes: Planes | None = None, radius: int = 0) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, vector) the k best of ``base`` (id, vector), itself excluded.

    Up to ``block`` queries are sent to the tasks, and the base is read once where it lies. More of
    them are dealt into blocks, and so is the base: each pair of blocks meets in one task, which
    keeps k rows for a query. Either way a shuffle sees at most k rows for a query and block. Where both
    have an ``owner``, only rows of the query's owner count; with ``planes``, only rows in a bucket within ``radius``.
    """
    spark, q_kind, kind = base.sparkSession, of_ids.kind(queries, "query_id"), of_ids.kind(base)
    schema = f"query_id {q_kind}, id {kind}, score double"
    both = "owner" in queries.columns and "owner" in base.columns
    owner = (F.xxhash64("owner") if both else F.lit(0).cast("bigint")).alias("owner")
    q = queries.select(F.col("query_id").cast(q_kind).alias("query_id"), "vector", owner)
    x = base.select(F.col("id").cast(kind).alias("id"), "vector", owner)
    n, width = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n <= block:
        rows = q.toArrow()
        sent = spark.sparkContext.broadcast((of_ids.array(rows.column("query_id"), q_kind), _matrix(rows.column("vector").combine_chunks()), np.array(rows.column("owner").to_pylist(), np.int64)))

        def run(batches):
            for b in batches:
                if b.num_rows and len(sent.value[0]):
                    yield _nearest(*sent.value, of_ids.array(b.column("id"), kind), _matrix(b.column("vector")), b.column("owner").to_numpy(zero_copy_only=False), k, least, digits, planes, radius)

        found = x.mapInArrow(run, schema)
    else:
        q_blocks, x_blocks = -(-n // block), -(-base.count() // max(1024, BASE_BLOCK // max(1, width)))
        dealt = lambda df, c, of, other: df.withColumns({of[0]: F.pmod(F.xxhash64(c), F.lit(of[1])).cast("int"), other[0]: F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)))})
        left = dealt(q, "query_id", ("qb", q_blocks), ("xb", x_blocks)).groupBy("qb", "xb")
        right = dealt(x, "id", ("xb", x_blocks), ("qb", q_blocks)).groupBy("qb", "xb")

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            both = [(of_ids.array(t.column(c), k), _matrix(t.column("vector").combine_chunks()), t.column("owner").to_numpy()) for t, c, k in ((a, "query_id", q_kind), (b, "id", kind))]
            if not len(both[0][0]) or not len(both[1][0]):
                return pa.Table.from_batches([], pa.schema([("query_id", of_ids.arrow(q_kind)), ("id", of_ids.arrow(kind)), ("score", pa.float64())]))
            return pa.Table.from_batches([_nearest(*both[0], *both[1], k, least, digits, planes, radius)])

        found = left.cogroup(right).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Planes:
    """Random hyperplanes of a fixed seed: ``tables`` signatures of ``bits`` signs each."""

    def __init__(self, dimension: int, tables: int = 8, bits: int = 10, seed: int = 1729):
        p = np.random.default_rng(seed).normal(size=(tables * bits, dimension))
        self.planes, self.tables, self.bits = p / np.linalg.norm(p, axis=1, keepdims=True), tables, bits

    def signatures(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signature and margins of each vector and table; a projection of zero counts as positive."""
        m = (x @ self.planes.T).reshape(len(x), self.tables, self.bits)
        return ((m >= 0) << np.arange(self.bits)).sum(2), m

    def probes(self, signature: np.ndarray, margin: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """(table, bucket), nearest first: signatures with up to ``radius`` of the least certain signs turned."""
        out = []
        for t in range(self.tables):
            for r in range(radius + 1):
                for flips in itertools.combinations(range(self.bits), r):
                    bucket = int(signature[t]) ^ sum(1 << b for b in flips)
                    out.append((r, float(sum(abs(margin[t, b]) for b in flips)), t, bucket))
        return [(t, b) for _, _, t, b in sorted(out)]

    def within(self, signatures: np.ndarray, radius: int) -> np.ndarray:
        """For each table and bucket, as bits, which of some signatures probe it: those with up to ``radius`` other signs."""
        apart = np.bitwise_count(np.arange(1 << self.bits)[None, :, None] ^ signatures.T[:, None, :])
        return np.packbits(apart <= radius, axis=2)

    def shared(self, near: np.ndarray, signatures: np.ndarray, n: int) -> np.ndarray:
        """Which of the ``n`` queries of ``near`` probe a bucket of which vectors: queries by vectors."""
        hit = near[0][signatures[:, 0]]
        for t in range(1, self.tables):
            hit |= near[t][signatures[:, t]]
        return np.unpackbits(hit, axis=1, count=n).view(bool).T


def buckets(base: DataFrame, planes: Planes) -> DataFrame:
    """(id, table_id, bucket): the signature table of ``base`` (id, vector)."""

    kind = of_ids.kind(base)

    def run(batches):
        for b in batches:
            s, _ = planes.signatures(_matrix(b.column("vector")))
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of_ids.array(b.column("id"), kind), planes.tables)), pa.array(np.tile(np.arange(planes.tables, dtype=np.int32), n)), pa.array(s.ravel().astype(np.int32))], ["id", "table_id", "bucket"])

    return base.select(F.col("id").cast(kind).alias("id"), "vector").mapInArrow(run, f"id {kind}, table_id int, bucket int")


def lsh_top_k(queries: DataFrame, base: DataFrame, k: int, planes: Planes, radius: int = 1) -> DataFrame:
    """As top_k, but only over vectors that share a probed bucket with the query.

    Vectors far from each other share buckets so often that pairs of ids grow with the square of the table. So
    buckets are looked up in the tasks where blocks meet, and a shuffle sees k rows for a query and block.
    """
    return top_k(queries, base, k, planes=planes, radius=radius)


def index_difference(wanted: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert, update or delete for each entry that is not as it should be."""
    a = wanted.select(key, F.col(digest).alias("_new"))
    b = existing.select(key, F.col(digest).alias("_old"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_new") != F.col("_old"), "update")
    return a.join(b, key, "full_outer").select(key, action.alias("action")).filter("action is not null")
