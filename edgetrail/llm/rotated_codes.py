"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is rotated by a fixed random orthogonal matrix; its code holds the signs of the rotated coordinates, packed
into bits, and two correction scalars: its length, and the inner product of its unit vector with the code's unit
vector. For a query q and a vector v with code x,  <q, v> is about  |v| * <Rq, x> / <Rv/|v|, x>, and the error is at
most  |v| * |q| * sqrt((1 - c * c) / (c * c)) * EPSILON / sqrt(d - 1)  with high probability (c is the second scalar). Every vector
whose upper bound reaches the k-th best lower bound is reranked by its exact inner product in double precision.

Equal vectors are indexed once, with their least ids, so a vector that a third of all rows share costs one code. The
codes are dealt to tasks by a hash; queries come in blocks of bounded size, and each block scans all codes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, rows_of, written

EPSILON = 4.0
SEED = 17
BLOCK_BYTES = 16 << 20
CHUNK = 4096
_CODES = pa.schema(
    [("cls", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("bits", pa.binary()), ("length", pa.float64()), ("agreement", pa.float64())]
)
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and unit vectors; scaled first, so that squares neither overflow nor vanish."""
    peak = np.abs(vectors).max(axis=1)
    scaled = vectors / peak[:, None]
    length = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return peak * length, scaled / length[:, None]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of unit vectors with their codes' unit vectors."""
    d = vectors.shape[1]
    length, unit = units(vectors)
    turned = unit @ rotation(d).T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / math.sqrt(d)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += query[j] * vectors[:, j]
    return total


def index(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector (vec_id, embedding): its code, its scalars and its k + 1 least ids.

    Vectors that are null, empty, zero or hold null or non-finite components are left out, and so are null ids;
    repeated rows with equal id and vector count once.
    """
    whole = F.col("embedding")
    good = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(whole, lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & whole.isNotNull() & F.coalesce(good, F.lit(False)))
    # -0.0 and 0.0 are equal. The limit on ranks is applied before the shuffle too, so copies do not meet in one task.
    rows = rows.select("vec_id", F.transform(whole, lambda x: x + F.lit(0.0)).alias("embedding")).distinct()
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct = rows.withColumn("place", order).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def code(parts):
        def rows_out():
            for ids, vector in rows_of(parts, "ids", "embedding"):
                v = np.array([vector])
                bits, length, agreement = encode(v)
                yield ids[0], v.tobytes(), ids, bits.tobytes(), float(length[0]), float(agreement[0])

        yield from batches(rows_out(), _CODES)

    return distinct.mapInArrow(code, "cls long, vector binary, ids array<long>, bits binary, length double, agreement double")


def search(codes: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest vectors found for each query (vec_id, vector).

    A query's own id is no candidate; ties go to the smaller vec_id; with fewer candidates all are returned. Vectors
    of another dimension than the query's are no candidates. An empty side gives no row.
    """
    spark = codes.sparkSession
    n, held = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))).first()
    blocks = max(1, math.ceil(held / BLOCK_BYTES))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def scan(block: int) -> DataFrame:
        rows = dealt.where(F.col("block") == block).select("vec_id", "vector").toArrow()
        asked = [(i, np.frombuffer(v)) for i, v in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for d in {len(v) for _, v in asked}:
            mine = [(i, v) for i, v in asked if len(v) == d]
            by_size[d] = [i for i, _ in mine], np.array([v for _, v in mine])
        sent = spark.sparkContext.broadcast(by_size)

        def nearest(parts):
            rows = list(rows_of(parts, "vector", "ids", "bits", "length", "agreement"))

            def out():
                for d, (ids, vectors) in sent.value.items():
                    mine = [r for r in rows if len(r[0]) == 8 * d]
                    if mine:
                        yield from _scan(mine, d, ids, vectors, k)

            yield from batches(out(), _FOUND, 8192)

        return codes.select("vector", "ids", "bits", "length", "agreement").mapInArrow(nearest, "query_id long, vec_id long, score double")

    found = reduce(DataFrame.unionByName, map(scan, range(blocks)))
    # The k best of each query: every task has cut its own share to k.
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))
    placed = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return placed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _scan(rows: list[tuple], d: int, query_ids: list[int], queries: np.ndarray, k: int):
    """The k nearest of one task's vectors for each query."""
    vectors = np.frombuffer(b"".join(r[0] for r in rows)).reshape(-1, d)
    signs = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=d).astype(np.float32) * 2 - 1
    length, agreement = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    # Directions are compared in single precision; lengths, which may be very large or small, stay in double.
    scale = length / (agreement * math.sqrt(d))
    spread = length * (np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement * EPSILON / math.sqrt(max(1, d - 1)))
    turned = (units(queries)[1] @ rotation(d).T).astype(np.float32)
    # A vector stands for up to k + 1 ids, of which one may be the query's own.
    need = min(k + 1, len(rows)) - 1
    per = max(1, (8 << 20) // (8 * len(rows)))
    for at in range(0, len(queries), per):
        with np.errstate(over="ignore", invalid="ignore"):
            guess = (turned[at : at + per] @ signs.T) * scale
            lower = np.nan_to_num(guess - spread, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            floor = np.partition(lower, len(rows) - 1 - need, axis=1)[:, len(rows) - 1 - need]
            # Without a bound (not a number) a vector is reranked.
            outside = guess + spread < floor[:, None]
        for i, chosen in enumerate(~outside):
            near = np.flatnonzero(chosen)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = exact(queries[at + i], vectors[near])
            # A sum without a value, as of +inf and -inf, comes last.
            scores = np.where(np.isnan(scores), -np.inf, scores)
            least = np.partition(scores, len(scores) - 1 - need)[len(scores) - 1 - need]  # and all its ties
            hits = [(-scores[j], v) for j in np.flatnonzero(scores >= least) for v in rows[near[j]][1] if v != query_ids[at + i]]
            for minus, v in sorted(hits)[:k]:
                yield query_ids[at + i], v, float(-minus)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest vectors of every vector whose vec_id is divisible by every.

    Each row is a candidate: an id with several vectors is listed once for each of them that is near. As a query such an
    id asks with the least of its vectors (in the order of their bytes). Products beyond double precision are infinite.
    """
    codes = written(index(vectors, k), "codes")
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = codes.select("vector", F.explode("ids").alias("vec_id")).where(F.col("vec_id") % every == 0)
    # Ids beyond the k + 1 least of a vector are found by their own rows.
    rest = whole.where(F.col("vec_id") % every == 0).join(asked.select("vec_id"), "vec_id", "left_anti")
    asked = asked.unionByName(_packed(rest)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(codes, asked, k)


def _packed(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def pack(parts):
        def out():
            for vec_id, v in rows_of(parts, "vec_id", "embedding"):
                if v and None not in v and np.isfinite(v).all() and any(v):
                    yield vec_id, np.array(v).tobytes()

        yield from batches(out(), schema)

    return rows.select("vec_id", "embedding").mapInArrow(pack, "vec_id long, vector binary")
