"""Whitening of embeddings with an exact scatter matrix.

Entries become whole numbers. Their sums of products are counted bit by bit: each dimension's values, shifted to start
at 0, are cut into bit planes, a plane's bits of 64 rows fill a word, and the product sum of two dimensions is the
sum over their planes of  2^(p + q) * popcount(plane p AND plane q).  All counts are whole, so the sums do not depend
on the order of rows; they are centred as whole numbers (n * product sum - sum * sum) before the first rounding.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import ROWS_PER_BATCH

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**62
BLOCK_ROWS = 8192
COMPONENTS = 32
_WHOLE = pa.decimal128(38, 0)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 as 64-bit whole numbers; beyond 2^62 on either side the nearest of these counts."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _vectors(batch: pa.RecordBatch):
    """(rows, whole numbers) of the batch's usable vectors, by their length."""
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        column = batch.column("embedding").slice(at, BLOCK_ROWS)
        start = np.asarray(column.offsets)
        flat = column.values.slice(start[0], start[-1] - start[0])
        value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        length, start = np.diff(start), start[:-1] - start[0]
        known = np.asarray(column.is_valid()) & (length > 0)
        for d in np.unique(length[known]):
            rows = np.flatnonzero(known & (length == d))
            x = value[start[rows][:, None] + np.arange(d)]
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                yield at + rows[fine], whole_numbers(x[fine])


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _WHOLE)


def _summed(parts):
    """Rows, least, greatest and sum of each dimension, by the vectors' length."""
    held: dict[int, list] = {}
    for batch in parts:
        for _, x in _vectors(batch):
            d = x.shape[1]
            # Halves of 32 bits, so that no sum overflows.
            now = [len(x), x.min(axis=0), x.max(axis=0), (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)]
            if d in held:
                n, low, high, upper, lower = held[d]
                held[d] = [n + now[0], np.minimum(low, now[1]), np.maximum(high, now[2]), upper + now[3], lower + now[4]]
            else:
                held[d] = now
    for d, (n, low, high, upper, lower) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(low), pa.array(high), _decimals((upper << 32) + lower)],
            ["d", "dim", "n", "low", "high", "total"],
        )


def bit_planes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Packed bit planes of a block of rows (unsigned, dimension by dimension, lowest bit first): a row of words for each."""
    words = -(-len(x) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for j, b in enumerate(bits):
        plane = (x[:, j][None, :] >> np.arange(b, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(plane, axis=1)
        out[at : at + b, : packed.shape[1]] = packed
        at += b
    return out.view(np.uint64)


def product_sums(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of x[:, j] * x[:, k] for j <= k, from weighted popcounts of ANDed bit planes."""
    d = len(bits)
    planes = bit_planes(x, bits)
    start = np.cumsum(bits) - bits
    used = np.flatnonzero(bits)
    place = np.concatenate([np.arange(b) for b in bits]) if d else np.zeros(0, int)
    # Weighted counts of a block fit 64 bits unless the values are very large.
    fits = 2 * int(bits.max(initial=0)) + BLOCK_ROWS.bit_length() < 63
    kind = np.int64 if fits else object
    weight = np.array([1 << int(p) for p in place], kind)
    out = np.zeros((d, d), kind)
    for k, j in enumerate(used):
        later = used[k:]
        for p in range(bits[j]):
            row = planes[start[j] + p]
            count = np.bitwise_count(planes[start[j] :] & row).sum(axis=1, dtype=np.int64)
            weighted = count.astype(kind) * weight[start[j] :]
            out[j, later] += np.add.reduceat(weighted, start[later] - start[j]) * (1 << p)
    return out


def _components(rows: list, products: dict[tuple[int, int], int], components: int):
    """Number of vectors, sums, eigenvalues, unit eigenvectors (as columns) and trace of the exact covariance."""
    d, n = len(rows), int(rows[0].n)
    low = [int(r.low) for r in rows]
    shifted = [int(r.total) - n * v for r, v in zip(rows, low, strict=True)]
    exact = np.zeros((d, d), np.longdouble)
    trace = Fraction(0)
    for (j, k), s in products.items():
        v = Fraction(n * s - shifted[j] * shifted[k], n * n)
        near = float(v)
        exact[j, k] = exact[k, j] = np.longdouble(near) + np.longdouble(float(v - Fraction(near)))
        if j == k:
            trace += v
    _, vectors = np.linalg.eigh(exact.astype(float))
    # A vector's own quotient is more exact than the solver's small eigenvalues.
    value = (vectors * (exact @ vectors.astype(np.longdouble))).sum(axis=0).astype(float)
    order = np.argsort(-value, kind="stable")[:components]
    value, vectors = value[order], vectors[:, order]
    real = value > value.max(initial=0.0) * d * np.finfo(float).eps
    value, vectors = value[real], vectors[:, real]
    peak = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[peak, np.arange(len(value))])
    return n, [int(r.total) for r in rows], value, vectors, float(trace)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component.

    embeddings has vec_id and embedding. Vectors that are null or empty or hold null or non-finite entries take no
    part; nor do those of another length than most have (of equally many the longer). An entry c becomes
    x = floor(64 * c) + 1,000,000; deviation is the exact sum over dimensions of (n * x - sum)^2, null beyond 64 bits. Components are the unit
    eigenvectors of the covariance of x by falling eigenvalue; each vector's largest entry is positive. Those whose
    eigenvalue is 0 to rounding are not given, so equal vectors alone, like an empty table, give no rows. A null
    vec_id stays null; repeated rows count and are given each; other columns are ignored.

    The driver holds sums of the size of one vector's square. Nothing else is collected and no row is shuffled.
    """
    spark = embeddings.sparkSession
    source = embeddings.select("vec_id", "embedding")
    sums = source.select("embedding").mapInArrow(_summed, "d long, dim long, n long, low long, high long, total decimal(38,0)")
    sums = sums.groupBy("d", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    common = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).first()
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], columns)
    rows = sums.where(F.col("d") == common.d).orderBy("dim").collect()
    d = len(rows)
    low = np.array([r.low for r in rows], np.int64)
    bits = np.array([(int(r.high) - int(r.low)).bit_length() for r in rows])

    def usable(batch):
        for at, x in _vectors(batch):
            if x.shape[1] == d:
                yield at, x

    def scattered(parts):
        total = np.zeros((d, d), object)
        held = []

        def add():
            block = np.concatenate(held)
            for at in range(0, len(block), BLOCK_ROWS):
                total[:] += product_sums(block[at : at + BLOCK_ROWS], bits).astype(object)

        for batch in parts:
            for _, x in usable(batch):
                held.append(x.view(np.uint64) - low.view(np.uint64))
            if sum(map(len, held)) >= BLOCK_ROWS:
                add()
                held = []
        if held:
            add()
        one, two = np.triu_indices(d)
        # Parts of 40 bits, so that sums over all tasks stay whole and fit.
        cells = total[one, two]
        limbs = [pa.array([int(c) >> 40 * i & (1 << 40) - 1 for c in cells], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *limbs], ["one", "two", *(f"l{i}" for i in range(5))])

    limbs = ", ".join(f"l{i} long" for i in range(5))
    products = source.select("embedding").mapInArrow(scattered, f"one long, two long, {limbs}").groupBy("one", "two").agg(*(F.sum(f"l{i}").alias(f"l{i}") for i in range(5)))
    products = {(r.one, r.two): sum(int(r[f"l{i}"]) << 40 * i for i in range(5)) for r in products.collect()}
    n, total, value, vectors, trace = _components(rows, products, components)
    if not len(value):
        return spark.createDataFrame([], columns)
    turn = vectors / np.sqrt(value)
    k = len(value)
    shifted = np.array([t - n * int(v) for t, v in zip(total, low, strict=True)], object)
    reach = n * (1 << int(bits.max()))
    small = reach < 1 << 62 and d * reach * reach < 1 << 63

    def centred(x: np.ndarray) -> tuple[np.ndarray, list]:
        """Deviations from the mean as doubles, and the exact sums of squares of n times them."""
        off = x - low if small else x.astype(object) - low.astype(object)
        off = off * n - (shifted.astype(np.int64) if small else shifted)
        squares = (off * off).sum(axis=1).tolist()
        if small:
            return off / n, squares
        return (off / n).astype(float), [s if s < 1 << 63 else None for s in squares]

    def covered(parts):
        cross, seen = np.zeros((k, k)), np.zeros(k)
        for batch in parts:
            for _, x in usable(batch):
                w = centred(x)[0] @ turn
                cross += w.T @ w
                seen += w.sum(axis=0)
        one, two = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.column_stack([cross, seen]).ravel())], ["one", "two", "sum"])

    seen = source.select("embedding").mapInArrow(covered, "one long, two long, sum double").groupBy("one", "two").agg(F.sum("sum").alias("sum"))
    cross = np.zeros((k, k + 1))
    for r in seen.collect():
        cross[r.one, r.two] = r["sum"] / n
    mean = cross[:, k]
    error = float(np.abs(cross[:, :k] - np.outer(mean, mean) - np.eye(k)).max())
    share = value / trace

    def rows_out(parts):
        for batch in parts:
            ids = batch.column("vec_id")
            for at, x in usable(batch):
                off, squares = centred(x)
                w = off @ turn
                for cut in range(0, len(at), ROWS_PER_BATCH):
                    some = at[cut : cut + ROWS_PER_BATCH]
                    m = len(some)
                    each = np.repeat(np.arange(m), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(some)).take(pa.array(each)),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                            pa.array(np.full(m * k, n)),
                            pa.array(squares[cut : cut + m], pa.int64()).take(pa.array(each)),
                            pa.array(w[cut : cut + m].ravel()),
                            pa.array(np.tile(share, m)),
                            pa.array(np.full(m * k, error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return source.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(rows_out, columns)
