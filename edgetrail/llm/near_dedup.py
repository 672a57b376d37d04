"""Near-duplicate documents by one-permutation MinHash.

A document's shingles are hashed once and dealt into BANDS * ROWS bins; the least hash of each bin is its value and
empty bins borrow from a bin that an own hash sequence finds (optimal densification). Documents with equal sets form
one class. Classes that agree on all values of a band share a bucket, and each bucket only links its members to one
center, so pairs stay in proportion to members. Centers are the members that share most buckets. Links are confirmed
on full sets; pairs that a sketch puts more than five deviations below the threshold are not sent there. The sketch has
1024 bins of the same hashes, with a bit for "occupied" and one of the value. What a star can miss - two members that are
alike but not both like the center - is searched for only among members of a bucket that are still in different
components, once for the bucket's main component. Its members are dealt into blocks of bounded size, and a task counts
at once what all pairs of two blocks share: frequent shingles by a product of matrices, rare ones by their lists.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, rows_of, tidied, written
from edgetrail.llm.shingles import hashed, mixed, shingle_set, spaced_words

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
SKETCH_BINS = 1024
SKETCH_LONGS = SKETCH_BINS // 64
_PROBES = 4096
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 19
FREQUENT = 256  # a shingle is frequent if more than one of so many pairs shares it
COLUMNS, CELLS = 1024, 1 << 22
_SIGNATURES = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("mark", pa.int64())]
)
_PARTS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_probes: list[np.ndarray] = []


def values(distinct: np.ndarray) -> np.ndarray:
    """The densified one-permutation values of a sorted, non-empty set of hashes."""
    bins = (((distinct >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = distinct[first], True
    if len(first) == 1:
        return np.full(BINS, distinct[0])
    if not _probes:
        _probes.append(np.random.default_rng(11).integers(0, BINS, (_PROBES, BINS)))
    empty = np.flatnonzero(~full)
    for probe in _probes[0]:
        if not len(empty):
            return out
        at = probe[empty]
        found = full[at]
        out[empty[found]] = out[at[found]]
        empty = empty[~found]
    used = np.flatnonzero(full)  # so sparse that no probe met it: the next full bin
    out[empty] = out[used[np.searchsorted(used, empty) % len(used)]]
    return out


def _sketch(distinct: np.ndarray) -> list[int]:
    """SKETCH_LONGS words of occupied bins, then as many with the lowest mixed bit of each bin's least hash."""
    bins = (distinct >> np.uint64(64 - 10)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros((2, SKETCH_BINS), np.uint8)
    out[0, bins[first]] = 1
    out[1, bins[first]] = (mixed(distinct[first]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(out).view(np.int64).tolist()


def _signature(text: str | None, size: int) -> tuple:
    distinct = shingle_set(hashed(spaced_words(text)), size) if text else ()
    if not len(distinct):
        return 0, None, None, [], []
    v = values(distinct)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in v.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    a, b = np.frombuffer(xxhash.xxh3_128_digest(distinct.tobytes()), np.int64).tolist()
    return len(distinct), a, b, key.view(np.int64).tolist(), _sketch(distinct)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; sets hold the distinct shingles of size
    words of the whole text. Texts whose sets overlap by percent of their union are linked. A text without words has
    no set and no link. Equal rows are linked like other copies. A null doc_id takes no part: its component and kept
    are null. Other columns are ignored. With mark (a long) its value comes along, by which rows of a repeated doc_id
    can be told apart.
    """

    def sign(parts):
        yield from batches(((d, *_signature(t, size), m) for d, t, m in rows_of(parts, "doc_id", "text", "mark")), _SIGNATURES)

    rows = docs.select("doc_id", "text")
    marked = docs.select("doc_id", "text", (F.lit(None).cast("long") if mark is None else mark).alias("mark"))
    signed = written(marked.mapInArrow(tidied(sign), "doc_id long, n long, set_a long, set_b long, keys array<long>, sketch array<long>, mark long"), "signatures")
    classes = written(
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    dealt = classes.select("cls", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(dealt.join(shared, "key"), "buckets")

    weight = members.groupBy("cls").agg(F.sum("members").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("cls")).alias("minus")))
    centers = members.join(weight, "cls").groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.minus")).alias("center"), "best.weight")
    star = members.join(centers, "key").where("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b"), "weight").distinct()
    looks = classes.select("cls", *_LOOKS)
    likely = star.join(_named(looks, "a"), "a").join(_named(looks, "b"), "b").where(_alike(percent))
    likely = written(likely.select("a", "b", "a_least", "b_least", "weight"), "star")
    # First every member with its heaviest center; then what is still apart, so few sets are made and sent.
    first = likely.groupBy("b").agg(F.max_by(F.struct("a", "b", "a_least", "b_least"), F.struct("weight", -F.col("a"))).alias("pair")).select("pair.*")
    links = written(_confirmed(rows, first, size, percent), "links")
    roots = components(links)
    apart = likely.join(roots.select(F.col("cls").alias("a"), F.col("root").alias("a_root")), "a", "left").join(roots.select(F.col("cls").alias("b"), F.col("root").alias("b_root")), "b", "left")
    apart = apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "a_least", "b_least")
    links = written(links.unionByName(_confirmed(rows, apart, size, percent)), "links")
    roots = components(links)

    parts = members.join(roots, "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("part"))
    sizes = parts.groupBy("key", "part").agg(F.count("*").alias("members"))
    open_keys = sizes.groupBy("key").agg(F.max_by("part", F.struct("members", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    left = parts.join(open_keys, "key").select("main", "part", "cls").distinct()
    left = written(left.join(classes.select("cls", "n", "least"), "cls"), "open-buckets")
    more = written(_crossing(rows, left, size, percent), "more-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    placed = classes.select("cls", "set_a", "set_b", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    component = placed.join(least, "root").select(F.col("set_a").alias("own_a"), F.col("set_b").alias("own_b"), "component")
    found = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b", "mark").join(component, (F.col("set_a") == F.col("own_a")) & (F.col("set_b") == F.col("own_b")), "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    found = found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "mark")
    return found.drop("mark") if mark is None else found


_LOOKS = ("n", "least", "sketch")


def _named(looks: DataFrame, name: str) -> DataFrame:
    return looks.select(F.col("cls").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _LOOKS))


def _alike(percent: int):
    """Sizes, and an estimate from sketches, that a pair of at least this similarity has."""

    def total(of):
        return reduce(lambda x, y: x + y, (F.bit_count(of(i)) for i in range(SKETCH_LONGS)))

    def at(side: str, i: int):
        return F.col(f"{side}_sketch")[i]

    either = total(lambda i: at("a", i).bitwiseOR(at("b", i)))
    both = total(lambda i: at("a", i).bitwiseAND(at("b", i)))
    odd = total(lambda i: at("a", i).bitwiseAND(at("b", i)).bitwiseAND(at("a", i + SKETCH_LONGS).bitwiseXOR(at("b", i + SKETCH_LONGS))))
    # Bins with different values agree in their bit by half, so twice the odd bins differ; the rest holds equal values.
    share, a, b = percent / 100, F.col("a_n"), F.col("b_n")
    sampled = F.greatest(F.lit(0.0), 1 - either / ((a + b) / (1 + share)))
    deviation = F.sqrt(2 * odd + share * (1 - share) * either * sampled)
    sizes = (a * 100 >= b * percent) & (b * 100 >= a * percent)
    return sizes & (both - 2 * odd + 5 * deviation + 2 >= share * either)


def _sets(rows: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """cls and items, the full set made anew from a text, of each class in ends."""
    schema = pa.schema([("cls", pa.int64()), ("items", pa.list_(pa.int64()))])

    def sets(parts):
        yield from batches(((c, shingle_set(hashed(spaced_words(t)), size).view(np.int64)) for c, t in rows_of(parts, "cls", "text")), schema, 64)

    # A repeated doc_id with several texts has several sets; all of them are compared and the best counts. Equal rows
    # are one here, by the partitioning of the join.
    ends = ends.select("cls", "least").distinct()
    texts = rows.where("text IS NOT NULL").join(ends, rows.doc_id == ends.least).select("least", "cls", "text").distinct()
    return written(texts.select("cls", "text").mapInArrow(tidied(sets), "cls long, items array<long>"), "sets")


def _confirmed(rows: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets, made anew from the texts, overlap enough."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("cls"), F.col("a_least").alias("least")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("b_least").alias("least")))
    items = _sets(rows, ends, size)
    both = (
        pairs.select("a", "b")
        .join(items.select(F.col("cls").alias("b"), F.col("items").alias("b_items")), "b")
        .join(items.select(F.col("cls").alias("a"), F.col("items").alias("a_items")), "a")
        .withColumn("common", F.size(F.array_intersect("a_items", "b_items")))
    )
    enough = F.col("common") * 100 >= (F.size("a_items") + F.size("b_items") - F.col("common")) * percent
    return both.where(enough).select("a", "b").distinct()


def _crossing(rows: DataFrame, left: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of parts of which two members, met in one main component, overlap enough on full sets.

    Members of the main part and members apart from it have blocks of their own: no pair of the main part is compared.
    """
    apart = F.col("part") != F.col("main")

    def blocks(of: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.count_if(of) / BLOCK_SETS), F.ceil(F.sum(F.when(of, F.col("n"))) / BLOCK_SHINGLES))

    # Few components need more than two blocks: at most one for each BLOCK_SETS members or BLOCK_SHINGLES shingles.
    cut = left.groupBy("main").agg(blocks(apart).alias("outer"), blocks(~apart).alias("inner")).where("outer + inner > 2")
    placed = left.join(F.broadcast(cut), "main", "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("outer", "inner")})
    spread = F.xxhash64("cls")
    block = F.when(apart, F.pmod(spread, F.col("outer"))).otherwise(F.col("outer") + F.pmod(spread, F.col("inner")))
    others = F.sequence(F.lit(0).cast("long"), F.col("outer") - 1 + F.when(apart, F.col("inner")).otherwise(F.lit(0)))
    dealt = placed.select("main", "part", "cls", block.alias("block"), F.explode(others).alias("other"))
    dealt = dealt.select("main", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "part", "cls")
    met = dealt.join(_sets(rows, left, size), "cls").select("main", "low", "high", "block", "part", "items")
    met = met.repartition("main", "low", "high").sortWithinPartitions("main", "low", "high")

    def compare(parts):
        yield from batches((pair for group in _groups(parts) for pair in _linked_parts(group, percent)), _PARTS)

    return met.mapInArrow(tidied(compare), "a long, b long").distinct()


def _groups(parts):
    """The rows of each two blocks that meet, as one table, from sorted batches."""
    held, last = [], None
    for batch in parts:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy() for name in ("main", "low", "high")])
        for at, end in pairwise([0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]):
            key = tuple(keys[:, at].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked_parts(group: pa.Table, percent: int):
    """The pairs of different parts, each once, that a pair of sets of the two blocks links."""
    low, high, block, part = (group.column(name).to_numpy() for name in ("low", "high", "block", "part"))
    items = group.column("items").combine_chunks()
    n = items.value_lengths().to_numpy().astype(np.int64)
    _, codes = np.unique(items.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(n)

    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each item of these rows, which of the rows has it, and its code."""
        at = np.repeat(ends[rows] - np.cumsum(n[rows]), n[rows]) + np.arange(n[rows].sum())
        return np.repeat(np.arange(len(rows)), n[rows]), codes[at]

    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not (len(a) and len(b)):
        return
    others, found = of(b), set()
    for rows in np.array_split(a, -(-len(a) * len(b) // CELLS)):
        common = _common(of(rows), others, (len(rows), len(b)))
        i, j = np.nonzero((common * (100 + percent) >= (n[rows][:, None] + n[b]) * percent) & (part[rows][:, None] != part[b]))
        x, y = part[rows[i]], part[b[j]]
        found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
    yield from found


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many items each pair of a row of a and a row of b shares, from the rows and codes of their items."""
    codes = 1 + max(a[1].max(initial=-1), b[1].max(initial=-1))
    in_b = np.bincount(b[1], minlength=codes)
    sharing = np.bincount(a[1], minlength=codes) * in_b  # pairs
    common = np.zeros(shape, np.int64)
    frequent = sharing * FREQUENT > shape[0] * shape[1]
    column, total = np.cumsum(frequent) - 1, int(frequent.sum())

    def matrices(side: tuple[np.ndarray, np.ndarray], height: int):
        """0 and 1 by row and frequent item, COLUMNS items at a time."""
        rows, at = (x[frequent[side[1]]] for x in (side[0], column[side[1]]))
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        for first in range(0, total, COLUMNS):
            here = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            out = np.zeros((height, min(COLUMNS, total - first)), np.float32)
            out[rows[here], at[here] - first] = 1
            yield out

    for x, y in zip(matrices(a, shape[0]), matrices(b, shape[1]), strict=True):
        common += (x @ y.T).astype(np.int64)
    rare = (sharing > 0) & ~frequent
    rows, held = (x[rare[a[1]]] for x in a)
    order = np.argsort(b[1], kind="stable")
    mates, start = b[0][order], np.searchsorted(b[1][order], held)
    ends = np.cumsum(in_b[held])
    cuts = np.searchsorted(ends, np.arange(CELLS, ends[-1] if len(ends) else 0, CELLS))
    for at, end in pairwise(sorted({0, *cuts.tolist(), len(held)})):
        times = in_b[held[at:end]]
        before = ends[at:end] - times
        mate = mates[np.repeat(start[at:end] - before, times) + np.arange(before[0], ends[end - 1])]
        common += np.bincount(np.repeat(rows[at:end], times) * shape[1] + mate, minlength=common.size).reshape(shape)
    return common


def components(edges: DataFrame) -> DataFrame:
    """cls and root, the least member reachable, for every end of an edge: large-star and small-star rounds."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())
        before = now
