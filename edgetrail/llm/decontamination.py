"""Benchmark items inside long documents: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the power of two below their number of shingles. Each partition keeps the SKETCH least
hashes of every item (its MinHash sketch). A document is as long as it likes: only the small side is sketched, and a
document is a candidate for an item if it holds one hash of the item's sketch; an item of which a share s is in the
document is missed with a chance below (1 - s) ** SKETCH, and never if SKETCH exceeds (1 - s) of its shingles. The
size of a partition also tells how many shingles a document needs at least. Candidates are verified on all shingles.

Items are broadcast in blocks of bounded rows and bytes, and each block scans the documents once, without a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, rows_of, slices, tidied
from edgetrail.llm.shingles import hashed, plain_words, shingle_set, shingles

SKETCH = 16
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
FILTER_BITS = 20
_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])


class Items:
    """One block of items: per size partition the sketch index, and every item's full set."""

    def __init__(self, rows: list[tuple], size: int):
        # (item_id, words in a shingle, set): an item of fewer words is a single shingle of that many words
        self.items = []
        for item_id, text in rows:
            words = hashed(plain_words(text or ""))
            if len(words):
                self.items.append((item_id, min(size, len(words)), shingle_set(words, size)))
        self.lengths = sorted({k for _, k, _ in self.items})
        self.partitions = []
        parts: dict[tuple, list[int]] = {}
        for i, (_, k, distinct) in enumerate(self.items):
            parts.setdefault((k, len(distinct).bit_length() - 1), []).append(i)
        for (k, power), members in sorted(parts.items()):
            pairs = [(h, i) for i in members for h in np.sort(self.items[i][2])[:SKETCH].tolist()]
            pairs.sort()
            keys = np.array([h for h, _ in pairs], np.uint64)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.partitions.append((k, 1 << power, keys, np.array([i for _, i in pairs]), seen))

    def found(self, text: str, threshold: float):
        """(item_id, shingles of the item, how many of them the text holds), for those with enough."""
        words = hashed(plain_words(text))
        by_length = {k: shingles(words, k) for k in self.lengths}
        for k, least, keys, owner, seen in self.partitions:
            mine = by_length[k]
            if len(mine) < threshold * least:
                continue
            hit = mine[seen[(mine & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
            if not len(hit):
                continue
            hit = np.unique(hit)
            low, high = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            candidates = {int(owner[j]) for a, b in zip(low, high, strict=True) for j in range(a, b)}
            if not candidates:
                continue
            whole = np.unique(mine)
            for i in sorted(candidates):
                item_id, _, distinct = self.items[i]
                at = np.minimum(np.searchsorted(whole, distinct), len(whole) - 1)
                shared = int((whole[at] == distinct).sum())
                if shared >= threshold * len(distinct):
                    yield item_id, len(distinct), shared


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, item_shingles, shared and containment of each pair with at least the threshold.

    Words are lower-cased runs of ASCII letters, digits, underscores and any non-ASCII characters. An item of fewer
    than size words is one shingle of all its words. A null or wordless text, on either side, gives no pair; null
    ids stay null; repeated documents give their pairs each, repeated items likewise; other columns are ignored.
    """
    texts = docs.select("doc_id", "text")

    def pairs(index) -> DataFrame:
        def search(parts):
            def rows():
                for doc_id, text in rows_of(parts, "doc_id", "text"):
                    for item_id, whole, shared in index.value.found(text or "", threshold):
                        yield doc_id, item_id, whole, shared, shared / whole

            yield from batches(rows(), _PAIRS)

        return texts.mapInArrow(tidied(search), "doc_id long, item_id long, item_shingles long, shared long, containment double")

    return reduce(DataFrame.unionByName, map(pairs, _blocks(benchmark, size)))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item by the rule of contaminated()."""

    def without(rest: DataFrame, index) -> DataFrame:
        def keep(parts):
            for piece in slices(parts):
                texts = piece.column("text").to_pylist()
                yield piece.filter(pa.array([next(index.value.found(t or "", threshold), None) is None for t in texts], pa.bool_()))

        return rest.mapInArrow(tidied(keep), docs.schema)

    return reduce(without, _blocks(benchmark, size), docs)


def _blocks(benchmark: DataFrame, size: int):
    """The items in broadcast blocks of at most about BLOCK_ITEMS rows and BLOCK_BYTES of text."""
    items = benchmark.select("item_id", "text")
    n, held = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(held / BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows], size))
