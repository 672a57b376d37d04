"""Cross-entropy difference of documents under matched target and background bigram models.

Both models share one vocabulary, all words of the corpus, one order and one smoothing:
p(w | u) = MIX * c(u, w) / c(u) + (1 - MIX) * (c(w) + mass / V) / (N + mass), where V counts the words and one unknown
word.  The background is the whole corpus, the target its documents of the wanted kind; the mass of the target is
smaller in proportion to its tokens, so that unseen words weigh alike in both. c(u) counts u as a context.

Documents are dealt to blocks by a hash, and labels meet them there; a doc_id is dealt to SALTS blocks. A block numbers
its own words and counts them. Spark sums the counts of a word over the blocks, deals ids and joins both back to the
blocks that hold the word. A block then counts its own bigrams once and deals them to buckets, of which there are as
many as blocks. It sends a bucket one run: its bigrams in order as differences, with their counts, as compressed planes
of bytes. The bucket sums its runs and sends each block the sums in the order of that block's run, so no bigram travels
back by name, and documents are scored there. A word has at most one row and a bigram one entry per block, so no key is
hot. Words and bigrams thus grow with the corpus and are never gathered in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import trim, written
from edgetrail.llm.shingles import plain_words

MIX = 0.7
MASS = 1_000.0
BLOCK_BYTES = 12 << 20
SALTS = 16
COUNTS = ("background", "target", "background_context", "target_context")
# A row is a document with its words' places in the block, or a word of the block (place is not null).
_HELD = pa.schema(
    [("block", pa.int32()), ("doc_id", pa.int64()), ("wanted", pa.bool_()), ("ids", pa.binary()), ("place", pa.int32()), ("word", pa.string()), *((c, pa.int64()) for c in COUNTS)]
)
_RUNS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("run", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])


def _packed(places: list[int]) -> bytes:
    """Four planes of bytes, of which the upper ones are mostly zero."""
    return np.array(places, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _coded(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 up, of one length, as compressed planes of their bytes."""
    return pa.compress(np.stack(columns).astype("<u8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def _decoded(blob: bytes, columns: int, n: int) -> np.ndarray:
    """The columns that _coded was given, as rows of an array."""
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=columns * n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view("<u8").reshape(columns, n).astype(np.int64)


def _merged(runs: pa.Table) -> pa.Table:
    """The runs of one bucket, each entry with the sums over all of them in place of its own counts."""
    trim()
    sizes = runs["n"].to_pylist()
    keys, counts = np.empty(sum(sizes), np.int64), np.empty((2, sum(sizes)), np.int64)
    ends = np.cumsum(sizes)
    for blob, n, end in zip(runs["run"], sizes, ends, strict=True):
        steps, *own = _decoded(blob.as_py(), 3, n)
        keys[end - n : end], counts[:, end - n : end] = np.cumsum(steps), own
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    sums = np.add.reduceat(counts[:, order], first, axis=1)
    out = [_coded(*sums[:, place[end - n : end]]) for n, end in zip(sizes, ends, strict=True)]
    return pa.table([runs["block"], runs["bucket"], runs["n"], pa.chunked_array([pa.array(out, pa.binary())])], schema=_RUNS)


def _read_block(key, table: pa.Table, labels: pa.Table) -> pa.Table:
    """The documents of a block as places of words, most frequent first, and its words with their counts."""
    trim()
    target_ids = set(labels.column("doc_id").to_pylist())
    ids = table.column("doc_id").to_pylist()
    wanted = [d in target_ids for d in ids]
    place: dict[bytes, int] = {}
    docs = []
    for text in table.column("text"):
        words = plain_words(text.as_py() or "")
        docs.append(np.fromiter((place.setdefault(w, len(place)) for w in words), "<u4", len(words)))
    size = len(place)
    count = np.zeros((len(COUNTS), size), np.int64)
    for i, chosen in enumerate((docs, [d for d, w in zip(docs, wanted, strict=True) if w])):
        count[i] = np.bincount(np.concatenate([np.zeros(0, "<u4"), *chosen]), minlength=size)
        count[i + 2] = count[i] - np.bincount(np.array([d[-1] for d in chosen if len(d)], np.int64), minlength=size)  # the last word is no context
    order = np.argsort(-count[0], kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    words = list(place)
    n, m = len(docs), size
    columns = {
        "block": np.full(n + m, key[0].as_py(), np.int32), "doc_id": ids + [None] * m, "wanted": wanted + [None] * m,
        "ids": [_packed(rank[d]) for d in docs] + [None] * m, "place": [None] * n + list(range(m)), "word": [None] * n + [words[i].decode("utf-8") for i in order],
    }
    columns |= {c: [None] * n + count[i][order].tolist() for i, c in enumerate(COUNTS)}
    return pa.table([pa.array(columns[f.name], f.type) for f in _HELD], schema=_HELD)


def _numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """Each row with an id from 0 up, and the number of rows; only one count per partition is gathered."""
    marked = written(counts.withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, total = [], 0
    for p, n in sizes:
        firsts.append((p, total))
        total += n
    starts = F.create_map(*(F.lit(x).cast("long") for first in firsts or [(0, 0)] for x in first))
    return marked.withColumn("id", starts[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"), total


def score_documents(docs: DataFrame, wanted: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (their difference; lower is closer to the target).

    docs has doc_id and text, wanted has the doc_ids of the target. Losses are nats per word; the first word of a
    document follows a mark of its start. Words are lower-cased runs of ASCII letters, digits, underscores and any
    non-ASCII characters. A null or wordless text has no token and null losses; a null doc_id is scored but is no
    target; repeated rows count and are scored each; other columns are ignored. An empty target leaves its model
    uniform. With vocabulary, only so many of the most frequent words are known, ties going to the first in order, and
    all others are one unknown word; without, every word is known.
    """
    texts = docs.select("doc_id", "text")
    held = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(held / BLOCK_BYTES))

    def block_of(salt):
        return F.pmod(F.xxhash64("doc_id", salt), F.lit(blocks)).cast("int")

    dealt = texts.withColumn("block", block_of(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))).groupBy("block")
    marked = wanted.where("doc_id IS NOT NULL").select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    marked = marked.select("doc_id", block_of(F.col("salt")).alias("block")).distinct().groupBy("block")
    counted = ", ".join(f"{c} long" for c in COUNTS)
    read = written(dealt.cogroup(marked).applyInArrow(_read_block, f"block int, doc_id long, wanted boolean, ids binary, place int, word string, {counted}"), "blocks")
    own_words = read.where("place IS NOT NULL").select("block", "place", "word", *COUNTS)
    sums = own_words.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    if vocabulary is None:
        known, size = _numbered(sums)
        totals = known.agg(*(F.sum(c).alias(c) for c in COUNTS)).first()
    else:
        sums = written(sums, "all-words")
        known, size = _numbered(sums.orderBy(F.desc("background"), "word").limit(vocabulary))
        totals = sums.agg(*(F.sum(c).alias(c) for c in COUNTS)).first()
        rest = sums.join(known.select("word"), "word", "left_anti")
        other = rest.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
        known = known.unionByName(rest.select("word", *(F.lit(other[c]).cast("long").alias(c) for c in COUNTS), F.lit(size).cast("long").alias("id")))
    total = np.array([totals[c] or 0 for c in COUNTS], np.int64)
    starts = total[:2] - total[2:]  # each document that has words has one last word, and one mark of its start
    width = size + 2  # the unknown word is size, the mark of a start size + 1
    words = written(own_words.select("block", "place", "word").join(known, "word").select("block", "place", "id", *COUNTS), "block-words")
    whole = read.where("place IS NULL").select("block", "doc_id", "wanted", "ids").unionByName(words, allowMissingColumns=True).groupBy("block")

    def parts_of(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        return table.filter(pc.is_null(table["place"])), table.filter(pc.is_valid(table["place"])).sort_by("place")

    def pairs_of(blob: bytes, ids: np.ndarray) -> np.ndarray:
        mine = ids[_unpacked(blob)] if blob else np.zeros(0, np.int64)
        return np.append(size + 1, mine[:-1]) * width + mine if len(mine) else mine

    def counted_pairs(texts: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of a block in order, and how often each is in all its documents and in those of the target."""
        each = [pairs_of(b, ids) for b in texts["ids"].to_pylist()]
        pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_counts=True)
        seen, m = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, w in zip(each, texts["wanted"].to_pylist(), strict=True) if w)]), return_counts=True)
        count = np.zeros((len(pair), 2), np.int64)
        count[:, 0] = n
        count[np.searchsorted(pair, seen), 1] = m
        return pair, count

    def dealt_pairs(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Each bigram's key in its bucket, the order by bucket and key, and the buckets with their spans in that order.

        Neither the bigrams that share their first word nor those that share their second meet in one bucket.
        """
        before, after = pair // width, pair % width
        bucket, keys = (before + after) % blocks, before * -(-width // blocks) + after // blocks
        order = np.lexsort((keys, bucket))
        held, first = np.unique(bucket[order], return_index=True)
        ends = np.append(first, len(pair))[1:]
        return keys, order, list(zip(held.tolist(), first.tolist(), ends.tolist(), strict=True))

    def count_block(key, table):
        trim()
        texts, words = parts_of(table)
        pair, count = counted_pairs(texts, words["id"].to_numpy())
        keys, order, spans = dealt_pairs(pair)
        keys, count = keys[order], count[order]
        runs = [_coded(np.diff(keys[a:b], prepend=0), *count[a:b].T) for _, a, b in spans]
        columns = [np.full(len(spans), key[0].as_py()), [s[0] for s in spans], [b - a for _, a, b in spans], runs]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RUNS, strict=True)], schema=_RUNS)

    run = "block int, bucket int, n int, run binary"
    summed = whole.applyInArrow(count_block, run).groupBy("bucket").applyInArrow(_merged, run)

    def score_block(_, table: pa.Table, sums: pa.Table) -> pa.Table:
        trim()
        texts, words = parts_of(table)
        ids = words["id"].to_numpy()
        # Ids of the block's words in order, then the mark of a start, which is greater than all.
        named, first = np.unique(ids, return_index=True)
        named = np.append(named, size + 1)
        pair, count = counted_pairs(texts, ids)
        _, order, spans = dealt_pairs(pair)
        place = {bucket: (a, b) for bucket, a, b in spans}
        for bucket, n, blob in zip(sums["bucket"].to_pylist(), sums["n"].to_pylist(), sums["run"], strict=True):
            a, b = place[bucket]
            count[order[a:b]] = _decoded(blob.as_py(), 2, n).T
        before, after = np.searchsorted(named, pair // width), np.searchsorted(named, pair % width)
        loss = np.empty((len(pair), 2))
        for i, name in enumerate(("background", "target")):
            mass = MASS * total[i] / total[0] if total[i] else MASS
            word = np.append(words[name].to_numpy()[first], 0)
            context = np.append(words[f"{name}_context"].to_numpy()[first], starts[i])
            alone = (word[after] + mass / (size + 1)) / (total[i] + mass)
            loss[:, i] = -np.log(MIX * count[:, i] / np.maximum(1, context[before]) + (1 - MIX) * alone)
        out = []
        for doc_id, blob in zip(texts["doc_id"].to_pylist(), texts["ids"].to_pylist(), strict=True):
            mine = np.searchsorted(pair, pairs_of(blob, ids))
            background, target = loss[mine].mean(axis=0).tolist() if len(mine) else (None, None)
            out.append((doc_id, len(mine), target, background, target - background if len(mine) else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCORES, strict=True)], schema=_SCORES) if out else _SCORES.empty_table()

    return whole.cogroup(summed.groupBy("block")).applyInArrow(score_block, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
