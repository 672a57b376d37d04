"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours that fill each seed's window.

Terms are token ids, so document frequencies are a vector of the vocabulary's size, counted over all ids of all documents.
Every document first fills whole windows of its own. What is left of it, shorter than a window, goes to a shard with
the terms of the whole document, by which it seeks and is found:
tails are range-partitioned by a min-hash of those terms (doc_id breaks ties, so copies spread), and each run of
SHARD_TAILS rows is one shard with its own inverted index. A window starts with the next unused tail, asks the index
for its best unused neighbours and takes them until it is full; the last one is cut and its rest is the next seed.
The open window of a shard goes on in the next shard, and the open window of a partition is cut into sequences
of powers of two, so nothing is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.bpe import Encoder, once, tokenizer_text
from edgetrail.llm.common import batches, rows_of, written

TEXT_BYTES = 8 << 20  # of texts whose words are encoded together, each once
SHARD_TAILS = 1024
COMPACT = 0.75  # postings of used tails are dropped when this share of those held is left
K1, B = 1.2, 0.75
END_ID = 0
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("n", pa.int64()), ("body", pa.binary()), ("tail", pa.binary()), ("terms", pa.binary()), ("times", pa.binary()), ("sketch", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, within: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Each id lies in exactly one
    piece and offsets in a sequence are gapless. A null doc_id stays null, repeated rows are packed each, other
    columns are ignored, and an empty table gives no piece. With within, a text column, a sequence holds documents
    of one of its values only (null is one): shards and the open window end where the value changes.
    """
    sc = docs.sparkSession.sparkContext
    text = tokenizer_text(tokenizer_path)
    vocabulary = sc.broadcast(text)
    tokens = written(docs.select("doc_id", "text", F.col(within).alias("part") if within else F.lit(None).cast("string").alias("part")).mapInArrow(_tokenize(vocabulary, window), "doc_id long, part string, n long, body binary, tail binary, terms binary, times binary, sketch long"), "tokens")
    tails = tokens.where(F.length("tail") > 0).select("doc_id", "part", "n", "tail", "terms", "times", "sketch")
    counts = tokens.select("n", "terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    # At most one row per id of the vocabulary, and two for totals.
    total = {r.term: r.n for r in counts if r.term < 0}
    frequency = np.zeros(1 + max((r.term for r in counts), default=0))
    for r in counts:
        if r.term >= 0:
            frequency[r.term] = r.n
    n = max(1, total.get(-1, 0))
    index = sc.broadcast((np.log1p((n - frequency + 0.5) / (frequency + 0.5)), max(1.0, total.get(-2, 0) / n)))
    # Whole windows need no neighbour: byte ranges, four bytes an id. Their sequences have even numbers, packed ones odd.
    bodies = tokens.where(F.length("body") > 0).select("doc_id", "n", "body", F.explode(F.expr(f"sequence(0L, length(body) DIV 4 - 1, {window}L)")).alias("start"))
    bodies = bodies.select(
        "doc_id", "start", F.expr(f"substring(body, CAST(start * 4 + 1 AS INT), {window * 4})").alias("ids"), F.col("n").alias("doc_tokens"),
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    order = [*(["part"] if within else []), "sketch", "doc_id"]
    packed = tails.repartitionByRange(*order).sortWithinPartitions(*order, "n", "tail", "terms", "times").mapInArrow(_packer(index, window), PIECES)
    return bodies.unionByName(packed)


def _tokenize(vocabulary, window: int):
    def tokenize(parts):
        encoder = once(Encoder, vocabulary.value)
        shuffled = np.random.default_rng(7).permutation(1 << 20).astype(np.int64)

        def rows():
            for batch in _texts(_with_part(parts)):
                found, ends = encoder.many(batch.column("text"))
                found = np.insert(found, ends, END_ID).astype("<u4", copy=False)
                ends, at = ends + np.arange(1, len(ends) + 1), 0
                for doc_id, part, end in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), ends.tolist(), strict=True):
                    ids, at = found[at:end], end
                    cut = len(ids) - len(ids) % window
                    terms, times = np.unique(ids, return_counts=True)
                    sketch = int(shuffled[terms & 0xFFFFF].min())
                    yield doc_id, part, len(ids), ids[:cut].tobytes(), ids[cut:].tobytes(), terms.tobytes(), times.astype("<u4").tobytes(), sketch

        yield from batches(rows(), _TOKENS, 256)

    return tokenize


def _with_part(parts):
    """The batches; part is null where they have none."""
    for batch in parts:
        yield batch if "part" in batch.schema.names else batch.append_column("part", pa.nulls(batch.num_rows, pa.string()))


def _texts(parts):
    """The rows in batches of about TEXT_BYTES of text, in their order; a longer text is alone."""
    for batch in parts:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = TEXT_BYTES + (int(size[at - 1]) if at else 0)
            to = max(at + 1, int(np.searchsorted(size, most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _frequencies(parts):
    """Per task: how many documents hold each id; under -1 the number of documents, under -2 that of their ids."""
    seen, n, length = np.zeros(0, np.int64), 0, 0
    for size, held in rows_of(parts, "n", "terms"):
        terms = np.frombuffer(held, "<u4")
        if terms[-1] >= len(seen):
            seen = np.concatenate([seen, np.zeros(int(terms[-1]) + 1 - len(seen), np.int64)])
        seen[terms] += 1
        n, length = n + 1, length + size
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]]), pa.int64()), pa.array(np.concatenate([seen[at], [n, length]]), pa.int64())], names=["term", "n"])


def _packer(index, window: int):
    def pack(parts):
        idf, mean = index.value
        base, seq, space = TaskContext.get().partitionId() << 32, 0, window
        opened: list[tuple] = []  # pieces of the open window: doc_id, start, ids, doc_tokens, terms, times
        rest: tuple | None = None  # what is left of the document that was cut last

        def closed():
            nonlocal seq, opened, space
            offset = 0
            for doc_id, start, ids, n, *_ in opened:
                yield doc_id, start, ids.tobytes(), n, (base + seq) * 2 + 1, offset
                offset += len(ids)
            seq, opened, space = seq + 1, [], window

        def put(piece: tuple) -> None:
            nonlocal rest, space
            doc_id, start, ids, *more = piece
            opened.append((doc_id, start, ids[:space], *more))
            rest = (doc_id, start + space, ids[space:], *more) if len(ids) > space else None
            space -= min(space, len(ids))

        def shard(tails: list[tuple]):
            nonlocal rest
            lists = Postings([t[4] for t in tails], idf, mean, [t[5] for t in tails])
            unused, at = np.ones(len(tails), bool), 0
            while True:
                if rest:
                    put(rest)
                elif not opened:
                    at += int(np.argmax(unused[at:])) if at < len(tails) else 0
                    if at >= len(tails) or not unused[at]:
                        return
                    unused[at] = False
                    put(tails[at])
                if space:
                    for i in lists.best(np.concatenate([p[4] for p in opened]), unused):
                        unused[i] = False
                        put(tails[i])
                        if not space:
                            break
                if space:
                    return  # no tail is left; the window stays open
                yield from closed()

        def rows():
            held: list[tuple] = []
            now = None
            for doc_id, part, n, tail, terms, times in rows_of(_with_part(parts), "doc_id", "part", "n", "tail", "terms", "times"):
                if part != now:
                    yield from shard(held)
                    yield from ended()
                    held, now = [], part
                ids = np.frombuffer(tail, "<u4")
                held.append((doc_id, n - len(ids), ids, n, np.frombuffer(terms, "<u4"), np.frombuffer(times, "<u4")))
                if len(held) == SHARD_TAILS:
                    yield from shard(held)
                    held = []
            yield from shard(held)
            yield from ended()

        def ended():
            """The open window in sequences of powers of two."""
            nonlocal opened, rest
            left, power = [*opened, *([rest] if rest else [])], window
            opened, rest = [], None
            while left:
                total = sum(len(p[2]) for p in left)
                while power > total:
                    power //= 2
                take, opened = power, []
                while take:
                    doc_id, start, ids, *more = left.pop(0)
                    opened.append((doc_id, start, ids[:take], *more))
                    if len(ids) > take:
                        left.insert(0, (doc_id, start + take, ids[take:], *more))
                    take -= min(take, len(ids))
                yield from closed()

        yield from batches(rows(), _PIECES, 256)

    return pack


class Postings:
    """An inverted index of one shard: for each term the tails whose documents hold it, with their BM25 weights.

    tails has the ids of each document and times how often each counts, once if not given.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, times: list[np.ndarray] | None = None):
        self.size = len(tails)
        if not tails:
            return
        times = times or [np.ones(len(t), np.int64) for t in tails]
        lengths = np.array([t.sum() for t in times], np.int64)
        key = np.repeat(np.arange(len(tails), dtype=np.int64), [len(t) for t in tails]) + np.concatenate(tails).astype(np.int64) * len(tails)
        order = np.argsort(key)  # by term, then tail
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pairs, tf = key[first], np.add.reduceat(np.concatenate(times).astype(np.int64)[order], first)
        terms, self.tail = pairs // len(tails), pairs % len(tails)
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.tail] / mean))
        terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(pairs))
        self.place = np.full(len(idf), -1)
        self.place[terms] = np.arange(len(terms))
        self.held = self.size

    def best(self, query: np.ndarray, unused: np.ndarray):
        """The unused tails, best first; ties, and tails without a common term, in order of the shard."""
        if not self.size or not unused.any():
            return
        left = np.flatnonzero(unused)
        if len(left) < COMPACT * self.held:
            self._drop_used(unused)
            self.held = len(left)
        query = np.unique(query)
        at = self.place[query[query < len(self.place)]]
        spans = list(zip(self.starts[at[at >= 0]].tolist(), self.ends[at[at >= 0]].tolist(), strict=True))
        scores = np.zeros(self.size)
        if spans:
            scores = np.bincount(np.concatenate([self.tail[i:j] for i, j in spans]), np.concatenate([self.weight[i:j] for i, j in spans]), self.size)
        yield from left[np.argsort(-scores[left], kind="stable")].tolist()

    def _drop_used(self, unused: np.ndarray) -> None:
        """Without the postings of used tails, which no later query may return; scores of the others stay the same."""
        keep = unused[self.tail]
        moved = np.concatenate([[0], np.cumsum(keep)])
        self.tail, self.weight = self.tail[keep], self.weight[keep]
        self.starts, self.ends = moved[self.starts], moved[self.ends]
