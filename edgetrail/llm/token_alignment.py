"""Two tokenizers' tokens of the same text, aligned by their byte ends.

The sorted byte ends of both tokenizers are merged. Diagonals of equal work cut the merge path into pieces, each found
by a binary search, so a piece needs nothing from the others. A piece emits the token pairs that overlap; where a
diagonal falls between two equal ends, the two pieces are stitched. A group ends where tokens of both end at one byte.
All texts of a batch lie one behind the other on one path: a text's last tokens end together, so no group spans two.

The two ids of a link are counted over all documents in two steps: a task counts them over chunks of documents, Spark
adds the chunks' counts and sends each chunk the totals of its own pairs.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetrail.llm.bpe import PATTERN, byte_letters, once, tokenizer_text
from edgetrail.llm.common import batches, rows_of, written

WORK = 4096  # ends of one piece of the merge path
BATCH_BYTES = 1 << 20  # text that is aligned at once; one longer text is a batch of its own
CHUNK_LINKS = 1 << 21  # distinct links of one chunk's documents
WIDE_GROUP = 1 << 12  # groups of more links are multiplied out by distinct ids
_LONG_SPACE = re.compile(r"\s{1000}")
_ALIGNED = pa.schema(
    [("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("chunk", pa.int64()), ("links", pa.binary())]
)
_PAIRS = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("documents", pa.int64())])


def specification(path_a: str, path_b: str) -> str:
    """Both tokenizer files, of fixed size, as one text to be broadcast to the tasks."""
    with open(path_b, "rb") as f:
        return json.dumps({"a": tokenizer_text(path_a), "b": base64.b64encode(f.read()).decode()})


class Both:
    """The two tokenizers of a process: a byte-level BPE (A) and a piece model with byte fallback (B)."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        files = json.loads(spec)
        self.library = Tokenizer.from_str(files["a"])
        self.library.encode_special_tokens = True
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in json.loads(files["a"])["model"]["vocab"].items()}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=base64.b64decode(files["b"]))
        every = range(self.pieces.vocab_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in every)]
        self.length_a, self.length_b = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(tokens))] for tokens in (self.bytes_a, self.bytes_b))

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the text, special strings being plain text; none if either does not give back the bytes."""
        spaced = " " + text
        # The faster library fails on very long white space.
        a = self.library.encode(spaced, add_special_tokens=False).ids if _LONG_SPACE.search(text) else self.plain(spaced)
        b = self.pieces.encode(text, num_threads=1)
        want = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], []
        return a, b


def crossings(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals of equal work cross the merge path of two rising arrays, as places in a and b. An end of a
    comes before the equal end of b. All diagonals are searched at once."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while len(left := np.flatnonzero(low < high)):
        middle = (low[left] + high[left]) // 2
        later = a[middle] <= b[at[left] - middle - 1]
        low[left[later]] = middle[later] + 1
        high[left[~later]] = middle[~later]
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps of one piece in the order of their ends: index in a, index in b, and whether both end there."""
    before_a, before_b = np.searchsorted(b, a, "left"), np.searchsorted(a, b, "right")
    tied = np.zeros(len(b), bool)
    some = before_b > 0
    tied[some] = a[before_b[some] - 1] == b[some]
    closed = np.zeros(len(a) + len(b), bool)
    one, two = np.empty(len(closed), np.int64), np.empty(len(closed), np.int64)
    of_a, of_b = np.arange(len(a)) + before_a, np.arange(len(b)) + before_b
    one[of_a], two[of_a] = np.arange(len(a)), before_a
    one[of_b], two[of_b] = before_b, np.arange(len(b))
    closed[of_b[tied] - 1] = True
    kept = np.ones(len(closed), bool)
    kept[of_b[tied]] = False
    return one[kept], two[kept], closed[kept]


def group_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """For each group of two token lists with byte ends a and b: how many tokens of each lie up to its end."""
    i, j = crossings(a, b, work)
    ends_a, ends_b, waiting = [], [], None
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        one, two, closed = overlaps(a[i0:i1], b[j0:j1])
        if waiting is not None and j1 > j0 and b[j0] == waiting:
            # The diagonal fell between two equal ends: the last overlap before it closes its group.
            ends_a.append(np.array([i0]))
            ends_b.append(np.array([j0 + 1]))
            one, two, closed = one[1:], two[1:], closed[1:]
        ends_a.append(one[closed] + i0 + 1)
        ends_b.append(two[closed] + j0 + 1)
        if i1 > i0:
            waiting = a[i1 - 1]
    return np.concatenate([np.zeros(0, np.int64), *ends_a]), np.concatenate([np.zeros(0, np.int64), *ends_b])


def _links(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs (A id in the upper half) of one document's links, in order, and how often each is linked."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    size = size_a * size_b
    plain = np.flatnonzero(size <= WIDE_GROUP)
    group = np.repeat(plain, size[plain])
    within = np.arange(len(group)) - np.repeat(np.cumsum(size[plain]) - size[plain], size[plain])
    step = size_b[group]
    keys = [ids_a[(ends_a - size_a)[group] + within // step] << 32 | ids_b[(ends_b - size_b)[group] + within % step]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > WIDE_GROUP):
        one, n = np.unique(ids_a[ends_a[g] - size_a[g] : ends_a[g]], return_counts=True)
        two, m = np.unique(ids_b[ends_b[g] - size_b[g] : ends_b[g]], return_counts=True)
        keys.append((one[:, None] << 32 | two).ravel())
        times.append(np.outer(n, m).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, np.concatenate(times))
    return key, total


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: all lowest bytes, then all second ones and so on, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    return _planes(np.diff(keys >> 32, prepend=0).astype("<u4")) + _planes((keys & 0xFFFFFFFF).astype("<u4")) + _planes(times.astype("<u8"))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    planes = np.frombuffer(blob, np.uint8)

    def column(start: int, kind: str, width: int) -> np.ndarray:
        return np.ascontiguousarray(planes[start * n : (start + width) * n].reshape(width, n).T).view(kind).reshape(n).astype(np.int64)

    return np.cumsum(column(0, "<u4", 4)) << 32 | column(4, "<u4", 4), column(8, "<u8", 8)


def _texts(parts):
    """(doc_id, text) in batches of bounded text."""
    held, size = [], 0
    for doc_id, text in rows_of(parts, "doc_id", "text"):
        held.append((doc_id, text or ""))
        size += len(held[-1][1])
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def _aligned(both: Both, held: list[tuple]):
    """(doc_id, n_a, n_b, n_groups, n_links, groups, keys, times) of each text of a batch."""
    tokens = [both.tokens(text) if text else ([], []) for _, text in held]
    ids_a, ids_b = (np.array([i for pair in tokens for i in pair[k]], np.int64) for k in (0, 1))
    ends_a, ends_b = group_ends(np.cumsum(both.length_a[ids_a]), np.cumsum(both.length_b[ids_b]))
    at_a = at_b = at_group = 0
    for (doc_id, _), (a, b) in zip(held, tokens, strict=True):
        to_a, to_b = at_a + len(a), at_b + len(b)
        to_group = int(np.searchsorted(ends_a, to_a, "right"))
        own_a, own_b = ends_a[at_group:to_group] - at_a, ends_b[at_group:to_group] - at_b
        keys, times = _links(ids_a[at_a:to_a], ids_b[at_b:to_b], own_a, own_b)
        one, two = list(map(both.name_a.__getitem__, a)), list(map(both.name_b.__getitem__, b))
        x = y = 0
        words = []
        for p, q in zip(own_a.tolist(), own_b.tolist(), strict=True):
            words.append(f"{one[x]}|{two[y]}" if p - x == 1 == q - y else f"{','.join(one[x:p])}|{','.join(two[y:q])}")
            x, y = p, q
        yield doc_id, len(a), len(b), len(words), int(times.sum()), ";".join(words), keys, times
        at_a, at_b, at_group = to_a, to_b, to_group


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups of every row's whole text, with what score_links needs (chunk, links).

    docs has doc_id and text. A (byte-level BPE) encodes a space and the text, B (a piece model, which puts that space
    itself) the text; special strings in a text are plain text. groups reads `a1,a2|b1;a3|b2,b3`: ids of A and of B, in
    order. A text that is null or empty, or whose bytes either tokenizer does not give back, has no tokens: counts of
    0 and empty groups. A null doc_id stays null; repeated rows are aligned each; other columns are ignored; an empty
    table gives no rows. Nothing is shuffled. A long text is cut into pieces of equal work after its encoding.
    """
    spec = docs.sparkSession.sparkContext.broadcast(specification(path_a, path_b))

    def run(parts):
        both = once(Both, spec.value)
        chunk, room = TaskContext.get().partitionId() << 32, CHUNK_LINKS

        def rows():
            nonlocal chunk, room
            for held in _texts(parts):
                for doc_id, n_a, n_b, n_groups, n_links, groups, keys, times in _aligned(both, held):
                    if room <= 0:
                        chunk, room = chunk + 1, CHUNK_LINKS
                    room -= len(keys) + 64
                    yield doc_id, n_a, n_b, n_groups, n_links, groups, chunk, _packed(keys, times)

        yield from batches(rows(), _ALIGNED)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, links binary"
    )


def _count(parts):
    """Documents of each id pair, by chunk; a chunk that lies in two splits gives two rows for a pair."""
    now, held, size = None, [], 0

    def counted():
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(pair), 1 << 16):
            piece = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[piece]), now)), pa.array(pair[piece]), pa.array(n[piece])], schema=_PAIRS)

    for chunk, blob in rows_of(parts, "chunk", "links"):
        if held and (chunk != now or size > 2 * CHUNK_LINKS):
            yield from counted()
            held, size = [], 0
        now = chunk
        held.append(_unpacked(blob)[0])
        size += len(held[-1])
    if held:
        yield from counted()


def score_links(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to the rows of align() and drops chunk and links; all other columns are kept.

    The count of an id pair is the number of rows that hold it linked. count_sum adds the counts of a row's links,
    n_best counts its links whose count is the highest of their A id, ties included; rows without links have 0. A
    chunk is bounded by CHUNK_LINKS and one row, and holds a pair once, so a pair that every text holds costs one
    record a chunk. The pairs of one A id are at most as many as B has ids.
    """
    rows = written(aligned, "aligned")
    own = written(rows.select("chunk", "links").mapInArrow(_count, "chunk long, pair long, documents long"), "pairs")
    totals = own.groupBy("pair").agg(F.sum("documents").alias("count"))
    totals = totals.withColumn("best", F.max("count").over(Window.partitionBy(F.shiftright("pair", 32))))
    told = own.select("chunk", "pair").join(totals, "pair").select("chunk", "pair", "count", (F.col("count") == F.col("best")).alias("best"))
    kept = rows.drop("chunk", "links").schema

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        pair, first = np.unique(told["pair"].to_numpy(), return_index=True)
        count, best = told["count"].to_numpy()[first], told["best"].to_numpy()[first]
        n_best, count_sum = [], []
        for blob in texts["links"].to_pylist():
            keys, times = _unpacked(blob)
            at = np.searchsorted(pair, keys)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        out = texts.drop_columns(["chunk", "links"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_best long", "count_sum long"])
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
