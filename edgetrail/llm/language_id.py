"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to four letters lie within words, whose ends count as a letter; they are hashed into BUCKETS. Counts
are summed by Spark; the matrix of log probabilities (languages x BUCKETS) is broadcast, BLOCK_LANGUAGES rows at a time.
Texts are scored in batches in numpy: the sparse counts of (text, bucket) are multiplied by the matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgetrail.llm.common import rows_of, slices, tidied, written

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
# Languages in one broadcast matrix: at most 64 MB.
BLOCK_LANGUAGES = 256
# More values than there are languages: the list of names is bounded.
MAX_LANGUAGES = 16_384
# The model may be fitted on a sample of about this many labelled rows, chosen by a hash within each language. A language
# gives as many as its share, but about LEAST_ROWS or all it has at least, so the sample grows with the languages only.
MAX_TRAINING_ROWS = 20_000
LEAST_ROWS = 78
SMOOTHING = 0.5
UNKNOWN = "und"
_SEGMENT = 1 << 18
_HELD_COUNTS = 1 << 22
_letters: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-cased code points with every run of other characters, and both ends, as one 0."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = np.concatenate([[0], np.where(_letters[0][codes], codes, 0), [0]]).astype(np.uint32)
    return codes[(codes != 0) | (np.append(1, codes[:-1]) != 0)]


def ngrams(codes: np.ndarray, starts: int) -> np.ndarray:
    """The bucket of each n-gram that begins at the first places, order by order; BUCKETS where it leaves a word."""
    codes = np.append(codes, np.zeros(max(ORDERS), np.uint32))
    out = np.empty((len(ORDERS), starts), np.int64)
    h, inside = np.zeros(starts, np.uint32), np.ones(starts, bool)
    for i, n in enumerate(ORDERS):
        c = codes[n - 1 : n - 1 + starts]
        h = (h * np.uint32(0x01000193)) ^ c
        if n > 2:
            inside = inside & (codes[n - 2 : n - 2 + starts] != 0)
        spread = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x297A2D39 & 0xFFFFFFFF)
        known = inside & (c != 0) if n == 1 else inside
        out[i] = np.where(known, (spread ^ (spread >> np.uint32(13))) & np.uint32(BUCKETS - 1), BUCKETS)
    return out


def segments(codes: np.ndarray):
    """A long text in pieces of bounded size: codes with a margin, and how many n-grams begin in them."""
    for at in range(0, len(codes), _SEGMENT):
        piece = codes[at : at + _SEGMENT + max(ORDERS)]
        yield piece, min(_SEGMENT, len(codes) - at)


def counted(texts):
    """Sparse counts of (row, text) pairs, piece by piece: (rows, buckets, counts) without repeats in a piece.

    Texts are laid end to end up to _SEGMENT code points, so that a piece is hashed by a few array operations; a longer
    text goes over several pieces. The 0 at both ends of a text keeps n-grams of neighbours apart.
    """
    held, size = [], 0
    for row, text in texts:
        for piece, starts in segments(letters(text)):
            held.append((row, piece, starts))
            size += len(piece)
            if size >= _SEGMENT:
                yield _sparse(held)
                held, size = [], 0
    if held:
        yield _sparse(held)


def _sparse(held: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(piece) for _, piece, _ in held])
    rows = np.repeat(np.array([row for row, _, _ in held], np.int64), lengths)
    ends = np.cumsum(lengths)
    begins = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) < np.repeat([starts for _, _, starts in held], lengths)
    found = ngrams(np.concatenate([piece for _, piece, _ in held]), ends[-1])
    keys = (rows * BUCKETS + found)[begins & (found < BUCKETS)]
    keys, counts = np.unique(keys, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[list[str], DataFrame]:
    """The languages in order, and their counts (lang, bucket, n) as a written table, from (doc_id, text, lang)."""
    spark = labelled.sparkSession
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"lang holds more than {MAX_LANGUAGES} values: these are not languages")
    n = sum(r.n for r in seen)
    shares = [(r.lang, i, math.ceil(min(1.0, max(max_rows / n, LEAST_ROWS / r.n)) * (1 << 20))) for i, r in enumerate(seen)]
    known = spark.createDataFrame(shares, "lang string, place int, below long")
    rows = rows.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 20)) < F.col("below"))

    def count(parts):
        def batch(keys, counts):
            columns = [pa.array(keys // BUCKETS, pa.int32()), pa.array(keys % BUCKETS, pa.int32()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lang, bucket, times in counted(rows_of(parts, "place", "text")):
            keys, place = np.unique(np.concatenate([keys, lang * BUCKETS + bucket]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            if len(keys) > _HELD_COUNTS:
                yield batch(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield batch(keys, counts)

    counts = rows.select("place", "text").mapInArrow(tidied(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return [r.lang for r in seen], written(counts, "language-counts")


def matrix(counts: DataFrame, first: int, end: int) -> np.ndarray:
    """Log probabilities of the languages from first to end: a row for each language, a column for each bucket."""
    found = counts.where(F.col("lang").between(first, end - 1)).toArrow()
    totals = np.full((end - first, BUCKETS), SMOOTHING)
    totals[found["lang"].to_numpy() - first, found["bucket"].to_numpy()] += found["n"].to_numpy()
    return np.log(totals / totals.sum(axis=1, keepdims=True)).astype(np.float32)


def scored(texts: list[str | None], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of each text (rows) under each language (columns), and the texts' numbers of n-grams.

    The sparse counts of the batch are multiplied by the matrix language by language.
    """
    totals, n = np.zeros((len(texts), len(logs))), np.zeros(len(texts))
    for rows, buckets, counts in counted((i, text or "") for i, text in enumerate(texts)):
        n += np.bincount(rows, counts, len(texts))
        for i, row in enumerate(logs):
            totals[:, i] += np.bincount(rows, row[buckets] * counts, len(texts))
    return totals, n


_STATE = pa.schema([("lang_place", pa.int32()), ("lang_top", pa.float64()), ("lang_rest", pa.float64())])


def _compared(docs: DataFrame, logs: np.ndarray, first: int, keep: list[str]) -> DataFrame:
    """The columns to keep and _STATE: the place of the best language of those seen so far (-1 for a text without a
    letter), its log-likelihood, and the sum over these languages of exp(difference to the best / square root of the
    number of n-grams)."""
    model = docs.sparkSession.sparkContext.broadcast(logs)
    begun = "lang_place" in docs.columns

    def compare(parts):
        for piece in slices(parts):
            totals, n = scored(piece.column("text").to_pylist(), model.value)
            width = np.sqrt(np.maximum(1, n))
            place = totals.argmax(axis=1)
            top = totals[np.arange(len(totals)), place]
            rest = np.exp((totals - top[:, None]) / width[:, None]).sum(axis=1)
            place = place + first
            if begun:
                before, old, other = (piece.column(name).to_numpy() for name in _STATE.names)
                best = np.maximum(top, old)
                rest = rest * np.exp((top - best) / width) + other * np.exp((old - best) / width)
                place, top = np.where(top > old, place, before), best
            state = pa.array(np.where(_lettered(n), place, -1), pa.int32()), pa.array(top), pa.array(rest)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *state], names=[*keep, *_STATE.names])

    state = T.StructType().add("lang_place", T.IntegerType()).add("lang_top", T.DoubleType()).add("lang_rest", T.DoubleType())
    return docs.mapInArrow(tidied(compare), T.StructType([*docs.select(keep).schema, *state]))


def _lettered(n: np.ndarray) -> np.ndarray:
    """Whether texts with that many n-grams have a letter: without one, the pair of both ends is the only n-gram."""
    return n > 1


def identify(docs: DataFrame, names: list[str], counts: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text alone.

    A null text, and one without a letter, is UNKNOWN with score 0, and so is every text if no language was learned.
    The score is the share of the best language after the log-likelihoods are divided by the square root of the
    number of n-grams, so that long texts do not all score 1 exactly; ties go to the first language in order.
    Null doc_ids stay null, repeated rows are scored each, other columns are ignored. BLOCK_LANGUAGES languages are
    broadcast at a time; with more, the best so far of each row is written and compared with the next ones.
    """
    rows = docs.select("doc_id", "text")
    if not names:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = _best(rows, names, counts, ["doc_id"])
    score = F.when(F.col("lang_place") >= 0, 1 / F.col("lang_rest")).otherwise(0.0)
    return found.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def _best(rows: DataFrame, names: list[str], counts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep with _STATE over all languages and the best one's name, null for a text without a letter."""
    for first in range(0, len(names), BLOCK_LANGUAGES):
        end = min(len(names), first + BLOCK_LANGUAGES)
        if first:
            rows = written(rows, "language-best")
        rows = _compared(rows, matrix(counts, first, end), first, list(dict.fromkeys([*keep, "text"])) if end < len(names) else keep)
    known = rows.sparkSession.createDataFrame(list(enumerate(names)), "lang_place int, lang_pred string")
    return rows.join(F.broadcast(known), "lang_place", "left")


def recognised(docs: DataFrame, names: list[str], counts: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not UNKNOWN; ``lang`` is then the recognised one,
    whatever it was before."""
    if not names:
        return docs.where(F.lit(False))
    found = _best(docs, names, counts, docs.columns).where("lang_place >= 0")
    return found.withColumn("lang", F.col("lang_pred")).select(list(dict.fromkeys([*docs.columns, "lang"])))


def is_held_out() -> F.Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
