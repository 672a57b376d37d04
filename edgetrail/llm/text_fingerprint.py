"""Fingerprints of texts as Merkle trees: sentences, paragraphs, sections, root.

A leaf is one sentence or a few, a paragraph ends at a line's end, a section at an empty line; where a text has none of
these, content decides (a leaf's hash), so an edit moves no border far from it. The root hashes all full digests, so
equal roots mean equal texts. Below it the fingerprint holds each leaf's shortened digest and length in the tree's
order: two fingerprints are compared from the root down, and only branches that differ are opened, which gives the
share of text in common and the places of edits.

A fingerprint reads `root:section/section`, a section `paragraph;paragraph`, a paragraph `leaf,leaf`; a leaf is seven
letters of digest and its length in base 10.
"""

from __future__ import annotations

import re
from base64 import urlsafe_b64encode
from collections import Counter
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, rows_of, written

# Sentences with what follows them, of at most a few hundred code points; together they are the whole text.
_SENTENCE = re.compile(r"[^.!?\n]{1,256}[.!?\s]{0,64}|[.!?\s]{1,64}")
_EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")
LEAF, PARAGRAPH, SECTION = 2, 32, 4  # one of so many hashes ends a leaf, paragraph or section where the text does not
_LETTERS = 7
_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("changed_from", pa.int64()), ("part", pa.int32()), ("place", pa.string()), ("text", pa.string())]
)
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed_from long"


def fingerprint(text: str) -> str:
    root = blake2b(str(len(text)).encode(), digest_size=16)
    sections, paragraphs, leaves = [], [], []
    held = ""

    def leaf() -> bytes:
        digest = blake2b(held.encode(), digest_size=16).digest()
        root.update(digest)
        leaves.append(f"{urlsafe_b64encode(digest[:6])[:_LETTERS].decode()}{len(held)}")
        return digest

    for sentence in _SENTENCE.findall(text):
        held += sentence
        line = "\n" in sentence
        if not line and hash_of(sentence) % LEAF:
            continue
        digest = leaf()
        if line or digest[6] % PARAGRAPH == 0:
            paragraphs.append(",".join(leaves))
            leaves = []
            if digest[7] % SECTION == 0 or line and _EMPTY_LINE.search(sentence):
                sections.append(";".join(paragraphs))
                paragraphs = []
        held = ""
    if held:
        leaf()
    if leaves:
        paragraphs.append(",".join(leaves))
    if paragraphs:
        sections.append(";".join(paragraphs))
    return f"{urlsafe_b64encode(root.digest())[:22].decode()}:{'/'.join(sections)}"


def hash_of(sentence: str) -> int:
    return blake2b(sentence.encode(), digest_size=1).digest()[0]


def _branches(print_: str) -> list[str]:
    body = print_.split(":", 1)[1]
    return body.split("/") if body else []


def _length(leaf: str) -> int:
    return int(leaf[_LETTERS:])


def _own_leaves(one: list[str], two: list[str]) -> tuple[list[str], list[str]]:
    """Leaves that only one of two fingerprints has; equal sections and paragraphs are not opened."""
    for cut in (";", ",", None):
        a, b = Counter(one), Counter(two)
        common = a & b
        one, two = list((a - common).elements()), list((b - common).elements())
        if cut:
            one, two = [x for s in one for x in s.split(cut)], [x for s in two for x in s.split(cut)]
    return one, two


def _total(branches: list[str]) -> int:
    return sum(_length(leaf) for s in branches for p in s.split(";") for leaf in p.split(","))


def likeness(one: str, two: str) -> float:
    """Twice the code points of common leaves over those of both texts, 0 to 1; 1 exactly if the roots are equal."""
    if one.split(":", 1)[0] == two.split(":", 1)[0]:
        return 1.0
    a, b = _branches(one), _branches(two)
    total = _total(a) + _total(b)
    left, right = _own_leaves(a, b)
    common = total - sum(map(_length, left)) - sum(map(_length, right))
    return min(common / total, 1 - 2**-30) if total else 0.0


def changes(one: str, two: str) -> list[tuple[int, int]]:
    """Where the second text has leaves that the first has not: (from, to) code points, touching ones joined."""
    if one.split(":", 1)[0] == two.split(":", 1)[0]:
        return []
    _, new = _own_leaves(_branches(one), _branches(two))
    left, at, found = Counter(new), 0, []
    for leaf in (leaf for s in _branches(two) for p in s.split(";") for leaf in p.split(",")):
        to = at + _length(leaf)
        if left[leaf] > 0:
            left[leaf] -= 1
            if found and found[-1][1] == at:
                found[-1] = (found[-1][0], to)
            else:
                found.append((at, to))
        at = to
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every row's whole text.

    A null text counts as empty; an empty one has a root alone. A null doc_id stays null; repeated rows are each
    given; other columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(parts):
        yield from batches(((i, len(t or ""), fingerprint(t or "")) for i, t in rows_of(parts, "doc_id", "text")), schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    new_own = fingerprint(new)
    spans = changes(own, new_own)
    return doc_id, len(text), sha256(new.encode()).hexdigest(), own, new_own, likeness(own, new_own), likeness(own, next_own), spans[0][0] if spans else None


def _chain(parts):
    """Each row of a sorted partition against the next one; its first and last rows are given as they are."""
    part = TaskContext.get().partitionId()

    def rows():
        last = None
        for doc_id, text in rows_of(parts, "doc_id", "text"):
            own = fingerprint(text)
            if last is None:
                yield doc_id, None, None, own, None, None, None, None, part, "first", text
            else:
                yield *_compared(*last, text, own), part, None, None
            last = doc_id, text, own
        if last:
            yield last[0], None, None, last[2], None, None, None, None, part, "last", last[1]

    yield from batches(rows(), _ROWS)


def _across(parts):
    """The last row of a partition against the first of the next."""
    schema = pa.schema(list(_ROWS)[:8])
    yield from batches((_compared(*row) for row in rows_of(parts, "doc_id", "text", "fingerprint", "next_text", "next_fingerprint")), schema)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint against that of its edited text and that of the next row.

    Rows follow each other by doc_id, nulls first, equal ids by a hash of the text and then by place; after the last
    comes the first. The edited text is edited(text, next text). changed_from is the first code point of the edited
    text whose leaf is new, null if there is none. A null text counts as empty; repeated rows are compared each; a
    single row follows itself; other columns are ignored; an empty table gives no rows.

    Texts are range-sorted, shuffled once, and compared within partitions. Only the first and last row of each
    partition is given out with its text, and these meet in a join on the partitions' numbers, which alone reach the
    driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    order = ["doc_id", "h", "at"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(placed.mapInArrow(_chain, f"{_COLUMNS}, part int, place string, text string"), "chained")
    first, last = (found.where(F.col("place") == p) for p in ("first", "last"))
    parts = sorted(r.part for r in first.select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = last.select("doc_id", "text", "fingerprint", "part").join(after, "part").join(heads, "next_part")
    ends = ends.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_across, _COLUMNS)
    return found.where("place IS NULL").select(*ends.columns).unionByName(ends)
