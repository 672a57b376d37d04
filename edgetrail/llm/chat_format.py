"""Conversations as prefix trees: shared first turns are written once, with attention intervals over ancestors.

Each conversation is a path of turns. Paths are sorted by the hashes of their prefixes, which is a depth-first order
of the prefix tree, and conv_id breaks ties, so a first turn that a third of all conversations share is dealt over
many tasks. A task walks its sorted paths and writes a node whenever a path leaves the one before; a pack is closed
when it holds PACK_TOKENS and the next path would add to it, and the next pack repeats the open path once.

A node's tokens are ids of its formatted turn. Position ids count from the root along the path, and a node attends to
the token intervals of its ancestors and to itself. Every conversation points to the node of its last turn.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.bpe import once, tokenizer_text
from edgetrail.llm.common import batches, rows_of

# The template's control strings. Inside texts and roles a backslash stands before each backslash and after each "<" that "|" follows.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PACK_TOKENS = 65_536
NODES = (
    "pack_id long, node long, parent long, depth int, ids array<int>, first_token long, first_position long, "
    "loss_from int, loss_to int, ancestors array<struct<from:long,to:long>>, conv_ids array<long>"
)
_INTERVAL = pa.struct([("from", pa.int64()), ("to", pa.int64())])
_NODES = pa.schema(
    [
        ("pack_id", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("ids", pa.list_(pa.int32())),
        ("first_token", pa.int64()), ("first_position", pa.int64()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
        ("ancestors", pa.list_(_INTERVAL)), ("conv_ids", pa.list_(pa.int64())),
    ]
)


def escaped(text: str) -> str:
    """Without any control string: each backslash is doubled and a "<" before a "|" gets a backslash."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(TURN).partition(TEXT)
        turns.append((unescaped(role), unescaped(text)))
    return turns


class Codec:
    """Ids of ordinary text and back; special strings in a text are ordinary here."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def format_conversations(turns: DataFrame, tokenizer_path: str, trained: str = "assistant") -> DataFrame:
    """The nodes of all packs from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; a null turn comes first; null roles and texts are empty. Repeated
    rows are turns of their own. Rows with a null conv_id form one conversation. Tokens of a text whose role is
    trained lie under the loss mask: loss_from to loss_to within the node's ids. Other columns are ignored.
    """
    sc = turns.sparkSession.sparkContext
    vocabulary = sc.broadcast(tokenizer_text(tokenizer_path))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # The order of a depth-first walk: a hash of each prefix, one after the other.
    prefix = F.aggregate("turns", F.array().cast("array<long>"), lambda seen, t: F.concat(seen, F.array(F.xxhash64(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)), t["role"], t["text"]))))
    role, text = F.transform("turns", lambda t: t["role"]), F.transform("turns", lambda t: t["text"])
    keyed = paths.select("conv_id", role.alias("roles"), text.alias("texts"), prefix.alias("path"))
    placed = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def pack(parts):
        codec = once(Codec, vocabulary.value)
        base = TaskContext.get().partitionId() << 32

        def rows_out():
            pack_id, tokens, count = base, 0, 0
            opened: list[dict] = []  # the nodes of the path that is open now, root first
            turn, text_mark, end = codec.ids(TURN), codec.ids(TEXT), codec.ids(END)
            for conv_id, path, roles, texts in rows_of(parts, "conv_id", "path", "roles", "texts"):
                same = 0
                while same < min(len(opened), len(path)) and opened[same]["turn"] == (path[same], roles[same], texts[same]):
                    same += 1
                for node in reversed(opened[same:]):
                    yield _row(node)
                del opened[same:]
                if tokens >= PACK_TOKENS and same < len(path):
                    for node in reversed(opened):
                        yield _row(node)
                    pack_id, tokens, count, opened, same = pack_id + 1, 0, 0, [], 0
                for key, role, text in list(zip(path, roles, texts, strict=True))[same:]:
                    head, body = [*turn, *codec.ids(escaped(role)), *text_mark], codec.ids(escaped(text))
                    ids, up = [*head, *body, *end], opened[-1] if opened else None
                    span = (len(head), len(head) + len(body)) if role == trained else (0, 0)
                    opened.append({
                        "turn": (key, role, text), "pack": pack_id, "node": count, "parent": up and up["node"], "depth": len(opened), "ids": ids, "from": tokens,
                        "position": up["position"] + len(up["ids"]) if up else 0, "loss": span,
                        "above": [*up["above"], {"from": up["from"], "to": up["from"] + len(up["ids"])}] if up else [], "convs": [],
                    })
                    count, tokens = count + 1, tokens + len(ids)
                if len(opened[-1]["convs"]) >= 1024:  # a leaf of very many copies is written in several rows
                    yield _row(opened[-1])
                    opened[-1]["convs"] = []
                opened[-1]["convs"].append(conv_id)
            for node in reversed(opened):
                yield _row(node)

        yield from batches(rows_out(), _NODES, 256)

    return placed.mapInArrow(pack, NODES)


def _row(n: dict) -> tuple:
    return n["pack"], n["node"], n["parent"], n["depth"], n["ids"], n["from"], n["position"], *n["loss"], n["above"], n["convs"]


def read_back(nodes: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, formatted (its whole text in the template) and loss (all text under the mask, unescaped), from the
    tokens that its last turn attends to."""
    vocabulary = nodes.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.string())])

    def read(parts):
        codec = once(Codec, vocabulary.value)

        def rows():
            spans: dict[int, tuple[str, str]] = {}
            waiting: list[tuple] = []
            pack = None
            for pack_id, first, ids, a, b, above, convs in rows_of(parts, "pack_id", "first_token", "ids", "loss_from", "loss_to", "ancestors", "conv_ids"):
                if pack_id != pack:
                    yield from _joined(waiting, spans)
                    spans, waiting, pack = {}, [], pack_id
                if first not in spans:
                    spans[first] = codec.text(ids), unescaped(codec.text(ids[a:b]))
                if convs:
                    waiting.append((convs, [*(x["from"] for x in above), first]))
            yield from _joined(waiting, spans)

        yield from batches(rows(), schema, 256)

    return nodes.repartition("pack_id").sortWithinPartitions("pack_id").mapInArrow(read, "conv_id long, formatted string, loss string")


def _joined(waiting: list[tuple], spans: dict):
    for convs, path in waiting:
        formatted, loss = "".join(spans[x][0] for x in path), "".join(spans[x][1] for x in path)
        for conv_id in convs:
            yield conv_id, formatted, loss


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of conversations read back."""
    # A formatted text holds no END inside a turn, so turns are found by splitting; escapes go last.
    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    turns = F.filter(F.split("formatted", re.escape(END), -1), lambda t: t != "")
    said = F.transform(turns, lambda t: F.concat(plain(F.regexp_extract(t, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)), F.lit("\n"), plain(F.regexp_extract(t, r"(?s)^<\|turn\|>.*?<\|text\|>(.*)$", 1)), F.lit("\n")))
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
