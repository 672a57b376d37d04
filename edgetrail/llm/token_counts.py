"""Token counts of whole texts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from edgetrail.llm.bpe import Counter, once, tokenizer_text
from edgetrail.llm.common import batches, rows_of


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row.

    The text is counted whole. A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated
    rows are counted each; other columns are ignored. A special string inside a text is one token. Nothing is
    shuffled: each row depends on itself only.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(parts):
        counter = once(Counter, vocabulary.value)

        def rows():
            for doc_id, text in rows_of(parts, "doc_id", "text"):
                n = counter.count(text) if text else 0
                yield doc_id, len(text.encode("utf-8")) if text else 0, n, n > limit

        yield from batches(rows(), schema, 4096)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
