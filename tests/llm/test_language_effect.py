"""What the language stage of the pipeline finds decides how documents are packed."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from edgetrail.llm import language_id, packing
from edgetrail.llm.common import ship

EN, DE = "the cat sat on the mat with the other cat", "die Katze saß auf der Matte neben dem Hund"


def table(spark):
    rows = [(i, f"{EN if i % 2 else DE} {i}", None if i > 39 else "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(60, EN, "de", "s", 1), (61, None, "en", "s", 1), (62, "12 34", "en", "s", 1), (None, DE, None, "s", 1), (3, DE, None, "s", 1)]
    return ship(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_lang_is_the_recognised_one(spark, monkeypatch):
    docs = table(spark)
    model = language_id.fit(docs)
    for block in (256, 1):
        monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", block)
        found = language_id.recognised(docs, *model)
        assert found.columns == docs.columns
        got = [(r.doc_id, r.text, r.lang) for r in found.collect()]
        assert sorted(got, key=str) == sorted(((r.doc_id, r.text, "de" if "Katze" in r.text else "en") for r in docs.collect() if r.text and "a" in r.text), key=str)
    without = language_id.recognised(docs.drop("lang"), *model)
    assert without.columns == ["doc_id", "text", "source", "n_chars", "lang"] and without.count() == found.count()


def test_sequences_hold_one_language(spark):
    docs = corpus_pipeline.keep_known_language(spark, table(spark), "")
    lang = {(r.doc_id, r.text): r.lang for r in docs.collect()}
    docs = docs.where("doc_id IS NOT NULL AND text LIKE concat('%', doc_id)")
    of = {i: v for (i, text), v in lang.items() if i is not None and text.endswith(str(i))}
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == set(of) and len(set(of.values())) == 2
    held = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        langs, end = held.get(r.sequence_id, (set(), 0))
        assert r.offset == end
        held[r.sequence_id] = (langs | {of[r.doc_id]}, end + len(r.ids) // 4)
    assert all(len(langs) == 1 and n & (n - 1) == 0 for langs, n in held.values())
    total = sum(n for _, n in held.values())
    mixed = packing.pack_documents(docs, public_tokenizers.path(corpus_pipeline.TOKENIZER)).collect()
    assert total == sum(len(r.ids) // 4 for r in mixed)
    assert any(len({of[r.doc_id] for r in mixed if r.sequence_id == s}) == 2 for s in {r.sequence_id for r in mixed})
