"""Token alignment, text fingerprints and whitening against brute force, and their defined results at the edges."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import public_tokenizers
from edgetrail.llm import queries, text_fingerprint, token_alignment, whitening
from edgetrail.llm.common import ship

SF_DIR = "/root/testdata/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  a  b   c ", "x\n \ny \n", "<|endoftext|>", "a <s> </s> <unk> <0x41> b", "it's 12 34", "ünï　çödé 日本語 текст", "\U0001f600\U0001f600 ok",
    "under ▁ score", "nul \x00 byte", "a" * 3000, "end  ", "\x1c \x1c", "same words here", "same words here", "résumé ﬁne",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 8, "g") for i, t in enumerate(ODD)] + [(None, "no id", 1, 1, ""), (3, None, 1, 1, ""), (15, "same words here", 1, 1, "")]
    return ship(spark).createDataFrame(rows, "doc_id long, text string, chunk long, n_a long, groups string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


# --- token alignment -----------------------------------------------------------------------


def plain_alignment(texts):
    """Per text: ids, groups; by the libraries and sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letter = {c: i for i, c in enumerate(token_alignment.byte_letters())}
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            yield [], [], []
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[x:p], ids_b[y:q]))
            x, y = p, q
        yield ids_a, ids_b, groups


def expected_alignment(rows):
    found = list(plain_alignment([t for _, t in rows]))
    links = [Counter((a, b) for one, two in groups for a in one for b in two) for _, _, groups in found]
    count = Counter(pair for each in links for pair in each)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), (ids_a, ids_b, groups), own in zip(rows, found, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append(
            (doc_id, len(ids_a), len(ids_b), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
             sum(n * count[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if ids_a else "")
        )
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs):
    from pyspark.sql import functions as F

    found = token_alignment.align(docs, BYTE, PIECE)
    found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    return token_alignment.score_links(found)


def key(rows):
    return sorted((tuple(-1 if v is None else v for v in r) for r in rows), key=str)


def test_alignment_of_odd_texts(docs, empty):
    want = expected_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert key(aligned(docs).select(*COLUMNS).collect()) == key(want)
    assert aligned(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"CHUNK_LINKS": 500, "BATCH_BYTES": 3000, "WORK": 7, "WIDE_GROUP": 2}])
def test_alignment_of_the_table(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(token_alignment, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.op11_token_alignment(spark, SF_DIR)
    assert key(got.select(*COLUMNS).collect()) == key(expected_alignment(rows))


def test_alignment_pieces_are_stitched():
    rnd = random.Random(5)
    for _ in range(400):
        total = rnd.randint(1, 60)
        a, b = (np.array(sorted({total, *rnd.sample(range(1, total + 1), rnd.randint(0, total))})) for _ in "ab")
        common = np.intersect1d(a, b)
        for work in (1, 2, 3, 8, 4096):
            i, j = token_alignment.crossings(a, b, work)
            assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
            ends = token_alignment.group_ends(a, b, work)
            assert ends[0].tolist() == (np.searchsorted(a, common) + 1).tolist() and ends[1].tolist() == (np.searchsorted(b, common) + 1).tolist()


def test_alignment_of_very_long_texts(spark):
    texts = [(1, "ab" * 100_000), (2, " " * 200_000 + "x"), (3, "word of a long text. " * 10_000)]
    got = {r.doc_id: r for r in aligned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(r.n_groups > 0 and r.n_links >= r.n_groups for r in got.values())


# --- text fingerprints ---------------------------------------------------------------------


def leaves(print_):
    return [leaf for s in print_.split(":", 1)[1].split("/") for p in s.split(";") for leaf in p.split(",") if leaf]


def test_fingerprint_tree():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choices(["word ", "stop. ", "line\n", "\n\n", "x" * 300, "é", " ", "?!"], k=rnd.randint(0, 80)))
        own = text_fingerprint.fingerprint(text)
        assert sum(int(x[7:]) for x in leaves(own)) == len(text)
        assert own == text_fingerprint.fingerprint(text) and text_fingerprint.likeness(own, own) == 1.0
        other = text_fingerprint.fingerprint(text + "!")
        a, b = Counter(leaves(own)), Counter(leaves(other))
        share = sum(int(x[7:]) * n for x, n in (a & b).items()) * 2 / (2 * len(text) + 1)
        assert text_fingerprint.likeness(own, other) == pytest.approx(min(share, 1 - 2**-30)) and own.split(":")[0] != other.split(":")[0]


def test_fingerprint_locates_edits():
    sentences = [f"Sentence number {i} of this text says {i * i}." for i in range(200)]
    lines = "".join(s + ("\n\n" if i % 20 == 19 else "\n" if i % 5 == 4 else " ") for i, s in enumerate(sentences))
    at = lines.index("number 77 ")
    new = lines[:at] + "NUMBER" + lines[at + 6 :]
    one, two = text_fingerprint.fingerprint(lines), text_fingerprint.fingerprint(new)
    spans = text_fingerprint.changes(one, two)
    assert spans and all(a <= at + 6 and b > at - 200 and b - a < 800 for a, b in spans)
    assert 0.9 < text_fingerprint.likeness(one, two) < 1
    assert text_fingerprint.changes(one, one) == []
    shifted = text_fingerprint.fingerprint("A new start.\n" + lines)
    assert text_fingerprint.likeness(one, shifted) > 0.95


def expected_chain(rows):
    """By plain Python: edited text and likeness of each (doc_id, text), given in order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, other, edited = (text_fingerprint.fingerprint(t) for t in (text, following, new))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, edited, text_fingerprint.likeness(own, edited), text_fingerprint.likeness(own, other)))
    return out


CHAIN = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("partitions", ["4", "37"])
def test_fingerprint_chain_over_the_table(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == "4").lower())
    try:
        rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
        got = queries.op12_text_fingerprint(spark, SF_DIR).select(*CHAIN).collect()
        assert sorted(map(tuple, got)) == sorted(expected_chain(rows))
        assert sum(r.near_edited for r in got) > 2 * sum(r.near_next for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_fingerprint_edges(spark, docs, empty):
    got = text_fingerprint.compare_with_next(docs).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(r.text or "") for r in docs.collect())
    by_text = defaultdict(set)
    for r in text_fingerprint.fingerprints(docs).collect():
        by_text[r.n_chars].add(r.fingerprint)
    assert len({r.fingerprint for r in got if r.doc_id == 15}) == 1
    assert text_fingerprint.compare_with_next(empty).count() == 0 and text_fingerprint.fingerprints(empty).count() == 0
    (one,) = text_fingerprint.compare_with_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    (long,) = text_fingerprint.compare_with_next(spark.createDataFrame([(5, "ab " * 300_000)], "doc_id long, text string")).collect()
    assert long.n_chars == 900_000


# --- whitening -----------------------------------------------------------------------------


def check_whitening(got, rows, components=32):
    """Against whole-number covariances in Python and the definitions of the results."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - total[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(o[j] * o[k] for o in off), n**3)) for k in range(d)] for j in range(d)])
    value = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, int((value > value[0] * 1e-12).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    square = Counter((i, sum(o * o for o in row)) for (i, _), row in zip(kept, off, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == square
    for r in got:
        assert r.explained == pytest.approx(value[r.component - 1] / np.trace(cov), rel=1e-6)
        assert r.identity_error < 1e-6
    by_row = defaultdict(dict)
    for r in got:
        by_row[r.vec_id, r.deviation][r.component] = r.whitened
    if len(by_row) == n:
        w = np.array([[v[c] for c in range(1, k + 1)] for v in by_row.values()])
        w = w - w.mean(axis=0)
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op13_whitening(spark, SF_DIR).collect(), rows)


def test_whitening_edges(spark):
    ship(spark)
    rnd = np.random.default_rng(1)
    schema = "vec_id long, embedding array<double>, n int, component int"
    rows = [(i, rnd.standard_normal(5).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [9.0] * 5), (3, [9.0] * 5)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]

    def frame(data):
        return spark.createDataFrame([(*r, 0, 0) for r in data], schema).repartition(3)

    got = whitening.whiten(frame(rows + odd)).collect()
    check_whitening(got, rows)
    check_whitening(whitening.whiten(frame(rows), 2).collect(), rows, 2)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame(odd[:1])).count() == 0
    assert whitening.whiten(frame([(1, [2.0, 2.0])] * 3)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]  # rank 1
    check_whitening(whitening.whiten(frame(flat)).collect(), flat)
    large = [(i, [float(i) * 1e14, float(i * i % 7), 1.0]) for i in range(12)]
    got = whitening.whiten(frame(large)).collect()
    assert got and all(r.deviation is None for r in got if r.vec_id == 0) and all(r.identity_error < 1e-4 for r in got)
    huge = [(i, [float(i) * 1e300, float(i * i % 7), 1.0]) for i in range(4)]
    assert all(math.isfinite(r.whitened) for r in whitening.whiten(frame(huge)).collect())


def test_product_sums_are_exact():
    rnd = np.random.default_rng(3)
    for high in (1, 2, 300, 1 << 40):
        x = rnd.integers(0, high, (130, 4)).astype(np.uint64)
        x[:, 2] = 0
        bits = np.array([int(v).bit_length() for v in x.max(axis=0)])
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, j], x[:, k], strict=True)) if k >= j else 0 for k in range(4)] for j in range(4)]
        assert whitening.product_sums(x, bits).tolist() == want


# --- legal but unusual inputs of earlier operators -----------------------------------------


def test_html_comments_and_open_quotes():
    from edgetrail.llm.html_text import main_text, parse

    def text(page):
        nodes = parse(page)
        return main_text(nodes, np.ones(len(nodes)))

    assert text("<p>one</p><!--><p>two</p>") == text("<p>one</p><!---><p>two</p>") == "one\ntwo"
    assert text("<p>one</p><!-- x > y --><p>two</p><!-- no end") == "one\ntwo"
    assert text('<p title="x>b</p><p>c</p>') == "b\nc"
    assert text('<p title="a > b">d</p>') == "d"


def test_html_without_marked_articles(spark):
    from edgetrail.llm import html_text

    body = "".join(f"<p>Some longer sentence number {i} of the text that a reader came for, with many words.</p>" for i in range(6))
    rows = [(i, "u", f'<html><body><nav><ul><li><a href="/">home</a></li></ul></nav><div class="post">{body}</div><div id="footer"><p>about</p></div></body></html>') for i in range(5)]
    pages = ship(spark).createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract(pages, html_text.fit(pages)).collect()
    assert all(r.text.count("\n") == 5 and "number 3" in r.text and "home" not in r.text for r in found)
    assert html_text._fitted([]) is None


def test_rotated_codes_of_any_magnitude(spark):
    from edgetrail.llm import rotated_codes

    rnd = np.random.default_rng(2)
    for scale in (1e-200, 1e20, 1e150, 1e300):
        vectors = rnd.standard_normal((60, 8)) * scale * np.exp(rnd.standard_normal((60, 1)))
        df = ship(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r.rank): r.vec_id for r in rotated_codes.nearest(df, 5).collect()}
        assert len(got) == 15
        if scale < 1e100:
            for q in (0, 20, 40):
                score = (vectors / scale) @ (vectors[q] / scale)
                score[q] = -np.inf
                assert [got[q, r] for r in range(1, 6)] == np.argsort(-score)[:5].tolist() or scale < 1


def test_warc_of_far_apart_ids(spark, tmp_path):
    from edgetrail.llm import warc

    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    pages = ship(spark).createDataFrame([(i, "u", f"<p>{i % 3}</p>") for i in ids], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == ids


def test_pipeline_keeps_a_unique_text_of_a_repeated_id(spark):
    import corpus_pipeline

    same, other = "one two three four five six seven eight", "a wholly different text that nothing else here repeats at all"
    rows = [(1, same, "en", "s", 1), (2, same, "en", "s", 1), (2, other, "en", "s", 1), (None, same, "en", "s", 1)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, same), (2, other), (0, same)])
    assert kept.columns == docs.columns
