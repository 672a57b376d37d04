"""The training-text operators against brute force, and their defined results at the edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter as Counts
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, difference

import public_tokenizers
from edgetrail.llm import chat_format, checks, decontamination, html_text, language_id, lm_scoring, near_dedup, packing, queries, rotated_codes, token_counts, warc
from edgetrail.llm.bpe import Counter, Encoder, tokenizer_text
from edgetrail.llm.common import new_path, ship
from edgetrail.llm.shingles import hashed, shingle_set, spaced_words

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "  a  b   c ", "x\n \ny \n", "tab\t end ", "<|endoftext|>", "a <|endoftext|>  b", "it's we'll 12 34", "ünï 　 çödé  日本語 текст",
    "\U0001f600 \U0001f600", "a" * 3000, "é " * 50, "end  ", "\x1c \x1c", "!!! ??? ...", "\\ <| |> <|end|> \\<|turn|>",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)]
    rows += [(None, "no id at all here now", "en", None, 1), (100, None, None, None, None), (101, "same words in this text twice", "en", "s", 1), (101, "same words in this text twice", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return ship(spark).createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(checks.CHECKS))
def test_sql(spark, name):
    assert difference(spark, connect(SF_DIR), queries.QUERIES[name], checks.CHECKS[name], SF_DIR) is None


def test_encoder_and_counter_equal_the_library(library):
    text = tokenizer_text(PATH)
    encoder, counter = Encoder(text), Counter(text)
    rnd = random.Random(3)
    pieces = ["word", " ", "  ", "\n", "\t", ".", "'s", "é", "日", "9", "<|endoftext|>", " ", "\x1c", "Ab", "-", "\r\n"]
    for t in ODD + ["".join(rnd.choices(pieces, k=rnd.randint(1, 12))) for _ in range(3000)]:
        want = ids_of(library, t)
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == want, repr(t)
        assert counter.count(t) == len(want), repr(t)


def test_encoder_encodes_the_words_of_many_texts_once(library, monkeypatch):
    encoder = Encoder(tokenizer_text(PATH))
    rnd = random.Random(5)
    pieces = ["word", " ", "  ", "\n", "\t", ".", "'s", "é", "<|endoftext|>", " a", " \n", "\x85", "\u3000"]
    for size in (0, 1, 2, 30):
        for _ in range(40):
            texts = [rnd.choice([None, "", "same words", "".join(rnd.choices(pieces, k=rnd.randint(1, 9)))]) for _ in range(size)]
            ids, ends = encoder.many(pa.array(["cut off", *texts], pa.string())[1:])
            assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [ids_of(library, t) for t in texts]
    given = []
    monkeypatch.setattr(encoder, "plain", lambda text, plain=encoder.plain: given.append(text) or plain(text))
    encoder.many(pa.array(["one two three two", "two three two", "three two"], pa.string()))
    joined, *firsts = given
    assert sorted(joined.split()) == ["one", "three", "two"] and firsts == ["one", "two", "three"]


def test_packing_takes_texts_by_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BYTES", 10)
    texts = ["aaaa", None, "é" * 3, "b", "c" * 50, "", "dddd", "e" * 6, "f"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x", *texts], pa.string())}).slice(1)
    got = [b.column("text").to_pylist() for b in packing._texts([batch, batch.slice(0, 0)])]
    assert got == [["aaaa", None, "é" * 3], ["b"], ["c" * 50], ["", "dddd", "e" * 6], ["f"]]


def test_token_counts(spark, docs, empty, library):
    got = token_counts.token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, len(ids_of(library, r.text))) for r in docs.collect())
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty, PATH).count() == 0


def check_packing(pieces, texts, library, window):
    """Each id in exactly one piece, gapless sequences, no padding."""
    full = [[*ids_of(library, t), 0] for t in texts]
    want = sum(map(len, full))
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, np.frombuffer(p.ids, "<u4")))
    got = 0
    for parts in by_sequence.values():
        at = 0
        for offset, ids in sorted(parts, key=lambda x: x[0]):
            assert offset == at and len(ids)
            at += len(ids)
        assert at <= window and at & (at - 1) == 0
        got += at
    assert got == want


def test_packing(spark, docs, empty, library):
    for window in (64, 1024):
        pieces = packing.pack_documents(docs, PATH, window).collect()
        check_packing(pieces, [r.text for r in docs.collect()], library, window)
        one = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces if p.doc_id == 9)
        assert [x for _, ids in one for x in ids] == [*ids_of(library, ODD[9]), 0]
    assert packing.pack_documents(empty, PATH).count() == 0


def test_packing_takes_alike_neighbours():
    tails = [np.array(x, "<u4") for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    index = packing.Postings(tails, np.ones(10), 3.0)
    unused = np.array([False, True, True, True])
    assert next(index.best(tails[0], unused)) == 2
    assert list(index.best(np.array([0], "<u4"), unused)) == [1, 2, 3]


def test_packing_searches_a_whole_shard(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rnd = np.random.default_rng(4)
    tails = [rnd.integers(0, 500, 30).astype("<u4") for _ in range(1024)]
    tails[0], tails[900] = np.array([600, 601, 602], "<u4"), np.array([600, 601, 603], "<u4")  # over 512 rows apart
    columns = {"doc_id": range(1024), "n": [len(t) for t in tails], "tail": [t.tobytes() for t in tails]}
    bags = [np.unique(t, return_counts=True) for t in tails]
    columns |= {"terms": [t.tobytes() for t, _ in bags], "times": [n.astype("<u4").tobytes() for _, n in bags]}
    index = SimpleNamespace(value=(np.ones(1000), 30.0))
    rows = [r for b in packing._packer(index, 64)(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    first = sorted((r["offset"], r["doc_id"]) for r in rows if r["sequence_id"] == 1)
    assert [d for _, d in first[:2]] == [0, 900]


def test_packing_describes_whole_documents(library):
    """Frequencies and terms count the ids of bodies too, so documents with alike bodies and unlike tails are neighbours."""
    same = " ".join(["river", "stone"] * 40)
    texts = [same + " alpha beta gamma", "cat dog cat cow cat", same + " one two three", "cat dog pig dog cow"]
    parts = [pa.RecordBatch.from_pydict({"doc_id": range(4), "text": texts})]
    rows = [r for b in packing._tokenize(SimpleNamespace(value=tokenizer_text(PATH)), 16)(iter(parts)) for r in b.to_pylist()]
    full = [[*ids_of(library, t), 0] for t in texts]
    for r, ids in zip(rows, full, strict=True):
        assert dict(zip(np.frombuffer(r["terms"], "<u4").tolist(), np.frombuffer(r["times"], "<u4").tolist(), strict=True)) == {i: ids.count(i) for i in ids}
    river = ids_of(library, " river")[0]
    (found,) = packing._frequencies([pa.RecordBatch.from_pylist(rows)])
    counts = dict(zip(*(c.to_pylist() for c in found.columns), strict=True))
    assert counts[river] == 2 and counts[-1] == 4 and counts[-2] == sum(map(len, full))
    bags = [(np.frombuffer(r["terms"], "<u4"), np.frombuffer(r["times"], "<u4")) for r in rows]
    index = packing.Postings([t for t, _ in bags], np.ones(60_000), 10.0, [n for _, n in bags])
    assert next(index.best(bags[0][0], np.array([False, True, True, True]))) == 2


def test_packing_drops_used_postings_without_changing_scores():
    rnd = np.random.default_rng(6)
    tails = [rnd.integers(0, 200, rnd.integers(1, 60)).astype("<u4") for _ in range(300)]
    lists, whole = (packing.Postings(tails, np.linspace(0.1, 2, 200), 30.0) for _ in range(2))
    unused = np.ones(300, bool)
    for i in rnd.permutation(300)[:290]:
        unused[i] = False
        whole.held = 0  # never drops
        assert list(lists.best(tails[i], unused)) == list(whole.best(tails[i], unused))
    assert len(lists.tail) < len(whole.tail) / 4


def test_packing_query(spark, library):
    rows = queries.op1_packing(spark, SF_DIR).collect()
    texts = {r["doc_id"]: np.array([*ids_of(library, r["text"]), 0], "<u4") for r in pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()}
    for r in rows:
        assert zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))


def links(texts, size=4):
    sets = {i: set(shingle_set(hashed(spaced_words(t or "")), size).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, docs, empty):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts, at = {}, 0
    for _ in range(6):  # stars, chains of edits and short texts
        base = rnd.choices(words, k=rnd.choice([12, 60, 300]))
        chain = list(base)
        for _ in range(25):
            chain[rnd.randrange(len(chain))] = rnd.choice(words)
            star = [w if rnd.random() > 0.03 else rnd.choice(words) for w in base]
            texts[at], texts[at + 1] = " ".join(chain), " ".join(star)
            at += 2
    texts |= {at: "One  two", at + 1: "one TWO\n", at + 2: "one", at + 3: "", at + 4: None, at + 5: "É", at + 6: "é"}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == links(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = near_dedup.near_duplicates(docs).collect()
    assert len(odd) == docs.count() and [r.kept for r in odd if r.doc_id is None] == [None] and [r.component_id for r in odd if r.doc_id == 101] == [101, 101]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_hot_family_write_no_pairs_of_members(spark, monkeypatch):
    rnd, tables, written = random.Random(7), {}, near_dedup.written
    base = [f"b{i}" for i in range(200)]

    def member():  # any two share 173 of 197 shingles each: a similarity of 0.78
        return [f"x{rnd.getrandbits(60)}" if i % 32 == 16 else w for i, w in enumerate(base)]

    members = [member() for _ in range(300)]
    twins = [[*m[:-1], "other"] for m in members[::30]]  # alike, but not like the center of their buckets
    texts = dict(enumerate(" ".join(w) for w in members + twins))

    def counted(df, name):
        df = written(df, name)
        tables[name] = max(tables.get(name, 0), df.count())
        return df

    monkeypatch.setattr(near_dedup, "written", counted)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 50)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == links(texts)
    assert sum(not r.kept for r in got) == len(twins)
    assert max(tables.values()) <= near_dedup.BANDS * len(texts)


def test_near_duplicates_count_what_sets_share(monkeypatch):
    rnd = np.random.default_rng(8)

    def rows(sets):
        return np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets)

    for _ in range(200):
        for name, some in (("FREQUENT", [1, 4, 256, 10**9]), ("COLUMNS", [1, 3, 1024]), ("CELLS", [1, 7, 1 << 22])):
            monkeypatch.setattr(near_dedup, name, int(rnd.choice(some)))
        a, b = ([np.flatnonzero(rnd.random(60) < rnd.random()) for _ in range(rnd.integers(1, 12))] for _ in range(2))
        got = near_dedup._common(rows(a), rows(b), (len(a), len(b)))
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "x " * 500 + item.upper().replace(" ", ", ") + " y" * 500), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (4, "tiny words"), (None, item)]
    bench = spark.createDataFrame([(1, item, 0), (2, "tiny words", 0), (3, None, 0), (4, "", 0), (1, item, 0)], "item_id long, text string, doc_id int")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 1), (-1, 1), (1, 1), (1, 1), (4, 2)]
    clean = decontamination.clean(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, item_id string"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3] and clean.columns == ["doc_id", "text", "item_id"]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_language(spark, docs, empty):
    rows = queries.op4_language_id(spark, SF_DIR).collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, *model).collect()}
    assert got[0].lang_pred == got[15].lang_pred == got[100].lang_pred == "und" and got[0].score == 0
    assert got[2].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, *language_id.fit(empty)).collect()} == {"und"}
    assert language_id.recognised(docs, *model).columns == docs.columns


def test_language_learns_rare_languages(spark):
    rows = [(i, f"common words here {i}", "en") for i in range(3000)] + [(3000, "öæå þðø ßœé", "xx"), (None, "жщы эюя", "yy")]
    names, counts = language_id.fit(ship(spark).createDataFrame(rows, "doc_id long, text string, lang string"), 300)
    assert names == ["en", "xx", "yy"]
    asked = spark.createDataFrame([(1, "þðø œé"), (2, "жщы"), (3, "words here")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(asked, names, counts).orderBy("doc_id").collect()] == ["xx", "yy", "en"]


def plain_ngrams(text):
    """Buckets of a text's n-grams, counted word by word in plain Python."""
    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
        spread = ((h ^ h >> 15) * 0x2C1B3C6D + len(gram) * 0x297A2D39) & 0xFFFFFFFF
        return (spread ^ spread >> 13) & (language_id.BUCKETS - 1)

    found = Counts([bucket((0, 0))])
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split(" "):
        codes = [0, *map(ord, word), 0] if word else []
        for n in (1, 2, 3, 4):
            found.update(bucket(g) for g in zip(*(codes[i:] for i in range(n))) if all(g[1:-1]) and (n > 1 or g[0]))
    return found


@pytest.mark.parametrize("block", [1, 2, 256])
def test_language_against_plain_naive_bayes(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", block)
    pool = {"aa": "abc de fgh", "bb": "abd ce fhg", "cc": "xyz abc öü", "dd": "жщ ab юя", "ee": "abc de fgh"}
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choices(pool[lang].split(), k=pick.randint(1, 9))) + "! 1", lang) for i in range(90) for lang in pool]
    asked = [(i, t) for i, t in enumerate([None, "", "12 !", "abc", "fhg ce ab", "ÖÜ xyz", "Жщ-юя, q", "abc " * 70_000, *(r[1] for r in rows[:40])])]
    frame = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), *language_id.fit(frame)).collect()
    counts = {lang: sum((plain_ngrams(t) for _, t, x in rows if x == lang), Counts()) for lang in pool}
    whole = {lang: counts[lang].total() + language_id.SMOOTHING * language_id.BUCKETS for lang in pool}
    assert len(got) == len(asked)
    for r in got:
        text = asked[r.doc_id][1] or ""
        grams = plain_ngrams(text)
        logs = {x: sum(n * np.log((counts[x][g] + language_id.SMOOTHING) / whole[x]) for g, n in grams.items()) for x in pool}
        top = max(logs.values())
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        assert logs[r.lang_pred] == pytest.approx(top, rel=1e-6)
        assert r.score == pytest.approx(1 / sum(np.exp((v - top) / np.sqrt(grams.total())) for v in logs.values()), rel=1e-3)


def test_language_has_no_bound_of_one_matrix(spark):
    rows = [(i, f"{chr(0x4E00 + i)} w", f"l{i:04}") for i in range(600)]
    frame = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(frame, *language_id.fit(frame)).collect()
    assert len(got) == 600 and all(r.lang_pred == f"l{r.doc_id:04}" for r in got)


def test_language_segments():
    text = "".join(random.Random(1).choices("abc dé", k=900_000))
    codes = language_id.letters(text)
    whole = language_id.ngrams(codes, len(codes))
    parts = np.concatenate([language_id.ngrams(p, n) for p, n in language_id.segments(codes)], axis=1)
    assert (np.sort(whole, axis=1) == np.sort(parts, axis=1)).all()


def test_chat_format(spark):
    ship(spark)
    first = [("user", ODD[-1]), ("assistant", "<|text|>\\"), ("user", "")]
    rows = []
    for conv in range(60):  # one tree with shared turns, copies and prefixes of others
        for turn, (role, text) in enumerate([*first, ("assistant", f"answer {conv // 4}"), ("user", f"more {conv}")][: 2 + conv % 4]):
            rows.append((conv, turn, role, text, "x"))
    rows += [(500, None, None, None, "x"), (500, 0, "user", "a", "x"), (500, 0, "user", "a", "x"), (None, 0, "user", "lost", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    nodes = chat_format.format_conversations(frame, PATH)
    got = {r.conv_id: r for r in chat_format.read_back(nodes, PATH).collect()}
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {c: chat_format.parsed(r.formatted) for c, r in got.items()} == want
    assert all(r.loss == "".join(t for role, t in want[c] if role == "assistant") for c, r in got.items())
    digests = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(nodes, PATH)).collect()}
    for c, turns in want.items():
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and digests[c].n_turns == len(turns)
    for n in nodes.collect():  # positions count along the path, and intervals are the path's
        assert n.first_position == sum(a["to"] - a["from"] for a in n.ancestors) and len(n.ancestors) == n.depth
    assert chat_format.format_conversations(frame.limit(0), PATH).count() == 0


def test_warc(spark):
    ship(spark)
    rows = [(i, f"http://a/{i} b\r\nX: y", "same" if i % 3 == 0 else f"<p>{i} é</p>" * i, 1) for i in range(40)]
    rows += [(50, None, None, 1), (51, "", "", 1), (None, "u", "same", 1), (7, "http://again", "other", 1), (39, "u", "same", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    path = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages, path, roll_bytes=1500, per_shard=10)
    got = warc.read_warc(manifest, path).collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect()) and manifest.count() > 4
    holder = {}
    for page_id, _, html, _ in rows:
        holder[html or ""] = max(holder.get(html or "", -1), -1 if page_id is None else page_id)
    want = sorted(
        (str(p), len((h or "").encode()), warc.base32(hashlib.sha1((h or "").encode()).digest()), "response" if p is None or p == holder[h or ""] else "revisit", None if p is None or p == holder[h or ""] else holder[h or ""])
        for p, _, h, _ in rows
    )
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    again = new_path(spark, "warc-test")
    second = warc.write_warc(pages.repartition(7), again, roll_bytes=1500, per_shard=10)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, second.collect()))  # the same bytes
    none = new_path(spark, "warc-test")
    assert warc.read_warc(warc.write_warc(pages.limit(0), none), none).count() == 0


def test_vectors(spark):
    ship(spark)
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.standard_normal(24).tolist()) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 1200)] + [(1200, None), (1201, [0.0] * 24), (1202, [float("nan")] * 24), (1203, [None] * 24), (1204, []), (1205, rows[5][1]), (1205, rows[5][1])]
    got = rotated_codes.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")).collect()
    good = {i: np.array(np.array(v, np.float32), float) for i, v in rows if v and v[0] is not None and np.isfinite(v[0]) and any(v)}
    ids = np.array(sorted(good))
    matrix = np.array([good[i] for i in ids])
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q in ids[ids % 20 == 0]:
        scores = np.array([sum(a * b for a, b in zip(good[q], v, strict=True)) for v in matrix])
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits = sorted(mine[q])
        assert [r for r, _, _ in hits] == list(range(1, 21)) and [s for _, _, s in hits] == sorted((s for _, _, s in hits), reverse=True)
        found += len({v for _, v, _ in hits} & {int(ids[i]) for i in order})
        total += 20
    assert len(mine) == (ids % 20 == 0).sum() and found / total > 0.99
    assert len(rotated_codes.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")).collect()) == 1
    assert rotated_codes.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_models(spark, docs, empty):
    rows = [(1, "a b a b c"), (2, "a b A, b"), (3, "x y z"), (4, None), (5, "!!"), (3, "x y z")]
    got = lm_scoring.score_documents(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, word int"), spark.createDataFrame([(1,), (None,), (9,)], "doc_id long"), 4).collect()
    texts = [[w.strip(",!").lower() for w in (t or "").split() if w.strip(",!")] for _, t in rows]
    count = {}
    for t in texts:
        for w in t:
            count[w] = count.get(w, 0) + 1
    known = sorted(count, key=lambda w: (-count[w], w))[:4]
    seen = [["<s>", *(w if w in known else "?" for w in t)] for t in texts]

    def loss(path, corpus):
        words = [w for t in corpus for w in t[1:]]
        pairs = [p for t in corpus for p in zip(t, t[1:], strict=False)]
        before = [a for a, _ in pairs]
        mass = lm_scoring.MASS * len(words) / sum(len(t) - 1 for t in seen)
        alone = lambda w: (words.count(w) + mass / 5) / (len(words) + mass)
        return np.mean([-np.log(lm_scoring.MIX * pairs.count(p) / max(1, before.count(p[0])) + (1 - lm_scoring.MIX) * alone(p[1])) for p in zip(path, path[1:], strict=False)])

    want = sorted((d, len(t) - 1, round(loss(t, seen[:1]), 9) if len(t) > 1 else -1, round(loss(t, seen), 9) if len(t) > 1 else -1) for (d, _), t in zip(rows, seen, strict=True))
    assert sorted((r.doc_id, r.n_tokens, -1 if r.loss_target is None else round(r.loss_target, 9), -1 if r.loss_target is None else round(r.loss_background, 9)) for r in got) == want
    none = docs.select("doc_id").limit(0)
    assert lm_scoring.score_documents(docs, none).count() == docs.count() and lm_scoring.score_documents(empty, none).count() == 0


def test_language_models_know_every_word(spark, monkeypatch):
    """With more words than 32,768, a bigram of two rare words keeps its own counts, also over several blocks."""
    ship(spark)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 100_000)
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 34_000, 1000)] * 2 + ["rare once", "odd thing"]
    seen = [["<s>", *t.split()] for t in texts]
    pairs, before, words = Counts(), Counts(), Counts()
    for t in seen:
        pairs.update(zip(t, t[1:], strict=False))
        before.update(t[:-1])
        words.update(t[1:])
    n, v = words.total(), len(words) + 1
    alone = lambda w: (words[w] + lm_scoring.MASS / v) / (n + lm_scoring.MASS)
    want = [np.mean([-np.log(lm_scoring.MIX * pairs[p] / before[p[0]] + (1 - lm_scoring.MIX) * alone(p[1])) for p in zip(t, t[1:], strict=False)]) for t in seen]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(lm_scoring.score_documents(frame, frame.select("doc_id").where("doc_id >= 68")).collect())
    assert np.allclose([r.loss_background for r in got], want, rtol=0, atol=1e-9)
    assert all(r.score < 0 for r in got[68:]) and all(r.score > 0 for r in got[:68])


def test_language_models_of_wordless_and_very_long_texts(spark):
    """A block without a bigram sends no run; a text of 300,000 words is scored whole."""
    ship(spark)
    texts = [None, "", "!!", "...", "one two " * 150_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(lm_scoring.score_documents(frame.where("doc_id < 4"), frame.select("doc_id")).collect())
    assert [(r.n_tokens, r.loss_target, r.score) for r in got] == [(0, None, None)] * 4
    got = sorted(lm_scoring.score_documents(frame, frame.select("doc_id")).collect())
    assert [r.n_tokens for r in got] == [0, 0, 0, 0, 300_000] and got[4].score == 0


def test_language_model_runs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**62, 1000), rng.integers(0, 3, 1000)
    assert np.array_equal(lm_scoring._decoded(lm_scoring._coded(a, b), 2, 1000), [a, b])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">menu</a></li></ul></nav><article><h1>Title
 here</h1><p><b>First &amp; second.<br><p>Third   one.</p><script>var a = "<p>no</p>";</script><div class="ad">buy</div></article><footer>&copy;</footer>"""


def test_html(spark):
    ship(spark)
    nodes = html_text.parse(PAGE)
    truth = html_text.weak_truth(nodes)
    assert html_text.main_text(nodes, [bool(t) for t in truth]) == "Title here\nFirst & second.\nThird one."
    frame = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = html_text.fit(frame)
    deep = "<div>" * 3000 + "x" + "</p></b>" * 10
    odd = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", deep, 0), (4, "u", "<p", 0), (5, "u", "<!-- a", 0), (6, "u", "plain < text & more", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(odd, model).collect()}
    assert got[1] == "Title here\nFirst & second.\nThird one." and got[2] == got[None] == "" and len(got) == 7
    assert html_text.extract(frame.limit(0), html_text.fit(frame.limit(0))).count() == 0


@pytest.mark.parametrize("part", ["<svg viewBox='0'/>", "<svg><path d='x'/>", "<svg><text>no</text></svg>", "<div><object>no</div>", "<div><canvas>no<p>no</div>", "<noscript><p>no</p></noscript>", "<p><template><p>no</template></p>"])
def test_html_goes_on_after_dropped_elements(part):
    nodes = html_text.parse(f"<article><p>one</p>{part}<p>two</p></article><p>three</p>")
    assert html_text.main_text(nodes, [True] * len(nodes)) == "one\ntwo\nthree"


def test_html_place_among_many_siblings():
    nodes = html_text.parse("<ul>" + "<li>x</li>" * 100 + "</ul>")
    places = html_text.features(nodes)[2:, len(html_text.TAGS) + 14]
    assert np.allclose(places, np.arange(100) / 100)


def test_html_accuracy_on_held_out_variants(spark):
    pages = pq.read_table(f"{SF_DIR}/pages.parquet").column("html").to_pylist()
    model = html_text.fit(ship(spark).read.parquet(f"{SF_DIR}/pages.parquet").limit(25), 25)
    right = total = 0
    for i, page in enumerate(p for p in pages[25:] if p):
        for text in html_text.variants(page, 10_000 + i):
            nodes = html_text.parse(text)
            found = html_text.weak_truth(nodes)
            if found is None:  # a page without content has no truth to hold it against
                continue
            truth = [bool(t) for t in found]
            right += html_text.main_text(nodes, html_text.decode(nodes, model.odds(html_text.features(nodes)))) == html_text.main_text(nodes, truth)
            total += 1
    assert right / total > 0.95, right / total


def test_pipeline(spark):
    import corpus_pipeline

    docs = ship(spark).read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()}
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    roots = links(kept)
    items = decontamination.Items([(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()], 5)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = new_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    want = {i for i in kept if roots[i] == i and not list(items.found(texts[i], 0.8))}
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().collect()} == want
