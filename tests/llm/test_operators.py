"""The operators against brute force, on edge cases and on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (
    components,
    decontamination,
    harmonic_packing,
    language_crf,
    license_rules,
    license_scan,
    multi_index,
    quality_gam,
    shared,
    simhash,
    token_counts,
    token_ids,
    token_matrices,
    warc,
)
from tidemark.llm.bpe import TokenCounter

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LONG = "x" * 3000 + " word" * 30_000
#: Null, empty, blank, long, repeated; the extra columns have names that operators use themselves.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b c"), (5, "a b c"), (6, "a b c"), (None, "a b c"), (7, "Größe 你好 😀 <|endoftext|> x")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", "s", None, "z", 1.0, 0, b"", 5) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, id long, ids binary, start int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def odd_texts(n=1500):
    rng = random.Random(1)
    some = "ab  \n\t'sé²Ⅷ½一   \x1c\x85_!#İ´"
    wide = [(32, 0xD7FF), (32, 900), (0xE000, 0x1FFFF)]
    out = ["", "a" * 5000, "aaa aaaa  aa", " <|endoftext|> x<|endoftext|>", "  ", "x \n", " y", LONG]
    out += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", "<|endof"]) for _ in range(n)]
    return out + ["".join(chr(rng.randrange(*rng.choice(wide))) for _ in range(40)) for _ in range(n // 3)]


def test_token_counts(spark, sf, edges, docs, library):
    texts = odd_texts()
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert TokenCounter(VOCAB, cache=50, batch_bytes=1000).count(texts) == expected
    got = {r.doc_id: r for r in token_counts.op10_token_counts(spark, sf).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {
        i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs.items()
    }
    rows = token_counts.count_tokens(edges, VOCAB).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES)
    assert token_counts.count_tokens(edges.where("false"), VOCAB).count() == 0
    for other in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert token_counts.counter(public_tokenizers.path(other)).count(["Hello there"])[0] > 0


def test_token_ids(library):
    texts = odd_texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in token_ids.TokenIds(VOCAB).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, library, capacity):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
    return used / (capacity * len(sequences))


def test_packing(spark, sf, edges, docs, library):
    assert check_packing(harmonic_packing.op8_packing(spark, sf).collect(), docs, library, 1024) > 0.98
    distinct = edges.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    rows = harmonic_packing.digest(harmonic_packing.pack(distinct, VOCAB)).collect()
    check_packing(rows, dict(EDGES[:5]) | dict(EDGES[6:7]) | dict(EDGES[8:]), library, 1024)
    assert harmonic_packing.pack(edges, VOCAB).where("start = 0").count() == len(EDGES)
    assert harmonic_packing.pack(edges.where("false"), VOCAB).count() == 0
    for n in range(1, 3000):
        cut = harmonic_packing.pieces(n)
        assert sum(cut) == n and all(0 < x <= 1024 for x in cut)


def test_token_matrices(spark, edges, docs, sf, library):
    folder = shared.new_path(spark, "test")
    rows = token_matrices.write_matrices(spark.read.parquet(f"{sf}/documents.parquet"), VOCAB, folder, window=50_000).collect()
    shards = {s: token_matrices.read_shard(f"{folder}/{s}") for s in {r.shard for r in rows}}
    found = defaultdict(dict)
    for r in rows:
        a = shards[r.shard]
        assert (a["positions"][r.row, r.offset : r.offset + r.length] == np.arange(r.length)).all()
        ends = a["cu_seqlens"][a["row_ptr"][r.row] : a["row_ptr"][r.row + 1]]
        assert r.offset in ends and r.offset + r.length in ends
        found[r.doc_id][r.start] = a["ids"][r.row, r.offset : r.offset + r.length]
    for i, t in docs.items():
        assert np.concatenate([found[i][s] for s in sorted(found[i])]).tolist() == [*library.encode(t, add_special_tokens=False).ids, token_matrices.END]
    assert sum(r.length for r in rows) / sum(a["ids"].size for a in shards.values()) > 0.9
    assert token_matrices.write_matrices(edges, VOCAB, folder).where("start = 0").count() == len(EDGES)
    assert token_matrices.write_matrices(edges.where("false"), VOCAB, folder).count() == 0
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    room: list[int] = []
    expected = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(room)) if room[r] >= sizes[i]]
        least = min((room[r] for r in fits), default=None)
        if least is None:
            room.append(50)
            least = 50
        expected[i] = 50 - least
        room[max(r for r in range(len(room)) if room[r] == least)] -= sizes[i]
    placed = token_matrices.best_fit_decreasing(sizes, 50)
    assert 1 + max(r for r, _ in placed) == len(room) and [o for _, o in placed] == [expected[i] for i in range(len(sizes))]


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def slow_simhash(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [2048, 3])
def test_fingerprint_links(spark, limit):
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    roots = {r.node: r.root for r in components.components(simhash.link_fingerprints(rows, limit)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_simhash(spark, sf, edges, docs, monkeypatch):
    ids = sorted(docs)
    fps = [slow_simhash(docs[i]) for i in ids]
    roots = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, roots)}
    # a row without an id ties those beside it, which are too far apart themselves
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width=3: text.cast("long"))
    chain = spark.createDataFrame([(1, "0"), (None, "7"), (2, "63"), (None, "9000000000")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(chain).collect()} == {(1, 1), (None, 1), (2, 1), (None, None)}
    monkeypatch.undo()
    rows = simhash.near_duplicates(edges).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in rows) == [(0, 5), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7)]
    assert simhash.near_duplicates(edges.where("false")).count() == 0
    assert simhash.simhash(LONG.encode()) == slow_simhash(LONG)


def test_components_of_a_chain(spark):
    links = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(i, 0) for i in range(1, 40)}
    assert components.components(links.where("false")).count() == 0


def test_warc(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = warc.op6_warc(spark, sf)
    expected = db.execute(warc.OP6_SQL)
    assert [d[0] for d in expected.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected.fetchall(), key=str)
    big = "é\r\n\r\n" * 500
    rows = [(1, "u", big, "x"), (2, None, big, "x"), (2, "v\r\n", big, "x"), (None, "w", big, "x"), (5, "a", None, "x"), (6, "a", "", None), (7, "b", "y" * 999, "x"), (8, "b", "y" * 999, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = shared.new_path(spark, "warc-test")
    index = shared.materialize(warc.write_archive(warc.mark_revisits(pages), folder, roll_bytes=600), "index")
    back = {(r.page_id, r.url): r for r in warc.read_records(index, folder, gap=0, span=700).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in back.items()} == {
        (1, "u"): ("revisit", 2, 3000), (2, None): ("response", None, 3000), (2, "v%0D%0A"): ("response", None, 3000), (None, "w"): ("revisit", 2, 3000),
        (5, "a"): ("response", None, 0), (6, "a"): ("response", None, 0), (7, "b"): ("response", None, 999), (8, "b"): ("response", None, 999),
    }
    assert back[2, None].payload == big.encode() and back[1, "u"].digest == hashlib.sha1(big.encode()).hexdigest() and back[1, "u"].payload is None
    assert warc.read_records(index.where("url = 'b'"), folder).count() == 2
    assert warc.mark_revisits(pages.where("false")).count() == 0


def test_multi_index(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = defaultdict(list)
    for r in multi_index.op2_multi_index(spark, sf).orderBy("rank").collect():
        found[r.query_id].append(r)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        got = found[int(ids[q])]
        assert [r["rank"] for r in got] == list(range(1, 21)) and ids[q] not in {r.vec_id for r in got}
        assert np.allclose([r.score for r in got], [s[np.flatnonzero(ids == r.vec_id)[0]] for r in got], atol=1e-12)
        recall.append(len(best & {r.vec_id for r in got}) / 20)
    assert np.mean(recall) >= 0.9
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0])]
    u = spark.createDataFrame([(i, v, 1, 2.0) for i, v in few], "vec_id long, embedding array<double>, rank int, score double")
    got = [tuple(r) for r in multi_index.search(u, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert multi_index.search(u.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    left, right = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    walked = [left[i] + right[j] for i, j in multi_index.walk(left, right)]
    assert walked == sorted(walked) and len(walked) == 6


def test_license_scan(spark, sf, edges, docs):
    rows = {r.doc_id: r for r in license_scan.op3_license_scan(spark, sf).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in docs.items():
        words = word.findall("".join(c.lower() if c.isascii() else c for c in t))
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.scan(edges).count() == len(EDGES) and license_scan.scan(edges.where("false")).count() == 0
    text = "Licensed under the Apache License, Version 2.0.\n# The MIT\n# License and GNU General Public License v3; CC BY-NC 4.0" + " MIT License" * 1000
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {("apache-2.0", 4), ("mit", 3), ("gpl-3.0", 3), ("cc-by-nc-4.0", 2)} <= {(d.label, d.priority) for d in r.detections}
    spans = [(d.start, d.end, d.priority) for d in r.detections]
    assert spans == sorted(spans, key=lambda s: (s[0], -s[1], -s[2]))
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] and a[2] >= b[2] for a in spans[:40] for b in spans[:40])
    assert len(license_rules.rules()) >= 200


def samples(tree):
    """Texts that a pattern matches: at least one for every alternative, optional part and listed character."""
    out = {""}
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            some = {chr(value)}
        elif name == "IN":
            some = {chr(x[0]) if isinstance(x, tuple) else chr(x) for kind, x in value}
        elif name == "SUBPATTERN":
            some = samples(value[3])
        elif name == "BRANCH":
            some = set().union(*map(samples, value[1]))
        elif name == "MAX_REPEAT":
            inner = samples(value[2])
            some = {x * n for x in inner for n in {value[0], max(1, value[0])}}
        else:
            assert name in ("AT", "ASSERT_NOT"), name
            continue
        out = {a + b for a in out for b in some}
    return out


def test_license_rules_fire_whatever_the_wording(spark):
    parse = re._parser.parse
    texts = {(label, priority, x) for line in license_rules.RULES_TEXT.strip().split("\n") for label, priority, _, rx in [line.split(" ", 3)] for x in samples(parse(rx))}
    rows = [(i, x, label, int(priority)) for i, (label, priority, x) in enumerate(sorted(texts))]
    assert len(rows) > 900
    found = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    spans = {r.doc_id: r.detections for r in found}
    # ungated: all rules over each text; what no other match of the same or a higher priority contains must be reported
    compiled = [(label, priority, re.compile(rx.replace("[-[", "[-").replace("]+]", "]"), re.A)) for label, priority, _, rx in license_rules.rules()]
    for i, x, label, priority in rows:
        every = {(m.start(), m.end(), p, lb) for lb, p, rx in compiled for m in rx.finditer(x)}
        assert any(lb == label and p == priority for _, _, p, lb in every), (x, label)
        best = max(p for _, _, p, _ in every)
        assert best == max((d.priority for d in spans[i]), default=0), x
        for a, b, p, _ in every:
            assert any(d.start <= a and b <= d.end and d.priority >= p for d in spans[i]), (x, a, b, p)
    texts = ["Licensed under GPLv3", "GPLv3", "MPL2.0", "FreeBSD license", "beer-ware license", "openrail", "open rail", "released under the GPL version 2", "noncommercial only"]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {texts[r.doc_id]: {(d.label, d.priority) for d in r.detections} for r in found}
    wanted = [("gpl-3.0", 2), ("gpl-3.0", 2), ("mpl-2.0", 2), ("bsd-2-clause", 3), ("beerware", 2), ("openrail", 2), ("openrail", 2), ("gpl-2.0", 4), ("noncommercial", 1)]
    assert all(w in labels[x] for x, w in zip(texts, wanted)), labels


def test_language(spark, sf, edges):
    rng = np.random.default_rng(0)
    sizes = np.array([1, 5, 32, 33, 100, 64, 700])
    e, start, move = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, at = language_crf.marginals(e, sizes, start, move), 0
    for n in sizes:
        p = np.exp(e[at : at + n])
        f, b = np.ones((n, 3)), np.ones((n, 3))
        f[0] = np.exp(start) * p[0]
        for i in range(1, n):
            f[i] = f[i - 1] / f[i - 1].sum() @ np.exp(move) * p[i]
        for i in range(n - 2, -1, -1):
            b[i] = np.exp(move) @ (b[i + 1] * p[i + 1])
            b[i] /= b[i].sum()
        both = f * b
        assert np.allclose(both / both.sum(1, keepdims=True), got[at : at + n])
        at += n
    found = language_crf.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in found if r.held_out]
    assert own and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang_pred == r.lang for r in own]) > 0.9 and all(0 <= r.score <= 1 for r in found)
    crf = language_crf.train_crf([["hola", "mundo"] * 20, ["hello", "world"] * 20], ["es", "en"])
    lang, score = language_crf.predict([None, "", "12 !?", "hello world hola mundo mundo mundo", LONG], crf)
    assert lang[:4] == ["und", "und", "und", "es"] and score[:3] == [0.0] * 3 and lang[4] != "und"
    assert edges.select(language_crf.language(F.col("text"), crf).alias("x")).count() == len(EDGES)
    none = language_crf.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_crf.predict(["hello"], none) == (["und"], [0.0])


def test_language_of_long_words_counts_all_letters():
    rng = random.Random(5)
    left, right = ([chr(c) for c in range(a, a + 26)] for a in (0x4E00, 0x5E00))

    def text(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    crf = language_crf.train_crf([[text(x, 40) for _ in range(60)] for x in (left, right)], ["a", "b"])
    # by its first 40 letters each were the other language
    texts = [text(left, 40) + text(right, 4000), text(right, 40) + text(left, 4000), text(left, 39) + "-1" + text(right, 4000)]
    lang, score = language_crf.predict(texts, crf)
    assert lang == ["b", "a", "b"] and min(score) > 0.9
    words = ["a" * 40, "b" * 95, "-" * 50, "É" * 41, "c"]
    assert language_crf.pieces(words) == ["a" * 40, "b" * 40, "b" * 40, "b" * 15, "é" * 40, "é", "c"]
    assert language_crf.pieces(["x", "y"]) == ["x", "y"] and language_crf.pieces([]) == []


def test_quality(spark, sf, edges):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality_gam.op9_quality(spark, sf).collect()
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.9  # only a pairwise table can tell
    assert quality_gam.fit(x, np.ones(2000)).score(x).min() > 0.9 and quality_gam.fit(x[:0], y[:0]).score(x)[0] == 0.5
    real = quality_gam.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")))
    assert edges.select(quality_gam.quality_score(F.col("text"), real).alias("s")).where("s BETWEEN 0 AND 1").count() == len(EDGES)


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_decontamination(spark, sf, edges, docs):
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(1, 6, 12).astype(np.uint64), rng.integers(1, 6, (3, 20)).astype(np.uint64)
        assert decontamination.align(a, b)[0].tolist() == [slow_align(a, row) for row in b]
    items = {r.item_id: decontamination.word_hashes(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.op1_decontamination(spark, sf).collect()}
    some = [i for i in docs if len(docs[i]) < 3000][:60]
    for d in some:
        words = decontamination.word_hashes(docs[d])
        for i, item in items.items():
            score = decontamination.align(item, words[None, :])[0][0] / (2 * len(item)) if len(words) else 0
            assert ((d, i) in got) == (score >= decontamination.THRESHOLD)
            assert (d, i) not in got or got[d, i] == pytest.approx(score)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "a B, c"), (5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    edited = [(10, "zz " * 50 + "One two three; four FIVE six, eight nine ten" + " yy" * 50), (11, "one two zz"), (10, "same id")]
    more = edges.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    rows = decontamination.contaminated(more, bench, block_bytes=40).collect()
    assert sorted(((r.doc_id or 0), r.item_id) for r in rows) == [(0, 4), (5, 4), (5, 4), (6, 4), (10, 1), (10, 5)]
    best = next(r for r in rows if r.doc_id == 10)
    assert (best.first_word, best.last_word) == (50, 58) and 0.8 < best.score < 1
    assert decontamination.contaminated(edges.where("false"), bench).count() == 0 and decontamination.contaminated(edges, bench.where("false")).count() == 0


@pytest.mark.parametrize("every", [3, 4, 5])
def test_decontamination_of_evenly_edited_copies(spark, every):
    """Every third, fourth or fifth word replaced, beside an intact copy and copies edited at other places."""
    words = [f"w{k}" for k in range(40)]
    edited = [[f"x{first}{k}" if k % every == first else w for k, w in enumerate(words)] for first in range(every)]
    alone = [(10 + first, " ".join(["zz"] * 30 + copy + ["yy"] * 30)) for first, copy in enumerate(edited)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    item = decontamination.word_hashes(" ".join(words))
    for rows in [*([row] for row in alone), [*alone, (99, " ".join(words))]]:
        expected = {i: s for i, t in rows if (s := slow_align(item, decontamination.word_hashes(t)) / 80) >= decontamination.THRESHOLD}
        assert set(expected) == {i for i, _ in rows}
        got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(expected)


BLANKS = [f"a{' ' * 1_000_000}b", f"a b{chr(10) * 3_000_000} c", "x" * 1_000_000, f"{' ' * 3_000_000}é", " \n" * 30_000 + "y"]


def test_long_blank_runs_and_words(spark, library):
    """Runs on which a pattern's stack or an index over pairs might break encode as the library has them."""
    import corpus_pipeline

    ids = [library.encode(t, add_special_tokens=False).ids for t in BLANKS]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_ids.TokenIds(VOCAB).encode(BLANKS)] == ids
    mixed = "".join(random.Random(3).choice(["the", "ing", "你", "of"]) for _ in range(20_000))
    counts = TokenCounter(VOCAB)
    assert counts.count([*BLANKS, mixed, mixed]) == [*map(len, ids), *[len(library.encode(mixed, add_special_tokens=False).ids)] * 2]
    assert not any(len(c) > 32 for c in (*counts.head, *counts.tail))
    rows = spark.createDataFrame(list(enumerate(BLANKS)), "doc_id long, text string")
    check_packing(corpus_pipeline.packed(spark, rows, "").collect(), dict(enumerate(BLANKS)), library, 1024)
    written = token_matrices.write_matrices(rows, VOCAB, shared.new_path(spark, "test")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in written} == {i: len(x) + 1 for i, x in enumerate(ids)}


def test_matrices_have_one_kind_of_ids(spark):
    folder = shared.new_path(spark, "test")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").repartition(2)
    shards = {r.shard for r in token_matrices.write_matrices(rows, VOCAB, folder).collect()}
    assert {token_matrices.read_shard(f"{folder}/{x}")["ids"].dtype for x in shards} == {np.dtype(np.uint16)}
    shards = {r.shard for r in token_matrices.write_matrices(rows, VOCAB, folder, end=70_000).collect()}
    assert {token_matrices.read_shard(f"{folder}/{x}")["ids"].dtype for x in shards} == {np.dtype(np.uint32)}


def found_neighbours(df, k=20):
    out = defaultdict(list)
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0, k=k).orderBy("rank").collect():
        out[r.query_id].append(r.vec_id)
    return out


def test_neighbours_beside_repeats(spark):
    """One row many times, and one id on many vectors: every query still gets all its neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(401, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    schema = "vec_id long, embedding array<double>"
    got = found_neighbours(spark.createDataFrame(rows + [rows[40]] * 3000, schema))
    recall = []
    for q in range(0, 401, 20):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(set(np.argsort(-s)[:20].tolist()) & set(got[q])) / 20)
        assert len(got[q]) == len(set(got[q])) == 20
    assert len(got) == 21 and np.mean(recall) >= 0.9
    near = [(7, (x[0] + rng.normal(size=16) * 0.01).tolist()) for _ in range(2000)]
    got = found_neighbours(spark.createDataFrame(rows + near, schema))
    assert all(len(v) == len(set(v)) == 20 for v in got.values()) and got[0][0] == 7
    # lengths are worlds of their own
    both = found_neighbours(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0, 1.0]), (21, [0.0, 1.0]), (22, [1.0])], schema))
    assert both == {0: [1, 22], 20: [21]}


def test_short_items_and_unspaced_scripts(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "new york city"), (3, "new york city"), (4, "今天天气很好我们去公园玩吧"), (5, "big apple pie now")], "item_id long, text string")
    texts = {1: "to paris or not", 2: "in New York; City of many", 3: "york city new", 4: "他说：今天天气很好我们去公园玩吧！好的", 5: "big apple pie", 6: "paris new york city paris", 7: "今天天很好我们去公园玩吧"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.last_word, r.item_words) for r in decontamination.contaminated(docs, bench).collect()}
    assert {k for k in got if k[1] != 4} == {(1, 1), (2, 2), (2, 3), (6, 1), (6, 2), (6, 3)}
    assert got[2, 2] == (1.0, 1, 3, 3) and got[6, 1] == (1.0, 0, 0, 1)
    assert {k[0] for k in got if k[1] == 4} == {4, 7} and got[4, 4][0] == 1.0 and 0.8 < got[7, 4][0] < 1


def test_rules_of_repeats_against_plain_python(spark):
    """All matches of all rules, sorted, and those within an earlier one of at least their priority left out."""
    phrases = ["Licensed under the Apache License, Version 2.0", "MIT License", "GPLv3 or MPL2.0", "see the license for details", "nothing here", "SPDX-License-Identifier: BSD-3-Clause"]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(phrases) for _ in range(n)) for n in (0, 1, 2, 9, 30, 400)]
    compiled = [(label, priority, re.compile(rx.replace("[-[", "[-").replace("]+]", "]"), re.A)) for label, priority, _, rx in license_rules.rules()]
    found = {r.doc_id: [(d.start, d.end, d.priority, d.label) for d in r.detections] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = sorted((m.start(), -m.end(), -p, label) for label, p, rx in compiled for m in rx.finditer(text.lower()))
        expected = []
        reach = {p: 0 for p in range(1, 5)}
        for start, end, priority, label in spans:
            if reach[-priority] < -end:
                expected.append((start, -end, -priority, label))
            for p in range(1, -priority + 1):
                reach[p] = max(reach[p], -end)
        assert found[i] == expected


def test_similar_texts(spark):
    """Against five-word Jaccard of all pairs: what is linked is similar, and nearly all that is similar is linked."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(200)]
        for edits in (0, 1, 2, 3, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", " ", "a b", "a  b", "a c"]
    for limit in (2048, 16):
        roots = {r.key: r.root for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", limit=limit).collect()}
        sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
        parent = list(range(len(texts)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        for i, j in pairs:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        together = [roots.get(i, i) == roots.get(j, j) for i, j in pairs]
        assert np.mean(together) > 0.9
        assert all(find(i) == find(r) for i, r in roots.items())
        assert roots.get(201, 201) == 200 and roots.get(203, 203) == 202 and 204 not in roots


@pytest.mark.parametrize("limit", [2048, 3])
def test_similar_texts_lose_no_link(spark, limit):
    """All texts of which a fingerprint meets and that are similar are linked, also behind nearer ones that are not similar."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]

    def edited(base, edits):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        return copy

    texts = []
    # one pair of words in the majority gives all of them the same fingerprints, whatever follows
    for _ in range(12):
        tail = [rng.choice(words) for _ in range(100)]
        texts += ["a " * 300 + " ".join(t) for t in (tail, edited(tail, 1))]
    for _ in range(4):
        base = [rng.choice(words) for _ in range(150)]
        texts += [" ".join(edited(base, rng.choice((2, 4, 6)))) for _ in range(25)]
    texts += ["", " ", "a b", "a  b", "a c"]
    n = len(texts)
    lanes = np.array([simhash.lanes(t.encode(), 2, 3) for t in texts], np.uint64)
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    assert (lanes[:24] == lanes[0]).all()
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if np.bitwise_count(lanes[i] ^ lanes[j]).min() <= 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [root[k] for k in range(24)] == [k // 2 * 2 for k in range(24)]
    found = {r.key: r.root for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", limit=limit).collect()}
    assert [found.get(k, k) for k in range(n)] == root
