"""Centroids, importance resampling and packing against plain walks through the rows."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablecheck.llm import centroids, encoding, packing, queries, resampling, running

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, None, "a", 0), (2, "", "a", 1), (3, "one", None, 2), (4, "u v w " * 400, "b", 3), (4, "u v w " * 400, "b", 3), (None, "x y", "b", 4),
    (None, "x y", "b", 4), (5, " ".join(f"w{i}" for i in range(60)), "c", 5), (6, "The <|endoftext|> of\r\n\n it's  all\tÉa", "c", 6),
    (7, " ".join(f"p{i % 977}" for i in range(20000)), "d", 7), (8, "é ü \t\x0b\x0c\r\n z", "é", 8), (9, "y" * 70000 + " " + "Z" * 300 + " end", "c", 9),
    *[(100 + i, " ".join(f"Q{i * j % 37}-x" for j in range(i)), "hot", 1) for i in range(60)],
]
SCHEMA = "doc_id long, text string, source string, row int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"doc": F.lit(1), "ids": F.lit(2), "weight": F.lit(3)}).repartition(3)


def test_running_sums_over_many_equal_keys(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 AS g", "0L AS k", "id % 7 AS n").repartition(5)
    got = running.before(rows, ["k", "id"], "n", "ahead", "g").collect()
    seen = Counter()
    for r in sorted(got, key=lambda r: r.id):
        assert r.ahead == seen[r.g]
        seen[r.g] += r.n
    assert len(got) == 5000


def test_ids_are_those_of_the_tokenizers_library(spark):
    library, coder = Tokenizer.from_file(BPE), encoding.Encoder(BPE)
    assert coder.fast is not None
    points = [c for c in (*range(0x3400), *range(0x3400, 0x110000, 97)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1{chr(c)}a  {chr(c)}\n{chr(c)}'{chr(c)}" for c in points]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 5000, "it's we'LL 12.5%\r\n\r\n"]
    for t, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert coder.ids(t).tolist() == want.ids


def test_files_of_another_kind_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = encoding.Encoder(path), Tokenizer.from_file(path)
    assert coder.fast is None
    for text in ("Hello  World", "<|startoftext|>a", "é"):
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def lloyd(vectors, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), k in zip(kept, own) if k == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in out:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def test_centroids_equal_rounds_in_whole_numbers(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(i % 5, 0.7, 64).astype(np.float32).astype(float).tolist(), 1) for i in range(150)]
    rows += [rows[3], rows[3], (None, [0.0] * 64, 1), (None, rows[4][1], 1), (900, None, 1), (901, [1.0] * 63, 1), (902, [1.0] * 63 + [None], 1)]
    rows += [(903, [1.0] * 63 + [float("nan")], 1), (904, [float("-inf")] + [1.0] * 63, 1), (905, [], 1)] + [(1000 + i, [0.5] * 64, 1) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").withColumn("sums", F.lit(b"x")).repartition(3)
    got = centroids.with_summary(*centroids.clustered(table))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd([r[:2] for r in rows])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, cluster int")
    assert sorted((tuple(r) for r in centroids.with_summary(*centroids.clustered(few)).collect()), key=repr) == lloyd([r[:2] for r in rows[:3]])
    assert centroids.with_summary(*centroids.clustered(table.limit(0))).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_crcs_of_runs_follow_from_two_prefixes():
    texts = [b"One two-THREE", b"", b"...", b"x" * 300 + b" " + b"y" * 70000 + b" z", "É caf\xe9 1a".encode(), b"a"]
    scanned = [resampling.running_crcs(t) for t in texts]
    words = np.array([len(c) for c, _ in scanned])
    got, of = resampling.features(np.concatenate([c for c, _ in scanned]), np.concatenate([n for _, n in scanned]), words, 3)
    want = Counter()
    for d, t in enumerate(texts):
        w = t.translate(resampling._WORD).split()
        want.update((d, zlib.crc32(b" ".join(w[i: i + n]))) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert Counter(zip(of.tolist(), got.tolist())) == want


def test_resampling_equals_plain_counting(spark, docs):
    items = [(1, "W1 w2 w3, u V"), (2, None), (3, ""), (4, "q1 x q2 x")]
    target = spark.createDataFrame(items, "item_id long, text string")

    def runs(text):
        w = (text or "").encode().translate(resampling._WORD).split()
        return len(w), [zlib.crc32(b" ".join(w[i: i + n])) % 10000 for n in (1, 2) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for text in texts for b in runs(text)[1]) for texts in ([r[1] for r in ODD], [x for _, x in items]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    want = []
    for doc_id, text, *_ in ODD:
        n, found = runs(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    got = [(r.doc.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resampled(docs, target).collect()]
    assert Counter(r[:5] for r in got) == Counter(want)
    places = {r[5]: r[:5] for r in got if r[5]}
    assert sorted(places) == list(range(1, len(able) * 25 // 100 + 1))
    assert [places[k] for k in sorted(places)] == able[: len(places)]
    with_text = resampling.resampled(docs, target, carry=["text", "source"]).filter("rank = 1").select("doc.*").collect()
    assert [(r.id, r.text) for r in with_text] == [next(x[:2] for x in ODD if x[0] == able[0][0])]
    assert resampling.resampled(docs.limit(0), target).collect() == []
    assert resampling.resampled(docs, target.limit(0)).count() == len(ODD)


def plain_round_robin(rows, weights, window, packet):
    """(doc, start, size) in the order of sending; ``rows``: (doc, source, tokens) in the order of their queues."""
    queues = {}
    for doc, source, n in rows:
        queues.setdefault(source, []).extend((doc, a, min(packet, n - a)) for a in range(0, n, packet))
    order = sorted(queues, key=lambda x: (x is None, x))
    share = {q: Fraction(window * weights[q], sum(weights.values())) for q in order}
    deficit, sent = dict.fromkeys(order, Fraction(0)), []
    while any(queues.values()):
        for q in order:
            deficit[q] += share[q]
            while queues[q] and queues[q][0][2] <= deficit[q]:
                sent.append(queues[q].pop(0))
                deficit[q] -= sent[-1][2]
    return sent


@pytest.mark.parametrize("weights", [None, {"hot": 5, "d": 2}])
def test_packing_equals_a_walk_through_the_queues(spark, docs, weights):
    library = Tokenizer.from_file(BPE)
    library_ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ODD]
    keys = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")).collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    queue = sorted(range(len(ODD)), key=lambda k: (keys[ODD[k][0]], crc(library_ids[k])))
    sizes = Counter()
    for k in queue:
        sizes[ODD[k][2]] += len(library_ids[k])
    share = sizes if weights is None else {q: weights.get(q, 1) for q in sizes}
    sent = plain_round_robin([(k, ODD[k][2], len(library_ids[k])) for k in queue], share, 256, 64)
    stream = [x for k, a, n in sent for x in library_ids[k][a: a + n]]
    pieces = packing.packed(docs, BPE, weights, window=256, packet=64).collect()
    windows = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, ids))
    built = []
    for s in range(len(windows)):
        parts = sorted(windows[s])
        assert [a for a, _ in parts] == list(np.cumsum([0, *[len(x) for _, x in parts]])[:-1])
        built.append([x for _, ids in parts for x in ids])
    assert all(len(w) == 256 for w in built[:-1]) and 0 < len(built[-1]) <= 256
    assert [x for w in built for x in w] == stream
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.source, p.doc_tokens), []).append((p.start, p.length))
    for (_, _, n), parts in by_doc.items():
        assert sum(length for _, length in parts) % n == 0
    if weights is None:  # each window holds each source's share but for packets and quanta at its two ends
        for s in range(len(windows) - 1):
            held = Counter()
            for p in pieces:
                if p.sequence_id == s:
                    held[p.source] += p.length
            for q, n in sizes.items():
                assert abs(held[q] - Fraction(256 * n, sizes.total())) <= 2 * (64 + Fraction(256 * n, sizes.total()))


def test_packing_of_an_empty_table(spark, docs):
    assert packing.packed(docs.limit(0), BPE).collect() == []
    with pytest.raises(ValueError):
        packing.packed(docs, BPE, {"hot": 0})


def test_queries_carry_the_contracts_columns(spark):
    folder = "/root/testdata/sf0.001"
    pieces = queries.packing_query(spark, folder)
    assert pieces.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for d, t in texts.items()}
    covered = Counter()
    for p in pieces.collect():
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start: p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == Counter({d: len(x) for d, x in ids.items()})
