"""Operators that SQL cannot express, against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tablecheck.llm import simhash, token_files
from tablecheck.llm.staging import new_folder

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "one two three four"), (2, "one two three four"), (3, None), (4, ""), (5, "  \n lone\n\n  two  words "),
    (6, "a" * 5000), (7, "x y z " * 3000), (7, "x y z " * 3000), (8, "ÄÖ ñ b c <|endoftext|> \r\n tab\tq"), (None, "no id"),
    (9, "it's we'll 123 4.5 — «q»\n\nNew line\n x"), (10, "\n"), (11, " "), (12, "<|endoftext|>"), (-3, "end \n"),
]


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    windows = [words[i: i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42) for w in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_classes_agree_with_all_pairs(documents, rows):
    data = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [plain_fingerprint(t) for _, t in data]
    expected = plain_components([d for d, _ in data], prints)
    got = simhash.classes(documents)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert rows(got) == sorted(zip([d for d, _ in data], signed, expected), key=repr)


def test_postings_connect_a_dense_group_like_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    prints = {center ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 6), replace=False)) for _ in range(400)}
    prints |= {int(x) for x in rng.integers(1 << 62, size=50)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = dict(zip(prints, plain_components(prints, [p & (1 << 64) - 1 for p in prints])))
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    for block in (4096, 8):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {r.node: r.root for r in simhash.components(simhash.near_links(fps)).collect()}
        assert {p: roots.get(p, p) for p in prints} == expected


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_simhash_of_an_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string, fp int")).collect() == []


def test_token_files_hold_the_librarys_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 20000)
    library = Tokenizer.from_file(BPE)
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    data = sorted(((r.doc_id, r.h, r.text or "") for r in rows), key=lambda x: (x[0] is not None, *x))
    expected, start = [], 0
    for doc, _, text in data:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.encoded(documents, BPE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_token_files_allow_reading_parts_of_documents(spark, documents):
    path = new_folder(spark, "test")
    token_files.write(documents, path, BPE)
    whole = {(r.part, r.block, r.place): r.ids for r in token_files.read(spark, path).collect()}
    shards = [r.asDict() for r in spark.read.parquet(path).collect()]
    assert sum(len(s["rules"]) for s in shards) > 0
    for shard in shards:
        for n in range(0, shard["n_docs"], 7):
            ids = whole[shard["part"], shard["block"], n]
            for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
                assert token_files.decode_range(shard, n, a, b).tolist() == ids[a:b]


@pytest.mark.parametrize("ids", [[5] * 4097, [1, 2] * 3000, list(range(3000)), [9], [1, 1, 2, 1, 1, 2, 1] * 500])
def test_grammars_expand_to_what_they_were_made_from(ids):
    ids = np.array(ids, dtype=np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[[len(ids) // 2, -1]] = True
    symbols, ends, rules, lengths = token_files.compress(ids, last, 100000)
    assert token_files.expand(symbols, rules, lengths, 100000).tolist() == ids.tolist()
    first = symbols[: int(np.flatnonzero(ends)[0]) + 1]
    assert token_files.expand(first, rules, lengths, 100000).tolist() == ids[: len(ids) // 2 + 1].tolist()


def test_token_files_replace_frequent_pairs_to_the_end(spark):
    """Under two thirds of the symbols are left of ordinary documents, and few pairs that would pay for a rule."""
    path = new_folder(spark, "test")
    token_files.write(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, BPE)
    shards = [r.asDict() for r in spark.read.parquet(path).collect()]
    assert 3 * sum(len(s["symbols"]) // 4 for s in shards) < 2 * sum(s["n_tokens"] for s in shards)
    for s in shards:
        symbols = np.frombuffer(s["symbols"], dtype="<u4").astype(np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[np.cumsum(np.frombuffer(s["doc_symbols"], dtype="<u4").astype(np.int64)) - 1] = False
        pairs = (symbols[:-1] << 32 | symbols[1:])[inside[:-1]]
        times = np.unique(pairs, return_counts=True)[1]
        assert times[times >= 2 * token_files.LEAST].sum() < len(symbols) / 100  # what is left are runs of one symbol


def test_token_files_share_out_a_frequent_id(spark):
    docs = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS doc_id", "'the same text' AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = token_files.encoded(docs, BPE)
        path = new_folder(spark, "test")
        token_files.write(docs, path, BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n_docs")).collect()) < 2600
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in found.collect())
    assert [s for s, _, _ in starts] == [n * starts[0][1] for n in range(4000)] and all(d is None for _, _, d in starts[:2000])


def test_token_files_of_an_empty_table(spark):
    assert token_files.encoded(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []
