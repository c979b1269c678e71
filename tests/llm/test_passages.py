"""Passages that repeat across documents, against a search with a dictionary of all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablecheck.llm import repeats


def plain(data):
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    first = {}
    for doc, text in data:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            key = tuple(w[i: i + 50])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in data:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 49):
            if doc is not None and first[tuple(w[i: i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def made_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ü", "the", "of"] * 20

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [prose(n) for n in (50, 51, 70, 120, 49)]
    data = []
    for i in range(120):
        w = prose(rng.randint(0, 90))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
        data.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    long = prose(3000)
    edited = list(long)
    edited[1000] = "edit"
    copy = data[5][1]
    return data + [
        (200, " ".join(long)), (201, " ".join(edited)), (202, "\n".join(long)), (203, "a " * 400), (204, "a " * 300), (190, "a " * 60),
        (210, copy), (211, copy), (211, copy), (211, " ".join(passages[3])), (4, " ".join(long[:100])), (None, " ".join(long[:200])),
        (None, None), (212, None), (213, ""), (214, "x" * 100000), (215, " ".join(passages[0]) + "\x00 y"), (-5, " ".join(passages[2])),
        (211, " \n ".join(copy.split())),
    ]


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_removed_words_agree_with_a_dictionary_of_windows(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    data = made_texts()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("runs", F.lit("r")).repartition(5)
    assert rows(repeats.cut(docs)) == plain(data)


def test_sample_documents(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(repeats.cut(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_no_documents(spark):
    assert repeats.cut(spark.createDataFrame([], "doc_id long, text string")).collect() == []
