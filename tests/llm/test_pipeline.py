"""The pipeline, stage by stage, against plain Python on the same rows; and the package's place in the repository."""

import ast
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_rows import normal_words, words
from test_signatures import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tablecheck.llm import mixing
from tablecheck.llm.staging import new_folder

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc", F.lit("clash")).withColumn("size", F.lit(-1))
    # The tables hold few whole windows of the benchmark among kept documents: one is added.
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    first = docs.filter("doc_id = 3")
    marked = first.withColumn("doc_id", F.lit(100_000).cast("long")).withColumn("text", F.concat(F.lit(item), F.lit(" "), F.substring(F.col("text"), 30, 900)))
    out = [docs.unionByName(marked).unionByName(docs.filter("doc_id = 5"))]
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "stage")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def failed(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + o for i, g in enumerate(windows) if seen[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    chars = len(b"".join(w).decode())
    return (
        len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * sum(c in "#*$%&|<>" for c in text) > len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * len(w) or chars > 20 * len(w)
    )


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5


def test_quality_stage(stages):
    assert rows_of(stages[1]) == sorted((tuple(r) for r in stages[0].collect() if not failed(r.text)), key=repr)


def test_near_duplicate_stage(stages):
    data = stages[1].collect()
    roots = plain_components([r.doc_id for r in data], [plain_fingerprint(r.text) for r in data])
    kept = sorted({tuple(r) for r, root in zip(data, roots) if r.doc_id == root}, key=repr)  # doc 5 is there twice
    assert rows_of(stages[2]) == kept and len(kept) == len({r[0] for r in kept}) < len(data)


def test_near_duplicates_are_kept_by_row(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in ("a", "b", "c", "d", "e")]
    rows = [
        (1, texts[0], "x"), (2, texts[0], "x"), (None, texts[0], "x"),  # one component
        (3, texts[1], "x"), (1, texts[2], "x"), (0, texts[2], "x"),  # 1 is a root above, but not here
        (4, texts[3], "x"), (4, texts[3] + " more", "x"), (4, texts[3], "y"),  # one id, near texts or unlike columns
        (None, texts[4], "x"), (None, texts[4], "x"), (None, texts[4], "y"), (None, None, None), (None, "", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_key", F.lit(1))
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert (prints[6] ^ prints[7]).bit_count() <= 3
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(k for k in kept if k[0] in (0, 1, 3)) == [(0, texts[2]), (1, texts[0]), (3, texts[1])]
    assert len([k for k in kept if k[0] == 4]) == 1
    assert [k for k in kept if k[0] is None and k[1]] == [(None, texts[4])]
    assert len([k for k in kept if not k[1]]) == 1 and len(kept) == 6


def test_exact_copies_of_the_row_that_is_kept_go(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "x")] * 3 + [(2, text + " end", "x"), (3, None, "x"), (3, None, "x"), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert rows_of(corpus_pipeline.near_duplicate_stage(spark, docs, SF)) == [(1, text, "x"), (3, None, "x")]


def test_decontamination_stage(spark, stages):
    items = [normal_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(v[i: i + 13]) for v in items for i in range(max(1, len(v) - 12)) if v}
    sizes = {len(w) for w in windows}
    kept = []
    for r in stages[2].collect():
        w = normal_words(r.text)
        hit = {i + o for n in sizes for i in range(len(w) - n + 1) if tuple(w[i: i + n]) in windows for o in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(tuple(r))
    assert rows_of(stages[3]) == sorted(kept, key=repr)
    assert stages[3].filter("doc_id = 100000").isEmpty() and not stages[2].filter("doc_id = 100000").isEmpty()


def test_mixing_stage(spark, stages):
    chosen = mixing.taken(stages[3], mixing.labelled_quality(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    wanted = {r.doc_id: r.copies for r in chosen if r.copies}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == wanted
    assert stages[4].distinct().exceptAll(stages[3].distinct()).isEmpty()


def test_token_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for r in stages[4].collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(map(tuple, stages[5].collect()), key=lambda r: r[1])
    assert sorted((d, n, c) for d, _, n, c in got) == sorted(expected)
    ends = np.cumsum([n for _, _, n, _ in got])
    assert [s for _, s, _, _ in got] == [0, *ends[:-1].tolist()]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_the_library_does_not_use_this_package():
    for folder, _, names in os.walk(ROOT):
        if "/llm" in folder or "/.git" in folder:
            continue
        for name in names:
            if name.endswith(".py") and name not in ("__spark_entry__.py", "corpus_pipeline.py"):
                with open(os.path.join(folder, name)) as source:
                    tree = ast.parse(source.read())
                for node in ast.walk(tree):
                    used = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(u.startswith("tablecheck.llm") or u == "corpus_pipeline" for u in used), (folder, name)
