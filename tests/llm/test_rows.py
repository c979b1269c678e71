"""Rules, mixing and decontamination on odd rows: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import math

from pyspark.sql import functions as F

from tablecheck.llm import decontaminate, mixing, quality
from tablecheck.llm.columns import unit

ODD = [
    (1, None, "a", 0), (2, "", "a", 1), (3, "one", None, 2), (4, "u v w " * 40, "b", 3), (4, "u v w " * 40, "b", 3), (None, "x y", "b", 4),
    (5, " ".join(f"w{i}" for i in range(60)), "c", 5), (6, "line one\nline one\n\nline two\n#*$ %&|<>", "c", 6),
    (7, " ".join(f"p{i % 977}" for i in range(20000)), "d", 7), (8, "é ü \t\x0b\x0c\r\n z", "é", 8),
]
SCHEMA = "doc_id long, text string, source string, n_words int"


def words(text):
    return (text or "").encode().split()


def test_measures_agree_with_plain_counting(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("doc", F.lit(1)).withColumn("m", F.lit(2)).withColumn("fail_bits", F.lit(3))
    got = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(got) == len(ODD)
    for r in got:
        w, text = words(r.doc.text), r.doc.text or ""
        windows = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
        again = {g for g in windows if windows.count(g) > 1} if len(windows) < 500 else set()
        if len(windows) >= 500:
            seen = {}
            for g in windows:
                seen[g] = seen.get(g, 0) + 1
            again = {g for g, n in seen.items() if n > 1}
        covered = {i + o for i, g in enumerate(windows) if g in again for o in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        expected = (
            len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
        )
        assert tuple(r[c] for c in quality.MEASURES) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (r.fail_bits == 0) and not (r.base_failed and r.kept)
        assert (r.doc.doc, r.doc.m, r.doc.fail_bits) == (1, 2, 3)


def test_policies_and_ablations_read_only_bits(spark):
    entries = spark.createDataFrame([(0,), (1,), (3,), (4,), (12,), (12,), (5,)], "fail_bits long")
    kept = {v: quality.apply_policy(entries, p).filter("kept").count() for v, p in quality.POLICIES.items()}
    assert kept == {"base-1": 4, "strict-1": 1, "lenient-1": 2}
    found = {r.rule: tuple(r)[2:] for r in quality.ablations(entries).collect()}
    assert found["few_words"] == (3, 1, 1, 6)
    assert found["symbols"] == (4, 1, 1, 9)
    assert found["dup_lines"] == (2, 0, 0, 4)
    assert found["long_words"] == (0, 0, 0, 0)
    assert {tuple(r)[2:] for r in quality.ablations(entries.limit(0)).collect()} == {(0, 0, 0, 0)}


def fill(sizes, weights, most=3.0):
    """Targets by handing out the excess again and again."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i] + 1e-9}
        if not over:
            return [most * s if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= over


def test_targets_agree_with_repeated_sharing(spark):
    for sizes in ([100, 10, 1000, 1, 50, 7], [5, 5, 5], [0, 0], [0, 100], [1], [1000, 1, 1, 1, 1, 1, 1]):
        df = spark.createDataFrame([(f"0{chr(97 + i)}", s) for i, s in enumerate(sizes)], "src string, source_size long")
        got = [r.target for r in mixing.targets(df, F.col("rank") % 3 + 1, 3).orderBy("src").collect()]
        expected = fill(sizes, [i % 3 + 1 for i in range(len(sizes))]) if sum(sizes) else [0] * len(sizes)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, expected)), (sizes, got, expected)


def test_mix_meets_targets_in_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 7)
    data = [(i, "w " * (i % 13), f"s{i % 4}" if i % 5 else None, i) for i in range(600)] + ODD
    docs = spark.createDataFrame(data, SCHEMA)
    quality_of = spark.createDataFrame([(i, (0.0, 0.5, 2.0, float("nan"))[i % 4]) for i in range(0, 600, 3)], "doc_id long, q double")
    got = mixing.taken(docs, quality_of).collect()
    assert len(got) == len(data)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(docs, quality_of).collect()))
    biggest = max(r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= biggest / 2 + 1
        assert max(r.copies for r in own) <= 3 and len({r.copies for r in own if r["size"]}) <= 2
    keys = docs.select("doc_id", unit(F.lit("mix-1"), F.col("doc_id")).alias("u")).distinct().collect()
    key = {r.doc_id: -math.log(r.u) for r in keys}
    q = {r.doc_id: r.q for r in quality_of.collect()}
    own = sorted((r for r in got if r.source == "s1" and r["size"]), key=lambda r: -r.copies)

    def scaled(d):
        w = q.get(d, 1.0)
        return math.inf if w == 0 else key[d] / (w if w == w else 1.0)

    more = [scaled(r.doc_id) for r in own if r.copies == own[0].copies]
    less = [scaled(r.doc_id) for r in own if r.copies < own[0].copies]
    assert not less or sorted(more)[-2] <= min(less)


def test_mixed_rows_repeat_as_often_as_they_are_taken(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    chosen = mixing.taken(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).filter("n > 0")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    sizes = got.withColumn("size", F.size(F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")).cast("long"))
    counted = sizes.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counted.collect()), key=repr) == sorted(map(tuple, chosen.collect()), key=repr)
    assert mixing.mixed(docs.limit(0)).collect() == []


ITEMS = [(1, "a b c d e f g h i j k l m n"), (10, "Short, item!"), (2, None), (3, "--"), (None, "q r s"), (1, "short item"), (4, "é Ü ß")]
TEXTS = [
    (1, "zz A-B c d e f g h i j k l M, nope " + "y " * 20), (2, "short item " + "y " * 30), (3, "short item short item"), (4, None), (5, ""),
    (6, "xshort item"), (7, "q  r\ts é Ü ß"), (8, "q R s"), (8, "q R s"), (9, "a b c d e f g h i j k l n"), (None, "short—item short;;item"),
    (11, "y " * 5000 + "short item " * 400),
]


def normal_words(text):
    out = bytearray((text or "").encode())
    for i, b in enumerate(out):
        if 65 <= b <= 90:
            out[i] = b + 32
        elif not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128):
            out[i] = 32
    return bytes(out).split()


def test_contamination_agrees_with_trying_every_window(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_hit", F.lit(5)).withColumn("found", F.lit("x"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1 << 20, 10):
        got = decontaminate.judged(docs, bench, limit=limit).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            w, hit, items = normal_words(r.doc.text), set(), set()
            for item, text in ITEMS:
                v = normal_words(text)
                for i in range(max(1, len(v) - 12)) if v else []:
                    window = v[i: i + 13]
                    at = [j for j in range(len(w) - len(window) + 1) if w[j: j + len(window)] == window]
                    hit |= {j + o for j in at for o in range(len(window))}
                    items |= {str(item) if item is not None else ""} if at else set()
            assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(items), sorted(items))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            raw = (r.doc.text or "").encode()
            assert normal_words(b" ".join(raw[s.start: s.end] for s in r.spans).decode()) == [w[i] for i in sorted(hit)]
    assert decontaminate.judged(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.judged(docs.limit(0), bench).collect() == []
