"""Findings kept up to date by partial results per file."""

import os
import random

from tablecheck.model import ForeignKey, Key, Required, RuleSet
from tablecheck.operators import integrity
from tablecheck.operators.partials import PartialFindings

RULES = RuleSet(
    (Required("c", "id"), Required("c", "note", True), Required("c", "absent")),
    (Key("c_pk", "c", ("id",)), Key("c_k", "c", ("k", "note"), "u"), Key("p_pk", "p", ("id",))),
    (ForeignKey("c_p", "c", ("k",), "p", ("id",), ("k",)), ForeignKey("c_none", "c", ("k",), "gone", ("id",))),
)


def test_only_new_files_are_read(spark, tmp_path):
    draw = random.Random(2)
    folders = {t: str(tmp_path / t) for t in ("c", "p")}

    def more(n):
        rows = [(draw.choice([None, *range(30)]), draw.choice([None, *range(9)]), draw.choice([None, " ", "", "x", "y\t"])) for _ in range(n)]
        spark.createDataFrame(rows, "id INT, k INT, note STRING").coalesce(1).write.mode("append").parquet(folders["c"])

    more(60)
    more(40)
    spark.createDataFrame([(k,) for k in (1, 2, 2, 5, None)], "id BIGINT").coalesce(1).write.parquet(folders["p"])

    def run():
        kept = PartialFindings(spark, str(tmp_path / "partials"), folders, RULES)
        read = kept.refresh()
        full = integrity.check({t: spark.read.parquet(p) for t, p in folders.items()}, RULES, include_zero=True)
        assert sorted(map(str, kept.findings(include_zero=True).collect())) == sorted(map(str, full.collect()))
        return {t: len(files) for t, files in read.items()}

    assert run() == {"c": 2, "p": 1}
    assert run() == {"c": 0, "p": 0}
    more(25)
    assert run() == {"c": 1, "p": 0}
    os.remove(next((tmp_path / "c").glob("*.parquet")))
    assert run() == {"c": 0, "p": 0}
    spark.createDataFrame([(7,)], "id BIGINT").coalesce(1).write.mode("append").parquet(folders["p"])
    assert run() == {"c": 0, "p": 1}
