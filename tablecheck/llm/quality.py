"""Quality rules as a ledger of bits: rules are evaluated once, policies are applied to the bits later.

``ledger`` gives each document its measurements and one long whose bit k is set where rule k fails. A policy is a version,
a mask of the rules it minds and the number of failures it forgives; applying one, or comparing many, reads the ledger and
never the texts again. ``ablations`` adds up the combinations of bits that occur, at most two to the power of the rules.

A document is measured inside its own row: no shuffle, no state beyond the row. NULL and empty texts have no words and fail
``few_words``. Repeated rows are measured each for itself. Other columns of any name are carried in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.columns import NO_SEPARATOR, let, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rules in the order of their bits: SQL over the measurements, true where a document fails. The first two are the base.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


def mask_of(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


@dataclass(frozen=True)
class Policy:
    """A document passes if at most ``forgiven`` of the masked rules fail, and none of the required ones."""

    version: str
    mask: int
    required: int = 0
    forgiven: int = 0


BASE = mask_of("few_words", "repeats")
POLICIES = {
    "base-1": Policy("base-1", BASE, BASE),
    "strict-1": Policy("strict-1", mask_of(*RULES), BASE),
    "lenient-1": Policy("lenient-1", mask_of(*RULES), BASE, forgiven=1),
}
DEFAULT = POLICIES["strict-1"]


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that occur again in the same array.

    Windows are compared by 64-bit hashes, sorted with their places; the places whose neighbour has an equal hash are
    sorted again, and each adds the words that the one before has not covered.
    """

    def covered(sorted_windows: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            before = F.coalesce(F.get(sorted_windows, i - 1)["h"] == e["h"], F.lit(False))
            after = F.coalesce(F.get(sorted_windows, i + 1)["h"] == e["h"], F.lit(False))
            return before | after

        places = F.sort_array(F.transform(F.filter(sorted_windows, twice), lambda e: e["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, covered)).otherwise(0)

    first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return let(F.transform(first, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), counted)


def _measured(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SEPARATOR))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            )).alias("l"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    return let(let(words(text), of), lambda m: F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["lines"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
    ))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the input row as a struct), the measurements, and ``fail_bits``.

    The measurements leave a generator as one struct, so that no later filter makes Spark compute them again.
    """
    row = docs.select(F.struct("*").alias("doc"))
    measured = row.select("doc", F.explode(F.array(_measured(F.col(f"doc.`{text}`")))).alias("m")).select("doc", "m.*")
    bits = sum((F.expr(f"IF({sql}, {1 << k}L, 0L)") for k, sql in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(policy: Policy, bits: Column) -> Column:
    """Whether a policy keeps a document with these bits."""
    return (bits.bitwiseAND(F.lit(policy.required)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(policy.mask))) <= policy.forgiven)


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    return (
        entries.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0)
        .withColumn("kept", verdict(policy, F.col("fail_bits"))).withColumn("policy", F.lit(policy.version))
    )


def ablations(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule: documents that fail it, that no other minded rule rejects, and that dropping the rule would win back.

    ``with_others`` has the bits of all rules that fail together with it. An empty ledger gives a row of zeros per rule.
    """
    combos = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = entries.sparkSession.createDataFrame(
        [(k, n, 1 << k) for k, n in enumerate(RULES)], "bit int, rule string, flag long",
    )
    kept = verdict(policy, F.col("fail_bits"))
    without = F.col("fail_bits").bitwiseAND(F.bitwise_not(F.col("flag")))
    flagged = combos.withColumn("flag", F.explode(F.array(*[F.lit(1 << k).cast("long") for k in range(len(RULES))])))
    flagged = flagged.filter(F.col("fail_bits").bitwiseAND(F.col("flag")) != 0)
    sums = flagged.groupBy("flag").agg(
        F.sum("n").alias("failed"),
        F.sum(F.when(without.bitwiseAND(F.lit(policy.mask)) == 0, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(~kept & verdict(policy, without), F.col("n")).otherwise(0)).alias("won_back"),
        F.bit_or(without).alias("with_others"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("failed", "failed_alone", "won_back", "with_others")}
    return rules.join(sums, "flag", "left").select("bit", "rule", *zero.values())
