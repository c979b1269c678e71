"""Removing passages that an earlier document has, by prefix-partitioned suffixes.

A window is ``WINDOW`` consecutive words. The suffixes of all documents form a tree; its nodes of depth WINDOW are the
windows, and a node whose leaves lie in several documents is a repeat. The tree is never held whole:

- Suffixes are dealt by a prefix of ``PREFIX`` words: not of each suffix itself, which would send every word position of
  the corpus over the network, but of the one suffix inside each window whose prefix hashes lowest. Equal windows choose
  the same one, and consecutive windows mostly share it, about one in twenty positions.
- Prefixes that occur in one text only end there. Texts are read again for the others, and windows that share a prefix and
  follow one another form a *branch*: one longer prefix, named by the hash of all its words. A branch that occurs in many
  documents is one row after the map-side combine, however often it occurs. So groups are split by prefixes of variable
  length: ``PREFIX`` words, then a branch's words, then WINDOW words.
- A branch that an earlier document has too is a repeat over its full length. The windows of distinct branches are the
  nodes of depth WINDOW; the smallest document below each node decides the rest.

Nodes are told apart by two 64-bit hashes, of the window and of its prefix. Texts with the same words are represented by
the smallest id; their copies are removed whole if they have a window. All groups are combined before the shuffle, and what
is joined back to rows is a staged table, so that Spark can split frequent keys.

NULL and empty texts have no words. Rows without an id are neither cut nor seen as earlier. Rows that repeat an id do not cut
each other. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.staging import staged

WINDOW = 50
PREFIX = 10
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.random.default_rng(11).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE, _WORD_BASE, _SPAN_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = np.array([pow(int(base), -1, 1 << 64)], dtype=np.uint64)[0]
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _runs_of(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray, powers=None) -> np.ndarray:
    """Hashes of the runs from starts to ends: differences of a running sum, shifted back to the beginning."""
    up, down = powers or _powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


_CHUNK_POWERS = _powers(_BYTE_BASE, 1 << 16)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.r_[False, ~_SPACE[data], False].astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in chunks that end between words."""
    out = []
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        begin, end = starts[at], ends[to - 1]
        powers = _CHUNK_POWERS if end - begin < 1 << 16 else None
        out.append(_runs_of(_LETTER[data[begin:end]], _BYTE_BASE, starts[at:to] - begin, ends[at:to] - begin, powers))
        at = to
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    done, low = 1, grams
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


def windows_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, prefix of each window, node of each window); the last two are empty below WINDOW words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_hashes(data, *word_bounds(data))
    n = len(words)
    if n < WINDOW:
        return words, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    powers = _powers(_WORD_BASE, n)
    at = np.arange(n + 1)
    grams = _runs_of(words, _WORD_BASE, at[: n - PREFIX + 1], at[PREFIX:], powers)
    nodes = _runs_of(words, _WORD_BASE, at[: n - WINDOW + 1], at[WINDOW:], powers)
    return words, _lowest(grams, WINDOW - PREFIX + 1), nodes


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, digest and distinct prefixes of each text."""
    for batch in batches:
        numbers, digests, prefixes = [], [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            numbers.append(len(words))
            digests.append(_digest(words))
            prefixes.append(np.unique(windows_of(text)[1]).view(np.int64) if len(words) >= WINDOW else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("x"), pa.array(numbers, pa.int64()), pa.array(digests), pa.array(prefixes, pa.list_(pa.int64()))],
            ["doc_id", "x", "n_words", "all_sha256", "prefixes"],
        )


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows whose common prefix is one of the text's shared ones, with their nodes."""
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("doc_id", "x", "prefix", "branch", "first", "n", "nodes")}
        for k, text in enumerate(batch.column("text").to_pylist()):
            words, prefix, nodes = windows_of(text)
            change = np.flatnonzero(np.diff(prefix)) + 1
            starts, ends = np.r_[0, change], np.r_[change, len(prefix)]
            shared = np.asarray(batch.column("prefixes")[k].values).view(np.uint64)
            take = np.isin(prefix[starts], shared)
            starts, ends = starts[take], ends[take]
            names = _runs_of(words, _SPAN_BASE, starts, ends + WINDOW - 1)
            columns["doc_id"] += [batch.column("doc_id")[k].as_py()] * len(starts)
            columns["x"] += [batch.column("x")[k].as_py()] * len(starts)
            columns["prefix"] += prefix[starts].view(np.int64).tolist()
            columns["branch"] += names.view(np.int64).tolist()
            columns["first"] += starts.tolist()
            columns["n"] += (ends - starts).tolist()
            columns["nodes"] += [nodes[a:b].view(np.int64) for a, b in zip(starts, ends)]
        kinds = {"first": pa.int32(), "n": pa.int32(), "nodes": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()], list(columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that repeated windows cover."""
    for batch in batches:
        removed, digests, texts = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            reach = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(reach, [r["first"] for r in runs], 1)
            np.add.at(reach, [r["first"] + r["n"] + WINDOW - 1 for r in runs], -1)
            gone = np.cumsum(reach[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            removed.append(int(gone.sum()))
            digests.append(_digest(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("x"), pa.array(removed, pa.int64()), pa.array(digests)],
            ["doc_id", "x", "n_removed", "kept_sha256"],
        )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("x"), text.alias("text"))


def repeated_runs(texts: DataFrame, first: DataFrame, surveyed: DataFrame) -> DataFrame:
    """(``doc_id``, ``x``, ``runs``): runs of windows (``first``, ``n``) that also start in a smaller document."""
    seen = surveyed.join(first, "all_sha256").filter("doc_id = first_id AND x = first_x")
    prefixes = seen.select("doc_id", "x", F.explode("prefixes").alias("prefix"))
    # Texts that differ; equal ones count once, so a prefix must occur in two of them.
    least = prefixes.withColumn("t", F.struct("doc_id", "x")).groupBy("prefix").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    shared = staged(least.filter("a < b").select("prefix"), "prefixes")
    own = prefixes.join(shared, "prefix", "left_semi").groupBy("doc_id", "x").agg(F.collect_set("prefix").alias("prefixes"))
    wanted = staged(own, "wanted")
    kind = "doc_id long, x long, prefix long, branch long, first int, n int, nodes array<long>"
    branches = staged(texts.join(wanted, ["doc_id", "x"]).mapInArrow(_branches, kind), "branches")

    name = ["prefix", "branch", "n"]
    roots = staged(branches.groupBy(*name).agg(F.min("doc_id").alias("root"), F.first("nodes").alias("nodes")), "roots")
    nodes = roots.select(*name, "root", F.posexplode("nodes").alias("at", "node"))
    earliest = staged(nodes.groupBy("prefix", "node").agg(F.min("root").alias("earliest")), "nodes")
    early = nodes.join(earliest, ["prefix", "node"]).filter("earliest < root").groupBy(*name).agg(F.collect_list("at").alias("early"))
    decided = staged(roots.select(*name, "root").join(early, name, "left"), "decided")

    placed = branches.select(*name, "doc_id", "x", "first").join(decided, name)
    whole = F.array(F.struct("first", "n"))
    some = F.transform(F.coalesce("early", F.array().cast("array<int>")), lambda j: F.struct((F.col("first") + j).alias("first"), F.lit(1).alias("n")))
    found = placed.select("doc_id", "x", F.explode(F.when(F.col("doc_id") > F.col("root"), whole).otherwise(some)).alias("run"))
    return found.groupBy("doc_id", "x").agg(F.collect_list("run").alias("runs"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_words``, ``n_removed``, ``kept_sha256``) for every row."""
    texts = _texts(docs, id_col, text_col)
    kind = "doc_id long, x long, n_words long, all_sha256 string, prefixes array<long>"
    surveyed = staged(texts.mapInArrow(_survey, kind), "survey")
    with_windows = surveyed.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = with_windows.groupBy("all_sha256").agg(F.min(F.struct("doc_id", "x")).alias("f"))
    first = staged(first.select("all_sha256", F.col("f.doc_id").alias("first_id"), F.col("f.x").alias("first_x")), "first")

    runs = repeated_runs(texts, first, with_windows)
    results = texts.join(staged(runs, "runs"), ["doc_id", "x"]).mapInArrow(_cut, "doc_id long, x long, n_removed long, kept_sha256 string")
    results = staged(results.dropDuplicates(["doc_id", "x"]), "results").withColumnsRenamed({"doc_id": "first_id", "x": "first_x"})
    by_text = staged(first.join(results, ["first_id", "first_x"], "left"), "by-text")

    rows = surveyed.select("doc_id", "n_words", "all_sha256").join(by_text, "all_sha256", "left")
    copy = F.col("doc_id") > F.col("first_id")
    mine = F.col("doc_id") == F.col("first_id")
    return rows.select(
        F.col("doc_id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(mine, F.coalesce("kept_sha256", "all_sha256")).otherwise(F.col("all_sha256")).alias("kept_sha256"),
    )
