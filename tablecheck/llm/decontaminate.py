"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, texts scanned once.

Texts are normalised byte by byte: A-Z are lower-cased, every byte that is no digit, letter or part of a longer character
becomes a space. The length never changes, so the place of a word in the normalised text is its place in the original. The
automaton reads the words joined by single spaces; matches are mapped to words and on to the original bytes.

The items are the stated query set. They are read in blocks of at most ``BLOCK_BYTES`` of windows, and each block is one
automaton and one step of the same task: a larger benchmark makes more steps over each text, not more memory in one, and
no shuffle. One block is the rule; the driver holds the items' texts while it starts the job.

NULL and empty texts have no words; items with none have no window. Items of one id are one item; items without an id hit
words and are listed as an empty string. Repeated rows are judged each for itself. Other columns of any name are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
BLOCK_BYTES = 32 << 20

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def normal(text: str | None) -> bytes:
    """The text's bytes, normalised in place."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The windows of an item, each between single spaces, a byte per character."""
    found = normal(text).decode("latin-1").split()
    if not found:
        return set()
    return {f" {' '.join(found[i: i + size])} " for i in range(max(1, len(found) - size + 1))}


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> list[list[tuple[str, list[str]]]]:
    """Windows with the items that have them, cut into blocks of a bounded size."""
    out: list[list[tuple[str, list[str]]]] = []
    owners: dict[str, set[str]] = {}
    held = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    for item, text in rows.toLocalIterator():
        for window in windows(text):
            if window not in owners:
                held += len(window)
            owners.setdefault(window, set()).add(item)
        if held > limit:
            out.append([(w, sorted(i)) for w, i in sorted(owners.items())])
            owners, held = {}, 0
    if owners:
        out.append([(w, sorted(i)) for w, i in sorted(owners.items())])
    return out


def _automaton(block: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for window, items in block:
        automaton.add_word(window, (window.count(" ") - 1, len(window), items))
    automaton.make_automaton()
    return automaton


def _scan(block: list[tuple[str, list[str]]]):
    """One step over the texts: adds the word spans and items that this block's automaton finds to ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block) if block else None
        for batch in batches:
            counts, spans, items = [], [], []
            for text, earlier in zip(batch.column("text"), batch.column("found")):
                earlier = earlier.as_py() or {"spans": [], "items": []}
                words = normal(text.as_py()).decode("latin-1").split()
                counts.append(len(words))
                more, names = list(earlier["spans"]), set(earlier["items"])
                matches = list(automaton.iter(f" {' '.join(words)} ")) if words and automaton else []
                if matches:
                    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                    starts = np.cumsum(lengths + 1) - lengths - 1  # of the space before each word
                    at = np.array([end + 1 - size for end, (_, size, _) in matches])
                    first = np.searchsorted(starts, at)
                    reach = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(reach, first, 1)
                    np.add.at(reach, first + np.array([n for _, (n, _, _) in matches]), -1)
                    edges = np.diff(np.r_[0, (np.cumsum(reach[:-1]) > 0).astype(np.int8), 0])
                    more += np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).ravel().tolist()
                    for _, (_, _, owners) in matches:
                        names.update(owners)
                spans.append(more)
                items.append(sorted(names))
            found = pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "spans", "items"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), found], ["doc", "text", "found"])

    return run


def _merged(spans: list[int]) -> np.ndarray:
    """Pairs of first and past-the-last words, overlapping ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, places, digests, numbers = [], [], [], []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
            words = _merged(found["spans"])
            hits.append(int((words[:, 1] - words[:, 0]).sum()))
            numbers.append(len(found["items"]))
            digests.append(hashlib.sha256(",".join(found["items"]).encode()).hexdigest())
            if len(words):
                data = np.frombuffer(normal(text.as_py()), dtype=np.uint8) != 32
                edges = np.diff(np.r_[0, data.astype(np.int8), 0])
                starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                places.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in words])
            else:
                places.append([])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        found = batch.column("found")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), found.field("n_words"), pa.array(hits, pa.int64()), pa.array(numbers, pa.int64()),
             pa.array(digests, pa.string()), found.field("items"), pa.array(places, span)],
            ["doc", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans"],
        )


def judged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc`` (the input row as a struct), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``items``, ``spans``
    (bytes of the UTF-8 text that are hit) and ``contaminated``."""
    row = docs.select(F.struct("*").alias("doc"))
    scanned = row.select("doc", F.col(f"doc.`{text_col}`").alias("text"), F.lit(None).cast(FOUND).alias("found"))
    for block in blocks(benchmark, limit=limit) or [[]]:
        scanned = scanned.mapInArrow(_scan(block), scanned.schema)
    kind = T.StructType([
        row.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")],
        T.StructField("items_sha256", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    hit = (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))
    return scanned.mapInArrow(_judge, kind).withColumn("contaminated", hit)
