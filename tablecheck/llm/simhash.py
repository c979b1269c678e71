"""SimHash fingerprints, and links between those that differ in at most three bits.

A fingerprint is eight bytes in eight places. Two fingerprints that differ in at most three bits agree in at least five
places, so an inverted index whose postings are named by five places and their bytes holds every such pair together: 56
postings a fingerprint. Postings of one place only would grow with the square of the corpus (each holds 1/256 of it).
Within a posting the shared places of a pair are tallied, pairs that reach the guaranteed five go on, and their differing
bits are counted. Five bytes fix 40 bits, so a posting has at most 2^24 fingerprints whatever the corpus; one with more
than 4,096 is split by three equal half bytes of the other six, which leaves at most 4,096 each. A posting gives back the
links of a spanning forest, not all its pairs; connectivity is all that a component needs.

Copies share a fingerprint and enter the index once. Components come from alternating large and small stars over staged
links. Fingerprints are joined back to documents by sort-merge joins over staged tables, which Spark splits where a
fingerprint is very frequent.

NULL and empty texts have no words and fingerprint zero. Rows without an id are fingerprinted and linked like others; a
component's id is its smallest id, NULL if it has none. Repeated rows stay. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.staging import staged

PLACES = 8
MAX_BITS = 3
SHARED = PLACES - MAX_BITS
#: The most members of a posting that are compared pair by pair.
BLOCK = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned: a bit is set if more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype="<u8")
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).astype(np.uint8), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, ``fp``): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _masks(parts: int, width: int, shared: int) -> list[int]:
    one = (1 << width) - 1
    return [sum(one << (width * p) for p in places) for places in combinations(range(parts), shared)]


def postings(fps: DataFrame) -> DataFrame:
    """Each distinct fingerprint under the 56 choices of five places: (``places``, ``bytes``, ``fp``)."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(PLACES, 8, SHARED)]
    listed = F.array(*[F.lit(m).cast("long") for m in masks])
    return fps.select(F.posexplode(listed).alias("places", "mask"), "fp").select(
        F.col("places").cast("short").alias("places"), F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp",
    )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the least tally of equal places and then differ in few enough bits."""
    x = a ^ b
    tally = (np.ascontiguousarray(x)[..., None].view(np.uint8) == 0).sum(axis=-1)
    return (tally >= SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of up to BLOCK fingerprints, found level by level from each unvisited one."""
    links: list[tuple[int, int]] = []
    left = np.sort(values)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _near(left, np.uint64(at))
            if near.any():
                found = left[near]
                links += [(int(at), int(v)) for v in found]
                frontier += list(found)
                left = left[~near]
    return links


def _linked(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of one posting. A large one is split again, by three equal half bytes of the six that its key leaves free."""
    values = np.unique(values)
    if len(values) <= BLOCK:
        return _forest(values)
    moving = np.bitwise_or.reduce(values ^ values[0])
    free = [p for p in range(16) if int(moving) >> (4 * p) & 15]
    links: list[tuple[int, int]] = []
    for same in combinations(free, max(0, len(free) - MAX_BITS)):
        mask = np.uint64(sum(15 << (4 * p) for p in same))
        keys = values & mask
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(values[order], cuts):
            if len(part) > 1:
                links += _forest(part)
    return links


def _posting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of postings that arrive sorted; a posting may go on in the next batch."""

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    held: list[np.ndarray] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        places, masked, fp = (np.asarray(c) for c in batch.columns)
        fp = np.asarray(fp).view(np.uint64)
        cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(masked) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
        links: list[tuple[int, int]] = []
        if key == (places[0], masked[0]):
            held.append(fp[: ends[0]].copy())
        else:
            links += _linked(np.concatenate(held)) if held else []
            held = [fp[: ends[0]].copy()]
        if len(starts) > 1:
            links += _linked(np.concatenate(held))
            held = [fp[starts[-1]:].copy()]
            sizes = ends - starts
            inner = np.flatnonzero(sizes[1:-1] > 1) + 1
            two = starts[inner[sizes[inner] == 2]]
            near = two[_near(fp[two], fp[two + 1])]
            links += list(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for g in inner[sizes[inner] > 2]:
                links += _linked(fp[starts[g]: ends[g]])
        key = (places[-1], masked[-1])
        if links:
            yield out(links)
    if held and (links := _linked(np.concatenate(held))):
        yield out(links)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (``a`` < ``b``, signed) that connect all distinct fingerprints at most three bits apart."""
    dealt = postings(fps.select("fp").distinct())
    dealt = dealt.repartition("places", "bytes").sortWithinPartitions("places", "bytes")
    return dealt.mapInArrow(_posting_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links; the root is the component's smallest node.

    Large star: every node sends its larger neighbours to the smallest it knows; small star: every node sends itself and
    its smaller neighbours there. Rounds end when a round changes nothing; each is written to the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u")

    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = star(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "stars")
        now = state(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fp``, ``component_id``) for every row of the documents."""
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    first = staged(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "first")
    member = staged(components(near_links(first)), "members")
    linked = first.join(member, first["fp"] == member["node"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "root").select("fp", "least_id")
    whole = first.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return fps.join(staged(whole, "classes"), "fp").select(id_col, "fp", "component_id")
