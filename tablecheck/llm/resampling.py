"""Documents drawn so that their words come closer to a target's: importance weights of hashed n-grams, Gumbel top-k.

Texts are normalised to lower-case words parted by single spaces. Each normalised document is scanned once and the running
CRC-32 at the end of every word is stored, with the words' lengths. The CRC of any run of words follows from two of them: the
CRC of a text is linear over GF(2), so ``crc(b) = crc(ab) ^ shift(crc(a), len(b))``, where shifting by n zero bytes is a
linear map looked up in tables. A run's bucket is its CRC modulo the number of buckets. Texts are not read again: bucket
counts come with the scan, one array per task, and weights from the stored CRCs.

A bucket's gain is the floored thousandfold logarithm of the target's smoothed share over the corpus's; a document's weight is the
floored mean gain over its features, and its score the weight plus Gumbel noise from a hash of its id.

NULL and empty texts have no features and weight 0. A NULL id is hashed as an empty one and comes last among ties; repeated rows are
documents of their own, their order among equal scores and ids is that of the stored rows. Texts and words may be of any length.
An empty table gives an empty result, an empty target shares of one smoothed count per bucket. Columns other than the
two named are not looked at, except those asked for in ``carry``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tablecheck.llm import running
from tablecheck.llm.staging import staged

BUCKETS = 10_000
RUN = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25

#: Bytes of words: digits, letters and everything beyond ASCII; upper-case ASCII letters become lower-case, the rest a space.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A length that a byte does not hold is kept apart.
_LONG = 255
_ALL = 0xFFFFFFFF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_BYTE = _crc_table()


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What n zero bytes make of each value of each of a CRC's four bytes: for every n below 256, and for 256, 512, 1024, …"""
    one = [(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)]
    step = np.stack(one)
    small = [step]
    for _ in range(256):
        step = (step >> np.uint32(8)) ^ _BYTE[step & 0xFF]
        small.append(step)
    powers = [small.pop()]
    while len(powers) < 32:
        powers.append(_through(powers[-1], powers[-1]))
    return np.stack(small), powers


def _through(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return table[0][values & 0xFF] ^ table[1][(values >> 8) & 0xFF] ^ table[2][(values >> 16) & 0xFF] ^ table[3][values >> 24]


_SMALL, _POWERS = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs (uint32) after n more zero bytes each, as far as they are linear: without the initial and final inversion."""
    low, flat = (n & 0xFF) << 8, _SMALL.reshape(256, 4, 256)
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= flat[:, k].reshape(-1)[low + ((crc >> np.uint32(8 * k)) & np.uint32(0xFF))]
    high = n >> 8
    for bit, table in enumerate(_POWERS):
        if not high.any():
            break
        some = np.flatnonzero(high & 1)
        out[some] = _through(table, out[some])
        high = high >> 1
    return out


def running_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(CRC of the normalised text up to the end of each word, length of each word)."""
    words = text.translate(_WORD).split()
    crc = zlib.crc32
    ends = list(accumulate(words, lambda c, w: crc(w, crc(b" ", c)), initial=0)) if words else [0]
    if words:  # the first word follows no space
        ends = list(accumulate(words[1:], lambda c, w: crc(w, crc(b" ", c)), initial=crc(words[0])))
    return np.array(ends if words else [], dtype=np.uint32), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def features(crcs: np.ndarray, lengths: np.ndarray, words: np.ndarray, longest: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(CRC, document) of every run of 1 to ``longest`` words. The documents, ``words`` words each, lie one after the other."""
    doc = np.repeat(np.arange(len(words)), words)
    opens = np.zeros(len(crcs), dtype=bool)
    opens[(np.cumsum(words) - words)[words > 0]] = True
    before = np.r_[np.uint32(0), crcs[:-1]].astype(np.uint32)
    before = (_BYTE[(before ^ np.uint32(_ALL ^ 0x20)) & np.uint32(0xFF)] ^ ((before ^ np.uint32(_ALL)) >> np.uint32(8))) ^ np.uint32(_ALL)
    before[opens] = 0  # the CRC where a word begins
    found, of, size = [], [], lengths
    for n in range(longest):
        at = np.flatnonzero(doc[n:] == doc[: len(doc) - n]) if n else np.arange(len(doc))
        if n:
            size = size[: len(doc) - n] + 1 + lengths[n:]
        found.append(crcs[at + n] ^ shifted(before[at], size[at]))
        of.append(doc[at])
    return np.concatenate(found), np.concatenate(of)


def _scan(docs: DataFrame, id_col: str, text_col: str, carry: list[str], buckets: int, longest: int) -> DataFrame:
    """Running CRCs per document; the last row of a task has its bucket counts and nothing else."""
    kept = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(text_col).alias("text"))
    kind = StructType([
        StructField("doc", kept.schema["doc"].dataType), StructField("row", LongType()), StructField("n_words", LongType()),
        StructField("crcs", BinaryType()), StructField("lengths", BinaryType()), StructField("long", BinaryType()), StructField("counts", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, counts, batch = TaskContext.get().partitionId() << 33, np.zeros(buckets, dtype=np.int64), None
        for batch in batches:
            for few in _slices(batch):
                texts = pc.cast(pc.fill_null(few.column(1), ""), pa.binary()).to_pylist()
                scanned = [running_crcs(t) for t in texts]
                words = np.array([len(c) for c, _ in scanned], dtype=np.int64)
                crcs, _ = features(np.concatenate([c for c, _ in scanned]), np.concatenate([n for _, n in scanned]), words, longest)
                counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
                yield pa.RecordBatch.from_arrays([
                    few.column(0), pa.array(np.arange(row, row + len(texts))), pa.array(words),
                    pa.array([c.astype("<u4").tobytes() for c, _ in scanned], pa.binary()),
                    pa.array([np.minimum(n, _LONG).astype(np.uint8).tobytes() for _, n in scanned], pa.binary()),
                    pa.array([n[n >= _LONG].astype("<i8").tobytes() for _, n in scanned], pa.binary()), pa.nulls(len(texts), pa.binary()),
                ], names=kind.names)
                row += len(texts)
        if batch is not None:
            none = [pa.nulls(1, t) for t in (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=kind.names)

    return staged(kept.mapInArrow(run, kind), "resampling-crcs")


def _slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)) // size
    edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b > a)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(``bucket``, ``n``) for every bucket that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                total += np.frombuffer(held, dtype="<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = scanned.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(scanned: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(``bucket``, ``gain``) for all buckets; as many rows as there are buckets."""
    session = scanned.sparkSession
    both = session.range(buckets).withColumnRenamed("id", "bucket")
    for name, table in (("s", scanned), ("t", target)):
        counts = bucket_counts(table, buckets).select("bucket", F.col("n").cast("double").alias(name))
        both = both.join(counts, "bucket", "left").fillna({name: 0.0})
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row


def _weights(scanned: DataFrame, gain: list[int], longest: int) -> DataFrame:
    """(``doc``, ``row``, ``n_words``, ``n_features``, ``weight``) per document, from its stored CRCs."""
    rows = scanned.filter("counts IS NULL").select("doc", "row", "n_words", "crcs", "lengths", "long")
    table = np.array(gain, dtype=np.int64)
    kind = StructType([rows.schema["doc"], rows.schema["row"], rows.schema["n_words"], StructField("n_features", LongType()), StructField("weight", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column("crcs")), dtype=np.int64)) // (4 << 20)
            edges = np.r_[0, np.flatnonzero(np.diff(size)) + 1, batch.num_rows]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                few = batch.slice(a, b - a)
                if not few.num_rows:
                    continue
                crcs = np.frombuffer(b"".join(few.column("crcs").to_pylist()), dtype="<u4").astype(np.uint32)
                lengths = np.frombuffer(b"".join(few.column("lengths").to_pylist()), dtype=np.uint8).astype(np.int64)
                lengths[lengths == _LONG] = np.frombuffer(b"".join(few.column("long").to_pylist()), dtype="<i8")
                words = np.asarray(few.column("n_words"), dtype=np.int64)
                found, of = features(crcs, lengths, words, longest)
                n, total = np.bincount(of, minlength=len(words)), np.zeros(len(words), dtype=np.int64)
                np.add.at(total, of, table[found % np.uint32(len(table))])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([few.column("doc"), few.column("row"), few.column("n_words"), pa.array(n.astype(np.int64)), pa.array(weight)], names=kind.names)

    return rows.mapInArrow(run, kind)


def gumbel(seed: int, doc: Column) -> Column:
    """The floored thousandfold Gumbel variate that the first eight hex digits of a hash of the id decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = RUN,
    seed: int = SEED, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """Every document as ``doc`` (``id`` and the columns in ``carry``) with ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank``: 1, 2, 3, … for those drawn, from the highest score down, NULL for the others.

    Drawn are ``percent`` of the documents with at least ``least_words`` words, rounded down.
    """
    scanned = _scan(docs, id_col, text_col, carry or [], buckets, longest)
    aim = _scan(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", [], buckets, longest)
    table = [r["gain"] for r in gains(scanned, aim, buckets).orderBy("bucket").collect()]  # one number per bucket
    scored = _weights(scanned, table, longest).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc.id")))
    scored = staged(scored, "resampling-scores")
    eligible = F.col("n_words") >= least_words
    drawn = scored.filter(eligible).count() * percent // 100
    ranked = scored.filter(eligible).withColumns({"one": F.lit(1).cast("long"), "id": F.col("doc.id")})
    ranked = running.before(ranked, [F.col("score").desc(), F.col("id").asc_nulls_last(), "row"], "one", "ahead")
    columns = ["doc", "n_words", "n_features", "weight", "score"]
    rank = F.when(F.col("ahead") < drawn, F.col("ahead") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.filter(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))
