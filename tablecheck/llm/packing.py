"""Documents packed into token windows of a fixed mixture by deficit round-robin over their sources.

Each source is a queue of documents, in the order of a hash of their id. Documents are cut into packets of at most
``packet`` tokens. A round gives every queue a quantum, its share of one window by weight; a queue sends packets from its
head as long as its deficit, what it was given less what it has sent, covers them, and carries the rest to the next round.
A queue that has run dry gives nothing to the others, whose shares among themselves stay the same. What is sent, one round
after the other and in a round one queue after the other, is a single stream, and every ``window`` tokens of it are a
sequence. So each source's tokens stay within a packet and a quantum of its target at the end of any round, and only the
last sequence needs padding.

No queue is walked through by one task. A packet that ends at token c of its queue leaves in the first round whose quanta
add up to c, round ceil(c / quantum): this is the deficit carried over all earlier rounds in closed form, so tasks need not
wait for one another. c and the place in the stream are running sums over ranges of rows (``running.before``).

NULL and empty texts are the end token alone. NULL is a source like others; rows with a NULL id and repeated rows are packed
like others (ties of the hash go by the ids' checksum, then by row). A document of any length is packed whole. An empty table gives no pieces. Columns other than the three named
are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from tablecheck.llm import running
from tablecheck.llm.encoding import encoder, slices
from tablecheck.llm.staging import staged

#: Tokens of a sequence, and the most that leave a queue at once.
WINDOW = 2048
PACKET = 512
#: Id that ends each document.
END = 1


def _encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(``id``, ``text_source``, ``key``, ``row``, ``width``, ``ids``, ``doc_tokens``, ``crc``) per document.

    ``ids`` holds ``width`` bytes per id, little-endian.
    """
    id_type = docs.schema[id_col].dataType
    kind = StructType([
        StructField("id", id_type), StructField("text_source", StringType()), StructField("key", LongType()), StructField("row", LongType()),
        StructField("width", ByteType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()), StructField("crc", LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer), TaskContext.get().partitionId() << 33
        width = 2 if max(coder.vocabulary() - 1, end) < 1 << 16 else 4
        for batch in batches:
            for few in slices(batch, 3):
                ids = [np.append(x, np.uint32(end)) for x in coder.encode(few.column(3))]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    few.column(0), few.column(1), few.column(2), pa.array(np.arange(row, row + n)), pa.array(np.full(n, width, dtype=np.int8)),
                    pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ], names=kind.names)
                row += n

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("text_source"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.col(text_col).alias("text"),
    )
    return staged(rows.mapInArrow(run, kind), "packing-ids", "zstd")


def _sources(encoded: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """(``text_source``, ``queue``, ``weight``, ``all_weights``): one row per source, numbered by name, NULL last."""
    sizes = encoded.groupBy("text_source").agg(F.sum("doc_tokens").alias("tokens"))
    weight: Column = F.col("tokens")
    if weights is not None:
        weight = F.lit(1).cast("long")
        for name, given in weights.items():
            weight = F.when(F.col("text_source") == name, F.lit(given).cast("long")).otherwise(weight)
    number = F.row_number().over(Window.orderBy(F.col("text_source").asc_nulls_last()))
    sizes = sizes.select("text_source", number.cast("long").alias("queue"), weight.alias("weight"))
    return sizes.withColumn("all_weights", F.sum("weight").over(Window.partitionBy()))


def packed(
    docs: DataFrame, tokenizer: str, weights: dict[str, int] | None = None, window: int = WINDOW, packet: int = PACKET, end: int = END,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per piece: ``doc_id``, ``source``, ``start`` in the document, ``length``, ``ids`` (little-endian uint32),
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence.

    ``weights`` are targets per source (others 1, all above 0); without them each source's target is its share of all
    tokens, so that every window mirrors the table and all queues end together.
    """
    if weights and min(weights.values()) < 1 or not 0 < packet <= window:
        raise ValueError("weights must be above 0 and packets no longer than a window")
    rows = _encoded(docs, tokenizer, end, id_col, text_col, source_col)
    sources = _sources(rows, weights)
    queues = rows.select("row", "text_source", "key", "crc", "doc_tokens")
    queues = queues.join(sources, queues["text_source"].eqNullSafe(sources["text_source"])).drop("text_source")
    queues = running.before(queues, ["key", "crc", "row"], "doc_tokens", "ahead", "queue")

    number = F.explode(F.sequence(F.lit(0), F.expr(f"(doc_tokens - 1) div {packet}"))).alias("n")
    packets = queues.select("row", "queue", "weight", "all_weights", "doc_tokens", "ahead", number)
    packets = packets.withColumn("start", F.col("n") * packet)
    packets = packets.withColumn("size", F.least(F.lit(packet).cast("long"), F.col("doc_tokens") - F.col("start")))
    packets = packets.withColumn("sent", F.col("ahead") + F.col("start") + F.col("size"))
    # ceil(sent / (window * weight / all_weights)), in whole numbers
    due = f"(cast(sent as decimal(19)) * cast(all_weights as decimal(19)) + {window} * cast(weight as decimal(19)) - 1) div ({window} * cast(weight as decimal(19)))"
    packets = packets.select("row", "queue", "start", "size", "sent", F.expr(due).alias("round"))
    stream = running.before(packets, ["round", "queue", "sent"], "size", "at")

    last = F.expr(f"(at + size - 1) div {window}")
    cuts = stream.select("row", "start", "size", "at", F.explode(F.sequence(F.expr(f"at div {window}"), last)).alias("sequence_id"))
    first, stop = F.greatest("at", F.col("sequence_id") * window), F.least(F.col("at") + F.col("size"), (F.col("sequence_id") + 1) * window)
    piece = F.struct(
        (F.col("start") + first - F.col("at")).alias("start"), (stop - first).alias("length"), "sequence_id",
        (first - F.col("sequence_id") * window).alias("offset"),
    )
    pieces = cuts.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))  # as many as one document is long
    return _cut(rows.select("row", "id", "text_source", "width", "ids", "doc_tokens").join(pieces, "row"), id_col, source_col)


def _cut(rows: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """The pieces of documents with their ids; pieces that follow one another in a sequence become one."""
    fields = [("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("doc_tokens", LongType()), ("sequence_id", LongType()), ("offset", IntegerType())]
    kind = StructType([StructField(id_col, rows.schema["id"].dataType), StructField(source_col, StringType()), *[StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            flat, size = lists.flatten(), np.asarray(lists.value_lengths(), dtype=np.int64)
            start, length, sequence, offset = (np.asarray(flat.field(c)) for c in ("start", "length", "sequence_id", "offset"))
            doc = np.repeat(np.arange(batch.num_rows), size)
            opens = np.ones(len(doc), dtype=bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
            at = np.flatnonzero(opens)
            length = np.add.reduceat(length, at)
            start, sequence, offset, doc = start[at], sequence[at], offset[at], doc[at]
            width, held = batch.column("width"), batch.column("ids")
            ids, now, wide = [], -1, None
            for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist()):
                if d != now:
                    now, wide = d, np.frombuffer(held[d].as_buffer(), dtype=f"<u{width[d].as_py()}")
                ids.append(wide[a: a + n].astype("<u4").tobytes())
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(own), batch.column("text_source").take(own), pa.array(start), pa.array(length), pa.array(ids, pa.binary()),
                batch.column("doc_tokens").take(own), pa.array(sequence), pa.array(offset.astype(np.int32)),
            ], names=kind.names)

    return rows.select("id", "text_source", "width", "ids", "doc_tokens", "pieces").mapInArrow(run, kind)
