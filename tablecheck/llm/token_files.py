"""Token ids as grammar-compressed binary files.

A table of token files is a folder of Parquet files; each row is one shard: consecutive documents in ascending order of id
whose ids are compressed together by Re-Pair. Its columns, all numbers little-endian:

- ``part``, ``block``: the order of the shards; ``n_tokens``: the ids of all documents in it
- ``doc_ids``: int64 each, with ``nulls`` a byte each (1: the id is NULL)
- ``doc_tokens``, ``doc_symbols``: uint32 each, ids and symbols of each document; their running sums are the places where
  documents start
- ``rules``: pairs of uint32; rule r makes the symbol ``base + r`` from two earlier symbols
- ``lengths``: uint32 per rule, how many ids it expands to
- ``symbols``: uint32 each, the compressed ids; below ``base`` a symbol is an id

A pair never spans two documents. To read ids i to j of a document only symbols whose expansion reaches into the range are
expanded, found by the running sum of expansion lengths.

Re-Pair replaces the most frequent pairs first. In each round pairs are counted in the whole shard; every pair that occurs
``LEAST`` times and more often than the pairs it overlaps is replaced by a nonterminal of its own. Rounds end when no such
pair is left or a round saves less than one symbol in ``LAST_SAVES``.

Ids are those of the tokenizers library; :mod:`tablecheck.llm.encoding` says how they are found.

Rows with NULL text are empty: the end id alone. Ids are whole numbers; others are cast to them, to NULL or an error as the session
has it. NULL ids come first. Rows with the same id stay, ordered by a hash of their text. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.encoding import encoder, slices
from tablecheck.llm.staging import new_folder

END = 0
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 18
#: A pair that occurs less often is not replaced: its rule, of two symbols and a length, would take about what it saves.
LEAST = 8
#: A round that saves a smaller share of the symbols than one in so many is the last; of ordinary text the rounds after it save
#: some 0.3 percent, at a third of the time.
LAST_SAVES = 1024

SHARD = (
    "part int, block int, n_docs long, n_tokens long, base int, doc_ids binary, nulls binary, doc_tokens binary, "
    "doc_symbols binary, rules binary, lengths binary, symbols binary"
)


def _round(symbols: np.ndarray, last: np.ndarray, base: int, least: int):
    """One round of replacements: (symbols, last, pairs), pairs being the new rules in the order of their symbols."""
    seen, dense = np.unique(symbols, return_inverse=True) if symbols.max() > 1 << 20 else (None, symbols)  # numbers from 0
    counts = np.bincount(dense)
    often = np.flatnonzero(counts >= least)
    if not len(often):
        return symbols, last, None
    width = len(often)
    small = width * width <= 1 << 22
    code = np.full(len(counts), -1, dtype=np.int32 if small else np.int64)
    code[often] = np.arange(len(often))
    c = code[dense]
    key = c[:-1] * width + c[1:]
    key[(c[:-1] < 0) | (c[1:] < 0) | last[:-1]] = -1
    if small:
        pair_counts = np.bincount(key + 1, minlength=width * width + 1).astype(np.int32)
        pair_counts[0] = 0
        n = pair_counts[key + 1]
    else:
        # Pairs are told apart exactly only where their hash occurs often enough.
        some = np.flatnonzero(key >= 0)
        hashed = (key[some] * 0x1E3779B97F4A7C15 >> 40) & 0x3FFFF
        some = some[np.bincount(hashed, minlength=1 << 18)[hashed] >= least]
        _, inverse, times = np.unique(key[some], return_inverse=True, return_counts=True)
        n = np.zeros(len(key), dtype=np.int64)
        n[some] = times[inverse]
    n[n < least] = 0
    # A pair goes if its neighbours are less frequent; of equally frequent neighbours every second goes.
    change = np.flatnonzero(np.diff(n)) + 1
    starts = np.r_[0, change]
    ends = np.r_[change, len(n)]
    value = n[starts]
    before, after = np.r_[0, value[:-1]], np.r_[value[1:], 0]
    peak = (value > 0) & (value > before) & (value > after)
    starts, ends = starts[peak], ends[peak]
    single = ends - starts == 1
    chosen = [starts[single]]
    for a, b in zip(starts[~single], ends[~single]):
        chosen.append(np.arange(a, b, 2))
    at = np.sort(np.concatenate(chosen))
    kinds, which = np.unique(key[at], return_inverse=True)
    pairs = np.stack([often[kinds // width], often[kinds % width]], axis=1)
    if seen is not None:
        pairs = seen[pairs]
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = base + which
    last[at] = last[at + 1]
    stay = np.ones(len(symbols), dtype=bool)
    stay[at + 1] = False
    return symbols[stay], last[stay], pairs


def compress(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules, lengths). ``last`` marks the last id, later the last symbol, of each document."""
    symbols = ids.astype(np.int32 if base < 1 << 30 else np.int64)
    rules, lengths = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    saved = len(symbols)
    while saved * LAST_SAVES > len(symbols) > 1:
        before = len(symbols)
        symbols, last, pairs = _round(symbols, last, base + len(rules), LEAST)
        if pairs is None or not len(pairs):
            break
        saved = before - len(symbols)
        # A round's rules are made of ids and of rules from rounds before.
        sizes = np.ones(pairs.shape, dtype=np.int64)
        sizes[pairs >= base] = lengths[pairs[pairs >= base] - base]
        rules, lengths = np.concatenate([rules, pairs]), np.concatenate([lengths, sizes.sum(axis=1)])
    return symbols, last, rules, lengths


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of every range, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def _table(rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """All rules written out, one after the other: level by level, each from its two parts."""
    starts = np.cumsum(lengths) - lengths
    table = np.zeros(int(lengths.sum()), dtype=np.uint32)
    ready, waiting = np.zeros(len(rules), dtype=bool), np.arange(len(rules))
    while len(waiting):
        part = rules[waiting]
        able = ((part < base) | ready[np.maximum(part - base, 0)]).all(axis=1)
        now, at = waiting[able], starts[waiting[able]]
        for side in (0, 1):
            symbol = rules[now, side]
            own = symbol >= base
            table[at[~own]] = symbol[~own]
            size = np.where(own, lengths[np.maximum(symbol - base, 0)], 1)
            table[_spread(at[own], size[own])] = table[_spread(starts[symbol[own] - base], size[own])]
            at = at + size
        ready[now] = True
        waiting = waiting[~able]
    return table


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols: one gather from a table that holds every id in use and every rule written out."""
    if not len(rules):
        return symbols.astype(np.uint32)
    rule = symbols >= base
    size = np.ones(len(symbols), dtype=np.int64)
    size[rule] = lengths[symbols[rule] - base]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint32)
    out[at[~rule]] = symbols[~rule]
    starts = np.cumsum(lengths) - lengths
    out[_spread(at[rule], size[rule])] = _table(rules, lengths, base)[_spread(starts[symbols[rule] - base], size[rule])]
    return out


def _shard(part: int, block: int, docs: list[tuple[int | None, np.ndarray]], base: int) -> dict:
    tokens = np.array([len(x) + 1 for _, x in docs], dtype=np.int64)
    end = np.array([END], dtype="<u4")
    ids = np.concatenate([y for _, x in docs for y in (x, end)])
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(tokens) - 1] = True
    symbols, last, rules, lengths = compress(ids, last, base)
    edges = np.flatnonzero(last) + 1
    u4 = lambda a: a.astype("<u4").tobytes()
    return {
        "part": part, "block": block, "n_docs": len(docs), "n_tokens": len(ids), "base": base,
        "doc_ids": np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(), "nulls": bytes(d is None for d, _ in docs),
        "doc_tokens": u4(tokens), "doc_symbols": u4(np.diff(np.r_[0, edges])), "rules": u4(rules), "lengths": u4(lengths),
        "symbols": u4(symbols),
    }


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write them as token files.

    Ranges of ids are dealt to tasks, so their order is global; rows of one id go by a hash of their text, and copies by
    where they stand in the input, so that a frequent id is no task's alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        base = coder.vocabulary()
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        kind = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SHARD.split(", ")])
        for batch in batches:
            for few in slices(batch):
                pa.default_memory_pool().release_unused()
                for doc, ids in zip(few.column(0).to_pylist(), coder.encode(few.column(1))):
                    held.append((doc, ids))
                    size += len(ids) + 1
                    if size >= SHARD_IDS:
                        yield pa.RecordBatch.from_pylist([_shard(part, block, held, base)], schema=kind)
                        block, held, size = block + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_shard(part, block, held, base)], schema=kind)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    order = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({f"k{i}": k for i, k in enumerate(order[1:])})
    dealt = rows.repartitionByRange("id", "k0", "k1").sortWithinPartitions("id", "k0", "k1").select("id", "text")
    dealt.mapInArrow(run, SHARD).write.parquet(path)


def _decoded(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard with their ids."""
    u4 = {c: np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("symbols", "rules", "lengths", "doc_tokens")}
    ids = expand(u4["symbols"], u4["rules"].reshape(-1, 2), u4["lengths"], row["base"])
    ends = np.cumsum(u4["doc_tokens"])
    for doc, null, a, b in zip(np.frombuffer(row["doc_ids"], dtype="<i8").tolist(), row["nulls"], ends - u4["doc_tokens"], ends):
        yield None if null else doc, ids[a:b]


def decode_range(row: dict, n: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the shard's n-th document, expanding only the symbols that reach into them."""
    symbols, sizes = (np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("symbols", "doc_symbols"))
    rules, lengths = (np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("rules", "lengths"))
    first = int(sizes[:n].sum())
    own = symbols[first: first + int(sizes[n])]
    long = np.ones(len(own), dtype=np.int64)
    long[own >= row["base"]] = lengths[own[own >= row["base"]] - row["base"]]
    ends = np.cumsum(long)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    part = expand(own[a:b], rules.reshape(-1, 2), lengths, row["base"])
    offset = start - int(ends[a - 1]) if a else start
    return part[offset: offset + stop - start]


def read(spark, path: str) -> DataFrame:
    """(``doc_id``, ``ids``, ``part``, ``block``, ``place``): every document of the files, ids decoded."""
    return _documents(spark, path, True)


def _documents(spark, path: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                docs = list(_decoded(row))
                arrays = {
                    "doc_id": pa.array([d for d, _ in docs], pa.int64()), "n_tokens": pa.array([len(x) for _, x in docs], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64()),
                    "part": pa.array([row["part"]] * len(docs), pa.int32()), "block": pa.array([row["block"]] * len(docs), pa.int32()),
                    "place": pa.array(range(len(docs)), pa.int32()),
                    "inner": pa.array(np.cumsum([0, *[len(x) for _, x in docs]])[:-1], pa.int64()),
                }
                if with_ids:
                    arrays["ids"] = pa.array([x for _, x in docs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(arrays)

    kind = "doc_id long, n_tokens long, ids_crc32 long, part int, block int, place int, inner long" + ", ids array<long>" * with_ids
    return spark.read.schema(SHARD).parquet(path).mapInArrow(run, kind)


def index(spark, path: str) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) from the files: start counts the ids of all documents before.

    Starts come from sums per task, then per shard of a task; the only single-task step has one row per writing task.
    """
    shards = spark.read.schema(SHARD).parquet(path).select("part", "block", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shards.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    starts = blocks.join(parts, "part")
    docs = _documents(spark, path, False).join(starts, ["part", "block"])
    return docs.select("doc_id", (F.col("at") + F.col("in_part") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files into the shared folder and return their index."""
    path = new_folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col, text_col)
    return index(docs.sparkSession, path)
