"""Token counts of a byte-pair model by merging with a heap over a linked list; no id is ever made.

The characters of a piece are a linked list. A heap holds its adjacent pairs that the model knows, best score first and
leftmost among equals; a popped pair whose ends have changed is skipped. Every merge takes one from the count, which starts
at one per known character and one per UTF-8 byte of an unknown one.

A sentencepiece model of this kind (byte-pair merges, byte fallback, no normalisation beyond a leading space mark) has no
piece with a space mark after another character and none with a line end. No merge crosses such a place, so a text is cut
there, and a piece is merged once as long as it stays in a table of bounded size. ``Counter`` checks these properties and
refuses other models.

NULL and empty texts have no tokens. Texts of any length are counted whole. Other columns of any name are left alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Pieces whose counts a task remembers.
REMEMBERED = 400_000

_MARK = "▁"
_RUNS = re.compile(f"{_MARK}+[^{_MARK}\n]*|\n[^{_MARK}\n]*|[^{_MARK}\n]+")


class Counter:
    """Counts the tokens of texts for one model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        inner = any(_MARK in p.lstrip(_MARK) or "\n" in p for p in self.score)
        if inner or sum(map(model.is_byte, ids)) != 256 or model.normalize("ﬁ  A ") != f"{_MARK}ﬁ{_MARK * 2}A{_MARK}":
            raise ValueError(f"{path} is no byte-pair model with byte fallback and plain text")
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """The tokens of a piece."""
        score = self.score
        count = sum(1 if c in score else len(c.encode("utf-8", "surrogatepass")) for c in piece)
        symbol: list[str] = list(piece)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i, p in enumerate(map("".join, zip(symbol, symbol[1:]))) if p in score]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or not symbol[i] or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                longer = pair + symbol[k]
                if longer in score:
                    heapq.heappush(heap, (-score[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbol[h] + pair
                if longer in score:
                    heapq.heappush(heap, (-score[longer], h, longer))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > REMEMBERED:
            self.known = {}
        marked = _MARK + text.replace(" ", _MARK)
        if _MARK * 2 in marked:
            pieces = _RUNS.findall(marked)
        else:  # what follows a mark is written without it; what opens with a line end follows none
            pieces = marked[1:].replace("\n", _MARK + "\n").split(_MARK)
        known, total = self.known, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                known[p] = n = self.merged(p if p[:1] in ("\n", _MARK) else _MARK + p)
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def n_tokens(text: Column, model: str) -> Column:
    """The number of tokens of a text, 0 for NULL."""

    def counted(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _COUNTERS.get(model) or _COUNTERS.setdefault(model, Counter(model))
        for array in arrays:
            yield pa.array([counter.count(t) for t in array.to_pylist()], pa.int64())

    counted.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, "long")(text)


def counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, model).alias("n_tokens"))
    return size.withColumn("over_limit", F.col("n_tokens") > limit)
