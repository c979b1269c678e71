"""Texts to the ids that the tokenizers library gives for a tokenizer file.

Where the file is a plain byte-level BPE whose merged tokens are numbered in the order of their merges, tiktoken merges by
the file's own vocabulary several times as fast and to the same ids (tests compare both libraries on every code point and on
random texts). Texts with a string of an added token, texts that tiktoken cannot take and all other files go to the
tokenizers library itself. NULL texts are empty.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Bytes of text that are encoded at a time.
SLICE = 2 << 20
#: Fixed value: where a byte-level tokenizer cuts texts. Lazy and greedy forms match alike; these never go back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _spelled_bytes() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones as they are, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(moved)}


def _ranks(file: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks; None unless the file is of the kind that tiktoken merges alike."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not file.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or cut.get("add_prefix_space") or any(model.get(k) for k in odd):
        return None
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    byte = _spelled_bytes()
    added = {t["content"] for t in file.get("added_tokens", [])}
    words = {w: n for w, n in vocab.items() if w not in added}
    if made != sorted(set(made)) or len(words) != 256 + len(made) or any(b not in vocab or vocab[b] >= made[0] for b in byte):
        return None
    return {bytes(byte[c] for c in word): n for word, n in words.items()}


class Encoder:
    """Texts to ids as little-endian uint32 bytes, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = [t["content"] for t in file.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        ranks = _ranks(file)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not self.added.search(text):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except Exception as failed:  # a piece that its pattern engine gives up on
                if isinstance(failed, MemoryError):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [self.ids(t or "") for t in texts.to_pylist()]


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text each."""
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)) // SLICE
    edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b > a)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
