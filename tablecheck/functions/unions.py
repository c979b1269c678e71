"""Putting many frames together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def balanced_union(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts, with the same columns in one order, in a frame whose plan is as deep as the logarithm of their number."""
    level = list(parts)
    while len(level) > 1:
        level = [a.unionAll(b) for a, b in zip(level[::2], level[1::2])] + (level[-1:] if len(level) % 2 else [])
    return level[0]
