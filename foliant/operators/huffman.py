"""Huffman tables of baseline images: counts of symbols by aggregation, an optimal table for each slot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(image_id, slot, symbol, n)."""
    return symbols.groupBy("image_id", "slot", "symbol").agg(F.count("*").alias("n"))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of the 256 symbols' codes, before long ones are folded back; the all-ones code is kept free.

    The two rarest are merged again and again; of equally rare ones that of the highest number goes first.
    """
    rare = np.append(np.asarray(counts, np.int64), 1)
    groups = {k: [k] for k in np.flatnonzero(rare)}
    length = np.zeros(257, np.int64)
    while len(groups) > 1:
        first, second = sorted(groups, key=lambda k: (rare[k], -k))[:2]
        length[groups[first] + groups[second]] += 1
        rare[first] += rare[second]
        groups[first] += groups.pop(second)
    return length


def optimal_table(counts: np.ndarray) -> tuple[list[int], list[int]] | None:
    """(codes of each length from 1 to 16, symbols by length and number); None if there is nothing to code or a code is too long."""
    length = code_lengths(counts)
    if length.max() == 0 or length.max() > 32:
        return None
    bits = np.bincount(length, minlength=33)
    bits[0] = 0
    for i in range(32, 16, -1):
        while bits[i] > 0:
            j = int(np.flatnonzero(bits[: i - 1])[-1])
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    bits[np.flatnonzero(bits)[-1]] -= 1
    symbols = np.flatnonzero(length[:256])
    return bits[1:17].tolist(), symbols[np.lexsort((symbols, length[symbols]))].tolist()


def tables(counts: DataFrame) -> DataFrame:
    """(image_id, slot, lengths, symbols): the optimal table of each slot of each image; 256 counts a slot at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(256, np.int64)
        full[pdf.symbol.to_numpy()] = pdf.n
        made = optimal_table(full)
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "slot": [pdf.slot.iloc[0]], "lengths": [made and made[0]], "symbols": [made and made[1]]})

    return counts.groupBy("image_id", "slot").applyInPandas(run, "image_id long, slot int, lengths array<int>, symbols array<int>")
