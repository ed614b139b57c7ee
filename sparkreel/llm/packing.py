"""Operator 7: best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into groups at random;
each group packs its own by best-fit decreasing and compares the number of bins with lower bounds
from dual feasible functions. A group whose count meets its bound is certified, and only its last
gap is worth another try; any other group has gaps all over. The bins with gaps are given back,
the groups exchange what is in them (they are dealt anew into fewer groups), and best-fit
decreasing runs again, until one group is left or the bound of what is left is met. Groups double
where less than half was settled, up to 2^20 pieces, which a task can hold; groups of that size
exchange as long as that saves bins.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm import bpe
from sparkreel.llm.storage import store, text_of
from sparkreel.llm.workers import parts_of, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, kept boolean"
MOST_PER_GROUP = 1 << 20


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``.

    A document longer than ``capacity`` is cut into pieces of that length, the first one taking
    the remainder. A null or empty text is one piece holding ``end_id`` alone.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = bpe.load(vocabulary)
        for batch in batches:
            rows = []
            # The ids of some documents at a time are held, not those of a batch.
            for begin, texts in parts_of(batch["text"], 1000, 4 * bpe.CHUNK_CHARS):
                counts, ids = engine.encode(texts)
                of = batch["doc_id"].iloc[begin : begin + len(texts)]
                for doc_id, n, tokens in zip(of, counts.tolist(), ids, strict=True):
                    all_ids = np.append(tokens, end_id).astype("<u4")
                    total = n + 1
                    at, size = 0, (total - 1) % capacity + 1
                    piece = 0
                    while at < total:
                        crc = zlib.crc32(all_ids[at : at + size].data)
                        rows.append((doc_id, piece, at, size, crc))
                        at, size, piece = at + size, capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInPandas(
        tidy(cut), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest value over families of dual feasible functions."""
    return bound_of_counts(*np.unique(lengths.astype(np.int64), return_counts=True), capacity)


def bound_of_counts(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """The same of distinct lengths, ascending, and how often each occurs."""
    if not len(size):
        return 0
    best = math.ceil(int((size * count).sum()) / capacity)
    # Pieces over capacity - t fill a bin, those under t count nothing.
    total = np.concatenate([[0], np.cumsum(size * count)])
    number = np.concatenate([[0], np.cumsum(count)])
    for t in size[size <= capacity // 2].tolist():
        low = np.searchsorted(size, t)
        high = np.searchsorted(size, capacity - t, side="right")
        filled = int(number[-1] - number[high])
        best = max(best, filled + math.ceil(int(total[high] - total[low]) / capacity))
    # Rounding to k-ths of a bin, exact multiples kept as they are.
    for k in range(1, 33):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, math.ceil(int((value * count).sum()) / (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the space left in each bin: best fit, longest first."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s: some bin has s left
    space: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = open_spaces >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            chosen = by_space[left].pop()
            if not by_space[left]:
                open_spaces ^= 1 << left
        else:
            left, chosen = capacity, len(space)
            space.append(capacity)
        bins[i], offsets[i] = chosen, capacity - left
        space[chosen] = left - length
        by_space[left - length].append(chosen)
        open_spaces |= 1 << (left - length)
    return bins, offsets, np.array(space, np.int64)


def _packer(capacity: int, round_no: int, last: bool) -> Callable[..., pd.DataFrame]:
    """Packs one group; ``kept`` tells which rows stay where they are."""

    def pack_group(key, rows):
        lengths = rows["length"].to_numpy()
        bins, offsets, space = best_fit(lengths, capacity)
        full = space == 0
        if len(space) == lower_bound(lengths, capacity):
            # Certified: only the emptiest bin, the rounding of the bound, is given back.
            full = np.ones(len(space), bool)
            full[np.argmax(space)] = space.max() == 0
        rows["sequence_id"] = (round_no << 52) + (int(key[0]) << 24) + bins
        rows["offset"] = offsets
        rows["kept"] = True if last else full[bins]
        return rows.drop(columns="group")

    return pack_group


def pack(pieces: DataFrame, capacity: int = 2048, per_group: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length, ids_crc32``).

    Every row is placed once, repeated rows and null ids included. Rows are dealt by a random
    number, so no key can make a group large; a group holds about ``per_group`` rows, in later
    rounds up to ``MOST_PER_GROUP``, whatever the size of the table. Empty tables give no rows.
    """
    waiting = pieces
    final: list[DataFrame] = []
    number, bins = waiting.count(), None
    for round_no in itertools.count():
        groups = max(1, math.ceil(number / per_group))
        last = groups == 1
        # A stored table keeps its row numbers, so a repeated task deals its rows alike.
        dealt = waiting.withColumn(
            "group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), groups))
        packed = store(dealt.groupBy("group").applyInPandas(
            _packer(capacity, round_no, last), PACKED))
        final.append(packed.filter("kept").drop("kept"))
        if last:
            break
        rest = packed.filter("NOT kept")
        counts = sorted(rest.groupBy("length").agg(
            F.count("*"), F.count_if(F.col("offset") == 0)).collect())
        size, count, first = np.array(counts, np.int64).reshape(-1, 3).T
        before, number = number, int(count.sum())
        bins_before, bins = bins, int(first.sum())
        large = per_group >= MOST_PER_GROUP and number > before // 2
        if bins == bound_of_counts(size, count, capacity) or (
                large and bins_before is not None and bins >= bins_before):
            final.append(rest.drop("kept"))
            break
        waiting = rest.select(pieces.columns)
        # Bins with gaps are dealt anew; whole bins' worth of them must be able to meet.
        if number > before // 2:
            per_group = max(per_group, min(2 * per_group, MOST_PER_GROUP))
    out = final[0]
    for part in final[1:]:
        out = out.unionAll(part)
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, per_group: int = 4096
) -> DataFrame:
    """Documents (``doc_id, text``; other columns are not read) as packed pieces."""
    pieces = store(cut_pieces(docs, vocabulary, capacity))
    return pack(pieces, capacity, per_group)
