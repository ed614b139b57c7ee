"""Operator 11: SimHash near-duplicates by segment bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its 16 segments of four bits. Flipping one
bit moves one count by one, so the Manhattan distance of two count vectors is at most the Hamming
distance of the fingerprints. The range join of radius 2 is a join on grid cells: of two vectors at
distance 2 or less, one is the other's cell, or a cell lies one step from both. So every vector
enters its own cell, those one step below it and those one step above it; who meets in a cell is
verified on the fingerprints.

Equal fingerprints are folded first. Cells with more than ``MOST`` members are not joined. Their
members enter the finest grid, of 64 segments of one bit, where a cell holds the fingerprints one
bit from a common one: 65 at the most, each two of them two bits apart or less. There every member
is linked with the smallest one, and no pair is formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.components import components
from sparkreel.llm.storage import store, text_of

# What a shingle is hashed with: XXH64 under this seed.
SEED = 42
SEGMENT = 4
MOST = 128
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_ONE_BLANK = _LOWER.translate(bytes.maketrans(BLANKS, b" " * len(BLANKS)))
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """The bits set in over half the hashes of a text's shingles; 0 for a text without words."""
    words = [w for w in text.encode().translate(_ONE_BLANK).split(b" ") if w]
    if not words:
        return 0
    number = max(len(words) - size + 1, 1)
    clean = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:number].tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    count = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for begin in range(0, number, SHINGLES_AT_ONCE):
        spans = zip(first[begin : begin + SHINGLES_AT_ONCE], last[begin : begin + SHINGLES_AT_ONCE])
        values = np.array([hashed(clean[a:b], SEED) for a, b in spans], ">u8")
        count += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > number).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, print`` (64 bits as a signed long) for every row of ``docs`` (``doc_id, text``)."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "print": found.view(np.int64)})

    docs = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return docs.mapInPandas(look, "doc_id long, print long")


def segment_counts(prints: np.ndarray, segment: int) -> np.ndarray:
    """Bit counts of each segment of ``segment`` bits, one row per fingerprint."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(prints), 64 // segment, segment).sum(axis=2).astype(np.int64)


def grid_cells(prints: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the fingerprint, cell and step (-1, 0, 1) of every cell that it enters.

    A cell is a count vector, packed into 64 bits: of 16 segments at three bits each, of 64 at one.
    """
    counts = segment_counts(prints, segment)
    width = int(segment).bit_length()
    weight = np.uint64(1) << np.arange(0, width * counts.shape[1], width, dtype=np.uint64)
    own = (counts.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
    number = np.arange(len(prints))
    owners, cells, steps = [number], [own], [np.zeros(len(prints), np.int8)]
    for step, inside in ((-1, counts > 0), (1, counts < segment)):
        at, dimension = np.nonzero(inside)
        move = weight[dimension]
        owners.append(at)
        cells.append(own[at] - move if step < 0 else own[at] + move)
        steps.append(np.full(len(at), step, np.int8))
    return np.concatenate(owners), np.concatenate(cells), np.concatenate(steps)


def _entered(prints: DataFrame, segment: int) -> DataFrame:
    """``cell, print, step`` of every cell that every fingerprint enters."""

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["print"].to_numpy(np.int64)
            at, cell, step = grid_cells(own.view(np.uint64), segment)
            yield pd.DataFrame({"cell": cell.view(np.int64), "print": own[at], "step": step})

    return prints.select("print").mapInPandas(enter, "cell long, print long, step byte")


def near(a: Column, b: Column, most: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def _meeting(entered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of cells with 2 to ``MOST`` members, and the fingerprints in larger cells."""
    # Counted with a partial count before the shuffle; most cells have one member.
    sizes = store(entered.groupBy("cell").agg(F.count("*").alias("m")).filter("m > 1"))
    few = sizes.filter(F.col("m") <= MOST).select("cell")
    many = sizes.filter(F.col("m") > MOST).select("cell", F.xxhash64("cell").alias("mark"))
    crowded = (
        entered.withColumn("mark", F.xxhash64("cell"))
        .join(many, ["cell", "mark"], "left_semi").select("print").distinct())
    return entered.join(few, "cell", "left_semi"), crowded


def _verified(meeting: DataFrame) -> DataFrame:
    """Links ``a, b`` of fingerprints that meet in a cell and differ in two bits or fewer."""
    left = meeting.select("cell", F.col("print").alias("a"), F.col("step").alias("s"))
    right = meeting.select("cell", F.col("print").alias("b"), F.col("step").alias("t"))
    # Two that meet one step up also meet one step down, so two steps up are left out; nor need a
    # cell's own member meet one that looks up at it, as it looks down at that one's cell.
    ways = "(s = 0 AND t = 0 OR s = -1 AND t = -1) AND a < b OR s = 0 AND t = -1 OR s = 1 AND t = -1"
    return (
        left.join(right, "cell").filter(F.expr(ways) & (F.col("a") != F.col("b")))
        .filter(near(F.col("a"), F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _stars(crowded: DataFrame) -> DataFrame:
    """In the finest grid all members of a cell are linked: each with the smallest one."""
    entered = store(_entered(crowded, 1))
    lowest = entered.groupBy("cell").agg(F.min("print").alias("a"), F.count("*").alias("m"))
    return (
        entered.join(lowest.filter("m > 1").select("cell", "a"), "cell")
        .filter("a <> print").select("a", F.col("print").alias("b")).distinct())


def linked_prints(prints: DataFrame) -> DataFrame:
    """``print, component``: the smallest fingerprint reached, for each distinct one with a link."""
    entered = store(_entered(prints, SEGMENT))
    few, crowded = _meeting(entered)
    crowded = store(crowded)
    links = _verified(few)
    if not crowded.isEmpty():
        links = links.unionAll(_stars(crowded))
    return components(links).select(F.col("id").alias("print"), "component")


def simhash_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, fingerprint, component_id``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of ``size`` words,
    repeats included, are hashed by XXH64 (of fewer words the whole sequence). ``fingerprint`` is
    in 16 hexadecimal digits. Rows are linked when their fingerprints differ in two bits or fewer;
    ``component_id`` is the smallest doc_id that links reach, null where none has one.

    Null and empty texts, and texts of blanks, have fingerprint 0 and are linked like any other.
    Repeated rows come back repeated, rows of one id with different texts each with their own
    fingerprint. Other columns are not looked at. An empty table gives no rows.
    """
    rows = store(fingerprints(docs, size))
    # Copies are folded before anything is joined: a third of all rows may share a fingerprint.
    prints = store(rows.groupBy("print").agg(F.min("doc_id").alias("low")))
    linked = store(linked_prints(prints))
    placed = prints.join(linked, "print", "left").withColumn(
        "component", F.coalesce("component", "print"))
    placed = store(placed)
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id")).withColumn(
        "mark", F.xxhash64("component"))
    named = placed.withColumn("mark", F.xxhash64("component")).join(
        lowest, ["component", "mark"]).select("print", "component_id")
    named = named.withColumn("mark", F.xxhash64("print"))
    # The second key keeps this join on a shuffle of its own, which can be split where one
    # fingerprint holds many rows.
    return (
        rows.withColumn("mark", F.xxhash64("print")).join(named, ["print", "mark"])
        .select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                "component_id"))
