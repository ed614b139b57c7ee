"""Operator 8: repeated word windows, found by super-k-mers.

The minimiser of a window is its ``m``-gram of words with the smallest hash. Consecutive windows
with the same minimiser form a super-k-mer. Equal windows have equal minimisers, so windows are
compared only within the bucket of a minimiser, and a minimiser that occurs once needs no look at
its words. First only minimisers and places travel; the super-k-mers of repeated ones then go to
their bucket as packed strings. Equal strings are pre-aggregated to their first place: every later
string is repeated as a whole. The windows of strings that are not alone in their bucket are then
sorted by name, and all but the first of each run are repeats. Buckets are counted before the
shuffle and joined, never dealt as a whole: a minimiser may stand in a third of all places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.storage import keyed, store, text_of
from sparkreel.llm.streams import runs
from sparkreel.llm.words import shingles, words_of

SHIFT = 64  # a place is start * SHIFT + number of windows


def super_kmers(keys: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and number of windows of each super-k-mer of a document."""
    if len(keys) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = window - m + 1
    value = shingles(keys, m)
    place = np.arange(len(value))
    span = 1
    while span < width:  # leftmost smallest of ever wider spans
        step = min(span, width - span)
        n = len(value) - step
        later = value[step:] < value[:n]
        value = np.where(later, value[step:], value[:n])
        place = np.where(later, place[step:], place[:n])
        span += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return value[first], first, np.diff(np.append(first, len(place)))


def _documents(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for begin in range(0, len(batch), 500):
        texts = batch["text"].iloc[begin : begin + 500].tolist()
        words = words_of(texts)
        for i in range(len(texts)):
            yield begin + i, words.key[words.first[i] : words.first[i + 1]]


def _minimisers(docs: DataFrame, window: int, m: int) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["_key"].to_numpy()
            out, held = [], 0
            for i, keys in _documents(batch):
                value, first, number = super_kmers(keys, window, m)
                out.append((value.view(np.int64), np.full(len(value), ids[i]),
                            first * SHIFT + number))
                held += len(value)
                if held > 1 << 18 or i == len(batch) - 1:
                    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"minimiser": a, "doc": b, "place": c})
                    out, held = [], 0

    return docs.mapInPandas(emit, "minimiser long, doc long, place long")


def _packed(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The super-k-mers at the given places, packed into strings."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc, text, found, own in zip(batch["_key"], batch["text"], batch["places"],
                                             batch["minimisers"], strict=True):
                words = text.encode().split()
                for place, minimiser in zip(found.tolist(), own.tolist(), strict=True):
                    start, number = divmod(place, SHIFT)
                    end = start + number + window - 1
                    packed = b" ".join(words[start:end])
                    out.append((minimiser, packed, doc, place))
                    held += len(packed)
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=["minimiser", "packed", "doc", "place"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["minimiser", "packed", "doc", "place"])

    lists = places.groupBy("doc").agg(
        F.collect_list("place").alias("places"), F.collect_list("minimiser").alias("minimisers"))
    return (
        docs.join(lists, docs["_key"] == lists["doc"]).drop("doc")
        .mapInPandas(emit, "minimiser long, packed binary, doc long, place long"))


def _windows(strings: DataFrame, window: int) -> DataFrame:
    """128-bit names and places of the windows in packed strings."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.iloc[begin : begin + 2000]
                words = words_of([p.decode() for p in part["packed"]], more=True)
                number = part["place"].to_numpy() % SHIFT
                names = [], []
                for i in range(len(part)):
                    own = slice(words.first[i], words.first[i + 1])
                    names[0].append(shingles(words.key[own], window))
                    names[1].append(shingles(words.more[own], window))
                step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                yield pd.DataFrame({
                    "a": np.concatenate(names[0]).view(np.int64),
                    "b": np.concatenate(names[1]).view(np.int64),
                    "doc": np.repeat(part["doc"].to_numpy(), number),
                    "start": np.repeat(part["place"].to_numpy() // SHIFT, number) + step,
                })

    return strings.mapInPandas(emit, "a long, b long, doc long, start long")


def repeated_windows(docs: DataFrame, window: int = 20, m: int = 6) -> DataFrame:
    """``doc, place`` of repeated windows: ``place`` is start * 64 + number of windows from there.

    ``docs`` has ``_key`` and ``text``. A window is repeated if its words also start earlier: in
    a document with a smaller key, or further up in the same one.
    """
    if not 0 < m <= window or window - m + 1 >= SHIFT:
        raise ValueError("m must lie in 1..window, and window - m below 63")
    # Counts are pre-aggregated, and the join splits frequent minimisers (`mark` follows from the
    # key and gives both sides a shuffle of their own): one may stand in a third of all places.
    every = _minimisers(docs, window, m)
    mark = F.xxhash64("minimiser").alias("mark")
    often = (
        every.groupBy("minimiser").agg(F.count("*").alias("n")).filter("n > 1")
        .select("minimiser", mark))
    places = store(
        every.select("*", mark).join(often, ["minimiser", "mark"], "left_semi").drop("mark"))
    strings = (
        _packed(docs, places, window).groupBy("packed")
        .agg(F.min(F.struct("doc", "place")).alias("at"), F.first("minimiser").alias("minimiser"))
        .select("minimiser", "at.doc", "at.place", "packed"))
    strings = store(strings)
    # A place that is not the first of its string is repeated throughout.
    later = places.select("doc", "place").join(
        strings.select("doc", "place"), ["doc", "place"], "left_anti")
    shared = (
        strings.groupBy("minimiser").agg(F.count("*").alias("n")).filter("n > 1")
        .select("minimiser", mark))
    several = strings.select("*", mark).join(shared, ["minimiser", "mark"], "left_semi")
    single = runs(_windows(several, window), ["a", "b"], ["doc", "start"], first=False)
    return later.unionAll(single.select("doc", (F.col("start") * SHIFT + 1).alias("place")))


def substring_dedup(docs: DataFrame, window: int = 20, m: int = 6) -> DataFrame:
    """Removes words covered by a repeated window of ``window`` words.

    Adds ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) to
    ``doc_id, text``. Words are runs of anything but ASCII white space. Null and empty texts, and
    texts with fewer words than a window, lose nothing. Rows that repeat an id and a text are one
    document and get the same result; rows of one id with other texts count as documents of their
    own, ordered by a hash of the text; rows without an id come first. Empty tables give no rows.
    """
    docs = keyed(docs.select("doc_id", text_of("text").alias("text")))
    read = docs.select("_key", "text")
    found = repeated_windows(read, window, m)
    lists = found.groupBy("doc").agg(F.collect_list("place").alias("places"))

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def keep(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, places, strict=True):
            words = text.encode().split()
            if found is None or not len(found):
                rows.append((len(words), 0, b" ".join(words).decode()))
                continue
            start, number = np.divmod(np.asarray(found), SHIFT)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + number + window - 1, -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
            rows.append((len(words), len(words) - len(kept),
                         b" ".join([words[i] for i in kept]).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    return (
        docs.join(lists, docs["_key"] == lists["doc"], "left")
        .select("doc_id", "text", keep("text", "places").alias("out"))
        .select("doc_id", "text", "out.*"))


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return rows.select("doc_id", "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"))
