"""Operator 10: exact n-gram Jaccard join.

A document is its set of n-gram hashes. Sets are banded by size. Two linked sets differ in at most
D of their members, where D follows from the largest sizes in the band; so when the hash space is
cut into more than D tiles, at least one tile holds exactly the same members of both. Sets that
agree in a tile are candidates, and nothing else needs to be looked at. Candidates are compared by
bitmaps of hashed places with an odd number of members first (a differing bit stands for a member
that only one set has), then by intersecting the sorted arrays.

Groups of thousands of near copies agree in the same tiles. Each tile first pairs its members with
its smallest one only, and each set is compared with the one it is paired with most often; pairs
that these links have not connected yet are compared afterwards.
So no link between components is lost, and a group costs as many comparisons as it has members.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.components import components
from sparkreel.llm.storage import discard, folded, keyed, small, store, text_of, unfolded
from sparkreel.llm.words import scramble, shingles, words_of
from sparkreel.llm.workers import parts_of, tidy

# Bits of a set's bitmap, and of one with more members than ``LARGE``.
BITS, LARGE, LARGE_BITS = 1024, 2048, 4096
BROADCAST_IDS = 500_000
PER_PART = 256
U = np.uint64


@functools.cache
def band_edges(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands; a set's smaller partners are in its own band or the one before."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * den * den / (num * num))))
    return np.array(edges)


@functools.cache
def tiles_of(band: int, num: int, den: int) -> tuple[int, int]:
    """Tiles of a band, and how many of them may be empty in a set before that matters.

    Of ``D + 1 + spare`` tiles at least ``1 + spare`` agree, so one agreeing tile has members
    unless more than ``spare`` tiles are empty.
    """
    edges = band_edges(num, den)
    differ = (den - num) * 2 * (int(edges[band + 1]) - 1) // (den + num)
    if not differ:
        return 0, 0
    spare = 0
    for _ in range(8):
        tiles = differ + 1 + spare
        mean = tiles * math.exp(-edges[band] * num / den / tiles)
        spare = math.ceil(mean + 4 * math.sqrt(mean))
    return differ + 1 + spare, spare


def tile_keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys under which a set (sorted, distinct) can meet every set it may be linked with."""
    edges = band_edges(num, den)
    n = len(members)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    bands = [own] if own >= 0 else []
    if n * den >= num * int(edges[own + 1]):
        bands.append(own + 1)
    keys = []
    for band in bands:
        tiles, spare = tiles_of(band, num, den)
        if not tiles:
            continue
        tile = ((members >> U(32)) * U(tiles)) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        total = np.add.reduceat(scramble(members, 3), first)
        place = tile[first] + U(band << 32)
        keys.append(scramble(total + scramble(place, 4), 1))
        if tiles - len(first) > spare:
            empty = np.setdiff1d(np.arange(tiles, dtype=np.uint64), tile[first])
            keys.append(scramble(scramble(empty + U(band << 32), 4), 5))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sets(batch: pd.DataFrame, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each text that has words."""
    for begin, texts in parts_of(batch["text"]):
        words = words_of(texts, lower=True)
        for i in range(len(texts)):
            keys = words.key[words.first[i] : words.first[i + 1]]
            if len(keys):
                yield begin + i, np.unique(shingles(keys, size))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _names(members: np.ndarray) -> tuple[int, int, int]:
    """Size and 128-bit name of a set."""
    sums = [np.add.reduce(scramble(members, turn), keepdims=True) for turn in (3, 4)]
    return len(members), int(_signed(sums[0])[0]), int(_signed(sums[1])[0])


def _parities(members: np.ndarray) -> np.ndarray:
    """Bitmap of the places with an odd number of members.

    Members of both sets cancel out, so two bitmaps differ by what the sets do not share, however
    large they are; a bitmap of the places taken would fill up.
    """
    places = LARGE_BITS if len(members) > LARGE else BITS
    counts = np.bincount((members % U(places)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    """``_key, doc_id, n_shingles, name_a, name_b, bits``: size, name, bitmap of each row's set."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = np.zeros((len(batch), 3), np.int64)
            bitmaps = [np.zeros(BITS // 64, np.int64)] * len(batch)
            for i, members in _sets(batch, size):
                names[i] = _names(members)
                bitmaps[i] = _parities(members)
            yield pd.DataFrame({
                "_key": batch["_key"], "doc_id": batch["doc_id"].astype("Int64"),
                "n_shingles": names[:, 0],
                "name_a": names[:, 1], "name_b": names[:, 2],
                "bits": bitmaps})

    return docs.mapInPandas(
        tidy(name), "_key long, doc_id long, n_shingles long, name_a long, name_b long, bits array<long>")


def _keys(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, held = [], [], 0
            own = batch["_key"].to_numpy(np.int64)
            for i, members in _sets(batch, size):
                found = tile_keys(members, num, den)
                keys.append(found)
                ids.append(np.full(len(found), own[i]))
                held += len(found)
                if held > 1 << 18:
                    yield pd.DataFrame({"key": _signed(np.concatenate(keys)),
                                        "id": np.concatenate(ids)})
                    ids, keys, held = [], [], 0
            if held:
                yield pd.DataFrame({"key": _signed(np.concatenate(keys)),
                                    "id": np.concatenate(ids)})

    return docs.select("_key", "text").mapInPandas(tidy(emit), "key long, id long")


def _met(keys: DataFrame) -> DataFrame:
    """``key, id, low``: rows whose key has several ids, and the smallest of them, each once.

    Rows come sorted by key and id and are looked through as a stream, so the length of a run does
    not matter; a document has many keys, so one key has a small share of the rows.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key = last_id = low = None
        told = False  # whether the first row of the open run has been given out
        for batch in batches:
            key, ident = batch["key"].to_numpy(), batch["id"].to_numpy()
            if not len(key):
                continue
            again = np.concatenate([
                [key[0] == last_key and ident[0] == last_id],
                (key[1:] == key[:-1]) & (ident[1:] == ident[:-1])])
            last_id = ident[-1]
            key, ident = key[~again], ident[~again]
            if not len(key):
                continue
            fresh = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            first = np.flatnonzero(fresh)
            lows = np.empty(len(key), np.int64)
            opened = np.concatenate([[low if low is not None else 0], ident[first]])
            lows[:] = opened[np.cumsum(fresh)]
            keep = ~fresh
            follows = np.concatenate([~fresh[1:], [False]])
            out = [pd.DataFrame({"key": key, "id": ident, "low": lows})[keep | (fresh & follows)]]
            if not fresh[0] and not told:
                out.append(pd.DataFrame({"key": [last_key], "id": [low], "low": [low]}))
            told = bool(keep[-1])
            last_key, low = key[-1], lows[-1]
            yield pd.concat(out)

    return (
        keys.repartition("key").sortWithinPartitions("key", "id")
        .mapInPandas(tidy(runs), "key long, id long, low long")
    )


def _contents(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id, members``: sorted hashes of the wanted documents, which ``docs`` lists once."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sets = [], []
            for i, members in _sets(batch, size):
                ids.append(batch["_key"].iloc[i])
                sets.append(members.tobytes())
                if len(ids) == 100:
                    yield pd.DataFrame({"id": ids, "members": sets})
                    ids, sets = [], []
            if ids:
                yield pd.DataFrame({"id": ids, "members": sets})

    return (
        docs.select("_key", "text")
        .join(small(wanted, BROADCAST_IDS), F.col("_key") == wanted["id"], "left_semi")
        .mapInPandas(tidy(fetch), "id long, members binary"))


def _listed_once(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``docs`` with one row for each key; rows that share a key hold the same text."""
    again = store(
        sizes.groupBy(F.col("_key").alias("id")).agg(F.count("*").alias("n")).filter("n > 1"))
    if again.isEmpty():
        return docs
    several = small(again.select("id"), BROADCAST_IDS)
    same = docs["_key"] == several["id"]
    return store(
        docs.join(several, same, "left_anti").unionByName(
            docs.join(several, same, "left_semi").dropDuplicates(["_key"])))


def _info(sizes: DataFrame) -> DataFrame:
    """``id, n, bits`` of every document with n-grams."""
    return (
        sizes.filter("n_shingles > 0").groupBy(F.col("_key").alias("id"))
        .agg(F.min(F.struct("n_shingles", "name_a", "name_b", "bits")).alias("one"))
        .select("id", F.col("one.n_shingles").alias("n"), "one.bits"))


def may_link(
    bits_a: Column, bits_b: Column, size_a: Column, size_b: Column, num: int, den: int
) -> Column:
    """False only for pairs that cannot be linked.

    Linked sets differ in at most ``(den - num) / (den + num)`` of their summed sizes, and every bit
    in which their bitmaps of odd counts differ stands for at least one member that one set lacks;
    so bit counts bound the overlap from above.
    """
    few = reduce(Column.__add__, [
        F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(BITS // 64)])
    many = F.aggregate(
        F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
        lambda total, bits: total + bits)
    # Bitmaps of two lengths tell nothing; that is for sets on both sides of the border.
    differ = F.when((size_a <= LARGE) & (size_b <= LARGE), few).when(
        (size_a > LARGE) & (size_b > LARGE), many).otherwise(0)
    return (
        (size_a * den >= size_b * num) & (size_b * den >= size_a * num)
        & (differ * (den + num) <= (size_a + size_b) * (den - num)))


def _turned(pairs: DataFrame) -> DataFrame:
    """``centre, part, other``: the pairs ``a, b``, dealt by the end that more of them share.

    A centre's pairs go to parts of about ``PER_PART``, so that none is too large for a task.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    degree = store(ends.groupBy("id").agg(F.count("*").alias("n")))
    for end in ("a", "b"):
        pairs = pairs.join(
            degree.select(F.col("id").alias(end), F.col("n").alias("n_" + end)), end)
    parts = F.floor(F.greatest("n_a", "n_b") / PER_PART) + 1
    turned = store(
        pairs.withColumn("centre", F.when(F.col("n_b") > F.col("n_a"), F.col("b")).otherwise(F.col("a")))
        .withColumn("other", F.when(F.col("n_b") > F.col("n_a"), F.col("a")).otherwise(F.col("b")))
        .select("centre", F.pmod(F.xxhash64("other"), parts).alias("part"), "other"))
    discard(degree)
    return turned


def _linked(
    pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int
) -> DataFrame:
    """The pairs ``a, b`` that are linked, by intersecting the sorted arrays.

    A set travels once for each pair in which it is not the centre, and a centre once for each of
    its parts. Rows come sorted, a centre before the others of its part, and are looked through.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            found = []
            for centre, ident, members in zip(
                    batch["centre"], batch["id"], batch["members"], strict=True):
                members = np.frombuffer(members, np.uint64)
                if ident == centre:
                    held = members
                    continue
                common = len(np.intersect1d(held, members, assume_unique=True))
                if den * common >= num * (len(held) + len(members) - common):
                    found.append((min(centre, ident), max(centre, ident)))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    turned = _turned(pairs)
    asked = store(
        turned.select("centre", "part", F.col("other").alias("id")).unionAll(
            turned.select("centre", "part", F.col("centre").alias("id")).distinct()))
    wanted = store(asked.select("id").distinct())
    sets = (
        _contents(docs, wanted, size).join(small(asked, BROADCAST_IDS), "id")
        .select("centre", "part", (F.col("id") != F.col("centre")).alias("later"), "id", "members"))
    linked = store(
        sets.repartition("centre", "part").sortWithinPartitions("centre", "part", "later")
        .select("centre", "id", "members").mapInPandas(tidy(compare), "a long, b long"))
    discard(turned, asked, wanted)
    return linked


def _apart(members: DataFrame, found: DataFrame, info: DataFrame) -> DataFrame:
    """``key, v, component, n, bits`` of tiles whose members are in several components.

    Two members alone have been compared already.
    """
    # Narrow rows first: bitmaps join only the members that are still apart.
    placed = store(
        members.join(found.select(F.col("id").alias("v"), "component").distinct(), "v", "left")
        .withColumn("component", F.coalesce("component", "v")))
    apart = (
        placed.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
        .filter("x <> y AND m > 2").select("key", F.xxhash64("key").alias("mark")))
    apart = placed.withColumn("mark", F.xxhash64("key")).join(
        apart, ["key", "mark"], "left_semi").drop("mark")
    apart = store(apart.join(info.withColumnRenamed("id", "v"), "v"))
    discard(placed)
    return apart


def _apart_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that no path of links connects yet."""
    of = found.groupBy("id").agg(F.min("component").alias("c"))
    for end in ("a", "b"):
        mine = of.select(F.col("id").alias(end), F.col("c").alias("c_" + end))
        pairs = pairs.join(mine, end, "left").withColumn("c_" + end, F.coalesce("c_" + end, end))
    return pairs.filter("c_a <> c_b").select("a", "b")


def _across(
    both: DataFrame, picked: bool, num: int, den: int
) -> DataFrame:
    """Pairs of a tile's members in different components that may be linked.

    With ``picked`` those with one member of each tile only, chosen by hash.
    """
    names = ["v", "component", "n", "bits"]
    left = both.select("key", *[F.col(x).alias("a_" + x) for x in names])
    right = both
    if picked:
        one = F.max(F.struct(F.xxhash64("v", "key").alias("h"), *names)).alias("one")
        right = both.groupBy("key").agg(one).select("key", "one.*")
    right = right.select("key", *[F.col(x).alias("b_" + x) for x in names])
    possible = may_link(
        F.col("a_bits"), F.col("b_bits"), F.col("a_n"), F.col("b_n"), num, den)
    order = "a_v <> b_v" if picked else "a_v < b_v"
    return left.join(right, "key").filter(f"{order} AND a_component <> b_component").filter(
        possible).select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b"))


def _linked_rows(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``_key, doc_id, n_shingles, component`` of each row of ``docs`` (``_key, doc_id, text``).

    ``component`` is the smallest key that links reach.
    """
    sizes = store(_sizes(docs, size))
    named = sizes.filter("n_shingles > 0")
    name = ["n_shingles", "name_a", "name_b"]
    mark = F.xxhash64(*name)
    classes = (
        named.groupBy(*name).agg(F.min("_key").alias("low"), F.count("*").alias("n"))
        .filter("n > 1").drop("n").withColumn("mark", mark))
    # Rows with equal sets are copies of their smallest; only that one is compared.
    copies = store(
        named.withColumn("mark", mark).join(classes, [*name, "mark"])
        .filter("_key <> low").select(F.col("_key").alias("id"), "low").distinct())
    docs = _listed_once(docs, sizes)
    copied = small(copies.select("id"), BROADCAST_IDS)
    originals = docs.join(copied, docs["_key"] == copied["id"], "left_anti")
    met = store(_met(_keys(originals, size, num, den)))
    first = store(
        met.filter("id <> low").groupBy(F.col("low").alias("a"), F.col("id").alias("b"))
        .agg(F.count("*").alias("tiles")))
    info = store(_info(sizes))
    left = info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    possible = may_link(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), num, den)
    likely = store(
        first.join(left, "a").join(right, "b").filter(possible).select("a", "b", "tiles"))
    same = copies.select(F.col("id").alias("a"), F.col("low").alias("b"))
    # Each set is compared with the one it shares most tiles with; that connects most of what can
    # be. Pairs within a component then need no look at their sets.
    best = store(
        likely.groupBy("b").agg(F.max(F.struct("tiles", "a")).alias("one")).select("one.a", "b"))
    links = store(_linked(best, docs, size, num, den).unionAll(same))
    found = components(links)
    open_pairs = store(_apart_pairs(likely.join(best, ["a", "b"], "left_anti"), found))
    if not open_pairs.isEmpty():
        links = store(links.unionAll(_linked(open_pairs, docs, size, num, den)))
        found = components(links)

    # Members of a tile that are still apart: first against a member picked at random in each tile,
    # which connects most of what can be, then across the components that are left, never within.
    members = met.select("key", F.col("id").alias("v"))
    tested = first.select("a", "b")
    for picked in (True, False):
        apart = _apart(members, found, info)
        pairs = _across(apart, picked, num, den)
        rest = store(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        discard(apart)
        if not rest.isEmpty():
            links = store(links.unionAll(_linked(rest, docs, size, num, den)))
            found = components(links)
            tested = tested.unionAll(rest)
    discard(met, likely, first, best, open_pairs)
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    return (
        sizes.select("_key", "doc_id", "n_shingles")
        .join(found, F.col("_key") == F.col("id"), "left").drop("id")
        .withColumn("component", F.coalesce("component", "_key")))


def jaccard_components(
    docs: DataFrame, size: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct
    n-grams of ``size`` words, of fewer words the whole sequence. Two documents are linked when
    ``den * intersection >= num * union``; ``component_id`` is the smallest doc_id that links
    reach, null where they reach none. Null and empty texts have no n-grams and no links. Rows
    that repeat an id and a text are one document; rows of one id with other texts, and rows
    without an id, are documents of their own. Empty tables give no rows.
    """
    docs = keyed(docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")))
    found = _linked_rows(docs, size, num, den)
    if docs.filter("NOT _key <=> doc_id").isEmpty():
        return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    found = store(found)
    lowest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(lowest, "component").select("doc_id", "n_shingles", "component_id")


def without_near_copies(
    docs: DataFrame, size: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component.

    Rows that repeat an id and a text are copies as well; texts without words are not.
    """
    own = docs.columns
    docs = keyed(folded(docs))
    read = docs.select("_key", F.col("doc_id").cast("long"), text_of("text").alias("text"))
    found = store(_linked_rows(read, size, num, den).drop("doc_id"))
    later = found.filter("_key <> component").select("_key").distinct()
    kept = docs.join(later, "_key", "left_anti")
    again = store(
        found.filter("n_shingles > 0 AND _key = component").groupBy("_key")
        .agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    if not again.isEmpty():
        kept = kept.join(again, "_key", "left_anti").unionByName(
            kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*unfolded(own))
