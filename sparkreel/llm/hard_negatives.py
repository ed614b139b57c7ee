"""Operator 13: hard negatives, by bounds along a spanning tree of the anchors.

Anchors are packed into blocks of similar ones, and every block carries its minimum spanning tree.
All rows are packed into tiles; each block meets each tile once. In a meeting the scores at the
tree's root are computed. The score of a child differs from its parent's by the inner product of
their difference with the candidate, hence by no more than the edge's length times the candidate's
norm: so the parent's score, or what bounds it, bounds the child's. Only candidates whose bounds
overlap a window of the child are scored again, exactly.

Two passes: the first looks for each anchor's best rows of its own label (the window starts at the
worst of the best found so far, first among the anchors of the block itself), the second for the
best rows of other labels in the score windows that the positives open. Each meeting keeps a few
rows per anchor; nothing is formed per pair of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from sparkreel.llm.storage import store

NO_ID = -(2**63)
LARGEST = 2**63 - 2
PACKED = "ids binary, labels binary, code string, dims int, vectors binary"


@dataclass(frozen=True)
class MiningOptions:
    """A negative's score lies from ``least`` to ``most`` hundredths of the positive's score.

    The rest bounds the sizes of tiles, blocks and the groups of tiles that a task looks through.
    """

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95
    anchor_step: int = 50
    tile_values: int = 1 << 16
    block_values: int = 1 << 15
    group_rows: int = 1 << 13

    def rows_of(self, values: int, dims: int) -> int:
        return max(values // max(dims, 1), 8)


def pack(vectors: np.ndarray) -> tuple[str, int, bytes]:
    """Whole numbers in the smallest type that holds them."""
    size = np.abs(vectors).max(initial=0)
    code = "<i2" if size < 2**15 else "<i4" if size < 2**31 else "<f8"
    return code, vectors.shape[1], vectors.astype(code).tobytes()


def unpack(row) -> np.ndarray:
    values = np.frombuffer(row.vectors, row.code).astype(float)
    number = len(row.ids) // 8
    return values.reshape(number, row.dims)


def longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as exact longs, cut off at their range.

    Vectors of different lengths are compared as if filled up with zeros.
    """
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if dims * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = np.asarray(whole(a) @ whole(b).T, object).reshape(len(a), len(b))
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge length of every row in a minimum spanning tree; row 0 is the root."""
    number = len(vectors)
    parent, length = np.zeros(number, np.int32), np.zeros(number)
    nearest = np.full(number, np.inf)
    waiting = np.ones(number, bool)
    last = 0
    waiting[0] = False
    for _ in range(number - 1):
        apart = np.linalg.norm(vectors - vectors[last], axis=1)
        closer = waiting & (apart < nearest)
        nearest[closer], parent[closer] = apart[closer], last
        last = int(np.argmin(np.where(waiting, nearest, np.inf)))
        if not waiting[last]:  # all distances overflow: any order does
            last = int(np.flatnonzero(waiting)[0])
        waiting[last] = False
        length[last] = nearest[last]
    return parent, length


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """Rows by depth, the root first."""
    levels = [np.array([0])]
    left = np.arange(1, len(parent))
    while len(left):
        below = np.isin(parent[left], levels[-1])
        levels.append(left[below])
        left = left[~below]
    return levels


Overlap = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bounded_scores(
    vectors: np.ndarray, parent: np.ndarray, length: np.ndarray, rows: np.ndarray, overlap: Overlap
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of what may lie in a window.

    ``overlap(anchors, low, high)`` tells which bounds, one line per anchor, meet a window.
    """
    norm = np.linalg.norm(rows, axis=1)
    low = np.empty((len(vectors), len(rows)))
    high = np.empty((len(vectors), len(rows)))
    at, column, score = [], [], []
    for depth, level in enumerate(levels_of(parent)):
        if depth == 0:
            low[0], high[0] = -np.inf, np.inf
            meets = np.ones((1, len(rows)), bool)
        else:
            above = parent[level]
            # The second part covers what rounding may take away.
            reach = length[level][:, None] * norm[None, :] * (1 + 1e-9)
            reach += 1 + 1e-9 * (np.abs(low[above]) + np.abs(high[above]))
            low[level], high[level] = low[above] - reach, high[above] + reach
            meets = overlap(level, low[level], high[level])
        for i in np.flatnonzero(meets.any(axis=1)):
            hit = np.flatnonzero(meets[i])
            exact = products(vectors[level[i]][None, :], rows[hit])[0]
            low[level[i], hit] = high[level[i], hit] = exact
            if depth == 0:
                hit = np.flatnonzero(overlap(level, low[level], high[level])[0])
                exact = exact[hit]
            at.append(np.full(len(hit), level[i]))
            column.append(hit)
            score.append(exact)
    if not at:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return np.concatenate(at), np.concatenate(column), np.concatenate(score)


def below(scores: np.ndarray) -> np.ndarray:
    """Floats not above the scores, which may have more digits than a float."""
    return np.nextafter(scores.astype(float), -np.inf)


class Best:
    """The best ``most`` rows per key: highest score, then smallest id, tile and place."""

    def __init__(self, keys: int, most: int) -> None:
        self.most = most
        self.rows = [np.zeros(0, np.int64) for _ in range(5)]
        self.floor = np.full(keys, -np.inf)

    def add(self, key, score, ident, tile, place) -> None:
        rows = [np.concatenate(pair) for pair in zip(self.rows, (key, score, ident, tile, place))]
        key, score, ident, tile, place = rows
        order = np.lexsort((place, tile, ident, -score, key))
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        size = np.diff(np.append(start, len(key))).astype(np.int64)
        rank = np.arange(len(key)) - np.repeat(start, size) if len(key) else key
        keep = order[rank < self.most]
        self.rows = [values[keep] for values in rows]
        full = rank == self.most - 1
        self.floor[key[full]] = below(score[order][full])


def _packed_rows(batch: pd.DataFrame, size: Callable[[int], int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row and the filled-up vectors of each run of rows that makes up one pack."""
    begin = 0
    lengths = batch["vector"].map(len).to_numpy()
    while begin < len(batch):
        end, widest = begin, 0
        while end < len(batch):
            widest = max(widest, lengths[end])
            if end > begin and end - begin >= size(widest):
                break
            end += 1
        vectors = np.zeros((end - begin, max(int(lengths[begin:end].max()), 1)))
        for i in range(begin, end):
            vectors[i - begin, : lengths[i]] = batch["vector"].iloc[i]
        yield begin, end, vectors
        begin = end


def _tiles(rows: DataFrame, options: MiningOptions) -> DataFrame:
    """Valid rows (``vec_id, label, vector``) packed in tiles, each with a number ``tile``."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, end, vectors in _packed_rows(
                    batch, lambda dims: options.rows_of(options.tile_values, dims)):
                vectors = np.floor(256.0 * vectors)
                part = batch.iloc[begin:end]
                code, dims, packed = pack(vectors)
                yield pd.DataFrame([(
                    part["vec_id"].to_numpy(np.int64).tobytes(),
                    part["label"].to_numpy(np.int64).tobytes(), code, dims, packed)],
                    columns=["ids", "labels", "code", "dims", "vectors"])

    return store(rows.mapInPandas(fill, PACKED).withColumn("tile", F.monotonically_increasing_id()))


def _blocks(tiles: DataFrame, options: MiningOptions) -> DataFrame:
    """Anchors packed in blocks with their trees; similar ones come together."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = longs(row.ids)
                own = np.flatnonzero((ids != NO_ID) & (ids % options.anchor_step == 0))
                vectors = unpack(row)[own]
                # Signs of fixed projections: near vectors have most of them in common.
                plane = np.random.default_rng(16).standard_normal((vectors.shape[1], 16))
                sign = ((vectors @ plane) > 0) @ (1 << np.arange(15, -1, -1))
                yield pd.DataFrame({
                    "tile": row.tile, "place": own, "vec_id": ids[own],
                    "label": longs(row.labels)[own], "sign": sign,
                    "vector": pd.Series(list(vectors), dtype=object)})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, end, vectors in _packed_rows(
                    batch, lambda dims: options.rows_of(options.block_values, dims)):
                part = batch.iloc[begin:end]
                parent, length = spanning_tree(vectors)
                yield pd.DataFrame([(
                    part["vec_id"].to_numpy(np.int64).tobytes(),
                    part["label"].to_numpy(np.int64).tobytes(), *pack(vectors),
                    part["tile"].to_numpy(np.int64).tobytes(),
                    part["place"].to_numpy(np.int64).tobytes(),
                    parent.tobytes(), length.tobytes())],
                    columns=["ids", "labels", "code", "dims", "vectors", "tiles", "places",
                             "parent", "length"])

    anchors = tiles.mapInPandas(
        pick, "tile long, place long, vec_id long, label long, sign long, vector array<double>")
    return store(
        anchors.orderBy("label", "sign", "vec_id", "tile", "place")
        .mapInPandas(fill, PACKED + ", tiles binary, places binary, parent binary, length binary")
        .withColumn("block", F.monotonically_increasing_id()))


FOUND = "block long, pos long, w int, score long, id long, tile long, place long"


def _meet(
    blocks: DataFrame, tiles: DataFrame, groups: int,
    search: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
) -> DataFrame:
    """Every block with every tile: each block travels to each group of tiles.

    The table of blocks is small, but not once it is repeated for every group: that must not be
    broadcast. Merged, a block meets all tiles of its group in a row, as ``search`` has it best.
    """
    sent = blocks.select(
        *[F.col(c).alias("b_" + c) for c in blocks.columns],
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    dealt = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    # By number: the rows are few and large in work, so tasks are not to be put together by bytes.
    sent, dealt = sent.repartition(groups, "part"), dealt.repartition(groups, "part")
    return sent.hint("merge").join(dealt, "part").mapInPandas(search, FOUND)


def _block(row) -> SimpleNamespace:
    return SimpleNamespace(**{k[2:]: getattr(row, k) for k in row._fields if k.startswith("b_")})


def _emit(block: int, best: Best, windows: int) -> pd.DataFrame:
    key, score, ident, tile, place = best.rows
    return pd.DataFrame({
        "block": block, "pos": key // windows, "w": (key % windows).astype(np.int32),
        "score": score, "id": ident, "tile": tile, "place": place})


def _own_label(options: MiningOptions) -> Callable:
    """Rows of the anchors' labels with the best scores."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = best = None
        for batch in batches:
            for row in batch.itertuples():
                if held != (row.b_block, row.part):
                    if best is not None:
                        yield _emit(held[0], best, 1)
                    held = (row.b_block, row.part)
                    block = _block(row)
                    vectors, labels = unpack(block), longs(block.labels)
                    parent = np.frombuffer(block.parent, np.int32)
                    length = np.frombuffer(block.length)
                    tiles, places = longs(block.tiles), longs(block.places)
                    best = Best(len(labels), options.positives)
                    # The other anchors of the block are rows too: they tell where to start.
                    inside = below(products(vectors, vectors))
                    inside[labels[:, None] != labels[None, :]] = -np.inf
                    np.fill_diagonal(inside, -np.inf)
                    if len(labels) >= options.positives:
                        at = len(labels) - options.positives
                        best.floor = np.partition(inside, at, axis=1)[:, at]
                rows, other = unpack(row), longs(row.labels)

                def overlap(at, low, high):
                    same = labels[at][:, None] == other[None, :]
                    return same & (high >= best.floor[at][:, None])

                key, column, score = bounded_scores(vectors, parent, length, rows, overlap)
                keep = (score >= best.floor[key]) & (
                    (tiles[key] != row.tile) | (places[key] != column))
                key, column, score = key[keep], column[keep], score[keep]
                floor = best.floor.copy()
                best.add(key, score, longs(row.ids)[column],
                         np.full(len(key), row.tile), column)
                best.floor = np.maximum(best.floor, floor)
        if best is not None:
            yield _emit(held[0], best, 1)

    return search


def _other_labels(options: MiningOptions) -> Callable:
    """Rows of other labels with the best scores in each window (``b_low``, ``b_high``)."""
    windows = options.positives

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = best = None
        for batch in batches:
            for row in batch.itertuples():
                if held != (row.b_block, row.part):
                    if best is not None:
                        yield _emit(held[0], best, windows)
                    held = (row.b_block, row.part)
                    block = _block(row)
                    vectors, labels = unpack(block), longs(block.labels)
                    parent = np.frombuffer(block.parent, np.int32)
                    length = np.frombuffer(block.length)
                    low_of = np.full((len(labels), windows), LARGEST)
                    high_of = np.full((len(labels), windows), -LARGEST)
                    low_of[block.pos, block.w] = block.low
                    high_of[block.pos, block.w] = block.high
                    best = Best(len(labels) * windows, options.negatives)
                rows, other = unpack(row), longs(row.labels)

                def overlap(at, low, high):
                    floor = np.maximum(best.floor.reshape(-1, windows), low_of)
                    meets = np.zeros(low.shape, bool)
                    for w in range(windows):
                        meets |= (high >= floor[at, w][:, None]) & (
                            low <= high_of[at, w].astype(float)[:, None])
                    return meets & (labels[at][:, None] != other[None, :])

                at, column, score = bounded_scores(vectors, parent, length, rows, overlap)
                for w in range(windows):
                    inside = (score >= low_of[at, w]) & (score <= high_of[at, w])
                    key = at[inside] * windows + w
                    value = score[inside]
                    top = value >= best.floor[key]
                    found = column[inside][top]
                    best.add(key[top], value[top], longs(row.ids)[found],
                             np.full(len(found), row.tile), found)
        if best is not None:
            yield _emit(held[0], best, windows)

    return search


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` per anchor and window, with their ``rank`` from 1."""
    order = Window.partitionBy("block", "pos", "w").orderBy(
        F.desc("score"), "id", "tile", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def valid_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of rows that take part, labels as they are used."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    return vectors.filter(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    ).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))


def mine_hard_negatives(
    vectors: DataFrame, options: MiningOptions = MiningOptions()
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``. Rows with a null label, a null vector or a
    component that is null or not finite take no part; other columns are not looked at. Where
    vec_id is divisible by 7 the label becomes ``(label + 1) % 10``; components become
    ``floor(256 x)``. Anchors are the rows whose vec_id is divisible by ``anchor_step``. A score is
    the integer inner product with the anchor; higher ones come first, ties by smaller vec_id (rows
    without one come before all, and are no anchors). Rows of an anchor's label, the anchor itself
    left out, give its first ``positives``; for each the first ``negatives`` rows of other labels
    whose score lies from ``least`` to ``most`` hundredths of the positive's are returned, ``rank``
    from 1. Rows listed twice are two rows. Vectors of different lengths are compared as if filled
    up with zeros, empty ones score 0. Scores beyond a long are cut off at its range. An empty
    table, or one without anchors, gives no rows.
    """
    tiles = _tiles(valid_rows(vectors), options)
    blocks = _blocks(tiles, options)
    rows = tiles.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    groups = max(1, -(-int(rows) // options.group_rows))
    names = blocks.select("block", F.posexplode(_longs("ids")).alias("pos", "anchor_id"))

    found = _meet(blocks, tiles, groups, _own_label(options))
    best = store(_top(found, options.positives).select(
        "block", "pos", (F.col("rank") - 1).alias("w"), "score", "id"))
    # In whole numbers: least * p <= 100 * n <= most * p, without leaving the range of a long.
    low, high = _share("score", options.least, True), _share("score", options.most, False)
    windows = best.groupBy("block").agg(
        F.collect_list("pos").alias("pos"), F.collect_list("w").alias("w"),
        F.collect_list(low).alias("low"), F.collect_list(high).alias("high"))
    found = _meet(blocks.join(windows, "block"), tiles, groups, _other_labels(options))
    negatives = _top(found, options.negatives).select(
        "block", "pos", "w", "rank", F.col("id").alias("n_id"), F.col("score").alias("n_score"))

    def shown(column: str):
        return F.nullif(F.col(column), F.lit(NO_ID))

    return (
        negatives.join(best, ["block", "pos", "w"]).join(names, ["block", "pos"])
        .select("anchor_id", shown("id").alias("positive_id"), "rank",
                shown("n_id").alias("negative_id"), F.col("score").alias("positive_score"),
                F.col("n_score").alias("negative_score")))


def _share(column: str, hundredths: int, up: bool):
    """``hundredths * column / 100``, rounded up or down, within the range of a long."""
    rest = F.pmod(F.col(column), F.lit(100))
    more = F.floor((rest * hundredths + (99 if up else 0)) / 100)
    return F.floor(F.expr(f"({column} - pmod({column}, 100)) div 100")) * hundredths + more


@F.pandas_udf(ArrayType(LongType()))
def _longs(packed: pd.Series) -> pd.Series:
    return packed.map(lambda p: np.frombuffer(p, np.int64))
