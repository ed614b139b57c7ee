"""Operator 12: conversation structure repair by prefix-doubling path ranking.

A conversation is read by an automaton over role initials that accepts ``(s?(ua)+)?``. Keeping,
reroling, deleting and inserting turns are arcs with costs between nodes (turn, state). Costs to
the end follow from a dynamic program; arcs on cheapest paths are optimal. Nodes are then ranked
by the least audit (the labels along optimal arcs) of 1, 2, 4, ... edits: the rank for twice the
length is that of the pair (own rank, rank of the node reached), and pointers double along. The
ranks settle which arc a node takes, and the least path is read off the doubled pointers.

Turns are put in order by one range sort of narrow rows and dealt in blocks of consecutive turns of
one conversation, so a conversation of any length is spread over tasks. A block is first reduced to
the costs between its four entry and four exit states; a scan over the blocks (a tree of fixed
fan-in, level after level) tells every block the costs behind it, each block ranks its own nodes for
all four entry states, and a second scan tells where the path enters. Blocks are worked off many at
a time. Texts travel once, at the end, to be written in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sparkreel.llm.storage import NO_ID, store

BLOCK_BITS = 12
ROWS_AT_ONCE = 1 << 15
BLANK_ONLY = r"\A[ \t-\r]*\z"
ENDED = r"[.!?][ \t-\r]*\z"

# Costs of the edits, and what an undeleted turn without an end adds.
REROLE, DELETE, INSERT, UNENDED = 3, 4, 3, 3
# States: nothing read, after s, after u, after a. A user turn may follow all but u.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
CLOSING = ["", "ua", "a", ""]
CLOSE = np.array([INSERT * len(c) for c in CLOSING])
FAR = 1 << 40
# Labels in the order of their letters.
D, I, K, R = 1, 2, 3, 4
CLASSES = "sua"


def _edits() -> tuple[np.ndarray, np.ndarray]:
    """Cost and target of D, K and R (by label) for every code of a turn and every state.

    A code is the class of the role (s, u, a, other) + 4 if it must go + 8 if it has no end.
    """
    cost = np.full((5, 16, 4), FAR)
    target = np.zeros((5, 16, 4), np.int64)
    for code in range(16):
        role, gone, more = code & 3, code & 4, UNENDED * (code >> 3)
        for state in range(4):
            cost[D, code, state], target[D, code, state] = DELETE, state
            if gone:
                continue
            if role == 0 and state == START:
                cost[K, code, state], target[K, code, state] = more, SYSTEM
            if role == 1 and NEXT[state] == USER or role == 2 and NEXT[state] == ASSISTANT:
                cost[K, code, state], target[K, code, state] = more, NEXT[state]
            cost[R, code, state], target[R, code, state] = REROLE + more, NEXT[state]
    return cost, target


COST, TARGET = _edits()


def _after_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs to the end (last axis: states) where up to two inserts may come first."""
    one = np.minimum(costs, INSERT + costs[..., NEXT])
    return np.minimum(one, INSERT + one[..., NEXT])


def _before(code: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs to the end before turns ``code`` from those ``behind`` them (axes: turn, .., state)."""
    index = code.reshape(-1, *[1] * (behind.ndim - 1))
    rows = np.arange(len(code)).reshape(index.shape)
    best = np.full(behind.shape, FAR)
    for label in (D, K, R):
        cost, target = COST[label][code], TARGET[label][code]
        if behind.ndim == 3:
            lines = np.arange(behind.shape[1])[None, :, None]
            reached = behind[rows, lines, target[:, None, :]]
            best = np.minimum(best, cost[:, None, :] + reached)
        else:
            best = np.minimum(best, cost + behind[rows, target])
    return _after_inserts(best)


def _columns(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes in one array, the first place of each block in it, and their numbers."""
    size = np.array([len(c) for c in codes])
    return np.frombuffer(b"".join(codes), np.uint8), np.cumsum(size) - size, size


def _backwards(code: np.ndarray, first: np.ndarray, size: np.ndarray, behind: np.ndarray,
               keep: bool) -> np.ndarray:
    """Costs before each block (or, with ``keep``, before each turn and behind each block)."""
    now = behind.copy()
    held = np.zeros((len(code) + len(size), *behind.shape[1:]), np.int64) if keep else None
    base = first + np.arange(len(size))
    if keep:
        held[base + size] = now
    for step in range(int(size.max(initial=0))):
        active = np.flatnonzero(size > step)
        at = size[active] - 1 - step
        now[active] = _before(code[first[active] + at], now[active])
        if keep:
            held[base[active] + at] = now[active]
    return held if keep else now


def transfer(codes: list[bytes]) -> np.ndarray:
    """Costs between the four entry and exit states of each block of turns."""
    code, first, size = _columns(codes)
    behind = np.full((len(codes), 4, 4), FAR)
    behind[:, np.arange(4), np.arange(4)] = 0
    # Axis 1 is the exit state, axis 2 the entry state while walking back.
    return np.minimum(_backwards(code, first, size, behind, False), FAR).transpose(0, 2, 1)


def rank_paths(codes: list[bytes], behind: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Least cheapest path of each block from each entry state, and the states it exits in.

    ``behind`` holds the costs from each exit state to the end of the conversation. A path is
    spelled in edits: ``u`` and ``a`` insert, ``U`` and ``A`` rerole, ``K`` keeps, ``D`` deletes.
    """
    code, first, size = _columns(codes)
    cost = _backwards(code, first, size, behind, True)
    number = len(cost)
    place = np.arange(number)
    last = first + np.arange(len(size)) + size
    inner = np.ones(number, bool)
    inner[last] = False
    turn = np.zeros(number, np.int64)
    turn[inner] = code
    state = np.arange(4)

    # Optimal arcs of every node (place, state), label by label.
    goal = np.zeros((5, number, 4), np.int64)
    optimal = np.zeros((5, number, 4), bool)
    for label in (D, K, R):
        to = TARGET[label][turn]
        ahead = np.minimum(place + 1, number - 1)[:, None]
        goal[label] = ahead * 4 + to
        optimal[label] = COST[label][turn] + cost[ahead, to] == cost
    goal[I] = place[:, None] * 4 + NEXT[state][None, :]
    optimal[I] = INSERT + cost[:, NEXT] == cost
    optimal[:, ~inner] = False
    goal, optimal = goal.reshape(5, -1), optimal.reshape(5, -1)

    # Audits of one edit are ranked by their letter; exits, where audits go on elsewhere, by 0.
    # An edit of one kind has one target, so a node's least letter names a single arc.
    rank = np.where(optimal.any(axis=0), optimal.argmax(axis=0), 0)
    node = np.arange(number * 4)
    letter, pointer = rank, np.where(rank > 0, goal[rank, node], node)
    pointers = [pointer]
    while (rank[pointer] > 0).any():
        # Twice the length: by the first half, then by the rank of the node that it leads to.
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        rank = np.where(letter > 0, rank + 1, 0)
        pointer = pointer[pointer]
        pointers.append(pointer)

    # The path of each entry through the doubled pointers: first its middle, then the quarters.
    entry = ((first + np.arange(len(size)))[:, None] * 4 + state[None, :]).ravel()
    path = entry[:, None]
    for pointer in reversed(pointers):
        path = np.stack([path, pointer[path]], axis=2).reshape(len(entry), -1)
    exits = pointers[-1][entry].reshape(-1, 4) % 4
    symbol = np.array(list(" D?KR"))[letter]
    aim = np.array(list("?sua"))[goal[letter, node] % 4]
    symbol = np.where(letter == I, aim, np.where(letter == R, np.char.upper(aim), symbol))
    spelled = symbol[path]
    words = ["".join(line).rstrip(" ") for line in spelled.tolist()]
    return [words[i : i + 4] for i in range(0, len(words), 4)], exits


def _chunks(codes: list[bytes]) -> Iterator[slice]:
    begin, held = 0, 0
    widest = 0
    for i, code in enumerate(codes):
        # Paths are laid out to the length of the longest, so long and short ones share no chunk.
        widest = max(widest, len(code) + 1)
        held += 1
        if widest * held > ROWS_AT_ONCE and i > begin:
            yield slice(begin, i)
            begin, held, widest = i, 1, len(code) + 1
    if begin < len(codes):
        yield slice(begin, len(codes))


@F.pandas_udf(ArrayType(LongType()))
def _transfer(codes: pd.Series) -> pd.Series:
    """The sixteen costs of a block, entry by entry."""
    codes = codes.tolist()
    out = [transfer(codes[part]).reshape(-1, 16) for part in _chunks(codes)]
    return pd.Series(list(np.concatenate(out)) if out else [], dtype=object)


@F.pandas_udf(StructType([
    StructField("exits", ArrayType(LongType())), StructField("paths", ArrayType(StringType())),
    StructField("illegal", LongType())]))
def _paths(codes: pd.Series, behind: pd.Series) -> pd.DataFrame:
    codes = codes.tolist()
    rows = []
    for part in _chunks(codes):
        costs = np.stack(behind.iloc[part].to_numpy()).astype(np.int64)
        words, exits = rank_paths(codes[part], costs)
        rows += [(e, w, illegal_pairs(c)) for e, w, c in zip(exits.tolist(), words, codes[part])]
    return pd.DataFrame(rows, columns=["exits", "paths", "illegal"])


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initials of these classes may follow each other: su, ua, au."""
    return (b == 1) & ((a == 0) | (a == 2)) | (a == 1) & (b == 2)


def illegal_pairs(code: bytes) -> int:
    role = np.frombuffer(code, np.uint8) & 3
    return int((~_legal(role[:-1], role[1:])).sum())


# ---- scans over the blocks of a conversation ----------------------------------------------------

Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]


def compose_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a.reshape(4, 4)[:, :, None] + b.reshape(4, 4)[None, :, :]
    return np.minimum(both.min(axis=1), FAR).ravel()


def act_costs(block: np.ndarray, behind: np.ndarray) -> np.ndarray:
    return (block.reshape(4, 4) + behind[None, :]).min(axis=1)


def compose_exits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four exit states and the class of the last turn."""
    return np.append(b[a[:4]], b[4])


def act_exits(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.array([block[before[0]], block[4]])


def scan(
    blocks: DataFrame, compose: Compose, act: Compose, start: list[int], backward: bool,
    bits: int = BLOCK_BITS,
) -> tuple[DataFrame, DataFrame]:
    """What reaches every block (``conv, blk, carry``), and the end of each conversation.

    ``blocks`` has ``conv, blk, value``. ``act`` takes what comes in through a block, ``compose``
    joins two adjacent blocks into one. Groups of ``2^bits`` numbers are joined level by level
    until a conversation is one, then what comes in is handed down; no group has more members.
    """

    @F.pandas_udf("array<long>")
    def join(values: pd.Series) -> pd.Series:
        out = []
        for parts in values:
            total = parts[0]
            for part in parts[1:]:
                total = compose(total, part)
            out.append(total)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<array<long>>")
    def hand_down(values: pd.Series, carry: pd.Series) -> pd.Series:
        out = []
        for parts, now in zip(values, carry, strict=True):
            found = []
            for part in parts[::-1] if backward else parts:
                found.append(now)
                now = act(part, now)
            out.append(found[::-1] if backward else found)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<long>")
    def finish(value: pd.Series) -> pd.Series:
        return pd.Series([act(v, np.array(start)) for v in value], dtype=object)

    levels, top = [], blocks.select("conv", "blk", "value")
    while True:
        parts = F.array_sort(F.collect_list(F.struct("blk", "value")))
        grouped = store(
            top.groupBy("conv", F.shiftright("blk", bits).alias("up")).agg(parts.alias("parts"))
            .select("conv", "up", "parts.blk", "parts.value"))
        levels.append(grouped)
        top = store(grouped.select("conv", F.col("up").alias("blk"), join("value").alias("value")))
        if top.groupBy("conv").count().filter("count > 1").isEmpty():
            break
    carry = top.select("conv", "blk", F.array(*[F.lit(s).cast("long") for s in start]).alias("carry"))
    for grouped in reversed(levels):
        handed = grouped.join(carry.withColumnRenamed("blk", "up"), ["conv", "up"]).select(
            "conv", "blk", hand_down("value", "carry").alias("carry"))
        handed = handed.select("conv", F.explode(F.arrays_zip("blk", "carry")))
        carry = handed.select("conv", "col.blk", "col.carry")
    return carry, top.select("conv", finish("value").alias("carry"))


# ---- the operator -------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Faults made by rule, as a test of the repair: ``conv_id, turn, role, text``.

    By ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties its text, 2 takes its ``[.!?]``
    away, 3 repeats it, 4 makes it a user's. Nulls are read as one space.
    """
    def whole(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), whole("role").alias("role"),
        whole("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(
        F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


def _named(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, name``; the name stands for role and text."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.left(name, F.lit(32))).alias("name"))


def _in_order(named: DataFrame) -> DataFrame:
    """Narrow rows with their place ``at``: consecutive along the turns of a conversation."""
    kind = F.position(F.left("role", F.lit(1)), F.lit(CLASSES)) - 1
    kind = F.when((F.length("role") == 0) | (kind < 0), 3).otherwise(kind)
    # Rows that are equal in all may change places, so a number of their own splits them.
    return store(
        named.select(
            "conv", "turn", "name", kind.alias("kind"),
            (F.col("text").rlike(BLANK_ONLY)).alias("blank"),
            (~F.col("text").rlike(ENDED)).alias("unended"),
            F.monotonically_increasing_id().alias("split"))
        .orderBy(F.col("conv"), F.col("turn").asc_nulls_first(), "name", "split")
        .drop("split").withColumn("at", F.monotonically_increasing_id()))


def _faults(rows: DataFrame) -> DataFrame:
    """Adds each row's first fault: ``blank``, ``duplicate`` or ``truncated``."""
    firsts = rows.groupBy("conv", "name").agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("first"))
    again = F.col("first").isNull() & ~F.col("blank")
    return store(
        rows.join(firsts, "at", "left").select(
            "conv", "turn", "name", "at", "kind", "blank", again.alias("duplicate"),
            (F.col("unended") & ~F.col("blank") & ~again).alias("truncated")))


@dataclass(frozen=True)
class Repair:
    """``summary``: one row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit``. ``turns``: the repaired turns ``conv_id, role, text``; each
    conversation's rows lie in one partition, in order."""

    summary: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame, bits: int = BLOCK_BITS) -> Repair:
    """The cheapest repair of every conversation of ``turns`` (``conv_id, turn, role, text``).

    Turns are taken by ``turn``, nulls first, ties by the SHA-256 of role and text; null roles and
    texts are read as one space, rows without a conv_id are one conversation. A row's first fault
    counts: blank (white space only), duplicate (role and text seen earlier in the conversation),
    truncated (last character that is no white space not one of ``.!?``). Roles are told by their
    first letter; others than s, u, a (and empty ones) must be reroled or deleted. Keeping costs
    0, reroling to user or assistant 3, deleting 4 (required for blank and duplicate rows),
    inserting an empty turn 3; a truncated row that stays adds 3. Of the cheapest repairs whose
    roles read ``(s?(ua)+)?`` the one with the least audit (initials of the edits in order) is
    taken. ``gaps`` are the turn numbers missing between the smallest and largest, ``illegal`` the
    adjacent rows whose initials are not su, ua or au. Other columns are not looked at. An empty
    table gives no rows. ``bits`` sets the size of the blocks.
    """
    named = _named(turns)
    rows = _faults(_in_order(named))
    code = F.col("kind") + F.when(F.col("blank") | F.col("duplicate"), 4).otherwise(0) + F.when(
        F.col("truncated"), 8).otherwise(0)
    ordered = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))
    blocks = store(
        rows.groupBy("conv", F.shiftright("at", bits).alias("blk")).agg(ordered.alias("turns"))
        .select("conv", "blk", F.col("turns.at")[0].alias("first"),
                F.col("turns.code")[0].bitwiseAND(3).alias("opens"),
                F.element_at("turns.code", -1).bitwiseAND(3).cast("long").alias("ends"),
                F.unhex(F.array_join(F.transform(
                    "turns.code", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("codes")))
    costs = blocks.select("conv", "blk", _transfer("codes").alias("value"))
    behind, total = scan(costs, compose_costs, act_costs, CLOSE.tolist(), True, bits)
    ranked = store(
        blocks.join(behind, ["conv", "blk"])
        .select("conv", "blk", "first", "opens", "ends", _paths("codes", "carry").alias("found"))
        .select("conv", "blk", "first", "opens", "ends", "found.*"))
    exits = ranked.select("conv", "blk", F.array_append("exits", F.col("ends")).alias("value"))
    before, end = scan(exits, compose_exits, act_exits, [START, -1], False, bits)
    prior = F.col("carry")[1]
    legal = ((F.col("opens") == 1) & prior.isin(0, 2)) | ((F.col("opens") == 2) & (prior == 1))
    chosen = store(
        ranked.join(before, ["conv", "blk"]).select(
            "conv", "blk", "first", F.get("paths", F.col("carry")[0].cast("int")).alias("path"),
            (F.col("illegal") + F.when((prior >= 0) & ~legal, 1).otherwise(0)).alias("illegal")))
    closing = end.select("conv", F.get(
        F.array(*[F.lit(c) for c in CLOSING]), F.col("carry")[0].cast("int")).alias("closing"))
    closing = store(closing)
    return Repair(_summary(rows, chosen, total, closing), _repaired(named, rows, chosen, closing))


def _summary(rows: DataFrame, chosen: DataFrame, total: DataFrame, closing: DataFrame) -> DataFrame:
    def number(column: str) -> Column:
        return F.sum(F.col(column).cast("long")).alias(column)

    counts = rows.groupBy("conv").agg(
        number("blank"), number("duplicate"), number("truncated"), F.min("turn").alias("least"),
        F.max("turn").alias("most"), F.countDistinct("turn").alias("turns"))
    gaps = F.coalesce(F.expr("try_add(try_subtract(most, least), 1 - turns)"), F.lit(0))
    paths = F.array_sort(F.collect_list(F.struct("blk", "path")))
    audits = chosen.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.array_join(paths["path"], "").alias("path"))
    audit = F.translate(F.concat("path", "closing"), "uaUA", "IIRR")
    return (
        counts.join(audits, "conv").join(closing, "conv")
        .join(total.select("conv", F.col("carry")[0].alias("cost")), "conv")
        .select(F.nullif("conv", F.lit(NO_ID)).alias("conv_id"), gaps.alias("gaps"), "blank",
                "duplicate", "truncated", "illegal", "cost", audit.alias("audit")))


def _repaired(
    named: DataFrame, rows: DataFrame, chosen: DataFrame, closing: DataFrame
) -> DataFrame:
    """Turns after the repair: edits and texts meet in one sorted stream per conversation.

    Only the first of equal rows can stay, so a text is found by its conversation, turn and name.
    """
    edits = chosen.select("conv", F.posexplode(
        F.regexp_extract_all("path", F.lit("[ua]*[KDUA]"), F.lit(0))), "first")
    edits = edits.filter("col <> 'D'").select(
        (F.col("first") + F.col("pos")).alias("at"), F.col("col").alias("edit"))
    edits = rows.select("at", "conv", "turn", "name").join(edits, "at").select(
        "conv", F.lit(0).alias("closes"), "turn", "name", F.lit(0).alias("is_text"), "at", "edit",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in
               (("turn", "long"), ("name", "binary"))]
    last = closing.filter("closing <> ''").select(
        "conv", F.lit(1).alias("closes"), *nothing, F.lit(0).alias("is_text"),
        F.lit(None).cast("long").alias("at"), F.col("closing").alias("edit"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = named.select(
        "conv", F.lit(0).alias("closes"), "turn", "name", F.lit(1).alias("is_text"),
        F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("edit"),
        "role", "text")
    stream = (
        edits.unionAll(last).unionAll(texts).repartition("conv")
        .sortWithinPartitions("conv", "closes", "turn", "name", "is_text", "at"))
    return stream.mapInPandas(_write, "conv_id long, role string, text string")


ROLES = {"u": "user", "a": "assistant"}


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits come before the text that they belong to; a text without one is not written."""
    waiting, key = [], None
    for batch in batches:
        conv = batch["conv"].tolist()
        closes, is_text = batch["closes"].tolist(), batch["is_text"].tolist()
        turn, name = batch["turn"].tolist(), batch["name"].tolist()
        edit, role, text = batch["edit"].tolist(), batch["role"].tolist(), batch["text"].tolist()
        out = []
        for i in range(len(conv)):
            if closes[i]:
                out += [(conv[i], ROLES[c], "") for c in edit[i]]
                continue
            at = (conv[i], None if turn[i] != turn[i] else turn[i], name[i])
            if not is_text[i]:
                if at != key:
                    waiting, key = [], at
                waiting.append(edit[i])
                continue
            if at != key or not waiting:
                continue
            for step in waiting:
                out += [(conv[i], ROLES[c], "") for c in step[:-1]]
                if step[-1] != "D":
                    out.append((conv[i], ROLES.get(step[-1].lower(), role[i]), text[i]))
            waiting = []
        rows = pd.DataFrame(out, columns=["conv_id", "role", "text"])
        rows["conv_id"] = rows["conv_id"].astype("Int64").where(rows["conv_id"] != NO_ID)
        yield rows


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns, as ``role:text`` joined by line feeds.

    A hash runs from the first turn to the last; so a conversation is read in one task, as a
    stream that holds one batch of turns.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, digest = None, None
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype("Int64").fillna(NO_ID).tolist()
            for conv, role, text in zip(ids, batch["role"], batch["text"], strict=True):
                if conv != held:
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _digest_rows(out)
        if digest is not None:
            yield _digest_rows([(held, digest.hexdigest())])

    return turns.mapInPandas(look, "conv_id long, repaired_sha256 string")


def _digest_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "repaired_sha256"])
    out["conv_id"] = out["conv_id"].astype("Int64").where(out["conv_id"] != NO_ID)
    return out


def repair_report(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged by rule and repaired: summary and digest.

    A conversation without rows after the damage has zeros, an empty audit and the hash of an
    empty text.
    """
    found = repair_conversations(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    summary, digest = found.summary, digests(found.turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        ids.join(summary, ids["conv_id"].eqNullSafe(summary["conv_id"]), "left")
        .join(digest, ids["conv_id"].eqNullSafe(digest["conv_id"]), "left")
        .select(ids["conv_id"], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
                .alias("repaired_sha256")))
