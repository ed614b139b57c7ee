"""Conversation repair against a search over all audits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkreel.llm import conversation_repair as cr
from sparkreel.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string, at int"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def ordered(rows):
    def name(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]

    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, name(r[2], r[3])))


def plain(rows):
    """Summary and repaired lines of the turns of one conversation."""
    rows = ordered(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    blank = duplicate = truncated = illegal = 0
    seen, flags = set(), []
    for i, (_, _, role, text) in enumerate(rows):
        must = late = False
        if not text.strip(BLANKS):
            blank += 1
            must = True
        elif (role, text) in seen:
            duplicate += 1
            must = True
        elif text.rstrip(BLANKS)[-1] not in ".!?":
            truncated += 1
            late = True
        seen.add((role, text))
        flags.append((must, late))
        if i and rows[i - 1][2][:1] + role[:1] not in ("su", "ua", "au"):
            illegal += 1
    cost, audit = cheapest(rows)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, "\n".join(lines_of(rows, audit))


def parts(rows):
    """Initial, whether it must go and what it costs to stay, of ordered rows."""
    seen, turns = set(), []
    for _, _, role, text in rows:
        must = not text.strip(BLANKS) or (role, text) in seen
        seen.add((role, text))
        turns.append((role[:1], must, 0 if must or text.rstrip(BLANKS)[-1] in ".!?" else 3))
    return turns


def cheapest(rows):
    """Backwards over turns and states, one (cost, audit) each."""
    best = [(0, ""), (6, "II"), (3, "I"), (0, "")]
    for initial, must, late in reversed(parts(rows)):
        own = []
        for state in range(4):
            role, after = NEXT[state]
            ways = [(4 + best[state][0], "D" + best[state][1])]
            if not must:
                ways.append((3 + late + best[after][0], "R" + best[after][1]))
                if initial == role[0]:
                    ways.append((late + best[after][0], "K" + best[after][1]))
                if initial == "s" and state == 0:
                    ways.append((late + best[1][0], "K" + best[1][1]))
            own.append(min(ways))
        for _ in range(2):
            own = [min(own[s], (3 + own[NEXT[s][1]][0], "I" + own[NEXT[s][1]][1]))
                   for s in range(4)]
        best = own
    return best[0]


def lines_of(rows, audit):
    state, at, lines = 0, 0, []
    for edit in audit:
        role, after = NEXT[state]
        if edit == "I":
            lines.append(role + ":")
            state = after
            continue
        _, _, own, text = rows[at]
        at += 1
        if edit != "D":
            lines.append(f"{own if edit == 'K' else role}:{text}")
            state = 1 if edit == "K" and own[:1] == "s" else after
    return lines


def every_path(rows):
    """The least of all paths by (cost, audit), each of them tried."""
    turns, found = parts(rows), []

    def go(at, state, cost, audit):
        if at == len(turns) and state in (0, 3):
            found.append((cost, audit))
        role, after = NEXT[state]
        if not audit.endswith("II"):
            go(at, after, cost + 3, audit + "I")
        if at < len(turns):
            initial, must, late = turns[at]
            go(at + 1, state, cost + 4, audit + "D")
            if not must:
                go(at + 1, after, cost + 3 + late, audit + "R")
                if initial == role[0]:
                    go(at + 1, after, cost + late, audit + "K")
                if initial == "s" and state == 0:
                    go(at + 1, 1, cost + late, audit + "K")

    go(0, 0, 0, "")
    return min(found)


def test_plain_version_tries_enough():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]),
                 rng.choice(["a.", "b", "", "c."])) for t in range(rng.randrange(5))]
        assert cheapest(ordered(rows)) == every_path(ordered(rows))


def expected(rows, damage):
    out = {}
    after = damaged(rows) if damage else rows
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        *found, whole = plain(own) if own else (0, 0, 0, 0, 0, 0, "", "")
        out[conv] = (*found, hashlib.sha256(whole.encode()).hexdigest())
    return out


def random_turns(seed, conversations=40, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", "User", None]
    texts = ["Yes.", "No", "Why?", "", " \n", "Go on!\t", "a ", " ", "b.\u0085", None, "x."]
    rows = []
    for conv in [None, *range(conversations)]:
        turn = rng.randrange(5)
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles),
                         rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 0, 3])
    return rows


def test_report(spark):
    rows = random_turns(1) + [(900, t, "user", "x.") for t in range(2)]
    # A conversation whose only row is dropped.
    lost = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "x."))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    found = {r[0]: tuple(r)[1:] for r in cr.repair_report(table).collect()}
    assert found == expected(rows, True)
    assert found[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_report(table.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [12, 1])
def test_blocks_of_any_size(spark, bits):
    """Small blocks make scans of many levels; the long conversation spans several partitions."""
    rng = random.Random(3)
    rows = [(r[0], r[1], r[2] or "", r[3] or "") for r in random_turns(2, 25)]
    rows += [(77, t, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(40)}"
              + rng.choice(["", ".", "?"])) for t in range(60)]
    rows += [(78, None, "user", "same.")] * 50
    repair = cr.repair_conversations(spark.createDataFrame(
        [(*r, "x", 1) for r in rows], SCHEMA).repartition(5), bits)
    digest = {r[0]: r[1] for r in cr.digests(repair.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    found = {r[0]: (*tuple(r)[1:], digest.get(r[0], empty)) for r in repair.summary.collect()}
    assert found == expected(rows, False)
    roles = "".join(r.role[0] for r in repair.turns.filter("conv_id = 77").collect())
    assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) > 20


def test_ranks_of_random_blocks():
    rng = np.random.default_rng(5)
    codes = [rng.choice([0, 1, 2, 3, 9, 10, 7], rng.integers(1, 40)).astype(np.uint8).tobytes()
             for _ in range(30)]
    behind = np.tile(cr.CLOSE, (30, 1))
    words, exits = cr.rank_paths(codes, behind)
    costs = cr.transfer(codes)
    for i, code in enumerate(codes):
        total = (costs[i] + cr.CLOSE[None, :]).min(axis=1)
        for state in range(4):
            spent = 0
            path = re.findall("[ua]*[KDUA]", words[i][state])
            assert len(path) == len(code)
            for step, c in zip(path, code, strict=True):
                spent += 3 * (len(step) - 1)
                late = 3 * (c >> 3)
                spent += {"K": late, "D": 4, "U": 3 + late, "A": 3 + late}[step[-1]]
            assert spent + cr.CLOSE[exits[i][state]] == total[state]


def test_query(spark, tmp_path):
    rows = [r for r in random_turns(7, 30)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(
        f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == expected(rows, True)
