"""SimHash links against comparing every two fingerprints."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from llm import brute
from llm.test_corpus import DOCS, ODD, frame, random_docs
from sparkreel.llm import queries, simhash


def plain_print(text, size=3):
    words = brute.WORDS.findall(brute.lower(text or ""))
    if not words:
        return 0
    grams = [words[i : i + size] for i in range(max(len(words) - size + 1, 1))]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest reachable print of every print, by comparing each two."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in root}


def expected(docs):
    prints = [plain_print(text) for _, text in docs]
    component = plain_components(set(prints))
    lowest = {}
    for (doc_id, _), p in zip(docs, prints, strict=True):
        if doc_id is not None:
            c = component[p]
            lowest[c] = min(doc_id, lowest.get(c, doc_id))
    return Counter((doc_id, f"{p:016x}", lowest.get(component[p]))
                   for (doc_id, _), p in zip(docs, prints, strict=True))


def near_copies(seed):
    """Texts of 300 words with few changes, so that fingerprints differ in few bits."""
    rng = random.Random(seed)
    docs = []
    for _ in range(6):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            docs.append((len(docs) + 1000, " ".join(own)))
    return docs


def test_components_against_all_pairs(spark):
    docs = near_copies(1) + [(i + 200, t) for i, t in random_docs(12, 60)] + ODD + [(60, "AbC  dEf"), (61, "abc\tdef")]
    rows = simhash.simhash_components(frame(spark, docs)).collect()
    assert Counter(tuple(r) for r in rows) == expected(docs)
    by_id = {r.doc_id: r.component_id for r in rows}
    # Texts without words share fingerprint zero; the smallest id of them is 1.
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[60] == by_id[61] == 60
    linked = [r for r in rows if r.component_id not in (r.doc_id, None, 1)]
    assert len(linked) > 20 and len({r.fingerprint for r in linked}) > 10
    assert rows[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}
    assert simhash.simhash_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [128, 3])
def test_links_of_prints(spark, monkeypatch, most):
    """With few members to a coarse cell allowed, most go through the finest grid."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(2)
    prints = {0, 1, 3, 7, 2**64 - 1, 2**64 - 2, 2**63, 2**63 + 1}
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(rng.randrange(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    own = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    found = simhash.linked_prints(spark.createDataFrame([(p,) for p in own], "print long"))
    groups = {}
    for row in found.collect():
        groups.setdefault(row.component, set()).add(row.print % 2**64)
    want = {}
    for p, c in plain_components(prints).items():
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in want.values() if len(g) > 1)


def test_long_text():
    text = "Ärger über \U0001f642 Wörter " * 30_000
    assert simhash.fingerprint(text) == plain_print(text)


def test_query(spark, tmp_path):
    docs = near_copies(3) + ODD
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op11_simhash"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected(docs)
