"""Memory of Python workers: bounded by parts of a batch, and given back."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from sparkreel.llm import jaccard_join, toxicity, workers

LONG = [" ".join(f"w{i}x{k % 997}" for k in range(i, i + 8000)) for i in range(200)]


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most, chars", [(500, 1 << 18), (3, 1 << 18), (500, 10)])
def test_parts_hold_every_text_once(most, chars):
    texts = ["", "a" * 7, *LONG[:20], "b", "", "c" * 9]
    parts = list(workers.parts_of(pd.Series(texts), most, chars))
    assert [text for _, part in parts for text in part] == texts
    for begin, part in parts:
        assert part == texts[begin : begin + len(part)] and len(part) <= most
        assert len(part) == 1 or sum(map(len, part)) <= chars
    assert not list(workers.parts_of(pd.Series([], dtype=object)))


def test_sets_of_long_texts_in_bounded_memory():
    batch = pd.DataFrame({"text": LONG})
    assert peak_mb(lambda: [i for i, _ in jaccard_join._sets(batch, 5)]) < 40


def test_fit_holds_used_buckets_only():
    texts = [f"good day number {i % 9}" if i % 3 else f"bad zorrk day {i % 7}" for i in range(600)]
    labels = np.array([float(i % 3 == 0) for i in range(600)])
    toxicity._fit(texts[:10], labels[:10], toxicity.FtrlOptions())
    assert peak_mb(lambda: toxicity._fit(texts, labels, toxicity.FtrlOptions())) < 60


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(workers, "give_back", lambda: told.append(True))
    run = workers.tidy(lambda batches: (x + 1 for x in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and told == [True]
