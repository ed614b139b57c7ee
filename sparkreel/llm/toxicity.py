"""Operator 3: toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the words of a text (whole, and their stems of four to seven bytes, since inflected
forms are many and each is rare), its word pairs and its pairs with one word skipped, each hashed
to one of 2^22 numbers and counted once. Shards of the labelled rows are fitted side by side, each
coordinate with its own learning rate and an L1 term that keeps most weights at zero; the shards'
weights are averaged, and the few that are not zero are broadcast for scoring.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.storage import store, text_of
from sparkreel.llm.words import MARK, scramble, stems, words_of
from sparkreel.llm.workers import give_back, parts_of, tidy

BITS = 22
STEMS = (4, 5, 6, 7)
U = np.uint64


@dataclass(frozen=True)
class FtrlOptions:
    """``max_rows`` bounds the labelled sample that is fitted; every other row is only scored.

    ``shard_rows`` is about how many of them are fitted in one task.
    """

    max_rows: int = 24000
    shard_rows: int = 8000
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    least_texts: int = 3
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, repeats included."""
    words = words_of(texts, MARK, lower=True)
    key = words.key
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    owners, buckets = [owner], [scramble(key, 1)]
    for skip, turn in ((1, 2), (2, 3)):
        inside = owner[skip:] == owner[:-skip]
        pair = scramble(key[:-skip], turn) + scramble(key[skip:], turn + 2)
        owners.append(owner[skip:][inside])
        buckets.append(scramble(pair[inside], turn))
    for stem in stems(words, STEMS):
        owners.append(owner[stem != 0])
        buckets.append(stem[stem != 0])
    bucket = (np.concatenate(buckets) >> U(64 - BITS)).astype(np.int64)
    return np.concatenate(owners), bucket


def _fit(texts: list[str], labels: np.ndarray, options: FtrlOptions) -> pd.DataFrame:
    """Weights that are not zero; bucket -1 is the bias."""
    rows = []
    for _, part in parts_of(texts, 200):
        owner, bucket = features(part)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, len(part)))
        rows += [np.unique(b).astype(np.int32) for b in np.split(bucket[order], cuts)]
    seen = np.zeros(1 << BITS, np.int32)
    for row in rows:
        seen[row] += 1
    # What few texts of the shard have tells nothing about others.
    known = np.flatnonzero(seen >= options.least_texts)
    # From here on a bucket goes by its place among these, and `seen` holds the places.
    kept = seen >= options.least_texts
    seen[known] = np.arange(len(known))
    rows = [seen[row[kept[row]]] for row in rows]
    bias = len(known)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    rng = np.random.default_rng(options.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0.0, options.l1)
        rate = (options.beta + np.sqrt(n[at])) / options.alpha + options.l2
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0.0) / rate

    for _ in range(options.epochs):
        for i in rng.permutation(len(rows)).tolist():
            at = np.append(rows[i], bias)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / options.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    found = w != 0
    found[bias] = True
    return pd.DataFrame({"bucket": np.append(known, -1)[found], "weight": w[found]})


def _fitter(options: FtrlOptions) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit_shard(rows):
        rows = rows.sort_values(["doc_id", "text"])
        weights = _fit(rows["text"].tolist(), rows["toxic"].to_numpy(float), options)
        give_back()
        return weights

    return fit_shard


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, options: FtrlOptions = FtrlOptions()
) -> ToxicityModel:
    """Weights from the labelled rows (``labels``: ``doc_id, toxic``) of ``docs``.

    Of the labelled ids that ``docs`` holds at most ``options.max_rows`` are used, those with the
    smallest hashes. Labels of an id listed twice count as toxic if one is; of several texts of an
    id the first in order is learnt from; null labels and ids are left out. Without any labelled
    row the model is not ``fitted`` and gives every text a score of 0.5.
    """
    present = docs.select(F.col("doc_id").alias("_present")).distinct()
    sample = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .join(present, F.col("doc_id") == F.col("_present"), "left_semi")
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id", F.lit(options.seed)), "_id").limit(options.max_rows))
    # The sample is bounded by max_rows, so it may be broadcast.
    sample = store(sample)
    shards = max(1, -(-sample.count() // options.shard_rows))
    rows = (
        docs.select("doc_id", text_of("text").alias("text"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(options.seed + 1)), shards)
    weights = (
        rows.select("doc_id", "text", "toxic", shard.alias("shard"))
        .groupBy("shard").applyInPandas(
            lambda rows: _fitter(options)(rows), "bucket long, weight double"))
    weights = store(weights)
    count = weights.filter("bucket = -1").count()
    # Added in order, so that a run repeated gives the same sums.
    in_order = F.aggregate(
        F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda total, w: total + w)
    found = weights.groupBy("bucket").agg(in_order.alias("weight")).toPandas()
    found = found.sort_values("bucket")
    bias = found.loc[found["bucket"] == -1, "weight"].sum() / max(count, 1)
    found = found[found["bucket"] >= 0]
    return ToxicityModel(
        found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(float) / max(count, 1), bias,
        count > 0)


@functools.cache
def _table() -> np.ndarray:
    return np.zeros(1 << BITS, np.float32)


def toxicity_score(docs: DataFrame, text: Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic; the model goes to the executors as one broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.bias))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, weights, bias = shared.value
        table = _table()
        table[:] = 0
        table[buckets] = weights
        for batch in batches:
            out = np.full(len(batch), float(bias))
            for begin, texts in parts_of(batch):
                owner, bucket = features(texts)
                at = np.flatnonzero(table[bucket])
                once = np.unique(owner[at] << BITS | bucket[at])
                np.add.at(out, begin + (once >> BITS), table[once & ((1 << BITS) - 1)])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return F.pandas_udf(tidy(score), "double")(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    One row per input row. Only the text is looked at, whole; null and empty texts have no
    features and get the score of the bias. Existing columns of these names are replaced.
    """
    return docs.withColumn("score", toxicity_score(docs, F.col("text"), model)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
