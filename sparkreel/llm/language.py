"""Operator 9: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from the vectors of its
letters, permuted by their place and multiplied; a text is the bundle (sum) of its trigrams. The
bundles of labelled texts of a language add up to its prototype, and a text takes the language of
the prototype with the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.bpe import LETTER, _classes
from sparkreel.llm.storage import store, text_of

LETTERS = 512
BLOCK = 4096
SPAN = 1 << 20


@dataclass(frozen=True)
class LanguageOptions:
    """``max_rows`` bounds the labelled sample the prototypes are learnt from."""

    dimensions: int = 1024
    max_rows: int = 20000
    shards: int = 8
    seed: int = 5


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray  # one row of unit length per language
    options: LanguageOptions


@functools.cache
def _letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    """Random vectors of all letters, as they stand first, second and third in a trigram."""
    letters = np.random.default_rng(seed).choice(
        np.array([-1, 1], np.int8), (LETTERS, dimensions))
    return np.stack([np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a text and how often they occur; other runs are one blank.

    Letters beyond the first 384 code points share the remaining 128 vectors.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = _classes()[code] == LETTER
    keep = letter | np.concatenate([[True], letter[:-1]])
    symbol = np.where(code < 384, code, 384 + code % 128)
    symbol = np.where(letter, symbol, 0)[keep].astype(np.int32)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, counts = [], []
    for begin in range(0, len(symbol) - 2, SPAN):
        part = symbol[begin : begin + SPAN + 2]
        found = np.unique((part[:-2] * LETTERS + part[1:-1]) * LETTERS + part[2:],
                          return_counts=True)
        grams.append(found[0])
        counts.append(found[1])
    if len(grams) == 1:
        return grams[0].astype(np.int64), counts[0]
    ids, back = np.unique(np.concatenate(grams), return_inverse=True)
    return ids.astype(np.int64), np.bincount(back, np.concatenate(counts)).astype(np.int64)


def bundles(texts: list[str], options: LanguageOptions) -> np.ndarray:
    """Vectors of unit length, one row per text; zero for texts without letters."""
    first, second, third = _letter_vectors(options.dimensions, options.seed)
    found = [trigrams(t) for t in texts]
    out = np.zeros((len(texts), options.dimensions), np.float32)
    ids = np.unique(np.concatenate([f[0] for f in found])) if found else []
    for begin in range(0, len(ids), BLOCK):
        own = ids[begin : begin + BLOCK]
        bound = (first[own // LETTERS**2] * second[own // LETTERS % LETTERS]
                 * third[own % LETTERS]).astype(np.float32)
        counts = np.zeros((len(texts), len(own)), np.float32)
        for i, (gram, number) in enumerate(found):
            a, b = np.searchsorted(gram, [own[0], own[-1] + 1])
            counts[i, np.searchsorted(own, gram[a:b])] = number[a:b]
        out += counts @ bound
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _bundler(options: LanguageOptions) -> Callable[..., pd.DataFrame]:
    def bundle_shard(key, rows):
        total = np.zeros(options.dimensions)
        texts = rows["text"].tolist()
        for begin in range(0, len(texts), 200):
            total += bundles(texts[begin : begin + 200], options).sum(axis=0)
        return pd.DataFrame({"lang": [key[0]], "total": [total]})

    return bundle_shard


def fit_languages(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Prototypes from rows of ``docs`` (``doc_id, text, lang``) with a language and an id.

    At most ``options.max_rows`` rows are used, those whose ids have the smallest hashes.
    """
    sample = (
        docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("_id"))
        .orderBy(F.xxhash64("doc_id", F.lit(options.seed)), "doc_id").limit(options.max_rows)
        .distinct())
    # The sample is bounded by max_rows, so it may be broadcast.
    rows = docs.filter("lang IS NOT NULL").select("doc_id", "lang", text_of("text").alias("text"))
    rows = rows.join(F.broadcast(store(sample)), F.col("doc_id") == F.col("_id"), "left_semi")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(options.seed + 1)), options.shards)
    bundle = _bundler(options)
    totals = (
        rows.select("lang", "text", shard.alias("shard")).groupBy("lang", "shard")
        .applyInPandas(lambda key, rows: bundle(key, rows), "lang string, total array<double>")
        .toPandas())
    languages = sorted(totals["lang"].unique())
    sums = [np.sum(totals.loc[totals["lang"] == x, "total"].tolist(), axis=0) for x in languages]
    prototypes = np.array(sums).reshape(len(languages), options.dimensions)
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(languages, prototypes / np.where(length > 0, length, 1.0), options)


def predict(docs: DataFrame, text: Column, model: LanguageModel) -> Column:
    """A struct of ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            texts = batch.tolist()
            for begin in range(0, len(texts), 200):
                vectors = bundles(texts[begin : begin + 200], model.options)
                some = vectors.any(axis=1)
                if not model.languages:
                    names += ["und"] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                cosine = vectors @ model.prototypes.T
                best = cosine.argmax(axis=1)
                names += [model.languages[k] if x else "und" for k, x in
                          zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return guess(F.coalesce(text, F.lit("")))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, 0 if negative).

    One row per input row; only the text is looked at, whole. Null texts and texts without a
    letter are ``und`` with score 0, as is every text if nothing could be learnt.
    """
    plain = docs.drop("lang_pred", "score")
    return plain.select("*", predict(docs, F.col("text"), model).alias("_guess")).select(
        *plain.columns, "_guess.*")
