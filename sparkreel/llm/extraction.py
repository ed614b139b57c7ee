"""Operator 6: main text of web pages by a tree-structured graphical model.

Every block element and text block of a page is a variable: main text or not. Potentials of the
nodes come from tags, names and text measures, potentials of parent and child from a table. One
sum-product pass up the tree and one down give exact marginals. Weights are fitted to labelled
pages by gradient ascent on the likelihood, whose gradient those marginals are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.dom import Page, parse
from sparkreel.llm.labelled_pages import labelled_pages

ELEMENT, TEXT = 0, 1


@dataclass(frozen=True)
class ExtractionModel:
    """``unary``: log-odds per feature. ``edge[kind of child][parent label][child label]``."""

    unary: dict[str, float]
    edge: list[list[list[float]]]


def _bin(value: float) -> int:
    return min(int(math.log2(value + 1)), 12)


def features(page: Page) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(page.parent)
    size, linked, blocks = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.text[i] is not None:
            size[i], linked[i], blocks[i] = len(page.text[i]), page.linked[i], 1
        for total in (size, linked, blocks):
            total[page.parent[i]] += total[i]
    out = []
    for i in range(n):
        share = int(4 * linked[i] / size[i] + 0.5) if size[i] else 0
        if page.text[i] is not None:
            last = page.text[i][-1]
            out.append(["text", f"text links {share}", f"text size {_bin(size[i])}",
                        f"text in {page.tag[page.parent[i]]}",
                        f"text ends {'.' if last in '.!?:' else ''}"])
        else:
            own = ["element", f"links {share}", f"size {_bin(size[i])}", f"tag {page.tag[i]}",
                   f"blocks {_bin(blocks[i])}"]
            out.append(own + ["name " + x for x in page.names[i]])
    return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(
    page: Page, odds: list[float], edge: list[list[list[float]]]
) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of every node after both passes; of it without its parent; of its parent without it.

    A message in log-odds: what the child says of its parent, or the parent of its child.
    """
    n = len(odds)
    up = list(odds)
    message = [0.0] * n
    for i in range(n - 1, 0, -1):
        e = edge[TEXT if page.text[i] is not None else ELEMENT]
        u = up[i]
        message[i] = _log_sum(e[1][0], u + e[1][1]) - _log_sum(e[0][0], u + e[0][1])
        up[page.parent[i]] += message[i]
    belief, rest = list(up), [0.0] * n
    for i in range(1, n):
        e = edge[TEXT if page.text[i] is not None else ELEMENT]
        c = rest[i] = belief[page.parent[i]] - message[i]
        belief[i] = up[i] + _log_sum(e[0][1], c + e[1][1]) - _log_sum(e[0][0], c + e[1][0])
    return belief, up, rest


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def fit(pages: list[str], epochs: int = 30, rate: float = 0.5, l2: float = 0.0) -> ExtractionModel:
    """Weights for labelled pages (see ``labelled_pages``), a bounded list held by the driver."""
    parsed = [parse(p) for p in pages]
    named = [features(p) for p in parsed]
    truth = [[1 if m else 0 for m in p.marked] for p in parsed]
    unary: dict[str, float] = {f: 0.0 for page in named for node in page for f in node}
    edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in (ELEMENT, TEXT)]
    squares: dict[object, float] = {}

    def step(key: object, gradient: float) -> float:
        squares[key] = squares.get(key, 1e-8) + gradient * gradient
        return rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        for page, names, labels in zip(parsed, named, truth, strict=True):
            odds = [sum(map(unary.__getitem__, f)) for f in names]
            belief, up, rest = marginals(page, odds, edge)
            gradient: dict[str, float] = {}
            pairs: dict[tuple[int, int, int], float] = {}
            for i, own in enumerate(names):
                g = labels[i] - _logistic(belief[i])
                for f in own:
                    gradient[f] = gradient.get(f, 0.0) + g
                if i:
                    kind = TEXT if page.text[i] is not None else ELEMENT
                    e = edge[kind]
                    joint = [[a * rest[i] + b * up[i] + e[a][b] for b in (0, 1)] for a in (0, 1)]
                    whole = _log_sum(_log_sum(*joint[0]), _log_sum(*joint[1]))
                    for a in (0, 1):
                        for b in (0, 1):
                            seen = labels[page.parent[i]] == a and labels[i] == b
                            key = (kind, a, b)
                            pairs[key] = pairs.get(key, 0.0) + seen - math.exp(joint[a][b] - whole)
            for f, g in gradient.items():
                unary[f] += step(f, g - l2 * unary[f])
            for (kind, a, b), g in pairs.items():
                edge[kind][a][b] += step((kind, a, b), g - l2 * edge[kind][a][b])
    return ExtractionModel(unary, edge)


@functools.cache
def default_model(pages: int = 400, seed: int = 3) -> ExtractionModel:
    return fit(labelled_pages(pages, seed))


def extract(source: str, model: ExtractionModel) -> str:
    """The main text of one page: its text blocks that are likelier main text than not."""
    page = parse(source)
    known = model.unary
    odds = [sum(known.get(f, 0.0) for f in own) for own in features(page)]
    belief, _, _ = marginals(page, odds, model.edge)
    return "\n\n".join(
        t for t, b in zip(page.text, belief, strict=True) if t is not None and b >= 0.0)


def main_text(pages: DataFrame, source: Column, model: ExtractionModel) -> Column:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x, shared.value) for x in batch], dtype=object)

    return read(F.coalesce(source, F.lit("")))


def extract_pages(pages: DataFrame, model: ExtractionModel | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (its code points) to pages (``html``).

    One row per input row, repeated rows included. Blocks hold single spaces only and are joined
    by two line feeds; character references are decoded. Null and empty pages, and pages without
    main text, get an empty text. Existing columns of these names are replaced.
    """
    model = model or default_model()
    return pages.withColumn("text", main_text(pages, F.col("html"), model)).withColumn(
        "n_chars", F.length("text").cast("long"))
