"""Stages of the pipeline and run() against plain versions, on odd rows."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from llm import brute
from llm.test_corpus import DOCS, ODD
from sparkreel.llm import queries

CLASHING = ("score", "predicted", "n_removed", "kept_text", "n_lines", "_key", "_hash", "_id", "_of",
            "id", "key", "words", "_gone", "item")


def documents(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat_ws("-", F.lit(name), "doc_id"))
    return docs


def checked(docs, found):
    """The rows of a stage, whose other columns must be what they were."""
    assert found.columns == docs.columns
    rows = found.collect()
    for row in rows:
        for name in CLASHING:
            assert row[name] == (name if row.doc_id is None else f"{name}-{row.doc_id}")
    return Counter((r.doc_id, r.text) for r in rows)


def folder(path, spark, docs, labels=(), items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return str(path)


def sentences(seed, number, length=30):
    rng = random.Random(seed)
    return [" ".join(f"v{rng.randrange(3000)}" for _ in range(length)) for _ in range(number)]


def test_no_labels_drop_nothing(spark, tmp_path):
    docs = documents(spark, ODD)
    far = [(i, 1, 1) for i in range(5000, 9000)]
    for name, labels in (("none", []), ("far", far)):
        path = folder(tmp_path / name, spark, docs, labels)
        assert checked(docs, pipeline.drop_toxic(spark, docs, path)) == Counter(ODD)


def test_toxic_documents_go(spark, tmp_path):
    texts = sentences(1, 400)
    rows = [(i, t + " zorrk zorrk zorrk" if i % 4 == 0 else t) for i, t in enumerate(texts)]
    odd = [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    docs = documents(spark, rows + odd)
    path = folder(tmp_path, spark, docs, [(i, 1, int(i % 4 == 0)) for i in range(400)]
                  + [(i, 0, 1) for i in range(10**6, 10**6 + 30_000)])
    left = checked(docs, pipeline.drop_toxic(spark, docs, path))
    gone = [i for i, t in rows if (i, t) not in left]
    assert len(gone) > 90 and all(i % 4 == 0 for i in gone)
    assert all(left[row] for row in odd)


def test_repeated_lines_go(spark, tmp_path):
    line = "a line that is longer than forty characters, surely"
    rows = [(i + 20, t) for i, t in [(0, line), (1, f"own\n{line}\nend"), (2, line), (3, "short")]]
    rows += ODD
    docs = documents(spark, rows)
    found = pipeline.drop_repeated_lines(spark, docs, "")
    left = checked(docs, found)
    assert left[(21, "own\nend")] == 1 and left[(20, line)] == 1
    assert not any(i == 22 for i, _ in left)
    assert {r.n_chars for r in found.filter("doc_id = 21").collect()} == {7}
    plain = [r for r in ODD if r[0] != 6 and r[0] is not None]
    assert all(left[r] == 1 for r in plain)


def test_near_copies_go(spark):
    texts = sentences(2, 8, 60)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t.replace(t.split()[30], "other", 1)) for i, t in enumerate(texts)]
    rows += [(300 + (i or 0), t) for i, t in ODD if t is None or not t.split()]
    docs = documents(spark, rows)
    want = brute.jaccard(rows, 5, 80, 100)
    left = checked(docs, pipeline.keep_one_of_near_copies(spark, docs, ""))
    assert left == Counter(
        (i, t) for i, t in rows if not want[i][0] or want[i][1] == i)
    assert not any(99 < i < 300 for i, _ in left)


def test_contaminated_documents_go(spark, tmp_path):
    texts = sentences(3, 6)
    items = [(1, texts[0]), (2, "short item"), (3, None), (4, "")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, "x " + texts[0] + " y"),
                                                    (11, "a SHORT, item!"), (12, "short an item")]
    rows += [(20 + (i or 0), t) for i, t in ODD]
    docs = documents(spark, rows)
    path = folder(tmp_path, spark, docs, items=items)
    left = checked(docs, pipeline.drop_contaminated(spark, docs, path))
    assert left == Counter(r for r in rows if r[0] not in (0, 10, 11))


@pytest.mark.parametrize("name,function", pipeline.STAGES)
def test_empty_tables(spark, tmp_path, name, function):
    docs = documents(spark, ODD).limit(0)
    path = folder(tmp_path, spark, docs)
    assert function(spark, docs, path).count() == 0


def test_run(spark, tmp_path):
    """Clean rows come through whole; what each stage is for does not."""
    texts = sentences(4, 200)
    line = "this very line stands in two of the documents, word by word"
    rows = [(i, t + " zorrk zorrk" if i % 5 == 0 else t) for i, t in enumerate(texts)]
    rows += [(300, texts[1] + f"\n{line}"), (301, texts[2][::-1] + f"\n{line}"),
             (302, texts[3] + " and"), (303, "item: " + " ".join(texts[4].split()[:20])),
             (304, None), (305, "")]
    docs = spark.createDataFrame(rows, DOCS)
    path = folder(tmp_path, spark, docs, [(i, 1, int(i % 5 == 0)) for i in range(200)],
                  [(1, " ".join(texts[4].split()[:20]))])
    found = pipeline.run(spark, path).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    length = Counter()
    for row in found:
        length[row.doc_id] += row.length
    assert not any(i % 5 == 0 for i in length if i < 200)
    assert not {4, 302, 303} & set(length)
    want = {i: t for i, t in rows if i < 200 and i % 5 and i != 4}
    want |= {301: texts[2][::-1], 304: "", 305: ""}
    for i, text in want.items():
        assert length[i] == len(tokens.encode(text, add_special_tokens=False).ids) + 1, i
