"""Corpus operators against plain versions, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql.functions import expr as F_expr
from tokenizers import Tokenizer

from llm import brute
from sparkreel.llm import bpe, decontamination, exact_dedup, extraction, jaccard_join, language
from sparkreel.llm import line_dedup, packing, substring_dedup, token_counts, toxicity, words
from sparkreel.llm.components import components
from sparkreel.llm.labelled_pages import labelled_pages

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
# Null and empty texts, blanks only, a long text, ties, repeated rows, ids that are null or shared.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word " * 3000), (5, "It's a\ttest, isn't it?\n\nYes."),
    (6, "It's a\ttest, isn't it?\n\nYes."), (6, "It's a\ttest, isn't it?\n\nYes."), (7, "tie"),
    (7, "other text under the id seven"), (None, "no id"), (None, None), (8, "é日\U0001f642"),
]


def frame(spark, rows):
    """With other columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return docs.withColumn("n_lines", F.lit("x")).withColumn("score", F.lit("x")).withColumn(
        "kept", F.lit("x")).withColumn("id", F.lit(1)).withColumn("key", F.lit(1))


def random_docs(seed, number=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(number):
        if docs and rng.random() < 0.6:
            text = list(rng.choice(docs)[1].split(" "))
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        docs.append((i, " ".join(text)))
    return docs + [(number + k, "a b " * rng.randrange(0, 60)) for k in range(10)]


# ---- 1: token counts --------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    rng = random.Random(1)
    parts = ["'s", "'", "'ll", "re", " ", "  ", "\n", "\t", "a", "aaaa", "B", "12", "!", "é",
             "日本", "<|endoftext|>", "　", "\x1c", "\x85", "\U0001f642", "'ve", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    library = Tokenizer.from_file(VOCABULARY)
    counts, ids = bpe.load(VOCABULARY).encode(texts)
    for text, count, own, theirs in zip(
            texts, counts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == theirs.ids, text
        assert count == len(theirs.ids)
    rows = token_counts.count_tokens(frame(spark, ODD), VOCABULARY).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        tokens = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (
            tokens, len((row.text or "").encode()), tokens > 512)
    assert token_counts.count_tokens(frame(spark, []), VOCABULARY).count() == 0


def alternating():
    """Two words of 1,024 letters whose letters change places by one rule."""
    turn = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)


def test_regular_words_are_told_apart(spark):
    one, other = alternating()
    library = Tokenizer.from_file(VOCABULARY)
    for texts in ([one, other], [other, one, one], ["x " + other, one + " y"]):
        own = bpe.Bpe(VOCABULARY)
        for _ in range(2):  # the second time from the cache
            counts, ids = own.encode(texts)
            assert [i.tolist() for i in ids] == [
                e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    words = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{words} {one}"), (2, f"{words} {other}")], DOCS)
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    found = jaccard_join.jaccard_components(docs, 3, 90, 100).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 2)}


def test_words_of_large_batches(monkeypatch):
    """Cutting a batch in segments changes no word and no hash."""
    texts = ["some words " * 300, "", "x" * 5000 + " end", " a  b\tc", "ü" * 700]
    whole = words.words_of(texts, more=True)
    monkeypatch.setattr(words, "SEGMENT_BYTES", 512)
    cut = words.words_of(texts, more=True)
    for name in ("start", "end", "key", "more", "first"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    assert len(whole.key) == 600 + 2 + 3 + 1 and len(set(whole.key.tolist())) == 8


def test_shared_hash_in_the_token_cache(monkeypatch):
    """Pre-tokens that share a hash, in one batch and across batches, keep their own ids."""
    own = bpe.Bpe(VOCABULARY)
    own.mix = np.uint64(0)
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["alpha beta gamma", "delta gamma alpha", "alpha", "omega beta"]
    for batch in (texts, texts[::-1], texts[1:3]):
        assert [i.tolist() for i in own.encode(batch)[1]] == [
            e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


# ---- 2: line dedup ----------------------------------------------------------------------------


@pytest.mark.parametrize("min_chars", [1, 40])
def test_lines_against_brute_force(spark, min_chars):
    rng = random.Random(2)
    lines = ["a" * 12, "b" * 7, "cc", "", "d" * 50]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(25)))) for i in range(60)]
    docs += [(90, None), (91, "z" * 50 + "\n" * 9), (92, docs[3][1] + "\nx\n" + docs[7][1])]
    want, text = brute.lines(docs, min_chars), dict(docs)
    rows = line_dedup.line_dedup(spark.createDataFrame(docs, DOCS).repartition(4), min_chars)
    for row in rows.collect():
        own = (text[row.doc_id] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(own) if i not in want[row.doc_id])
        assert row.n_removed == len(want[row.doc_id])
        assert row.kept_text == (None if text[row.doc_id] is None else kept)


def test_lines_of_odd_rows(spark):
    rows = line_dedup.line_dedup(frame(spark, ODD), 1).collect()
    assert len(rows) == len(ODD)
    kept = Counter((r.doc_id, r.kept_text) for r in rows)
    # Row 5 comes first; both rows of 6 are one document, a later copy.
    assert kept[(5, ODD[4][1])] == 1 and kept[(6, "")] == 2
    assert kept[(7, "tie")] == 1 and kept[(None, "no id")] == 1 and kept[(1, None)] == 1
    assert {"score", "kept", "id", "key"} <= set(rows[0].asDict())
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# ---- 3: toxicity ------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if i % 6 == 0:
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = "zorrk" + rng.choice(words)
        docs.append((i, " ".join(text)))
        if i % 3 != 1:
            labels.append((i, int(i % 6 == 0)))
    labels += [(None, 1), (1, None)]
    model = toxicity.fit_toxicity(
        spark.createDataFrame(docs, DOCS),
        spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id < 1200"))
    assert 0 < len(model.weights) < 5000
    rows = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), model).collect()
    held = [r for r in rows if r.doc_id >= 1200]
    right = sum(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert right / len(held) > 0.97
    odd = toxicity.score_toxicity(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_no_labels_give_one_half(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame(spark, ODD), none)
    assert {r.score for r in toxicity.score_toxicity(frame(spark, ODD), model).collect()} == {0.5}


def test_labels_without_documents(spark):
    """Labels of other documents do not push those of the documents at hand out of the sample."""
    docs = spark.createDataFrame(
        [(i, f"zorrk text {i}" if i % 2 else f"quiet text {i}") for i in range(200)]
        + [(1, "zorrk again")] * 30, DOCS)
    labels = spark.range(20_000).select(
        "id", (F_expr("id % 2")).alias("toxic")).withColumnRenamed("id", "doc_id")
    options = toxicity.FtrlOptions(max_rows=100, l1=0.1)
    model = toxicity.fit_toxicity(docs, labels, options)
    again = toxicity.fit_toxicity(docs.repartition(3), labels, options)
    assert model.fitted and len(model.weights) > 0
    assert (model.weights == again.weights).all() and model.bias == again.bias
    rows = toxicity.score_toxicity(docs, model).collect()
    assert sum(r.predicted == ("zorrk" in r.text) for r in rows) > 0.9 * len(rows)
    none = toxicity.fit_toxicity(docs, labels.filter("doc_id > 5000"), options)
    assert not none.fitted and len(none.weights) == 0


def test_weights_against_plain_ftrl():
    """One shard against updates of one coordinate after another."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["good", "bad", "ugly", "plain", "odd"]) for _ in range(6))
             for _ in range(40)]
    labels = np.array([float("bad" in t) for t in texts])
    options = toxicity.FtrlOptions(epochs=3, l1=0.5)
    found = toxicity._fit(texts, labels, options)
    owner, bucket = toxicity.features(texts)
    sets = [set(bucket[owner == i].tolist()) for i in range(len(texts))]
    seen = Counter(b for own in sets for b in own)
    z, n = Counter(), Counter()

    def weight(b):
        l1 = 0.0 if b == -1 else options.l1
        if abs(z[b]) <= l1:
            return 0.0
        rate = (options.beta + math.sqrt(n[b])) / options.alpha
        return -math.copysign(abs(z[b]) - l1, z[b]) / rate

    order = np.random.default_rng(options.seed)
    for _ in range(options.epochs):
        for i in order.permutation(len(texts)).tolist():
            at = [b for b in sorted(sets[i]) if seen[b] >= options.least_texts] + [-1]
            own = {b: weight(b) for b in at}
            g = 1 / (1 + math.exp(-sum(own.values()))) - labels[i]
            for b in at:
                step = (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / options.alpha
                z[b] += g - step * own[b]
                n[b] += g * g
    want = {b: weight(b) for b in list(z) if b == -1 or weight(b)}
    got = dict(zip(found["bucket"].tolist(), found["weight"].tolist()))
    assert got.keys() == want.keys() and len(got) > 5
    assert all(math.isclose(got[b], want[b], rel_tol=1e-9, abs_tol=1e-12) for b in want)


# ---- 4: exact dedup ---------------------------------------------------------------------------


def test_exact_groups(spark):
    docs = ODD + [(20, "a  b"), (21, "a\t\nb"), (22, "a b "), (23, "a b")]
    docs += [(30 + i, "same head " * 20 + str(i % 2)) for i in range(6)]
    rows = exact_dedup.exact_dedup(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(brute.BLANKS.sub(" ", text or ""), []).append(doc_id)
    for row in rows:
        text = brute.BLANKS.sub(" ", row.text or "")
        ids = [i for i in groups[text] if i is not None]
        keep = min(ids) if ids else None
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.keep_id, row.group_size) == (keep, len(groups[text]))
        assert row.kept == (row.doc_id == keep)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# ---- 5: decontamination -----------------------------------------------------------------------


def test_items_in_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for i in range(30)]
    items += [(30, None), (31, ""), (None, "one two three four five six"), (2, items[2][1])]
    items += [(32, "FIVE, six!"), (33, "w3"), (34, "w1 w2 w3 w4"), (35, "never-seen here")]
    docs = list(ODD)
    for i in range(60):
        own = rng.choice(items[:30])[1].split()
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = "changed"
        filler = [f"f{rng.randrange(1000)}" for _ in range(rng.randrange(0, 400))]
        docs.append((100 + i, " ".join([*filler, *own, *filler]).upper()))
    docs.append((300, "ONE, two; three-four five six!"))

    def grams(text, item):
        found = brute.re.findall(r"[^\W_]+", (text or "").lower())
        of_item = brute.re.findall(r"[^\W_]+", (item or "").lower())
        n = min(len(of_item), 5)
        return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()

    want = set()
    for item, text in items:
        for doc, whole in docs:
            own = grams(text, text)
            shared = len(own & grams(whole, text))
            if shared and 5 * shared >= 4 * len(own):
                want.add((doc, item, shared, len(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(frame(spark, docs), bench).collect()
    assert sorted(map(str, [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found])) == sorted(
        map(str, want))
    assert len(want) > 20
    left = decontamination.remove_contaminated(frame(spark, docs), bench).collect()
    gone = {w[0] for w in want}
    assert Counter(r.doc_id for r in left) == Counter(i for i, _ in docs if i not in gone)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(frame(spark, docs), none).count() == 0
    assert decontamination.find_contamination(frame(spark, []), bench).count() == 0


# ---- 6: extraction ----------------------------------------------------------------------------


def test_messages_give_exact_marginals():
    """Sum-product on a small tree against the sum over all labellings."""
    page = extraction.parse("<div><p>one</p><ul><li>two</li></ul></div>")
    rng = random.Random(6)
    n = len(page.parent)
    odds = [rng.uniform(-2, 2) for _ in range(n)]
    edge = [[[rng.uniform(-2, 2) for _ in (0, 1)] for _ in (0, 1)] for _ in (0, 1)]
    weight = np.zeros((n, 2))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        total = sum(o for o, on in zip(odds, y, strict=True) if on) + sum(
            edge[int(page.text[i] is not None)][y[page.parent[i]]][y[i]] for i in range(1, n))
        for i in range(n):
            weight[i, y[i]] += math.exp(total)
    belief = extraction.marginals(page, odds, edge)[0]
    assert np.allclose(belief, np.log(weight[:, 1] / weight[:, 0]))


def test_extraction_held_out():
    model = extraction.default_model()
    right = total = 0
    for source in labelled_pages(100, seed=99):
        page = extraction.parse(source)
        odds = [sum(model.unary.get(f, 0.0) for f in own) for own in extraction.features(page)]
        for text, mark, belief in zip(
                page.text, page.marked, extraction.marginals(page, odds, model.edge)[0], strict=True):
            if text is not None:
                total += 1
                right += bool(mark) == (belief >= 0)
    assert right / total > 0.95


def test_extraction_of_odd_pages(spark):
    body = "<article><h1>A &amp; B</h1><p><b>One\n two three four.<br><p>Next &eacute;.</article>"
    pages = [(1, "u", f"<html><body><nav><a href=/>x</a></nav>{body}<footer>f</footer></body>"),
             (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", f"<body>{body[:40]}"),
             (6, None, "<script>var a = '</p>';</script>"), (1, "u", f"<body>{body}")]
    rows = extraction.extract_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    texts = {(r.page_id, r.html): (r.text, r.n_chars) for r in rows}
    full = "A & B\n\nOne two three four.\n\nNext é."
    assert texts[(1, pages[0][2])] == (full, len(full))
    assert texts[(2, None)] == ("", 0) and texts[(6, pages[5][2])] == ("", 0)


PAGES = [
    # (page, what stays of it, block by block)
    ("<html><head><title>T</title><style>p{}</style></head><body>"
     "<nav class='menu'><a href=/>Home</a> <a href=/a>About</a></nav>"
     "<article><h1>The &amp; headline</h1><p>First   paragraph with\n several words in it, long "
     "enough to be read.</p><p>Second paragraph, also of some length and with a full stop.</p>"
     "</article><footer><p>Copyright 2020. All rights reserved.</p></footer></body></html>",
     ["The & headline", "First paragraph with several words in it, long enough to be read.",
      "Second paragraph, also of some length and with a full stop."]),
    ("<div id=main><h1>A headline</h1><p>Only text of the page, told in one plain and rather long sentence.<p>"
     "And another one that nobody closed, which goes on for a good while.</div>"
     "<script>var a = '<p>no</p>';</script>"
     "<div class='sidebar'><ul><li><a href=x>Link</a></ul></div>",
     ["A headline", "Only text of the page, told in one plain and rather long sentence.",
      "And another one that nobody closed, which goes on for a good while."]),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages_block_by_block(spark, page, want):
    table = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = extraction.extract_pages(table).first().text
    assert text.split("\n\n") == want


def test_odd_pages(spark):
    from pyspark.sql import functions as F

    deep = "<span><div>" * 20_000 + "deep text"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<" * 5000), (4, "u", deep), (4, "u", deep),
            (5, "u", "<p>" + "long words " * 200_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "text", F.lit("x")).withColumn("n_chars", F.lit("x"))
    began = time.monotonic()
    found = extraction.extract_pages(table).select("page_id", "text", "n_chars").collect()
    assert time.monotonic() - began < 60
    assert sorted(r.page_id for r in found) == [1, 2, 3, 4, 4, 5]
    assert all(r.n_chars == len(r.text) for r in found)
    assert extraction.extract_pages(table.limit(0)).count() == 0


# ---- 7: packing -------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    docs = ODD + [(100 + i, "token " * (37 * i % 900)) for i in range(60)]
    docs += [(500, "x y " * 1500)]
    rows = packing.pack_documents(frame(spark, docs), VOCABULARY, 256, per_group=32).collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in docs)
    want = Counter()
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at, size, piece = 0, (len(ids) - 1) % 256 + 1, 0
        while at < len(ids):
            crc = zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())
            want[(doc_id, piece, at, size, crc)] += 1
            at, size, piece = at + size, 256, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = pd.DataFrame([r.asDict() for r in rows]).sort_values(["sequence_id", "offset"])
    ends = bins.groupby("sequence_id")["length"].cumsum()
    assert (ends - bins["length"] == bins["offset"]).all() and ends.max() <= 256
    assert bins["sequence_id"].nunique() <= math.ceil(bins["length"].sum() / 256) + 1
    assert packing.pack_documents(frame(spark, []), VOCABULARY).count() == 0


def test_packing_goes_on_until_groups_have_met(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(26, 45, 600).tolist()
    pieces = spark.createDataFrame(
        [(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces.repartition(2), 100, per_group=8).toPandas()
    assert sorted(zip(rows["doc_id"], rows["length"])) == list(enumerate(lengths))
    assert rows.groupby("sequence_id")["length"].sum().max() <= 100
    whole = len(packing.best_fit(np.array(lengths), 100)[2])
    assert rows["sequence_id"].nunique() <= whole + 2


def test_bounds_never_exceed_packings():
    rng = np.random.default_rng(7)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, space = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(space)
        assert (np.bincount(bins, lengths) + space == 100).all()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


# ---- 8: substring dedup -----------------------------------------------------------------------


def test_windows_against_brute_force(spark):
    rng = random.Random(8)
    docs = random_docs(8)
    docs += [(200 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(40)]
    docs += [(300, None), (301, "x\t" * 70), (302, "p q r " * 30)]
    want = brute.substring(docs)
    found = substring_dedup.digest(
        substring_dedup.substring_dedup(spark.createDataFrame(docs, DOCS).repartition(4)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == want
    assert sum(w[1] for w in want.values()) > 100


def test_windows_of_odd_rows(spark):
    rows = substring_dedup.substring_dedup(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r.n_removed for r in rows if r.doc_id != 4} == {0}
    assert [r.n_words - r.n_removed for r in rows if r.doc_id == 4] == [1]
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


# ---- 9: language ------------------------------------------------------------------------------


def test_language_held_out(spark):
    rng = random.Random(9)
    letters = {"aa": "aeiklmn", "bb": "bdoprstu", "cc": "бваоин"}
    docs = []
    for i in range(240):
        lang = list(letters)[i % 3]
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 8)))
                        for _ in range(rng.randrange(3, 60)))
        docs.append((i, text, lang if i % 4 else None))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit_languages(table.filter("doc_id < 160"))
    rows = language.identify_languages(table.filter("doc_id >= 160"), model).collect()
    assert all(r.lang_pred == list(letters)[r.doc_id % 3] for r in rows)
    odd = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in
           language.identify_languages(frame(spark, ODD + [(9, "12 ...")]), model).collect()}
    for key in ((1, None), (2, ""), (9, "12 ...")):
        assert odd[key] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in odd.values())
    nothing = language.fit_languages(table.limit(0))
    assert language.identify_languages(table, nothing).filter("lang_pred <> 'und'").count() == 0


# ---- 10: Jaccard join -------------------------------------------------------------------------


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100)])
def test_links_against_brute_force(spark, size, num, den):
    docs = random_docs(10, 120)
    want = brute.jaccard(docs, size, num, den)
    found = jaccard_join.jaccard_components(
        spark.createDataFrame(docs, DOCS).repartition(4), size, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_links_of_odd_rows(spark):
    rows = jaccard_join.jaccard_components(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    found = Counter((r.doc_id, r.component_id) for r in rows)
    assert found[(6, 5)] == 2 and found[(1, 1)] == 1 and found[(None, None)] == 2
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_links_of_shared_and_missing_ids(spark):
    rng = random.Random(11)
    docs = [(rng.choice([None, *range(12)]), text) for _, text in random_docs(11, 60)] + ODD
    docs += docs[:5]
    texts = dict(enumerate(sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))))
    sets = brute.jaccard([(i, text) for i, (_, text) in texts.items()])
    members = {}
    for i, (_, component) in sets.items():
        members.setdefault(component, []).append(i)
    want, stay = Counter(), 0
    for i, row in texts.items():
        ids = [texts[j][0] for j in members[sets[i][1]] if texts[j][0] is not None]
        want[(row[0], sets[i][0], min(ids, default=None))] += docs.count(row)
        stay += docs.count(row) if not sets[i][0] else sets[i][1] == i
    found = jaccard_join.jaccard_components(frame(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    left = jaccard_join.without_near_copies(frame(spark, docs)).collect()
    assert len(left) == stay < len(docs) - 5
    components_left = Counter(
        sets[next(i for i, d in texts.items() if d == (r.doc_id, r.text))][1]
        for r in left if (r.text or "").split())
    assert set(components_left.values()) == {1}


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 80), (5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.id, r.component) for r in found} == {(i, 0) for i in range(41)} | {
        (100, 80), (90, 80), (80, 80)}


@pytest.mark.parametrize("n", [2_000, 5_000])
def test_bitmaps_of_large_sets_tell_them_apart(spark, n):
    """Sets with 60 % of their members shared: far from linked, and their bitmaps show it."""
    texts = [" ".join(f"w{i}" for i in range(begin, begin + n)) for begin in (0, n * 2 // 5, n // 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_key long, text string").selectExpr(
        "_key", "_key AS doc_id", "text")
    sizes = jaccard_join._sizes(docs, 3)
    a, b = (sizes.selectExpr(f"_key {e}", f"n_shingles n{e}", f"bits bits{e}") for e in "ab")
    may = jaccard_join.may_link(*[F_expr(c) for c in ("bitsa", "bitsb", "na", "nb")], 80, 100)
    pairs = a.crossJoin(b).filter("a < b").select("a", "b", may)
    assert {(r[0], r[1]): r[2] for r in pairs.collect()} == {
        (0, 1): False, (0, 2): True, (1, 2): False}
