"""Quality rules: the counts against a restatement, the model by held-out labels, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import quality as ql


def spec(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def counts(texts):
    found = ql.base_counts([(t or "").encode() for t in texts])
    return list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|\x0b\x1c\x85 ", max_size=80), min_size=1, max_size=4))
def test_counts(texts):
    assert counts(texts) == [spec(t) for t in texts]


def test_counts_of_long_repeats():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(400)), "w " * 7, None, "", "a b c d e\n" * 3 + "x"]
    assert counts(texts) == [spec(t) for t in texts]


def test_hash_clashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(ql, "_MIX", np.zeros(5, np.uint64))
    texts = ["a b c d e f g h", "a b c d e x a b c d e", "q r s t u v"]
    assert counts(texts) == [spec(t) for t in texts]


def test_model_and_edge_cases(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("calm river stone light winter garden letter morning quiet field".split()) for _ in range(40))
    bad = lambda: " ".join(rng.choice("WIN!! $$$ cash### click%%% now&&& free***".split()) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "k") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None), (9999, 0)], "doc_id long, quality int")
    model = ql.fit(docs, labels)
    got = {r.doc_id: r for r in ql.judge(docs, model).collect()}
    late = [got[i] for i in range(300, 600) if not got[i].base_failed]
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in late]) > 0.97
    assert 0 <= min(r.p_quality for r in late) and abs(np.mean([r.p_quality for r in late if r.doc_id % 3]) - 1) < 0.15
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "few words"), (5, "same words here again now " * 4000), (6, good()), (6, good()), (None, good())], "doc_id long, text string")
    out = ql.judge(odd, model).collect()
    assert len(out) == 8 and all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3, 4, 5))
    assert all(r.kept for r in out if r.doc_id in (6, None))
    kept = ql.with_good_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3
    assert ql.judge(odd.limit(0), model).count() == 0
    none = ql.fit(docs, labels.limit(0))
    assert none.weights is None and all(r.kept != r.base_failed for r in ql.judge(odd, none).collect())


def plain_probability(model, text):
    """The calibrated probability from plain sums over single n-grams."""
    mask = 0xFFFFFFFF
    words = [zlib.crc32(w.encode()) for w in re.findall("[^\x20\x09-\x0d]+", text)]
    grams = [(h * 0x9E3779B1 & mask) >> 16 for h in words] + [((a * 0x85EBCA77 + b * 0xC2B2AE3D) & mask) >> 16 for a, b in zip(words, words[1:], strict=False)]
    chars = []
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) & mask
        chars.append(ql.WORD_BUCKETS + (((h ^ (h >> 15)) * 0x27D4EB2F & mask) >> 16))
    z = model.intercept + sum(sum(float(model.weights[g]) for g in kind) / max(len(kind), 1) for kind in (grams, chars))
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def test_probabilities_and_verdicts_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = ql.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in ql.judge(docs, model).collect():
        p, (n, *_, repeats) = plain_probability(model, texts[r.doc_id]), spec(texts[r.doc_id])
        assert abs(p - r.p_quality) < 1e-4
        assert abs(p - 0.5) < 1e-4 or r.kept == (n >= 10 and 100 * repeats <= 20 * n and p >= 0.5)


def test_an_id_that_repeats_gives_one_text(spark, monkeypatch):
    docs = spark.range(5000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (0, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    held = []
    monkeypatch.setattr(ql, "fit_logistic", lambda x, y, *a, **k: held.append(x.n) or (np.zeros(x.width), 0.0))
    monkeypatch.setattr(ql, "fit_platt", lambda z, y, w: held.append(len(z)) or (1.0, 0.0))
    ql.fit(docs, labels)
    assert sum(held) in (0, 5)  # one row for each label of each id, none where the fit gives up
    held.clear()
    ql.fit(docs, labels.unionByName(labels))
    assert sum(held) in (0, 5)
