"""The corpus pipeline against a brute-force walk through its stages."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import language_id, packing, quality
from tests.llm.test_line_dedup import spec as spec_lines
from tests.llm.test_packing import spec_ids
from tests.llm.test_quality import spec as spec_counts
from tests.llm.test_simhash import spec_components, spec_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in source.collect()}
    model = quality.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text):
        n, _, _, _, repeats = spec_counts(text)
        raw = [text.encode()]
        return n >= 10 and 100 * repeats <= 20 * n and quality.probabilities(model, raw, quality.WordBatch(raw))[0] >= 0.5

    kept = [d for d, r in docs.items() if good(r.text)]
    rest = source.filter(source.doc_id.isin(kept))
    lang = language_id.fit(rest)
    kept = [d for d in kept if (p := language_id.score(lang, [docs[d].text]))[0][0] != "und" and p[1][0] >= 0.5]
    lines = {d: t for d, t, _, _ in spec_lines([(d, docs[d].text) for d in kept])}
    component = spec_components([(d, spec_fingerprint(lines[d])) for d in kept])
    want = set()
    for d in kept:
        if component[d] == d:
            ids = np.array(spec_ids(lines[d]), "<u4")
            want |= {(d, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.pieces(len(ids))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) == len(got)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(clean & set(kept)) >= 0.95 * len(clean)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def odd_documents(spark):
    """Real documents, and rows with nulls, repeats, a very long text, blank texts, and further columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    text = docs.join(labels, "doc_id").filter("length(text) between 400 and 2000").orderBy("doc_id").first().text
    long = "\n".join(f"{text} {i} {text[::-1]}" for i in range(300))
    rows = [(None, None, None, None, None), (1_000_001, None, "en", "s", 0), (1_000_001, None, "en", "s", 0), (1_000_002, "", "en", "s", 0), (1_000_003, " \n\t", None, None, None)]
    rows += [(900_001, text, None, None, None)] * 2 + [(None, text, "en", "s", 5), (900_002, long, "en", "s", None)]
    out = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    # names that operators use inside
    for name in ("row", "fp", "key", "n", "drops", "head", "batch", "index", "_deal"):
        out = out.withColumn(name, F.lit(name))
    return out


def test_stages_on_odd_rows(spark):
    """What each stage keeps of null, blank, repeated and very long texts, row by row, with all columns as they were."""
    docs = odd_documents(spark)
    every = Counter(map(tuple, docs.collect()))

    def run(name):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        return out

    got = {name: Counter(map(tuple, run(name).collect())) for name in ("quality_rules", "language_id")}
    for name, kept in got.items():
        assert not kept - every, name
        odd = {r: n for r, n in kept.items() if r[0] is None or r[0] >= 900_000}
        # blank and null texts go, real ones stay as often as they stand there
        assert all(r[1] and r[1].strip() for r in odd), name
        assert sorted(((r[0] or 0, n) for r, n in odd.items() if r[0] != 900_002)) == [(0, 1), (900_001, 2)], name
    assert any(r[0] == 900_002 for r in got["language_id"])

    lines = {d: t for d, t, _, _ in spec_lines([(r[0], r[1]) for r in every.elements() if r[0] is not None])}
    kept = Counter(map(tuple, run("line_dedup").collect()))
    assert sum(kept.values()) == sum(every.values())
    for r in kept:
        if r[0] is not None:
            assert (r[1] or "") == lines[r[0]] and r[5:] == next(x for x in every if x[0] == r[0])[5:]
    assert kept[next(x for x in every if x[0] is None and x[1])] == 1 and kept[next(x for x in every if x[0] is None and x[1] is None)] == 1

    component = spec_components([(r[0], spec_fingerprint(r[1])) for r in every if r[0] is not None])
    kept = Counter(map(tuple, run("near_dedup").collect()))
    assert not kept - every
    assert sorted(r[0] for r in kept.elements() if r[0] is not None) == sorted({c for d, c in component.items() if d == c})
    assert sum(n for r, n in kept.items() if r[0] is None) == 2

    pieces = [r for r in run("packing").collect() if r.doc_id is None or r.doc_id >= 900_000]
    for doc, text in {(r[0], r[1]) for r in every if r[0] is not None and r[0] >= 900_000}:
        times = sum(n for r, n in every.items() if r[0] == doc)
        ids = np.array(spec_ids(text or ""), "<u4")
        want = sorted((s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.pieces(len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == doc) == sorted(want * times), doc


def test_stages_keep_rows_of_tables_with_one_row_or_one_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy("doc_id").limit(1)
    assert corpus_pipeline.near_deduplication(spark, one, SF).count() == 1 and corpus_pipeline.line_deduplication(spark, one, SF).count() == 1
    first = one.first()
    same = spark.range(500).select(F.col("id").alias("doc_id"), *[F.lit(first[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[1:]])
    assert [r.doc_id for r in corpus_pipeline.near_deduplication(spark, same, SF).collect()] == [0]
