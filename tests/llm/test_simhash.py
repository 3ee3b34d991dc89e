"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash


def spec_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def spec_components(rows):
    """rows: (doc_id, fingerprint) -> doc_id: smallest reachable."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def check(spark, rows, block=1024):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, block=block).collect()}
    prints = [(d, spec_fingerprint(t)) for d, t in rows]
    comp = spec_components(prints)
    assert got == {(d, f, comp[d]) for d, f in prints}


def test_texts_and_edge_cases(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "δ", "x"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base * 2)]
    for i in range(40):
        parts = rng.choice(base).split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        rows.append((100 + i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "One"), (205, "one two"), (206, "a b c"), (207, "A\x0bB\rC"), (208, "long " * 30_000)]
    check(spark, rows)


def test_repeated_rows_share_results_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [1, 1, 1]
    assert simhash.without_near_duplicates(docs).count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_two_texts_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "w x y z"), (7, "w x y z"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3), (7, 3)]
    assert sorted((r.doc_id or 0) for r in simhash.without_near_duplicates(docs).collect()) == [0, 0, 3]


def test_dense_groups_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 5)]
    prints = {f ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for f in base for _ in range(60)} | set(base)
    chain, f = [], 0x0123456789ABCDEF
    for _ in range(30):
        f ^= 7 << int(rng.integers(0, 60))
        chain.append(f)
    rows = list(enumerate(sorted(prints | set(chain))))
    classes = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "rep long, fp long")
    from shelfmark.llm.common import workspace

    got = {r.node: r.root for r in simhash.components(simhash.links(classes, block=8), workspace(spark, "t")).collect()}
    comp = spec_components(rows)
    assert {i: got.get(i, i) for i, _ in rows} == comp


def test_chain_filter_passes_every_close_pair_from_some_start():
    rng = random.Random(1)
    for _ in range(500):
        x = rng.getrandbits(64)
        bits = rng.sample(range(64), rng.randrange(6))
        y = x ^ sum(1 << b for b in bits)
        pair = [np.array([v], np.uint64) for v in (x, y)]
        assert any(len(simhash.chain_links(*pair, np.array([s]))) for s in range(4)) == (len(bits) <= 3)


def test_bit_needs_more_than_half(spark):
    assert simhash.fingerprint(b"") == 0
    text = "a b c d"
    assert simhash.fingerprint(text.encode()) == spec_fingerprint(text)
    docs = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert simhash.near_duplicates(docs).select(F.col("fp")).first()[0] == docs.select(F.xxhash64("text")).first()[0]
