"""Machines against plain restatements, and streams against batches."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import state as st
from shelfmark.streaming import machines as sm


def events(n=300, seed=1):
    rng = random.Random(seed)
    t = {k: 0.0 for k in "abc"}
    out = []
    for i in range(n):
        k = rng.choice("aabc")
        t[k] += rng.choice([0, 1, 5, 200, 400]) - (300_000 if rng.random() < 0.01 else 0)
        out.append((k, i, float(t[k]), rng.random() < 0.5))
    return out


def by_key(rows):
    out = {}
    for k, i, t, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(k, []).append((i, t, ok))
    return out


def spec_breaker(rows, threshold=3, cooldown=300):
    want = {}
    for own in by_key(rows).values():
        opened, failures = None, 0
        for i, t, ok in own:
            if opened is not None and t - opened < cooldown:
                want[i] = (False, "open", failures)
                continue
            probe, opened_before = opened is not None, opened
            opened = None
            if ok:
                failures = 0
            else:
                failures += 1
                if probe or failures >= threshold:
                    opened = t
            want[i] = (True, "open" if opened is not None else "closed", failures)
            assert opened_before is None or probe
    return want


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, t double, ok boolean")


def test_breaker(spark):
    rows = events()
    got = st.breaker(frame(spark, rows).repartition(3), "k", "t", "i", "ok").collect()
    assert {r.i: (r.admitted, r.state, r.failures) for r in got} == spec_breaker(rows)


def test_quota_and_limiter(spark):
    rows = events(seed=2)
    got = {r.i: (r.allowed, r.used) for r in st.quota(frame(spark, rows), "k", "t", "i", 4, 1).collect()}
    slow = {r.i: round(r.started, 6) for r in st.limiter(frame(spark, rows), "k", "t", "i", 60.0).collect()}
    for own in by_key(rows).values():
        begun, used, last = None, 0, None
        for i, t, _ in own:
            if begun is None or t - begun >= 3600:
                begun, used = t, 0
            ok = used < 4
            used += ok
            assert got[i] == (ok, used)
            last = t if last is None else max(t, last + 60.0)
            assert slow[i] == round(last, 6)


@pytest.mark.parametrize("stop", [False, True])
def test_budget(spark, stop):
    rng = random.Random(4)
    items = [(i, f"w{rng.randrange(5)}", rng.choice(["pdfs", "images"]), rng.randrange(1, 40)) for i in range(200)]
    df = spark.createDataFrame(items, "i long, w string, k string, n long").repartition(4)
    got = {r.i: r.admitted for r in st.budget(df, "w", "k", "n", "i", {"pdfs": 150, "images": None}, {"pdfs": 400, "images": 10**9}, stop).collect()}
    works, total, ended = {}, 0, False
    for i, w, k, n in items:
        if k == "images":
            assert got[i] == (not ended)
            continue
        fits = total + n <= 400 and not ended
        ok = fits and works.get(w, 0) + n <= 150
        # the first refusal by a total ends the run for every kind
        ended |= stop and not fits
        if ok:
            works[w], total = works.get(w, 0) + n, total + n
        assert got[i] == ok


def test_budget_of_long_works_and_no_size(spark):
    rows = [(i, "w", "pdfs", 0 if i % 3 == 0 else 10) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, w string, k string, n long")
    for stop in (False, True):
        got = {r.i: r.admitted for r in st.budget(df, "w", "k", "n", "i", {"pdfs": 2000}, {"pdfs": 1000}, stop).collect()}
        assert sum(got[i] for i, *_ in rows if i % 3) == 100 and all(got[i] for i, *_ in rows if i % 3 == 0)


def test_long_keys_are_cut_into_ranges(spark, monkeypatch):
    """Limiter and runs of failures are the same however the order is cut."""
    rows = [(k if i % 50 else None, i, float(rng), i % 7 > 2) for i, (k, rng) in enumerate((k, random.Random(i).randrange(4000)) for i, k in enumerate("ab" * 400))]
    df = frame(spark, rows)
    out = {}
    for parts in (1, 3, 64):
        monkeypatch.setattr(st, "RANGES", parts)
        monkeypatch.setattr(st.ranges, "__defaults__", (parts,))
        out[parts] = (
            sorted((r.i, round(r.started, 6), round(r.waited, 6)) for r in st.limiter(df, "k", "t", "i", 3.0).collect()),
            sorted(map(str, st.islands(df, "k", ["t", "i"], ~F.col("ok")).collect())),
        )
    assert out[1] == out[3] == out[64] and len(out[1][0]) == 800


def test_null_keys_are_one_key(spark):
    rows = [(None, i, float(i), False) for i in range(6)] + [(1, i + 6, float(i), False) for i in range(2)]
    df = spark.createDataFrame(rows, "k long, i long, t double, ok boolean")
    got = {r.i: (r.admitted, r.state) for r in st.breaker(df, "k", "t", "i", "ok").collect()}
    assert [got[i] for i in range(6)] == [(True, "closed")] * 2 + [(True, "open")] + [(False, "open")] * 3
    assert [got[i] for i in (6, 7)] == [(True, "closed")] * 2
    used = {r.i: r.used for r in st.quota(df, "k", "t", "i", 4, 1).collect()}
    assert [used[i] for i in range(8)] == [1, 2, 3, 4, 4, 4, 1, 2]


def test_islands_early_stop_and_files(spark):
    df = frame(spark, [("a", i, float(i), ok) for i, ok in enumerate([True, False, False, True, False, False, False])])
    runs = sorted((r.length, r.first, r.last) for r in st.islands(df, "k", ["t", "i"], ~F.col("ok")).collect())
    assert runs == [(2, 1.0, 2.0), (3, 4.0, 6.0)]
    pages = spark.createDataFrame([("w", i, p, False) for i, p in enumerate([False, True, True, False, True, True, True, False])], "k string, i int, p boolean, f boolean")
    assert sorted(r.i for r in st.early_stop(pages, "k", "i", "p", "f").collect()) == list(range(7))
    files = spark.createDataFrame([("w", "s" * 60, "gb", e, i) for i, e in enumerate([".jpg", ".pdf", ".png", ".pdf", ""])], "w string, stem string, slug string, e string, i int")
    s = "s" * 50
    assert [r.filename for r in st.number_files(files, "w", "stem", "slug", "e", "i").orderBy("i").collect()] == [f"{s}_gb_image_001.jpg", f"{s}_gb.pdf", f"{s}_gb_image_002.png", f"{s}_gb_2.pdf", f"{s}_gb"]


@pytest.mark.parametrize("machine", ["breaker", "quota"])
def test_stream_equals_batch(spark, machine):
    rows = sorted((r for r in events(seed=7) if r[2] >= 0), key=lambda r: (r[2], r[1]))
    folder = tempfile.mkdtemp()
    for n, part in enumerate((rows[:150], rows[150:])):
        frame(spark, part).coalesce(1).write.parquet(f"{folder}/in/{n}")
    source = spark.readStream.schema("k string, i long, t double, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    args = ("k", "t", "i", "ok") if machine == "breaker" else ("k", "t", "i", 4, 1)
    live = getattr(sm, machine)(source, *args).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    live.awaitTermination(120)
    want = getattr(st, machine)(frame(spark, rows), *args)
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
