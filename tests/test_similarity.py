"""Token-set and simple scores against a restatement over difflib."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from shelfmark.functions.similarity import creator_score, with_title_score, with_token_set_score
from shelfmark.functions.text import normalize_text, tokens
from tests.test_text import key


def ratio(a, b):
    return round(SequenceMatcher(None, a, b).ratio() * 100)


def token_set(a, b):
    a, b = set(key(a).split()), set(key(b).split())
    if not a or not b:
        return 0
    both = sorted(a & b)
    t0, t1, t2 = " ".join(both), " ".join(both + sorted(a - b)), " ".join(both + sorted(b - a))
    return ratio(t1, t2) if not t0 else max(ratio(t0, t1), ratio(t0, t2), ratio(t1, t2))


def pairs(n=250):
    rng = random.Random(6)
    words = ["voyage", "de", "la", "mer", "Küche", "1651", "book", "of", "cookery", "ab", "ba", "Подарок", "é", "x"] + ["long" + "word" * 30]
    out = [("", "x"), ("x", ""), ("a b", "b a"), ("tide", "diet"), ("a b c", "a b c d e f")]
    return out + [(" ".join(rng.choices(words, k=rng.randrange(1, 9))), " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for _ in range(n)]


def test_scores(spark):
    data = pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    got = with_title_score(with_title_score(df, "a", "b", "s"), "a", "b", "r", "simple").orderBy("i").collect()
    assert [r.s for r in got] == [token_set(a, b) for a, b in data]
    assert [r.r for r in got] == [ratio(key(a), key(b)) if key(a) and key(b) else 0 for a, b in data]


def test_gated_scores_agree_on_who_passes(spark):
    data = pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string").select("i", tokens(normalize_text(F.col("a"))).alias("a"), tokens(normalize_text(F.col("b"))).alias("b"))
    got = with_token_set_score(df, "a", "b", "s", least=60).orderBy("i").collect()
    for r, (a, b) in zip(got, data, strict=True):
        want = token_set(a, b)
        assert (r.s >= 60) == (want >= 60) and (r.s == want or want < 60)


def test_creators(spark):
    df = spark.createDataFrame([(0, "Ibsen, Henrik", ["Henrik Ibsen", "Zola"]), (1, None, ["x"]), (2, "x", None), (3, "x", []), (4, "Zola", ["Emile", "Zolla"])], "i int, w string, c array<string>")
    got = [r[0] for r in df.orderBy("i").select(creator_score(F.col("w"), F.col("c"))).collect()]
    assert got == [100, 0, 0, 0, max(token_set("Zola", "Emile"), token_set("Zola", "Zolla"))]


def test_best_titles(spark):
    from shelfmark.operators.select import best_titles

    rows = [("r", "Voyage to the moon", t, i) for i, t in enumerate(["zzz", "Voyage moon", "Moon voyage", "Voyage to the moon, 1865"])] + [("q", "abc", "", 0)]
    got = best_titles(spark.createDataFrame(rows, "k string, q string, t string, i int"), "k", "q", "t", "i").collect()
    assert [(r.k, r.title, r.token_score) for r in got] == [("r", "Voyage moon", 100)]
