"""Native text expressions against short restatements."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import dates, text

LETTERS = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}


def fold(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return "".join(LETTERS.get(c, c) for c in s.lower())


def key(s):
    s = fold(s)
    plain = " ".join(re.findall("[0-9a-z]+", s))
    if plain and not any(c.isalpha() and ord(c) > 127 for c in s):
        return plain
    return " ".join(re.sub(r"[^\w\s]|_", " ", s).split())


def slug(s):
    parts = re.findall("[0-9]+|[a-z]+", fold(s))
    return "_".join(parts)


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


SAMPLES = ["", "Bønder & Ærø", "Küche / Gebäck", "ﬁne ½ Ⅻ", "Подарок 1861", "ΟΔΥΣΣΕΙΑ", "Straße_42b", "naïve—Œuvre", "123 _ 456", "日本 1", "été", "x1y2", None]


def test_samples(spark):
    got = run(spark, SAMPLES, text.normalize_text(F.col("v")), text.snake_case(F.col("v")))
    assert got == [(key(s or ""), slug(s or "")) for s in SAMPLES]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ09 _-ßøÆéñ́Ωжﬁ½"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Co", "Cn"])), max_size=12), min_size=20, max_size=60))
def test_accents_and_keys(spark, values):
    got = run(spark, values, text.strip_accents(F.col("v")))
    assert [g[0] for g in got] == ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]


def test_names_and_ids(spark):
    names = ["a.pdf", "Mr. Smith's Voyage, vol. 2.pdf", "x.tar.gz", "CON", "", ".pdf", "a/b\\c<d>.jpg", "  ..  ", "n" * 150 + ".epub", "p.pdf?token=1"]
    got = [g[0] for g in run(spark, names, text.sanitize_filename(F.col("v")))]
    assert got == ["a.pdf", "Mr_Smith's_Voyage,_vol_2.pdf", "x.tar.gz", "_CON_", "_untitled_", "pdf", "bcd.jpg", "_untitled_", "n" * 100 + ".epub", "p_pdftoken=1"]
    wid = run(spark, ["Bønder"], text.work_id(F.col("v"), F.lit(None).cast("string")), text.work_directory(F.lit("E0001"), F.col("v"), F.lit("Ibsen, H."), F.lit(1880)))
    assert wid == [(hashlib.sha1(b"bonder|").hexdigest()[:10], "e_0001_bonder_ibsen_h_1880")]
    assert run(spark, ["Подарок"], text.work_directory(F.lit("7"), F.col("v")))[0][0] == "7_t_" + hashlib.sha1("Подарок".encode()).hexdigest()[:8]


def test_creators(spark):
    got = run(spark, ["Ibsen, Henrik; ; Bjørnson, B.", None, " a ;b"], text.split_creators(F.col("v")))
    assert got == [(["Ibsen, Henrik", "Bjørnson, B."],), ([],), (["a", "b"],)]
    assert run(spark, ["Émile Zola/ emile zola | Balzac,--"], text.split_creator_cell(F.col("v"))) == [(["Émile Zola", "Balzac"],)]


@pytest.mark.parametrize("value,year", [("1651-1660", 1651), ("S. XVIII", None), ("[1770]", 1770), ("1651.0", 1651), ("é1651", None), ("0999 12345 2101 1999", 1999), (None, None), ("18. Jh.", None)])
def test_years(spark, value, year):
    assert run(spark, [value], dates.extract_year(F.col("v"))) == [(year,)]


def test_penalties_and_waits(spark):
    df = spark.createDataFrame([(1700, 1690), (1700, 1600), (None, 1600), (1700, None), (1700, 1700)], "a int, b int")
    assert [r[0] for r in df.select(dates.year_penalty(F.col("a"), F.col("b"), 5)).collect()] == [2.5, 25.0, 0.0, 0.0, 0.0]
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    got = run(spark, ["5", "-3", "900", "Mon, 15 Jan 2024 12:00:30 GMT", "soon", None], dates.retry_after(F.col("v"), now, 100.0))
    assert [g[0] for g in got] == [5.0, 0.0, 100.0, 30.0, None, None]


def test_scraped_titles(spark):
    raw = ["A long enough title 1999 and more 2001 rest", "Short 1999 2001", "A History of the World Bread (Paris) (2nd ed.)", "x" * 60 + " " + "y" * 60, "Title - /", None]
    want = ["A long enough title 1999 and more", "Short 1999 2001", "A History of the World Bread (Paris)", "x" * 60, "Title", ""]
    assert [g[0] for g in run(spark, raw, text.clean_title(F.col("v")))] == want
    texts = F.array(F.col("v"), F.lit("  Émile  Zola"), F.lit("emile zola"), F.lit("d41d8cd98f00b204e9800998ecf8427e"), F.lit("Download"), F.lit("ab"))
    assert run(spark, ["A Title "], text.title_candidates(texts)) == [(["A Title", "Émile Zola"],)]


def test_decomposition_over_all_of_unicode(spark):
    """Every character that decomposes, and every mark, against the standard library's tables."""
    texts = []
    for first in range(0x80, 0x30000, 64):
        run = "".join(chr(c) for c in range(first, first + 64) if not 0xD800 <= c <= 0xDFFF)
        if unicodedata.normalize("NFKD", run) != run or any(map(unicodedata.combining, run)):
            texts.append(f"x {run} y")
    texts += ["각 한국어 텍스트", "\U0001d400\U0001d7ff", "ﬃ ½ ㎏"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_accents(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.s == "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)), r.t
