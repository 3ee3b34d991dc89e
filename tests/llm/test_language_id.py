"""Language identification: held-out accuracy, a direct restatement of the score, edge cases."""

import zlib

import numpy as np
import pytest

from shelfmark.llm import language_id as lid

WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "über straße schön grün haß", "cc": "ça été où garçon là"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang if i % 10 else None, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(docs):
    model = lid.fit(docs)
    rows = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([rows[i].lang_pred == list(WORDS)[i % 3] for i in rows if rows[i].held_out]) > 0.98


def test_real_table_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in lid.predict(docs, lid.fit(docs)).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.95


def test_held_out_rows_and_predictions_do_not_learn(spark, docs):
    model = lid.fit(docs)
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end lang")
    other = lid.fit(changed)
    assert model.languages == other.languages and np.array_equal(model.logp, other.logp)


def test_score_is_the_sum_of_gathered_rows(docs):
    model = lid.fit(docs)
    text = "Schön IPSUM, 12 été"
    folded = "".join(c if c.isalpha() else " " for c in text.lower())
    total = model.prior.copy()
    for own, bucket in lid.ngram_buckets(np.zeros(len(folded), np.int64), folded):
        for b in bucket:
            total = total + model.logp[b]
    lang, p = lid.score(model, [text, None or ""])
    want = np.exp(total - total.max())
    assert lang[0] == model.languages[int(total.argmax())] and abs(p[0] - (want / want.sum()).max()) < 1e-6
    singles, pairs, triples = (len(b) for _, b in lid.ngram_buckets(np.zeros(len(folded), np.int64), folded))
    assert (singles, pairs, triples) == (13, 14, 11)


def test_edge_cases(spark, docs):
    model = lid.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "straße " * 300_000), (5, "été"), (5, "été"), (None, "lorem ipsum")]
    got = lid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "bb" and by[5].lang_pred == "cc" and by[None].lang_pred == "aa" and by[None].held_out is False
    assert len(got) == 7
    empty = lid.fit(docs.limit(0))
    assert {r.lang_pred for r in lid.predict(docs.limit(5), empty).collect()} == {"und"}
    kept = lid.with_known_language(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert kept.count() == 4 and kept.columns == ["doc_id", "text"]


def test_long_text_in_chunks_scores_like_one(monkeypatch, docs):
    model = lid.fit(docs)
    texts = ["lorem ipsum grün " * 50, "été", "dolor"]
    whole = lid.score(model, texts)
    monkeypatch.setattr(lid, "char_chunks", lambda t, o: __import__("shelfmark.llm.common", fromlist=["x"]).char_chunks(t, o, 7))
    parts = lid.score(model, texts)
    assert whole[0] == parts[0]


def test_counts_and_priors_against_a_plain_count(spark):
    """Every n-gram of every learned text, counted one by one."""
    rows = [(i, t, l) for i, (t, l) in enumerate([("Été, 12!", "fr"), ("ab  cd", "en"), ("a", "en"), ("ß-x", "de"), ("", "de"), (None, "fr"), ("öde", None)] * 3)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [(t or "", l) for i, t, l in rows if l and zlib.crc32(str(i).encode()) % 4 != 2]
    languages = sorted({l for _, l in learned})
    counts = np.zeros((lid.BUCKETS, len(languages)))
    for text, label in learned:
        folded = "".join(c if c.isalpha() else " " for c in text.lower())
        for n in (1, 2, 3):
            for i in range(len(folded) - n + 1):
                gram = folded[i : i + n]
                if {1: gram == " ", 2: gram == "  ", 3: gram[1:2] == " "}[n]:
                    continue
                h = n * 0x27D4EB2F & 0xFFFFFFFF
                for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                    h = (h ^ ord(c)) * m & 0xFFFFFFFF
                    h ^= h >> 15
                counts[h >> 3 & (lid.BUCKETS - 1), languages.index(label)] += 1
    assert model.languages == languages
    assert np.allclose(np.exp(model.prior), [sum(l == x for _, l in learned) / len(learned) for x in languages])
    smooth = counts + 0.1
    assert np.allclose(model.logp, np.log(smooth / smooth.sum(axis=0)), atol=1e-5)


def test_ties_and_too_many_languages(spark):
    rows = [(i, "same words", l) for i, l in enumerate(["bb", "aa"] * 40)]
    even = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    half = min(sum(r[2] == x for r in even) for x in ("aa", "bb"))
    even = [r for x in ("aa", "bb") for r in [r for r in even if r[2] == x][:half]]
    docs = spark.createDataFrame(even, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lid.predict(docs, lid.fit(docs)).collect()} == {"aa"}
    with pytest.raises(ValueError, match="more than 1 languages"):
        lid.fit(docs, most_languages=1)
