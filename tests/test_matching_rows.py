"""The matching queries that SQL cannot state, against a row-by-row restatement over the same tables."""

import json
import re
import unicodedata
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from shelfmark.plans import load
from tests.conftest import SF

REGISTRY = load()
LETTERS = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}
PRIORITY = {"src3": 0, "src1": 1, "src7": 2, "src0": 3}


def norm(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    folded = "".join(LETTERS.get(c, c) for c in folded)
    plain = re.sub("[^0-9a-z]+", " ", folded).strip()
    if plain and not any(c.isalpha() and not c.isascii() for c in folded):
        return plain
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", folded)).strip()


def percent(a, b):
    return round(SequenceMatcher(None, a, b).ratio() * 100)


def token_set(a, b):
    a, b = sorted(set(norm(a).split())), sorted(set(norm(b).split()))
    if not a or not b:
        return 0
    both = sorted(set(a) & set(b))
    one, two = " ".join(both + [x for x in a if x not in both]), " ".join(both + [x for x in b if x not in both])
    scores = [percent(one, two)]
    if both:
        scores += [percent(" ".join(both), one), percent(" ".join(both), two)]
    return max(scores)


def simple(a, b):
    a, b = norm(a), norm(b)
    return percent(a, b) if a and b else 0


def runs(text):
    w = text.split(" ")
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {text}


@pytest.fixture(scope="module")
def world(spark):
    """(works, hits): hits as (entry, source, source number, hit number, title, lang, doc, place)."""
    works = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        title = re.match(r"[^.!?\n]*", r.text)[0].strip(" ")
        works[str(r.item_id).zfill(5)] = (title, (r.text.split(" ") + [""])[1], 1600 + r.item_id * 7 % 400)
    wanted = defaultdict(set)
    for entry, (title, _, _) in works.items():
        if norm(title):
            for run in runs(norm(title)):
                wanted[run].add(entry)
    found = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for pos, part in enumerate(re.split(r"[.!?\n]+", r.text or "")):
            title = part.strip(" ")
            if title and norm(title):
                for entry, shared in Counter(e for run in runs(norm(title)) for e in wanted.get(run, ())).items():
                    found[entry, r.source].append((-shared, r.doc_id, pos, title, r.lang))
    hits = [(e, s, int(s[3:]), n, t, lang, d, p) for (e, s), rows in found.items() for n, (_, d, p, t, lang) in enumerate(sorted(rows))]
    assert len(hits) > 20
    return works, hits


def got(spark, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in REGISTRY.QUERIES[name](spark, SF).collect())


def test_ratios(spark, world):
    works, hits = world
    for name, score in (("token_set_ratio", token_set), ("simple_ratio", simple)):
        assert got(spark, name, "entry_id", "source_id", "score") == Counter((e, f"{d}:{p}", score(works[e][0], t)) for e, _, _, _, t, _, d, p in hits), name


def test_creators(spark, world):
    works, hits = world
    assert got(spark, "best_creator_score", "entry_id", "source_id", "score") == Counter((e, f"{d}:{p}", max(token_set(works[e][1], x) for x in (lang, t))) for e, _, _, _, t, lang, d, p in hits)


def test_best_titles(spark, world):
    works, hits = world
    best = {}
    for e, _, six, n, t, _, d, p in hits:
        a, b = token_set(works[e][0], t), simple(works[e][0], t)
        if max(a, b) > 0:
            best[e] = min(best.get(e, ((1,),)), ((-max(a, b), six, n, f"{d}:{p}", t), a, b))
    assert got(spark, "best_titles", "entry_id", "title", "token_score", "simple_score") == Counter((e, k[4], a, b) for e, (k, a, b) in best.items())


def test_search_work(spark, world):
    works, hits = world
    listed = defaultdict(list)
    for e, s, six, n, t, lang, d, p in hits:
        if n >= 5:
            continue
        title, creator, year = works[e]
        date = {1: str(1600 + d % 400), 2: f"[{1600 + d % 400}-1999]"}.get(d % 4, "")
        penalty = min(25.0, 0.5 * max(0, abs(int(date.strip("[")[:4]) - year) - 15)) if date else 0.0
        boost = (3.0 if d % 3 == 0 else 0.0) + (0.5 if d % 2 == 0 else 0.0)
        score = token_set(title, t)
        listed[e].append((six, n, s, f"{d}:{p}", t, score, score + 0.2 * token_set(creator, lang) + boost - penalty))
    rows = {r.entry_id: r for r in REGISTRY.QUERIES["search_work"](spark, SF).collect()}
    assert set(rows) == set(works)
    for e, r in rows.items():
        own = sorted(listed[e])
        passing = [x for x in own if x[5] >= 40]
        assert r.status == ("match" if passing else "no_match" if own else "no_candidates") and r.n_candidates == len(own)
        if passing:
            best = min(passing, key=lambda x: (PRIORITY.get(x[2], 9999), -x[6], x[0], x[1]))
            assert (r.selected_provider, r.selected_source_id) == (best[2], best[3]) and abs(r.selected_total - best[6]) < 1e-9
        shown = [(c["provider_ix"], c["hit_ix"], c["provider_key"], c["source_id"], c["title"], c["title_score"], round(c["total"], 6)) for c in json.loads(r.candidates)] if r.candidates else []
        assert shown == [(*x[:6], round(x[6], 6)) for x in own]
