"""Line deduplication against a plain restatement."""

import random
from collections import defaultdict

from shelfmark.llm import line_dedup

BLANKS = "\t\n\x0b\x0c\r "


def spec(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_against_restatement(spark):
    rng = random.Random(2)
    pool = [f"Shared line number {i} ÉÀ with words" for i in range(6)] + ["short", "", "  ", "  twenty points here   "]
    rows = []
    for d in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + [f"own text of document {d} is long"]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r"]) for x in lines]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0]), (103, pool[0]), (104, "\n".join([pool[1]] * 5000)), (None, pool[0]), (105, pool[0] + "\n")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, drops string")
    got = [(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=order) == sorted(spec(rows), key=order)


def test_filter_form_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "the very same long line here\nown " + str(i), "en", "s", 0, "x") for i in range(4)] + [(9, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[0].text == "own 0" and got[0].n_chars == 5 and got[3].text.startswith("the very") and got[9].text is None
    assert line_dedup.without_repeated_lines(docs).schema.names == docs.schema.names
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
