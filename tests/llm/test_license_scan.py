"""License scans: every template finds itself, edited wordings are told apart, plain text stays clean."""

import random
import textwrap

import pytest
import zstandard

from shelfmark.llm import license_scan as ls

SCANNER = ls.Scanner()


@pytest.mark.parametrize("name", [x[0] for x in ls.LICENSES])
def test_each_license_is_found_in_prose(name):
    cited = next(x[1][0] for x in ls.LICENSES if x[0] == name)
    for sentence in (f"Licensed under the {cited}.", f"Released under the {cited}.", f"This work is licensed under {cited}."):
        text = f"The river was calm and wide.\nSome words before. {sentence}\nThe end of it. More plain words."
        assert {f.license for f in SCANNER.scan(text)[1]} == {name}


def test_wording_decides():
    found = lambda t: sorted({f.license for f in SCANNER.scan(t)[1]})
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 7.") == []
    assert found("Released under the MIT License.\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "MIT"]
    assert found("She was granted a driving license and permission to travel under the copyright of the king.") == []
    opening = next(x[3] for x in ls.LICENSES if x[0] == "MIT")
    assert found(opening) == ["MIT"] and SCANNER.scan(opening.replace("publish", "print"))[1][0].missing == 1
    assert SCANNER.scan("Released under the MIT License.")[1][0].exact


def test_reductions_are_conditional_compression():
    block = "Licensed under the Apache License, Version 2.0."
    order = SCANNER.ranked(block)
    assert SCANNER.templates[order[0][1]][0] == "Apache-2.0" and order[0][0] > 0.5
    assert [r for r, _ in order] == sorted((r for r, _ in order), reverse=True)
    raw = zstandard.ZstdCompressionDict(b"nothing alike here", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert len(raw.as_bytes()) == 18


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "word " * 50_000 + "\nReleased under the MIT License."), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (None, "license " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_blocks int")
    got = ls.scan_documents(docs).collect()
    assert len(got) == 7 and [r.licenses for r in sorted(got, key=lambda r: r.doc_id or 0)] == ["", "", "", "", "MIT", "MIT", "MIT"]
    assert ls.scan_documents(docs.limit(0)).count() == 0


def prose(n):
    """A sentence's worth of plain words, none of them a licensing word."""
    plain = "the river was calm and wide when under a grey morning sky all of them walked along to an old mill that stood beside its western bank".split()
    return " ".join(plain[i * i % len(plain)] + ("" if i % 3 else str(i)) for i in range(n))


@pytest.mark.parametrize("n", [20, 50, 100, 200, 400])
def test_long_sentences_keep_their_citations(n):
    for name, cited, _, _ in ls.LICENSES:
        sentence = f"The library that {prose(n - 14)} is released under the {cited[0]}."
        assert [(f.license, f.exact) for f in SCANNER.scan(sentence)[1]] == [(name, True)], (name, n)


def test_every_license_of_a_sentence_is_found():
    found = lambda t: [f.license for f in SCANNER.scan(t)[1]]
    assert found("Licensed under the MIT License or the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert found("Licensed under the Apache License, Version 2.0 and/or the MIT License.") == ["Apache-2.0", "MIT"]
    assert found("Released under the MIT License, the ISC License or CC0 1.0, as you like.") == ["MIT", "ISC", "CC0-1.0"]
    assert found("It is licensed under the ISC License and its data are licensed under the CC BY 4.0 with thanks.") == ["ISC", "CC-BY-4.0"]
    assert found("Licensed under the MIT License or The Unlicense.") == ["MIT", "Unlicense"]
    assert found("Released under the MIT License, the wide river says.") == ["MIT"]
    six = ["MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0", "ISC", "CC0-1.0"]
    cited = {x[0]: x[1][0] for x in ls.LICENSES}
    assert found("Parts are " + ", parts are ".join(f"licensed under the {cited[x]}" for x in six) + ".") == six


@pytest.mark.parametrize("name", [x[0] for x in ls.LICENSES if x[3]])
def test_openings_are_found_on_one_line_and_wrapped(name):
    opening = next(x[3] for x in ls.LICENSES if x[0] == name)
    wrapped = textwrap.wrap(opening, 75)
    for text in (opening, opening.upper(), "\n".join(wrapped), "\r\n".join(wrapped), "\n".join(f" * {x}" for x in textwrap.wrap(opening, 40))):
        found = SCANNER.scan(f"The river was calm.\n{text}\nThe end of it.")[1]
        assert [(f.license, f.exact) for f in found] == [(name, True)], text


def test_every_wording_starts_a_block():
    for x in ls.LICENSES:
        for w, _ in ls.wordings(x):
            assert ls.CUE.search(" ".join(w)), w


SHAPES = {
    "one line": lambda t: t, "capitals": str.upper, "wrapped": lambda t: "\n".join(textwrap.wrap(t, 72)), "hashes": lambda t: "\n".join("# " + x for x in textwrap.wrap(t, 70)),
    "slashes": lambda t: "\r\n".join("// " + x for x in textwrap.wrap(t, 70)), "stars": lambda t: "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 60)) + "\n */", "quoted": lambda t: "\n".join("> " + x for x in textwrap.wrap(t, 50)), "dnl": lambda t: "\n".join("dnl " + x for x in textwrap.wrap(t, 75)),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("name", sorted(ls.TEXTS))
def test_whole_texts_are_found_in_every_shape(name, shape):
    text = f"Copyright (c) 2019 A. Writer\n\n{SHAPES[shape](ls.TEXTS[name])}\n\nint main() {{}}\n"
    found = SCANNER.scan(text)[1]
    assert [f.license for f in found] == [name]
    assert found[0].exact


@pytest.mark.parametrize("name", [x[0] for x in ls.LICENSES])
def test_tags_headings_and_short_names(name):
    cited = next(x[1] for x in ls.LICENSES if x[0] == name)
    texts = [f"// SPDX-License-Identifier: {name}\nint x;", f"# SPDX-License-Identifier: {name}-or-later", f"License: {name}", f"Plain words.\n\n{cited[0]}\n\nMore of them."]
    texts += [f"It is licensed under {n}." for n in ls.SHORT_NAMES[name]] + [f"Licensed under the {n}, see below." for n in ls.SHORT_NAMES[name]]
    for text in texts:
        assert [f.license for f in SCANNER.scan(text)[1]] == [name], text


def test_short_examples():
    found = lambda t: [f.license for f in SCANNER.scan(t)[1]]
    want = {"SPDX-License-Identifier: MIT": "MIT", "Licensed under MIT.": "MIT", "MIT License": "MIT", "The MIT License (MIT)": "MIT", "Licensed under GPL-2.0.": "GPL-2.0", "Licensed under the GPLv3.": "GPL-3.0", "License: BSD 3-Clause": "BSD-3-Clause"}
    for text, name in want.items():
        assert found(text) == [name], text
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    assert found("Er fuhr mit dem Zug, mit Permission der Stadt. A license to drive. The GNU is an animal.") == []


def brute(text):
    """Every template's every wording against the whole text: no block, no ranking, no first look at word counts."""
    have = ls.words(text)
    stated = []
    for at, x in enumerate(ls.LICENSES):
        for wording, decisive in ls.wordings(x):
            for missing, extra, start, end in ls.places(wording, have, decisive):
                if (reduction := SCANNER.reduction(have[start:end], at)) >= ls.LEAST_REDUCTION:
                    stated.append((missing + extra, -len(wording), -reduction, at, missing, start, end))
    taken, found = set(), []
    for _, _, _, at, _, start, end in sorted(set(stated)):
        if not taken & set(range(start, end)):
            taken |= set(range(start, end))
            found.append((start, ls.LICENSES[at][0]))
    return [name for _, name in sorted(found)]


def plain_places(wording, have, decisive):
    """Whole-word alignment by the textbook table, for each start and end; the fewest differences at each end, then the later start."""
    best = {}
    for start in range(len(have)):
        row = list(range(len(wording) + 1))
        lacks = list(range(len(wording) + 1))
        for end in range(start + 1, len(have) + 1):
            new, missing = [end - start], [0]
            for j, w in enumerate(wording, 1):
                options = [(new[j - 1] + 1, missing[j - 1] + 1), (row[j] + 1, lacks[j])]
                if have[end - 1] == w:
                    options.append((row[j - 1], lacks[j - 1]))
                d, m = min(options)
                new.append(d)
                missing.append(m)
            row, lacks = new, missing
            best[end] = min(best.get(end, (10**9,)), (row[-1], lacks[-1], -start))
    most = round(len(wording) * (1 - ls.LEAST_WORDING), 9)
    return {(m, d - m, -s, e) for e, (d, m, s) in best.items() if m <= most and d - m <= most and all(w in have[-s:e] for w in decisive)}


def test_places_against_the_textbook_table():
    rng = random.Random(5)
    wording = "licensed under the terms of the small license".split()
    for _ in range(60):
        have = [rng.choice([*wording, "river", "old"]) for _ in range(rng.randrange(1, 9))] + [w for w in wording if rng.random() < 0.9] + ["end"]
        got = set(ls.places(wording, have, []))
        want = plain_places(wording, have, [])
        assert {(m + x, e) for m, x, _, e in got} == {(m + x, e) for m, x, _, e in want}


def test_scan_against_every_wording_everywhere():
    rng = random.Random(11)
    pool = [t for x in ls.LICENSES for t in (x[1][0], x[3], *(c.format(rng.choice(x[1])) for c in ls.CITATIONS), *(c.format(rng.choice(ls.SHORT_NAMES[x[0]])) for c in ls.CITATIONS)) if t]
    for n in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            told = rng.choice(pool).split()
            if rng.random() < 0.4 and len(told) > 12:
                told[rng.randrange(len(told))] = "instead"
            # full stops between, so that no list of names joins
            parts += [prose(rng.randrange(5, 300)), rng.choice([" ", "\n# "]).join(told), "Thus ended the day."]
        text = "\n".join(parts)
        assert [f.license for f in SCANNER.scan(text)[1]] == brute(text), text


def test_blocks_hold_every_place_near_a_cue():
    for n in (1, 30, 300, 2000):
        have = [f"w{i}" if i % 50 else "license" for i in range(n)]
        held = ls.blocks(" ".join(have))
        for i in range(0, max(n - ls.REACH, 1), 7):
            assert any(at <= i and i + ls.REACH <= at + len(part) or n < ls.REACH for at, part in held)
        assert all(have[at : at + len(part)] == part for at, part in held)
