"""Text folding, matching keys, slugs and file names as native column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters without a decomposition, and what stands for them.
LETTERS = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}
# Device names that no file may have.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
#: Blocks that hold characters with a decomposition; Hangul syllables, which follow a rule, lie outside.
COVERED = ((0x80, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10000, 0x12000), (0x16A00, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20))
# The Hangul letters that syllables are made of, by the standard's rule.
HANGUL_FIRST, HANGUL_LEADS, HANGUL_VOWELS, HANGUL_TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
#: All blanks and line ends of Unicode, as a text's ends may hold them.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def strip(text: Column) -> Column:
    """The text without blanks and line ends at its ends."""
    return F.trim(text, F.lit(BLANKS))


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters of ``COVERED`` whose decomposition is one letter plus marks, those letters, and the longer ones.

    Combining marks end the first string without a partner, so ``translate`` drops them.
    """
    source, target, marks, longer = [], [], [], {}
    for c in map(chr, (x for a, b in COVERED for x in range(a, b))):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c:
            if len(base) == 1:
                source.append(c)
                target.append(base)
            else:
                longer[c] = base
    return "".join(source + marks), "".join(target), longer


def _hangul(c: Column) -> Column:
    """A Hangul syllable as its letters, any other character as it is."""
    leads, vowels, tails = ("".join(map(chr, range(first, first + n))) for first, n in ((HANGUL_LEADS, 19), (HANGUL_VOWELS, 21), (HANGUL_TAILS + 1, 27)))
    at = F.ascii(c) - HANGUL_FIRST
    letters = F.concat(F.substr(F.lit(leads), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substr(F.lit(vowels), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)))
    tail = F.when(at % 28 > 0, F.substr(F.lit(tails), (at % 28).cast("int"), F.lit(1))).otherwise("")
    return F.when(c.between(chr(HANGUL_FIRST), chr(HANGUL_FIRST + 11171)), F.concat(letters, tail)).otherwise(c)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without its combining marks, over all of Unicode; null gives the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    source, target, longer = _folding()
    simple = F.translate(text, source, target)
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], _hangul(c)))
    # a class of two ranges settles most texts before the long class is tried
    near = "".join(f"\\x{{{ord(c):x}}}" for c in longer if ord(c) < 0x250)
    rare = text.rlike(f"[{near}\\x{{250}}-\\x{{10ffff}}]") & text.rlike("[\\x{ac00}-\\x{d7a3}" + "".join(f"\\x{{{ord(c):x}}}" for c in longer) + "]")
    return (
        F.when(F.octet_length(text) == F.length(text), text)
        .when(rare, F.translate(F.array_join(each, ""), source, target))
        .otherwise(simple)
    )


def transliterate(text: Column) -> Column:
    """Replaces the letters of ``LETTERS`` (lower case only)."""
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for letter, pair in LETTERS.items():
        if len(pair) > 1:
            out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def folded(text: Column) -> Column:
    return transliterate(F.lower(strip_accents(text)))


def normalize_text(text: Column) -> Column:
    """The matching key of a text: folded words of ASCII letters and digits, one blank between.

    A text with letters that ASCII cannot hold keeps all its letters, digits and marks instead.
    """

    def keyed(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(s, "[^0-9a-z]+", " "))
        wide = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]|_", " "), r"(?U)\s+", " "))
        foreign = (F.octet_length(s) != F.length(s)) & s.rlike(r"[\p{L}&&[^\x00-\x7F]]")
        return F.when((plain != "") & ~foreign, plain).otherwise(wide)

    # plain ASCII needs no folding, and no other letters are in it; elsewhere the folded text is computed once
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))).otherwise(let(folded(text), keyed))


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that later filters and projections read but never compute again.

    A projection would be merged into theirs, and a costly expression with it; the generator is not.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def tokens(normalized: Column) -> Column:
    """The sorted distinct words of a normalised text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != "")))


def snake_case(text: Column) -> Column:
    """Lower-case ASCII words and numbers joined by underscores."""
    s = F.regexp_replace(folded(text), "[^0-9A-Za-z]+", "_")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1_$2")
    s = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(s, "_+", "_"), F.lit("_")))


def guard_reserved(name: Column) -> Column:
    return F.when(F.lower(name).isin(RESERVED), F.concat(F.lit("_"), name, F.lit("_"))).otherwise(name)


def sanitize_filename(name: Column, longest: int = 100) -> Column:
    """A safe file name; up to two short suffixes survive, only the part before them is cut."""
    last = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    stem = F.regexp_extract(last, r"^(?s)(.*?)((?:\.[A-Za-z0-9]{1,8}){0,2})$", 1)
    suffix = F.when(stem == "", "").otherwise(F.regexp_extract(last, r"^(?s)(.*?)((?:\.[A-Za-z0-9]{1,8}){0,2})$", 2))
    stem = F.when(stem == "", last).otherwise(stem)
    base = F.regexp_replace(F.regexp_replace(stem, ILLEGAL, ""), r"[\s._-]+", "_")
    base = F.trim(base, F.lit("._-"))
    base = guard_reserved(F.left(F.when(base == "", "_untitled_").otherwise(base), F.lit(longest)))
    out = F.rtrim(F.concat(base, F.regexp_replace(suffix, ILLEGAL, "")), F.lit(". "))
    return F.when(F.coalesce(name, F.lit("")) == "", "_untitled_").when(out == "", "_untitled_").otherwise(out)


def work_id(title: Column, creator: Column) -> Column:
    """Ten hex digits that stand for a work's normalised title and creator."""
    return F.left(F.sha1(F.concat(normalize_text(title), F.lit("|"), normalize_text(F.coalesce(creator, F.lit(""))))), F.lit(10))


def work_directory(entry_id: Column, title: Column, creator: Column | None = None, year: Column | None = None, longest: int = 80) -> Column:
    """``<entry>_<title>[_<creator>][_<year>]`` in snake case.

    A title without any Latin letter or digit is stood for by a digest of its text.
    """
    empty = F.lit(None).cast("string")
    slug = F.left(snake_case(title), F.lit(longest))
    named = F.when(F.coalesce(title, F.lit("")) == "", "untitled").when(slug == "", F.concat(F.lit("t_"), F.left(F.sha1(title), F.lit(8)))).otherwise(slug)
    parts = [F.nullif(snake_case(entry_id), F.lit("")), named]
    parts.append(F.nullif(F.left(snake_case(creator), F.lit(longest)), F.lit("")) if creator is not None else empty)
    parts.append(F.nullif(snake_case(year.cast("string")), F.lit("")) if year is not None else empty)
    return guard_reserved(F.concat_ws("_", *parts))


def split_creators(text: Column) -> Column:
    """Creators of a ``;``-separated text, never split at commas; null gives an empty list."""
    parts = F.transform(F.split(text, ";"), strip)
    return F.coalesce(F.filter(parts, lambda c: c != ""), F.array().cast("array<string>"))


def distinct_by_normal_form(values: Column) -> Column:
    """The first raw value of each normalised form, in order; empty forms go."""
    both = F.struct(values.alias("v"), F.transform(values, normalize_text).alias("k"))

    def firsts(x: Column) -> Column:
        keys = F.filter(F.array_distinct(x["k"]), lambda k: k != "")
        return F.transform(keys, lambda k: F.element_at(x["v"], F.array_position(x["k"], k).cast("int")))

    return let(both, firsts)


def split_creator_cell(text: Column) -> Column:
    """Creators of a listing cell, split at ``, ; / |`` and deduplicated by normal form."""
    parts = F.filter(F.transform(F.split(text, "[,;/|]+"), strip), lambda c: c != "")
    return distinct_by_normal_form(F.coalesce(parts, F.array().cast("array<string>")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def clean_title(text: Column) -> Column:
    """A scraped title: cut before a second year, without a repeated closing parenthesis, at most 100 characters."""
    year = r"\b(?:19|20)\d{2}\b"

    def first_year_only(s: Column) -> Column:
        head = F.regexp_extract(s, rf"(?U)^(.*?{year}.*?){year}", 1)
        return F.when(F.length(head) > 20, F.trim(head)).otherwise(s)

    def without_last_parenthesis(s: Column) -> Column:
        at = F.length(s) - F.length(F.substring_index(s, "(", -1)) - 1
        head = F.trim(F.left(s, at))
        several = F.length(s) - F.length(F.replace(s, F.lit("("), F.lit(""))) > 1
        return F.when(several & F.endswith(s, F.lit(")")) & (at > 20) & (F.length(head) > 15), head).otherwise(s)

    def short(s: Column) -> Column:
        head = F.trim(F.left(s, F.lit(100)))
        at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        return F.when(F.length(s) <= 100, s).when(at > 40, F.trim(F.left(head, at))).otherwise(head)

    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    s = let(let(s, first_year_only), without_last_parenthesis)
    return let(F.rtrim(s, F.lit(" -:;|/")), short)


# Link texts that are no titles.
NO_TITLES = ["download", "download options", "download mirror"]


def title_candidates(texts: Column) -> Column:
    """Cleaned titles among scraped texts, one for each normal form, in order; digests and link texts go."""
    spaced = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " ")))
    both = F.struct(spaced.alias("v"), F.transform(spaced, normalize_text).alias("k"))

    def chosen(x: Column) -> Column:
        keys = F.filter(F.array_distinct(x["k"]), lambda k: (F.length(k) >= 3) & ~k.rlike("^[0-9a-f]{32}$") & ~k.isin(NO_TITLES))
        return F.transform(keys, lambda k: F.element_at(x["v"], F.array_position(x["k"], k).cast("int")))

    return F.filter(F.transform(let(both, chosen), clean_title), lambda t: t != "")


def split_list(text: Column) -> Column:
    """Items of a comma-separated text, trimmed, without repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), strip), lambda c: c != ""))


def escape_cql(text: Column) -> Column:
    """A text inside a double-quoted CQL literal."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(out, r"[\r\n\t]+", " ")


def escape_sparql(text: Column) -> Column:
    """A text inside a quoted SPARQL literal, with either quote."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))
    return F.translate(out, "\r\n\t", "   ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def fold_spanish(text: Column) -> Column:
    return F.translate(F.lower(text), "áéíóúüñ", "aeiouun")


# Short names of providers in file names, and their display abbreviations.
PROVIDER_SLUGS = {
    "bnf_gallica": "gallica", "british_library": "bl", "mdz": "mdz", "europeana": "europeana", "wellcome": "wellcome", "loc": "loc", "ddb": "ddb", "polona": "polona", "bne": "bne", "dpla": "dpla",
    "internet_archive": "ia", "google_books": "gb", "hathitrust": "hathi", "annas_archive": "annas", "slub": "slub", "e_rara": "erara", "sbb_digital": "sbb",
}
PROVIDER_ABBREVIATIONS = {
    "gallica": "GAL", "british_library": "BL", "mdz": "MDZ", "europeana": "EUROPEANA", "wellcome": "WELLCOME", "loc": "LOC", "ddb": "DDB", "polona": "POLONA", "bne": "BNE", "dpla": "DPLA",
    "internet_archive": "IA", "google_books": "GB", "bnf_gallica": "GAL", "hathitrust": "HATHI", "annas_archive": "ANNAS", "slub": "SLUB", "e_rara": "ERARA", "sbb_digital": "SBB",
}


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def provider_slug(preferred: Column, by_url: Column) -> Column:
    """The short name of a provider in file names; one without a name of its own is its key in snake case."""
    key = F.coalesce(F.nullif(preferred, F.lit("")), F.nullif(by_url, F.lit("")), F.lit("unknown"))
    return F.coalesce(_named(key, PROVIDER_SLUGS), snake_case(key))


def provider_abbreviation(key: Column) -> Column:
    return F.coalesce(_named(key, PROVIDER_ABBREVIATIONS), F.upper(key))
