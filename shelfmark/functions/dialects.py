"""Search texts in each provider's query dialect: Lucene-like, CQL, SPARQL, plain words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_cql, escape_sparql, fold_spanish

# Letters that the SPARQL search folds on both sides.
SPANISH = [("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ü", "u"), ("ñ", "n")]


def said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def fill(template: str, *values: Column) -> Column:
    """The template with its ``{}`` marks replaced in order."""
    parts = template.split("{}")
    return F.concat(*[x for p, v in zip(parts, [*values, F.lit("")], strict=True) for x in (F.lit(p), v)])


def unquoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(" "))


def _two(title: str, both: str, clean):
    return lambda t, c: F.when(said(c), fill(both, clean(t), clean(c))).otherwise(fill(title, clean(t)))


def folded_sparql(variable: str) -> str:
    out = f"LCASE({variable})"
    for a, b in SPANISH:
        out = f"REPLACE({out}, '{a}', '{b}')"
    return out


#: provider -> (title, creator) -> query text
DIALECTS = {
    "internet_archive": _two('title:("{}") AND mediatype:(texts)', 'title:("{}") AND creator:("{}") AND mediatype:(texts)', unquoted),
    "bnf_gallica": _two('gallica all "{}"', 'gallica all "{}" and dc.creator all "{}"', escape_cql),
    "europeana": _two('title:"{}"', 'title:"{}" AND who:"{}"', unquoted),
    "ddb": _two('"{}"', '"{}" AND creator:"{}"', unquoted),
    "british_library": _two('title all "{}"', 'title all "{}" and creator all "{}"', escape_cql),
    "e_rara": _two('"{}"', '"{}" and "{}"', escape_cql),
    "mdz": _two("{}", "{} {}", lambda x: x),
    "polona": _two("{}", "{} {}", lambda x: x),
    "bne": lambda t, c: fill(f"FILTER(CONTAINS({folded_sparql('?title')}, '{{}}'))", escape_sparql(fold_spanish(t))),
}


def search_text(provider: Column, title: Column, creator: Column) -> Column:
    """The query text of each row's provider; null for providers that take parameters instead."""
    out = None
    for name, build in DIALECTS.items():
        value = build(title, creator)
        out = F.when(provider == name, value) if out is None else out.when(provider == name, value)
    return out


def relaxed(title: Column, creator: Column) -> Column:
    """Queries from strict to loose for catalogues that are asked until one answers."""
    t, c = escape_cql(title), escape_cql(creator)
    strict = F.array(fill('pica.tit="{}" AND pica.aut="{}"', t, c), fill('dc.title="{}" AND dc.creator="{}"', t, c))
    loose = F.array(fill('pica.tit="{}"', t), fill('dc.title="{}"', t), fill('"{}"', t))
    return F.when(said(creator), F.concat(strict, loose)).otherwise(loose)


def with_key(url: Column, key: str | None, host: str = "https://iiif.europeana.eu") -> Column:
    """The URL with the key appended, on the key's own host only and once."""
    if not key:
        return url
    mark = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    mine = F.startswith(url, F.lit(host)) & ~F.contains(url, F.lit("wskey="))
    return F.when(mine, F.concat(url, mark, F.lit(f"wskey={key}"))).otherwise(url)
