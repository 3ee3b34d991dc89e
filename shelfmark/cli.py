"""Command line: search captured responses, work through a works table, report on ledgers.

    python -m shelfmark.cli search WORKS.csv HITS.parquet [--json]
    python -m shelfmark.cli search --title TITLE [--creator NAME] HITS.parquet
    python -m shelfmark.cli pending WORKS.csv [--mode all|new|failed] [--entry-ids A,B] [--limit N]
    python -m shelfmark.cli batch WORKS.csv HITS.parquet --fetch MODULE:FUNCTION --out FOLDER [--dry-run] [--json]
    python -m shelfmark.cli verify FOLDER [--index INDEX.csv] [--json]
    python -m shelfmark.cli iiif MANIFESTS.parquet [--url URL...] [--name NAME...]
    python -m shelfmark.cli status WORKS.csv
    python -m shelfmark.cli quota STATE.json [--cleanup]
    python -m shelfmark.cli identify IDENTIFIER... [--provider KEY]
    python -m shelfmark.cli providers

``batch`` selects a record for each pending work among captured hits and hands the tasks to
FUNCTION, which gets a task as a dict and returns success, failed or deferred; a dry run only
says what would be done.  ``iiif`` shows what captured manifests (url, body) would bring.

Exit codes: 0 all done or all matched, 1 some not, 2 wrong usage, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .config import Selection, load_config, min_title_score, split_names
from .functions import ids
from .functions.dates import extract_year
from .functions.text import normalize_text, strip, with_once
from .operators import ledger as lg
from .operators.select import provider_ranks, stated
from .session import session
from .sources.works import backup, line_end, query_frame, read_index, read_works, write_csv, year_column

OK, SOME, USAGE, INTERRUPTED = 0, 1, 2, 130


def whole(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfmark")
    top.add_argument("--config")
    top.add_argument("--providers")
    top.add_argument("--enable-provider")
    top.add_argument("--disable-provider")
    sub = top.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("search")
    s.add_argument("works", nargs="?")
    s.add_argument("hits")
    s.add_argument("--title")
    s.add_argument("--creator")
    s.add_argument("--json", action="store_true")
    b = sub.add_parser("batch")
    b.add_argument("works")
    b.add_argument("hits")
    b.add_argument("--fetch")
    b.add_argument("--out")
    b.add_argument("--dry-run", action="store_true")
    b.add_argument("--json", action="store_true")
    b.add_argument("--mode", choices=["all", "new", "failed"], default="all")
    v = sub.add_parser("verify")
    v.add_argument("folder")
    v.add_argument("--index")
    v.add_argument("--json", action="store_true")
    d = sub.add_parser("iiif")
    d.add_argument("manifests")
    d.add_argument("--url", action="append", default=[])
    d.add_argument("--name", action="append", default=[])
    q = sub.add_parser("quota")
    q.add_argument("state")
    q.add_argument("--cleanup", action="store_true")
    for verb in (sub.add_parser("pending"), s, b):
        if verb not in (s, b):
            verb.add_argument("works")
            verb.add_argument("--mode", choices=["all", "new", "failed"], default="all")
        verb.add_argument("--entry-ids")
        verb.add_argument("--limit", type=whole)
    sub.add_parser("status").add_argument("works")
    i = sub.add_parser("identify")
    i.add_argument("identifiers", nargs="+")
    i.add_argument("--provider")
    sub.add_parser("providers")
    return top


def chosen(spark, works, args):
    """The wanted rows: entry ids, then the limit in file order."""
    if args.entry_ids:
        wanted = spark.createDataFrame([(x.strip(),) for x in args.entry_ids.split(",") if x.strip()], "entry_id string")
        works = lg.only_entries(works, wanted)
    return lg.first_rows(works, args.limit) if args.limit is not None else works


def found_for(spark, works, args, config):
    """The search result of works with a title, over the captured hits of the providers asked for."""
    from .plans.matching import search as run

    works = with_once(works.filter(~lg.blank(F.col("short_title"))), "norm", normalize_text(F.col("short_title")))
    hits = spark.read.parquet(args.hits)
    only, asked, dropped = (split_names(x) for x in (args.providers, args.enable_provider, args.disable_provider))
    named = only + asked + dropped
    there = {r.provider_key for r in hits.filter(F.col("provider_key").isin(named)).select("provider_key").distinct().collect()} if named else set()
    for name in named:
        if name not in there:
            print(f"unknown provider: {name}", file=sys.stderr)
    if only:
        hits = hits.filter(F.col("provider_key").isin(only + asked))
    if dropped:
        hits = hits.filter(~F.col("provider_key").isin(dropped))
    settings = Selection.of(config)
    settings.min_title_score = min_title_score(config, None, settings.min_title_score)
    listed = provider_ranks(hits.select("provider_key"), settings.provider_hierarchy, "provider_key")
    return run(spark, works, hits, settings, listed)


def with_year(works):
    return works.withColumn("query_year", extract_year(year_column(works)))


def search(spark, args, config) -> int:
    if args.title:
        works = query_frame(spark, args.title, args.creator).withColumn("query_year", F.lit(None).cast("int"))
    else:
        works = chosen(spark, with_year(read_works(spark, args.works)), args)
    found = found_for(spark, works, args, config).cache()
    if args.json:
        for line in found.toJSON().toLocalIterator():
            print(line)
    else:
        for r in found.toLocalIterator():
            print(*(x for x in (r.entry_id, r.status, r.selected_provider, r.selected_source_id) if x is not None), sep="\t")
            # a reader sees the ten best by title; the others are counted
            shown = sorted(r.candidates or [], key=lambda c: (-c.title_score, c.provider_ix, c.hit_ix))
            for c in shown[:10]:
                print("", c.title_score, c.provider_key, c.title, sep="\t")
            if len(shown) > 10:
                print(f"\t... and {len(shown) - 10} more")
    missed = found.filter(~stated(F.col("selected_provider"))).count()
    return SOME if missed else OK


def batch(spark, args, config) -> int:
    from .operators import batch as bt

    works = with_year(read_works(spark, args.works))
    wanted = spark.createDataFrame([(x,) for x in split_names(args.entry_ids)], "entry_id string") if args.entry_ids else None
    rows = bt.pending_rows(works, args.mode, wanted, args.limit)
    hits = spark.read.parquet(args.hits).select("entry_id", F.col("provider_key").alias("_p"), F.col("source_id").alias("_s"), F.col("item_url").alias("_u"))
    best = found_for(spark, rows, args, config).select("entry_id", F.col("selected_provider").alias("provider_key"), F.col("selected_source_id").alias("source_id"))
    same = (best.entry_id == hits.entry_id) & (F.col("provider_key") == F.col("_p")) & F.col("source_id").eqNullSafe(F.col("_s"))
    selected = best.join(hits, same, "left").groupBy(best.entry_id, "provider_key", "source_id").agg(F.min("_u").alias("item_url"))
    module, _, name = (args.fetch or "").partition(":")
    fetch = getattr(importlib.import_module(module), name) if module else None
    done = bt.run(works.drop("query_year"), selected, fetch, F.current_timestamp(), None, args.dry_run, args.mode, wanted, args.limit)
    if not args.dry_run:
        backup(spark, args.works, time.strftime("%Y%m%d_%H%M%S"))
        write_csv(done.works, args.out, line_end(spark, args.works))
    line = done.summary.first().summary
    if args.json:
        print(line)
    else:
        for r in done.outcomes.orderBy("entry_id").toLocalIterator():
            print(*(x for x in (r.entry_id, r.outcome, r.provider, r.url) if x is not None), sep="\t")
    return SOME if json.loads(line)["failed"] else OK


def verify(spark, args) -> int:
    from .operators.verify import verdict_totals
    from .operators.verify import verify as run

    checked, _ = run(spark, args.folder, read_index(spark, args.index) if args.index else None)
    checked = checked.cache()
    totals = verdict_totals(checked).first().asDict()
    if args.json:
        print(json.dumps({"command": "verify"} | totals))
    else:
        for r in checked.filter(~F.col("ok")).orderBy("path").toLocalIterator():
            print(r.path, r.reason, sep="\t")
        print(*(f"{k}: {n}" for k, n in totals.items()), sep="\n")
    return SOME if totals["partial"] else OK


def direct_names(urls: list[str], names: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(entry id, title, file stem) of each manifest: one name each, one shared name with a counter, or none."""
    if len(names) > 1 and len(names) != len(urls):
        raise ValueError(f"{len(names)} names for {len(urls)} manifests: give one shared name, one each, or none")
    out = []
    for i, _ in enumerate(urls, 1):
        stem = names[i - 1] if len(names) == len(urls) else names[0] if names else None
        if stem and (len(urls) == 1 or len(names) == len(urls)):
            out.append((f"IIIF_{stem}", stem, stem))
        else:
            out.append((f"IIIF_{i:04d}", stem, f"{stem}_{i:04d}" if stem else None))
    return out


def direct(spark, args) -> int:
    from .operators.transfers import preview

    rows = spark.read.parquet(args.manifests).select("url", "body")
    urls = args.url or [r.url for r in rows.select("url").orderBy("url").toLocalIterator()]
    named = direct_names(urls, args.name)
    order = spark.createDataFrame([(i, u, *n) for i, (u, n) in enumerate(zip(urls, named, strict=True))], "_i int, url string, entry_id string, title string, file_stem string")
    shown = order.join(preview(rows, "url", "body"), "url", "left").orderBy("_i")
    good = 0
    for r in shown.toLocalIterator():
        good += bool(r.page_count)
        print(json.dumps({k: v for k, v in r.asDict().items() if k != "_i"}, ensure_ascii=False))
    return OK if good == len(urls) else SOME


def quota(spark, args) -> int:
    from .operators import queue as dq
    from .sources import state as ss

    how, quotas, items = ss.load_state(spark, args.state)
    if how in ("corrupt", "fresh"):
        print(f"state: {how}", file=sys.stderr)
    now = F.current_timestamp()
    if args.cleanup:
        left = items.filter(F.col("status") != "completed")
        before, after = items.count(), left.count()
        ss.write_state(spark, args.state, quotas, left, "ord", now)
        print(f"removed: {before - after}", f"left: {after}", sep="\n")
        return OK
    for r in dq.quota_view(quotas, now).orderBy("provider_key").toLocalIterator():
        spent = f"resets in {r.seconds_left / 3600:.1f} h" if r.exhausted else f"{max(0, r.daily_limit - (0 if r.expired else r.downloads_used))} left"
        print(r.provider_key, f"{0 if r.expired else r.downloads_used}/{r.daily_limit}", spent, sep="\t")
    for r in dq.counts(items).orderBy("status").toLocalIterator():
        print(r.status, r.n, f"retries {r.retries}", sep="\t")
    waiting = items.filter(F.col("status").isin(dq.ACTIVE)).count()
    for r in dq.first_waiting(items, "ord").collect():
        print("", r.title[:50], r.provider_name, sep="\t")
    if waiting > 10:
        print(f"\t... and {waiting - 10} more")
    return OK


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    if args.verb == "providers":
        print(*sorted(ids.PROVIDER_HOSTS), sep="\n")
        return OK
    if args.verb == "batch" and not args.dry_run and not (args.fetch and args.out):
        print("batch needs --fetch and --out, or --dry-run", file=sys.stderr)
        return USAGE
    if args.verb == "search" and not (args.title or args.works):
        print("search needs a works table or --title", file=sys.stderr)
        return USAGE
    try:
        config = load_config(args.config) if args.config else {}
        spark = session()
        if args.verb in ("search", "batch"):
            return {"search": search, "batch": batch}[args.verb](spark, args, config)
        if args.verb in ("verify", "iiif", "quota"):
            return {"verify": verify, "iiif": direct, "quota": quota}[args.verb](spark, args)
        if args.verb == "identify":
            rows = spark.createDataFrame([(x,) for x in args.identifiers], "identifier string").select(strip(F.col("identifier")).alias("identifier"))
            providers = F.array(F.lit(args.provider)) if args.provider else ids.providers_of_identifier(F.col("identifier"))
            found = ids.with_manifest_urls(rows.select("identifier", F.explode(providers).alias("provider")), "identifier", "provider").orderBy("identifier", "provider", "manifest_ord").collect()
            for r in found:
                print(r.identifier, r.provider, r.manifest_url, sep="\t")
            return OK if {r.identifier for r in found} >= {x.strip() for x in args.identifiers} else SOME
        works = read_works(spark, args.works)
        if args.verb == "status":
            print(*(f"{k}: {v}" for k, v in lg.status_counts(works).first().asDict().items()), sep="\n")
            return OK
        for r in chosen(spark, lg.pending(works, args.mode), args).select("entry_id", "short_title").toLocalIterator():
            print(r.entry_id, r.short_title or "", sep="\t")
        return OK
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print("no such file", file=sys.stderr)
        return USAGE
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
