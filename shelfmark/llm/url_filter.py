"""URL filtering: host and path rules, then logistic regression on hashed character n-grams.

The classifier is trained on the driver from a small labelled URL table (below, or the
caller's); its weights, a fixed 2^16 numbers, travel with the task.  A batch's n-grams are
hashed and summed at once.  Rules are found by looking up each suffix of the host, so their
number does not matter.

Defined cases: a null url or one without ``://`` has an empty host and path and gets the
method's verdict on nothing, which is allow; ties between rules of equal length go to the
first in the list; a url of any length is read whole; repeated rows get equal verdicts;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SparseRows, fit_logistic, in_small_batches, sigmoid

BUCKETS = 1 << 16
ORDERS = (3, 4, 5)
STEPS = 200
PATH_WEIGHT = 0.25
#: Share of urls to block that the classifier is trained for.
BLOCKED_SHARE = 0.4
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: What hosts to block are about: gambling, medicine, adult, link and tracking farms, fraud.
BLOCKED_WORDS = (
    "casino slots jackpot poker bets betting lotto roulette bingo pills viagra cialis pharmacy weightloss replica loans payday adult dating xxx porn sex webcam escort nude singles "
    "linkfarm spam backlinks clicks popup ads adserver tracker tracking redirect banner freemoney cash winner prize giveaway crypto forex phish warez crack keygen torrent"
).split()
#: What other hosts are about, and syllables that names without any meaning are made of.
ALLOWED_WORDS = (
    "library museum history archive books review poetry maps atlas recipes food garden roses birds mountain sailing cycling travel railway weather physics math chemistry astronomy geology medicine hospital clinic school "
    "university college research science news herald post times radio film theatre orchestra music art gallery photography council parliament law courts data statistics census energy water forestry fisheries farmers woodwork "
    "ceramics textiles architecture housing kitchen bakery coffee tea brewery software docs wiki manuals forum community charity parish genealogy castle harbour lighthouse ferry airport trains bridges rivers lakes"
).split()
#: What both are combined with.
COMPANIONS = "online best my free world city shop club king royal easy quick daily top one net blog 24 home star".split()
SYLLABLES = "ar ath ble cor dan en er eth fal gor ha hin ing is ka la len lor ly man mer mon nd nor on or ost per ra ren rin ros sel sh son sta ter tha the ti tion tor und ver vin wen wh zor".split()
HOST_ENDS = ("example.com", "example.org", "example.net", "com", "org", "net", "info", "example.com")
HOST_STARTS = ("", "www.", "m.", "blog.", "news.")
PATHS = ("/", "/en/{0}", "/de/{0}.html", "/fr/{0}?page=2", "/es/{0}/", "/articles/{0}", "/page/{0}#top", "/2021/05/{0}", "/index.php?id={0}", "")


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """The labelled table: 1 marks urls to block, 0 others.  Ends and paths are dealt by a hash of the name, so only names tell."""
    made = ["".join(SYLLABLES[(7 * i + 11 * k + i * k * k) % len(SYLLABLES)] for k in range(2 + i % 3)) for i in range(120)]

    def names(words: list[str], each: int) -> list[str]:
        """Every word with a few companions, before or after it, with a hyphen or without."""
        out = []
        for i, word in enumerate(words):
            for k in range(each):
                other = COMPANIONS[(5 * i + 3 * k) % len(COMPANIONS)]
                out.append(("-" if (i + k) % 2 else "").join((other, word) if zlib.crc32(word.encode()) + k & 1 else (word, other)))
        return out

    out = []
    for label, hosts in ((1, names(BLOCKED_WORDS, 6)), (0, names(ALLOWED_WORDS, 4) + made)):
        for i, name in enumerate(hosts):
            h = zlib.crc32(name.encode())
            host = f"{HOST_STARTS[h % 5]}{name}.{HOST_ENDS[h // 5 % 8]}"
            out.append((f"http{'s' * (h // 400 % 2)}://{host}{PATHS[h // 40 % 10].format(i * 37 % 1000)}", label))
    return tuple(out)


LABELLED = labelled_urls()


@dataclass
class UrlModel:
    weights: np.ndarray
    intercept: float
    threshold: float = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``; then up to ``? #``; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        return rest.translate(UPPER), ""
    path = rest[i:]
    for stop in "?#":
        path = path.partition(stop)[0]
    return rest[:i].translate(UPPER), path


def rule_table(rules) -> dict[str, list[tuple[int, str, str, str]]]:
    """host -> [(order, path, rule, verdict)], the longest rule first."""
    out: dict[str, list[tuple[int, str, str, str]]] = {}
    for i, (verdict, rule) in enumerate(rules):
        host, slash, path = rule.partition("/")
        out.setdefault(host.translate(UPPER), []).append((i, slash + path, rule, verdict))
    for found in out.values():
        found.sort(key=lambda r: (-len(r[2]), r[0]))
    return out


def match_rule(table: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it."""
    best = None
    at = 0
    while host:
        for order, prefix, rule, verdict in table.get(host[at:], ()):
            if path.startswith(prefix):
                if best is None or (-len(rule), order) < best[0]:
                    best = ((-len(rule), order), rule, verdict)
                break
        at = host.find(".", at) + 1
        if at == 0:
            break
    return (best[1], best[2]) if best else (None, None)


def _grams(texts: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, buckets) of every n-gram of every text, each hashed with its length and ``salt``."""
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rows, buckets = [], []
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = np.full(m, (salt * 31 + n) * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = owner[:m] == owner[n - 1 :]
        rows.append(owner[:m][inside])
        buckets.append((h[inside] % np.uint32(BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, buckets, values): n-grams of each ``^host$`` and path, each kind scaled to unit length, a path's weighing less."""
    out = []
    for salt, weight, texts in ((1, 1.0, [f"^{h}$" for h in hosts]), (2, PATH_WEIGHT, [f"{p}$" for p in paths])):
        row, bucket = _grams([t.encode("utf-8", "replace") for t in texts], salt)
        key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, bucket = key // BUCKETS, key % BUCKETS
        length = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(texts)))
        out.append((row, bucket, weight * n / length[row]))
    row, bucket, value = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, bucket, value


def fit(labelled=LABELLED, ridge: float = 1e-5) -> UrlModel:
    """Trains on (url, blocked) pairs; the table is small and lives on the driver."""
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    row, bucket, value = features(list(hosts), list(paths))
    y = np.array([b for _, b in labelled], float)
    own = [np.flatnonzero(row == i) for i in range(len(y))]
    weight = np.where(y == 1, BLOCKED_SHARE / max(y.sum(), 1), (1 - BLOCKED_SHARE) / max((1 - y).sum(), 1))
    w, b = fit_logistic(SparseRows([bucket[i] for i in own], [value[i] for i in own], BUCKETS), y, weight, ridge, STEPS)
    return UrlModel(w.astype(np.float32), b)


def probabilities(model: UrlModel, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability that each url is to be blocked; nothing to judge gives 0."""
    row, bucket, value = features(hosts, paths)
    p = sigmoid(np.bincount(row, model.weights[bucket] * value, len(hosts)) + model.intercept)
    return np.where([bool(h) for h in hosts], p, 0.0)


def probability(model: UrlModel, host: str, path: str) -> float:
    return float(probabilities(model, [host], [path])[0])


def judge(pages: DataFrame, model: UrlModel | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every row; a rule overrides the model."""
    model, table = model or fit(), rule_table(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            p = probabilities(model, [h for h, _ in parts], [x for _, x in parts]).tolist()
            out = []
            for (host, path), q in zip(parts, p, strict=True):
                rule, verdict = match_rule(table, host, path)
                out.append((host, path, rule, verdict or ("block" if q >= model.threshold else "allow"), q))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 4 + [pa.float64()], strict=True)]], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    return in_small_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), run, "page_id long, host string, path string, rule string, verdict string, p_block double")
