"""An optional live source: responses of a list of URLs as rows.

    spark.dataSource.register(HttpSource)
    spark.read.format("shelfmark_http").option("urls", "https://… https://…").load()

Each partition is one URL.  Transport errors become rows without a status, so a failing
server never fails the job; breaker decisions are made over the rows.  ``attempts`` (1) tries
again what the server says is passing (429, 5xx) and broken transports, a connection that was
never made twice at most, after ``backoff`` seconds (1.5) that grow by half each time or after
what Retry-After says, ``maxWait`` seconds (60) at most.  A body beyond ``maxBytes`` is never
handed on in part: its row has an error and no body.  Nothing
in this package uses the source by itself; captured responses are the usual input.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Attempts after a connection that was never made.
CONNECT_ATTEMPTS = 2


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelfmark_http"

    def schema(self) -> str:
        return "url string, status int, content_type string, retry_after string, body binary, error string, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.timeout = float(options.get("timeout", "30"))
        self.most = int(options.get("maxBytes", str(64 << 20)))
        self.attempts = max(1, int(options.get("attempts", "1")))
        self.backoff, self.longest = float(options.get("backoff", "1.5")), float(options.get("maxWait", "60"))

    def partitions(self) -> list[UrlPartition]:
        return [UrlPartition(u) for u in self.urls]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        import time

        most, n = self.attempts, 0
        while True:
            n += 1
            row, again, wait = self._once(partition.url)
            if again == "connect":
                most = min(most, CONNECT_ATTEMPTS)
            if not again or n >= most:
                yield (*row, n)
                return
            time.sleep(min(self.longest, self.backoff * 1.5 ** (n - 1) if wait is None else wait))

    def _once(self, url: str) -> tuple[tuple, str | None, float | None]:
        """(row, why to try again, seconds that the server asks for)."""
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        def row(status, answer):
            # one byte more tells a body that is too long from one that just fits
            body = answer.read(self.most + 1)
            body, error = (body, None) if len(body) <= self.most else (None, f"the body is longer than {self.most} bytes")
            return url, status, answer.headers.get("Content-Type"), answer.headers.get("Retry-After"), body, error

        try:
            with urlopen(Request(url, headers={"User-Agent": "shelfmark"}), timeout=self.timeout) as r:  # noqa: S310
                return row(r.status, r), None, None
        except HTTPError as e:
            said = e.headers.get("Retry-After") or ""
            passing = e.code == 429 or 500 <= e.code <= 599
            return row(e.code, e), "status" if passing else None, float(said) if said.isdigit() else None
        except OSError as e:
            never = isinstance(e, URLError) and isinstance(e.reason, OSError)
            return (url, None, None, None, None, f"{type(e).__name__}: {e}"), "connect" if never else "transport", None
