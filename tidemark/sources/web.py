"""Reading from web services: retries, pacing, validation, a cache, and pages of a listing.

A request goes through ``transport(url, timeout) -> bytes``, so a test needs no network. On a cluster
``fetch_table`` deals the requests by their pacing key, so that one task paces one key.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Transport = Callable[[str, float], bytes]


def over_http(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "tidemark"}), timeout=timeout) as response:
        return response.read()


@dataclass
class Fetcher:
    """Bytes of a URL. A response that ``valid`` rejects counts as failed; waits double from ``wait`` on;
    requests of one key start ``interval`` seconds apart at least. ``cache`` holds what was fetched, and
    what it holds is neither paced nor fetched again."""

    transport: Transport = over_http
    valid: Callable[[bytes], bool] | None = None
    tries: int = 5
    wait: float = 8.0
    interval: float = 0.0
    timeout: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: dict[str, float] = field(default_factory=dict)

    def get(self, url: str, key: str = "", cache: str | None = None, force: bool = False) -> bytes:
        if cache is not None and not force and os.path.exists(cache):
            with open(cache, "rb") as f:
                return f.read()
        problem: Exception | None = None
        for attempt in range(self.tries):
            if attempt:
                self.sleep(self.wait * 2 ** (attempt - 1))
            due = self._last.get(key, -self.interval) + self.interval - self.clock() if self.interval else 0.0
            if due > 0:
                self.sleep(due)
            self._last[key] = self.clock()
            try:
                data = self.transport(url, self.timeout)
            except OSError as e:
                problem = e
                continue
            if self.valid is None or self.valid(data):
                if cache is not None:
                    os.makedirs(os.path.dirname(cache) or ".", exist_ok=True)
                    with open(cache, "wb") as f:
                        f.write(data)
                return data
            problem = ValueError(f"response of {len(data)} bytes was rejected")
        raise RuntimeError(f"{url}: no answer in {self.tries} tries") from problem


def encoded_query(query: dict) -> str:
    """A query as the path segment that listings of this kind take: JSON in base 64."""
    return base64.b64encode(json.dumps(query).encode()).decode()


def pages(fetch: Callable[[str], bytes], base: str, query: dict, rows: str = "results", number: str = "pageNumber", total: tuple[str, str] = ("page", "totalPages")) -> Iterator[dict]:
    """Rows of all pages of a listing, from page 1 to the number of pages that it names."""
    page = last = 1
    while page <= last:
        answer = json.loads(fetch(f"{base}/{encoded_query(query | {number: page})}"))
        yield from answer.get(rows) or ()
        last = int((answer.get(total[0]) or {}).get(total[1], page))
        page += 1


def fetch_table(requests: DataFrame, url: str, key: str, make: Callable[[], Fetcher]) -> DataFrame:
    """``(url, key, content, error)`` of every request; requests of one key run one after another in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fetcher = make()
        rows = []
        for u, k in zip(pdf[url], pdf[key]):
            try:
                rows.append((u, k, fetcher.get(u, str(k)), None))
            except RuntimeError as e:
                rows.append((u, k, None, str(e)))
        return pd.DataFrame(rows, columns=["url", "key", "content", "error"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandas(run, f"url string, key {kind}, content binary, error string")
