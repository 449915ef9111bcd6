"""Live responses: one GET a URL, no redirects followed, no retries, a bounded pool a task.

Spark may run a task again after a failure; a caller that must not repeat a GET sets ``spark.task.maxFailures``
to 1, leaves speculation off and writes each level's responses before it reads them.
"""

from __future__ import annotations

import http.client
import ssl
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import origin_column as in_scope_origin
from ..operators.outcomes import classify
from .snapshot import SNAPSHOT
from .store import scratch_path

PERMITS = 10


def fetch(url: str, timeout: float = 30.0, agent: str = "crawlframe", ca_file: str | None = None) -> dict:
    """One response as a snapshot row; bodies are read for HTML successes only."""
    parts = urlsplit(url)
    row = {"url": url, "status": None, "content_type": [], "content_encoding": [], "location": None, "body": b"", "error": None}
    if parts.scheme == "https":
        conn = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=timeout, context=ssl.create_default_context(cafile=ca_file))
    else:
        conn = http.client.HTTPConnection(parts.hostname, parts.port, timeout=timeout)
    try:
        conn.request("GET", (parts.path or "/") + (f"?{parts.query}" if "?" in url else ""), headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
        got = conn.getresponse()
        row["status"], row["location"] = got.status, got.getheader("Location")
        row["content_type"] = got.headers.get_all("Content-Type") or []
        row["content_encoding"] = [x.strip() for v in got.headers.get_all("Content-Encoding") or [] for x in v.split(",")]
        kind = (row["content_type"] or [""])[0].split(";")[0].strip().lower()
        if 200 <= got.status < 300 and got.status != 206 and kind in ("text/html", "application/xhtml+xml"):
            row["body"] = got.read()
    except TimeoutError:
        row["error"] = "timeout"
    except (OSError, http.client.HTTPException):
        row["error"] = "body" if row["status"] else "transport"
    finally:
        conn.close()
    return row


def _fetch_all(timeout: float, ca_file: str | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with ThreadPoolExecutor(PERMITS) as pool:
        for batch in batches:
            yield pd.DataFrame(list(pool.map(partial(fetch, timeout=timeout, ca_file=ca_file), batch["url"])), columns=SNAPSHOT.names)


def responses(urls: DataFrame, timeout: float = 30.0, ca_file: str | None = None) -> DataFrame:
    """A snapshot of distinct ``urls`` (url)."""
    if not 1 <= timeout <= 300:
        raise ValueError("timeout must be from 1 to 300 seconds")
    return urls.select("url").distinct().mapInPandas(partial(_fetch_all, timeout, ca_file), SNAPSHOT)


def crawled(spark: SparkSession, jobs: DataFrame, timeout: float = 30.0, ca_file: str | None = None) -> DataFrame:
    """A snapshot of all that ``jobs`` (job_id, base) reach, fetched level by level, each URL once.

    A level's responses are written before they are read; the next level are links in a job's scope that no
    level has fetched. Nothing outside every job's scope is fetched.
    """
    root = scratch_path(spark, "responses")
    read = lambda: spark.read.schema(SNAPSHOT).parquet(root)
    new, bases = jobs.select(F.col("base").alias("url")).distinct(), jobs.select("base").distinct()
    while True:
        got = scratch_path(spark, "level")
        responses(new, timeout, ca_file).write.parquet(got)
        level = spark.read.schema(SNAPSHOT).parquet(got)
        if level.isEmpty():
            return read()
        level.write.mode("append").parquet(root)
        links = classify(level).select(F.explode("links").alias("url")).distinct()
        near = links.withColumn("origin", in_scope_origin(F.col("url"))).join(bases.withColumn("origin", in_scope_origin(F.col("base"))), "origin")
        new = near.where(F.col("url").startswith(F.col("base"))).select("url").distinct().join(read().select("url"), "url", "left_anti")
