"""Responses to outcomes: file with words and links, no file, or an error that fails the job.

Headers decide first, so bodies are read for HTML successes only, and Python sees only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import html, http, urls

EXTRACTED = StructType([StructField("links", ArrayType(StringType())), StructField("words", LongType()), StructField("error", StringType())])
OUTCOMES = ("url", "outcome", "words", "ext", "links", "error", "error_status")


def _page(url: str, body: bytes | None, content_type: str, gzipped: bool) -> tuple:
    text, error = http.decode_body(body, content_type, gzipped)
    if error:
        return [], None, error
    try:
        return (*html.extract(url, text), None)
    except html.WordCountOverflow:
        return [], None, "WordCountOverflow"


#: Said to be nondeterministic, so that the planner evaluates it once a row, whatever filters stand above it.
extract_page = F.udf(_page, EXTRACTED, useArrow=True).asNondeterministic()


def _redirect(url: str, location: str) -> list[str]:
    found = urls.resolve(urls.parse(url), location)
    return [found] if found else []


redirect_target = F.udf(_redirect, ArrayType(StringType()), useArrow=True).asNondeterministic()


def classify(snapshot: DataFrame) -> DataFrame:
    """url, outcome (file, no-file, or null with an error), words, ext, links, error, error_status of every response.

    Links are canonical, in document order, without repeats and of any scope; each page is parsed once,
    however many jobs visit it.
    """
    ctype = F.coalesce(F.get("content_type", F.lit(0)), F.lit(""))
    rest = F.filter("content_encoding", lambda e: ~F.lower(F.trim(e)).isin("identity", "gzip", ""))
    headed = snapshot.withColumns(
        {
            "kind": http.status_class_column(F.col("status")),
            "ctype": ctype,
            "gzipped": F.exists("content_encoding", lambda e: F.lower(F.trim(e)) == "gzip"),
            "coded": F.coalesce(F.size(rest) > 0, F.lit(False)),
            "many": F.coalesce(F.size("content_type") > 1, F.lit(False)),
            "ext": urls.extension_column(F.col("url")),
        }
    )
    visible = F.coalesce(F.col("location").rlike(r"\A[\x20-\x7e\t]+\z"), F.lit(False))
    branch = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("kind") == "redirect", F.when(visible, "redirect").otherwise("bad-redirect"))
        .when(F.col("kind") == "no-file", "no-file")
        .when(F.col("kind") == "error", "status")
        .when(F.col("many"), "bad-header")
        .when(~http.is_html_column(F.col("ctype")), "file")
        .when(F.col("coded"), "coded")
        .otherwise("html")
    )
    headed = headed.withColumn("branch", branch)
    none, text = F.array().cast("array<string>"), lambda v: F.lit(v).cast("string")
    label = {"bad-redirect": "InvalidRedirect", "bad-header": "InvalidHeader", "coded": "UnsupportedContentEncoding", "status": "Status"}
    error = F.when(F.col("branch") == "failed", F.initcap("error"))
    for k, v in label.items():
        error = error.when(F.col("branch") == k, v)
    by_headers = headed.where("branch not in ('html', 'redirect')").select(
        "url", F.col("branch").alias("outcome"), F.when(F.col("branch") == "file", F.lit(0).cast("long")).alias("words"), "ext", none.alias("links"), error.alias("error"), F.when(F.col("branch") == "status", F.col("status")).alias("error_status")
    )
    by_headers = by_headers.withColumn("outcome", F.when(F.col("outcome").isin("file", "no-file"), F.col("outcome")))
    redirects = headed.where("branch = 'redirect'").select(
        "url", F.lit("no-file").alias("outcome"), F.lit(None).cast("long").alias("words"), "ext", redirect_target("url", "location").alias("links"), text(None).alias("error"), F.lit(None).cast("int").alias("error_status")
    )
    pages = headed.where("branch = 'html'").select("url", "ext", extract_page("url", "body", "ctype", "gzipped").alias("got"))
    parsed = pages.select(
        "url", F.when(F.col("got.error").isNull(), "file").alias("outcome"), F.col("got.words").alias("words"), "ext", F.col("got.links").alias("links"), F.col("got.error").alias("error"), F.lit(None).cast("int").alias("error_status")
    )
    return by_headers.unionByName(redirects).unionByName(parsed)


#: The failure that each error makes of a job.
FAILURES = {"WordCountOverflow": "statistics", "OwnershipMismatch": "protocol", "PageOutsideScope": "protocol"}


def failure_column(error: str = "error"):
    out = F.when(F.col(error).isNull(), F.lit(""))
    for k, v in FAILURES.items():
        out = out.when(F.col(error) == k, v)
    return out.otherwise("fetch")
