"""The scalar rules as SQL functions, and links as a table function for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import html, http, urls


def _extract(page: str | None, source: str | None) -> tuple[list[str], int] | None:
    return None if page is None or source is None else html.extract(page, source)


def _decode(body: bytes | None, content_type: str | None) -> tuple[str | None, str | None]:
    return http.decode_body(body, content_type or "")


def _in_scope(url: str | None, base: str | None) -> bool | None:
    return None if url is None or base is None else urls.in_scope(urls.parse(url), urls.parse(base))


def _extension(url: str | None) -> str | None:
    return None if url is None else urls.extension(urls.parse(url).path)


class HtmlLinks:
    """html_links(html, page): pos, link of every link of a decoded document at a canonical URL."""

    def eval(self, source: str, page: str) -> Iterator[tuple[int, str]]:
        if source is not None and page is not None:
            yield from enumerate(html.extract(page, source)[0])


def register(spark: SparkSession) -> None:
    """Make canonical_url, resolve_url, url_ext, in_scope, html_extract, srcset_urls, decode_body and html_links known to SQL."""
    found = StructType([StructField("links", ArrayType(StringType())), StructField("words", LongType())])
    text = StructType([StructField("text", StringType()), StructField("error", StringType())])
    spark.udf.register("canonical_url", urls.canonical_url)
    spark.udf.register("resolve_url", urls.resolve_url)
    spark.udf.register("url_ext", F.udf(_extension, StringType(), useArrow=True))
    spark.udf.register("in_scope", F.udf(_in_scope, "boolean", useArrow=True))
    spark.udf.register("html_extract", F.udf(_extract, found, useArrow=True))
    spark.udf.register("srcset_urls", F.udf(lambda v: None if v is None else html.srcset_urls(v), ArrayType(StringType()), useArrow=True))
    spark.udf.register("decode_body", F.udf(_decode, text, useArrow=True))
    spark.udtf.register("html_links", F.udtf(HtmlLinks, returnType="pos int, link string"))
