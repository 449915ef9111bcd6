"""Queries over the driver's tables, one for each operator or group of operators, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html, http, numbers, urls
from ..operators import closure, jobs, metrics, outcomes, protocol, stats
from ..sources import graphs, snapshot
from ..sources.store import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- URLs

_NO_FRAGMENT = "regexp_replace(url, '#.*$', '')"
_PATH = f"regexp_extract({_NO_FRAGMENT}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SEGMENT = f"regexp_extract({_PATH}, '([^/]*)$', 1)"
_EXT = f"CASE WHEN regexp_matches({_SEGMENT}, '^.+\\.[^.]+$') THEN lower(regexp_extract({_SEGMENT}, '\\.([^.]+)$', 1)) ELSE 'html' END"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(f"SELECT page_id, {_NO_FRAGMENT} AS canonical FROM pages")
def url_drop_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.drop_fragment(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_NO_FRAGMENT} AS canonical, NULL::VARCHAR AS url_error FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.with_canonical(_t(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "canonical", "url_error")


@query(f"SELECT page_id, {_EXT} AS ext FROM pages")
def url_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.extension_column(urls.drop_fragment(F.col("url"))).alias("ext"))


@query(f"SELECT page_id, {_ORIGIN} AS origin FROM pages")
def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.origin_column(F.col("url")).alias("origin"))


@query(f"SELECT page_id, starts_with({_NO_FRAGMENT}, {_ORIGIN} || '/en/') AS inside FROM pages")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = urls.drop_fragment(F.col("url"))
    base = F.concat(urls.origin_column(F.col("url")), F.lit("/en/"))
    return _t(spark, sf_dir, "pages").select("page_id", urls.in_scope_column(page, base).alias("inside"))


_BAD = {"docs/": "InvalidUrl", "http://": "InvalidUrl", "https://example.org:0/": "UnsupportedUrl", "ftp://example.org/": "UnsupportedUrl", "mailto:a@example.org": "UnsupportedUrl", "https://user:x@example.org/": "CredentialsNotAllowed"}


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_BAD.values())) + ") t(n, error)")
def url_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(list(enumerate(_BAD)), "n int, raw string")
    return urls.with_canonical(given, "raw", "url", "error").select("n", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://example.org/a/' || (o_orderkey % 7) ELSE 'https://example.org/a/b/' || o_orderkey || '.html?q=' || (o_orderkey % 5) END AS resolved FROM orders""")
def url_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("../"), (k % 7).cast("string"), F.lit("#x"))).otherwise(F.concat(F.lit("./"), k.cast("string"), F.lit(".html?q="), (k % 5).cast("string")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", urls.resolve_url(F.lit("HTTPS://EXAMPLE.org:443/a/b/c"), ref).alias("resolved"))


_MIMES = ["text/html", "TEXT/HTML; charset=UTF-8", " application/xhtml+xml ; charset=utf-8 ", "", "text/plain", "image/jpeg", "text/htmlish", "text/html, text/plain"]


@query("SELECT n, lower(trim(split_part(mime, ';', 1))) IN ('text/html', 'application/xhtml+xml') AS is_html FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_MIMES)) + ") t(n, mime)")
def mime_is_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_MIMES)), "n int, mime string").select("n", http.is_html_column(F.col("mime")).alias("is_html"))


@query("""SELECT status::INTEGER AS status, CASE WHEN status IN (301, 302, 303, 307, 308) THEN 'redirect'
 WHEN status BETWEEN 400 AND 499 AND status NOT IN (408, 429) THEN 'no-file'
 WHEN status BETWEEN 200 AND 299 AND status <> 206 THEN 'success' ELSE 'error' END AS class FROM range(100, 600) t(status)""")
def status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100, 600).select(F.col("id").cast("int").alias("status"), http.status_class_column(F.col("id")).alias("class"))


_NUMBERS = ["0", "7", "007", "+5", "18446744073709551615", "18446744073709551616", "9223372036854775808", "", "1a", "12\\n"]


@query("""SELECT n, CASE WHEN regexp_full_match(v, '0|[1-9][0-9]{0,37}') AND TRY_CAST(v AS HUGEINT) <= 18446744073709551615 THEN v END AS number FROM (VALUES """ + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_NUMBERS)) + ") t(n, v)")
def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(list(enumerate(_NUMBERS)), "n int, v string")
    return given.select("n", numbers.canonical_decimal(F.col("v")).cast("string").alias("number"))


@query("""SELECT event_id, regexp_full_match(event_type || '-' || user_id, '[A-Za-z0-9_-]{1,128}') AS worker_ok, regexp_full_match(props, '[A-Za-z0-9:_-]{1,128}') AS namespace_ok FROM events""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    worker = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", numbers.is_worker_id(worker).alias("worker_ok"), numbers.is_namespace(F.col("props")).alias("namespace_ok"))


# ---------------------------------------------------------------- pages

_WORDS = """len(regexp_extract_all(' ' || regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[\\s][A-Za-z]'))"""
#: hrefs of pages hold letters, digits and these marks; only what is not ASCII gets escaped.
_LINKS = f"""SELECT page_id, {_ORIGIN} || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%21', '!'), '%7C', '|'), '%24', '$'), '%26', '&'), '%2A', '*'), '%25', '%'), '%3A', ':'), '%40', '@'), '%3D', '='), '%2B', '+'), '%27', '''') AS link
FROM (SELECT DISTINCT page_id, url, replace(unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)), '&amp;', '&') AS href FROM pages)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.with_canonical(_t(spark, sf_dir, "pages"), "url").drop("url").withColumnRenamed("canonical", "url")
    return outcomes.classify(snapshot.from_pages(pages))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", urls.drop_fragment(F.col("url")).alias("url"), F.col("html").cast("binary").alias("body"))
    found = pages.select("page_id", "url", outcomes.extract_page("url", "body", F.lit("text/html; charset=utf-8"), F.lit(False)).alias("got"))
    linked = found.select("page_id", "url", F.explode("got.links").alias("link"))
    return linked.where(urls.origin_column(F.col("url")) == urls.origin_column(F.col("link"))).select("page_id", "link")


@query(f"SELECT page_id, count(*)::BIGINT AS links, min(link) AS first_link FROM ({_LINKS}) GROUP BY page_id")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first_link"))


@query(f"SELECT {_NO_FRAGMENT} AS url, 'file' AS outcome, {_WORDS}::BIGINT AS words, {_EXT} AS ext FROM pages")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("url", "outcome", "words", "ext")


@query(f"SELECT {_EXT} AS ext, count(*)::BIGINT AS n, CAST(sum({_WORDS}) AS DECIMAL(38,0)) AS words FROM pages GROUP BY 1")
def ext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_extension(_outcomes(spark, sf_dir))


@query(f"""SELECT count(*)::BIGINT AS num_files, count(DISTINCT {_EXT})::BIGINT AS num_exts, sum({_WORDS})::BIGINT AS total_word_count FROM pages""")
def web_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.web_stats(_outcomes(spark, sf_dir))
    return found.select("num_files", "num_exts", F.col("total_word_count").cast("long").alias("total_word_count"))


@query(f"""SELECT {_ORIGIN} AS origin, count(*)::BIGINT AS num_files, count(DISTINCT {_EXT})::BIGINT AS num_exts, sum({_WORDS})::BIGINT AS total_word_count FROM pages GROUP BY 1""")
def web_stats_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosted = _outcomes(spark, sf_dir).withColumn("origin", urls.origin_column(F.col("url")))
    return stats.web_stats(hosted, "origin").select("origin", "num_files", "num_exts", F.col("total_word_count").cast("long").alias("total_word_count"))


@query(f"SELECT link, count(*)::BIGINT AS pages FROM ({_LINKS}) WHERE link NOT IN (SELECT {_NO_FRAGMENT} FROM pages) GROUP BY link")
def unseen_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "pages").select(urls.drop_fragment(F.col("url")).alias("link"))
    return _links(spark, sf_dir).join(known, "link", "left_anti").groupBy("link").agg(F.count("*").alias("pages"))


@query(f"""WITH base AS (SELECT {_ORIGIN} || '/' AS base, row_number() OVER (ORDER BY {_ORIGIN}) AS job_id FROM pages GROUP BY {_ORIGIN}),
one AS (SELECT {_NO_FRAGMENT} AS url, min(html) AS html FROM pages GROUP BY 1),
found AS (SELECT base.job_id, {_WORDS} AS words FROM one JOIN base ON starts_with({_NO_FRAGMENT}, base.base))
SELECT job_id, count(*)::BIGINT AS num_files, sum(words)::BIGINT AS total_word_count FROM found GROUP BY job_id""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl job a host: its root links to every page of the host."""
    pages = _t(spark, sf_dir, "pages").groupBy(urls.drop_fragment(F.col("url")).alias("url")).agg(F.min("html").alias("html"))  # one response a URL
    hosts = pages.groupBy(F.concat(urls.origin_column(F.col("url")), F.lit("/")).alias("base")).agg(
        F.concat_ws("", F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<a href=\""), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("\"></a>")))).alias("html")
    )
    known = hosts.select("base", F.row_number().over(Window.orderBy("base")).cast("long").alias("job_id"))
    roots = snapshot.from_pages(hosts.select(F.col("base").alias("url"), "html"))
    visits, states = closure.crawl(known, outcomes.classify(snapshot.from_pages(pages).unionByName(roots)))
    got = stats.job_stats(visits.where("level > 0"), states)
    return got.select("job_id", "num_files", F.col("total_word_count").cast("long").alias("total_word_count"))


@query("SELECT doc_id, len(regexp_extract_all(' ' || coalesce(text, ''), '[\\s][A-Za-z]'))::BIGINT AS words FROM documents")
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?U)(?<!\S)[A-Za-zKİ]"))
    return _t(spark, sf_dir, "documents").select("doc_id", rule.cast("long").alias("words"))


@query()
def html_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


_SETS = ["a.png, b.png 2x, c.png 300w, d.png", "data:image/png;base64,AAAA 1x, good.png 2x", "a.png bad(a,b), b.png 2x", " , ,,"]


@query("SELECT * FROM (VALUES (0, 'a.png b.png c.png d.png'), (1, 'data:image/png;base64,AAAA good.png'), (2, 'a.png b.png'), (3, '')) t(n, found)")
def srcset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.udf(html.srcset_urls, "array<string>", useArrow=True)
    return spark.createDataFrame(list(enumerate(_SETS)), "n int, v string").select("n", F.array_join(cut("v"), " ").alias("found"))


# ---------------------------------------------------------------- closure

_EDGES = """SELECT 'root' AS src, 'region/' || r_regionkey AS dst FROM region
UNION ALL SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation
UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), seen(job_id, node, level) AS (
SELECT * FROM (VALUES (1::BIGINT, 'root', 0), (2::BIGINT, 'region/1', 0))
UNION SELECT seen.job_id, e.dst, seen.level + 1 FROM seen JOIN e ON e.src = seen.node)
SELECT job_id, level, count(*)::BIGINT AS nodes FROM seen GROUP BY job_id, level""")
def crawl_closure_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.hierarchy(*[_t(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")])
    roots = spark.createDataFrame([(1, "root"), (2, "region/1")], "job_id long, node string")
    return closure.reach(edges, roots).groupBy("job_id", "level").agg(F.count("*").alias("nodes"))


def _bench(case: str) -> None:
    files, exts, words = graphs.BENCHMARKS[case]["expected"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = spark.createDataFrame([(1, graphs.BASE)], "job_id long, base string")
        visits, states = closure.crawl(base, outcomes.classify(graphs.benchmark(spark, case)))
        return stats.stats_text(stats.job_stats(visits, states))

    run.__name__ = f"crawl_benchmark_{case}"
    text = f"files: {files}   extensions: {len(exts)}   words: {words}" + "".join(f"\n  {k} {v}" for k, v in sorted(exts.items()))
    query(f"SELECT 1::BIGINT AS job_id, '{text}' AS line")(run)


for _case in graphs.BENCHMARKS:
    _bench(_case)


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 1::BIGINT), (1, 1, 200), (1, 2, 200)) t(job_id, level, urls)")
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.createDataFrame([(1, graphs.BASE)], "job_id long, base string")
    visits, _ = closure.crawl(base, outcomes.classify(graphs.benchmark(spark, "mixed")))
    return visits.groupBy("job_id", "level").agg(F.count("*").alias("urls"))


# ---------------------------------------------------------------- jobs

_SUBMIT = f"SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS namespace, page_id AS pos, {_ORIGIN} || '/' AS base FROM pages"


@query(f"""WITH i AS ({_SUBMIT}), old AS (SELECT namespace, base, row_number() OVER (PARTITION BY namespace ORDER BY min(pos)) * 10 AS job_id FROM i WHERE pos < 20 GROUP BY namespace, base),
fresh AS (SELECT namespace, base, min(pos) AS first FROM i ANTI JOIN old USING (namespace, base) GROUP BY namespace, base),
made AS (SELECT namespace, base, first, (SELECT max(job_id) FROM old WHERE old.namespace = fresh.namespace) + row_number() OVER (PARTITION BY namespace ORDER BY first) AS job_id FROM fresh)
SELECT i.namespace, i.pos, i.base, coalesce(old.job_id, made.job_id)::BIGINT AS job_id, coalesce(i.pos = made.first, FALSE) AS created
FROM i LEFT JOIN old USING (namespace, base) LEFT JOIN made USING (namespace, base)""")
def submit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.concat(urls.origin_column(F.col("url")), F.lit("/"))
    inputs = _t(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("namespace"), F.col("page_id").alias("pos"), origin.alias("base"))
    first = inputs.where("pos < 20").groupBy("namespace", "base").agg(F.min("pos").alias("p"))
    existing = first.select("namespace", "base", (F.row_number().over(Window.partitionBy("namespace").orderBy("p")) * 10).cast("long").alias("job_id"))
    return jobs.submit(existing, inputs)


@query("SELECT n_nationkey + 1 AS job_id, row_number() OVER (ORDER BY CASE WHEN n_nationkey + 1 > 10 THEN 0 ELSE 1 END, n_nationkey)::BIGINT AS turn FROM nation")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rotated(_t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("job_id")), 10).select("job_id", "turn")


_STATES = "['running', 'done', 'aborted', 'failed']"
_STATE = f"{_STATES}[(n_nationkey % 4 + 1)::INTEGER]"


def _nation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("running", "done", "aborted", "failed")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    failure = F.when(F.col("n_nationkey") % 4 == 3, "fetch").otherwise("")
    return _t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("job_id"), F.col("n_name").alias("base"), state.alias("state"), failure.alias("failure"))


@query(f"SELECT (n_nationkey + 1)::BIGINT AS job_id, CASE WHEN {_STATE} = 'running' THEN 'aborted' ELSE {_STATE} END AS state, {_STATE} = 'running' AS changed FROM nation")
def abort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.abort(_nation_jobs(spark, sf_dir)).select("job_id", "state", "changed")


@query(f"""SELECT a.job_id::BIGINT AS job_id, CASE WHEN n_nationkey IS NULL THEN 'UnknownJob' WHEN {_STATE} = 'done' THEN 'ok' WHEN {_STATE} = 'failed' THEN 'JobFailed' WHEN {_STATE} = 'aborted' THEN 'JobAborted' ELSE 'NotFinished' END AS answer
FROM range(1, 31) a(job_id) LEFT JOIN nation ON n_nationkey + 1 = a.job_id""")
def final_stats_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.readable(spark.range(1, 31).select(F.col("id").alias("job_id")), _nation_jobs(spark, sf_dir))


def _order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25 + 1).cast("long").alias("job_id"), F.col("o_orderkey").cast("string").alias("url"), (status == "F").alias("done"), (status == "P").alias("in_flight"),
        F.when(F.col("o_orderkey") % 3 == 0, "no-file").otherwise("file").alias("outcome"),
    )


_PROGRESS = f"""SELECT (n_nationkey + 1)::BIGINT AS job_id, n_name AS base, {_STATE} AS state, CASE WHEN n_nationkey % 4 = 3 THEN 'fetch' ELSE '' END AS failure,
count(o_orderkey)::BIGINT AS discovered, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS processed, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS frontier,
count(*) FILTER (o_orderstatus = 'P')::BIGINT AS in_flight, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)::BIGINT AS files
FROM nation LEFT JOIN orders ON o_custkey % 25 = n_nationkey GROUP BY n_nationkey, n_name"""


@query(_PROGRESS)
def progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(_nation_jobs(spark, sf_dir), _order_visits(spark, sf_dir))


@query(f"""SELECT job_id, format('job {{}}  crawled {{}}  frontier {{}}  in flight {{}}  files {{}}  discovered {{}}  {{}}', job_id, processed, frontier, in_flight, files, discovered,
CASE WHEN state = 'failed' THEN 'failed (' || failure || ')' ELSE state END) AS line FROM ({_PROGRESS})""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress_text(progress_snapshot(spark, sf_dir))


@query("""SELECT job_id, seq, status FROM (SELECT o_custkey % 25 AS job_id, o_orderkey AS seq, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS old FROM orders) WHERE status IS DISTINCT FROM old""")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.changes(_t(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("job_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status")))


@query("SELECT s_suppkey AS pos, 'node-' || (41 + row_number() OVER (ORDER BY s_suppkey)) AS worker FROM supplier")
def worker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.worker_names(41, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos")))


@query("""SELECT s_suppkey, CAST(sum(CAST(l_orderkey AS HUGEINT) * 10000000000000) AS VARCHAR) AS total, sum(CAST(l_orderkey AS HUGEINT) * 10000000000000) > 18446744073709551615 AS overflow
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def overflow_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_orderkey").cast("decimal(24,0)") * F.lit(10_000_000_000_000).cast("decimal(14,0)")
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), value.alias("v"))
    total = numbers.exact_sum(F.col("v"))
    known = _t(spark, sf_dir, "supplier").select("s_suppkey")
    return items.join(known, "s_suppkey").groupBy("s_suppkey").agg(total.cast("string").alias("total"), numbers.overflows(total).alias("overflow"))


@query("""SELECT n AS part, list_aggregate(list(ext || ' ' || c ORDER BY ext), 'string_agg', ',') AS counts, sum(c)::VARCHAR AS num_files
FROM (SELECT (l_suppkey % 4)::INTEGER AS n, l_linestatus AS ext, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial statistics by return flag, merged."""
    each = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).cast("int").alias("part"), "l_returnflag", F.col("l_linestatus").alias("ext")).agg(F.count("*").alias("n"))
    parts = each.groupBy("part", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("ext", "n"))).alias("ext_counts"), F.sum("n").alias("total_word_count"))
    merged = stats.merge(parts, "part")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("ext_counts")), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ",")
    return merged.select("part", text.alias("counts"), F.col("num_files").cast("string").alias("num_files"))


@query("SELECT * FROM (VALUES (1, ''), (2, 'counts do not add up'), (3, 'extension not lower case'), (4, 'words without files')) t(n, broken)")
def stats_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 2, 1, {"html": 2}, 5), (2, 3, 1, {"html": 2}, 5), (3, 2, 1, {"HTML": 2}, 5), (4, 0, 0, {}, 5)]
    made = spark.createDataFrame(rows, "n int, num_files long, num_exts long, ext_counts map<string,long>, total_word_count long")
    return stats.broken_rules(made).select("n", F.array_join("broken", ",").alias("broken"))


@query("SELECT * FROM (VALUES (1, ''), (2, 'partition'), (3, 'done with work'), (4, 'active'), (5, 'files exceed processed,counts do not add up')) t(n, broken)")
def job_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n int, schema int, base string, state string, failure string, active boolean, processed long, files long, words long, exts map<string,long>, discovered long, frontier long, in_flight long"
    good = [1, 1, "http://a/", "running", "", True, 3, 2, 5, {"html": 2}, 5, 1, 1]
    other = lambda n, **kw: [n, *[kw.get(k, v) for k, v in list(zip([c.split()[0] for c in schema.split(", ")], good, strict=True))[1:]]]
    rows = [good, other(2, frontier=2), other(3, state="done", active=False), other(4, active=False), other(5, files=4)]
    return protocol.broken_rules(spark.createDataFrame(rows, schema)).select("n", F.array_join("broken", ",").alias("broken"))


@query("""SELECT o_custkey AS job_id, count(*)::BIGINT AS files, 'done' AS state, (count(*) * 2)::VARCHAR AS words FROM orders GROUP BY o_custkey""")
def protocol_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job a customer: its root claims and publishes all orders as children, each is claimed and published."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.format_string("http://a/%d", "o_orderkey").alias("url"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    first = o.where("k = 1").withColumn("root", F.col("url"))
    kids = o.where("k > 1").groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]).alias("children"))
    none = F.lit(None).cast("string")
    event = lambda df, seq, kind, url, kids=None: df.select("job_id", seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit("http://a/").alias("base"), url.alias("url"), F.lit("w").alias("worker"), F.lit("file").alias("outcome"), F.lit("2").alias("words"), F.lit("html").alias("ext"), (F.coalesce("children", F.array().cast("array<string>")) if kids else F.array().cast("array<string>")).alias("children"))
    root = F.lit("http://a/")
    seeds = first.join(kids, "job_id", "left")
    all_kids = seeds.withColumn("children", F.concat(F.array("root"), F.coalesce("children", F.array().cast("array<string>"))))
    parts = [
        event(seeds, F.lit(0), "submit", none), event(seeds, F.lit(1), "claim", none),
        event(all_kids, F.lit(2), "complete", root, True).withColumn("outcome", F.lit("no-file")),
        event(o, F.col("k") * 2 + 1, "claim", none), event(o, F.col("k") * 2 + 2, "complete", F.col("url")),
    ]
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    last = protocol.fold(events).groupBy("job_id").agg(F.max_by(F.struct("files", "state", "words"), "seq").alias("x"))
    return last.select("job_id", "x.files", "x.state", "x.words")


@query("""SELECT event_type AS stage, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total, max(round(value * 100)::BIGINT) AS most FROM events GROUP BY event_type""")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _t(spark, sf_dir, "events").withColumn("ns", F.round(F.col("value") * 100).cast("long"))
    return metrics.stage_timing(timed, "event_type", "ns")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS t, sum(CASE WHEN event_type = 'view' THEN 1 ELSE -1 END) AS step FROM events GROUP BY 1, 2),
a AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t) AS active, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM s)
SELECT user_id, max(active)::BIGINT AS peak, sum(active * (coalesce(nxt, t) - t))::BIGINT AS integral, arg_max(active, t)::BIGINT AS current FROM a GROUP BY user_id""")
def gauge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ns"), F.when(F.col("event_type") == "view", 1).otherwise(-1).alias("delta"))
    return metrics.gauges(steps, "user_id")


@query("""SELECT l_returnflag, round(median(l_quantity), 6) AS median, min(l_quantity) AS least, max(l_quantity) AS most, round(coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(l_quantity) END, 0), 6) AS stdev FROM lineitem GROUP BY l_returnflag""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bench_summary(_t(spark, sf_dir, "lineitem"), "l_returnflag", value="l_quantity")
    return found.withColumns({"median": F.round("median", 6), "stdev": F.round("stdev", 6)})


@query("SELECT o_orderstatus AS worker, count(*)::BIGINT AS owned, count(*) FILTER (o_orderkey % 2 = 0)::BIGINT AS matched FROM orders GROUP BY 1")
def owned_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications joined with their owners on job and URL: of each worker, how many name the owner."""
    flying = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("worker"))
    published = flying.select("job_id", "url", F.when(F.col("url") % 2 == 0, F.col("worker")).otherwise("other").alias("by"))
    return flying.join(published, ["job_id", "url"]).groupBy("worker").agg(F.count("*").alias("owned"), F.count_if(F.col("by") == F.col("worker")).alias("matched"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake that never forgets: first (user, type) of a stream of event files, run to its present end."""
    from ..streaming.intake import distinct_bases

    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    place = scratch_path(spark, "stream")
    first = distinct_bases(stream.select(F.col("user_id").cast("string").alias("namespace"), F.col("event_type").alias("base")))
    run = first.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{place}/rows").select(F.col("namespace").cast("long").alias("user_id"), F.col("base").alias("event_type"))


# ---------------------------------------------------------------- rules over generated rows

_HEADERS = """SELECT o_orderkey AS k, [200, 204, 206, 301, 404, 503, 408][(o_orderkey % 7 + 1)::INTEGER] AS status, o_orderkey % 5 AS kind, o_orderkey % 3 AS place, o_orderkey % 11 = 0 AS late FROM orders"""
_HEADER_ERROR = """CASE WHEN late THEN 'Timeout' WHEN status = 301 THEN CASE WHEN place = 0 THEN NULL ELSE 'InvalidRedirect' END WHEN status = 404 THEN NULL
 WHEN status NOT IN (200, 204) THEN 'Status' WHEN kind = 1 THEN 'InvalidHeader' WHEN kind = 4 THEN 'UnsupportedContentEncoding' END"""


@query(f"""SELECT k, CASE WHEN error IS NOT NULL THEN NULL WHEN status IN (301, 404) THEN 'no-file' ELSE 'file' END AS outcome, error,
 CASE WHEN error IS NULL THEN '' ELSE 'fetch' END AS failure, CASE WHEN error IS NULL AND status = 301 THEN 'http://h.example/x' ELSE '' END AS links,
 CASE WHEN error = 'Status' THEN status END::INTEGER AS error_status FROM (SELECT *, {_HEADER_ERROR} AS error FROM ({_HEADERS}))""")
def header_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that headers alone decide: statuses, redirects, repeated and coded content types, timeouts."""
    k, text = F.col("o_orderkey"), lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    status = F.element_at(F.array(*map(F.lit, (200, 204, 206, 301, 404, 503, 408))), (k % 7 + 1).cast("int"))
    kind = F.when(k % 5 == 0, text("text/plain")).when(k % 5 == 1, text("text/html", "text/html")).when(k % 5 == 2, text()).when(k % 5 == 3, text("image/png")).otherwise(text("text/html"))
    given = _t(spark, sf_dir, "orders").select(
        F.format_string("http://h.example/%d", k).alias("url"), status.alias("status"), kind.alias("content_type"), F.when(k % 5 == 4, text("br")).otherwise(text()).alias("content_encoding"),
        F.when(k % 3 == 0, "/x#y").when(k % 3 == 1, "/é").alias("location"), F.lit(b"").alias("body"), F.when(k % 11 == 0, "timeout").alias("error"),
    )
    found = outcomes.classify(given)
    number = F.element_at(F.split("url", "/"), -1).cast("long").alias("k")
    return found.select(number, "outcome", "error", outcomes.failure_column("error").alias("failure"), F.array_join("links", " ").alias("links"), "error_status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name || 'é' END AS text, CASE WHEN c_custkey % 5 = 0 THEN 'MalformedBody' END AS error FROM customer""")
def body_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in and out of quotes, a byte order mark that wins over its label, and bytes that a codec refuses."""
    k, name = F.col("c_custkey"), F.concat("c_name", F.lit("é"))
    way = [(F.encode(name, "UTF-8"), "text/html"), (F.encode(name, "UTF-16LE"), 'text/html; charset="utf-16le"'), (F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(name, "UTF-8")), "text/html;charset=windows-1252"), (F.encode(name, "ISO-8859-1"), "text/html ; Charset=Latin1")]
    body, kind = (F.coalesce(*[F.when(k % 4 == i, F.lit(w[j]) if j else w[j]) for i, w in enumerate(way)]) for j in (0, 1))
    bad = k % 5 == 0
    decode = F.udf(http.decode_body, "struct<text:string,error:string>", useArrow=True).asNondeterministic()
    got = _t(spark, sf_dir, "customer").select("c_custkey", decode(F.when(bad, F.lit(b"ok \xff\xc3")).otherwise(body), F.when(bad, "text/html; charset=utf-8").otherwise(kind)).alias("got"))
    return got.select("c_custkey", "got.text", "got.error")


@query("""SELECT c_custkey, 'http://h.example/d/ http://h.example/d/t' || c_custkey || ' http://h.example/d/n' || c_custkey || ' http://h.example/a' || c_custkey || '.png' AS links, 2::BIGINT AS words FROM customer""")
def html_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base element after links, a namespaced link, links inside template and noscript, repeats and words."""
    page = F.format_string('<svg><use xlink:href="#i"></use></svg><template><a href="t%1$d">no words</a></template><noscript><a href="n%1$d"></a></noscript><base><base href="/d/"><base href="/e/"><p>two w%1$d</p><script>var x</script><img srcset="../a%1$d.png 2x, n%1$d 3x">', F.col("c_custkey"))
    got = _t(spark, sf_dir, "customer").select("c_custkey", outcomes.extract_page(F.lit("http://h.example/p/q"), page.cast("binary"), F.lit("text/html"), F.lit(False)).alias("got"))
    return got.select("c_custkey", F.array_join("got.links", " ").alias("links"), F.col("got.words").alias("words"))


_STEPS = [  # kind, url, worker, outcome, children, reply; a job goes on in one of three ways
    ("submit", None, None, None, None, "'created'"), ("submit", None, None, None, None, "'existing'"), ("claim", None, "w", None, None, "'claimed http://a/'"),
    ("complete", "http://a/", "v", "file", None, "'ownership'"), ("complete", "http://a/none", "w", "file", None, "'ownership'"), ("complete", "http://a/", "w", "file", "http://b/", "'invalid'"),
    ("complete", "http://a/", "w", "file", "http://a/x", "'published'"), ("complete", "http://a/", "w", "file", None, "'already'"), ("claim", None, "w", None, None, "'claimed http://a/x'"),
    ("abort fail claim", "http://a/x", "w", "fetch", None, "['aborted', 'failed', 'idle'][(c_custkey % 3 + 1)::INTEGER]"), ("complete", "http://a/x", "w", "no-file", None, "['aborted', 'failed', 'published'][(c_custkey % 3 + 1)::INTEGER]"),
    ("claim", None, "w", None, None, "'idle'"), ("abort", None, None, None, None, "'unchanged'"),
]


@query("SELECT c_custkey AS job_id, seq, reply, CASE WHEN seq < 9 THEN 'running' WHEN c_custkey % 3 = 0 THEN 'aborted' WHEN c_custkey % 3 = 1 THEN 'failed' WHEN seq = 9 THEN 'running' ELSE 'done' END AS state, CASE WHEN seq >= 9 AND c_custkey % 3 = 1 THEN 'fetch' ELSE '' END AS failure, CASE WHEN seq < 6 THEN 1 ELSE 2 END::BIGINT AS discovered FROM ("
       + " UNION ALL ".join(f"SELECT c_custkey, {k}::BIGINT AS seq, {step[5]} AS reply FROM customer" for k, step in enumerate(_STEPS)) + ")")
def protocol_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply of the protocol: owners, strangers, repeats, children out of scope, an abort or a failure, late publications."""
    schema = "seq long, kinds string, url string, worker string, outcome string, child string"
    steps = spark.createDataFrame([(k, *step[:5]) for k, step in enumerate(_STEPS)], schema)
    every = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).crossJoin(F.broadcast(steps))  # len(_STEPS) events a job
    ways = F.split("kinds", " ")
    events = every.select(
        "job_id", "seq", F.get(ways, (F.col("job_id") % F.size(ways)).cast("int")).alias("kind"), F.lit("http://a/").alias("base"), "url", "worker", "outcome", F.lit("3").alias("words"), F.lit("html").alias("ext"),
        F.when(F.col("child").isNotNull(), F.array("child")).otherwise(F.array().cast("array<string>")).alias("children"),
    )
    return protocol.fold(events).select("job_id", "seq", "reply", "state", "failure", "discovered")


@query(f"SELECT (n_nationkey + 1)::BIGINT AS job_id, CASE WHEN {_STATE} = 'running' AND n_nationkey % 3 = 0 THEN 'aborted' ELSE {_STATE} END AS state, {_STATE} = 'running' AND n_nationkey % 3 = 0 AS changed FROM nation")
def abort_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = _nation_jobs(spark, sf_dir)
    return jobs.abort(all_jobs, all_jobs.where((F.col("job_id") - 1) % 3 == 0).select("job_id")).select("job_id", "state", "changed")


@query(f"SELECT (n_nationkey + 1)::BIGINT AS job_id FROM nation WHERE {_STATE} = 'running'")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active(_nation_jobs(spark, sf_dir)).select("job_id")


@query("SELECT l_returnflag AS namespace, l_orderkey AS job_id, count(*)::BIGINT AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.repeated_ids(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("namespace"), F.col("l_orderkey").alias("job_id")))


@query(f"""SELECT job_id, rule FROM (SELECT job_id, unnest([CASE WHEN discovered = 0 THEN 'nothing discovered' END, CASE WHEN state = 'done' AND frontier + in_flight > 0 THEN 'done with work' END,
 CASE WHEN state = 'running' AND frontier + in_flight = 0 THEN 'running without work' END]) AS rule FROM ({_PROGRESS})) WHERE rule IS NOT NULL""")
def preflight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.preflight(_nation_jobs(spark, sf_dir).withColumn("namespace", F.lit("n")), _order_visits(spark, sf_dir).withColumn("words", F.lit(0)))


@query("""SELECT l_suppkey AS job_id, CASE WHEN sum(CAST(l_orderkey AS HUGEINT) * 10000000000000) > 18446744073709551615 THEN 'failed' ELSE 'done' END AS state,
CASE WHEN sum(CAST(l_orderkey AS HUGEINT) * 10000000000000) > 18446744073709551615 THEN 'statistics' ELSE '' END AS failure FROM lineitem GROUP BY l_suppkey""")
def settled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose words go beyond the bound have failed for their statistics."""
    visits = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.lit("file").alias("outcome"), (F.col("l_orderkey").cast("decimal(38,0)") * F.lit(10_000_000_000_000)).alias("words"), F.lit("html").alias("ext"), F.lit(True).alias("done"))
    states = visits.select("job_id").distinct().select("job_id", F.lit("http://a/").alias("base"), F.lit("done").alias("state"), F.lit("").alias("failure"))
    return stats.settled(visits, states).select("job_id", "state", "failure")


@query("SELECT round(sum(o_totalprice) / (10 * sum(o_totalprice * 2)), 9) AS http_utilization FROM orders")
def http_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _t(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("integral"), (F.col("o_totalprice") * 2).alias("elapsed"))
    return metrics.utilization(nodes, "elapsed").select(F.round("http_utilization", 9).alias("http_utilization"))


_REPORT = {"http_transfer": "click", "parse": "purchase"}
_SPENT = "CASE WHEN event_type = '{0}' THEN round(value * 100)::BIGINT END"


@query("SELECT user_id::VARCHAR AS node, '{\"elapsed_ns\":' || count(*) || '," + ",".join(
    f'\"{s}\":{{\"count\":' + (f"' || count({_SPENT.format(_REPORT[s])}) || ',\"total_ns\":' || coalesce(sum({_SPENT.format(_REPORT[s])}), 0) || ',\"max_ns\":' || coalesce(max({_SPENT.format(_REPORT[s])}), 0) || '" if s in _REPORT else '0,\"total_ns\":0,\"max_ns\":0') + "}"
    for s in metrics.STAGES) + "," + ",".join(f'\"{g}\":{{\"active\":0,\"peak\":0,\"active_ns\":0}}' for g in metrics.GAUGES) + "}' AS line FROM events GROUP BY user_id")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a user, as a node: two of the stages are event types, the gauges never moved."""
    events = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("node"), "event_type", F.round(F.col("value") * 100).cast("long").alias("ns"))
    stage = F.coalesce(*[F.when(F.col("event_type") == v, k) for k, v in _REPORT.items()])
    timing = events.withColumn("stage", stage).where("stage is not null").groupBy("node", "stage").agg(F.count("*").alias("n"), F.sum("ns").alias("total"), F.max("ns").alias("most"))
    gauge = spark.createDataFrame([], "node string, gauge string, current long, peak long, integral long")
    return metrics.report(timing, gauge, events.groupBy("node").agg(F.count("*").alias("elapsed_ns")))
