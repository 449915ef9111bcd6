import random

import pytest

from crawlframe.functions import html
from crawlframe.operators import closure, outcomes, stats
from crawlframe.sources import graphs
from crawlframe.sources.snapshot import response, snapshot

H = "http://h.example/"


def page(path, text, *to):
    return response(H + path, 200, "text/html", f"<p>{text}</p>" + "".join(f"<a href='{x}'></a>" for x in to))


def crawl(spark, rows, jobs, small):
    base = spark.createDataFrame(jobs, "job_id long, base string")
    return (closure.crawl_on_driver if small else closure.crawl)(base, outcomes.classify(snapshot(spark, rows)))


ROWS = [
    page("s/", "root page", "a", "b#x", "sub/", "../out", "http://other.example/s/", "gone", "moved", "pic.JPG"),
    page("s/a", "left", "b", "./"), page("s/b", "right words here", "a", "deep/1"), page("s/sub/", "inner", "leaf", "/s/"), page("s/sub/leaf", "leaf 1 two"),
    page("s/deep/1", "down", "2"), page("s/deep/2", "downer", "../a"), response(H + "s/moved", 301, location="/s/found"), page("s/found", "found it"),
    response(H + "s/pic.JPG", 200, "image/jpeg", b"\xff"), page("out", "outside", "s/"),
]


@pytest.mark.parametrize("small", [True, False])
def test_two_jobs_share_pages(spark, small):
    visits, states = crawl(spark, ROWS, [(1, H + "s/"), (2, H + "s/sub/"), (3, H + "nothing/")], small)
    seen = {}
    for r in visits.collect():
        seen.setdefault(r.job_id, {})[r.url.removeprefix(H)] = r.level
    assert seen[1] == {"s/": 0, "s/a": 1, "s/b": 1, "s/sub/": 1, "s/gone": 1, "s/moved": 1, "s/pic.JPG": 1, "s/deep/1": 2, "s/sub/leaf": 2, "s/found": 2, "s/deep/2": 3}
    assert seen[2] == {"s/sub/": 0, "s/sub/leaf": 1} and seen[3] == {"nothing/": 0}
    assert {r.state for r in states.collect()} == {"done"}
    lines = {r.job_id: r.line for r in stats.stats_text(stats.job_stats(visits, states)).collect()}
    assert lines[1] == "files: 9   extensions: 2   words: 13\n  html 8\n  jpg 1"
    assert lines[2] == "files: 2   extensions: 1   words: 3\n  html 2"
    assert lines[3] == "files: 0   extensions: 0   words: 0"


@pytest.mark.parametrize("small", [True, False])
def test_an_error_fails_its_job_alone_and_freezes_the_level(spark, small):
    rows = [r for r in ROWS if r[0] != H + "s/sub/leaf"] + [response(H + "s/sub/leaf", 503), page("other/", "fine")]
    visits, states = crawl(spark, rows, [(1, H + "s/"), (2, H + "other/")], small)
    assert {r.job_id: (r.state, r.failure) for r in states.collect()} == {1: ("failed", "fetch"), 2: ("done", "")}
    got = visits.where("job_id = 1").collect()
    assert {r.level for r in got if r.done} == {0, 1} and {r.level for r in got if not r.done} == {2}
    assert [r.job_id for r in stats.job_stats(visits, states).collect()] == [2]


@pytest.mark.parametrize("seed", range(2))
def test_both_ways_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {k: [rng.randrange(n) for _ in range(rng.randint(0, 3))] for k in range(n)}
    rows = [page(f"r/{k}", "w " * k, *[f"{x}" for x in to]) for k, to in edges.items()]
    want, level, now = {0: 0}, 0, [0]
    while now:
        level += 1
        now = [x for x in dict.fromkeys(x for k in now for x in edges[k]) if x not in want and not want.update({x: level})]
    for small in (True, False):
        base = [(1, H + "r/0")]
        visits, _ = crawl(spark, [*rows, page("r/", "", "0")], [(1, H + "r/")], small)
        got = {int(r.url.rsplit("/", 1)[1]): r.level - 1 for r in visits.collect() if r.level}
        assert got == want and base


@pytest.mark.parametrize("case", ["latency", "broad", "mixed"])
def test_benchmark_shapes(spark, case):
    visits, states = closure.crawl(spark.createDataFrame([(1, graphs.BASE)], "job_id long, base string"), outcomes.classify(graphs.benchmark(spark, case)))
    row = stats.job_stats(visits, states).first()
    assert (row.num_files, row.ext_counts, int(row.total_word_count)) == graphs.BENCHMARKS[case]["expected"]


def test_a_page_outside_its_scope_is_an_error(spark):
    for small in (True, False):
        visits, states = crawl(spark, [page("a", "x")], [(1, "http://h.example:80/a"), (2, H + "a")], small)
        if not small:
            assert {(r.job_id, r.state, r.failure) for r in states.collect()} == {(1, "done", ""), (2, "done", "")}
    with pytest.raises(html.WordCountOverflow):
        html.extract(H, "<p>one two three", most=2)
    assert html.extract(H, "<p>one two", most=2) == ([], 2)


def test_pages_are_parsed_once(spark):
    found = outcomes.classify(snapshot(spark, ROWS)).where("outcome = 'file' and size(links) > 0 and words > 1").groupBy("ext").agg({"words": "sum"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_page(") == 1


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = closure.reach(edges, spark.createDataFrame([(1, "a"), (2, "d"), (3, "x")], "job_id long, node string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "d", 0), (3, "x", 0)]


def test_merge_and_rules(spark):
    big = 2**64 - 1
    rows = [(1, {"html": 2}, "5"), (1, {"html": 1, "png": 4}, "6"), (2, {"a": 1}, str(big)), (2, {"a": 1}, "1"), (3, {"a": 1}, str(big))]
    parts = spark.createDataFrame(rows, "k int, ext_counts map<string,long>, w string").selectExpr("k", "ext_counts", "cast(w as decimal(38,0)) as total_word_count")
    got = {r.k: r for r in stats.merge(parts, "k").collect()}
    assert {k: int(v) for k, v in got[1].ext_counts.items()} == {"html": 3, "png": 4} and int(got[1].num_files) == 7 and int(got[1].total_word_count) == 11
    assert got[2].ext_counts is None and got[2].total_word_count is None and int(got[3].total_word_count) == big
