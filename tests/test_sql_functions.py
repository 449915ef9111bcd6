from crawlframe.functions.register import register


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql("""
        SELECT canonical_url('HTTP://H.example/a/../b#f').url AS url, canonical_url('x').error AS error, resolve_url('http://h.example/a/b', '../c') AS resolved,
               url_ext('http://h.example/a.PNG?x') AS ext, in_scope('http://h.example/d/x', 'http://h.example/d/') AS inside,
               html_extract('http://h.example/', '<a href=x>one two</a>') AS page, srcset_urls('a 1x, b 2x') AS candidates, decode_body(X'C3A9', 'text/html').text AS body
    """).first()
    assert (row.url, row.error, row.resolved, row.ext, row.inside) == ("http://h.example/b", "InvalidUrl", "http://h.example/c", "png", True)
    assert (row.page.links, row.page.words, row.candidates, row.body) == (["http://h.example/x"], 2, ["a", "b"], "\u00e9")
    rows = spark.sql("SELECT t.pos, t.link FROM VALUES ('<a href=x><img src=y>') AS p(html), LATERAL html_links(p.html, 'http://h.example/') t ORDER BY pos").collect()
    assert [(r.pos, r.link) for r in rows] == [(0, "http://h.example/x"), (1, "http://h.example/y")]
