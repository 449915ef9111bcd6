import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlframe.functions import urls

GOOD = {
    "HTTP://Host.Example:80/x/./y/../z#f": "http://host.example/x/z",
    "https://host.example:443": "https://host.example/",
    "  https://host.example/a\tb\n": "https://host.example/ab",
    "https:\\\\host.example\\p\\..\\q": "https://host.example/q",
    "https://host.example/%2E%2e/top": "https://host.example/top",
    "https://münchen.example/": "https://xn--mnchen-3ya.example/",
    "https://host.example/ä b?c d#e": "https://host.example/%C3%A4%20b?c%20d",
    "http://0x7f.1:8080/": "http://127.0.0.1:8080/",
    "http://[2001:DB8:0:0::1]/": "http://[2001:db8::1]/",
    "https://host.example/q?": "https://host.example/q?",
    "https://@host.example/": "https://host.example/",
}
BAD = {
    "": urls.INVALID, "no/scheme": urls.INVALID, "https://": urls.INVALID, "http://h:99999/": urls.INVALID, "http://1.2.3.256/": urls.INVALID, "http://a b/": urls.INVALID,
    "ftp://h/": urls.UNSUPPORTED, "javascript:void(0)": urls.UNSUPPORTED, "http://h:0/": urls.UNSUPPORTED, "https://u:secret@h/?token=t": urls.CREDENTIALS,
}


@pytest.mark.parametrize(("raw", "want"), GOOD.items())
def test_canonical_form(raw, want):
    assert urls.canonical(raw) == (want, None)
    assert urls.canonical(want) == (want, None)


@pytest.mark.parametrize(("raw", "kind"), BAD.items())
def test_rejected_without_echo(raw, kind):
    assert urls.canonical(raw) == (None, kind)
    with pytest.raises(urls.UrlError) as caught:
        urls.parse(raw)
    assert "secret" not in str(caught.value) and "token" not in str(caught.value)


def test_distinctions_that_stay():
    forms = ["p", "p/", "P", "p?", "p?a=1", "p?a=1&b=2", "p?b=2&a=1", "%70", "a/b", "a%2Fb"]
    assert len({urls.canonical(f"https://h.example/{x}")[0] for x in forms}) == len(forms)


def test_resolution():
    page = urls.parse("https://h.example/d/s/page?q=1")
    want = {"../n#x": "/d/n", "/r": "/r", "?q=2": "/d/s/page?q=2", "": "/d/s/page?q=1", "#x": "/d/s/page?q=1", "//H.EXAMPLE:443/z": "/z", "https:rel": "/d/s/rel", ".": "/d/s/"}
    assert {r: urls.resolve(page, r) for r in want} == {r: f"https://h.example{p}" for r, p in want.items()}
    assert urls.resolve(page, "mailto:a@b") is None and urls.resolve(page, "//u:p@h.example/") is None


def test_scope_is_origin_and_literal_prefix():
    base = urls.parse("https://h.example/d/")
    inside = ["https://h.example/d/", "https://h.example:443/d/x?y"]
    outside = ["https://h.example/d", "https://h.example/d-e/", "http://h.example/d/", "https://h.example:444/d/", "https://h.example.evil.example/d/", "https://h.example/d/../e"]
    assert all(urls.in_scope(urls.parse(u), base) for u in inside)
    assert not any(urls.in_scope(urls.parse(u), base) for u in outside)
    assert urls.in_scope(urls.parse("https://h.example/d-e"), urls.parse("https://h.example/d"))


EXTENSIONS = {"x.PNG": "png", "x.tar.GZ?n=a.zip": "gz", "dir/": "html", "plain": "html", ".rc": "html", ".a.JSON": "json", "end.": "html", "d.png/": "html", "x%2Epng": "html"}


def test_extension(spark):
    assert {p: urls.extension(urls.parse(f"https://h.example/{p}").path) for p in EXTENSIONS} == EXTENSIONS
    rows = spark.createDataFrame([(p, f"https://h.example/{p}") for p in EXTENSIONS], "p string, u string")
    assert {r.p: r.e for r in rows.select("p", urls.extension_column(F.col("u")).alias("e")).collect()} == EXTENSIONS


def test_fast_path_agrees_with_full_rules(spark):
    raw = [*GOOD, *BAD, None, "https://a.example/x/y.html?q=1#z", "http://a.example/%7Eme/", "http://a.example/a..b/", "http://a1.example/", "http://a.example/a/../b", "http://1.example/", "http://a.0x1/"]
    df = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    got = {r.n: (r.canonical, r.url_error) for r in urls.with_canonical(df, "raw").collect()}
    assert got == {n: urls.canonical(x) for n, x in enumerate(raw)}


@given(st.text(max_size=40))
def test_canonical_is_a_fixpoint(text):
    url, _ = urls.canonical(f"http://h.example/{text}")
    assert url is None or urls.canonical(url)[0] == url
