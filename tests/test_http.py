import gzip

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import http
from crawlframe.operators import outcomes
from crawlframe.sources.snapshot import response, snapshot

B = "http://h.example/"


@pytest.mark.parametrize(
    ("body", "kind", "want"),
    [
        ("é".encode(), "text/html", ("é", None)),
        (b"\x93x\x94\x81", "text/html; charset=latin1", ("“x”\x81", None)),
        ("﻿é".encode(), "text/html; charset=latin1", ("é", None)),
        ("é".encode("utf-16"), "text/html", ("é", None)),
        ("ж".encode("koi8-r"), 'text/html; charset="KOI8-R"', ("ж", None)),
        (b"\xff", "text/html; charset=utf-8", (None, "MalformedBody")),
        (b"x", "text/html; charset=none-such", (None, "UnsupportedCharset")),
        (b"x", "text html", (None, "InvalidHeader")),
        (b"\x80\x81\xe9", "text/html; charset=windows-1250", ("€\x81é", None)),
        (b"\x98\xc6", "text/html; charset=windows-1251", ("\x98Ж", None)),
        (b"a\xaa", "text/html; charset=windows-1253", (None, "MalformedBody")),
        (b"\xe0\xca\x9f", "text/html; charset=windows-1255", ("א\u05ba\x9f", None)),
        (b"\xd9", "text/html; charset=windows-1255", (None, "MalformedBody")),
        (b"\xa1", "text/html; charset=TIS-620", ("ก", None)),
        (b"\xdb", "text/html; charset=windows-874", (None, "MalformedBody")),
        (b"\xae\xbe\xc6", "text/html; charset=koi8-u", ("ўЎф", None)),
        (b"\x80\xe9", "text/html; charset=macintosh", ("ÄÈ", None)),
        (b"a\x80\xff", "text/html; charset=x-user-defined", ("a\uf780\uf7ff", None)),
        (b"\x80\xc4\xe3\x80", "text/html; charset=gb2312", ("€你€", None)),
        (b"\xff", "text/html; charset=gbk", (None, "MalformedBody")),
        (b"\xe0", "text/html; charset=logical", ("א", None)),
        (b"", "text/html; charset=hz-gb-2312", ("", None)),
        (b"x", "text/html; charset=iso-2022-kr", (None, "MalformedBody")),
    ],
)
def test_decoding(body, kind, want):
    assert http.decode_body(body, kind) == want


def test_gzip():
    assert http.decode_body(gzip.compress(b"ok"), "text/html", True) == ("ok", None)
    assert http.decode_body(gzip.compress(b"o") + gzip.compress(b"k"), "text/html", True) == ("ok", None)
    assert http.decode_body(b"", "text/html", True) == ("", None)
    for broken in (b"\x1f\x8bbroken", gzip.compress(b"ok")[:-1], gzip.compress(b"ok") + b"more"):
        assert http.decode_body(broken, "text/html", True) == (None, "Body")


def test_every_label_has_a_codec():
    for label, codec in http.CODECS.items():
        assert label == label.lower() and http.decode_body(b"", f'text/html; charset="{label}"') == ("", None), codec


def test_outcomes(spark):
    rows = [
        response(B + "a", 200, "text/html", "<a href=b>one</a>"), response(B + "b.PDF", 200, "application/pdf", "x"), response(B + "c", 204, "text/html", ""),
        response(B + "d", 302, "text/html", "<a href=no>", location="a#f"), response(B + "e", 302, "text/html"), response(B + "f", 302, "text/html", location="mailto:x"),
        response(B + "g", 404, "text/html", "<a href=no>"), response(B + "h", 429), response(B + "i", 503), response(B + "j", 206),
        response(B + "k", 200, None, "no header"), response(B + "l", 200, "text/html", "x", encoding="br"), response(B + "m", 200, "text/html", gzip.compress(b"two words"), encoding="gzip"),
        response(B + "n", None, error="timeout"), response(B + "o", 200, "text/html", b"\xff"),
        (B + "p", 200, ["text/html", "text/plain"], [], None, bytearray(b"x"), None),
    ]
    got = {r.url.removeprefix(B): (r.outcome, r.words, r.ext, r.links, r.error, r.error_status) for r in outcomes.classify(snapshot(spark, rows)).collect()}
    assert got == {
        "a": ("file", 1, "html", [B + "b"], None, None), "b.PDF": ("file", 0, "pdf", [], None, None), "c": ("file", 0, "html", [], None, None),
        "d": ("no-file", None, "html", [B + "a"], None, None), "e": (None, None, "html", [], "InvalidRedirect", None), "f": ("no-file", None, "html", [], None, None),
        "g": ("no-file", None, "html", [], None, None), "h": (None, None, "html", [], "Status", 429), "i": (None, None, "html", [], "Status", 503), "j": (None, None, "html", [], "Status", 206),
        "k": ("file", 0, "html", [], None, None), "l": (None, None, "html", [], "UnsupportedContentEncoding", None), "m": ("file", 2, "html", [], None, None),
        "n": (None, None, "html", [], "Timeout", None), "o": (None, None, "html", [], "MalformedBody", None), "p": (None, None, "html", [], "InvalidHeader", None),
    }


def test_status_classes(spark):
    got = {r.s: r.c for r in spark.range(100, 600).select(F.col("id").alias("s"), http.status_class_column(F.col("id")).alias("c")).collect()}
    assert [s for s, c in got.items() if c == "redirect"] == [301, 302, 303, 307, 308]
    assert got[204] == "success" and got[206] == got[408] == got[429] == got[304] == got[500] == "error" and got[410] == "no-file"
