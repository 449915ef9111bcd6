import pytest

from crawlframe.functions import html

PAGE = "https://h.example/d/"


def links(source, page=PAGE):
    return [u.removeprefix(PAGE) for u in html.extract(page, source)[0]]


def words(source):
    return html.extract(PAGE, source)[1]


@pytest.mark.parametrize(
    ("source", "n"),
    [
        ("<p>One 2two three's (four)", 2),
        ("<title>Top</title><!-- no no --><style>no</style><script>no no</script><template>no</template><noscript>yes</noscript>", 2),
        ("<p>a<b>b</b>c", 3),
        ("x<!-- split -->y", 2),
        ("x</nothing>y", 1),
        ("one&nbsp;two &lt;three four&#32;five", 4),
        ("Été İstanbul K", 2),
        ("a<table>b<tr><td>c</table>d", 3),
        ("<textarea>in <b>here</b></textarea>", 1),
        ("<plaintext>a <b> c", 2),
        ("<frameset><frame src=x></frameset>never", 0),
        ("<iframe>raw <b>text</b></iframe>", 1),
        ("", 0),
        ("<", 0),
        ("a <3 b", 2),
        ("tail <a href='x", 1),
    ],
)
def test_words(source, n):
    assert words(source) == n


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<a href=one><a href='one#x'><A HREF=\"./two?a=1&amp;b=2\">", ["one", "two?a=1&b=2"]),
        ("<a href=late></a><base href=sub/><base href=no/>", ["sub/late"]),
        ("<base><base href='mailto:x'><base href=sub/><a href=c>", ["c"]),
        ("<template><base href=no/><a href=t></a></template><a href=c>", ["t", "c"]),
        ("<img src=i srcset='s 1x, t 2x'><video src=v poster=p></video><object data=o></object><input src=n>", ["i", "s", "t", "v", "p", "o", "n"]),
        ("<svg><image xlink:href=x /><use href=u xlink:href=no /></svg><use xlink:href=html>", ["x", "u"]),
        ("<image src=as-img href=no>", ["as-img"]),
        ("<a href='?a=1&copy=2&lt;'>", ["?a=1&copy=2%3C"]),
        ("<a href=1 href=2>", ["1"]),
        ("<script><a href=no></script><textarea><a href=no></textarea><a href=yes>", ["yes"]),
        ("<!-- <a href=no> --!><a href=yes>", ["yes"]),
        ("<frameset><frame src=f></frameset>", ["f"]),
        ("<a href='javascript:x'><a href='//u:p@h.example/d/x'>", []),
    ],
)
def test_links(source, want):
    assert links(source) == want


def test_srcset():
    assert html.srcset_urls("data:a;b,c 1x, e.png 2x,") == ["data:a;b,c", "e.png"]
    assert html.srcset_urls("a.png odd(1,2), b.png, c.png 3w") == ["a.png", "b.png", "c.png"]
    assert html.srcset_urls(" ,\n, ") == []


def test_long_broken_document_is_read_to_its_end():
    found, n = html.extract(PAGE, "<div><p>x<i>y</p>" + "<b>word " * 5000 + "<a href=end>")
    assert found == [PAGE + "end"] and n == 5002
