"""Links and words of HTML documents: a recovering tokenizer and a tree builder reduced to what those need.

The builder keeps the stack of open elements, namespaces, raw-text elements, implied ends, tags that are
ignored, text moved out of tables and framesets; that decides which text stands together in one node, what
lies inside template, script or style, and which attributes are links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

from . import urls

# Element and attribute tables of HTML.
LINKS = {
    "a": ("href",), "area": ("href",), "link": ("href",), "image": ("href",), "use": ("href",),
    "img": ("src", "srcset"), "source": ("src", "srcset"), "script": ("src",), "iframe": ("src",), "frame": ("src",),
    "audio": ("src",), "track": ("src",), "embed": ("src",), "input": ("src",), "video": ("src", "poster"), "object": ("data",),
}
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
RCDATA = {"title", "textarea"}
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr xmp plaintext li dd dt".split())
TABLE_PARTS = set("caption col colgroup tbody td tfoot th thead tr".split())
TABLE_CONTEXT = set("table tbody tfoot thead tr".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
HEAD_ONLY = set("base basefont bgsound link meta title style script template noscript noframes head html".split())
SCOPE_STOPS = set("applet caption html table td th marquee object template".split())

_TAG = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTR = re.compile(r"[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >]+))?)?)")
_REF = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;?)")
_WORDS = re.compile("[^\t-\r \x85\xa0  -     　]+")  # runs between Unicode white space
_SPACE = " \t\n\r\x0c"


def _attribute_text(value: str) -> str:
    """Character references as attributes have them: a name without ; before = or a letter stays."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        ref = m[1]
        if ref[0] == "#" or ref in html5 and ref.endswith(";"):
            return unescape(m[0])
        for k in range(len(ref), 1, -1):
            if ref[:k] in html5 and not ref[:k].endswith(";"):
                after = (ref[k:] + value[m.end() : m.end() + 1])[:1]
                return m[0] if after == "=" or after.isascii() and after.isalnum() else html5[ref[:k]] + ref[k:]
        return m[0]

    return _REF.sub(one, value)


def tokens(source: str) -> Iterator[tuple]:
    """("text", string), ("comment",), ("start", name, attributes, self-closing), ("end", name).

    Whoever reads them sends the name of the raw-text element that was just opened, or None.
    """
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", unescape(source[at:])
            return
        nxt = source[lt + 1 : lt + 2]
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("!", "?") and nxt or nxt == "/" and lt + 2 < n):
            stop = source.find("<", lt + 1)
            stop = n if stop < 0 else stop
            yield "text", unescape(source[at:stop])
            at = stop
            continue
        if lt > at:
            yield "text", unescape(source[at:lt])
        if source.startswith("<!--", lt):
            if source.startswith((">", "->"), lt + 4):
                at = source.index(">", lt + 4) + 1
            else:
                end = re.compile(r"--!?>").search(source, lt + 4)
                at = end.end() if end else n
            yield ("comment",)
            continue
        closing = nxt == "/"
        name = _TAG.match(source, lt + 1 + closing)
        if not name:
            end = source.find(">", lt + 1)
            at = n if end < 0 else end + 1
            if source[lt + 2 : lt + 3] != ">" and not source[lt : lt + 9].lower() == "<!doctype":
                yield ("comment",)
            continue
        at, attrs = name.end(), {}
        while at < n and source[at] != ">":
            found = _ATTR.match(source, at)
            if not found or found.end() == at:
                at += 1
                continue
            at = found.end()
            if found[1]:
                attrs.setdefault(found[1].lower(), _attribute_text(next((v for v in found.groups()[1:] if v is not None), "")))
        if at >= n:
            return  # the document ends inside a tag
        empty = source[at - 1] == "/"
        at += 1
        low = name[0].lower()
        if closing:
            yield "end", low
            continue
        raw = yield "start", low, attrs, empty
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\t\n\f\r />])", re.I).search(source, at) if raw != "plaintext" else None
            stop = end.start() if end else n
            if stop > at:
                yield "text", unescape(source[at:stop]) if raw in RCDATA else source[at:stop]
            at = stop


class _Builder:
    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []  # (name, namespace)
        self.texts: list[tuple[list[str], bool]] = []  # (pieces, excluded)
        self.open_text: list[str] | None = None
        self.before_table: list[list[str] | None] = []
        self.elements: list[tuple[str, str, dict, bool]] = []  # (name, namespace, attributes, inside template)
        self.body = self.frameset = self.head_closed = False

    def inside(self, *names: str) -> bool:
        return any(n in names for n, _ in self.stack)

    def boundary(self) -> None:
        self.open_text = None

    def in_scope(self, name: str, stops: set[str] = SCOPE_STOPS) -> bool:
        for n, ns in reversed(self.stack):
            if n == name:
                return True
            if n in stops and ns == "html":
                return False
        return False

    def pop_to(self, name: str) -> None:
        while self.stack:
            n, _ = self.stack.pop()
            if n == "table" and self.before_table:
                self.before_table.pop()
            if n == name:
                break
        self.boundary()

    def text(self, data: str) -> None:
        data = data.replace("\0", "")
        if not data:
            return
        if self.frameset and not self.inside("noframes"):
            return
        excluded = self.inside("script", "style", "template")
        if data.strip(_SPACE) and not self.inside("title", "script", "style", "template", "noscript", "noframes"):
            self.body = True
        if self.stack and self.stack[-1][0] in TABLE_CONTEXT and self.stack[-1][1] == "html" and data.strip(_SPACE) and self.before_table:
            held = self.before_table[-1]  # moved before the table, into the text that stands there
            if held is None:
                held = []
                self.texts.append((held, excluded))
                self.before_table[-1] = held
            held.append(data)
            return
        if self.open_text is None:
            self.open_text = []
            self.texts.append((self.open_text, excluded))
        self.open_text.append(data)

    def start(self, name: str, attrs: dict, empty: bool) -> str | None:
        ns = self.stack[-1][1] if self.stack else "html"
        if ns != "html" and self.stack[-1][0] in INTEGRATION:
            ns = "html"
        if ns != "html" and (name in BREAKOUT or name == "font" and {"color", "face", "size"} & attrs.keys()):
            while self.stack and self.stack[-1][1] != "html" and self.stack[-1][0] not in INTEGRATION:
                self.stack.pop()
            self.boundary()
            ns = "html"
        if name == "svg" and ns == "html":
            ns = "svg"
        elif name == "math" and ns == "html":
            ns = "math"
        if ns != "html":
            self.add(name, ns, attrs)
            if not empty:
                self.stack.append((name, ns))
            return None
        return self.start_html("img" if name == "image" else name, attrs)

    def add(self, name: str, ns: str, attrs: dict) -> None:
        self.boundary()
        self.elements.append((name, ns, attrs, self.inside("template")))

    def start_html(self, name: str, attrs: dict) -> str | None:
        if name in ("html", "body", "head"):
            self.body |= name == "body"
            return None  # one of each is there already
        if self.frameset and name not in ("frameset", "frame", "noframes"):
            return None
        if name == "frameset":
            if self.body:
                return None
            self.frameset = True
        elif name == "frame" and not self.frameset:
            return None
        elif name not in HEAD_ONLY:
            self.body = True
        in_table = self.in_scope("table", {"html", "template"})
        if name in TABLE_PARTS and not in_table and not self.inside("template"):
            return None
        if name == "form" and self.inside("form") and not self.inside("template"):
            return None
        if self.inside("select") and name not in ("option", "optgroup", "hr", "script", "template", "select", "input", "textarea", "keygen"):
            return None
        if self.inside("select") and name in ("select", "input", "textarea", "keygen"):
            self.pop_to("select")
            if name == "select":
                return None
        if name in CLOSES_P and self.in_scope("p", SCOPE_STOPS | {"button"}):
            self.pop_to("p")
        if name == "li" and self.in_scope("li", SCOPE_STOPS | {"ul", "ol"}):
            self.pop_to("li")
        if name in ("dd", "dt"):
            for other in ("dd", "dt"):
                if self.in_scope(other, SCOPE_STOPS | {"dl"}):
                    self.pop_to(other)
        if name in ("option", "optgroup") and self.stack and self.stack[-1][0] == "option":
            self.pop_to("option")
        if name in ("a", "nobr", "button") and self.in_scope(name):
            self.pop_to(name)
        if in_table and name in TABLE_PARTS:
            closes = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
            for other in closes.get(name, ()):
                if self.in_scope(other, {"table", "html", "template"}):
                    self.pop_to(other)
        before = self.open_text
        self.add(name, "html", attrs)
        if name in VOID:
            return None
        if name == "table":
            self.before_table.append(before)
        self.stack.append((name, "html"))
        return name if name in RAW | RCDATA or name == "plaintext" else None

    def end(self, name: str) -> None:
        if name == "br":
            self.add("br", "html", {})
        elif name == "p" and not self.in_scope("p", SCOPE_STOPS | {"button"}):
            if not (self.stack and self.stack[-1][1] != "html"):
                self.add("p", "html", {})
        elif name in ("html", "body", "head"):
            return
        elif re.fullmatch("h[1-6]", name):
            found = next((n for n, _ in reversed(self.stack) if re.fullmatch("h[1-6]", n)), None)
            if found:
                self.pop_to(found)
        elif self.in_scope(name, {"html", "template", "table"} - {name}):
            self.pop_to(name)


def _build(source: str) -> _Builder:
    made = _Builder()
    stream = tokens(source)
    send = None
    try:
        while True:
            token = stream.send(send)
            send = None
            if token[0] == "text":
                made.text(token[1])
            elif token[0] == "comment":
                made.boundary()
            elif token[0] == "start":
                send = made.start(*token[1:])
            else:
                made.end(token[1])
    except StopIteration:
        return made


def count_words(text: str) -> int:
    """Words that begin with a to z after lower-casing, between Unicode white space."""
    return sum("a" <= w[0] <= "z" for w in _WORDS.findall(text.lower()))


def srcset_urls(value: str) -> list[str]:
    """The URL of every candidate; commas inside a URL or a descriptor's parentheses don't end it."""
    out, at, n = [], 0, len(value)
    while True:
        while at < n and value[at] in _SPACE + ",":
            at += 1
        if at >= n:
            return out
        start = at
        while at < n and value[at] not in _SPACE:
            at += 1
        url = value[start:at]
        out.append(url.rstrip(","))
        if url.endswith(","):
            continue
        depth = 0
        while at < n:
            c = value[at]
            at += 1
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            if c == "," and not depth:
                break


def references(name: str, ns: str, attrs: dict) -> list[str]:
    out = []
    for attribute in LINKS.get(name, ()):
        value = attrs.get(attribute)
        if value is None and attribute == "href" and ns != "html":
            value = attrs.get("xlink:href")
        if value is not None:
            out += srcset_urls(value) if attribute == "srcset" else [value]
    return out


class WordCountOverflow(OverflowError):
    """A page has more words than the count can hold."""


def extract(page: str, source: str, most: int = (1 << 63) - 1) -> tuple[list[str], int]:
    """(canonical links in document order without repeats, words) of a decoded document at a canonical URL.

    Links of any scope are returned; the scope filter is a relational step. More than ``most`` words are an error.
    """
    made, here = _build(source), urls.parse(page)
    first = next((a["href"] for n, ns, a, inert in made.elements if n == "base" and not inert and "href" in a), None)
    base = here
    if first is not None:
        try:
            base = urls.parse(first, here)
        except urls.UrlError:
            base = here
    found = (urls.resolve(base, r) for n, ns, a, _ in made.elements for r in references(n, ns, a))
    links = list(dict.fromkeys(x for x in found if x is not None))
    words = sum(count_words("".join(t)) for t, excluded in made.texts if not excluded)
    if words > most:
        raise WordCountOverflow
    return links, words
