"""Personal data in texts: candidate spans scored by boosted trees, in DataFrame operations only.

Generators of high recall propose spans, which may overlap: the four base kinds, whose matches always stay,
and looser forms (written-out addresses, numbers without a plus sign, long tokens, grouped numbers). Each
candidate becomes numbers about its format and the text around it; boosted trees, compiled to a column
expression, score it, and a threshold per generator, calibrated on synthetic texts apart from those that the
trees were grown on, selects what is redacted. Of selected spans that overlap, the longest of a run stays, and
none that touches a base span, which covers it. Trees are grown on the driver from a bounded synthetic set,
which passes through the same generators and features as a corpus does; a corpus passes through expressions
alone, without a shuffle. A precision measured on such texts is no promise for others: a list written by hand,
in the tests, is held against the trees, and README gives what that finds.

Offsets are code points. Patterns avoid repeated groups, which the regular-expression engine of the JVM
recurses into: single separators between digits (and dots inside host names) are replaced by a marker of the
same length first, so that a run is one character class.

Defined cases: a null text is an empty text, without spans; null ids and repeated rows give a row each; texts
of any length are searched whole; an empty table gives no rows. Redaction keeps a null text null and leaves
all other columns as they are, whatever their names.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

BASE = ("email", "ip", "card", "phone")
_BLOCK = 64
#: Characters before a candidate that its features look at.
_CONTEXT = 24
_MARK = "\x01"
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,m:string,before:string,after:string>>"

# The patterns of the base kinds, with single separators inside runs replaced by the marker.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x01]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Generators of further candidates: name, kind of the span, pattern.
GENERATORS = (
    ("token", "secret", r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"),
    ("written_email", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z]{2,24}(?![A-Za-z])"),
    ("local_phone", "phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9.-])"),
    ("two_part_phone", "phone", r"(?<![0-9A-Za-z+./-])\(?0[0-9]{1,4}\)?[ /-]{1,2}[0-9]{5,8}(?![0-9A-Za-z./-])"),
    ("grouped_number", "id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
)
_HINTS = r"(?i)(?:token|key|secret|passw|bearer|mail|contact|write|tel|phone|call|fax|mobil|ssn|iban|account|social)"
#: Ends of host names that are common.
_DOMAIN = r"[. )\]](?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|nl|ch|at)$"
#: Words before numbers and hashes that are public.
_PUBLIC = r"(?i)(?:commit|sha-?[0-9]|md5|checksum|digest|hash|revision|build|version|serial|isbn|doi|part|item|order|page|https?:|www\.|\.[a-z]{2,4}/[^ ]*$)"


def _runs(text: Column, pattern: str) -> Column:
    """All matches with places and surroundings: lengths of the gaps between matches, summed up in blocks."""
    lit = F.lit

    def placed(x: Column) -> Column:  # x: struct(gaps, found)
        steps = F.transform(
            x["found"],
            lambda m, i: F.struct(
                F.length(F.get(x["gaps"], i)).alias("gap"), F.length(m).alias("len"), m.alias("m"),
                # what stands before goes on over the match before, and the text before that
                F.right(F.concat(F.coalesce(F.right(F.get(x["gaps"], i - 1), lit(_CONTEXT)), lit("")), F.coalesce(F.get(x["found"], i - 1), lit("")), F.get(x["gaps"], i)), lit(_CONTEXT)).alias("before"),
                F.left(F.get(x["gaps"], i + 1), lit(1)).alias("after"),
            ),
        )
        return F.transform(F.sequence(lit(0), F.floor((F.size(x["found"]) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, lit(_BLOCK)))

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda s: F.aggregate(s, lit(0), lambda a, y: a + y["gap"] + y["len"]))
        return F.aggregate(sums, F.array(lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))

    def block(s: Column, at: Column) -> Column:
        one = lambda a, y: F.struct(
            (a["at"] + y["gap"] + y["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + y["gap"]).alias("start"), (a["at"] + y["gap"] + y["len"]).alias("end"), y["m"].alias("m"), y["before"].alias("before"), y["after"].alias("after")))).alias("out"),
        )
        return F.aggregate(s, F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out")), one, lambda a: a["out"])

    # each array of one element binds a name, so that nothing is computed again for every match
    pieces = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, lit(pattern), lit(0)).alias("found")))
    blocks = F.filter(pieces, lambda x: F.size(x["found"]) > 0)
    bound = F.transform(F.transform(blocks, placed), lambda s: F.struct(s.alias("s"), summed(s).alias("at")))
    return F.flatten(F.flatten(F.transform(bound, lambda x: F.transform(x["s"], lambda s, b: block(s, F.get(x["at"], b))))))


def _none() -> Column:
    return F.array().cast(_FOUND)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def base_matches(text: Column) -> dict[str, Column]:
    """Arrays of found structs of the base kinds, failing matches dropped."""
    plain = F.translate(text, _MARK, "\x02")
    hosts = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    numbers = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", _MARK)
    card = F.filter(_runs(numbers, _CARD), lambda x: F.length(_digits(x["m"])).between(13, 19))
    return {
        "email": F.when(F.instr(text, "@") > 0, _runs(hosts, _EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_runs(text, _IP), lambda x: x["m"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9][ -]?[0-9]"), F.filter(card, lambda x: _luhn(_digits(x["m"])))).otherwise(_none()),
        "phone": F.when(F.instr(text, "+") > 0, F.filter(_runs(text, _PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))).otherwise(_none()),
    }


# ---------------------------------------------------------------- candidates and features

FEATURES = ("length", "digit_share", "upper_share", "vowel_share", "hex", "variety", "hint", "assigned", "quoted", "inner_marks", "joined", "switches", "public", "slashes", "domain")


def _features(x: Column) -> Column:
    m, n = x["m"], F.length(x["m"]).cast("double")
    share = lambda kept: F.length(F.regexp_replace(m, f"[^{kept}]+", "")) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.struct(
        n.alias("length"), share("0-9").alias("digit_share"), share("A-Z").alias("upper_share"), share("aeiouAEIOU").alias("vowel_share"),
        flag(m.rlike("^[0-9a-fA-F]+$")).alias("hex"), (F.size(F.array_distinct(F.split(m, ""))) / n).alias("variety"),
        flag(x["before"].rlike(_HINTS)).alias("hint"), flag(x["before"].rlike("[:=] ?[\"']?$")).alias("assigned"),
        flag(x["before"].rlike("[\"'(]$")).alias("quoted"), share("()+/_.@ -").alias("inner_marks"),
        flag(x["after"].rlike("[A-Za-z0-9@]")).alias("joined"),
        flag(x["before"].rlike(_PUBLIC)).alias("public"), share("/").alias("slashes"), flag(m.rlike(_DOMAIN)).alias("domain"),
        (F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]+", "")) / n).alias("switches"),
    )


def candidates(text: Column) -> Column:
    """Array of (generator's number, start, end, features) of all further generators."""
    cheap = {
        "token": text.rlike("[A-Za-z0-9+/_-]{16}"),
        "written_email": text.rlike(r"(?:\(at\)|\[at\]| at )"),
        "local_phone": text.rlike(r"[0-9]\)?[ .-]{1,2}[0-9]{3}"),
        "two_part_phone": text.rlike(r"0[0-9]{1,4}\)?[ /-]{1,2}[0-9]{5}"),
        "grouped_number": text.rlike(r"[0-9]{2}"),
    }
    found = []
    for k, (name, _, pattern) in enumerate(GENERATORS):
        runs = F.when(cheap[name], _runs(text, pattern)).otherwise(_none())
        found.append(_numbered(runs, k))
    return F.concat(*found)


def _numbered(runs: Column, k: int) -> Column:
    return F.transform(runs, lambda x: F.struct(F.lit(k).alias("generator"), x["start"].alias("start"), x["end"].alias("end"), _features(x).alias("f")))


# ---------------------------------------------------------------- learning

SYNTHETIC_TEXTS = 3_000


def synthetic(seed: int = 5, n: int = SYNTHETIC_TEXTS) -> list[dict]:
    """Texts with one candidate each: (text, start, end, private), made by rule from the seed."""
    rng = random.Random(seed)
    word = lambda lo=2, hi=9: "".join(rng.choice(["an", "er", "ti", "on", "st", "re", "le", "ou", "ve", "da"]) for _ in range(rng.randint(lo, hi) // 2 + 1))
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    digits = lambda k: pick("0123456789", k)
    hexed = lambda: rng.choice([lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(hexes.upper(), 40)])()
    keyed = lambda: rng.choice([lambda: pick(alnum, rng.randint(20, 44)), lambda: "sk_live_" + pick(alnum, 24), lambda: "ghp_" + pick(alnum, 36), lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16)])()
    asked = ["token = \"", "key: ", "secret=", "password \"", "api_key=", "Bearer "]
    path = lambda: "/".join(rng.choice([word(), word().title(), f"{word()}-{word()}", f"{word()}{digits(2)}"]) for _ in range(rng.randint(3, 6)))
    makers = {
        True: [
            lambda: (rng.choice(asked), hexed()),
            lambda: (rng.choice([*asked, "", "", "with "]), keyed()),
            lambda: (rng.choice(["mail ", "contact ", "write to ", ""]), rng.choice(["{} (at) {}.{}", "{} [at] {} [dot] {}", "{} at {} dot {}", "{}(at){}(dot){}"]).format(word(), word(), rng.choice(["com", "org", "net", "de"]))),
            lambda: (rng.choice(["call ", "tel ", "phone: ", ""]), rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}"]).format(digits(3), digits(3), digits(4))),
            lambda: (rng.choice(["call ", "tel ", "Tel. ", "phone: ", "fax ", "mobil "]), rng.choice(["0{} {}", "(0{}) {}", "0{}/{}", "0{}-{}"]).format(digits(rng.randint(2, 3)), digits(rng.randint(5, 8)))),
            lambda: (rng.choice(["ssn ", "account ", "IBAN ", ""]), rng.choice([lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: "DE" + digits(2) + "".join(" " + digits(4) for _ in range(4)) + " " + digits(2)])()),
        ],
        False: [
            lambda: ("", word(16, 40)),
            lambda: ("", "-".join(word() for _ in range(rng.randint(3, 6)))),
            lambda: ("", path()),
            lambda: (rng.choice(["https://{}.com/", "http://www.{}.org/", "see {}.net/", "://{}.io/"]).format(word()), path()),
            lambda: (rng.choice(["commit ", "sha256:", "md5 ", "checksum: ", "revision ", "digest ", "", ""]), hexed()),
            lambda: (rng.choice(["serial ", "part no. ", "order ", "build ", "item "]), pick(alnum[:26] + "0123456789", rng.randint(16, 20))),
            lambda: ("", rng.choice(["_", "-"]) * rng.randint(16, 60)),
            lambda: ("", rng.choice([word(16, 30), "_".join(word() for _ in range(rng.randint(3, 6))), f"{word()}{word()}{digits(1)}{word()}"]).upper()),
            lambda: ("", f"{word()} at {word()}. {word().title()}"),
            lambda: (rng.choice(["", "mail ", "write "]), f"{word()} at {word()}.{word()}"),
            lambda: (rng.choice(["pages ", "in ", "sum ", ""]), f"{digits(2)} {digits(3)} {digits(3)}"),
            lambda: (rng.choice(["pages ", "in ", "sum ", "", "order ", "version "]), f"0{digits(2)}{rng.choice(' /-')}{digits(rng.randint(5, 8))}"),
            lambda: (rng.choice(["order ", "number ", "", ""]), digits(rng.randint(16, 24))),
            lambda: ("", f"{word()} at {word()}.{word().title()}"),
            lambda: ("version ", f"{digits(2)}.{digits(3)}.{digits(4)}"),
            lambda: (rng.choice(["ISBN ", "isbn: "]), f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"),
            lambda: ("", f"{word()}{digits(1)}-{word()}-{word()}{digits(2)}-{word()}"),
        ],
    }
    out = []
    for i in range(n):
        private = i % 2 == 0
        lead, span = rng.choice(makers[private])()
        before = " ".join(word() for _ in range(rng.randint(2, 8))) + " " + lead
        after = rng.choice(["\" ", " ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 6)))
        out.append({"text": before + span + after, "start": len(before), "end": len(before) + len(span), "private": private})
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[dict]:
    """Boosted trees on logistic gradients, as nested dicts."""
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)

        def node(rows: np.ndarray, left: int, g: np.ndarray = g, h: np.ndarray = h) -> dict:
            leaf = {"step": round(float(-rate * g[rows].sum() / (h[rows].sum() + 1)), 6)}
            best = (1e-6, 0, 0.0)
            if left and len(rows) > 10:
                gt, ht = g[rows].sum(), h[rows].sum()
                for k in range(x.shape[1]):
                    order = rows[np.argsort(x[rows, k], kind="stable")]
                    v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
                    at = np.flatnonzero(v[1:] > v[:-1])
                    if len(at):
                        gain = gs[at] ** 2 / (hs[at] + 1) + (gt - gs[at]) ** 2 / (ht - hs[at] + 1) - gt**2 / (ht + 1)
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (float(gain[j]), k, float((v[at[j]] + v[at[j] + 1]) / 2))
            if best[0] <= 1e-6:
                return leaf
            low = x[rows, best[1]] <= best[2]
            return {"feature": best[1], "bound": best[2], "low": node(rows[low], left - 1), "high": node(rows[~low], left - 1)}

        tree = node(np.arange(len(y)), depth)
        out.append(tree)
        z = z + np.array([_walk(tree, r) for r in x])
    return out


def _walk(tree: dict, row: np.ndarray) -> float:
    while "step" not in tree:
        tree = tree["low"] if row[tree["feature"]] <= tree["bound"] else tree["high"]
    return tree["step"]


def _column(tree: dict, f: Column) -> Column:
    if "step" in tree:
        return F.lit(tree["step"])
    return F.when(f[FEATURES[tree["feature"]]] <= tree["bound"], _column(tree["low"], f)).otherwise(_column(tree["high"], f))


def calibrate(z: np.ndarray, y: np.ndarray, precision: float = 0.99) -> float:
    """The lowest score from which on at least ``precision`` of the candidates are private, but 0 at least; infinity if none is."""
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(z[order][1:] < z[order][:-1], True)
    good = np.flatnonzero((right >= precision) & ends)
    return max(0.0, float(z[order][good[-1]])) if len(good) else float("inf")


@lru_cache(maxsize=4)
def _learned(app: str, seed: int) -> tuple[list[dict], list[float]]:
    spark = SparkSession.getActiveSession()
    rows = json.dumps(synthetic(seed))
    given = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<text:string,start:int,end:int,private:boolean>>")).alias("r")).select("r.*")
    found = given.select("text", "start", "end", "private", F.explode(candidates(F.col("text"))).alias("c")).select(
        "private", F.col("c.generator").alias("g"), ((F.col("c.start") < F.col("end")) & (F.col("c.end") > F.col("start"))).alias("hit"), *[F.col(f"c.f.{k}").alias(k) for k in FEATURES]
    )
    got = found.collect()  # a few candidates for each of SYNTHETIC_TEXTS texts
    x = np.array([[r[k] for k in FEATURES] for r in got])
    y = np.array([float(r["hit"] and r["private"]) for r in got])
    gen, test = np.array([r["g"] for r in got]), np.arange(len(got)) % 3 == 2
    trees = grow(x[~test], y[~test])
    z = np.array([sum(_walk(t, r) for t in trees) for r in x])
    return trees, [calibrate(z[test & (gen == k)], y[test & (gen == k)]) for k in range(len(GENERATORS))]


def selected(text: Column, trees: list[dict], bounds: list[float], base: Column) -> Column:
    """Spans of the further generators whose score reaches their generator's threshold, apart from each other and from ``base``."""
    limits = F.array(*[F.lit(b) for b in bounds])
    kinds = F.array(*[F.lit(kind) for _, kind, _ in GENERATORS])

    def score(f: Column) -> Column:
        out = F.lit(0.0)
        for t in trees:
            out = out + _column(t, f)
        return out

    kept = F.filter(candidates(text), lambda c: score(c["f"]) >= F.get(limits, c["generator"]) - 1e-9)
    spans = F.transform(kept, lambda c: F.struct(F.get(kinds, c["generator"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    ordered = F.array_sort(F.concat(_ordered(base, 0), _ordered(spans, 1)))
    # reach: where base spans end so far; last: the span that may still give way to a longer one
    start = F.struct(F.lit(0).alias("reach"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a["out"], F.lit(-1))
        meets = F.coalesce(last["end"] > s["start"], F.lit(False))
        before = F.when(meets, F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1)).otherwise(a["out"])
        own = F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["to"]).alias("end")))
        longer = ~meets | (-s["to"] - s["start"] > last["end"] - last["start"])
        out = F.when(s["added"] == 0, before).when((s["start"] >= a["reach"]) & longer, F.concat(before, own)).otherwise(a["out"])
        return F.struct(F.when(s["added"] == 0, F.greatest(a["reach"], -s["to"])).otherwise(a["reach"]).alias("reach"), out.alias("out"))

    apart = F.aggregate(ordered, start, step, lambda a: a["out"])
    return F.when(F.size(spans) > 0, apart).otherwise(spans)


def _ordered(spans: Column, added: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), (-s["end"]).alias("to"), s["kind"].alias("kind")))


def with_spans(docs: DataFrame, *kept: Column, text: str = "text", seed: int = 5) -> DataFrame:
    """``kept``, ``__base`` (a struct of span arrays by kind) and ``__more`` (spans that the method adds)."""
    trees, bounds = _learned(docs.sparkSession.sparkContext.applicationId, seed)
    t = F.col("__text")
    staged = docs.select(*kept, text_of(text).alias("__text"))
    spans = lambda kind, runs: F.transform(runs, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.struct(*[spans(k, runs).alias(k) for k, runs in base_matches(t).items()])
    every = F.concat(*[F.col(f"__base.{k}") for k in BASE])
    return staged.withColumn("__base", base).withColumn("__more", selected(t, trees, bounds, every))


def _rank(kind: Column) -> Column:
    order = (*BASE, *sorted({k for _, k, _ in GENERATORS} - set(BASE)))
    return F.array_position(F.array(*[F.lit(k) for k in order]), kind)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = with_spans(docs, F.col(doc_id).cast("long").alias("doc_id"), text=text)
    base = F.concat(*[F.col(f"__base.{k}") for k in BASE])
    keyed = F.transform(F.concat(base, F.col("__more")), lambda s: F.struct(_rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    everything = F.array_sort(keyed)
    return found.select(
        "doc_id", *[F.size(f"__base.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(everything).alias("spans"),
    )


def redact(docs: DataFrame, *, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; spans that overlap become one.

    ``length``: a column that holds the text's code points, set anew.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    found = with_spans(docs, row, text=text)
    spans = F.array_sort(F.transform(F.concat(*[F.col(f"__base.{k}") for k in BASE], F.col("__more")), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))
    kind = "array<struct<start:int,end:int,kind:string>>"
    step = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], -s["to"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind")))),
    ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), (-s["to"]).alias("end"), s["kind"].alias("kind")))))
    merged = found.withColumn("__m", F.aggregate(spans, F.array().cast(kind), step))
    m, t, n = F.col("__m"), F.col("__text"), F.size("__m")
    end_of = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))

    def segment(b: Column) -> Column:
        """The text up to the last span of a block of spans, cut out once, then cut at each of them."""
        first, last = end_of(b * _BLOCK), end_of(F.least((b + 1) * _BLOCK, n))
        bound = F.array(F.substr(t, first + 1, last - first))
        parts = lambda seg: F.transform(
            F.slice(m, b * _BLOCK + 1, F.lit(_BLOCK)),
            lambda s, i: F.concat(F.substr(seg, end_of(b * _BLOCK + i) - first + 1, s["start"] - end_of(b * _BLOCK + i)), F.lit("["), F.upper(s["kind"]), F.lit("]")),
        )
        return F.array_join(F.flatten(F.transform(bound, parts)), "")

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), segment)
    clean = F.when(n > 0, F.concat(F.array_join(blocks, ""), F.substr(t, end_of(n) + 1, F.length(t)))).otherwise(F.col("__row")[text])
    new = {text: F.col("__clean")} | ({length: F.length("__clean").cast(docs.schema[length].dataType)} if length else {})
    return merged.select("__row", clean.alias("__clean")).select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
