"""Headers and bodies: MIME types, charset labels, strict decoding."""

from __future__ import annotations

import codecs
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_TYPE = re.compile(rf"({_TOKEN})/({_TOKEN})")
_PARAM = re.compile(rf"[ \t]*;[ \t]*({_TOKEN})=(?:({_TOKEN})|\"((?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|\\.)*)\")")

# Labels of the encoding standard and the codec that decodes each.
LABELS = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "x-unicode20utf8"),
    "cp1252": ("windows-1252", "ansi_x3.4-1968", "ascii", "cp1252", "cp819", "csisolatin1", "ibm819", "iso-8859-1", "iso-ir-100", "iso8859-1", "iso88591", "iso_8859-1", "iso_8859-1:1987", "l1", "latin1", "us-ascii", "x-cp1252"),
    "cp866": ("ibm866", "866", "cp866", "csibm866"),
    "iso8859-2": ("iso-8859-2", "csisolatin2", "iso-ir-101", "iso8859-2", "iso88592", "iso_8859-2", "iso_8859-2:1987", "l2", "latin2"),
    "iso8859-3": ("iso-8859-3", "csisolatin3", "iso-ir-109", "iso8859-3", "iso88593", "iso_8859-3", "iso_8859-3:1988", "l3", "latin3"),
    "iso8859-4": ("iso-8859-4", "csisolatin4", "iso-ir-110", "iso8859-4", "iso88594", "iso_8859-4", "iso_8859-4:1988", "l4", "latin4"),
    "iso8859-5": ("iso-8859-5", "csisolatincyrillic", "cyrillic", "iso-ir-144", "iso8859-5", "iso88595", "iso_8859-5", "iso_8859-5:1988"),
    "iso8859-6": ("iso-8859-6", "arabic", "asmo-708", "csiso88596e", "csiso88596i", "csisolatinarabic", "ecma-114", "iso-8859-6-e", "iso-8859-6-i", "iso-ir-127", "iso8859-6", "iso88596", "iso_8859-6", "iso_8859-6:1987"),
    "iso8859-7": ("iso-8859-7", "csisolatingreek", "ecma-118", "elot_928", "greek", "greek8", "iso-ir-126", "iso8859-7", "iso88597", "iso_8859-7", "iso_8859-7:1987", "sun_eu_greek"),
    "iso8859-8": ("iso-8859-8", "csiso88598e", "csisolatinhebrew", "hebrew", "iso-8859-8-e", "iso-ir-138", "iso8859-8", "iso88598", "iso_8859-8", "iso_8859-8:1988", "visual", "iso-8859-8-i", "csiso88598i", "logical"),
    "iso8859-10": ("iso-8859-10", "csisolatin6", "iso-ir-157", "iso8859-10", "iso885910", "l6", "latin6"),
    "iso8859-13": ("iso-8859-13", "iso8859-13", "iso885913"),
    "iso8859-14": ("iso-8859-14", "iso8859-14", "iso885914"),
    "iso8859-15": ("iso-8859-15", "csisolatin9", "iso8859-15", "iso885915", "iso_8859-15", "l9"),
    "iso8859-16": ("iso-8859-16",),
    "mac-roman": ("macintosh", "csmacintosh", "mac", "x-mac-roman"),
    "mac-cyrillic": ("x-mac-cyrillic", "x-mac-ukrainian"),
    "cp874": ("windows-874", "dos-874", "iso-8859-11", "iso8859-11", "iso885911", "tis-620"),
    "cp1250": ("windows-1250", "cp1250", "x-cp1250"),
    "cp1251": ("windows-1251", "cp1251", "x-cp1251"),
    "cp1253": ("windows-1253", "cp1253", "x-cp1253"),
    "cp1254": ("windows-1254", "cp1254", "csisolatin5", "iso-8859-9", "iso-ir-148", "iso8859-9", "iso88599", "iso_8859-9", "iso_8859-9:1989", "l5", "latin5", "x-cp1254"),
    "cp1255": ("windows-1255", "cp1255", "x-cp1255"),
    "cp1256": ("windows-1256", "cp1256", "x-cp1256"),
    "cp1257": ("windows-1257", "cp1257", "x-cp1257"),
    "cp1258": ("windows-1258", "cp1258", "x-cp1258"),
    "koi8-r": ("koi8-r", "cskoi8r", "koi", "koi8", "koi8_r"),
    "koi8-u": ("koi8-u", "koi8-ru"),
    "gb18030": ("gb18030", "gbk", "chinese", "csgb2312", "csiso58gb231280", "gb2312", "gb_2312", "gb_2312-80", "iso-ir-58", "x-gbk"),
    "big5hkscs": ("big5", "big5-hkscs", "cn-big5", "csbig5", "x-x-big5"),
    "euc_jp": ("euc-jp", "cseucpkdfmtjapanese", "x-euc-jp"),
    "iso2022_jp": ("iso-2022-jp", "csiso2022jp"),
    "cp932": ("shift_jis", "csshiftjis", "ms932", "ms_kanji", "shift-jis", "sjis", "windows-31j", "x-sjis"),
    "cp949": ("euc-kr", "cseuckr", "csksc56011987", "iso-ir-149", "korean", "ks_c_5601-1987", "ks_c_5601-1989", "ksc5601", "ksc_5601", "windows-949"),
    "utf-16-be": ("utf-16be", "unicodefffe"),
    "utf-16-le": ("utf-16le", "utf-16", "csunicode", "iso-10646-ucs-2", "ucs-2", "unicode", "unicodefeff"),
    "x-user-defined": ("x-user-defined",),
    "replacement": ("replacement", "csiso2022kr", "hz-gb-2312", "iso-2022-cn", "iso-2022-cn-ext", "iso-2022-kr"),
}
# Characters where the encoding standard and the codec differ.
HOLAM_HASER = "\u05ba"  # 0xCA in windows-1255
EURO = "\u20ac"  # 0x80 in gb18030
INSTEAD = {"koi8-u": {0x255D: 0x045E, 0x256C: 0x040E}, "x-user-defined": {b: 0xF700 + b for b in range(0x80, 0x100)}}
CODECS = {label: codec for codec, labels in LABELS.items() for label in labels}


def parse_mime(value: str) -> tuple[str, dict[str, str]] | None:
    """(essence, parameters) of a well-formed content type; None if it isn't."""
    value = value.strip(" \t")
    found = _TYPE.match(value)
    if not found:
        return None
    at, params = found.end(), {}
    while at < len(value):
        more = _PARAM.match(value, at)
        if not more:
            return (found[0].lower(), params) if not value[at:].strip(" \t;") else None
        plain = more[2] if more[2] is not None else re.sub(r"\\(.)", r"\1", more[3])
        params.setdefault(more[1].lower(), plain)
        at = more.end()
    return found[0].lower(), params


def codec_of(label: str) -> str | None:
    return CODECS.get(label.strip("\t\n\f\r ").lower())


def _undefined(error: UnicodeError) -> tuple[str, int]:
    """Bytes that a codec leaves undefined but the standard maps: 0x80 to 0x9F are control characters in
    single-byte encodings."""
    byte = error.object[error.start]
    if error.encoding == "gb18030" and byte == 0x80:
        return EURO, error.start + 1
    if error.encoding == "charmap" and 0x80 <= byte <= 0x9F:
        return chr(byte), error.start + 1
    raise error


codecs.register_error("crawlframe-undefined", _undefined)


def _text(body: bytes, codec: str) -> str:
    """Strictly decoded text; UnicodeError if malformed."""
    if codec == "replacement":
        if body:
            raise UnicodeError("no text in this encoding is read")
        return ""
    if codec == "cp1255":  # single-byte codecs don't name themselves in errors
        return HOLAM_HASER.join(piece.decode(codec, "crawlframe-undefined") for piece in body.split(b"\xca"))
    text = body.decode("latin-1" if codec == "x-user-defined" else codec, "crawlframe-undefined")
    return text.translate(INSTEAD[codec]) if codec in INSTEAD else text


def _inflated(body: bytes) -> bytes | None:
    """All members of a gzip body, one after another (none: empty); None if it is damaged or ends early."""
    out = []
    while body:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(body))
        except zlib.error:
            return None
        if not member.eof:
            return None
        body = member.unused_data
    return b"".join(out)


def decode_body(body: bytes | None, content_type: str, gzipped: bool = False) -> tuple[str | None, str | None]:
    """(text, error). A byte order mark wins over the label; malformed bytes are an error, never replaced."""
    mime = parse_mime(content_type)
    if mime is None:
        return None, "InvalidHeader"
    codec = codec_of(mime[1].get("charset", "utf-8"))
    if codec is None:
        return None, "UnsupportedCharset"
    body = bytes(body or b"")
    if gzipped:
        body = _inflated(body)
        if body is None:
            return None, "Body"
    for mark, by in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            body, codec = body[len(mark) :], by
            break
    try:
        return _text(body, codec), None
    except UnicodeError:
        return None, "MalformedBody"


# ---------------------------------------------------------------- columns


def is_html_column(content_type: Column) -> Column:
    return F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0])).isin("text/html", "application/xhtml+xml")


def status_class_column(status: Column) -> Column:
    """redirect, no-file, success or error, in this order of tests."""
    return (
        F.when(status.isin(301, 302, 303, 307, 308), "redirect")
        .when(status.between(400, 499) & ~status.isin(408, 429), "no-file")
        .when(status.between(200, 299) & (status != 206), "success")
        .otherwise("error")
    )
