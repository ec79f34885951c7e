"""Text expressions: cleaning, titles, hashes, links and excerpts."""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRIMMED = " \t\n\r\0\x0b"
# Names of fields that are never indexed, and of blocks and field types by their handling.
SECRET = r"(?i)key|secret|token|password|passwort"
SKIP_PAGE_FIELDS = ["uuid", "template", "slug", "num", "sort", "search_exclude"]
SKIP_BLOCK_FIELDS = ["bgcolor", "color", "defaultopen", "icon", "id", "ishidden", "lighttext", "showvisualizer", "theme"]
CODE_BLOCKS = ["code", "codeembed"]
PROSE_TYPES = ["markdown", "textarea", "writer"]
PLAIN_TYPES = ["list", "multiselect", "select", "tags", "text"]
RELATION_TYPES = ["link", "page", "pages"]
NESTED_TYPES = ["object", "structure"]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def chunk_normalized(text: Column) -> Column:
    """Line feeds only, single spaces, no spaces round line feeds, at most one blank line, trimmed."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, " *\n *", "\n")
    return trimmed(F.regexp_replace(t, "\n{3,}", "\n\n"))


def with_title(title: Column, piece: Column) -> Column:
    """The piece under its title, unless there is none or the piece begins with it."""
    t = trimmed(title)
    return F.when((t == "") | F.startswith(piece, t), piece).otherwise(F.concat(t, F.lit("\n\n"), piece))


def content_hash(title: Column, text: Column) -> Column:
    return F.sha1(F.concat(title, F.lit("\n"), text).cast("binary"))


def page_key(uuid: Column, page_id: Column) -> Column:
    return F.coalesce(F.nullif(uuid, F.lit("")), F.concat(F.lit("page-id://"), page_id))


def absolute_url(base: str, url: Column) -> Column:
    if not base:
        return url
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(url, F.lit("/"))))


def excerpt(text: Column, most: int = 1600) -> Column:
    t = F.regexp_replace(text, r"[\s\p{Z}]+", " ")
    t = trimmed(t)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…")))


def site_query(query: Column, sites: list[str]) -> Column:
    """The query without site: terms, limited to these sites."""
    plain = F.trim(F.regexp_replace(query, r"\s*site:\S+", ""))
    names = [re.sub(r"^https?://", "", s).rstrip("/") for s in sites]
    return F.concat(plain, F.lit(" (" + " OR ".join(f"site:{n}" for n in names) + ")")) if names else plain


def lines(text: Column) -> Column:
    """The trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\r\n|\n|\r"), trimmed), lambda x: x != "")


def allowed_field(name: Column) -> Column:
    return ~name.rlike(SECRET) & ~name.isin(SKIP_PAGE_FIELDS)


def first_label(labels: Column) -> Column:
    """The German label of a map, or its first, or none."""
    return F.coalesce(F.try_element_at(labels, F.lit("de")), F.get(F.map_values(labels), F.lit(0)), F.lit(""))


def labelled(label: Column, value: Column) -> Column:
    return F.when(value == "", "").when(F.coalesce(label, F.lit("")) == "", value).otherwise(F.concat(label, F.lit(": "), value))


def first_summary(*fields: Column, most: int = 500) -> Column:
    """The first field with text that isn't a list or an object, cut to `most` characters."""
    good = [F.when((trimmed(f) != "") & ~F.ltrim(f).rlike(r"^[\[{]"), trimmed(f)) for f in fields]
    return F.substring(F.coalesce(*good), 1, most)


def blocks_text(blocks: Column) -> Column:
    """The text of an array of structs (type, hidden, parts: array of strings): hidden and code blocks are left out."""
    shown = F.filter(blocks, lambda b: ~b["hidden"] & ~b["type"].isin(CODE_BLOCKS))
    texts = F.transform(shown, lambda b: F.array_join(F.filter(b["parts"], lambda p: trimmed(p) != ""), "\n"))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


_BREAK = re.compile(r"<\s*(?:br\s*/?|/(?:p|h[1-6]|li|div)\s*)[^>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z!?][^<>]*(?:>|$)", re.S)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def clean_html(markup: str) -> str:
    """Text of markup: breaks become line feeds, tags go, whole entities are decoded, white space is gathered."""
    text = _TAG.sub("", _BREAK.sub("\n", markup))
    text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text))
    return text.strip(TRIMMED)


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _ENTITY.sub(lambda m: html.unescape(m[0]), t) if "&" in t else t, na_action="ignore")


def html_text(markup: Column) -> Column:
    """`clean_html` as an expression: patterns run in Spark, once a row, and only entities, for which it has no function, are decoded in Python."""
    text = F.regexp_replace(F.regexp_replace(markup, "(?i)" + _BREAK.pattern, "\n"), "(?s)" + _TAG.pattern, "")
    return chunk_normalized(_decoded(text))


def keyed_hash(secret: str, value: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal; a null or empty value counts as "unknown"."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    text = F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)


#: German names of the months.
MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]


def day_text(date: Column) -> Column:
    """A date as day.month.year."""
    return F.date_format(date, "dd.MM.yyyy")


def long_day_text(date: Column) -> Column:
    """A date as its day, the German name of its month and its year."""
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date)), F.lit(" "), F.year(date).cast("string"))


def raw_url(text: Column) -> Column:
    """Percent-encoding of all but letters, digits, '-', '_', '.' and '~'."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base64_text(text: Column) -> Column:
    return F.replace(F.replace(F.base64(text.cast("binary")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def normalized_url(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the end of the path, no fragment; what is no address only loses slashes at its end."""
    t = F.rtrim(F.trim(url), F.lit("/"))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#@]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    scheme, user, host, path, query = (F.regexp_extract(t, pattern, k) for k in range(1, 6))
    whole = F.concat(F.lower(scheme), F.lit("://"), user, F.lower(host), F.rtrim(path, F.lit("/")), query)
    return F.when(t.rlike(pattern), whole).otherwise(t)


def index_fingerprint(base_url: Column, dimensions: Column, model: Column, chunk_chars: Column, overlap: Column, extractor: int = 2) -> Column:
    """What makes stored chunks comparable, as a hash of its JSON. Names and models are taken as ASCII."""
    parts = [
        ("embedding_base_url", _json(normalized_url(base_url))), ("embedding_dimensions", dimensions.cast("string")), ("embedding_model", _json(model)),
        ("extractor_version", F.lit(str(extractor))), ("chunk_chars", chunk_chars.cast("string")), ("chunk_overlap", overlap.cast("string")),
    ]
    fields = [F.concat(F.lit(f'"{name}":'), value) for name, value in parts]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).cast("binary"), 256)


def _json(text: Column) -> Column:
    """A string as JSON without escapes of slashes or letters."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
