"""The one pass over page text: head metadata and JSON-LD nodes, as flat columns.

Reading tags and JSON needs a parser, so this runs in Arrow batches in Python. It only
reads: which node is chosen, which fallback applies and what is refused is all decided
afterwards in Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.functions.batches import in_slices

# Limits on one JSON-LD block, and the names that are read.
MAX_DEPTH = 64
MAX_NODES = 10_000
ARTICLE_TYPES = ("NewsArticle", "Article")
_META_TIMES = ("article:published_time", "article:modified_time")
_JSON_LD = "application/ld+json"

_TEXT_FIELDS = {
    "headline": "headline",
    "date_published": "datePublished",
    "date_modified": "dateModified",
    "description": "description",
    "section": "articleSection",
    "in_language": "inLanguage",
}
_STRING = T.StringType()
_STRINGS = T.ArrayType(_STRING)
CANDIDATE = T.StructType(
    [T.StructField(name, _STRING) for name in ("kind", "main_id", "node_url", *_TEXT_FIELDS)]
    + [T.StructField("authors", _STRINGS), T.StructField("images", _STRINGS)]
)
PAGE_META = T.StructType(
    [
        T.StructField(name, _STRING)
        for name in (
            "html_lang",
            "canonical_href",
            "og_url",
            "og_title",
            "og_description",
            "og_image",
            "meta_published",
            "meta_modified",
            "meta_description",
            "parse_error",
        )
    ]
    + [T.StructField("candidates", T.ArrayType(CANDIDATE))]
)


class _Entries(HTMLParser):
    """All tags with their attributes, and the text of scripts, in page order.

    Nothing is chosen here: an entry is (tag, attributes), or ("", {"text": ...}) for the
    text of the script before it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict[str, str | None]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _READ_TAGS:
            self.found.append((tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.found.append(("/script", {}))

    def handle_data(self, data: str) -> None:
        if self.cdata_elem == "script":
            self.found.append(("", {"text": data}))


def _words(value: str | None) -> str:
    return (value or "").lower()


# Which entries give a head field, under which name, and the attribute with its value.
_FIELD_RULES = {
    "html": (lambda a: "html_lang", "lang"),
    "link": (lambda a: "canonical_href" if "canonical" in _words(a.get("rel")).split() else None, "href"),
    "meta": (lambda a: "meta " + _words(a.get("property") or a.get("name")).strip(), "content"),
}
_READ_TAGS = frozenset({*_FIELD_RULES, "script"})


def _first_fields(entries: list[tuple[str, dict[str, str | None]]]) -> dict[str, str]:
    """The first value of each head field."""
    values: dict[str, str] = {}
    for tag, attributes in reversed(entries):  # earlier entries overwrite later ones
        if tag in _FIELD_RULES:
            name_of, attribute = _FIELD_RULES[tag]
            name, value = name_of(attributes), attributes.get(attribute)
            if name is not None and value is not None:
                values[name] = value
    return values


def _json_blocks(entries: list[tuple[str, dict[str, str | None]]]) -> list[str]:
    """Texts of closed JSON-LD scripts."""
    blocks: list[str] = []
    parts: list[str] | None = None
    for tag, attributes in entries:
        if tag == "script":
            kind = _words(attributes.get("type")).split(";")[0].strip()
            parts = [] if kind == _JSON_LD else parts
        elif parts is not None and tag == "":
            parts.append(attributes["text"] or "")
        elif parts is not None and tag == "/script":
            blocks.append("".join(parts))
            parts = None
    return blocks


class _OverLimit(Exception):
    pass


def _objects(root: object) -> list[dict]:
    """All objects of a decoded block; scalars count towards the limits too."""
    found = []
    level, depth, seen = [root], 0, 0
    while level:
        seen += len(level)
        if seen > MAX_NODES or depth > MAX_DEPTH:
            raise _OverLimit
        below: list[object] = []
        for value in level:
            if isinstance(value, dict):
                found.append(value)
                below.extend(value.values())
            elif isinstance(value, list):
                below.extend(value)
        level, depth = below, depth + 1
    return found


def _clean(value: object) -> str | None:
    """A string that Arrow can hold; other values are null. Lone surrogates become '?'."""
    if not isinstance(value, str):
        return None
    try:
        value.encode("utf-8")
    except UnicodeEncodeError:
        return value.encode("utf-8", "replace").decode("utf-8")
    return value


def _listed(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _field(value: object, keys: tuple[str, ...], usable: Callable[[object], bool]) -> object:
    """A value that is no object as it is; of an object, its first usable member."""
    if not isinstance(value, dict):
        return value
    members = filter(usable, (value.get(key) for key in keys))
    return next(members, None)


def _is_text(value: object) -> bool:
    return isinstance(value, str)


def _strings(values: list) -> list[str]:
    return [text for text in map(_clean, values) if text is not None]


def _candidate(node: dict) -> dict | None:
    types = [name for name in _listed(node.get("@type")) if isinstance(name, str)]
    kind = next((name for name in ARTICLE_TYPES if name in types), None)
    if kind is None:
        return None
    authors = [
        author.get("name") if isinstance(author, dict) else author
        for author in _listed(node.get("author"))
    ]
    row: dict[str, object] = {name: _clean(node.get(key)) for name, key in _TEXT_FIELDS.items()}
    row.update(
        kind=kind,
        main_id=_clean(_field(node.get("mainEntityOfPage"), ("@id", "url"), _is_text)),
        node_url=_clean(_field(node.get("url"), ("@id", "url"), _is_text)),
        authors=_strings(authors),
        images=_strings([_field(image, ("url", "contentUrl"), bool) for image in _listed(node.get("image"))]),
    )
    return row


def read_page(content: str) -> dict:
    """Metadata of one page; ``parse_error`` holds the reason code of a page refused here."""
    head = _Entries()
    row: dict[str, object] = {"candidates": []}
    try:
        head.feed(content)
        candidates = []
        for block in _json_blocks(head.found):
            try:
                nodes = _objects(json.loads(block))
            except (json.JSONDecodeError, RecursionError):
                continue
            candidates.extend(filter(None, map(_candidate, nodes)))
        row["candidates"] = candidates
    except _OverLimit:
        row["parse_error"] = "jsonld_limits"
    except Exception:
        row["parse_error"] = "parser_execution"
    first = {name: _clean(value) for name, value in _first_fields(head.found).items()}
    row.update(
        html_lang=first.get("html_lang"),
        canonical_href=first.get("canonical_href"),
        meta_published=first.get("meta " + _META_TIMES[0]),
        meta_modified=first.get("meta " + _META_TIMES[1]),
        meta_description=first.get("meta description"),
    )
    for name in ("url", "title", "description", "image"):
        row["og_" + name] = first.get("meta og:" + name)
    return row


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, _arrow(field.dataType)) for field in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return pa.string()


@F.arrow_udf(PAGE_META)
def _page_meta(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = _arrow(PAGE_META)
    for contents in batches:
        yield from in_slices(lambda text: None if text is None else read_page(text), kind, contents)
        del contents  # before the next batch is read


def page_meta(content: Column) -> Column:
    """Struct of ``PAGE_META`` fields; null for null content."""
    return _page_meta(content)


def needs_pass(content: Column) -> Column:
    """False only for pages certain to hold no JSON-LD and certain to be readable.

    Looking for the media type instead would be wrong: it may be entity-encoded. The
    other two constructs are those that the tag reader can refuse.
    """
    return content.rlike(r"(?i)<script|<!\[|&#[0-9]{4300}")


def first_values(entries: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """First value per key of a metadata table, e.g. per page and property."""
    return entries.groupBy(*key).agg(F.min_by(value, order).alias(value))
