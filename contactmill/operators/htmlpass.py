"""The one Python pass of the package: read the structure of a page.

Spark has no HTML functions. This map-only pass turns each page into its visible text, its
links and the raw places where an address may be written. It judges nothing: patterns, checks,
order and limits are Column expressions applied to its output.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from contactmill.functions import fixed_values as fv

# Ship this code with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(fv)

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINK = _row(pos=_I, href=_S, url=_S, text=_S, in_nav=_B, in_footer=_B)
HINT = _row(kind=_S, value=_S, context=_S)
# A section is given by its place in the text and markup of the page. Sections may lie inside each
# other, so copies could add up to many times the page.
SECTION = _row(
    kind=_S, rank=_I, pos=_I, text_from=_I, text_length=_I, markup_from=_I, markup_length=_I
)

# Kinds of address hints in the order they are searched.
HINT_ORDER = {
    kind: rank
    for rank, kind in enumerate(
        ["mailto", "cf", "data", "jsonld", "meta0", "meta1", "meta2", "meta3", "itemprop", "form",
         "recipient", "input"]
    )
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript svg".split())
REGION_TAGS = frozenset(
    value
    for kind, value in fv.NAV_REGIONS + fv.LINK_FOOTER_REGIONS + fv.FOOTER_REGIONS
    if kind == "tag"
)
UNSEEN = frozenset(["title", "template"])
# An opening tag of the key ends an open element of the value.
ENDED_BY = {
    **dict.fromkeys(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
        "main nav ol p pre section table ul".split(),
        frozenset(["p"]),
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_COMMENT_END = re.compile(r"--!?\s*>")


def _matches(tag: str, attrs: dict, selector: tuple[str, str]) -> bool:
    kind, value = selector
    if kind == "tag":
        return tag == value
    have = attrs.get(kind.rstrip("*")) or ""
    if kind == "class":
        return value in have.split()
    return value in have if kind.endswith("*") else have == value


class _Element:
    __slots__ = ("tag", "attrs", "pos", "piece", "text_from", "markup_from", "in_nav", "in_footer", "uses")

    def __init__(self, tag, attrs, pos, piece, text_from, markup_from, in_nav, in_footer, uses):
        self.tag, self.attrs, self.pos, self.piece = tag, attrs, pos, piece
        self.text_from, self.markup_from = text_from, markup_from
        self.in_nav, self.in_footer, self.uses = in_nav, in_footer, uses


class PageReader(HTMLParser):
    """Collects text, links, address hints and sections of one page; never raises on bad markup."""

    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self._base = base
        self.text = self.markup = ""
        self._pieces: list[str] = []
        self._markup: list[str] = []
        self._text_length = self._markup_length = 0
        self.links: list[dict] = []
        self.hints: list[dict] = []
        self.sections: list[dict] = []
        self._open: list[_Element] = []
        self._open_tags: Counter[str] = Counter()
        self._dropped: str | None = None
        self._depth = 0
        self._json_ld: list[str] | None = None
        self._unseen: str | None = None
        self._metas: set[int] = set()
        self._footers = 0
        self._pos = 0
        self._source: str | None = None
        self._last_comment_end = -1

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment that nothing closes goes on to the end of the page."""
        if self._source is not self.rawdata:
            self._source = self.rawdata
            self._last_comment_end = max((m.end() for m in _COMMENT_END.finditer(self.rawdata)), default=-1)
        if i > self._last_comment_end:
            return len(self.rawdata)
        return super().parse_comment(i, report)

    # -- tags -------------------------------------------------------------------------
    def handle_starttag(self, tag: str, pairs: list) -> None:
        attrs = {}
        for name, value in pairs:
            attrs.setdefault(name, value or "")
        self._pos += 1
        if self._dropped:
            self._depth += tag == self._dropped
            return
        if tag in DROPPED:
            self._dropped, self._depth = tag, 1
            if tag == "script" and attrs.get("type") == "application/ld+json":
                self._json_ld = []
            return
        if tag in UNSEEN:
            self._unseen = tag
        if tag == "a" and self._open_tags["a"]:
            self.handle_endtag("a")
        ended = ENDED_BY.get(tag)
        while ended and self._open and self._open[-1].tag in ended:
            self._close_last()
        if attrs:
            self._attribute_hints(tag, attrs)
        self._write_markup(tag, attrs)
        if tag in VOID:
            return
        in_nav = in_footer = False
        if self._open:
            in_nav, in_footer = self._open[-1].in_nav, self._open[-1].in_footer
        uses = []
        if attrs or tag in REGION_TAGS:
            uses = [
                (kind, rank)
                for kind, regions in (("footer", fv.FOOTER_REGIONS), ("contact", fv.CONTACT_REGIONS))
                for rank, selector in enumerate(regions)
                if _matches(tag, attrs, selector)
            ]
            in_nav = in_nav or any(_matches(tag, attrs, s) for s in fv.NAV_REGIONS)
            in_footer = in_footer or any(_matches(tag, attrs, s) for s in fv.LINK_FOOTER_REGIONS)
            self._footers += any(kind == "footer" for kind, _ in uses)
        self._open_tags[tag] += 1
        self._open.append(
            _Element(
                tag, attrs, self._pos, len(self._pieces), self._text_length, self._markup_length,
                in_nav, in_footer, uses,
            )
        )

    def handle_startendtag(self, tag: str, pairs: list) -> None:
        self.handle_starttag(tag, pairs)
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._dropped:
            if tag == self._dropped:
                self._depth -= 1
                if self._depth == 0:
                    self._dropped = None
                    self._end_json_ld()
            return
        if tag == self._unseen:
            self._unseen = None
        if self._open_tags[tag]:
            while self._close_last() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._json_ld is not None:
            self._json_ld.append(data)
        elif not self._dropped and not self._unseen:
            self._pieces.append(data)
            self._text_length += len(data)
            if self._footers:
                self._add_markup(escape(data, quote=False))

    def handle_comment(self, data: str) -> None:
        if self._footers and not self._dropped:
            self._add_markup(f"<!--{data}-->")

    # -- what is collected ---------------------------------------------------------------
    def _hint(self, kind: str, pos: int, value: str, context: str) -> None:
        self.hints.append({"kind": kind, "pos": pos, "value": value, "context": context})

    def _attribute_hints(self, tag: str, attrs: dict) -> None:
        if attrs.get("data-cfemail"):
            self._hint("cf", self._pos, attrs["data-cfemail"], "cloudflare protected")
        data = next((attrs[a] for a in fv.DATA_EMAIL_ATTRIBUTES if attrs.get(a)), None)
        if data:
            self._hint("data", self._pos, data, "data attribute")
        if tag == "meta":
            for rank, selector in enumerate(fv.META_EMAIL_SELECTORS):
                # Only the first element of a meta selector counts, even if it is empty.
                if rank not in self._metas and _matches(tag, attrs, selector):
                    self._metas.add(rank)
                    if attrs.get("content"):
                        self._hint(f"meta{rank}", self._pos, attrs["content"], "meta tag")
        if tag in VOID and attrs.get("itemprop") == "email":
            value = attrs.get("content") or attrs.get("href", "").replace("mailto:", "", 1)
            self._hint("itemprop", self._pos, value, "schema.org itemprop")
        if tag == "form" and attrs.get("action", "").startswith("mailto:"):
            self._hint("form", self._pos, attrs["action"], "form action mailto")
        if tag == "input":
            value = attrs.get("value", "")
            if attrs.get("name") in fv.RECIPIENT_INPUTS and "@" in value:
                self._hint("recipient", self._pos, value, "form recipient field")
            if attrs.get("type") in ("hidden", "text") and "@" in value:
                self._hint("input", self._pos, value, "hidden input")

    def _add_markup(self, part: str) -> None:
        self._markup.append(part)
        self._markup_length += len(part)

    def _write_markup(self, tag: str, attrs: dict) -> None:
        if self._footers:
            inside = "".join(f' {name}="{escape(value)}"' for name, value in attrs.items())
            self._add_markup(f"<{tag}{inside}>")

    def _close_last(self) -> str:
        element = self._open.pop()
        self._open_tags[element.tag] -= 1
        attrs = element.attrs

        def text() -> str:
            return "".join(self._pieces[element.piece :])

        if element.tag == "a" and "href" in attrs:
            self.links.append(
                {
                    "pos": element.pos, "href": attrs["href"],
                    "url": _resolve(self._base, attrs["href"]), "text": text(),
                    "in_nav": element.in_nav, "in_footer": element.in_footer,
                }
            )
            if attrs["href"].startswith("mailto:"):
                self._hint("mailto", element.pos, attrs["href"], text().strip() or "mailto link")
        if attrs.get("itemprop") == "email":
            value = (
                attrs.get("content") or attrs.get("href", "").replace("mailto:", "", 1) or text()
            )
            self._hint("itemprop", element.pos, value, "schema.org itemprop")
        for kind, rank in element.uses:
            self.sections.append(
                {
                    "kind": kind, "rank": rank, "pos": element.pos,
                    "text_from": element.text_from,
                    "text_length": self._text_length - element.text_from,
                    "markup_from": element.markup_from,
                    "markup_length": self._markup_length - element.markup_from if kind == "footer" else 0,
                }
            )
        self._footers -= any(kind == "footer" for kind, _ in element.uses)
        if self._footers:
            self._add_markup(f"</{element.tag}>")
        return element.tag

    def _end_json_ld(self) -> None:
        if self._json_ld is None:
            return
        source, self._json_ld = "".join(self._json_ld), None
        try:
            found = list(_json_ld_emails(json.loads(source)))
        except (ValueError, RecursionError):
            return
        for value in found:
            self._hint("jsonld", self._pos, value, "structured data")

    def finish(self) -> None:
        self.close()
        self._end_json_ld()
        while self._open:
            self._close_last()
        self.text, self.markup = "".join(self._pieces), "".join(self._markup)
        # Elements are met in closing order; everything after wants document order.
        self.links.sort(key=lambda link: link["pos"])
        self.hints.sort(key=lambda hint: (HINT_ORDER[hint["kind"]], hint["pos"]))
        self.sections.sort(key=lambda part: (part["rank"], part["pos"]))


def _resolve(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def _json_ld_emails(root: object) -> Iterator[str]:
    """Address values of a JSON-LD tree in document order, however deep."""
    # Nodes are (None, value), fields are (key, value); the next one to read is last.
    todo: list[tuple[str | None, object]] = [(None, root)]
    while todo:
        key, value = todo.pop()
        if isinstance(value, list):
            todo.extend((None, item) for item in reversed(value))
        elif isinstance(value, dict):
            todo.extend((name.lower(), item) for name, item in reversed(value.items()))
            if isinstance(value.get("@graph"), list):
                todo.extend((None, item) for item in reversed(value["@graph"]))
        elif key is not None and isinstance(value, str):
            if "email" in key or key == "mail":
                cleaned = value.replace("mailto:", "", 1).strip()
                if "@" in cleaned:
                    yield cleaned
            elif key in ("sameas", "url", "href") and value.startswith("mailto:"):
                yield value[len("mailto:") :].split("?")[0]


def read_page(html: str | None, base: str | None = None) -> PageReader:
    reader = PageReader(base or "")
    try:
        reader.feed(html or "")
        reader.finish()
    except AssertionError:  # the standard parser's answer to a broken "<![...": read it as text
        reader = PageReader(base or "")
        reader.feed((html or "").replace("<![", "&lt;!["))
        reader.finish()
    return reader


def parse_pages(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """Replace the ``html`` column by ``text``, ``markup``, ``links``, ``hints`` and ``sections``.

    ``text`` is the visible text as written; ``markup`` the inside of the footers.

    ``base`` names the column that relative links are resolved against.
    Narrow and map-only: no shuffle, one page in memory at a time besides its Arrow batch.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    added = [
        T.StructField("text", T.StringType()),
        T.StructField("markup", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("hints", T.ArrayType(HINT)),
        T.StructField("sections", T.ArrayType(SECTION)),
    ]
    schema = T.StructType(kept + added)
    kept_names = [f.name for f in kept]
    kinds = {f.name: to_arrow_type(f.dataType) for f in added}

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers = [
                read_page(source, root)
                for source, root in zip(
                    batch.column(html).to_pylist(), batch.column(base).to_pylist(), strict=True
                )
            ]
            columns = {name: batch.column(name) for name in kept_names}
            for name in ("text", "markup", "links", "hints", "sections"):
                # Keys that only served the order, as the position of a hint, are left out.
                columns[name] = pa.array([getattr(r, name) for r in readers], kinds[name])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return pages.mapInArrow(read_batches, schema)
