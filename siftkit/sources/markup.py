"""Selecting attributes and text from HTML as it is found (unclosed, nested and misplaced tags).

A scanner walks a page's tags once and keeps the stack of open elements.  A selector is a
path of steps, each a child or a descendant of the one before, with a tag name and tests on
attributes; on the stack every element carries how many steps of each selector end at it, so
all selectors are matched in the one walk.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']|["'])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, and
# which open elements a start tag ends, up to which enclosing ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
ENDS_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hr main menu nav ol p pre section table ul""".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "option": ("option", ("select",)), "tr": ("tr", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
} | {tag: ("p", ("td", "th", "li", "div", "article", "section", "button", "table")) for tag in ENDS_P}


@dataclass(frozen=True)
class Step:
    """An element by tag name; ``deep``: any descendant, else a child of the step before.

    ``equal``: attributes with exactly these values; ``holds``: attributes whose value contains
    the text; ``without``: attributes that must be absent.
    """
    tag: str
    deep: bool = False
    equal: tuple[tuple[str, str], ...] = ()
    holds: tuple[tuple[str, str], ...] = ()
    without: tuple[str, ...] = ()

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        return (tag == self.tag and all(attributes.get(k) == v for k, v in self.equal)
                and all(v in attributes.get(k, "") and k in attributes for k, v in self.holds)
                and not any(k in attributes for k in self.without))


@dataclass(frozen=True)
class Selector:
    """What to take from the elements that ``steps`` lead to: an attribute, or their text nodes.

    ``text``: ``own`` takes an element's own text nodes, ``all`` those of its descendants too.
    """
    steps: tuple[Step, ...]
    attribute: str | None = None
    text: str = "own"


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


class _Open:
    """An open element: per selector the steps that end at it, and those that end at it or above it."""
    __slots__ = ("tag", "here", "above")

    def __init__(self, tag: str, here: list[int], above: list[int]):
        self.tag, self.here, self.above = tag, here, above  # bit k: the first k steps fit


def _enter(parent: _Open, tag: str, attributes: dict[str, str], selectors: Sequence[Selector]) -> _Open:
    here, above = [], []
    for s, h, a in zip(selectors, parent.here, parent.above):
        bits = 0
        for k, step in enumerate(s.steps):
            if (a if step.deep else h) >> k & 1 and step.fits(tag, attributes):
                bits |= 2 << k
        here.append(bits)
        above.append(a | bits)
    return _Open(tag, here, above)


def select(html: str, selectors: Sequence[Selector]) -> list[list[str]]:
    """For each selector what it finds, in document order.  Text nodes end at tags and comments."""
    out: list[list[str]] = [[] for _ in selectors]
    root = _Open("", [1] * len(selectors), [1] * len(selectors))
    stack, at, end = [root], 0, len(html)
    last = [1 << len(s.steps) for s in selectors]

    def text(piece: str) -> None:
        if piece:
            top, piece = stack[-1], unescape(piece)
            for s, bit, h, a, found in zip(selectors, last, top.here, top.above, out):
                if s.attribute is None and (a if s.text == "all" else h) & bit:
                    found.append(piece)

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            break
        text(html[at:m.start()])
        at = m.end()
        closing, name, rest = m.groups()
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        ended, borders = CLOSES.get(tag, ("", ()))
        if ended:
            ended = ended.split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in borders:
                    break
        attributes = _attributes(rest)
        element = _enter(stack[-1], tag, attributes, selectors)
        for s, bit, h, found in zip(selectors, last, element.here, out):
            if s.attribute is not None and h & bit and s.attribute in attributes:
                found.append(attributes[s.attribute])
        if tag in VOID or rest.rstrip().endswith("/") and tag not in RAW:
            continue
        stack.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            text(html[at:close.start() if close else end]) if tag in ("title", "textarea") else None
            at = close.end() if close else end
            stack.pop()
    text(html[at:])
    return out


def with_selected(pages: DataFrame, selectors: dict[str, Selector], html: str = "html") -> DataFrame:
    """``pages`` with one array<string> column a selector, batch by batch; a null page finds nothing."""
    schema = StructType([*pages.schema.fields, *(StructField(name, ArrayType(StringType())) for name in selectors)])
    paths = list(selectors.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [select(page.as_py() or "", paths) for page in batch.column(html)]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in range(len(paths))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *selectors])

    return pages.mapInArrow(run, schema)
