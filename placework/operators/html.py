"""Page HTML -> element tree.

The tree is one array of nodes per page, in document order, so everything below an element is a
slice of the array and an extractor needs no join and no shuffle. `html_nodes` gives the same as one row
per node.

Rules for broken HTML: void tags never nest; a block start closes an open `p` and what is open inside it;
`li`, `td`, `th`, `tr`, `dt`, `dd` and `option` close an open one of their own kind in the same list or table;
`script` and `style` hold raw text; stray end tags are ignored; comments are dropped.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the kernel of this module with the task, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
INLINE_MARKS = frozenset("span i b".split())
# tag -> (tags it closes, tags that stop the search)
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("table td th li html body".split())
P_ONLY = frozenset(["p"])

NODE_TYPE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("end_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("inline_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)

# One token: comment, declaration, script or style with its content, tag. The last group takes a tag whose
# quotes do not close.
_QUOTED = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_HEAD = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
_NAME = r"<(/?)([a-z][^\s/>]*)"
_TOKEN = re.compile(
    rf"{_HEAD}|<(script|style)(?=[\s>])({_QUOTED})>(.*?)(?:</\1\s*>|\Z)|{_NAME}(?:({_QUOTED})>|([^>]*)>)", re.S | re.I
)
# Used for the rest of a page after a tag with unclosed quotes, so that no page is scanned over and over.
_LOOSE_TOKEN = re.compile(
    rf"{_HEAD}|<(script|style)(?=[\s>])([^>]*)>(.*?)(?:</\1\s*>|\Z)|{_NAME}()([^>]*)>", re.S | re.I
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class _Nodes:
    """Node columns of a batch of pages."""

    def __init__(self) -> None:
        self.offsets = [0]
        self.parent, self.end, self.depth, self.inline = [], [], [], []
        self.tag, self.text = [], []
        self.attr_offsets, self.attr_names, self.attr_values = [0], [], []
        self.open: list[tuple[str, int]] = []
        self.open_count: Counter[str] = Counter()

    def _add(self, tag: str, text: str | None = None, source: str | None = None) -> int:
        """Append a node and return its index in the batch."""
        at, base, opened = len(self.tag), self.offsets[-1], self.open
        parent = opened[-1][1] if opened else None
        inline = None if parent is None else self.inline[parent]
        if inline is None and tag in INLINE_MARKS:
            inline = at - base + 1
        self.parent.append(None if parent is None else parent - base + 1)
        self.end.append(at - base + 1)
        self.depth.append(len(opened))
        self.inline.append(inline)
        self.tag.append(tag)
        self.text.append(text)
        if source:
            first = len(self.attr_names)
            for name, double, single, bare in _ATTRIBUTE.findall(source):
                name = name.lower()
                if name not in self.attr_names[first:]:
                    value = double or single or bare
                    self.attr_names.append(name)
                    self.attr_values.append(unescape(value) if "&" in value else value)
        self.attr_offsets.append(len(self.attr_names))
        return at

    def _close_from(self, depth: int) -> None:
        last = len(self.tag) - self.offsets[-1]
        for tag, at in self.open[depth:]:
            self.end[at] = last
            self.open_count[tag] -= 1
        del self.open[depth:]

    def _close_nearest(self, kinds, stops) -> None:
        if not any(self.open_count[kind] for kind in kinds):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][0]
            if tag in kinds:
                self._close_from(depth)
                return
            if tag in stops:
                return

    def _start(self, tag: str, source: str | None) -> None:
        if tag in BLOCK:
            self._close_nearest(P_ONLY, P_SCOPE)
        if tag in CLOSES:
            self._close_nearest(*CLOSES[tag])
        at = self._add(tag, None, source)
        if tag not in VOID:
            self.open.append((tag, at))
            self.open_count[tag] += 1

    def add_page(self, html: str | None) -> None:
        html = html or ""
        pos, pattern = 0, _TOKEN
        # Nothing after the last `>` can be a tag.
        stop = html.rfind(">") + 1
        while match := pattern.search(html, pos, stop):
            if match.start() > pos:
                self._add_text(html[pos : match.start()])
            pos = match.end()
            raw, raw_source, content, slash, name, source, loose = match.groups()
            if raw:
                self._start(raw.lower(), raw_source)
                if match.end(3) == pos:
                    # Not closed: the rest of the page is its content.
                    content, pos = html[match.start(3) :], len(html)
                if content:
                    self._add("#raw", content)
                self._close_from(len(self.open) - 1)
            elif name:
                if slash:
                    self._close_nearest((name.lower(),), ())
                else:
                    self._start(name.lower(), loose if source is None else source or loose)
                if source is None:
                    pattern = _LOOSE_TOKEN
            elif match.group().startswith("<!--") and not match.group().endswith("-->"):
                pos = len(html)
        if pos < len(html):
            self._add_text(html[pos:])
        self._close_from(0)
        self.offsets.append(len(self.tag))

    def _add_text(self, text: str) -> None:
        self._add("#text", unescape(text) if "&" in text else text)

    def array(self) -> pa.Array:
        counts = pa.array(self.offsets, pa.int32())
        numbers = [n - base + 1 for base, top in zip(self.offsets, self.offsets[1:]) for n in range(base, top)]
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()),
            pa.array(self.attr_names, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        integers = [pa.array(c, pa.int32()) for c in (numbers, self.parent, self.end, self.depth, self.inline)]
        strings = [pa.array(self.tag, pa.string()), attrs, pa.array(self.text, pa.string())]
        nodes = pa.StructArray.from_arrays([*integers, *strings], names=NODE_TYPE.names)
        return pa.ListArray.from_arrays(counts, nodes)


# An output batch is closed when it holds this many nodes, whatever the size of the input batch.
NODES_PER_BATCH = 200_000


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html_at = batch.schema.get_field_index("html")
        kept = [i for i in range(batch.num_columns) if i != html_at]
        names = [batch.schema.names[i] for i in kept]
        nodes, start = _Nodes(), 0
        for row in range(batch.num_rows):
            nodes.add_page(batch.column(html_at)[row].as_py())
            if nodes.offsets[-1] >= NODES_PER_BATCH or row == batch.num_rows - 1:
                part = [batch.column(i).slice(start, row + 1 - start) for i in kept]
                yield pa.RecordBatch.from_arrays([*part, nodes.array()], names=[*names, "nodes"])
                nodes, start = _Nodes(), row + 1


def html_trees(pages: DataFrame) -> DataFrame:
    """Pages with `html` replaced by `nodes`; select only the columns you need before."""
    schema = T.StructType([f for f in pages.schema.fields if f.name != "html"])
    schema = schema.add("nodes", T.ArrayType(NODE_TYPE))
    return pages.mapInArrow(_parse_batches, schema)


def html_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per node; text pieces are nodes with tag `#text`, script and style content `#raw`."""
    trees = html_trees(pages.select(key, "html"))
    return trees.select(key, F.inline("nodes"))
