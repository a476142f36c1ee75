"""Main text of web pages by a tree-structured graphical model over the DOM.

Every node of a page's tree (elements and text) has a hidden state, main text or not. A node's potential comes from its
tag, the words in its class, id and role, and how long and how linked the text below it is; a potential between
parent and child, by kind of child, says how states go on downwards. Sum-product messages upwards from the leaves and downwards from
the root give the exact probability of each state. An only child has its parent's state: what is nested in one another
is one thing, however deep. The weights are fitted to labelled pages by the gradient of their
likelihood: observed minus expected counts, from the same messages.

Messages of all pages of a batch go together, one depth at a time.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from placework.operators.html import html_trees

from .labelled_pages import labelled_pages

# Elements that begin and end a block of text; `br` and cells separate text too.
_BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 head header hr html iframe input label legend li main nav noscript ol option p pre script section "
    "select style summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
_NEVER = frozenset("#raw script style noscript template head title iframe svg textarea select option button".split())
# Kinds of children for the parent-child potentials.
_KINDS = {"#text": 1, **dict.fromkeys("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody tr td th figure figcaption br".split(), 2), **dict.fromkeys("b i em strong span code a u small sub sup font label".split(), 3), **dict.fromkeys("article main".split(), 4), "div": 6, "section": 7, **dict.fromkeys("nav header footer aside form script style".split(), 5)}
_KIND_COUNT = 8
# States of an only child and its parent that differ are ruled out.
_SAME = np.array([[0.0, -1e9], [-1e9, 0.0]])
_LENGTHS = np.array([1, 10, 25, 60, 120, 250, 600])
_LINKED = np.array([0.01, 0.1, 0.3, 0.6, 0.9])
NODES_TOGETHER = 100_000
_WORD = re.compile(r"[a-z]+")


@dataclasses.dataclass
class Trees:
    """Nodes of a batch of pages as columns; positions count through the batch."""

    page: np.ndarray
    parent: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    tags: np.ndarray
    texts: list
    only: np.ndarray
    features: list[np.ndarray]
    attributes: list[tuple[int, str, str]]
    pages: int


def name_words(value: str) -> list[str]:
    """The words of a class, id or role, and each name that is put together of several: `ad-free` is not `ad`."""
    names = [n for n in value.split() if not _WORD.fullmatch(n)]
    return [w for n in value.split() for w in ([n] if n in names else []) + _WORD.findall(n)]


def read_trees(nodes: pa.ListArray, weights_of: dict[str, int]) -> Trees:
    offsets = nodes.offsets.to_numpy()
    flat = nodes.flatten()
    counts = np.diff(offsets)
    base = np.repeat(np.cumsum(counts) - counts, counts)
    field = lambda name: flat.field(flat.type.get_field_index(name))
    parent = field("parent_id").fill_null(0).to_numpy() - 1 + base
    parent[field("parent_id").is_null().to_numpy(zero_copy_only=False)] = -1
    end = field("end_id").to_numpy() - 1 + base
    depth = field("depth").to_numpy()
    tags = np.array(field("tag").to_pylist(), object) if len(flat) else np.zeros(0, object)
    text = field("text")
    lengths = pc.utf8_length(pc.utf8_trim_whitespace(text)).fill_null(0).to_numpy()
    n = len(tags)

    # Attributes of interest: their owner, name and value.
    maps = field("attrs")
    names, values = maps.keys, maps.items
    wanted = np.flatnonzero(pc.is_in(names, pa.array(["class", "id", "role", "data-main"])).to_numpy(zero_copy_only=False)) if len(names) else []
    owner = np.searchsorted(maps.offsets.to_numpy(), wanted, "right") - 1 if len(wanted) else []
    attributes = [(int(o), names[int(k)].as_py(), (values[int(k)].as_py() or "").lower()) for o, k in zip(owner, wanted)]

    # Nodes without a sibling that says anything (white space says nothing).
    said = (tags != "#text") | (lengths > 0)
    siblings = np.bincount(parent[(parent >= 0) & said], minlength=n) if n else np.zeros(0, np.int64)
    # The page as a whole is no thing of that kind.
    only = (parent >= 0) & said & (siblings[parent] == 1) & ~np.isin(tags[parent], ["html", "body"])

    # Text below a node, and how much of it is inside links.
    total = np.concatenate([[0], np.cumsum(lengths)])
    linked = np.zeros(n + 1, np.int64)
    links = np.flatnonzero(tags == "a")
    np.add.at(linked, links, 1)
    np.add.at(linked, end[links] + 1, -1)
    in_link = np.concatenate([[0], np.cumsum(lengths * (np.cumsum(linked)[:n] > 0))])
    at = np.arange(n)
    below = total[end + 1] - total[at]
    share = (in_link[end + 1] - in_link[at]) / np.maximum(below, 1)

    def number(name):
        return weights_of.get(name, -1)

    is_text = tags == "#text"
    # How long and how linked the text below is says something of blocks; a link or a bold run takes after its block.
    inline = np.array([_KINDS.get(t, 0) in (1, 3) for t in tags], bool)
    tag_number = {t: number(f"tag {t}") for t in set(tags.tolist())}
    under = {t: number(f"in {t}") for t in tag_number}
    plain = {t: number(f"plain {t}") for t in tag_number}
    named = np.zeros(n, bool)
    named[[o for o, name, _ in attributes if name != "data-main"]] = True
    # A wrapper in a wrapper adds to its parent's features nothing but its names; where other elements without a name stand
    # says more than their tag.
    wrapper = only & np.array([t in ("div", "span") for t in tags], bool)
    inline |= wrapper
    skipped = named | is_text | wrapper
    features = [
        np.where(wrapper, -1, np.array([tag_number[t] for t in tags], np.int64)),
        np.array([under[tags[p]] if p >= 0 and x else -1 for p, x in zip(parent, is_text)], np.int64),
        np.array([-1 if skip else plain[t] for t, skip in zip(tags, skipped)], np.int64),
        np.array([-1 if skip or p < 0 else number(f"plain {t} in {tags[p]}") for t, p, skip in zip(tags, parent, skipped)], np.int64),
        np.where(inline, -1, number("length 0") + np.searchsorted(_LENGTHS, below, "right")),
        np.where(inline, -1, number("linked 0") + np.searchsorted(_LINKED, share, "right")),
        np.where(is_text, number("text 0") + np.searchsorted(_LENGTHS, lengths, "right"), -1),
    ]
    # Words of class, id and role, and whole names of several words, as (node, weight) pairs.
    found = [(o, number(f"word {w}")) for o, name, value in attributes if name != "data-main" for w in name_words(value)]
    found = [f for f in found if f[1] >= 0]
    features.append(np.array(found, np.int64).reshape(-1, 2))
    return Trees(np.repeat(np.arange(len(counts)), counts), parent, end, depth, tags, text, only, features, attributes, len(counts))


def _potentials(trees: Trees, weights: np.ndarray) -> np.ndarray:
    """Log potential of state main against the other one."""
    padded = np.append(weights, 0.0)
    out = sum(padded[f] for f in trees.features[:-1])
    pairs = trees.features[-1]
    return out + np.bincount(pairs[:, 0], padded[pairs[:, 1]], len(trees.tags)) if len(pairs) else out


def _normal(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def sum_product(trees: Trees, weights: np.ndarray, edges: np.ndarray):
    """Probability of main text of each node, and the joint of (parent, child) states of each node with a parent.

    edges: log potentials by kind of child, state of the parent, state of the child.
    """
    n = len(trees.tags)
    own = np.stack([np.zeros(n), _potentials(trees, weights)], axis=1)
    kinds = np.array([_KINDS.get(t, 0) for t in trees.tags], np.int64)
    kinds[trees.only] = _KIND_COUNT
    edges = np.concatenate([edges, _SAME[None]])
    order = np.argsort(trees.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(trees.depth[order])) + 1) if n else []
    up = np.zeros((n, 2))  # message to the parent, by state of the parent
    inside = own.copy()  # own potential and messages from below
    for level in reversed(levels):
        level = level[trees.parent[level] >= 0]
        if len(level):
            up[level] = np.logaddexp.reduce(edges[kinds[level]] + inside[level][:, None, :], axis=2)
            for state in (0, 1):
                np.add.at(inside[:, state], trees.parent[level], up[level, state])
    belief = inside.copy()
    joint = np.zeros((n, 2, 2))
    for level in levels:
        level = level[trees.parent[level] >= 0]
        if len(level):
            outside = belief[trees.parent[level]] - up[level]
            both = outside[:, :, None] + edges[kinds[level]] + inside[level][:, None, :]
            both = _normal(both.reshape(-1, 4)).reshape(-1, 2, 2)
            joint[level] = np.exp(both)
            belief[level] = np.logaddexp.reduce(both, axis=1)
    return np.exp(_normal(belief))[:, 1] if n else np.zeros(0), joint, kinds


@dataclasses.dataclass
class TreeModel:
    weights_of: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def _labels(trees: Trees) -> np.ndarray:
    labels = np.zeros(len(trees.tags), np.int64)
    for node, name, value in trees.attributes:
        if name == "data-main":
            labels[node : trees.end[node] + 1] = int(value)
    # What holds a single thing is that thing.
    for node in np.flatnonzero(trees.only)[::-1].tolist():
        labels[trees.parent[node]] = labels[node]
    return labels


def train_tree_model(nodes: pa.ListArray, rounds: int = 150, rate: float = 0.15, decay: float = 3e-4) -> TreeModel:
    """Fit to the trees of labelled pages (attribute data-main)."""
    flat = nodes.flatten()
    tags = sorted(set(flat.field(flat.type.get_field_index("tag")).to_pylist()))
    first = read_trees(nodes, {})
    words = sorted({w for _, name, value in first.attributes if name != "data-main" for w in name_words(value)})
    pairs = sorted({f"plain {t} in {first.tags[p]}" for t, p in zip(first.tags, first.parent) if p >= 0 and t != "#text"})
    names = pairs + [f"tag {t}" for t in tags] + [f"in {t}" for t in tags] + [f"plain {t}" for t in tags] + [f"word {w}" for w in words]
    names += [f"length {k}" for k in range(len(_LENGTHS) + 1)] + [f"text {k}" for k in range(len(_LENGTHS) + 1)] + [f"linked {k}" for k in range(len(_LINKED) + 1)]
    weights_of = {name: k for k, name in enumerate(names)}
    trees = read_trees(nodes, weights_of)
    y = _labels(trees)
    size = len(names)
    flat_weights = np.zeros(size + _KIND_COUNT * 4)
    moment = [np.zeros_like(flat_weights), np.zeros_like(flat_weights)]
    child = np.flatnonzero(trees.parent >= 0)
    for step in range(1, rounds + 1):
        p, joint, kinds = sum_product(trees, flat_weights[:size], flat_weights[size:].reshape(_KIND_COUNT, 2, 2))
        miss = y - p
        g = np.zeros(size + 1)
        for f in trees.features[:-1]:
            g += np.bincount(np.where(f < 0, size, f), miss, size + 1)
        pairs = trees.features[-1]
        g += np.bincount(pairs[:, 1], miss[pairs[:, 0]], size + 1)
        seen = np.zeros_like(joint)
        seen[child, y[trees.parent[child]], y[child]] = 1
        ge = np.zeros((_KIND_COUNT + 1, 2, 2))
        np.add.at(ge, kinds[child], (seen - joint)[child])
        ge = ge[:_KIND_COUNT]
        grad = np.concatenate([g[:size], ge.ravel()]) / trees.pages - decay * flat_weights
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        flat_weights += rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return TreeModel(weights_of, flat_weights[:size], flat_weights[size:].reshape(_KIND_COUNT, 2, 2))


def page_texts(trees: Trees, main: np.ndarray) -> list[str]:
    """Texts of the pages from the text nodes of main text; a block that begins or ends between two of them parts them."""
    n = len(trees.tags)
    blocks = np.array([t in _BLOCKS for t in trees.tags], bool)
    begun = np.cumsum(blocks) if n else np.zeros(0, np.int64)
    ended = np.cumsum(np.bincount(trees.end[blocks], minlength=n)) if n else begun
    kept = np.flatnonzero(main & (trees.tags == "#text"))
    out: list[list[str]] = [[] for _ in range(trees.pages)]
    last, last_page = -1, -1
    for node in kept.tolist():
        page = int(trees.page[node])
        if page != last_page:
            last_page = page
        elif begun[node] > begun[last] or ended[node - 1] > (ended[last - 1] if last else 0):
            out[page].append(" ")
        out[page].append(trees.texts[node].as_py() or "")
        last = node
    return [" ".join("".join(parts).split()) for parts in out]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to NODES_TOGETHER nodes; a larger page is a part of its own."""
    ends = batch.column(batch.schema.get_field_index("nodes")).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + NODES_TOGETHER, "right")) - 1)
        # A slice keeps the offsets of the whole, so it is copied.
        yield pa.Table.from_batches([batch.slice(at, to - at)]).take(pa.array(range(to - at))).combine_chunks().to_batches()[0]
        at = to


def fit_main_text(spark) -> TreeModel:
    """The model of the labelled pages, trained on the driver; their number is fixed."""
    pages = spark.createDataFrame([(k, page) for k, page in enumerate(labelled_pages())], "page_id int, html string")
    nodes = html_trees(pages).toArrow().combine_chunks().column("nodes")
    return train_tree_model(nodes.chunk(0) if isinstance(nodes, pa.ChunkedArray) else nodes)


def extract_main_text(pages: DataFrame, model: TreeModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null and empty html, and pages without main text, give an empty text. Character references are decoded, white space
    (as in Unicode) inside a block becomes one space, blocks are joined by one space; nothing else is changed and nothing
    is cut. Repeated rows get a row each; an empty table gives an empty result; other columns are ignored.
    """
    model = model or fit_main_text(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            trees = read_trees(batch.column(batch.schema.get_field_index("nodes")), model.weights_of)
            p, _, _ = sum_product(trees, model.weights, model.edges)
            never = np.zeros(len(trees.tags) + 1, np.int64)
            for node in np.flatnonzero([t in _NEVER for t in trees.tags]).tolist():
                never[node] += 1
                never[trees.end[node] + 1] -= 1
            texts = page_texts(trees, (p >= threshold) & (np.cumsum(never)[:-1] == 0))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    return html_trees(pages.select("page_id", "url", "html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


