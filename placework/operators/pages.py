"""Extractors over page trees (see `html.html_trees`).

All of them are expressions on the node array of one page: no join, no shuffle, one output row per page
or per found item. Parse once, write the trees or persist them, and run many extractors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import dms_to_degrees
from ..functions.text import (
    content_key,
    decimals_in,
    is_quality_line,
    price_mention,
    slugify,
    squash_spaces,
    strip_punctuation,
)
from ..functions.web import large_image

# Labels of a detail page and the text that says a contact is not known.
ADDRESS_LABELS = ("Localitate:", "Comună:", "Judeţ:", "Adresa:", "Cod poştal:")
CONTACT_LABELS = ("Telefon :", "Adresă de e-mail :", "Detalii:")
NOT_OWNED = "NU deţinem"
# The hooks of a listing page.
MAP_HOOK = "map_static_zoom"
ADDRESS_CLASS = "hp_address_subtitle jq_tooltip"
SUMMARY_ID = "summary"
SURROUNDINGS_HOOK = "hp-surroundings-category"
FACILITIES_CLASS = "facilitiesChecklistSection"
OCCUPANCY_CLASS = "occupancy_multiplier_number"
BED_CLASS = "bedroom_bed_type"
IMAGE_CLASS = "hide"
THUMB_HOOK = "hotel_thumbs_sprite"
RESULT_CLASS = "rc"
JSON_LD = "application/ld+json"
LISTING_LD = "struct<priceRange:string,address:struct<streetAddress:string>>"

NODES = "nodes"


def has_class(node: Column, name: str) -> Column:
    """The class attribute is `name` or has it as a token."""
    value = F.element_at(node["attrs"], F.lit("class"))
    return (value == name) | F.array_contains(F.split(F.btrim(value), r"\s+"), name)


def class_contains(node: Column, part: str) -> Column:
    return F.contains(F.element_at(node["attrs"], F.lit("class")), F.lit(part))


def attr(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], F.lit(name))


def find_all(nodes: Column, *tags: str, where=None) -> Column:
    """Nodes with one of the tags, in document order."""
    wanted = (lambda n: n["tag"] == tags[0]) if len(tags) == 1 else (lambda n: n["tag"].isin(*tags))
    if where is None:
        return F.filter(nodes, wanted)
    return F.filter(nodes, lambda n: wanted(n) & F.coalesce(where(n), F.lit(False)))


def first(nodes: Column) -> Column:
    return F.get(nodes, 0)


def below(nodes: Column, node: Column) -> Column:
    """Everything inside an element."""
    return F.slice(nodes, node["node_id"] + 1, node["end_id"] - node["node_id"])


def text_of(nodes: Column, node: Column) -> Column:
    """Text of an element, without script and style content; NULL for a NULL node."""
    pieces = find_all(below(nodes, node), "#text")
    return F.array_join(F.transform(pieces, lambda n: n["text"]), "")


def _key(trees: DataFrame) -> list[str]:
    return [c for c in trees.columns if c != NODES]


def match_elements(
    trees: DataFrame, tag: str, attrs: dict[str, str] | None = None, returned: list | None = None
) -> DataFrame:
    """Elements by tag and attribute values.

    `returned` names attributes, or (attribute, pattern) pairs that give group 1 of the pattern; each
    becomes a column `value_0`, `value_1`, ... Without it the node itself is returned. The page's own
    column `url`, if present, lets callers ask for one page with a filter that reaches the scan.
    """

    def matches(n):
        found = F.lit(True)
        for name, value in (attrs or {}).items():
            found = found & (has_class(n, value) if name == "class" else attr(n, name) == value)
        return found

    hits = trees.select(*_key(trees), F.explode(find_all(F.col(NODES), tag, where=matches)).alias("node"))
    if not returned:
        return hits
    values = []
    for i, item in enumerate(returned):
        if isinstance(item, str):
            value = attr(F.col("node"), item)
        else:
            value = F.nullif(
                F.regexp_extract(F.btrim(attr(F.col("node"), item[0])), item[1], 1), F.lit("")
            )
        values.append(value.alias(f"value_{i}"))
    return hits.select(*_key(trees), F.col("node.node_id").alias("node_id"), *values)


def page_links(trees: DataFrame) -> DataFrame:
    """`href` of every `a` that has one."""
    links = find_all(F.col(NODES), "a", where=lambda n: attr(n, "href").isNotNull())
    return trees.select(
        *_key(trees), F.posexplode(F.transform(links, lambda n: attr(n, "href"))).alias("pos", "href")
    )


def page_images(trees: DataFrame) -> DataFrame:
    """Page url + `/` + `src` of every `img` that has one; needs the column `url`."""
    images = find_all(F.col(NODES), "img", where=lambda n: attr(n, "src").isNotNull())
    sources = F.transform(images, lambda n: attr(n, "src"))
    return trees.select(*_key(trees), F.posexplode(sources).alias("pos", "src")).withColumn(
        "image_url", F.concat("url", F.lit("/"), "src")
    )


def page_title(trees: DataFrame) -> DataFrame:
    """Trimmed title; NULL for a page without one."""
    nodes = F.col(NODES)
    return trees.select(
        *_key(trees),
        F.btrim(text_of(nodes, first(find_all(nodes, "title"))), F.lit(" \t\r\n")).alias("title"),
    )


def metadata(nodes: Column, name: str) -> Column:
    return attr(first(find_all(nodes, "meta", where=lambda n: attr(n, "name") == name)), "content")


def page_metadata(trees: DataFrame, name: str) -> DataFrame:
    return trees.select(*_key(trees), metadata(F.col(NODES), name).alias("content"))


def _cell_text(nodes: Column, cell: Column) -> Column:
    return F.replace(text_of(nodes, cell), F.lit("&nbsp"), F.lit(""))


def page_table(
    trees: DataFrame, value_of: str | list[str] | None = None, skip_cells: int = 0
) -> DataFrame:
    """Rows of the first table: row_no and `cells ARRAY<STRUCT<key, text, value>>`.

    Keys are the slugs of the `th` cells; a cell beyond them has a NULL key. `value` is the attribute `value_of` of the
    cell, else that of its first link; of several names it is a struct with a field for each. Without `value_of`
    it is the `href` of the first link, else the `title` of the cell. `skip_cells` leading cells are left out; then
    empty headings, which stand over them, are none.
    """
    nodes = F.col(NODES)
    table = below(nodes, first(find_all(nodes, "table")))
    heads = F.transform(find_all(table, "th"), lambda n: slugify(text_of(nodes, n)))
    if skip_cells:
        heads = F.filter(heads, lambda k: k != "")
    rows = F.filter(
        F.transform(find_all(table, "tr"), lambda r: find_all(below(nodes, r), "td")), lambda c: F.size(c) > 0
    )

    def value(c):
        link = first(find_all(below(nodes, c), "a"))
        if value_of is None:
            return F.coalesce(attr(link, "href"), attr(c, "title"))
        if isinstance(value_of, str):
            return F.coalesce(attr(c, value_of), attr(link, value_of))
        return F.struct(*[F.coalesce(attr(c, a), attr(link, a)).alias(a) for a in value_of])

    def row_cells(cells):
        kept = F.slice(cells, skip_cells + 1, F.greatest(F.size(cells) - skip_cells, F.lit(0)))
        return F.transform(
            kept,
            lambda c, i: F.struct(
                F.get(F.col("__heads"), i).alias("key"), _cell_text(nodes, c).alias("text"), value(c).alias("value")
            ),
        )

    # The cells are read before the rows are exploded, so that the tree is not copied to every row.
    headed = trees.withColumn("__heads", heads)
    return headed.select(
        *_key(trees), F.posexplode(F.transform(rows, row_cells)).alias("row_no", "cells")
    )


def cell(cells: Column, key: str) -> Column:
    """The last cell under a header."""
    return F.try_element_at(F.filter(cells, lambda c: c["key"] == key), F.lit(-1))


def detail_fields(trees: DataFrame) -> DataFrame:
    """Label/value rows of a detail page, the first row left out.

    county, city: value texts; address, contacts: JSON of the labels present, under their slugs; phone. The
    first row of a label counts; a contact that is said to be unknown is not one.
    """
    nodes = F.col(NODES)
    rows = find_all(nodes, "tr")
    cells = F.transform(
        F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: find_all(below(nodes, r), "td")
    )
    pairs = F.transform(
        F.filter(cells, lambda c: F.size(c) >= 2),
        lambda c: F.struct(
            text_of(nodes, F.get(c, 0)).alias("label"), text_of(nodes, F.get(c, 1)).alias("value")
        ),
    )
    listed = trees.select(*_key(trees), pairs.alias("__pairs"))

    def value(label: str, contact: bool = False) -> Column:
        hit = lambda p: p["label"] == label
        if contact:
            return first(
                F.filter("__pairs", lambda p: hit(p) & ~F.contains(p["value"], F.lit(NOT_OWNED)))
            )["value"]
        return first(F.filter("__pairs", hit))["value"]

    slugs = dict(zip((*ADDRESS_LABELS, *CONTACT_LABELS), DETAIL_SLUGS))
    return listed.select(
        *_key(trees),
        value("Judeţ:").alias("county"),
        value("Localitate:").alias("city"),
        F.to_json(F.struct(*[value(x).alias(slugs[x]) for x in ADDRESS_LABELS])).alias("address"),
        F.to_json(F.struct(*[value(x, True).alias(slugs[x]) for x in CONTACT_LABELS])).alias("contacts"),
        value("Telefon :", True).alias("phone"),
    )


# Slugs of ADDRESS_LABELS and CONTACT_LABELS, in their order.
DETAIL_SLUGS = (
    "localitate",
    "comuna",
    "judet",
    "adresa",
    "cod-postal",
    "telefon",
    "adresa-de-e-mail",
    "detalii",
)


def json_ld(nodes: Column, schema: str = LISTING_LD) -> Column:
    script = first(find_all(nodes, "script", where=lambda n: attr(n, "type") == JSON_LD))
    return F.from_json(first(below(nodes, script))["text"], schema)


def page_json_ld(trees: DataFrame, schema: str = LISTING_LD) -> DataFrame:
    """The first JSON-LD script; its fields are NULL when it is missing or not JSON."""
    return trees.select(*_key(trees), json_ld(F.col(NODES), schema).alias("ld"))


def _section_entries(nodes: Column, sections: Column, heading: str, clean) -> Column:
    """Heading and item texts of each section that has a heading."""
    return F.filter(
        F.transform(
            sections,
            lambda s: F.struct(
                F.btrim(text_of(nodes, first(find_all(below(nodes, s), heading)))).alias("k"),
                F.transform(find_all(below(nodes, s), "li"), lambda li: clean(text_of(nodes, li))).alias("v"),
            ),
        ),
        lambda e: e["k"].isNotNull(),
    )


def _last_by_key(df: DataFrame, column: str) -> DataFrame:
    """Key/value structs (k, v) of a column without repeated keys: the last value of each, at the first one's place.

    Equal keys are neighbours after a sort, so the work does not grow with keys times entries.
    """
    found = F.transform(column, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v")))
    df = df.withColumn("__sorted", F.array_sort(found))
    at = F.col("__sorted")
    first = F.filter(at, lambda e, i: (i == 0) | (F.get(at, i - 1)["k"] != e["k"]))
    last = F.filter(at, lambda e, i: (i == F.size(at) - 1) | (F.get(at, i + 1)["k"] != e["k"]))
    merged = F.zip_with(first, last, lambda a, b: F.struct(a["i"].alias("i"), a["k"].alias("k"), b["v"].alias("v")))
    kept = F.transform(F.array_sort(merged), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    return df.withColumn(column, kept).drop("__sorted")


def _one_line(s: Column) -> Column:
    return F.replace(F.btrim(s, F.lit(" \t\r\n")), F.lit("\n"), F.lit(""))


def listing_record(trees: DataFrame, thumb_limit: int | None = None) -> DataFrame:
    """One record per listing page; `thumb_limit` keeps that many of its thumbnails, else all are kept.

    Coordinates stay text, as they are written in the map link's style; `status` is `error` without two of
    them. surroundings, facilities and capacity are JSON.
    """
    nodes = F.col(NODES)
    map_link = first(find_all(nodes, "a", where=lambda n: class_contains(n, MAP_HOOK)))
    capacity_key = F.coalesce(
        F.btrim(text_of(nodes, first(find_all(nodes, "span", where=lambda n: has_class(n, OCCUPANCY_CLASS))))),
        F.lit("unknown"),
    )
    beds = F.transform(
        find_all(nodes, "li", where=lambda n: has_class(n, BED_CLASS)),
        lambda n: F.replace(_one_line(text_of(nodes, n)), F.lit("\u00a0"), F.lit(" ")),
    )
    hidden = F.transform(
        find_all(nodes, "img", where=lambda n: has_class(n, IMAGE_CLASS)), lambda n: large_image(attr(n, "src"))
    )
    thumbs = F.transform(
        find_all(nodes, "a", where=lambda n: class_contains(n, THUMB_HOOK) & (attr(n, "href") != "#")),
        lambda n: large_image(attr(n, "href")),
    )
    if thumb_limit is not None:
        thumbs = F.slice(thumbs, 1, thumb_limit)
    summary = first(find_all(nodes, "div", where=lambda n: attr(n, "id") == SUMMARY_ID))
    address = first(find_all(nodes, "span", where=lambda n: has_class(n, ADDRESS_CLASS)))
    record = trees.select(
        *_key(trees),
        decimals_in(attr(map_link, "style")).alias("__numbers"),
        F.btrim(text_of(nodes, address)).alias("address"),
        _one_line(text_of(nodes, summary)).alias("long_description"),
        metadata(nodes, "description").alias("short_description"),
        _section_entries(
            nodes,
            find_all(nodes, "div", where=lambda n: class_contains(n, SURROUNDINGS_HOOK)),
            "h3",
            squash_spaces,
        ).alias("surroundings"),
        _section_entries(
            nodes, find_all(nodes, "div", where=lambda n: has_class(n, FACILITIES_CLASS)), "h5", _one_line
        ).alias("facilities"),
        F.to_json(F.create_map(capacity_key, beds)).alias("capacity"),
        hidden.alias("__hidden"),
        thumbs.alias("__thumbs"),
    )
    kept = [c for c in record.columns if c not in (*_key(trees), "__numbers")]
    for part in ("surroundings", "facilities"):
        record = _last_by_key(record, part)
    return record.select(
        *_key(trees),
        F.get("__numbers", 0).alias("latitude"),
        F.get("__numbers", 1).alias("longitude"),
        F.when(F.get("__numbers", 1).isNull(), F.lit("error")).alias("status"),
        *kept,
    ).withColumns(
        {
            "surroundings": F.to_json(F.map_from_entries("surroundings")),
            "facilities": F.to_json(F.map_from_entries("facilities")),
            "images": F.when(F.size("__hidden") > 0, F.col("__hidden")).otherwise(F.col("__thumbs")),
        }
    ).drop("__hidden", "__thumbs")


def wiki_table(trees: DataFrame) -> DataFrame:
    """Rows of the first `wikitable` with at least three cells.

    A `datatable` gives title, href, city_href, city, type per row; another table gives
    name -> href of its first cells, the last row of a name.
    """
    nodes = F.col(NODES)
    table = first(find_all(nodes, "table", where=lambda n: has_class(n, "wikitable")))
    cells = F.filter(
        F.transform(find_all(below(nodes, table), "tr"), lambda r: find_all(below(nodes, r), "td")),
        lambda c: F.size(c) >= 3,
    )
    data = F.coalesce(has_class(table, "datatable"), F.lit(False))

    def link(c, i):
        return first(find_all(below(nodes, F.get(c, i)), "a"))

    def first_word(c, i):
        return F.get(F.split(squash_spaces(text_of(nodes, F.get(c, i))), " "), 0)

    full = F.transform(
        cells,
        lambda c, row: F.struct(
            row.alias("row_no"),
            attr(link(c, 0), "title").alias("title"),
            attr(link(c, 0), "href").alias("href"),
            attr(link(c, 1), "href").alias("city_href"),
            F.replace(text_of(nodes, link(c, 1)), F.lit("\n"), F.lit("")).alias("city"),
            first_word(c, 3).alias("type"),
        ),
    )
    no_text = F.lit(None).cast("string")
    named = F.filter(
        F.transform(
            cells,
            lambda c, row: F.struct(
                row.alias("row_no"),
                first_word(c, 0).alias("title"),
                attr(link(c, 0), "href").alias("href"),
                no_text.alias("city_href"),
                no_text.alias("city"),
                no_text.alias("type"),
            ),
        ),
        lambda e: e["title"] != "",
    )
    read = trees.select(
        *_key(trees),
        data.alias("is_data"),
        F.when(data, full).alias("__full"),
        F.when(~data, named).alias("__named"),
    )
    read = read.withColumn("__named", F.transform("__named", lambda e: F.struct(e["title"].alias("k"), e.alias("v"))))
    last_named = F.transform("__named", lambda e: e["v"])
    return _last_by_key(read, "__named").select(
        *_key(trees), "is_data", F.inline(F.when(F.col("is_data"), F.col("__full")).otherwise(last_named))
    )


def wiki_page(trees: DataFrame) -> DataFrame:
    """All paragraphs of the content div joined, and its coordinates in degrees, or NULL."""
    nodes = F.col(NODES)
    content = below(nodes, first(find_all(nodes, "div", where=lambda n: has_class(n, "mw-content-ltr"))))

    def said(name):
        return text_of(nodes, first(find_all(content, "span", where=lambda n: has_class(n, name))))

    # In three steps, so that each text and each number is computed once.
    read = trees.select(
        *_key(trees),
        F.array_join(F.transform(find_all(content, "p"), lambda p: text_of(nodes, p)), "").alias("description"),
        said("latitude").alias("latitude"),
        said("longitude").alias("longitude"),
    )
    read = read.withColumns({c: dms_to_degrees(F.col(c)) for c in ("latitude", "longitude")})
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return read.withColumns({c: F.when(both, F.col(c)) for c in ("latitude", "longitude")})


def _result_blocks(trees: DataFrame, fields) -> DataFrame:
    """One row per result block with the fields that `fields(block)` gives."""
    blocks = find_all(F.col(NODES), "div", where=lambda n: has_class(n, RESULT_CLASS))
    found = F.transform(blocks, lambda b, i: F.struct(i.alias("pos"), *fields(b)))
    return trees.select(*_key(trees), F.inline(found))


def _block_link(block: Column) -> Column:
    return attr(first(find_all(below(F.col(NODES), block), "a")), "href").alias("href")


def result_items(trees: DataFrame) -> DataFrame:
    """href of the first link and trimmed text per result block."""
    nodes = F.col(NODES)
    return _result_blocks(
        trees, lambda b: [_block_link(b), F.btrim(text_of(nodes, b), F.lit(" \t\r\n")).alias("text")]
    )


def result_prices(trees: DataFrame) -> DataFrame:
    """href and the first price per result block; blocks without a price are dropped."""
    nodes = F.col(NODES)

    def price(block):
        said = F.transform(find_all(below(nodes, block), "#text"), lambda n: price_mention(n["text"]))
        return first(F.filter(said, lambda p: p.isNotNull())).alias("price")

    return _result_blocks(trees, lambda b: [_block_link(b), price(b)]).filter("price IS NOT NULL")


def page_content(trees: DataFrame) -> DataFrame:
    """Prose lines of `p` and `h1`-`h3`, once per page: key, line.

    Text in `span`, `i`, `b` counts without its punctuation when that is less than two marks, and as a space
    otherwise; the outermost of nested ones decides. Blocks inside such an element are part of its text.
    """
    nodes = F.col(NODES)

    # Text and stripped text of a piece are elements of their own, so that each is made once.
    def said(n):
        plain = n["tag"] == "#text"
        words = F.when(plain, n["text"]).otherwise(squash_spaces(text_of(nodes, n)))
        return F.struct(plain.alias("plain"), words.alias("words"))

    def stripped(p):
        return F.struct(p["plain"].alias("plain"), p["words"].alias("words"), F.when(~p["plain"], strip_punctuation(p["words"])).alias("bare"))

    def written_as(p):
        few = F.length(p["words"]) - F.length(p["bare"]) < 2
        return F.when(p["plain"], p["words"]).when(few, p["bare"]).otherwise(" ")

    def block_text(b):
        pieces = F.filter(
            below(nodes, b),
            lambda n: ((n["tag"] == "#text") & n["inline_id"].isNull()) | (n["inline_id"] == n["node_id"]),
        )
        return F.array_join(F.transform(F.transform(F.transform(pieces, said), stripped), written_as), "")

    blocks = find_all(nodes, "p", "h1", "h2", "h3", where=lambda n: n["inline_id"].isNull())
    lines = F.transform(blocks, lambda b: squash_spaces(block_text(b)))
    kept = F.array_distinct(F.filter(lines, lambda s: is_quality_line(s)))
    return trees.select(*_key(trees), F.explode(kept).alias("line")).withColumn(
        "key", content_key(F.col("line"))
    )
