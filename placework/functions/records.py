"""Records packed in columns: hash keys, maps, JSON, addresses and serialised id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address parts kept from a list of address components.
ADDRESS_TYPES = (
    "route",
    "locality",
    "administrative_area_level_2",
    "administrative_area_level_1",
    "country",
)
COMPONENTS = "array<struct<types:array<string>,short_name:string>>"
NO_BREAK = "\u00a0"


def _quoted(s: Column) -> Column:
    """A string as it is written inside the text of a tuple."""
    body = s
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), (NO_BREAK, "\\xa0")):
        body = F.replace(body, F.lit(raw), F.lit(written))
    single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
    return (
        F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def tuple_text(*values: tuple[Column, str]) -> Column:
    """Text of a tuple; each value comes with its kind, `text` or `number`."""
    parts = [
        F.coalesce(_quoted(c.cast("string")) if kind == "text" else c.cast("string"), F.lit("None"))
        for c, kind in values
    ]
    tail = ",)" if len(parts) == 1 else ")"
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(tail))


def hash_key(*values: tuple[Column, str]) -> Column:
    """SHA-256 of `tuple_text`. Pass coordinates as text made by one formatter."""
    return F.sha2(tuple_text(*values), 256)


def coordinate_text(value: Column) -> Column:
    """The one written form of a coordinate inside keys: six decimals."""
    return value.try_cast("decimal(10,6)").cast("string")


def place_key(longitude: Column, latitude: Column, url: Column) -> Column:
    """The one canonical key of a place."""
    return hash_key(
        (coordinate_text(longitude), "text"), (coordinate_text(latitude), "text"), (url, "text")
    )


def map_diff(first: Column, second: Column) -> Column:
    """Differences of two string maps as map<key, struct<kind, first, second>>.

    Keys of the shorter map are reported: `only` when the longer one lacks the key, `changed` (values
    in the order longer, shorter) when the values differ. When one map is empty or NULL, all
    entries of the other are `only`.
    """
    first_size = F.coalesce(F.size(first), F.lit(0))
    second_size = F.coalesce(F.size(second), F.lit(0))
    swap = first_size < second_size
    longer = F.when(swap, second).otherwise(first)
    shorter = F.when(swap, first).otherwise(second)

    def only(v):
        return F.struct(
            F.lit("only").alias("kind"), v.alias("first"), F.lit(None).cast("string").alias("second")
        )

    def compare(k, v):
        return F.when(~F.map_contains_key(longer, k), only(v)).otherwise(
            F.struct(
                F.lit("changed").alias("kind"),
                F.element_at(longer, k).alias("first"),
                v.alias("second"),
            )
        )

    differing = F.map_filter(
        shorter, lambda k, v: ~(F.map_contains_key(longer, k) & F.element_at(longer, k).eqNullSafe(v))
    )
    return (
        F.when(first_size == 0, F.transform_values(second, lambda k, v: only(v)))
        .when(second_size == 0, F.transform_values(first, lambda k, v: only(v)))
        .otherwise(F.transform_values(differing, compare))
    )


def pack_json(record: Column) -> Column:
    return F.to_json(record)


def unpack_json(text: Column, schema) -> Column:
    """Record from JSON text; NULL when the text is not JSON."""
    return F.from_json(text, schema)


def filter_components(components: Column) -> Column:
    """Address components whose first type is one of `ADDRESS_TYPES`."""
    return F.filter(components, lambda c: F.get(c["types"], 0).isin(*ADDRESS_TYPES))


def address_parts(components: Column) -> Column:
    """struct with one field per address type; the last component of a type counts."""
    kept = filter_components(components)

    def last_of(kind: str) -> Column:
        hits = F.filter(kept, lambda c: F.get(c["types"], 0) == kind)
        return F.try_element_at(hits, F.lit(-1))["short_name"].alias(kind)

    return F.struct(*[last_of(t) for t in ADDRESS_TYPES])


def address_map(components: Column) -> Column:
    """map type -> short name."""
    parts = address_parts(components)
    pairs = F.array(*[F.struct(F.lit(t).alias("k"), parts[t].alias("v")) for t in ADDRESS_TYPES])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def packed_address(components: Column) -> Column:
    """JSON text of the address; absent types are left out, no components at all is `{}`."""
    return F.when(components.isNull(), F.lit(None)).otherwise(F.to_json(address_parts(components)))


def first_valid_address(addresses: Column, city: Column, county_code: Column) -> Column:
    """Packed text of the first candidate address that names both the city and the county code."""
    packed = F.transform(addresses, lambda a: packed_address(a["address_components"]))
    return F.get(
        F.filter(packed, lambda p: F.contains(p, city) & F.contains(p, county_code)), 0
    )


def encode_id_list(ids: Column) -> Column:
    """[7, 9] -> `a:2:{i:0;i:7;i:1;i:9;}`"""
    slots = F.transform(
        ids,
        lambda v, i: F.concat(
            F.lit("i:"), i.cast("string"), F.lit(";i:"), v.cast("string"), F.lit(";")
        ),
    )
    return F.concat(
        F.lit("a:"), F.size(ids).cast("string"), F.lit(":{"), F.array_join(slots, ""), F.lit("}")
    )


def decode_id_list(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(r"i:\d+;i:(-?\d+);"), F.lit(1))
    return F.transform(values, lambda v: v.cast("bigint"))


def infer_value(text: Column) -> Column:
    """struct(ids, number, text), exactly one of them set for a non-NULL input."""
    marks = (F.length(text) - F.length(F.replace(text, F.lit(";i:"), F.lit("")))) / 3
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    is_list = (marks > 1) & F.rlike(text, F.lit(r"^a:\d+:\{.*\}$"))
    bare = F.replace(text, F.lit("."), F.lit(""))
    decimal = F.rlike(text, F.lit(r"^(\d+\.\d*|\.\d+)([eE]\d+)?$"))
    number = F.when(
        ~is_list & (dots == 1) & F.rlike(bare, F.lit(r"^[\p{L}\p{N}]+$")) & decimal,
        text.try_cast("double"),
    )
    return F.struct(
        F.when(is_list, decode_id_list(text)).alias("ids"),
        number.alias("number"),
        F.when(~is_list & number.isNull(), text).alias("text"),
    )
