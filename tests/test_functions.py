import hashlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placework.functions import geo, records, text, web


def test_similarity_and_its_bound(spark):
    pairs = [("small ring", "small rings"), ("", ""), ("abc", "xyz"), ("a" * 300, "a" * 250 + "b"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(
        "a", "b", text.similarity(F.col("a"), F.col("b")).alias("r"), text.similarity_bound(F.col("a"), F.col("b")).alias("m")
    ).collect()
    assert round(rows[0]["r"], 6) == 0.952381
    for row in rows:
        if row["a"] is None:
            assert row["r"] is None
        else:
            assert row["r"] == SequenceMatcher(None, row["a"], row["b"]).ratio()
            assert row["r"] <= row["m"]


def test_bound_by_edits_holds(spark):
    import random

    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    bound = text.similarity_bound_by_edits(F.col("a"), F.col("b"))
    for row in df.select("a", "b", bound.alias("m")).collect():
        assert SequenceMatcher(None, row["a"], row["b"]).ratio() <= row["m"] + 1e-9


@pytest.mark.parametrize(
    "value", ["a", "it's", 'say "x"', "it's \"x\"", "back\\slash", "line\nbreak\ttab", "țară", "a b"]
)
def test_hash_key_is_the_hash_of_the_tuple_text(one, value):
    expected = hashlib.sha256(str((value, 1, None)).encode()).hexdigest()
    key = records.hash_key((F.col("s"), "text"), (F.lit(1), "number"), (F.lit(None).cast("string"), "text"))
    assert one(key, s=value) == expected
    assert one(records.hash_key((F.col("s"), "text")), s=value) == hashlib.sha256(str((value,)).encode()).hexdigest()


def test_map_diff_reports_keys_of_the_shorter_map(spark):
    schema = "a map<string,string>, b map<string,string>"
    cases = [
        ({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "5"}, {"b": ("changed", "2", "5")}),
        ({"a": "1", "b": "5"}, {"a": "1", "b": "2", "c": "3"}, {"b": ("changed", "2", "5")}),
        ({}, {"x": "1"}, {"x": ("only", "1", None)}),
        (None, {"x": "1"}, {"x": ("only", "1", None)}),
        ({"x": "1"}, {}, {"x": ("only", "1", None)}),
        ({"a": None}, {"a": None}, {}),
        ({"a": "1", "q": "2"}, {"z": None}, {"z": ("only", None, None)}),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], schema)
    got = df.select(records.map_diff(F.col("a"), F.col("b")).alias("d")).collect()
    for row, (_, _, expected) in zip(got, cases):
        assert {k: tuple(v) for k, v in row["d"].items()} == expected


def test_degrees(one):
    assert round(one(geo.dms_to_degrees(F.lit("45°39′12″N"))), 6) == 45.653333
    assert round(one(geo.dms_to_degrees(F.lit("25°36′00″W"))), 6) == -25.6
    assert one(geo.dms_to_degrees(F.lit("nowhere"))) is None


@pytest.mark.parametrize(
    "county, city, expected",
    [
        ("Municipiul Bucureşti", "Voluntari", "ilfov"),
        ("Municipiul București", "Voluntari", "ilfov"),
        ("Ilfov", "Bucureşti", "bucuresti"),
        ("Braşov", "Săcele", "brasov"),
    ],
)
def test_capital_rules(one, county, city, expected):
    assert one(geo.normalise_region(F.lit(county), F.lit(city))) == expected


def test_slugs(one):
    assert one(text.slugify(F.lit("  Şura Mică & 1,000 ţări! "))) == "sura-mica-1000-tari"
    assert one(text.slugify(F.lit("Județ — Iași"))) == "judet-iasi"
    assert one(text.title_from_slug(F.lit("casa-din-deal"))) == "Casa Din Deal"
    assert one(text.unaccent(F.lit("ŞşȘșŢţȚțÂâĂăÎî Straße œuvre ñandú"))) == "SsSsTtTtAaAaIi Strasse oeuvre nandu"


@pytest.mark.parametrize(
    "url, expected", [("https://www.site.com/x", "site"), ("maps.site.com", "maps.site"), ("no-host", "")]
)
def test_platform(one, url, expected):
    assert one(web.platform_of_url(F.lit(url))) == expected


def test_numbers_and_prices(one):
    assert one(text.first_number(F.lit("de la 120,50 lei"))) == "120,50"
    assert float(one(text.number_value(F.lit("de la 120,50 lei")))) == 120.5
    assert one(text.first_number(F.lit("none"))) is None
    assert one(text.price_mention(F.lit("5 lei"))) is None
    assert one(text.price_mention(F.lit("de la 50 lei"))) == "50 lei"
    assert one(text.price_mention(F.lit("now € 75 only"))) == "€ 75"
    assert one(text.parse_grouped_int(F.lit("1.234"))) == 1234


@pytest.mark.parametrize(
    "value, ids, number, kept",
    [
        ("a:2:{i:0;i:7;i:1;i:9;}", [7, 9], None, None),
        ("4.5", None, 4.5, None),
        ("a.b", None, None, "a.b"),
        ("1.5d", None, None, "1.5d"),
        ("1.2.3", None, None, "1.2.3"),
        ("x", None, None, "x"),
        ("-4.5", None, None, "-4.5"),
    ],
)
def test_infer_value(one, value, ids, number, kept):
    got = one(records.infer_value(F.lit(value)))
    assert (got["ids"], got["number"], got["text"]) == (ids, number, kept)


def test_id_list_round_trip(one):
    packed = records.encode_id_list(F.array(F.lit(7), F.lit(-9), F.lit(12)))
    assert one(packed) == "a:3:{i:0;i:7;i:1;i:-9;i:2;i:12;}"
    assert one(records.decode_id_list(packed)) == [7, -9, 12]


@pytest.mark.parametrize(
    "size, expected",
    [
        ((500, 900), (True, False, None, None)),
        ((1000, 1000), (False, False, 1000, 1000)),
        ((1600, 1200), (False, False, 1600, 1200)),
        ((600, 1200), (False, True, 800, 1600)),
        ((700, 700), (False, True, 600, 800)),
    ],
)
def test_crop_plan(one, size, expected):
    got = one(geo.crop_plan(F.lit(size[0]), F.lit(size[1])))
    assert (got["rejected"], got["resize"], got["resize_w"], got["resize_h"]) == expected
    if not got["rejected"]:
        assert got["right"] - got["left"] == 800 and got["bottom"] - got["top"] == 600


@pytest.mark.parametrize(
    "url, name, mime",
    [
        ("http://h/a/B.JPG", "3.jpg", "image/jpeg"),
        ("http://h/a/b", "3.jpg", "image/jpeg"),
        ("http://h/a/.hidden", "3.jpg", "image/jpeg"),
        ("http://h/a/b.tar.PNG", "3.png", "image/png"),
    ],
)
def test_image_names(one, url, name, mime):
    assert one(web.image_name(F.lit(url), F.lit(3))) == name
    assert one(web.image_mime(F.lit(name))) == mime


def test_labels_and_links(one):
    pair = one(geo.labelled_pair(F.lit("*Biserică"), F.lit("Coordonate: 45.1,25.2")))
    assert tuple(pair) == ("45.1", "25.2")
    assert tuple(one(geo.labelled_pair(F.lit("Biserică"), F.lit("Coordonate: 45.1,25.2")))) == (None, None)
    assert tuple(one(web.point_from_map_link(F.lit("https://m/?z=1&q=45.1,25.2")))) == ("45.1", "25.2")
    assert one(web.quote_query(F.lit("a b/c~d*é"))).endswith("a%20b/c~d%2A%C3%A9")
    assert one(geo.display_name(F.lit("satu mare"), F.lit("1.jpg"))) == "Cazare_Satu Mare_1.jpg"


@pytest.mark.parametrize(
    "url, keep",
    [
        ("http://h.ro/a.html#x", True),
        ("http://h.ro/a.pdf", False),
        ("http://h.ro", False),
        ("/rel", False),
        ("http://h.ro/a.php?x=1", True),
        ("http://h.ro/a.b.c.d.html", False),
        ("http://h.ro/x#a.b.c.d", True),
        ("http://other.ro/a.html", False),
        ("http://h.ro/a", True),
    ],
)
def test_valid_links(one, url, keep):
    assert one(web.is_valid_link(F.lit(url), F.lit("http://h.ro/"))) is keep


def test_addresses(one):
    def part(kind, value):
        return {"types": [kind, "political"], "short_name": value}

    import json

    body = json.dumps(
        [
            {"address_components": [part("locality", "Altul"), part("country", "RO")]},
            {"address_components": [part("locality", "Sat"), part("administrative_area_level_1", "BV"), part("floor", "2")]},
            {"address_components": [part("locality", "Sat"), part("administrative_area_level_1", "BV"), part("country", "RO")]},
        ]
    )
    schema = f"array<struct<address_components:{records.COMPONENTS}>>"
    found = records.first_valid_address(records.unpack_json(F.lit(body), schema), F.lit("Sat"), F.lit("BV"))
    assert one(found) == '{"locality":"Sat","administrative_area_level_1":"BV"}'


def test_custom_endings(one):
    seed = F.lit("http://h.ro/")
    assert one(web.is_valid_link(F.lit("http://h.ro/a.asp"), seed)) is False
    assert one(web.is_valid_link(F.lit("http://h.ro/a.asp"), seed, exts=("asp",))) is True
    assert one(web.is_valid_link(F.lit("http://h.ro/a.asp"), seed, pattern=r"\.pdf$")) is True
    assert one(web.county_code(F.lit("BV/index.php?menu=BI"))) == "BV"
