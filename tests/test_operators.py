import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placework.operators import aggregates, changes, joins, paging, select, sets, windows
from placework.operators.graph import crawl_frontier
from placework.sources import files


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_match_like_exclude(spark):
    df = spark.createDataFrame(
        [(1, "50% off", 1), (2, "500", None), (3, None, 2), (4, "A_b", 1)], "id long, a string, n int"
    )
    ids = lambda match, mode="match": [r[0] for r in values(select.select_rows(df, match, mode), "id")]
    assert ids({"a": None}) == [3] and ids({"a": None}, "exclude") == [1, 2, 4]
    assert ids({"a": "50%"}, "like") == [1] and ids({"a": "a_B"}, "like") == [4]
    assert ids({"a": "50"}, "exclude") == [4]
    assert ids({"n": 1}, "exclude") == [2, 3] and ids({"n": 1, "a": "50% off"}) == [1]
    assert values(select.first_row(df, {"n": 1}), "id") == [(1,)]
    assert select.first_row(df, {"n": 9}).count() == 0
    with pytest.raises(ValueError):
        select.select_rows(df, {"n": 1}, "near")


def skewed(spark, rows=3000):
    """A third of the rows under one key, some without a key."""
    rng = random.Random(5)
    data = []
    for i in range(rows):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(60)}")
        data.append((key, rng.randrange(8), i, f"v{i}"))
    return spark.createDataFrame(data, "k string, lead int, i long, v string").repartition(5), data


ORDERS = [
    ["i"],
    ["lead", "i"],
    ["lead", "second", "i"],
    ["second", "i"],
    ["large", "i"],
    ["text", "i"],
    ["text desc", "i desc"],
    ["second desc", "i"],
    ["outlier", "i"],
]


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_numbering_equals_the_plain_window(spark, order):
    df, _ = skewed(spark)
    order = [F.desc(c.split()[0]) if c.endswith(" desc") else c for c in order]
    df = df.withColumns(
        {
            "second": F.when(F.col("i") % 3 > 0, F.col("i") % 7),
            "large": F.lit(2**60) + F.col("i") % 11,
            "text": F.when(F.col("i") % 5 > 0, F.concat(F.lit("t"), F.col("i") % 13)),
            "outlier": F.when(F.col("i") == 9, F.lit(10**15)).otherwise(F.col("i") % 4),
        }
    )
    cut = windows.number_within(df, ["k"], order)
    plain = windows.number_within(df, ["k"], order, bounded=True)
    assert cut.columns == plain.columns
    assert values(cut, "k", "i", "n") == values(plain, "k", "i", "n")
    whole = df.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    assert values(windows.number_all(df, order, start=1), "i", "n") == values(whole, "i", "n")


def test_ties_and_empty_tables_are_numbered_without_gaps(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit("same").alias("t"))
    assert sorted(r["n"] for r in windows.number_within(df, ["k"], ["t"]).collect()) == list(range(500))
    assert sorted(r["n"] for r in windows.number_all(df, "t").collect()) == list(range(500))
    assert windows.number_within(df.limit(0), ["k"], ["t"]).collect() == []
    assert windows.number_all(df.limit(0), "t").collect() == []


def test_large_limits_are_applied_to_parts_first(spark):
    df, _ = skewed(spark)
    got = windows.top_k_per_key(df.unionAll(df), ["k"], ["i"], 1500, rank="n")
    plain = df.unionAll(df).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("i"))).filter("n <= 1500")
    assert values(got, "k", "i", "n") == values(plain, "k", "i", "n")


def test_chunks_hold_everything_once(spark):
    df, data = skewed(spark)
    chunks = windows.collect_in_chunks(df, ["k"], ["lead", "i"], F.col("v"), 100, "vs").collect()
    assert max(len(r["vs"]) for r in chunks) == 100
    expected = [v for k, _, _, v in sorted((d for d in data if d[0] == "hot"), key=lambda d: (d[1], d[2]))]
    hot = sorted((r for r in chunks if r["k"] == "hot"), key=lambda r: r["chunk"])
    assert [v for r in hot for v in r["vs"]] == expected
    assert sum(len(r["vs"]) for r in chunks) == len(data)


def test_children_of_a_hot_parent_come_in_chunks(spark):
    df, data = skewed(spark)
    parents = spark.createDataFrame([("hot",), ("k1",), ("childless",)], "k string")
    nested = joins.with_children(parents, df.select("k", "i", "v"), "k", 300, ["i"]).collect()
    hot = [r for r in nested if r["k"] == "hot"]
    assert sorted(r["chunk"] for r in hot) == [0, 1, 2, 3] and sum(len(r["children"]) for r in hot) == 1000
    assert [r["children"] for r in nested if r["k"] == "childless"] == [[]]


def test_top_k_is_limited_before_the_shuffle(spark):
    df, _ = skewed(spark)
    top = windows.top_k_per_key(df, ["k"], ["i"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert values(top.filter("k = 'hot'"), "i") == [(0,), (3,), (6,)]


def test_page_counts(spark):
    df = spark.createDataFrame([("u", 0), ("v", 19), ("w", 20), ("x", 45)], "url string, count int")
    got = paging.page_urls(df).groupBy("url").count()
    assert values(got, "url", "count") == [("u", 1), ("v", 1), ("w", 2), ("x", 3)]
    assert "u&start=0&order=" in [r["page_url"] for r in paging.page_urls(df).collect()]


def test_chained_responses_give_all_pages(spark):
    body = '{"status":"OK","next_page_token":%s,"results":[{"name":"a%d","place_id":"p%d"}]}'
    rows = [(i, body % ('"t"' if i < 2 else "null", i, i)) for i in range(3)]
    rows.append((3, '{"status":"ZERO_RESULTS","results":[]}'))
    got = paging.collect_pages(spark.createDataFrame(rows, "page_no int, body string"))
    assert values(got, "page_no", "name") == [(0, "a0"), (1, "a1"), (2, "a2")]


def test_city_in_two_attempts(spark):
    city = spark.createDataFrame(
        [(5, 1, "sat nou"), (3, 1, "Sat-Nou de Sus"), (4, 2, "sat nou"), (6, 1, "x")], "id long, county_id long, name string"
    )
    rows = spark.createDataFrame(
        [(1, "Sat-Nou", 1), (2, "Sat-Nou", 2), (3, "sat nou", None), (4, "absent", 1), (5, None, 1)],
        "row int, said string, county long",
    )
    got = joins.resolve_city(rows, city, F.col("said"), F.col("county"))
    assert values(got, "row", "city_id") == [(1, 3), (2, 4), (3, None), (4, None), (5, None)]
    got = joins.resolve_city(rows, city, F.col("said"), F.col("county"), F.lit(2).cast("long"))
    assert values(got, "row", "city_id")[2] == (3, 4)
    got = joins.resolve_city(rows, city, F.col("said"))
    assert values(got, "row", "city_id") == [(1, 3), (2, 3), (3, 4), (4, None), (5, None)]
    got = joins.resolve_city_prefix(rows, city, F.lit("SAT-altul"), F.col("county"))
    assert values(got, "row", "city_id")[0] == (1, 3)


def brute_pairs(left, right, metres, min_ratio):
    from difflib import SequenceMatcher
    from math import asin, cos, radians, sin, sqrt

    def apart(a, b):
        x = sin(radians(b[2] - a[2]) / 2) ** 2
        y = cos(radians(a[2])) * cos(radians(b[2])) * sin(radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371008.8 * asin(min(1.0, sqrt(x + y)))

    return sorted(
        (a[0], b[0])
        for a in left
        for b in right
        if apart(a, b) <= metres and SequenceMatcher(None, b[1], a[1]).ratio() > min_ratio
    )


@pytest.mark.parametrize("centre", [(45.0, 25.0), (0.0, 0.0), (-33.0, 179.99995), (71.0, -179.99995), (89.9999, 10.0)])
def test_nearby_matches_equal_brute_force(spark, centre):
    rng = random.Random(7)
    names = ["casa mare", "casa mare 2", "casa", "vila alba", "vila albă", "hotel central", "hotel centrul", "x"]

    def side(n, base):
        out = []
        for i in range(n):
            lon = centre[1] + rng.uniform(-0.0002, 0.0002)
            lon = lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon
            spot = (centre[0], centre[1]) if i % 3 == 0 else (centre[0] + rng.uniform(-0.00005, 0.00005), lon)
            out.append((base + i, rng.choice(names) + rng.choice(["", " a", " bcd"]), float(spot[0]), float(spot[1])))
        return out

    left, right = side(60, 0), side(60, 1000)
    schema = "id long, name string, latitude double, longitude double"
    got = joins.match_nearby(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert values(got, "left_id", "right_id") == sorted(brute_pairs(left, right, 10, 0.8), key=repr)


def test_short_names_meet_where_they_can_match(spark):
    from itertools import product

    names = ["".join(p) for n in range(1, 5) for p in product("abc", repeat=n)] + ["abcab", "aabbc"]
    rows = [(k, n, 45.0, 25.0) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, latitude double, longitude double")
    got = joins.match_nearby(df, df)
    assert values(got, "left_id", "right_id") == sorted(brute_pairs(rows, rows, 10, 0.8), key=repr)
    with pytest.raises(ValueError):
        joins.match_nearby(df, df, min_ratio=0.6)


@pytest.mark.parametrize("most", [0, 20, 400])
def test_nearby_matches_with_crowds_of_any_size(spark, monkeypatch, most):
    from placework.operators import nearby

    monkeypatch.setattr(nearby, "CROWD", most)
    rng = random.Random(8)
    names = ["casa mare", "casa mare 2", "casa", "vila alba", "hotel central", "hotel centrul", "x"]
    rows = [
        (i, rng.choice(names) + rng.choice(["", " a", f" {i}"]), 45.0 + rng.choice([0, 0.0, 0.00006, 0.001]), 25.0 + rng.choice([0.0, 0.00005]))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "id long, name string, latitude double, longitude double")
    got = joins.match_nearby(df, df)
    assert values(got, "left_id", "right_id") == sorted(brute_pairs(rows, rows, 10, 0.8), key=repr)


def test_nearby_sides_do_not_pass_through_the_driver(spark):
    """Files look small before names are read and cells exploded; a broadcast planned from that is never taken back."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    at = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        (F.col("p_partkey") * 0.00005).alias("latitude"), F.lit(25.0).alias("longitude"),
    )
    for found in (joins.nearby_pairs(at, at), joins.match_nearby(at, at)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_city_lookups_ignore_accents_and_take_long_names(spark):
    import time

    city = spark.createDataFrame([(5, "Brașov", 1), (6, "Brașov-Centru", 1), (7, "Târgu Mureș", 1), (8, "x" * 10_000, 2)], "id long, name string, county_id long")
    rows = spark.createDataFrame([(1, "brasov", 1), (2, "Braşov-Sat", 1), (3, "targu-mures", 1), (4, "BRAŞOV", 2), (5, "x" * 9_000, 2), (6, "", 1)], "row int, said string, county long")
    start = time.perf_counter()
    got = joins.resolve_city(rows, city, F.col("said"), F.col("county"))
    assert values(got, "row", "city_id") == [(1, 5), (2, None), (3, 7), (4, None), (5, 8), (6, 5)]
    assert time.perf_counter() - start < 30
    got = joins.resolve_city_prefix(rows, city, F.col("said"), F.col("county"))
    assert values(got, "row", "city_id") == [(1, 6), (2, 6), (3, None), (4, None), (5, None), (6, 6)]


def test_match_kinds(spark):
    points = spark.createDataFrame(
        [(2, "a", 1.0, 2.0), (1, "b", 1.0, 2.0), (3, "c", 5.0, 5.0)], "id long, title string, latitude double, longitude double"
    )
    posts = spark.createDataFrame(
        [(1, "c", 1.0, 2.0), (2, "c", None, None), (3, "z", 9.0, 9.0)], "post int, title string, latitude double, longitude double"
    )
    got = joins.match_with_fallback(posts, points)
    assert values(got, "post", "point_id", "match_kind") == [(1, 1, "coordinates"), (2, 3, "title"), (3, None, "missing")]


def test_changes(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, s string, n int")
    rows = spark.createDataFrame([(2, "x", 5, 1), (2, "y", 6, 2), (3, "z", 7, 1), (3, "w", 8, 3)], "id long, s string, n int, o int")
    assert values(changes.upsert(target, rows, "id", "o"), "id", "s") == [(1, "a"), (2, "y"), (3, "w")]
    assert values(changes.insert_ignore(target, rows, "id", "o"), "id", "s") == [(1, "a"), (2, "b"), (3, "z")]
    set_null = spark.createDataFrame([(1, None, 9, ["s"])], "id long, s string, n int, set_columns array<string>")
    assert values(changes.update_by_id(target, set_null), "id", "s", "n") == [(1, None, 1), (2, "b", 2)]
    assert values(changes.delete_by_id(target, set_null), "id") == [(2,)]
    fresh = changes.assign_ids(spark.createDataFrame([(10,), (7,)], "k long"), target, "k")
    assert values(fresh, "k", "id") == [(10, 4), (7, 3)]


def test_union_and_sets(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "2")], "url string, p string")
    b = spark.createDataFrame([("y",), ("x",)], "url string")
    assert values(sets.union_urls(a, b), "url") == [("x",), ("y",)]
    assert values(sets.platform_rows(a, b), "url", "p") == [("x", "1"), ("x", "2"), ("x", None), ("y", None)]
    assert sets.unvisited(b, a).collect()[0]["url"] == "y"


def test_crawl_does_not_expand_failed_pages(spark):
    edges = [("http://h.ro/", "../a.html"), ("http://h.ro/a.html", "http://h.ro/b.html"), ("http://h.ro/b.html", "http://h.ro/c.html"),
             ("http://h.ro/a.html", "http://h.ro/"), ("http://h.ro/a.html", "http://x.ro/z.html"), ("http://h.ro/a.html", "../q.pdf")]
    seeds = spark.createDataFrame([("http://h.ro/",)], "url string")
    failed = spark.createDataFrame([("http://h.ro/b.html",)], "url string")
    got = crawl_frontier(spark, spark.createDataFrame(edges, "src string, dst string"), seeds, "http://h.ro/", failed)
    assert values(got, "url", "ok", "round") == [
        ("http://h.ro/", True, 0), ("http://h.ro/a.html", True, 1), ("http://h.ro/b.html", False, 2)
    ]
    progress = aggregates.crawl_progress(got)
    assert values(progress, "round", "visited", "failed") == [(0, 1, 0), (1, 1, 0), (2, 0, 1)]


def test_files(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes('﻿Hotel ID,URL,City,Hotels\r\n1,"a,""b""\nc",Iași,\r\n'.encode())
    assert values(files.read_listing_csv(spark, str(path)), "Hotel ID", "URL", "City", "Hotels") == [("1", 'a,"b"\nc', "Iași", None)]
    (tmp_path / "other.csv").write_text("City,Stars,Hotel ID,URL\nIasi,3,7,http://u\n")
    got = files.read_listing_csv(spark, str(tmp_path / "other.csv"))
    assert got.columns == ["Hotel ID", "URL", "City", "Hotels", "Stars"]
    assert [tuple(r) for r in got.collect()] == [("7", "http://u", "Iasi", None, "3")]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert files.read_listing_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    assert files.read_listing_csv(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "a.txt").write_text("('a, b', 1)\n\n[\"it's\", -2.5]\n('x', None)\n", encoding="utf-8")
    got = files.read_literal_lines(spark, str(tmp_path), "s string, n double")
    assert set(values(got, "s", "n")) == {("a, b", 1.0), ("it's", -2.5), ("x", None)}
    (tmp_path / "img" / "county" / "sat - x").mkdir(parents=True)
    (tmp_path / "img" / "county" / "sat - x" / "1.jpg").write_bytes(b"123")
    assert values(files.image_inventory(spark, str(tmp_path / "img")), "path", "length") == [("county/sat - x/1.jpg", 3)]


def test_keys_outlive_a_checkpoint(spark, tmp_path):
    from placework.streaming.new_keys import read_new_keys, write_new_keys

    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(keys, checkpoint):
        spark.createDataFrame([(k,) for k in keys], "k long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long").parquet(source)
        write_new_keys(stream, ["k"], out, str(tmp_path / checkpoint)).awaitTermination()
        return values(read_new_keys(spark, out, "k long"), "k")

    assert feed([1, 2, 2], "one") == [(1,), (2,)]
    assert feed([2, 3], "one") == [(1,), (2,), (3,)]
    assert feed([3, 4], "two") == [(1,), (2,), (3,), (4,)]
    assert feed([None, 4], "three") == [(1,), (2,), (3,), (4,), (None,)]
