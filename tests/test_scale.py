"""Operators whose plan or storage must not grow with the data the wrong way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from placework.operators import changes, graph, joins, paging, windows
from placework.plans import catalogue
from placework.schemas import CATALOGUE
from placework.sources import catalogue as stores
from placework.sources import files, folders
from placework.streaming import new_keys


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- city lookups ------------------------------------------------------------------------------------------


def town_names(rng, n):
    parts = ["satu", "mare", "nou", "vechi", "sat", "san", "de", "sus", "jos", "a", "Brașov", "târgu"]
    return [rng.choice([" ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_city_lookup_equals_a_scan_of_all_names(spark):
    rng = random.Random(3)
    names = town_names(rng, 300)
    city = [(k, rng.randrange(5), name) for k, name in enumerate(names)]
    said = [rng.choice([town_names(rng, 1)[0], rng.choice(names)[1:7], rng.choice(["a", "sa", "", "-", "- ", None])]) for _ in range(400)]
    rows = [(k, text, rng.choice([None, 0, 1, 2, 3, 4, 9])) for k, text in enumerate(said)]
    cities = spark.createDataFrame(city, "id long, county_id long, name string")
    df = spark.createDataFrame(rows, "row int, said string, county long")

    def plain(text):
        return text.lower().translate(str.maketrans("șâ", "sa"))

    def first(text, county):
        if text is None:
            return None
        return min((i for i, c, name in city if (county is None or c == county) and plain(text) in plain(name)), default=None)

    def tried(text, county):
        found = first(text, county)
        return found if found is not None or text is None else first(text.replace("-", " "), county)

    got = joins.resolve_city(df, cities, F.col("said"), F.col("county"))
    assert values(got, "row", "city_id") == sorted([(k, None if c is None else tried(t, c)) for k, t, c in rows], key=repr)
    got = joins.resolve_city(df, cities, F.col("said"))
    assert values(got, "row", "city_id") == sorted([(k, tried(t, None)) for k, t, _ in rows], key=repr)
    got = joins.resolve_city_prefix(df, cities, F.col("said"), F.col("county"))
    expected = [(k, None if c is None or t is None else first(t.split("-")[0] + "-", c)) for k, t, c in rows]
    assert values(got, "row", "city_id") == sorted(expected, key=repr)


def test_city_lookup_reads_its_rows_once(spark, tmp_path):
    spark.createDataFrame([(1, "sat nou", 1)], "row int, said string, county long").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([(5, 1, "sat nou")], "id long, county_id long, name string").write.parquet(str(tmp_path / "city"))
    rows, city = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "city"))
    for got in (
        joins.resolve_city(rows, city, F.col("said"), F.col("county"), F.lit(1).cast("long")),
        joins.resolve_city_prefix(rows, city, F.col("said"), F.col("county")),
    ):
        assert plan_of(got).count("row#") > 0 and plan_of(got).count("Relation [row#") == 1


def test_jobs_parse_pages_before_any_lookup(spark):
    from test_jobs import dimensions, list_pages

    city, county = dimensions(spark)
    stored = spark.createDataFrame([(7, "/s", "old title")], "id long, url string, title string")
    state = catalogue.ingest_catalogue(list_pages(spark), city, county, stored)
    assert "MapInArrow" not in plan_of(state) and state.count() == 3


# --- child tables ------------------------------------------------------------------------------------------


def test_children_of_changed_parents_are_replaced(spark):
    fields = "id long, k string, type string, content string, at string"
    stored = [(1, "a", "x", "same", "old"), (2, "a", "x", "gone", "old"), (3, "b", "x", "stays", "old"), (4, None, "x", "loose", "old"), (5, "a", "y", None, "old")]
    fresh = [("a", "x", "same", "now"), ("a", "x", "same", "later"), ("a", "y", None, "now"), ("a", "z", "new", "now"), ("c", "x", "not asked for", "now")]
    slots = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    table = spark.createDataFrame(stored, fields)
    come = spark.createDataFrame(fresh, "k string, type string, content string, at string")
    once = changes.replace_children(table, come, slots, ["k"], ("at",))
    expected = [(1, "a", "x", "same", "now"), (3, "b", "x", "stays", "old"), (4, None, "x", "loose", "old"), (5, "a", "y", None, "now"), (6, "a", "z", "new", "now")]
    assert values(once, "id", "k", "type", "content", "at") == sorted(expected, key=repr)
    again = changes.replace_children(once, come, slots, ["k"], ("at",))
    assert values(again, *once.columns) == values(once, *once.columns)
    by_type = changes.replace_children(table, come, spark.createDataFrame([("a", "x")], "k string, type string"), ["k", "type"], ("at",))
    assert values(by_type, "id", "content") == sorted([(1, "same"), (3, "stays"), (4, "loose"), (5, None)], key=repr)
    assert changes.replace_children(table.limit(0), come.limit(0), slots, ["k"]).count() == 0


def test_second_import_changes_no_child(spark):
    from test_jobs import dimensions
    from placework.plans.listings import import_listings
    from placework.queries import render

    city, county = dimensions(spark)
    csv = spark.createDataFrame([("1", "http://www.l.example/1.html", "Brasov", "Casa A")], "`Hotel ID` string, URL string, City string, Hotels string")
    page = lambda bed: spark.range(1).select(
        F.lit("http://www.l.example/1.ro.html").alias("url"),
        render.listing_page(F.lit("45.1"), F.lit("25.1"), F.lit("n"), F.lit("c"), F.lit("Str. 1"), F.lit(bed), F.lit(1)).alias("html"),
    )
    places = spark.createDataFrame([], "id long, name string, latitude double, longitude double, place_id string")
    details = spark.createDataFrame([], "place_id string, url string, formatted_phone_number string")
    results = spark.createDataFrame([], "hotel_id long, html string")
    none = spark.createDataFrame([], CATALOGUE["booking_listings"]).drop("type", "status")

    def run(existing, children, price):
        done = import_listings(csv, page(price), places, details, results, city, county, existing, "2024-01-02 03:04:05", [99], children)
        return done["listings"], {n: done[n] for n in ("platforms", "facilities", "contents")}

    listings, first = run(none, None, "120")
    same, second = run(listings, first, "120")
    assert values(same, *listings.columns) == values(listings, *listings.columns) and listings.count() == 1
    for name, df in first.items():
        assert df.count() > 0 and values(second[name], *df.columns) == values(df, *df.columns)
    # Another price: that platform row goes and one with the next id comes; the rest keeps its ids.
    _, third = run(same, second, "130")
    assert values(third["platforms"], "id", "avg_price") == [(2, "130")]
    assert values(third["facilities"], "id", "content") == values(first["facilities"], "id", "content")


# --- crawl ---------------------------------------------------------------------------------------------------


def breadth_first(edges, seeds, failed):
    at, out, distance = set(seeds), dict.fromkeys(seeds, 0), 0
    while at:
        distance += 1
        at = {d for s, d in edges if s in at and s not in failed} - set(out)
        out |= dict.fromkeys(at, distance)
    return out


def crawl(spark, edges, seeds, failed=(), **more):
    url = lambda k: f"http://h.ro/{k}.html"
    frame = spark.createDataFrame([(url(a), url(b)) for a, b in edges], "src string, dst string")
    start = spark.createDataFrame([(url(s),) for s in seeds], "url string")
    bad = spark.createDataFrame([(url(s),) for s in failed], "url string")
    got = graph.crawl_frontier(spark, frame, start, "http://h.ro/", bad, **more)
    return {int(r["url"].split("/")[-1][:-5]): (r["round"], r["ok"]) for r in got.collect()}


def test_long_chain_takes_few_steps(spark, tmp_path):
    n = 2000
    edges = [(k, k + 1) for k in range(n)] + [(k, 0) for k in range(1, n)] + [(5000, 5001), (5001, 5000)]
    got = crawl(spark, edges, [0], root=str(tmp_path / "crawl"))
    assert got == {k: (k, True) for k in range(n + 1)}
    steps = [d for d in os.listdir(tmp_path / "crawl") if d.startswith("tree=")] + os.listdir(tmp_path / "crawl" / "rounds")
    assert len([s for s in steps if "=" in s]) < 20


@pytest.mark.parametrize("seed", range(4))
def test_crawl_equals_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([40, 70, 120]))} | {(k, k + 1) for k in range(20, 40)}
    seeds, failed = [0, rng.randrange(n), 25], {rng.randrange(n) for _ in range(4)}
    expected = breadth_first(edges, seeds, failed)
    got = crawl(spark, sorted(edges), seeds, failed)
    assert got == {k: (d, k not in failed) for k, d in expected.items()}
    some = crawl(spark, sorted(edges), seeds, failed, max_rounds=2)
    assert some == {k: (d, k not in failed) for k, d in expected.items() if d <= 2}


# --- windows of an order -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [["t"], ["-n", "t"], ["n", "-t"], ["d"], ["-d", "n"], ["b"]])
def test_deep_pages_come_from_their_range(spark, order):
    df = spark.range(3000).select(
        F.concat(F.lit("t"), F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0")).alias("t"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("n"),
        F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("d"),
        (F.col("id") % 2).alias("b"),
    )
    rows = [tuple(r) for r in df.collect()]
    place = {c: k for k, c in enumerate(df.columns)}

    def key(row):
        out = []
        for c in order:
            v = row[place[c.removeprefix("-")]]
            out.append((v is not None, v if v is not None else 0) if not c.startswith("-") else (v is None, -v if isinstance(v, (int, float)) else v or 0))
        return out

    if order == ["n", "-t"]:
        rows.sort(key=lambda r: r[0], reverse=True)
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0))
    else:
        rows.sort(key=key)
    seen = []
    for offset in (0, 1234, 2990, 3000, 5000):
        page = paging.offset_page(df, order, offset, 20, shallow=100).collect()
        names = [c.removeprefix("-") for c in order]
        assert [tuple(r[c] for c in names) for r in page] == [tuple(r[place[c]] for c in names) for r in rows[offset : offset + 20]]
        seen += [r["t"] for r in page]
    assert len(seen) == len(set(seen)) == 50


def test_pages_of_ties_hold_every_row_once(spark):
    df = spark.range(600).select(F.lit("same").alias("t"), F.col("id"))
    seen = [r["id"] for offset in range(0, 600, 60) for r in paging.offset_page(df, "t", offset, 60, shallow=100).collect()]
    assert sorted(seen) == list(range(600))
    equal = spark.range(500).select(F.lit(1).alias("t"))
    assert paging.offset_page(equal, "t", 300, 20, shallow=100).count() == 20
    assert paging.offset_page(df.limit(0), "t", 300, 20, shallow=100).count() == 0


def test_numbers_by_hash_have_no_gaps(spark):
    df = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"))
    once, again = windows.number_by_hash(df, ["url"], start=1), windows.number_by_hash(df.repartition(7), ["url"], start=1)
    assert sorted(r["n"] for r in once.collect()) == list(range(1, 1001))
    assert values(once, "url", "n") == values(again, "url", "n")


# --- streams -----------------------------------------------------------------------------------------------------


def test_fifty_batches_leave_few_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    rng, keys = random.Random(4), set()
    for k in range(50):
        some = [rng.randrange(400) for _ in range(12)]
        keys |= set(some)
        spark.createDataFrame([(v,) for v in some], "k long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(source))
    new_keys.write_new_keys(stream, ["k"], out, str(tmp_path / "state")).awaitTermination()
    got = [r["k"] for r in new_keys.read_new_keys(spark, out, "k long").collect()]
    assert sorted(got) == sorted(keys)
    folders_left = [d for d, _, names in os.walk(out) if "_SUCCESS" in names]
    files_left = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(folders_left) <= 2 * new_keys.MERGED + 2
    assert len(files_left) <= 2 * new_keys.MERGED * new_keys.BUCKETS


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    folders_ = new_keys.KeyFolders(spark, str(tmp_path / "keys"))
    stored = spark.range(1000).select(F.col("id").alias("k")).withColumn("bucket", new_keys.key_bucket(["k"]))
    folders_.write(stored, "q", 0, 0)
    fresh = spark.createDataFrame([(5,), (5000,)], "k long").withColumn("bucket", new_keys.key_bucket(["k"]))
    unseen = new_keys.unseen_keys(folders_, "k long", ["k"], fresh, {"q": [(0, 0)]})
    assert values(unseen, "k") == [(5000,)]
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    wanted = sorted(r["bucket"] for r in fresh.collect())
    assert "PartitionFilters: [" in plan and all(str(b) in plan.split("PartitionFilters: [")[1].split("]")[0] for b in wanted)


def test_a_repeated_batch_and_an_unfinished_folder(spark, tmp_path):
    folders_ = new_keys.KeyFolders(spark, str(tmp_path / "keys"))
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long").withColumn("bucket", new_keys.key_bucket(["k"]))
    for batch in range(3):
        folders_.write(key(batch), "q", batch, batch)
    folders_.write(key(0, 1, 2), "q", 0, 2)
    assert folders_.current(folders_.found()["q"]) == [(0, 2)]
    os.remove(tmp_path / "keys" / "query=q" / "first=0" / "last=2" / "_SUCCESS")
    assert folders_.current(folders_.found()["q"]) == [(0, 0), (1, 1), (2, 2)]
    assert values(new_keys.read_new_keys(spark, str(tmp_path / "keys"), "k long"), "k") == [(0,), (1,), (2,)]


# --- sources -----------------------------------------------------------------------------------------------------


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for county in range(6):
        for place in range(4):
            at = tmp_path / "img" / f"county {county}" / f"sat - {place}"
            at.mkdir(parents=True)
            for k in range(3):
                (at / f"{k}.jpg").write_bytes(b"x" * (k + county))
    (tmp_path / "img" / "top.jpg").write_bytes(b"12")
    (tmp_path / "img" / "county 1" / "_hidden").write_bytes(b"12")
    expected = sorted(
        [(f"county {c}/sat - {p}/{k}.jpg", k + c) for c in range(6) for p in range(4) for k in range(3)] + [("top.jpg", 2)], key=repr
    )
    got = files.image_inventory(spark, str(tmp_path / "img"))
    assert values(got, "path", "length") == expected and got.rdd.getNumPartitions() > 20
    assert values(files.image_inventory(spark, f"file:{tmp_path}/img"), "path", "length") == expected
    (tmp_path / "none").mkdir()
    assert files.image_inventory(spark, str(tmp_path / "none")).count() == 0
    assert not folders.reachable("viewfs://store/in")


def test_catalogue_keys_are_checked(spark, tmp_path):
    county = spark.createDataFrame([(1, "AB", "Alba")], "id long, code string, name string")
    city = spark.createDataFrame([(1, 1, "x"), (2, 5, "y"), (2, None, "z")], "id long, county_id long, name string")
    tables = {"account_county": county, "account_city": city}
    got = stores.key_violations(tables)
    assert values(got, "table", "rule", "column", "value", "rows") == [
        ("account_city", "repeated", "id", "2", 2), ("account_city", "unknown", "county_id", "5", 1)
    ]
    with pytest.raises(stores.BrokenKeys, match="account_city.county_id = 5"):
        stores.save_catalogue(tables, str(tmp_path / "cat"))
    assert not os.path.exists(tmp_path / "cat")
    good = {"account_county": county, "account_city": city.filter("id = 1")}
    stores.save_catalogue(good, str(tmp_path / "cat"))
    read = stores.load_catalogue(spark, str(tmp_path / "cat"), tables=list(good), check=True)
    assert values(read["account_city"], "id", "county_id", "name", "siruta") == [(1, 1, "x", None)]
    stores.save_table(city, str(tmp_path / "cat"), "account_city")
    with pytest.raises(stores.BrokenKeys):
        stores.load_catalogue(spark, str(tmp_path / "cat"), tables=list(good), check=True)
    assert stores.jdbc_ranges(None, None, 0) == {} and stores.jdbc_ranges(3, 9, 10) == {}
    assert stores.jdbc_ranges(3, 90, 10, 3) == {"partitionColumn": "id", "lowerBound": "3", "upperBound": "91", "numPartitions": "4"}


def test_rendered_pages_are_dealt_over_tasks(spark, tmp_path):
    """A small file is one task; its rendered pages take long and must not all be parsed there."""
    from placework.queries.page_extracts import detail_pages, listing_pages, result_pages
    from placework.queries.stores import stored_pages

    for name in ("customer", "nation", "region", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for pages in (detail_pages, listing_pages, result_pages, stored_pages):
        assert pages(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_text_of_a_mark_is_squashed_once(spark):
    """What several conditions on one mark need is made once, not in each of them."""
    from placework.operators.html import html_trees
    from placework.operators.pages import page_content

    pages = spark.createDataFrame([(1, "<p>x <b>y</b></p>")], "page_id long, html string")
    plan = page_content(html_trees(pages))._jdf.queryExecution().optimizedPlan().toString()
    # One for the text of marks, one for the line.
    assert plan.count("(?U)") == 2
