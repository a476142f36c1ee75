"""Jobs on small inputs: what a second run on the first one's output changes."""

from pyspark.sql import functions as F

from placework.plans import catalogue, points
from placework.queries import render
from placework.schemas import CATALOGUE


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def dimensions(spark):
    city = spark.createDataFrame(
        [(1, 10, "Satu Nou"), (2, 20, "Brașov"), (3, 30, "Voluntari")], "id long, county_id long, name string"
    )
    county = spark.createDataFrame([(10, "AB", "Alba"), (20, "BV", "Brașov"), (30, "IF", "Ilfov")], "id long, code string, name string")
    return city, county


def list_pages(spark):
    rows = spark.createDataFrame(
        [
            (1, "Biserica A", "/a", "brasov", "Braşov", "*Biserică", "45.6,25.5"),
            (1, "Biserica A again", "/a", "brasov", "Braşov", "*Biserică", "1.0,1.0"),
            (2, "Biserica B", "/b", "VOLUNTARI", "Municipiul Bucureşti", "", ""),
            (2, "Stored", "/s", "brasov", "Braşov", "*Biserică", "45.6,25.5"),
        ],
        "page_id long, title string, url string, city string, county string, mark string, point string",
    )
    row = render.list_row(
        F.col("title"), F.col("url"), F.lit("ortodox"), F.lit("3"), F.lit(""), F.col("city"), F.col("county"), F.col("mark"), F.col("point")
    )
    grouped = rows.withColumn("row", row).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("title", "row"))).alias("r"))
    html = render.list_page(F.array_join(F.transform("r", lambda x: x["row"]), ""))
    return grouped.select("page_id", F.concat(F.lit("/p"), "page_id").alias("url"), F.lit(200).alias("status"), html.alias("html"))


def test_catalogue_is_complete_after_one_run(spark):
    city, county = dimensions(spark)
    stored = spark.createDataFrame([(7, "/s", "old title")], "id long, url string, title string")
    state = catalogue.ingest_catalogue(list_pages(spark), city, county, stored)
    assert values(state, "url", "title", "city_id", "county_id", "stage") == [
        ("/a", "Biserica A", 2, 20, "new"), ("/b", "Biserica B", 3, 30, "new"), ("/s", "old title", None, None, None)
    ]
    assert {r["id"] for r in state.collect()} == {7, 8, 9}
    again = catalogue.ingest_catalogue(list_pages(spark), city, county, state)
    assert values(again, *state.columns) == values(state, *state.columns)


def test_second_transfer_changes_nothing(spark):
    rows = spark.createDataFrame(
        [
            (1, None, "A", "ortodox", 2, 20, 45.6, 25.5, None, 3, "/a", "x", None, "fixed"),
            (2, "k", "B", "ortodox", 2, 20, 45.6, 25.5, "L", 1, "/b", "x", None, "fixed"),
            (3, "k", "C", "ortodox", 2, 20, None, None, "L", 1, "/c", "x", None, "fixed"),
            (4, "k", "D", "ortodox", 2, 20, 45.0, 25.0, "L", 1, "/d", "x", None, "new"),
        ],
        CATALOGUE["biserici_romania"],
    )
    empty = lambda name: spark.createDataFrame([], CATALOGUE[name])
    args = ("site.example", "site", "2024-01-02 03:04:05")
    first = points.reconcile_points(
        rows, empty("interest_points"), empty("interest_points_platform"), empty("interest_points_facility"), *args
    )
    # The second row is at the place of the first one, which became a point; it stays.
    assert values(first["rows"], "id", "stage") == [(1, "moved"), (2, "fixed"), (3, "moved"), (4, "new")]
    assert values(first["points"], "title", "status", "id") == [("A", None, 1), ("C", "invalid", 2)]
    second = points.reconcile_points(first["rows"], first["points"], first["platforms"], first["facilities"], *args)
    for name in ("rows", "points", "platforms", "facilities"):
        columns = [c for c in first[name].columns]
        assert values(second[name], *columns) == values(first[name], *columns)
    assert second["duplicates"].count() == 0


def test_keys_are_repaired_and_carried(spark):
    rows = spark.createDataFrame(
        [(1, "old", "A", "ortodox", 2, 20, 45.6, 25.5, None, 3, "/a", "x", None, "fixed")], CATALOGUE["biserici_romania"]
    )
    stored = spark.createDataFrame([(5, "bad", "A", 45.6, 25.5, 2)], "id long, geo_hash_id string, title string, latitude double, longitude double, city_id long")
    platform = spark.createDataFrame([(1, "bad", "site.example/a"), (2, "bad", "later")], "id long, geo_hash_id string, url string")
    facility = spark.createDataFrame([(1, "bad", "info"), (2, "other", "info")], "id long, geo_hash_id string, type string")
    done = points.reconcile_points(rows, stored, platform, facility, "site.example", "site", "2024-01-02 03:04:05")
    key = done["rows"].collect()[0]["geo_hash_id"]
    assert len(key) == 64 and done["rows"].collect()[0]["stage"] == "moved"
    assert values(done["points"], "id", "geo_hash_id") == [(5, key)]
    assert values(done["platforms"], "id", "geo_hash_id") == [(1, key), (2, key)]
    assert set(values(done["facilities"], "id", "geo_hash_id")) == {(1, key), (2, "other")}


def test_listings_of_other_counties_are_read_again(spark):
    from placework.plans.listings import import_listings

    city, county = dimensions(spark)
    csv = spark.createDataFrame(
        [("1", "http://www.l.example/1.html", "Brasov", "Casa A"), ("2", "http://www.l.example/2.html", "Satu Nou", "Casa B")],
        "`Hotel ID` string, URL string, City string, Hotels string",
    )
    page = lambda k: spark.range(1).select(
        F.lit(f"http://www.l.example/{k}.ro.html").alias("url"),
        render.listing_page(
            F.lit("45.1"), F.lit("25.1"), F.lit("n"), F.lit("c"), F.lit("Str. 1"), F.lit("120"), F.lit(k)
        ).alias("html"),
    )
    stored = spark.createDataFrame([(7, 1, "old", 20), (9, 2, "old", 10)], "id long, hotel_id long, title string, county_id long")
    places = spark.createDataFrame([], "id long, name string, latitude double, longitude double, place_id string")
    details = spark.createDataFrame([], "place_id string, url string, formatted_phone_number string")
    results = spark.createDataFrame([], "hotel_id long, html string")
    run = lambda counties: import_listings(
        csv, page(1).union(page(2)), places, details, results, city, county, stored, "2024-01-02 03:04:05", counties
    )
    assert values(run(None)["listings"], "id", "title") == [(7, "old"), (9, "old")]
    done = run([20])
    assert values(done["listings"], "id", "hotel_id", "title", "county_id") == [(7, 1, "old", 20), (9, 2, "Casa B", 10)]
    assert values(done["platforms"], "platform", "avg_price") == [("l", "120")]
