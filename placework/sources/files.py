"""Text, CSV, XML files, stored pages and posts, image folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LISTING_CSV
from .folders import FolderListing, reachable

SITEMAP_ROOT = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def read_listing_csv(
    spark: SparkSession, path: str, schema: str = LISTING_CSV, multi_line: bool = True
) -> DataFrame:
    """CSV with a header and quoted values, all text; an empty table when nothing is there.

    Columns go by the names in the header: those of `schema` come first (NULL when the header lacks one), others are
    kept after them. All files of a path have the same header; another one is an error when it is read. Quoted values may
    span lines, so a file is read by one task; `multi_line=False` splits large files, for lists whose values have no
    line breaks.
    """
    names = T.StructType.fromDDL(schema).fieldNames()
    try:
        rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', enforceSchema=False)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # A byte order mark belongs to no name.
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    wanted = [F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]
    return rows.select(*wanted, *[F.col(f"`{c}`") for c in rows.columns if c not in names])


def literal_to_json(line: Column) -> Column:
    """A flat tuple or list literal as a JSON array.

    Quotes are swapped outside the text only: pieces are taken one by one, so a `'` or `,` inside a
    double-quoted value stays what it is.
    """
    token = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"\s()\[\]][^,'"()\[\]]*)"""
    body = F.regexp_replace(F.btrim(line), r"^[\[(]|[\])]$", "")
    pieces = F.regexp_extract_all(body, F.lit(token), F.lit(1))

    def as_json(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        plain = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
        text = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
        word = F.btrim(p)
        return (
            F.when(F.rlike(p, F.lit("""^['"]""")), text)
            .when(word == "None", "null")
            .when(word.isin("True", "False"), F.lower(word))
            .otherwise(word)
        )

    return F.concat(F.lit("["), F.array_join(F.transform(pieces, as_json), ","), F.lit("]"))


def read_literal_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every non-empty line of every `*.txt` below the folder, as columns of `schema` in their order."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt").filter("trim(value) <> ''")
    values = lines.select(F.from_json(literal_to_json(F.col("value")), "array<string>").alias("v"))
    return values.select(
        *[F.get("v", i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    )


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One item per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_sitemap(df: DataFrame, path: str, url: str = "url") -> None:
    """Sitemap files, one per partition."""
    df.select(F.col(url).alias("loc")).write.format("xml").mode("overwrite").options(
        rowTag="url", rootTag=SITEMAP_ROOT
    ).save(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").schema("loc STRING").options(rowTag="url").load(path)


def load_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored page snapshots, split into (usable, failed)."""
    good = (F.col("status") == 200) & F.col("html").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return pages.filter(good), pages.filter(~good)


def load_posts(posts: DataFrame, post_type: str | None = None) -> DataFrame:
    """Posts of one type, or of every type. On a table partitioned by post_type only that part is read."""
    return posts if post_type is None else posts.filter(F.col("post_type") == post_type)


def save_posts(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").partitionBy("post_type").parquet(path)


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below an image root: path relative to the root, length. File contents are not read.

    Folders are listed by tasks where Arrow reaches the store (`sources.folders`); other stores are listed by
    Spark's file index, which holds all names in the driver.
    """
    if reachable(root):
        spark.dataSource.register(FolderListing)
        return spark.read.format(FolderListing.name()).option("path", root).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    clean = root.split(":", 1)[-1].rstrip("/") + "/"
    clean = "/" + clean.lstrip("/")
    return files.select(
        F.substring(relative, F.lit(len(clean) + 1), F.length(relative)).alias("path"), "length"
    )
