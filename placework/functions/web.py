"""URL and image-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: host without scheme, `www.` and last suffix.
PLATFORM_PATTERN = r"(?U)^(?:https?://)?(?:www\.)?((?:[\w|-]+\.)*[\w|-]+)(?:\.[a-z]+)"
AUTHORITY_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
# Fixed value: address of a result page.
RESULT_PAGE = "https://www.google.com/search?q="


def platform_of_url(url: Column) -> Column:
    return F.regexp_extract(url, PLATFORM_PATTERN, 1)


def authority(url: Column) -> Column:
    """Host with port (and user, if written) of an absolute or `//` address; empty otherwise."""
    return F.regexp_extract(url, AUTHORITY_PATTERN, 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def extension_pattern(exts=("htm", "php")) -> str:
    """Matches a trailing `.word` whose word starts with none of `exts`."""
    return r"(?U)\." + "".join(f"(?!{e})" for e in exts) + r"\w+$"


def is_valid_link(
    url: Column, seed_url: Column, exts=("htm", "php"), pattern: str | None = None
) -> Column:
    """At most three dots, a host that the seed has, and no ending that `pattern` (else `exts`) refuses."""
    page = without_fragment(url)
    host = authority(url)
    return (
        (F.length(page) - F.length(F.replace(page, F.lit("."), F.lit(""))) <= 3)
        & (host != "")
        & F.contains(seed_url, host)
        & ~F.rlike(page, F.lit(pattern or extension_pattern(exts)))
    )


def query_param(url: Column, name: str) -> Column:
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def point_from_map_link(url: Column) -> Column:
    """`...?q=lat,long` -> struct(latitude, longitude), both as text."""
    parts = F.split(query_param(url, "q"), ",")
    return F.struct(F.get(parts, 0).alias("latitude"), F.get(parts, 1).alias("longitude"))


def listing_url(url: Column) -> Column:
    """Romanian variant of a listing address; unchanged when it names a variant already."""
    return F.when(F.contains(url, F.lit(".ro.")), url).otherwise(
        F.replace(url, F.lit(".html"), F.lit(".ro.html"))
    )


def large_image(url: Column) -> Column:
    return F.regexp_replace(url, r"max\d00", "max1024x768")


def from_parent(url: Column, seed_url: Column) -> Column:
    return F.replace(url, F.lit("../"), seed_url)


def without_thumb(url: Column) -> Column:
    return F.replace(url, F.lit("zz_"), F.lit(""))


def county_code(index_url: Column) -> Column:
    """County code of an index address of the list site, `BV/index.php?menu=BI` -> `BV`."""
    return F.replace(index_url, F.lit("/index.php?menu=BI"), F.lit(""))


# Names accepted by `rewrite_url`, applied in the order given.
REWRITES = {"listing": listing_url, "large_image": large_image, "no_thumb": without_thumb}


def rewrite_url(url: Column, rules, seed_url: Column | None = None) -> Column:
    for rule in rules:
        url = from_parent(url, seed_url) if rule == "from_parent" else REWRITES[rule](url)
    return url


def quote_query(text: Column) -> Column:
    """Result-page address for a query; path-style quoting, so a space is `%20`."""
    quoted = F.url_encode(text)
    for form, path in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(form), F.lit(path))
    return F.concat(F.lit(RESULT_PAGE), quoted)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension with its dot, or empty; leading dots belong to the name."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def image_name(url: Column, k: Column) -> Column:
    ext = extension(url)
    return F.concat(k.cast("string"), F.lower(F.when(ext == "", ".jpg").otherwise(ext)))


def image_mime(name: Column) -> Column:
    return F.when(extension(name) == ".jpg", "image/jpeg").otherwise("image/png")
