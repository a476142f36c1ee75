"""Pages written from the test tables with column expressions.

The stored test pages have links and paragraphs only; tables, images, metadata, listings and search
results are written here, read back by the extractors and compared with the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html(*parts) -> Column:
    """Concatenate text and columns; a number is written as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listing_page(
    lat: Column, lon: Column, name: Column, city: Column, street: Column, price: Column, key: Column
) -> Column:
    """A lodging page: map link, address, summary, surroundings, facilities, beds, images, JSON-LD."""
    return html(
        '<!DOCTYPE html><html><head><title>', name, '</title><meta name="keywords" content="x">'
        '<meta name="description" content="Short ', name, '"><script type="application/ld+json">'
        '{"@type":"Hotel","priceRange":"de la ', price, ' lei","address":{"streetAddress":"', street,
        '"}}</script></head><body><a class="show_map map_static_zoom_in" style="background:url(m?c=', lat, ",", lon,
        '&z=1.5)" href="#map">map</a><span class="hp_address_subtitle jq_tooltip"> ', street, ", ", city,
        ' </span><div id="summary">\n<p>Long ', name, '</p>\n<p>by the lake</p></div>'
        '<div class="a hp-surroundings-category"><h3> Natural </h3><ul><li> Lake \n ', city,
        '<li>Hill</ul></div><div class="facilitiesChecklistSection"><h5>Food</h5><ul><li>Bar</li><li>', name,
        '</li></ul></div><div class="facilitiesChecklistSection"><ul><li>no heading</li></ul></div>'
        '<span class="occupancy_multiplier_number"> 3 </span><ul><li class="bedroom_bed_type">1 bed\n</li></ul>'
        '<img class="hide" src="/img/max300/', key, '.jpg"><img class="hide" src="/img/max500/b.jpg">'
        "</body></html>",
    )


def result_page(blocks: Column) -> Column:
    return html("<html><body><div id=search>", blocks, "</div></body></html>")


def result_block(href: Column, title: Column, said: Column) -> Column:
    return html(
        '<div class="g rc"><h3><a href="', href, '">', title, '</a></h3><span class=st><em>', said,
        '</em> and <a href="/other">40 lei</a></span></div>',
    )


def detail_page(
    county: Column, city: Column, street: Column, phone: Column, lat: Column, lon: Column, images: Column
) -> Column:
    """A detail page: label/value rows (one label twice, one contact unknown), map link, images."""
    row = lambda label, value: ["<tr><td>", label, "</td><td>", value, "</td></tr>"]
    return html(
        "<html><body><table>", *row("Judeţ:", "header row"), *row("Judeţ:", county), *row("Localitate:", city),
        *row("Adresa:", street), *row("Adresa:", "later"), *row("Telefon :", phone),
        *row("Detalii:", "NU deţinem informaţii"), "<tr><td>one cell</td></tr></table>",
        '<a class="fancybox-google btn" href="https://maps.example.com/?q=', lat, ",", lon, '&z=3">map</a>',
        images, "</body></html>",
    )


def list_page(rows: Column) -> Column:
    """A list page as the catalogue site writes it; `rows` is the text of its table rows."""
    return html(
        "<html><body><table><tr><th></th><th>Denumire</th><th>Religie</th><th>Fotografii</th><th>Cod LMI</th>"
        "<th>Localitate</th><th>Judeţ</th><th>Localizare</th></tr>", rows, "</table></body></html>",
    )


def list_row(
    title: Column, url: Column, religion: Column, photos: Column, code: Column, city: Column, county: Column,
    mark: Column, point: Column,
) -> Column:
    return html(
        '<tr><td>no</td><td><a href="', url, '">', title, "</a></td><td>", religion, "</td><td>", photos,
        "</td><td>", code, "</td><td>", city, "</td><td>", county, '</td><td title="Coordonate: ', point, '">',
        mark, "</td></tr>",
    )
