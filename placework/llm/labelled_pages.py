"""Labelled pages for the extraction model: rendered page layouts whose main text is known by construction.

Each page is put together at random from ways in which sites mark up an article and what stands around and inside it.
Elements that begin main text carry the attribute `data-main="1"`, and what is not main text inside them
`data-main="0"`; the model sees neither.
"""

from __future__ import annotations

import random

PAGES = 1200

_SYLLABLES = "an er in on re st ti es en at ou th ed nd ha to or ea hi is ar te se al".split()


def _words(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for k in range(0, len(words), r.randint(6, 14)):
        words[k] = words[k].capitalize()
    return " ".join(words) + r.choice([".", ".", ".", "", "?", "&amp;", " &copy;"])


def _inline(r: random.Random, text: str) -> str:
    words = text.split(" ")
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        k = r.randrange(len(words))
        tag = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"', 'a href="/y"', 'a href="/z"'])
        words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
    if r.random() < 0.1:
        words.insert(r.randrange(len(words)), "<br>")
    return " ".join(words)


def _links(r: random.Random, low: int = 2, high: int = 9) -> str:
    items = [f'<a href="/{r.randrange(999)}">{_words(r, 1, 4)}</a>' for _ in range(r.randint(low, high))]
    if r.random() < 0.6:
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    return r.choice([" ", " | ", ""]).join(items)


def _name(r: random.Random, *names: str) -> str:
    name = r.choice(names)
    name = r.choice([name, name, f"{name}-wrap", f"site-{name}", f"{name} clearfix", f"{name}-box", f"page_{name}"])
    return r.choice(["class", "class", "class", "id"]) + f'="{name}"'


def _heading(r: random.Random) -> str:
    h = r.choice(["h2", "h3", "h4"])
    return f"<{h}>{_words(r, 1, 5)}</{h}>"


def _form(r: random.Random) -> str:
    fields = "".join(
        r.choice(['<input type="text">', "<label>{}</label>", "<select><option>{}</option><option>{}</option></select>", "<textarea>{}</textarea>", "<p>{}</p>"]).replace("{}", _words(r, 1, 6))
        for _ in range(r.randint(1, 4))
    )
    return f'<form action="/f">{fields}<button>{_words(r, 1, 2)}</button></form>'


def _around(r: random.Random) -> str:
    """Something that is not main text."""
    kind = r.choice(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share", "script", "related"])
    off = ' data-main="0"'
    if kind == "nav":
        return r.choice([f"<nav{off}>{_links(r)}</nav>", f"<div{off} {_name(r, 'nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'topnav', 'toc', 'pagination', 'pager')}>{_links(r)}</div>", f"<ul{off} {_name(r, 'menu', 'nav', 'links')}><li>{_links(r)}</li></ul>"])
    if kind == "header":
        inside = r.choice([f"<h1>{_words(r, 1, 4)}</h1>", f"<p>{_words(r, 2, 8)}</p>", "", f"<div>{_words(r, 1, 5)}</div>"]) + r.choice(["", _links(r), f"<p>{_words(r, 3, 14)}</p>"])
        return r.choice([f"<header{off}>{inside}</header>", f"<div{off} {_name(r, 'header', 'masthead', 'topbar', 'logo', 'branding')}>{inside}</div>"])
    if kind == "footer":
        inside = r.choice(["&copy; ", "", "<p>&copy; "]) + _words(r, 2, 30) + r.choice(["", _links(r)])
        return r.choice([f"<footer{off}>{inside}</footer>", f"<div{off} {_name(r, 'footer', 'copyright', 'bottom', 'colophon', 'legal')}>{inside}</div>"])
    if kind == "aside":
        inside = "".join(r.choice([_heading(r), _links(r), f"<p>{_words(r, 4, 60)}</p>"]) for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside{off}>{inside}</aside>", f"<div{off} {_name(r, 'sidebar', 'side', 'widget', 'rail', 'aside', 'infobox', 'sidebar-right')}>{inside}</div>", f"<section{off} {_name(r, 'sidebar', 'widget')}>{inside}</section>"])
    if kind == "ad":
        inside = r.choice([_words(r, 2, 40), f"<p>{_words(r, 3, 40)}</p>", f'<a href="/ad">{_words(r, 2, 12)}</a>', f"{_words(r, 3, 12)} <a href='/b'>{_words(r, 1, 3)}</a>"])
        tag = r.choice(["div", "div", "div", "section", "aside", "p", "span"])
        return f"<{tag}{off} {_name(r, 'ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'promotion', 'banner', 'adslot', 'commercial')}>{inside}</{tag}>"
    if kind == "notice":
        inside = f"<p>{_words(r, 4, 50)}</p>" if r.random() < 0.6 else _words(r, 4, 50)
        tag = r.choice(["div", "div", "section", "p", "aside"])
        inside += r.choice(["", f"<button>{_words(r, 1, 2)}</button>", f"<a href='/c'>{_words(r, 1, 2)}</a>"])
        return f"<{tag}{off} {_name(r, 'cookie', 'cookies', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'overlay', 'disclaimer', 'warning', 'paywall', 'announcement')}>{inside}</{tag}>"
    if kind == "form":
        return r.choice([_form(r).replace("<form", f"<form{off}", 1), f"<div{off} {_name(r, 'search', 'newsletter', 'subscribe', 'signup', 'login', 'subscription', 'contact')}>{_heading(r)}{_form(r)}</div>"])
    if kind == "comments":
        one = lambda: r.choice([f'<div class="comment"><p>{_words(r, 3, 90)}</p></div>', f"<li>{_words(r, 3, 60)}</li>", f'<article class="comment"><h4>{_words(r, 1, 2)}</h4><p>{_words(r, 3, 90)}</p></article>', f'<div class="reply">{_words(r, 3, 60)}</div>', f"<p>{_words(r, 3, 70)}</p>", f"<blockquote>{_words(r, 3, 60)}</blockquote>"])
        inside = r.choice([_heading(r), ""]) + "".join(one() for _ in range(r.randint(1, 5))) + r.choice(["", _form(r)])
        tag = r.choice(["section", "div", "div", "ol", "ul", "aside"])
        return f"<{tag}{off} {_name(r, 'comments', 'comment', 'comment-list', 'responses', 'discussion', 'replies', 'reader-comments', 'disqus', 'reviews')}>{inside}</{tag}>"
    if kind == "share":
        return f"<div{off} {_name(r, 'share', 'social', 'sharing', 'follow', 'tags', 'meta-links')}>{_links(r, 2, 5)}</div>"
    if kind == "related":
        inside = _heading(r) + r.choice([_links(r), "".join(f"<div><a href='/r'>{_words(r, 2, 9)}</a><p>{_words(r, 3, 25)}</p></div>" for _ in range(3))])
        return f"<{r.choice(['div', 'section', 'aside'])}{off} {_name(r, 'related', 'recommended', 'more', 'popular', 'trending', 'teaser', 'read-more')}>{inside}</div>".replace("</div>", "</div>", 1)
    return r.choice([f"<script{off}>var t='{_words(r, 2, 9)}</p>';</script>", f"<style{off}>p{{margin:0}}</style>", f"<noscript{off}>{_words(r, 2, 12)}</noscript>", f"<template{off}><p>{_words(r, 2, 30)}</p></template>", f"<!-- {_words(r, 2, 5)} -->", f"<iframe{off}>{_words(r, 1, 4)}</iframe>", f"<svg{off}><title>{_words(r, 1, 2)}</title></svg>"])


def _block(r: random.Random) -> str:
    """A block of main text."""
    kind = r.choices(["p", "short", "h", "list", "quote", "table", "pre", "figure", "bare", "broken", "div", "dl"], [40, 10, 9, 6, 5, 4, 2, 3, 3, 8, 6, 2])[0]
    text = lambda low, high: _inline(r, _words(r, low, high))
    if kind == "p":
        return f"<p>{text(8, 160)}</p>"
    if kind == "short":
        return f"<p>{text(1, 6)}</p>"
    if kind == "h":
        h = r.choice(["h2", "h2", "h3", "h4"])
        return f"<{h}>{text(1, 8)}</{h}>"
    if kind == "list":
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{text(2, 30)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
    if kind == "quote":
        return f"<blockquote><p>{text(5, 60)}</p></blockquote>"
    if kind == "table":
        return "<table>" + "".join(f"<tr><th>{text(1, 3)}</th><td>{text(1, 8)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
    if kind == "pre":
        return f"<pre><code>{_words(r, 4, 30)}</code></pre>"
    if kind == "figure":
        return f'<figure><img src="/i.png"><figcaption>{text(2, 16)}</figcaption></figure>'
    if kind == "bare":
        return text(6, 80) + "<br>"
    if kind == "broken":
        return r.choice([f"<p><b>{text(4, 90)}<br><p>{text(4, 90)}</p>", f"<p>{text(5, 60)}<p>{text(5, 60)}", f"<p>{text(5, 60)}<br><br>{text(5, 60)}</p>"])
    if kind == "dl":
        return f"<dl><dt>{text(1, 4)}</dt><dd>{text(4, 30)}</dd></dl>"
    return f"<div>{_block(r)}</div>"


# Names of wrappers inside an article that say little, though words in them are those of notices and adverts too.
_WRAPPERS = (
    "message message-body ad-free no-ads text-block alert-text notice-text row col content-inner inner wrap box block group "
    "paragraph rich-text comment-free promo-text side-by-side header-text cookie-recipe social-history"
).split()


def _wrapped(r: random.Random) -> str:
    """Paragraphs of an article in a wrapper of their own."""
    inside = "".join(f"<p>{_inline(r, _words(r, 12, 120))}</p>" for _ in range(r.choice([1, 1, 2, 3])))
    return f'<div class="{r.choice(_WRAPPERS)}">{inside}</div>'


def _nested(r: random.Random, inside: str) -> str:
    depth = r.choice([1, 2, 3, 8, 40])
    return "<div>" * depth + inside + "</div>" * depth


def _plain_text(r: random.Random) -> str:
    """Main text without paragraphs: lines with breaks between them."""
    lines = [_inline(r, _words(r, 8, 120)) for _ in range(r.choice([1, 2, 3, 6]))]
    return r.choice(["<br><br>", "<br>", "<br/>\n<br/>"]).join(lines)


def _plain_page(r: random.Random, before: str, after: str) -> str:
    """Pages whose main text has no element with a telling name around it."""
    on, off = ' data-main="1"', ' data-main="0"'
    text = _plain_text(r) if r.random() < 0.6 else "".join(f"<p>{_inline(r, _words(r, 10, 90))}</p>" for _ in range(r.choice([1, 2, 4, 9])))
    kind = r.choice(["body", "body", "div", "div", "nested", "nested", "table", "table", "links", "links", "center"])
    if kind == "body":
        # Text and what stands around it are children of the body; or nothing but text.
        return f"<body{on}>{before if r.random() < 0.6 else ''}{text}{after if r.random() < 0.6 else ''}</body>"
    if kind == "div":
        return f"<body>{before}<div{on}>{text}</div>{after}</body>"
    if kind == "nested":
        return f"<body>{before}{_nested(r, f'<div{on}>{text}</div>')}{after}</body>"
    if kind == "table":
        menu = f"<td{off}>{_links(r)}</td>"
        cells = r.choice([menu + f"<td{on}>{text}</td>", f"<td{on}>{text}</td>" + menu, menu + f"<td{on}>{text}</td>" + menu])
        top = r.choice(["", f"<tr{off}><td colspan=2>{_words(r, 1, 5)}</td></tr>", f"<tr{off}><td>{_links(r)}</td></tr>"])
        bottom = r.choice(["", f"<tr{off}><td>&copy; {_words(r, 2, 9)}</td></tr>"])
        return f"<body>{before if r.random() < 0.3 else ''}<table>{top}<tr>{cells}</tr>{bottom}</table>{after if r.random() < 0.3 else ''}</body>"
    if kind == "links":
        linked = "".join(f'<p><a href="/{k}">{_words(r, 6, 40)}</a></p>' for k in range(r.choice([3, 5, 8])))
        title = r.choice(["", f"<h1>{_words(r, 2, 8)}</h1>"])
        return f"<body>{before}<article{on}>{title}{linked}</article>{after}</body>"
    return f"<body>{before}<center{on}>{text}</center>{after}</body>"


def _main(r: random.Random) -> str:
    parts = [r.choice([f"<h1>{_words(r, 2, 10)}</h1>", f"<h1>{_words(r, 2, 10)}</h1>", f"<h2>{_words(r, 2, 10)}</h2>", ""])]
    size = r.choice([1, 1, 2, 3, 5, 8, 12, 12, 40])
    plain = size == 40 and r.random() < 0.7
    for _ in range(size):
        # Long articles of many short paragraphs, too.
        parts.append(f"<p>{_words(r, 2, 12)}</p>" if plain else _wrapped(r) if r.random() < 0.06 else _block(r))
        if r.random() < 0.12:
            parts.append(_around(r))
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        parts.append(_around(r))
    inside = "".join(parts)
    on = ' data-main="1"'
    name = _name(r, "content", "post", "entry", "entry-content", "article-body", "story", "main", "main-content", "text", "body", "article", "post-content")
    return r.choices(
        [f"<article{on}>{inside}</article>", f"<main{on}>{inside}</main>", f"<main{on}><article>{inside}</article></main>", f"<div{on} {name}>{inside}</div>", f"<div><div{on} {name}>{inside}</div></div>", f"<section{on} {name}>{inside}</section>", f"<article{on} {name}><div>{inside}</div></article>", f"<div{on}>{inside}</div>"],
        [8, 2, 3, 4, 2, 2, 2, 2],
    )[0]


def labelled_pages(pages: int = PAGES, seed: int = 3) -> list[str]:
    out = []
    for number in range(pages):
        r = random.Random(seed * 1_000_003 + number)
        before = "".join(_around(r) for _ in range(r.choice([0, 1, 2, 2, 3, 4])))
        after = "".join(_around(r) for _ in range(r.choice([0, 1, 1, 2, 3, 4])))
        head = f"<head><title>{_words(r, 2, 9)}</title>{r.choice(['', '<style>p{margin:0}</style>', '<script>track(1);</script>'])}</head>"
        if r.random() < 0.3:
            out.append(f"<!DOCTYPE html><html>{head}{_plain_page(r, before, after)}</html>")
            continue
        main = _main(r)
        if r.random() < 0.08:
            main = _nested(r, main)
        middle = before + main + after
        if r.random() < 0.3:
            middle = f'<div {_name(r, "page", "container", "wrapper", "layout")}>{middle}</div>'
        out.append(f"<!DOCTYPE html><html>{head}<body>{middle}" + r.choice(["</body></html>", "</body></html>", ""]))
    return out
