"""Records from web pages: a small document tree, selectors, and tables of selectors by site.

A site is a table of fields and selectors, so that another site is another table. Whatever a page lacks is
null, or an empty array; a page that can't be read gives nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column

from recordloom.sources.web import by_page

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_COMPOUND = re.compile(r"""(?P<tag>[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>\$?=)"?(?P<value>[^"\]]*)"?)?\]""")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], above: Node | None = None):
        self.tag, self.attrs, self.above, self.inside = tag, attrs, above, []

    def walk(self) -> Iterator[Node]:
        """The nodes below, in the order of the page."""
        pending = [n for n in reversed(self.inside) if isinstance(n, Node)]
        while pending:
            node = pending.pop()
            yield node
            pending += [n for n in reversed(node.inside) if isinstance(n, Node)]

    def strings(self) -> Iterator[str]:
        pending = list(reversed(self.inside))
        while pending:
            x = pending.pop()
            if isinstance(x, str):
                yield x
            else:
                pending += reversed(x.inside)

    def text(self) -> str:
        return "".join(self.strings())

    def stripped(self) -> list[str]:
        return [s.strip() for s in self.strings() if s.strip()]

    def fits(self, compound: str) -> bool:
        for m in _COMPOUND.finditer(compound):
            if m["tag"] and self.tag != m["tag"] or m["cls"] and m["cls"] not in (self.attrs.get("class") or "").split() or m["id"] and self.attrs.get("id") != m["id"]:
                return False
            if m["attr"]:
                own = self.attrs.get(m["attr"])
                if own is None or m["op"] == "=" and own != m["value"] or m["op"] == "$=" and not own.endswith(m["value"]):
                    return False
        return True

    def select(self, selector: str) -> list[Node]:
        """Nodes below that fit the last part of a selector, with the parts before it somewhere above, outermost first."""
        *before, last = selector.split()

        def under(node: Node) -> bool:
            left = list(before)
            above = node.above
            while left and above is not None:
                if above.fits(left[-1]):
                    left.pop()
                above = above.above
            return not left

        return [n for n in self.walk() if n.fits(last) and under(n)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)

    def remove(self) -> None:
        self.above.inside.remove(self)

    def close(self) -> None:
        """Cut the tree apart, so that its memory goes at once: nodes name each other, and else wait for the collector of cycles."""
        pending = [self]
        while pending:
            node = pending.pop()
            pending += [n for n in node.inside if isinstance(n, Node)]
            node.above, node.inside = None, []


class _Tree(HTMLParser):
    def __init__(self, raw: bool = False) -> None:
        super().__init__()
        self.root = self.at = Node("", {})
        self.raw = raw

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.above is not None and node.tag != tag:
            node = node.above
        if node.above is not None:
            self.at = node.above

    def handle_data(self, data: str) -> None:
        if self.raw and self.cdata_elem and not getattr(self, "_escapable", False):
            data = data.replace("&amp;", "&")  # scripts' references are never decoded
        self.at.inside.append(data)


def tree(html: str, raw: bool = False) -> Node:
    """raw: character references stay as the page spells them."""
    parser = _Tree(raw)
    parser.feed(html.replace("&", "&amp;") if raw else html)
    return parser.root


def _read(html: str, of: Callable[[Node], dict], raw: bool = False) -> dict:
    page = tree(html, raw)
    try:
        return of(page)
    finally:
        page.close()


def selected(page: Node, selector: str) -> list[str]:
    """The texts of what a selector finds, or behind an @ the values of an attribute."""
    selector, _, attribute = selector.partition("@")
    found = page.select(selector)
    return [n.attrs[attribute] for n in found if attribute in n.attrs] if attribute else [n.text().strip() for n in found]


def fields(html: Column, site: dict[str, str], raw: bool = False) -> Column:
    """Struct of an array for each field of a site, of what its selector finds, in the order of the page; nulls for null.

    raw: character references stay as the page spells them.
    """
    found = lambda page: {name: selected(page, s) for name, s in site.items()}
    return by_page(html, lambda h: dict.fromkeys(site) if h is None else _read(h, found, raw), ", ".join(f"`{name}` array<string>" for name in site))


# Selectors of the first site's markup, fields of one value and of several, and headings of its detail blocks.
FIRST_ONE = {"title": "div#ratingWidget p strong", "rating": 'span[itemprop="ratingValue"]', "content_rating": 'meta[itemprop="contentRating"]@content'}
FIRST_SEVERAL = {
    "cast": "td.itemprop a span.itemprop", "directors": 'div.credit_summary_item span[itemprop="director"] a span', "writers": 'div.credit_summary_item span[itemprop="creator"] a span',
    "genres": 'a[href$="tt_stry_gnr"]', "keywords": 'span[itemprop="keywords"]',
}
FIRST_DETAILS = {
    "Country:": ("production_countries", 'a[itemprop="url"]'), "Language:": ("languages", 'a[itemprop="url"]'), "Production Co:": ("production_companies", 'span[itemprop="creator"] a span'),
    "Also Known As:": ("alternative_titles", ""), "Budget:": ("budget", ""), "Opening Weekend USA:": ("opening_weekend_revenue", ""), "Cumulative Worldwide Gross:": ("revenue", ""),
}
#: Fields of a record, those of several values joined by semicolons.
RECORD = (
    "title", "cast", "directors", "writers", "genres", "keywords", "content_rating", "run_time", "release_year", "languages", "rating", "budget", "revenue", "opening_weekend_revenue",
    "production_companies", "production_countries", "alternative_titles",
)


def _duration(text: str) -> str:
    """Minutes of '1h 20min' or '1h 20m', empty if there are none."""
    h, m = re.search(r"(\d+)\s*h", text), re.search(r"(\d+)\s*m", text)
    return str(60 * int(h[1] if h else 0) + int(m[1] if m else 0)) if h or m else ""


def first_site(page: Node) -> dict[str, str]:
    """The 17 attributes of a page of the first site, empty where it has none."""
    out = dict.fromkeys(RECORD, "")
    for name, selector in FIRST_ONE.items():
        out[name] = next(iter(selected(page, selector)), "")
    for name, selector in FIRST_SEVERAL.items():
        out[name] = ";".join(selected(page, selector)[: 5 if name == "cast" else None])
    times = selected(page, 'time[itemprop="duration"]')
    out["run_time"] = (times[1].split() or [""])[0] if len(times) > 1 else _duration(times[0]) if times else ""
    year = page.first("div#ratingWidget p")
    out["release_year"] = (year.text().split() or [""])[-1].strip("()") if year else ""
    for block in page.select("div.txt-block"):
        heading = block.first("h4")
        name, selector = FIRST_DETAILS.get(heading.text() if heading else "", ("", ""))
        if selector:
            out[name] = ";".join(selected(block, selector))
        elif name and len(strings := block.stripped()) > 1:
            own = strings[1] if name == "alternative_titles" else strings[1].replace(",", "")
            out[name] = f"{out[name]};{own}" if out[name] else own
    return out


#: Crew jobs that count as writing.
WRITING = ("Screenplay", "Writer", "Novel", "Story", "Author")


def second_site(page: Node) -> dict[str, str]:
    """The attributes of a page of the second site among RECORD, empty where it has none."""
    out = dict.fromkeys(RECORD, "")
    one = lambda selector: next(iter(selected(page, selector)), "")
    out |= {"title": one("meta[property=og:title]@content"), "rating": one("div.user_score_chart@data-percent"), "content_rating": one("div.certification span")}
    crew = [[p.text() for p in li.select("p")] for li in page.select("li.profile")]
    jobs = [(p[0], job.strip()) for p in crew if len(p) == 2 for job in p[1].split(",")]
    out["directors"] = ";".join(name for name, job in jobs if job == "Director")
    out["writers"] = ";".join(name for name, job in jobs if job in WRITING)
    out["cast"] = ";".join(p.text() for li in page.select("li.card") if (p := li.first("p")))
    facts = page.first("section.facts.left_column")
    for line in (facts.text() if facts else "").split("\n"):
        for label, name in (("Runtime", "run_time"), ("Budget", "budget"), ("Revenue", "revenue"), ("Original Language", "languages")):
            if line.startswith(label):
                value = line.replace(label, "").strip()
                out[name] = _duration(value) if name == "run_time" else value.replace(",", "") if name != "languages" else value
    out["genres"] = ";".join(selected(page, "section.genres.right_column li"))
    out["keywords"] = ";".join(selected(page, "section.keywords.right_column li"))
    out["release_year"] = one("div.header_poster_wrapper span.release_date").strip("()")
    return out


def records(html: Column, site: Callable[[Node], dict[str, str]] = first_site) -> Column:
    """Struct of RECORD of each page; empty fields are null, and so are all of a null page."""
    found = lambda page: {name: value or None for name, value in site(page).items()}
    return by_page(html, lambda h: dict.fromkeys(RECORD) if h is None else _read(h, found), ", ".join(f"`{name}` string" for name in RECORD))


#: Containers of article text by site, the first that a page has counts; what goes out of it, the first found or all of them.
ARTICLES = (
    ("section#article-section-1", ("aside",), ()),
    ("div.article-content", ("div", "aside"), ()),
    ('article[itemprop="articleBody"]', ("div",), ()),
    ("article.node-article", ("div.content-img-wrp", "div#dfp-ad-mosad_1-wrapper", "div.article-tags", "div#bottom-story-socials"), ("a.people-articles", "a.name", "a.more")),
    ("div.story-body", ("div", "aside"), ("div.bbccom_advert",)),
    ("div#article-body", ("p",), ()),
)


def article_text(page: Node, sites: tuple = ARTICLES) -> str | None:
    """The text of the first container that the page has, without what its site adds; None if it has none."""
    for container, once, always in sites:
        if (found := page.first(container)) is None:
            continue
        for selector in once:
            if (n := found.first(selector)) is not None:
                n.remove()
        for selector in always:
            for n in found.select(selector):
                if n in n.above.inside:
                    n.remove()
        return found.text()
    return None


def article_texts(html: Column, sites: tuple = ARTICLES) -> Column:
    found = lambda page: {"text": article_text(page, sites)}
    return by_page(html, lambda h: {"text": None} if h is None else _read(h, found), "text string")["text"]
