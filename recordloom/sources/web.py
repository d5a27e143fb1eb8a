"""Web pages: link generation, links and attributes of HTML, article text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Pages whose results are sent back together.
PAGES = 256
SKIPPED = {"script", "style", "nav", "aside", "header", "footer", "noscript"}


def page_links(spark: SparkSession, base: str, search: str, first: int, last: int) -> DataFrame:
    """(url) of numbered list pages."""
    return spark.range(first, last + 1).select(F.concat(F.lit(base + search), F.col("id").cast("string")).alias("url"))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def hrefs(html: Column, base: str = "") -> Column:
    """Links in order; those to the same site get the base before them."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1)), lambda h: F.when(h.startswith("/"), F.concat(F.lit(base), h)).otherwise(h))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


class _Article(HTMLParser):
    """Text of the first <article>, or of the whole page, without what is skipped; the first heading and the paragraphs' number."""

    def __init__(self) -> None:
        super().__init__()
        self.skip, self.inside, self.heading, self.paragraphs = 0, 0, "", 0
        self.body: list[str] = []
        self.all: list[str] = []
        self.in_heading = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED or tag == "div" and dict(attrs).get("class") == "ad":
            self.skip += 1
        elif tag == "div" and self.skip:
            self.skip += 1
        self.inside += tag == "article"
        self.in_heading = tag == "h1" and not self.heading
        self.paragraphs += tag == "p" and not self.skip

    def handle_endtag(self, tag: str) -> None:
        if self.skip and (tag in SKIPPED or tag == "div"):
            self.skip -= 1
        self.inside -= tag == "article" and self.inside > 0
        if tag == "h1":
            self.in_heading = False

    def handle_data(self, data: str) -> None:
        if self.in_heading:
            self.heading += data
        if not self.skip and data.strip():
            (self.body if self.inside else self.all).append(data.strip())


def article(html: str | None) -> tuple[str | None, str | None, int]:
    if html is None:
        return None, None, 0
    p = _Article()
    p.feed(html)
    return p.heading.strip() or None, " ".join(p.body or p.all) or None, p.paragraphs


def by_page(html: Column, read: Callable[[str | None], dict], schema: str) -> Column:
    """Struct of what is read of each page. A batch stays in Arrow's memory: of its pages one at a time is a string, and its results go in parts."""
    kind = to_arrow_type(StructType.fromDDL(schema))

    @F.arrow_udf(schema)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for at in range(0, len(pages), PAGES):
                yield pa.array((read(h.as_py()) for h in pages.slice(at, PAGES)), kind)

    return found(html)


def articles(html: Column) -> Column:
    """Struct of heading, body and number of paragraphs of each page; nulls where there is none."""
    names = ("heading", "body", "paragraphs")
    return by_page(html, lambda h: dict(zip(names, article(h))), "heading string, body string, paragraphs int")


def frontier(links: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Links not yet done, repeated ones kept."""
    return links.join(done.select(key).distinct(), key, "left_anti")


def distinct_frontier(links: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Distinct links not yet done."""
    return links.select(key).subtract(done.select(key))
