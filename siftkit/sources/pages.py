"""Web page extraction (A11, A12) as a job over a table of pages, by selectors.

The defaults fit the test pages; ``NEWS_LINKS`` and ``NEWS_ARTICLE`` are those of the news site.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Selector, Step, with_selected

# The selectors of the news site's listing and detail pages.
NEWS_LINKS = Selector((Step("ul", deep=True, holds=(("class", "list-style-none"),)), Step("li", without=("id",)),
                       Step("h3", deep=True), Step("a")), "href")
NEWS_ARTICLE = {
    "published_time": Selector((Step("meta", deep=True, equal=(("property", "article:published_time"),)),), "content"),
    "title": Selector((Step("meta", deep=True, equal=(("property", "og:title"),)),), "content"),
    "content": Selector((Step("div", deep=True, equal=(("class", "article-body"),)), Step("p")), text="all"),
    "category": Selector((Step("meta", deep=True, equal=(("name", "section"),)),), "content"),
    "keywords": Selector((Step("div", deep=True, equal=(("class", "article-hash-tag"),)),
                          Step("span", equal=(("class", "hash-tag"),)), Step("a"))),
}
NEWS_TEMPLATE = "https://www.chinatimes.com%s?chdtv"

PAGE_LINKS = Selector((Step("nav", deep=True), Step("li", deep=True, without=("id",)), Step("a")), "href")
PAGE_ARTICLE = NEWS_ARTICLE | {
    "title": Selector((Step("title", deep=True),)),
    "content": Selector((Step("article", deep=True), Step("p")), text="all"),
    "keywords": Selector((Step("nav", deep=True), Step("ul"), Step("li"), Step("a"))),
}


def extract_links(pages: DataFrame, html: str = "html", url: str = "url", links: Selector = PAGE_LINKS,
                  template: str = "%s%s") -> DataFrame:
    """Listing page -> one row per detail URL ``(page_id, link_idx, link)``.

    ``template`` is filled with the page's scheme and host, and the link; with one place, with
    the link alone.
    """
    host = F.regexp_extract(F.col(url), "^(https?://[^/]+)", 1)
    found = with_selected(pages.select("page_id", host.alias("_host"), F.col(html).alias("_html")), {"_links": links}, "_html")
    each = found.select("page_id", "_host", F.posexplode("_links").alias("link_idx", "_href"))
    filled = F.format_string(template, *([F.col("_host")] if template.count("%s") > 1 else []), F.col("_href"))
    return each.select("page_id", "link_idx", filled.alias("link"))


def extract_article(pages: DataFrame, html: str = "html", selectors: dict[str, Selector] = PAGE_ARTICLE, item_type: str = "news") -> DataFrame:
    """Detail page -> news item.

    ``published_time``, ``title`` and ``category`` are the first match or null; ``content`` (text
    nodes) and ``keywords`` are all matches.
    """
    found = with_selected(pages.select("page_id", "url", F.col(html).alias("_html")), selectors, "_html")
    first = {name: F.get(name, 0).alias(name) for name in ("published_time", "title", "category")}
    return found.select("page_id", "url", first["published_time"], first["title"], "content", first["category"], "keywords",
                        F.lit(item_type).alias("item_type"))
