"""Crawled pages to news records, as one pass of column expressions over the page table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.functions.html import (
    link_markup,
    markup_text,
    select_markup,
    visible_markup,
)
from truthmill.sources.writers import write_counted


@dataclass(frozen=True)
class SiteProfile:
    """Where one site keeps its fields. ``host`` and ``article`` are regular expressions.

    A page of a site with ``needs_date`` or ``needs_views`` is rejected if that does not parse.
    """

    host: str
    title: str
    content: str
    category: str = ""
    category_links: bool = False
    category_holding: str = ""
    dates: tuple[str, ...] = ()
    views: str = ""
    comments: str = ""
    dated_views: str = ""
    article: str = ""
    needs_date: bool = False
    needs_views: bool = False


# --- fixed values: selectors and phrases of the supported sites ----------------------
LIFESTYLE_SITE = SiteProfile(
    host=r".*",
    title="#box_10020912d10496 > .article_title",
    content="#box_10020915d10503 > .article_body",
    category="#box_10020908d10494",
    dates=("#box_10020914d10495 > .article_date",),
    views="#box_10020907d10500 > .article_views > span",
    needs_date=True,
    needs_views=True,
)
SATIRE_SITE = SiteProfile(
    host=r".*",
    title=".newsBoxN > h1",
    content=".newsTextt",
    category=".caTTL > h2",
    dated_views=".newsBoxN > .date",
    needs_date=True,
    needs_views=True,
)
BLOG_SITE = SiteProfile(
    host=r"^neverojatno\.wordpress\.com$",
    title=".post-title > h1",
    content=".post-entry",
    category=".post-info.clear-fix > p",
    category_links=True,
    category_holding="category tag",
    dates=(".post-title .post-date > strong", ".post-title .post-date > span"),
    comments="h3#comments-title > span",
    article=r"^https://neverojatno\.wordpress\.com/\d+/\d+/\d+/[A-Za-zА-Яа-я0-9.-]+/$",
)
VIEW_PHRASES = ("прегледана ", " пъти")
# Date layouts: day.month.year hour:minute, and day, short month name, year.
DATE_LAYOUTS = (
    (r"^\s*(\d{1,2}\.\d{1,2}\.\d{4}\s+\d{1,2}:\d{1,2})", "d.M.yyyy H:m"),
    (r"^\s*(\d{1,2} \p{L}{3,} \d{4})", "d MMM yyyy"),
)
# -------------------------------------------------------------------------------------
GENERIC_SITE = SiteProfile(
    host=r".*", title="title", content="article", category="nav", category_links=True
)
# The two profiles without a host of their own are chosen by the caller.
SITES = (BLOG_SITE, GENERIC_SITE)


def decoded_html(html: Column) -> Column:
    """Bytes of the page store as UTF-8 text."""
    return F.decode(html, "UTF-8")


def url_part(url: Column, part: str) -> Column:
    """Part of an address, null for an address that does not parse."""
    return F.try_parse_url(url, F.lit(part))


def parse_date(text: Column) -> Column:
    """First layout that fits the start of the text; null when none does."""
    tries = [
        F.try_to_timestamp(
            F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " "), F.lit(layout)
        )
        for pattern, layout in DATE_LAYOUTS
    ]
    return F.coalesce(*tries)


def count_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(0).cast("long"))


def dated_view_parts(text: Column) -> tuple[Column, Column]:
    """(date, text of the views) of a field such as ``01.02.2016 10:30 <phrase> 17 <phrase>``."""
    for phrase in VIEW_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    parts = F.split(text, r"\s+")
    date = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    return parse_date(date), F.get(parts, F.lit(2))


def is_article(url: Column, pattern: str) -> Column:
    return url.rlike(pattern) if pattern else F.lit(True)


def article_content(url: Column, content: Column, pattern: str) -> Column:
    """The content of an article page with text, '' for any other page."""
    return F.when(is_article(url, pattern) & (content != ""), content).otherwise("")


def _by_site(sites: tuple[SiteProfile, ...], value: Callable[[SiteProfile], Column]) -> Column:
    """Value of the first site whose host fits, null when none does."""
    out = None
    for p in sites:
        fits = F.col("_host").rlike(p.host)
        out = F.when(fits, value(p)) if out is None else out.when(fits, value(p))
    return out


#: Columns of a record, and the page fields that each is made from.
FIELDS = {
    "key": (), "url": (), "html": (), "title": ("title",), "content": ("content",), "category": (),
    "publish_date": ("date_1", "date_2", "dated_views"), "view_count": ("views", "dated_views"), "comment_count": ("comments",),
    "reject_reason": ("content", "date_1", "date_2", "dated_views", "views", "comments"),
}


def extract_records(pages: DataFrame, sites: tuple[SiteProfile, ...] = SITES, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """One record per page by the first site whose host fits, with a ``reject_reason``.

    A page that fails is kept and marked, and the rest go on: ``bad_url`` when the
    address does not parse or no site fits, ``bad_date`` and ``bad_count`` when a date or counter the
    site must have does not parse, ``no_content`` when no text was found. ``fields`` names the columns wanted: the expressions
    of the others are not even built, which for a handful of sites takes longer than small tables take to read.
    """
    wanted = {part for name in fields for part in FIELDS[name]}
    rows = pages.withColumn("_host", url_part(F.col("url"), "HOST"))
    if wanted or "category" in fields:
        rows = rows.withColumn("_markup", visible_markup(F.col("html")))

    def markup(selector: Callable[[SiteProfile], str]) -> Column:
        return _by_site(sites, lambda p: select_markup(F.col("_markup"), selector(p)) if selector(p) else F.lit(""))

    def date_part(i: int) -> Callable[[SiteProfile], str]:
        return lambda p: p.dates[i] if i < len(p.dates) else ""

    selectors: dict[str, Callable[[SiteProfile], str]] = {
        "title": lambda p: p.title, "content": lambda p: p.content, "date_1": date_part(0), "date_2": date_part(1),
        "views": lambda p: p.views, "comments": lambda p: p.comments, "dated_views": lambda p: p.dated_views,
    }

    def text(name: str) -> Column:
        # A field that no site has is the same for all: nothing to look for.
        found = any(selectors[name](p) for p in sites)
        return markup_text(markup(selectors[name])) if found else _by_site(sites, lambda p: F.lit(""))

    def category(p: SiteProfile) -> Column:
        if not p.category:
            return F.lit("")
        inner = select_markup(F.col("_markup"), p.category)
        if not p.category_links:
            return markup_text(inner)
        links = F.filter(link_markup(inner), lambda a: a.contains(p.category_holding))
        return F.array_join(F.transform(links, markup_text), ",")

    rows = rows.withColumns({f"_{name}": text(name) for name in selectors if name in wanted})

    def content() -> Column:
        return F.when(_by_site(sites, lambda p: is_article(F.col("url"), p.article)), F.col("_content")).otherwise("")

    def date() -> Column:
        return F.coalesce(parse_date(F.concat_ws(" ", "_date_1", "_date_2")), dated_view_parts(F.col("_dated_views"))[0])

    def views() -> Column:
        dated_views = dated_view_parts(F.col("_dated_views"))[1]
        return F.trim(F.when(F.col("_views") != "", F.col("_views")).otherwise(dated_views)).try_cast("long")

    def comments() -> Column:
        return F.trim("_comments").try_cast("long")

    def reason() -> Column:
        article = _by_site(sites, lambda p: is_article(F.col("url"), p.article))
        bad_count = _by_site(sites, lambda p: F.lit(p.needs_views)) & views().isNull() | (F.col("_comments") != "") & comments().isNull()
        return (
            F.when(article.isNull(), "bad_url")
            .when((content() == "") & _by_site(sites, lambda p: F.lit(bool(p.article))), "no_content")
            .when(_by_site(sites, lambda p: F.lit(p.needs_date)) & date().isNull(), "bad_date")
            .when(bad_count, "bad_count")
            .when(content() == "", "no_content")
        )

    zero = F.lit(0).cast("long")
    columns: dict[str, Callable[[], Column]] = {
        "key": lambda: F.col("page_id"), "url": lambda: F.col("url"), "html": lambda: F.col("html"), "title": lambda: F.col("_title"),
        "content": content, "category": lambda: _by_site(sites, category), "publish_date": date,
        "view_count": lambda: F.coalesce(views(), zero), "comment_count": lambda: F.coalesce(comments(), zero), "reject_reason": reason,
    }
    return rows.select(*[columns[name]().alias(name) for name in fields])


def _record_fields() -> Column:
    return F.to_json(
        F.struct(
            F.col("key").cast("string").alias("key"),
            "url",
            "html",
            "title",
            "content",
            "category",
            F.date_format("publish_date", "yyyy-MM-dd HH:mm:ss").alias("publishDate"),
            F.col("view_count").alias("viewCount"),
            F.col("comment_count").alias("commentCount"),
        )
    )


def record_json(records: DataFrame) -> DataFrame:
    """Record per JSON line; null fields are left out."""
    return records.select("key", _record_fields().alias("json"))


#: Why a page is rejected; ``ok`` if it is not.
OUTCOMES = ("ok", "bad_url", "no_content", "bad_date", "bad_count")


def outcome() -> Column:
    return F.coalesce("reject_reason", F.lit("ok"))


def write_records(records: DataFrame, path: str) -> dict[str, int]:
    """Write the records as JSON lines, a folder for each outcome, and return the pages of each: counted in the same pass."""
    rows = records.select("key", outcome().alias("outcome"), _record_fields().alias("value"))
    counts = {name: F.col("outcome") == name for name in OUTCOMES}
    return write_counted(rows.select("value", "outcome"), path, "text", ["outcome"], **counts)


def reject_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(outcome().alias("outcome")).agg(
        F.count("*").alias("pages")
    )
