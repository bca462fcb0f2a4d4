from datetime import datetime

import pytest
from pyspark.sql import functions as F

from truthmill.functions.html import markup_text, select_text, visible_markup
from truthmill.operators import pages


def one(spark, html, expression):
    return spark.createDataFrame([(html,)], "h string").select(expression(visible_markup(F.col("h"))).alias("r")).first().r


def test_text_of_markup(spark):
    html = "<p>На <b>д</b>вор&amp;eacute; &lt;x&gt;&nbsp;&#1073;&#x43A;<br>ред<div>\n два</div><!-- c --><script>var a='<p>';</script></p>"
    assert one(spark, html, markup_text) == "На двор&eacute; <x>\u00a0бк ред два"


def test_nested_elements_of_one_name(spark):
    html = '<div id="a"><div class="x body y">one <div>two</div> three</div> four</div><div>five</div>'
    assert one(spark, html, lambda h: select_text(h, "#a > .body")) == "one two three"
    assert one(spark, html, lambda h: select_text(h, "div#a")) == "one two three four"
    assert one(spark, html, lambda h: select_text(h, ".bod")) == ""
    assert one(spark, html, lambda h: select_text(h, "span")) == ""


def test_every_match_is_taken(spark):
    html = '<p class="a">one <b>1</b></p><p class="b">two</p><p class="a">three</p>'
    assert one(spark, html, lambda h: select_text(h, ".a")) == "one 1 three"
    assert one(spark, html, lambda h: select_text(h, ".a > b")) == "1"
    nested = '<div class="a">x <div class="a">y</div> z</div><div class="a">w</div>'
    assert one(spark, nested, lambda h: select_text(h, ".a")) == "x y z y w"


def test_children_and_descendants_differ(spark):
    html = '<div class="n"><div class="side"><h1>Other</h1></div><br><img src="x"/><h1>Main</h1></div><h1>Out</h1>'
    assert one(spark, html, lambda h: select_text(h, ".n > h1")) == "Main"
    assert one(spark, html, lambda h: select_text(h, ".n h1")) == "Other Main"
    nested = '<div class="a"><p>1</p><div class="a"><p>2</p></div></div><p>3</p>'
    assert one(spark, nested, lambda h: select_text(h, ".a > p")) == "1 2"
    assert one(spark, nested, lambda h: select_text(h, ".a p")) == "1 2"


def test_bad_date_and_counter_are_rejected(spark):
    page = (
        '<div id="box_10020914d10495"><span class="article_date">{}</span></div>'
        '<div id="box_10020907d10500"><p class="article_views"><span>{}</span></p></div>'
        '<div id="box_10020915d10503"><div class="article_body">Text</div></div>'
    )
    rows = [(1, "http://x.bg/a", page.format("bad", "7")), (2, "http://x.bg/a", page.format("05.03.2016 14:07", "")),
            (3, "http://x.bg/a", page.format("05.03.2016 14:07", "7"))]
    out = records(spark, rows, (pages.LIFESTYLE_SITE,))
    assert [out[i].reject_reason for i in (1, 2, 3)] == ["bad_date", "bad_count", None]


def test_unused_fields_are_not_looked_for(spark):
    df = spark.createDataFrame([(1, "http://x.bg/a", "<title>a</title>")], "page_id long, url string, html string")
    plan = pages.extract_records(df, pages.SITES).select("key", "category")._jdf.queryExecution().optimizedPlan().toString()
    assert "<(nav)" in plan and "<(title)" not in plan and "<(article)" not in plan


def test_unclosed_element_runs_to_the_end(spark):
    assert one(spark, "<article>a <p>b", lambda h: select_text(h, "article")) == "a b"


def test_a_selector_that_is_not_simple_is_refused():
    with pytest.raises(ValueError):
        select_text(F.lit(""), "a[href]")


def records(spark, rows, sites):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.key: r for r in pages.extract_records(df, sites).collect()}


def test_lifestyle_site(spark):
    html = (
        '<div id="box_10020914d10495"><span class="article_date">05.03.2016 14:07</span></div>'
        '<div id="box_10020907d10500"><p class="article_views">Видяна <span> 123 </span></p></div>'
        '<div id="box_10020912d10496"><h1 class="article_title">Заглавие</h1></div>'
        '<div id="box_10020915d10503"><div class="article_body">Текст <div>още</div></div></div>'
        '<div id="box_10020908d10494">Стил</div>'
    )
    row = records(spark, [(1, "http://x.bg/a", html)], (pages.LIFESTYLE_SITE,))[1]
    assert (row.title, row.content, row.category) == ("Заглавие", "Текст още", "Стил")
    assert row.publish_date == datetime(2016, 3, 5, 14, 7)
    assert (row.view_count, row.comment_count, row.reject_reason) == (123, 0, None)


def test_satire_site_splits_the_combined_field(spark):
    html = (
        '<div class="newsBoxN"><h1>Новина</h1><p class="date">1.2.2016 9:05 прегледана 77 пъти</p></div>'
        '<div class="newsTextt">Тяло</div><div class="caTTL"><h2>Спорт</h2></div>'
    )
    row = records(spark, [(1, "http://x.bg/a", html)], (pages.SATIRE_SITE,))[1]
    assert (row.title, row.content, row.category, row.view_count) == ("Новина", "Тяло", "Спорт", 77)
    assert row.publish_date == datetime(2016, 2, 1, 9, 5)


BLOG = (
    '<div class="post-title"><h1>Т</h1><div class="post-date"><strong>07</strong><span>Mar 2015</span></div></div>'
    '<div class="post-entry">Съдържание</div><div class="post-info clear-fix"><p><a rel="category tag">А</a> '
    '<a rel="author">Б</a><a rel="category tag">В</a></p></div>{comments}'
)


def test_blog_site(spark):
    good = "https://neverojatno.wordpress.com/2015/03/07/заглавие-1/"
    rows = [
        (1, good, BLOG.format(comments='<h3 id="comments-title"><span>4</span></h3>')),
        (2, "https://neverojatno.wordpress.com/about/", BLOG.format(comments="")),
        (3, good, "<p>no entry</p>"),
        (4, "not an address", BLOG.format(comments="")),
    ]
    out = records(spark, rows, (pages.BLOG_SITE,))
    assert (out[1].content, out[1].category, out[1].comment_count) == ("Съдържание", "А,В", 4)
    assert out[1].publish_date == datetime(2015, 3, 7)
    assert (out[2].content, out[2].comment_count, out[2].reject_reason) == ("", 0, "no_content")
    assert out[3].reject_reason == "no_content" and out[3].publish_date is None
    assert out[4].reject_reason == "bad_url"


@pytest.mark.parametrize(
    "text, parsed",
    [("05.03.2016 14:07", datetime(2016, 3, 5, 14, 7)), ("5 Mar 2016", datetime(2016, 3, 5)),
     ("05.03.2016 14:07 ч.", datetime(2016, 3, 5, 14, 7)), ("yesterday", None), ("32.01.2016 10:00", None), ("", None)],
)
def test_dates(spark, text, parsed):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(pages.parse_date(F.col("t"))).first()[0] == parsed


def test_json_leaves_out_missing_fields(spark):
    df = spark.createDataFrame([(1, "http://a.bg/x", "<title>t</title><article>b</article>")], "page_id long, url string, html string")
    line = pages.record_json(pages.extract_records(df)).first().json
    assert '"title":"t"' in line and "publishDate" not in line


def test_bytes_decode(spark):
    df = spark.createDataFrame([(bytearray("здравей".encode()),)], "b binary")
    assert df.select(pages.decoded_html(F.col("b"))).first()[0] == "здравей"
