"""The scanner of markup against the standard library's parser, on odd pages."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagelume.functions import html as H
from pagelume.functions import markup


class Reader(HTMLParser):
    """Visible text of the body, title, and anchors of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.title, self.links, self.inside, self.open_link, self.in_body = [], None, [], None, None, False

    def write(self, data):
        self.texts.append(data)
        if self.open_link:
            self.open_link[1].append(data)

    def handle_comment(self, data):
        self.write(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag, attrs):
        self.write(" ")
        if tag in ("script", "style", "title"):
            self.inside = tag
            if tag == "title" and self.title is None:
                self.title = ""
        if tag == "body":
            self.texts, self.in_body = [], True
        if tag == "a":
            self.open_link = None
            if dict(attrs).get("href") is not None:
                self.open_link = [dict(reversed(attrs))["href"], []]
                self.links.append(self.open_link)

    def handle_endtag(self, tag):
        self.write(" ")
        if tag == self.inside:
            self.inside = None
        if tag == "a":
            self.open_link = None

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        if self.inside not in ("script", "style"):
            self.write(data)


def plain(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    squeeze = lambda parts: " ".join("".join(parts).split())
    return squeeze(reader.texts), squeeze([reader.title or ""]) or None, [(h, squeeze(t)) for h, t in reader.links]


PAGES = [
    "", "plain text", "a < b and c > d", "1<2", "x <3 y", "<p>one<p>two<br>three", "<P CLASS=x>Up</P>", "<b>un<i>closed",
    '<p title="a > b">quoted</p>', "<p title='<b>no tag</b>'>single</p>", "<p title=it's>apostrophe</p>", '<p data-x="<!-- no comment -->">kept</p>',
    "a<!-- c -->b", "a<!-- <p>no</p> - > still -->b", "a<!---->b", "<!-- one --><!-- two -->x", 'x<script>var t="</p><b>";</script>y', "x<SCRIPT type='a>b'>if (a<b && c>d) {}</SCRIPT >y",
    "<style>p > a{}</style>s", "<script>var c = '<!-- ';</script>z", "<script>a</script><script>b</script>mid<style></style>end",
    "<title>A &amp; B</title>x", "<title lang='x>y'>T</title>u", "<html><head><title>one</title></head><body class='a>b'>text</body></html>", "<svg><path d='M0'/></svg>after",
    "&#8381; 100 &#x20BD; &euro;", "&amp;lt; &lt;b&gt; &quot;q&quot; &laquo;x&raquo;", "&copy; 2020 &mdash; &hellip;", "AT&amp;T & Co", "&#x1F600;",
    '<a href="/x">one <b>two</b></a>', "<a href='/y?a=1&amp;b=2'>q</a>", "<a class=big href=/z>u</a>", '<a title="href=/no" href="/yes">t</a>', '<a data-href="/no" href="/yes">t</a>', "<A HREF = '/up' >Up</A>",
    "<a href=/1>x<a href=/2>y</a>z", "<a name=top>no link</a><a href=''>empty</a>", '<a href="/c"><!-- <a href="/d">no</a> -->c</a>', "<abbr href=/n>no anchor</abbr>", '<a\nhref="/nl"\n>new\nline</a>',
    '<a href="/gt" title="1 > 0">gt</a> tail', "<!DOCTYPE html><p>doc</p>", "<?xml version='1.0'?>pi", "</p>stray</div>", "<p>" * 3000 + "deep" + "</p>" * 3000, "<p x='1' y=\"2\" z>" * 500 + "many",
]


def test_scanner_is_a_parser(spark):
    assert len(PAGES) > 40
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, p string")
    p = F.col("p")
    for r in df.select("i", H.html_text(p).alias("text"), H.html_title(p).alias("title"), H.anchor_array(p).alias("a")).collect():
        text, title, links = plain(PAGES[r.i])
        assert (r.text, r.title, [(x.href, x.text) for x in r.a]) == (text, title, links), PAGES[r.i][:200]


ENDS = [("a<!-- open", "a"), ("x<script>open", "x"), ('<p title="open>text</p>', "text"), ("&#0; &#xD800; &#9999999; &nosuch; &amp", "� � � &nosuch; &amp"), ("</ x>a</3>b<!>c", "a b c"), (None, None)]


def test_ends_that_are_missing(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(ENDS)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(H.html_text(F.col("p"))).collect()] == [t for _, t in ENDS]
    title = spark.createDataFrame([("<title>T <b>no tag</b></title>",)], "p string").select(H.html_title(F.col("p"))).first()[0]
    assert title == "T <b>no tag</b>"  # the text of a title has no elements


def test_attributes(spark):
    df = spark.createDataFrame([('<a b=1 href="x"',), ("<a href='y' href=z",), ("<a hrefx=1",), ("<a href=",), ("<a c='href=1'/href=2",)], "t string")
    assert [r[0] for r in df.select(markup.attribute(F.col("t"), "href")).collect()] == ["x", "y", None, "", "2"]


def test_time_grows_with_the_page_not_with_its_square(spark):
    """4,000 entities and 1,000 links on one page: the page was scanned again for each of them (minutes)."""
    import time

    items = "".join(f'<p>a&amp;b &#8381; &nosuch; c&lt;</p><a href="/x?i={i}&amp;j=1">l &hellip;</a>' for i in range(1000))
    page = spark.createDataFrame([(f"<html><body>{items}</body></html>",)], "html string")
    began = time.time()
    text, links = page.select(H.html_text(F.col("html")), H.anchor_array(F.col("html"))).first()
    took = time.time() - began
    assert text == " ".join(["a&b ₽ &nosuch; c< l …"] * 1000)
    assert [tuple(x) for x in links] == [(f"/x?i={i}&j=1", "l …") for i in range(1000)]
    assert took < 20
