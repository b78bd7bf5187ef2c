from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.html_text import extract, text_of


def show(x):
    return text_of(x.encode())


def test_blocks_lists_tables():
    assert show("<p>a<p>b  c<br>d") == "a\n\nb c\nd"
    assert show("<ul><li>one<li>two<ol><li>x<li>y</ol></ul>") == "- one\n- two\n  1. x\n  2. y"
    assert show("<table><tr><th>k<th>value<tr><td>long key<td>1</table>") == "k        | value\nlong key | 1"
    assert show("<pre>a\n  b</pre>") == "a\n  b"
    assert show("x<div>y</div>z") == "x\ny\nz"


def test_visibility():
    page = "<head><title>t</title></head><body>a<script>var x='</p>';</script><!-- no --><style>p{}</style><span style='display: none'>h</span><i hidden>h</i><b>c</b>&amp;&eacute;</body>"
    assert show(page) == "ac&é"


def test_broken():
    assert show("") == "" and text_of(None) == ""
    assert show("a <b>c") == "a c"
    assert show("a < b") == "a < b"
    assert show("<!-- never closed") == ""
    assert show("<div" * 3 + "x") is not None
    assert "deep" in show("<div>" * 5000 + "deep")
    assert len(show("word " * 200_000)) == 999_999


@given(st.text(alphabet="<>/abptdlirhu!-\"'= &;", max_size=80))
@settings(max_examples=300, deadline=None)
def test_never_fails(page):
    show(page)


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_all_visible_words_of_the_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        if "display" in r.html or "hidden" in r.html or "noscript" in r.html:
            continue
        p = Words()
        p.feed(r.html)
        lost = set("".join(p.words)) - set("".join(got[r.page_id]))
        assert not lost and len("".join(got[r.page_id].split())) >= len("".join(p.words)), r.page_id


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "<p>a", "y")], "page_id long, html string, title string")
    assert sorted((r.page_id, r.text) for r in extract(pages).collect()) == [(1, ""), (1, ""), (2, "a")]
    assert extract(pages.limit(0)).count() == 0


def test_head_without_end_tags():
    assert show("<html><head><title>T</title><h1>Hi</h1><p>text") == "Hi\n\ntext"
    assert show("<head><meta charset=x><title>T</title> plain") == "plain"
    assert show("<head><noscript><link rel=x></noscript><style>p{}</style><script>1</script></head>a") == "a"
    assert show("<head><title>T</title>&amp; a<") == "& a<"
    assert show("<head><svg><text>s</text></svg>b") == "s b"


def test_svg_math_xmp():
    assert show("a<svg width=5 />b<math/>c") == "abc"
    assert show("<p>a<svg/><p>b") == "a\n\nb"
    assert show("a<svg width=5/>b</svg>c") == "abc"
    assert show("<svg><title/><style/><path d='x'/><text>one</text><text>two</text><desc>no</desc></svg>z") == "one two z"
    assert show("<svg><title>no</title><text><![CDATA[<in>]]></text></svg>") == "<in>"
    assert show("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "x=1"
    assert show("a<xmp><b> &amp;\n  c</xmp>d") == "a\n\n<b> &amp;\n  c\n\nd"


class Spaced(Words):
    """Words as they stand in the page: inline tags do not part them."""

    INLINE = frozenset("a abbr b bdi bdo cite code dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag not in self.INLINE:
            self.words.append(" ")

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if tag not in self.INLINE:
            self.words.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_words_of_the_test_pages(spark, sf):
    from collections import Counter

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    checked = 0
    for r in pages.collect():
        if "display" in r.html or "hidden" in r.html or "noscript" in r.html:
            continue
        p = Spaced()
        p.feed(r.html)
        p.close()
        assert not Counter("".join(p.words).split()) - Counter(got[r.page_id].split()), r.page_id
        checked += 1
    assert checked
