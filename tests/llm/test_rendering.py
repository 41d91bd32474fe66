import pytest

from tickloom.llm.rendering import build, render, visible_text


def shown(html):
    return render(build(html))


@pytest.mark.parametrize(("html", "text"), [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a <b>b</b>\n  c<br>d", "a b c\nd"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "- x\n- y\n  - z\n\nend"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ul><li><ul><li>in</ul></ul>", "-\n  - in"),
    ("<table><tr><th>Name<th>N<tr><td>a<td>10<tr><td>longer<td>2</table>", "Name    N\na       10\nlonger  2"),
    ("<table><td>x<td>y<tr><td colspan=2>wide one<tr><td>p<td>q</table>", "x  y\nwide one\np  q"),
    ("<table><caption>Cap</caption><tr><td>a<br>b<td>c</table>", "Cap\n\na  c\nb"),
    ("<table><tr><td><table><tr><td>1<td>2</table><td>out</table>", "1  2  out"),
    ("<head><title>T</title><style>p{}</style><body><script>var a='</p><b>';</script>x", "x"),
    ("<div hidden>no</div><div style='DISPLAY : none'>no<p>no</div>yes", "yes"),
    ("<details><summary>s</summary>gone</details><details open>kept</details>", "s\nkept"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"),
    ("&lt;b&gt; &amp; &eacute;&#8364; 1 < 2 <3", "<b> & é€ 1 < 2 <3"),
    ("x<!-- <p>no --><!DOCTYPE y>z", "xz"),
    ("<p>a</div></span>b</p>", "ab"),
    ("<a title='1>2' href=x>t</a>", "t"),
    ("<p title=\"open>rest <b>more</b>", "rest more"),
    ("<h1>H</h1><div>d</div><div>e</div>", "H\n\nd\ne"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("", ""), ("<", "<"), ("<p", ""), ("</", ""), ("plain", "plain")])
def test_layout(html, text):
    assert shown(html) == text


def test_keeps_all_text_whatever_the_markup():
    deep = "<div><b>" * 30_000 + "core" + "</b></div>" * 10
    assert shown(deep) == "core"
    assert shown("<a " * 50_000) == ""
    assert shown("<p>x</i>" * 20_000).count("x") == 20_000
    nested = shown("<ul><li>x" * 5_000)
    assert nested.count("x") == 5_000 and len(nested) < 5_000 * 80
    wide = "<table>" + "<tr><td>" + "y" * 5_000 + "<td>z" * 3 + "</table>"
    assert shown(wide).count("y") == 5_000 and shown(wide).count("z") == 3


def test_given_pages_lose_no_visible_word(spark):
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from pyspark.sql import functions as F
    for html, text in pages.select("html", visible_text(F.col("html"))).collect():
        import html as entities
        plain = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->|<!doctype[^>]*>", " ", html)
        assert "hidden" in html.lower() or "display" in html.lower() or \
            entities.unescape(re.sub(r"</?[a-zA-Z][^>]*>", " ", plain)).split() == [w for w in re.sub(r"(?m)^(\s*(- |\d+\. |> ))+", "", text).split() if w] or \
            "".join(entities.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", plain)).split()) == "".join(re.sub(r"(?m)^ *(- |\d+\. |> )+", "", text).split())


def test_null_and_no_rows(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t")], "page_id int, html string, text string")
    assert [r[0] for r in df.orderBy("page_id").select(visible_text(F.col("html"))).collect()] == [None, "", ""]
    assert df.where("page_id > 5").select(visible_text(F.col("html"))).collect() == []


@pytest.mark.parametrize(("html", "text"), [
    ("<head><title>T</title><p>Hello <b>you</b>", "Hello you"), ("<html><head><meta charset=x>bare text<p>p", "bare text\n\np"),
    ("<head><link rel=x><style>s{}</style><script>1</script> <div>d</div></head><p>p", "d\n\np"),
    ("<head><noscript><img src=x><p>no</noscript><title>T</title></head>b", "b"), ("<head> <base href=x>\n</head>b", "b"),
    ("<head><template><p>no</p></template><title>T</title><h1>H</h1>", "H"), ("<head><title>T</title><body>b", "b")])
def test_head_ends_where_the_body_begins(html, text):
    assert shown(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>too</b></p>no</div>end", "yestoo\n\nend"),
    ("<div style='visibility:collapse'>no<i style='color:red'>no</i></div>yes", "yes"),
    ("<div style='display:none'>no<p style='visibility:visible'>no</div>yes", "yes"),
    ("<p style='backface-visibility:hidden'>yes", "yes"), ("<p style='visibility:hidden;visibility:visible'>yes", "yes"),
    ("<ul><li>a<li style='visibility:hidden'>no<li>b</ul>", "- a\n- b"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> it is", "so x=2 it is"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>one</text><g><text>two</text></g></svg>", "one\ntwo")])
def test_visibility_is_inherited_and_drawings_have_text(html, text):
    assert shown(html) == text


def test_given_pages_against_another_parser(spark):
    """Letters and digits of each page as Python's own HTML parser hands them out, outside of head, scripts, styles and hidden elements."""
    from html.parser import HTMLParser

    from pyspark.sql import functions as F

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.cut, self.open_, self.found = 0, [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "hr", "img", "input", "link", "meta", "wbr"):
                return
            a = dict(attrs)
            self.open_.append((tag, tag in ("head", "script", "style", "noscript", "template") or "hidden" in a
                               or "display:none" in (a.get("style") or "").replace(" ", "")))

        def handle_endtag(self, tag):
            places = [i for i, (name, _) in enumerate(self.open_) if name == tag]
            if places:
                del self.open_[places[-1]:]

        def handle_data(self, data):
            if not any(cut for _, cut in self.open_):
                self.found.append(data)

    letters = lambda text: "".join(filter(str.isalpha, text))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    compared = 0
    for html, text in pages.select("html", visible_text(F.col("html"))).collect():
        if html is not None:
            plain = Plain()
            plain.feed(html)
            plain.close()
            assert letters("".join(plain.found)) == letters(text)
            compared += 1
    assert compared > 100
