import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import css, mathml
from quirework.functions import text as T
from quirework.functions.decoding import decode_bytes, deobfuscated, image_size, lz77_decompress
from quirework.functions.render import Markdown
from quirework.sources.html import parse_html


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("base", "relative", "want"),
    [
        ("a/b/c.html", "../d.html", "a/d.html"), ("a/c.html", "#f", "a/c.html#f"), ("a/c.html", "http://x/y", "http://x/y"), ("a/c.html", "/d", "/d"),
        ("a/c.html", "../../../d", "d"), ("a/c.html", "./b//c\\d#e", "a/b/c/d#e"), ("c.html", "d", "d"), ("a/c.html", "mailto:x@y", "mailto:x@y"),
    ],
)
def test_resolve_path(spark, base, relative, want):
    assert one(spark, T.resolve_path(F.col("b"), F.col("r")), b=base, r=relative) == want


def test_resolve_path_with_root(spark):
    assert one(spark, T.resolve_path(F.col("b"), F.col("r"), root=True), b="a/c.html", r="/d/../e#f") == "e#f"


@pytest.mark.parametrize(("s", "want"), [("a (b)", "<a (b)>"), ("a(b)", "a(b)"), ("a)b(", "<a)b(>"), ("x", "x")])
def test_link_destination(spark, s, want):
    assert one(spark, T.link_destination(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "want"), [("- x", "\\- x"), ("1. x", "1\\. x"), ("# h", "\\# h"), ("a|b", "a\\|b"), ("*x*", "\\*x\\*"), ("---", "\\---"), ("![a", "\\!\\[a"), ("a - b", "a - b")])
def test_markdown_escape(spark, s, want):
    assert one(spark, T.markdown_escape(F.col("s")), s=s) == want


def test_other_scalars(spark):
    assert one(spark, T.slugify(F.col("s")), s="  Ünder_ the -- Hill! ") == "nder-the-hill"
    assert one(spark, T.fence_length(F.col("s")), s="a ```` b") == 5
    assert one(spark, T.inline_ticks(F.col("s")), s="a `b`") == 2
    assert one(spark, T.summary(F.col("s")), s="x" * 301) == "x" * 300 + "..."
    assert one(spark, T.media_type(F.col("p"), F.col("c")), p="a.bin", c=bytearray(b"\xff\xd8\xff\xe0")) == "image/jpeg"
    assert one(spark, T.repair_solidus(F.col("s")), s='<img src="x"/ alt="y">') == '<img src="x" alt="y"/>'
    assert one(spark, T.fuzzy_title(F.col("a"), F.col("b")), a="The Tide", b="tide the") == 1.0
    assert one(spark, T.word_retention(F.col("a"), F.col("b")), a="", b="x") == 1.0


def test_udfs(spark):
    from quirework.functions import codecs

    assert one(spark, codecs.percent_decode(F.col("s")), s="a%20b+c%zz#d%C3%A9") == "a b+c%zz#dé"
    assert one(spark, codecs.resolve_entities(F.col("s")), s="&eacute;&#65;&nosuch;&amp;") == "éA&"


@given(st.binary(max_size=400))
def test_decoders_never_fail(raw):
    assert isinstance(decode_bytes(raw, "nonsense"), str)
    image_size(raw)
    lz77_decompress(raw)


def test_decoders():
    assert decode_bytes(b"caf\xe9", None) == "café"
    assert decode_bytes("Жук".encode("cp1251"), "cp1251") == "Жук"
    assert image_size(b"GIF89a\x02\x00\x03\x00") == (2, 3)
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07") == (7, 5)
    assert lz77_decompress(b"abc\x80\x19") == b"abcabcd"[:3] + b"abca"[:4]
    assert deobfuscated(deobfuscated(b"fontdata" * 9, b"key", 20), b"key", 20) == b"fontdata" * 9


def test_css():
    assert css.length("12pt") == ("px", 16.0) and css.length("2ex") == ("em", 1.0) and css.length("0") == ("px", 0.0) and css.length("3vw") is None
    assert css.color("#abc") == "aabbccff" and css.color("rgb(100%, 0, 0)") == "ff0000ff" and css.color("nocolour") is None
    assert css.declarations("margin: 1px 2px; color: red !important; ; bad") == [("margin-top", "1px", False), ("margin-right", "2px", False), ("margin-bottom", "1px", False), ("margin-left", "2px", False), ("color", "red", True)]
    assert css.specificity("div#a.b > p:first-child") == (1, 2, 2)
    assert [s for s, _ in css.rules("/* x */ a, b { c: d } @font-face { x: y } @media screen { p { q: r } } broken")] == ["a", "b", "p"]
    assert css.font_faces("@font-face { font-family: 'A'; src: url(a.ttf) }") == [{"family": "A", "weight": "normal", "style": "normal", "src": "a.ttf"}]


def test_math():
    tree = mathml.parse("<math><mfrac><msup><mi>x</mi><mn>2</mn></msup><msqrt><mi>α</mi></msqrt></mfrac></math>")
    assert mathml.to_latex(tree) == "\\frac{x^{2}}{\\sqrt{\\alpha}}"
    assert mathml.to_text(tree) == "(x²)/(√(α))"
    assert mathml.parse(mathml.to_mathml(tree)) == tree
    assert mathml.from_latex(mathml.to_latex(tree)) == tree
    assert mathml.parse("<math><mfoo>x</mfoo></math>") == ["raw", "mfoo", "x"]


def _markdown(html):
    return Markdown(parse_html(html)).render()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>A <b>b</b></h2><p>x<br/>y</p>", "## A **b**\n\nx\\\ny\n"),
        ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n- b\n  - c\n"),
        ("<ol start='3'><li>a<li>b</ol>", "3. a\n4. b\n"),
        ("<table><tr><th>h</th><th>i</th></tr><tr><td>a|b</td></tr></table>", "| h | i |\n| --- | --- |\n| a\\|b |  |\n"),
        ("<pre><code class='language-py'>x = `1`\n</code></pre>", "```py\nx = `1`\n```\n"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b\n"),
        ("<p>1. no list</p><p># no head</p>", "1\\. no list\n\n\\# no head\n"),
        ("<p><a href='x y'>l</a> <i> e </i></p>", "[l](<x y>)  *e*\n"),
        ("<ul><li>a</li></ul><ul><li>b</li></ul>", "- a\n\n<!-- -->\n\n- b\n"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert _markdown(html) == want


@given(st.text(alphabet="<>/abp =\"'!-&;\n", max_size=200))
def test_broken_html_gives_a_tree(html):
    rows = parse_html(html)
    for r in rows:
        assert r["end"] >= r["pre"]
        if r["parent_pre"] is not None:
            p = rows[r["parent_pre"]]
            assert p["pre"] < r["pre"] <= r["end"] <= p["end"] and p["depth"] == r["depth"] - 1


def test_html_repairs_and_bounds():
    tags = lambda h: [(r["tag"], r["depth"]) for r in parse_html(h) if r["tag"] != "#text"]
    assert tags("<p>a<p>b") == [("p", 0), ("p", 0)]
    assert tags("<ul><li>a<li>b<ul><li>c</ul></ul>") == [("ul", 0), ("li", 1), ("li", 1), ("ul", 2), ("li", 3)]
    assert tags("<table><tr><td>a<td>b<tr><td>c</table>") == [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2)]
    assert tags("<script>'<p>'</script><div style='display:none'><p>x</p></div><b>y</b>") == [("b", 0)]
    assert max(r["depth"] for r in parse_html("<div>" * 600 + "x")) <= 512
    assert "".join(r["text"] for r in parse_html("<p>a &amp; b</p><!-- c -->") if r["tag"] == "#text") == "a & b"
