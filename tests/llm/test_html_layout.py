import random
import re

from sensorspark.llm import html_layout as h
from tests_llm_data import read


def test_blocks_lists_and_implied_tags():
    page = "<title>t</title><style>p{}</style><h1>Hi  there</h1><p>One<p>Two <b>bold</b><br>next<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol><li>e</ul>after"
    assert h.render(page) == "Hi there\n\nOne\n\nTwo bold\nnext\n\n- a\n- b\n  3. c\n  9. d\n- e\n\nafter"


def test_tables_are_aligned():
    page = "<table><caption>Cap<tr><th>Name<th>Val<tr><td>x<td>10<tr><td colspan=2>a wide cell<tr><td rowspan=2>r<td>1<tr><td>2</table>end"
    assert h.render(page) == "Cap\nName  Val\nx     10\na wide cell\nr     1\n      2\n\nend"
    assert h.render("<table><tr><td><table><tr><td>in</table><td>out</table>") == "in  out"


def test_visibility():
    for hidden in ("<p hidden>x</p>", "<div style='color:red; DISPLAY : none'>x</div>", '<p style="visibility:hidden">x', "<script>x</script>", "<noscript>x</noscript>", "<template>x</template>", "<input type=hidden value=x>", "<!-- x -->", "<head>\n<title>x</title></head>", "<!-- x", "<script>x"):
        assert h.render("a" + hidden) == "a", hidden
    assert h.render("<p data-hidden=1 title='display:none'>x") == "x"
    assert h.render("<p class=hidden>x</p>") == "x"


def test_words_inside_attribute_values_hide_nothing():
    for shown in ("<p class='w-full hidden md:block'>x</p>", '<p title="The hidden truth">x</p>', '<b title="a type=hidden b">x</b>', "<b title='a style=display:none b'>x</b>", "<button type=hidden>x</button>", "<p data-a=' hidden'hiddenx>x</p>", "<p style='background:url(\"a;display:none\")'>x</p>", "<p style='/*display:none*/ --a-display:none'>x</p>", "<p style='display:none;display:block'>x</p>", "<p title = ' hidden '>x</p>"):
        assert h.render(shown) == "x", shown
    assert h.render('<figure><img alt="hidden away"><figcaption>x</figcaption></figure>') == "x"
    for away in ("<p class='a'hidden>x</p>", "<p HIDDEN=''>x</p>", "<p title='>' hidden/>x</p>", "<p style='color:red;display:none!important;display:block'>x</p>", "<p style = 'display&#58;none'>x</p>", "<p style=visibility:hidden>x</p>"):
        assert h.render("a" + away) == "a", away
    assert h.render("<ol title=' start=7' start='3'><li>x</ol>") == "3. x"


def test_quoted_values_are_read_whole():
    for n in (10, 4095, 4096, 4097, 5000, 100_000):
        for quote, other in ("\"'", "'\""):
            value = f"<b hidden>{other}json{other}>" * (n // 10) + ">"
            assert h.render(f"a<i data-x={quote}{value}{quote} title=t>b</i><p data-y={quote}{value}{quote} hidden>c</p>d") == "abd", n
    assert h.render("<i a=\"x>one</i> <i b='1>2'>two</i> <i c='x>three</i> <p hidden>four") == "one two three"
    assert h.render("<i a=x\"y>one</i> <i b='z'\">two</i>") == "one two"
    for unit in ('<a b=">" ', "<a b='>", '<a b="> ', "<a b='>' c=\">\" ", "<a b='>\"", "<a b =   "):
        h.render(unit * 60_000)
        h.render(unit * 60_001 + ">")


def test_drawings_and_formulas():
    assert h.render("a<svg viewBox='0 0 9 9'><path d='M0'/><text x=1>one</text><g><text>t<tspan>wo</tspan></text></g></svg>b") == "a one two b"
    assert h.render("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == "so x=1 holds"
    for part in ("title", "desc", "defs", "metadata", "symbol", "clipPath"):
        assert h.render(f"a<svg><{part}><text>x</text></{part}><text>seen</text></svg>") == "a seen", part
        assert h.render(f"a<svg><{part}/><text>seen</text></svg>") == "a seen", part
    for part in ("annotation encoding='x/tex'", "annotation-xml"):
        away = f"<{part}>x</{part.split()[0]}>"
        assert h.render(f"<math><semantics><mrow><mi>y</mi></mrow>{away}</semantics></math>z") == "yz", part
    assert h.render("<svg><style/><script/><text>seen</text><style>x</style><script>x</script></svg>a") == "seen a"
    assert h.render("<svg><text><![CDATA[1 < 2 > 0]]></text></svg>a") == "1 < 2 > 0 a"
    assert h.render("<svg><foreignObject><p>in</p></foreignObject></svg>a") == "in\n\na"
    assert h.render("<svg><defs><p>para</p>") == "para"
    assert h.render("<desc>kept</desc> <metadata>too</metadata>") == "kept too"
    assert h.render("a<svg hidden><text>x</text></svg><svg style='display:none'><text>x</text></svg>") == "a"
    assert h.render("<table><tr><td>a<td><svg><text>t</text></svg><tr><td>b<td><math><mn>2</mn></math></table>") == "a  t\nb  2"
    h.render("<svg><g>" * 50_000 + "<p>x")
    h.render("<svg><![CDATA[" * 50_000 + "<p>x")


def test_text_is_kept():
    assert h.render("a &lt;b&gt; &nbsp; &copy; 1 < 2 & 3 > 2") == "a <b>   © 1 < 2 & 3 > 2"
    assert h.render("<pre>  a\n   b\n</pre>c") == "  a\n   b\n\nc"
    assert h.render("<textarea>&lt;i&gt;<b></textarea>") == "<i><b>"
    assert h.render("</p></td>x<br><br>y") == "x\n\ny"
    assert h.render(None) == h.render("") == h.render("<html>") == ""


def test_every_visible_word_comes_once():
    draw = random.Random(1)
    tags = "div p ul li table tr td th b span h2 ol dl dt dd pre section blockquote tbody caption select option".split()
    for _ in range(400):
        parts, n = [], 0
        for _ in range(draw.randint(1, 40)):
            kind = draw.random()
            if kind < 0.45:
                parts.append(f"<{draw.choice(tags)}>")
            elif kind < 0.7:
                parts.append(f"</{draw.choice(tags)}>")
            else:
                parts.append(f" w{n} ")
                n += 1
        words = re.findall(r"w[0-9]+", h.render("".join(parts)))
        assert sorted(words) == sorted(f"w{i}" for i in range(n)), "".join(parts)


def test_hostile_pages_end():
    for page in ("<a" * 50_000, "<b>" * 30_000 + "</i>" * 30_000, '<a "' * 30_000, "<!--" * 50_000, "<table><tr><td>" * 2000 + "x", "<ul><li>" * 5000):
        h.render(page)


def test_on_tables(spark):
    pages = read(spark, "pages")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<script.*?</script>", " ", r.html)
        plain = h.unescape(re.sub(r"<[^>]*>", " ", body))
        shown = re.sub(r"(?m)^ *- ", "", got[r.page_id])
        assert "".join(shown.split()) == "".join(plain.split()), r.page_id
    odd = spark.createDataFrame([(1, None), (None, "<p>x"), (1, None), (2, "")], "page_id bigint, html string")
    assert sorted(r.text for r in h.extract(odd).collect()) == ["", "", "", "x"]
    assert h.extract(odd.limit(0)).count() == 0


def test_visibility_is_inherited_and_switched_on_again():
    hide, show = "style='visibility:hidden'", "style='visibility:visible'"
    assert h.render(f"<div {hide}>a<p {show}>SHOWN</p>b</div>") == "SHOWN"
    assert h.render(f"<div {hide}><p>a<b {show}>x</b>c</p><div style='visibility:inherit'>d</div></div>e") == "x\n\ne"
    assert h.render(f"<ul><li {hide}>a<i {show}>x</i><li>b</ul>") == "  x\n- b"
    assert h.render(f"<table {hide}><tr><td>a<td {show}>x<tr {show}><td>y<td {hide}>z</table>") == "   x\ny"
    assert h.render(f"<table><tr {hide}><td>a<td><b {show}>x</b></table>") == "  x"
    assert h.render(f"<pre {hide}>a\n<b {show}>x</b></pre>") == "x"
    assert h.render(f"<div style='display:none'><p {show}>x</p></div>a") == "a"
    assert h.render("<svg visibility=hidden><text>x</text><text visibility=visible>y</text></svg>") == "y"


def test_closed_widgets_and_fallbacks_are_left_out():
    assert h.render("a<dialog>x</dialog>") == "a" and h.render("a<dialog open>x</dialog>") == "a\nx"
    assert h.render("<details>x<summary>s</summary>y<summary>z</summary></details>") == "s"
    assert h.render("<details open><summary>s</summary>y</details>") == "s\ny"
    for tag in ("video", "audio", "canvas", "meter", "progress"):
        assert h.render(f"a<{tag}>x<p>y</p></{tag}>b") == "ab", tag
    assert h.render("<p hidden style='display:block'>x") == "x"


def test_rows_reach_to_the_end_of_their_group():
    page = "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>"
    assert h.render(page) == "a  b\n   c\n   d\ne  f"
    assert h.render("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>") == "a  b\nc  d"


def test_wide_cells_are_wrapped_and_no_text_is_lost():
    words = [f"w{i}" for i in range(40)]
    got = h.render(f"<table><tr><td>{' '.join(words)}<td>x<tr><td>y<td>z</table>").split("\n")
    assert got[-1].split() == ["y", "z"] and len(got[-1]) <= h.CELL_WIDTH + 3 and "x" in got[0]
    assert " ".join(" ".join(got[:-1]).replace("  x", "").split()) == " ".join(words)
    long = "v" * 20_000
    page = f"<table><tr><td>{long}<td>q" + "<tr><td>1<td>2" * 2000 + "</table>"
    assert len(h.render(page)) < 4 * len(page) and long in h.render(page)
    draw = random.Random(2)
    for _ in range(50):
        line = " ".join("u" * draw.randint(1, 90) for _ in range(draw.randint(0, 30)))
        pieces = h.wrapped(line)
        assert " ".join(pieces) == line and all(len(p) <= h.CELL_WIDTH or " " not in p for p in pieces)


def test_padding_is_bounded():
    wide = "<table><tr>" + f"<td>{'x' * 60}" * 1000 + "<tr><td colspan=999><td>y" * 2000 + "</table>"
    deep = "<ul><li>x" * 5000
    for page in (wide, deep, "<table><tr><td>a<td>" * 2000 + "x"):
        assert len(h.render(page)) < 20 * len(page)
