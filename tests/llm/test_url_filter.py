import random

from sensorspark.llm import url_filter as u
from sensorspark.llm.plans import URL_RULES
from tests_llm_data import read

PAGES = "page_id bigint, url string, html string, verdict string, node string"


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def decide(url, rules):
    host, path = place(url)
    fits = [(len(h + p), v == "allow", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not host or not fits:
        return host, path, None, None
    _, allow, rule = max(fits)
    return host, path, rule, "allow" if allow else "block"


def rows(spark, pages, rules):
    table = spark.createDataFrame([(i, x, h, "extra", "extra") for i, (x, h) in enumerate(pages)], PAGES)
    return {r.page_id: r for r in u.judged(table, u.rule_table(spark, rules)).collect()}


def test_rules_equal_brute_force(spark):
    draw = random.Random(1)
    urls = [None, "", "x", "://", "http://", "http://A.Com", "HTTP://É.com/En", "http://a.com?x://y/z", "a://b://c.net/es/", "http://net/es/x", "http://x.net/es", "//a.com/", "http://b.net#/es/"]
    urls += [
        draw.choice(["http://", "https://", ""]) + draw.choice(["www.", "m.", "www.x.", ""]) + draw.choice(["example.com", "Example.COM", "net", "a.net", "anet", "example.org"])
        + draw.choice(["", "/", "/en/", "/en/a", "/es/", "/fr/b", "/EN/"]) + draw.choice(["", "?q=/en/", "#t", "/"])
        for _ in range(400)
    ]
    got = rows(spark, [(x, None) for x in urls], URL_RULES)
    for i, url in enumerate(urls):
        host, path, rule, verdict = decide(url, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or "allow"), url
    assert rows(spark, [("http://a.b/", None)], [("a.b", "/", "block"), ("a.b", "/", "allow")])[0].verdict == "allow"


def test_aliases_share_decisions(spark):
    canonical = '<html><head><LINK href="{}" rel="nofollow Canonical">'
    refresh = "<meta http-equiv=refresh content=\"0; URL='{}'\">"
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow"), ("bad.org", "/fine", "allow")]
    pages = [
        ("http://one.org/a", canonical.format("http://bad.org/x")),
        ("http://two.org/b", refresh.format("/c#part")),
        ("https://two.org/c", canonical.format("//one.org/a")),
        ("http://three.org/", canonical.format("http://good.org/g?a=1&amp;b=2")),
        ("http://good.org/g?a=1&b=2", refresh.format("http://bad.org/y")),
        ("http://bad.org/z", refresh.format("http://good.org/h")),
        ("http://four.org/", "<!-- " + canonical.format("http://bad.org/x") + " -->"),
        ("http://five.org/d/e", refresh.format("f")),
        ("http://five.org/d/f", canonical.format("http://bad.org/w")),
        ("http://six.org/", refresh.format("mailto:a@bad.org") + canonical.format("http://six.org/")),
        ("http://one.org/a", None),
    ]
    got = {i: r.verdict for i, r in rows(spark, pages, rules).items()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "block"}


def targets(spark, pages):
    """The one target of each page, or None."""
    table = spark.createDataFrame([(f"{url}#{i}", h) for i, (url, h) in enumerate(pages)], "url string, html string")
    found = {int(r.url.rsplit("#", 1)[1]): r.target for r in u.alias_links(table).collect()}
    return [found.get(i) for i in range(len(pages))]


def test_links_resolve_as_in_rfc_3986(spark):
    # Section 5.4, without fragments; other schemes are ignored.
    want = {
        "g:h": None, "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
        "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q",
        "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x?y#s": "http://a/b/c/g;x?y",
        ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
        "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
        "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
        "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
        "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y",
        "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g", "http:g": None,
        "http://h/i/../j?k": "http://h/j?k", "//h/i/./j": "http://h/i/j", "x//../y": "http://a/b/c/x/y",
    }
    link = "<link rel=canonical href='{}'>"
    assert dict(zip(want, targets(spark, [("http://a/b/c/d;p?q", link.format(x)) for x in want]))) == want
    refresh = "<meta http-equiv=refresh content='0; url={}'>"
    got = targets(spark, [("http://a/b/c/d;p?q", refresh.format(x)) for x in ("../g", "?y")])
    assert got == ["http://a/b/g", "http://a/b/c/d;p?y"]
    assert targets(spark, [("http://a", link.format("g")), ("http://a", link.format("../g")), ("http://a?q", link.format("?y"))]) == ["http://a/g", "http://a/g", "http://a?y"]


def test_links_resolve_against_the_base(spark):
    link = "<link rel=canonical href='{}'>"
    cases = [
        ("<base href='http://Z.org/x/y?w'>", "../g", "http://z.org/g"),
        ("<BASE target=_top><base href=/k/l><base href=/m/>", "g", "http://a/k/g"),
        ("<base href='../'>", "g", "http://a/b/g"),
        ("<base href='//z.org'>", "g", "http://z.org/g"),
        ("<base href='http://z.org/x?w'>", "#s", "http://z.org/x?w"),
        ("<base href='http://z.org/x?w'>", "?v", "http://z.org/x?v"),
        ("<base href='ftp://z.org/'>", "g", None),
        ("<base href='ftp://z.org/'>", "http://h/i", "http://h/i"),
        ("<base href='data:x'>", "g", "http://a/b/c/g"),
        ("<base href=''>", "g", "http://a/b/c/g"),
        ("<!-- <base href='http://z.org/'> -->", "g", "http://a/b/c/g"),
    ]
    assert targets(spark, [("http://a/b/c/d?q", base + link.format(x)) for base, x, _ in cases]) == [w for *_, w in cases]
    # The base counts wherever it stands.
    assert targets(spark, [("http://a/b/", link.format("g") + "<base href='http://z.org/'>")]) == ["http://z.org/g"]


def test_resolved_aliases_share_decisions(spark):
    canonical = "<link rel=canonical href='{}'>"
    pages = [
        ("http://one.org/p/q/r", canonical.format("../x")), ("http://one.org/p/x", canonical.format("http://bad.org/")),
        ("http://two.org/p/q", canonical.format("?v=1")), ("http://two.org/p/q?v=1", canonical.format("http://bad.org/")),
        ("http://three.org/", "<base href='http://bad.org/k/'>" + canonical.format("./l")),
        ("http://four.org/a/../b", canonical.format("http://bad.org/")), ("http://four.org/c", canonical.format("./b")),
        ("http://five.org/p/q", canonical.format("#top")),
    ]
    got = rows(spark, pages, [("bad.org", "/", "block")])
    assert [got[i].verdict for i in range(len(pages))] == ["block"] * 7 + ["allow"]
    assert got[0].alias == got[1].alias and got[7].alias is None


def test_given_and_empty_pages(spark):
    pages = read(spark, "pages")
    got = u.judged(pages, u.rule_table(spark, URL_RULES)).collect()
    assert len(got) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in got:
        host, path, rule, verdict = decide(urls[r.page_id], URL_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert u.judged(spark.createDataFrame([], PAGES), u.rule_table(spark, URL_RULES)).count() == 0
