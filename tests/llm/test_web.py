import random
import re
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaspark.llm import license_alignment, page_trees, plans, url_cascade

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def forest(spark):
    return page_trees.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def text_of(forest, html):
    page = page_trees.Page(html)
    return page_trees.main_text(page, page_trees.decode(page, forest.probability(page_trees.figures(page))))


def test_op9_on_the_marked_articles(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("(?s)<article>(.*)</article>", r.html).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = plans.op9_pages(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_made_pages(forest, spark):
    html = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()]
    stock = sorted({s for h in html for _, t in page_trees.Page(h).pieces for s in re.split(r"(?<=[.!?])\s", t)})
    rng, right = random.Random(123), 0
    for _ in range(150):
        made = page_trees.make_page(rng, rng.sample(stock, 40))
        marked = page_trees._Marked(made)
        want = "\n".join(t for v, t in marked.pieces if marked.main[v])
        right += text_of(forest, re.sub(' data-main="."', "", made)) == want
    assert right >= 0.9 * 150


def test_page_with_everything(forest):
    html = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
    <header class="site-header"><p>Site name and slogan here</p></header>
    <div class="cookie-notice"><p>We use cookies on this site, please accept them.</p></div>
    <main><article><h1>A title &amp; more</h1><p>First   paragraph of the story,\n with several words in it &eacute;.</p>
    <div class="advert"><p>Buy this thing now.</p></div>
    <p>Second paragraph, which is <b>bold</b> and goes on for a while.<br>It ends here.
    <p>Third one, never closed, with enough words to be a paragraph.</article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
    <section id="comments"><p>Great read, thanks a lot for it!</p><form><textarea>write</textarea></form></section>
    <footer>&copy; us</footer></body></html>"""
    assert text_of(forest, html) == (
        "A title & more\nFirst paragraph of the story, with several words in it é.\n"
        "Second paragraph, which is bold and goes on for a while. It ends here.\n"
        "Third one, never closed, with enough words to be a paragraph."
    )


def test_decoding_is_consistent_and_best():
    page = page_trees.Page("<div><p>a</p><p>b</p><section><p>c</p></section></div><p>d</p>")
    rng = random.Random(1)
    for _ in range(50):
        p = [rng.random() for _ in page.tag]
        kept = page_trees.decode(page, __import__("numpy").array(p))
        n = len(p)

        def chance(choice):
            out = 1.0
            for v in range(1, n):
                out *= p[v] if choice[v] else 1 - p[v]
            return out

        def fits(choice):
            return choice[0] and all(choice[page.parent[v]] or not choice[v] for v in range(1, n))

        every = [[bool(k >> i & 1) for i in range(n)] for k in range(1 << n)]
        assert fits(kept) and chance(kept) == max(chance(c) for c in every if fits(c))


def test_odd_pages(spark, forest):
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, "<p>" * 3000 + "deep"), (5, "<div>" * 2000), (6, "a < b & c"), (6, "a < b & c"), (7, "<"), (8, "<!-- x")]
    df = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    got = page_trees.extract(df.drop("text"), forest, ["page_id"]).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 5)} == {""}
    assert page_trees.extract(df.limit(0), forest, ["page_id"]).count() == 0
    assert page_trees.fit(df.drop("text").limit(0)).depth == 5


def test_op10_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(duck.execute(plans.CHECKS["op10_url_filter"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in plans.op10_url_filter(spark, SF).select(*names).collect()), key=str)
    assert got == want


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.ORG/x?y#z", "http://org/", "http://xorg/", "http://a.example.org/es/1",
        "http://example.org/en/12", "http://b.com/de/", "http://b.com/de", "x://h?q://z/", "http://spam-farm.net/", "http://a.b.spam-farm.net#f",
        "http://a.b.spam-farm.net#f", "http://ads.org", "http://ads.org/",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    keys = url_cascade.domain_keys(df)
    cascade = url_cascade.Cascade(keys.select("key", F.col("key").isin("spam-farm.net", "ads.org").alias("listed")))
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(df, cascade, plans.RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.org", "/x", "org/", "allow"), 5: ("org", "/", "org/", "allow"), 6: ("xorg", "/", None, "allow"),
        7: ("a.example.org", "/es/1", "example.org/es/", "block"), 8: ("example.org", "/en/12", "example.org/en/1", "block"),
        9: ("b.com", "/de/", "com/de/", "block"), 10: ("b.com", "/de", None, "allow"), 11: ("h", "", None, "allow"),
        12: ("spam-farm.net", "/", None, "block"), 13: ("a.b.spam-farm.net", "", None, "block"),
        14: ("a.b.spam-farm.net", "", None, "block"), 15: ("ads.org", "", None, "block"), 16: ("ads.org", "/", "org/", "allow"),
    }


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_cascade_is_exact(spark, monkeypatch, most_bits):
    monkeypatch.setattr(url_cascade, "MOST_BITS", most_bits)
    monkeypatch.setattr(url_cascade, "BITS_A_KEY", 2)  # many false positives, so that several levels are needed
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_cascade.Cascade(keys)
    if most_bits == 64:
        assert cascade.listed.count() == 572
        return
    assert len(cascade.levels) > 2
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    nothing = url_cascade.Cascade(keys.where("not listed"))
    assert keys.where(nothing.holds(F.col("key"))).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def test_alignment_matches_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        template = [rng.randint(1, 9) for _ in range(rng.randint(3, 12))]
        text = [t for t in template for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))]
        count, first, last = license_alignment.align(template, text, -4, 8)
        assert count == lcs(template, text)
        if count:
            assert lcs(template, text[first : last + 1]) == count


def test_op7_finds_planted_lines(spark):
    lines = {t: n for n, t in license_alignment.TEMPLATES.items()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for line, name in lines.items():
            for m in re.finditer(re.escape(line), r.text):
                want.add((r.doc_id, name, m.start(), m.start() + len(line.rstrip('.:"'))))
    got = plans.op7_licenses(spark, SF).collect()
    assert want and {(r.doc_id, r.license, r.start, r.end) for r in got if r.coverage == 1} == want


def test_odd_texts_for_licenses(odd, spark):
    mit = license_alignment.TEMPLATES["MIT"]
    broken = mit.replace("hereby", "").replace("merge,", "merge, mix").upper()
    rows = [(1, f"Intro. {mit} And {broken}", "x"), (2, "Permission is hereby granted to go", "x"), (3, None, "x"), (4, "Released under the MIT License. " * 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.start, r.coverage) for r in license_alignment.scan(df, license_alignment.TEMPLATES, ["doc_id"]).collect())
    assert [(i, n) for i, n, _, _ in got] == [(1, "MIT"), (1, "MIT"), (4, "MIT-notice"), (4, "MIT-notice")]
    assert got[0][2:] == (7, 1.0) and 0.9 < got[1][3] < 1
    assert license_alignment.scan(odd, license_alignment.TEMPLATES, ["doc_id"]).count() == 0
    assert license_alignment.scan(df, {}, ["doc_id"]).count() == 0


def found_in(text, index=[]):
    index = index or index.append(license_alignment.Index(license_alignment.TEMPLATES)) or index
    return [(m[0], m[3]) for m in license_alignment.matches(index[0], text)]


def test_headers_and_notices_that_the_tables_do_not_hold():
    header = license_alignment.TEMPLATES["GPL"]
    assert found_in(header) == [("GPL", 1.0)]
    for word, name in [("Lesser", "LGPL-3.0-header"), ("Affero", "AGPL-3.0-header")]:
        assert found_in(f"// {header.replace('General', word + ' General')} //") == [(name, 1.0)]
    assert found_in(header.replace("version 3", "version 2")) == [("GPL-2.0-header", 1.0)]
    for opening in ("Distributed", "Made available", "This package is free and comes"):
        assert found_in(f"{opening} under the MIT License.") == [("MIT-under", 1.0)]
    assert found_in("Distributed under the terms of the ISC license") == [("ISC-under", 1.0)]
    assert found_in("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0-work", 1.0)]
    assert found_in("This work is licensed under the GNU Affero General Public License, version 3.") == [("AGPL-3.0-work", 1.0)]
    assert found_in("Licensed under CC BY-NC-ND 4.0.") == [("CC-BY-NC-ND-4.0-licensed", 1.0)]
    assert found_in("Licensed under CC BY-NC 3.0.") == [("CC-BY-NC-3.0-licensed", 1.0)]


def test_whole_licenses_are_spanned():
    texts = {n: t for n, t in license_alignment.TEMPLATES.items() if n.endswith("-text")}
    assert {"MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Unlicense-text", "GPL-2.0-text"} <= set(texts)
    index = license_alignment.Index(license_alignment.TEMPLATES)
    for name, text in texts.items():
        (row,) = license_alignment.matches(index, f"Copyright someone. {text} The end of it.")
        assert row[0] == name and row[3] == 1 and row[4] >= 19 and row[5] >= 19 + 0.95 * len(text)


def test_reachable_words_bound_the_alignment():
    rng = random.Random(9)
    for _ in range(300):
        template = [rng.randint(1, 9) for _ in range(rng.randint(3, 12))]
        text = [rng.randint(0, 9) for _ in range(rng.randint(1, 30))]
        low = rng.randint(-12, 25)
        bound = license_alignment.reachable(template, license_alignment.np.array(text), low, low + 2)
        count = license_alignment.align(template, text, low, low + 2)[0]
        assert bound >= count or bound < license_alignment.COVERAGE * len(template) > count


LAYOUTS = {
    "body with a sidebar": '<body class="has-sidebar"><div id="content">{}</div><aside>{}</aside>',
    "right sidebar": '<body class="right-sidebar"><article>{}</article><div class="sidebar">{}</div>',
    "open comments": '<body><article class="post comments-open">{}</article><footer>{}</footer>',
    "has comments": '<body><article class="post has-comments">{}</article><footer>{}</footer>',
    "tagged": '<body><article class="post tags-news">{}</article><footer>{}</footer>',
    "builder": '<body><div class="elementor-widget"><article>{}</article></div><footer>{}</footer>',
    "one form": '<body><form method="post"><div id="main">{}</div><footer>{}</footer></form>',
}


@pytest.fixture(scope="module")
def trained(spark):
    return page_trees.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("header", ["{}", "<header>{}</header>", '<div class="entry-header">{}</div>'])
@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_ordinary_layouts_keep_their_article(trained, layout, header):
    paragraphs = [
        "The council met on Tuesday evening to discuss the new bridge, which has been planned for more than ten years.",
        "Several residents spoke against the plan, saying that traffic through the old town would only grow worse.",
        "An engineer explained that the foundations could be laid before the winter, if the money was granted in time.",
        "A decision is expected next month; until then, the drawings can be seen at the town hall every morning.",
    ]
    title = "A new bridge for the old town"
    article = header.format(f"<h1>{title}</h1>") + "".join(f"<p>{p}</p>" for p in paragraphs)
    html = "<html><head><title>x</title></head>" + LAYOUTS[layout].format(article, "<p>All rights reserved, 2024.</p>") + "</body></html>"
    page = page_trees.Page(html)
    text = page_trees.main_text(page, page_trees.decode(page, trained.probability(page_trees.figures(page))))
    assert text.split("\n") == [title, *paragraphs]


def test_paragraphs_are_never_lost_altogether():
    html = "<body><div><h1>Head</h1>" + "<p>" + "word " * 30 + "</p>" + "<p>" + "text " * 30 + "</p></div><nav><p>" + "menu " * 90 + "</p></nav>"
    page = page_trees.Page(html)
    nothing = page_trees.decode(page, np.full(len(page.tag), 1e-9))
    assert page_trees.main_text(page, nothing).split("\n")[0] == "Head" and "menu" not in page_trees.main_text(page, nothing)
    menu = page_trees.Page("<nav><p>" + "menu " * 90 + "</p></nav>")
    assert page_trees.main_text(menu, page_trees.decode(menu, np.full(len(menu.tag), 1e-9))) == ""
