import random
import time

from textmill.operators import mainpage

SF = "/root/testdata/sf0.001"


def quadratic(weights):
    """The definition: every run."""
    best = (0, 0, 0)
    for i in range(len(weights)):
        total = 0
        for j in range(i, len(weights)):
            total += weights[j]
            if total > best[0]:
                best = (total, i, j + 1)
    return best


def test_best_run_is_the_quadratic_one():
    rng = random.Random(1)
    for _ in range(3000):
        w = [rng.choice([-2, -2, -1, 0, 0, 1, 2, 5]) for _ in range(rng.randrange(0, 25))]
        assert mainpage.best_run(w) == quadratic(w), w


def test_all_pages_equal_the_quadratic_definition(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in mainpage.main_texts(pages).collect():
        assert (r.first, r.end) == quadratic([w for w, _ in mainpage.tokens(html[r.page_id] or "")])[1:]
        assert not set("<>") & set(r.text) or "<" in r.text


def test_menus_ads_and_scripts_are_left_out():
    text = "Some words that are the story of this page, and more of them. " * 3
    page = f'<html><head><title>T</title><script>var x="<p>words words words words words words words words</p>";</script></head><body><nav><ul>{"<li><a href=x>Menu item here</a></li>" * 9}</ul></nav><!-- a <p>comment</p> --><article><h1>Head</h1><p>{text}<b>bold</b> end.</p><p>{text}</p></article><footer><a>all about us and more</a> small print of the site</footer></body></html>'
    got, _, _ = mainpage.main_text(page)
    assert got.startswith("Head\nSome words") or got.startswith("Some words")
    assert "bold end." in got and got.count("Some words") == 6
    assert not any(x in got for x in ("Menu", "var x", "comment", "small print"))


def test_broken_and_nested_markup():
    w = lambda page: [x for x in mainpage.tokens(page)]
    assert w("a < b") == [(3, "a < b")] and w("a < b<p>") == [(1, "a "), (1, "<"), (1, " b"), (-2, "\n")]
    assert w("<a>x <nav>y</a>z</nav>q") == [(0, ""), (-1, "x "), (-2, "\n"), (-1, "y"), (0, ""), (1, "z"), (-2, "\n"), (1, "q")]
    assert w("</a>x<a>y") == [(0, ""), (1, "x"), (0, ""), (-1, "y")]
    assert w("<NAV><nav>x</nav>y</NAV>z") == [(-2, "\n"), (-2, "\n"), (-1, "x"), (-2, "\n"), (-1, "y"), (-2, "\n"), (1, "z")]
    assert w("<!-- open <p>x") == [(0, ""), (1, "x")] and w("<!-- x --><!---->y") == [(0, ""), (0, ""), (1, "y")] and w("x<p") == [(1, "x<p")] and w("<!DOCTYPE html><?x?>") == [(0, ""), (0, "")]
    assert w("<script>x</p>")[0] == (-2, "\n") and w("x &amp; y") == [(3, "x & y")]
    assert mainpage.main_text(None) == ("", 0, 0) == mainpage.main_text("<p></p>") == mainpage.main_text("<a>only links</a>")


def test_nulls_empty_tables_and_long_pages(spark):
    df = spark.createDataFrame([(1, None, "mine"), (None, "<p>x y z", "mine"), (1, "<p>x y z", "mine")], "page_id long, html string, text string")
    assert sorted(map(tuple, mainpage.main_texts(df).collect()), key=repr) == sorted([(1, "", 0, 0), (None, "x y z", 1, 2), (1, "x y z", 1, 2)], key=repr)
    assert mainpage.main_texts(df.limit(0)).count() == 0
    for page in ("<p>word " * 200_000, "<" * 300_000, "<!--" * 50_000, "<a>" * 100_000 + "x" + "</nav>" * 100_000, "<div " * 20_000):
        began = time.perf_counter()
        mainpage.main_text(page)
        assert time.perf_counter() - began < 20
