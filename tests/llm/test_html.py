import random
import time

import brute
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html
from tidemark.llm.html import blocks, common_places, content_zone, is_copy, main_text



PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div>%s<aside>side</aside><form><label>Mail</label><input></form><div id="comments"><p>first!</p></div><footer>&copy; me</footer></body></html>"""


def texts(page):
    found = blocks(page)
    return [t for t, z in found if z == content_zone([z for _, z in found])]


@pytest.mark.parametrize("page,want", [
    (PAGE % "<article><header><h1>A &amp; B</h1></header><p>one<br>two  <b>th</b>ree<p>four &lt;5&gt;<div class='share'>x</div><footer>by me</footer></article>", ["A & B", "one two three", "four <5>"]),
    (PAGE % "<main><p>in main</p><section class=comments><p>c</p></section></main>", ["in main"]),
    (PAGE % "<div class='content'><h2>H</h2><p>plain</p></div>", ["H", "plain"]),
    ("<article><p>unclosed <i>inline", ["unclosed inline"]), ("just text", ["just text"]), ("", []), ("<p>a<!-- x --> b</p><![CDATA[z]]>", ["a b"]), ("a < b and c > d", ["a < b and c > d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]), ("<article><p hidden>no</p><p>yes &nbsp; &#65;&#x42;</p></article>", ["yes AB".replace("A", " A").replace("  ", " ")]),
    ("<nav><div><p>menu</nav><p>after</p>", ["after"]), ("<div></p></span>ok</div>", ["ok"]), ("<form><nav>m</nav><main><p>in</p></main><input></form>", ["in"]), ("<aside><article><p>no</p></article></aside><p>x</p>", ["x"]), ("<div class='page has-sidebar'><p>yes</p><div class='right sidebar'>no</div></div>", ["yes"]),
    ("<p>loaded advert_text shadows</p>", ["loaded advert_text shadows"]), ("<p>x<a <b", ["x<a <b"]), ("<p class='x>one</p><p>two</p>", ["one", "two"]), ("<p>&#" + "9" * 5000 + ";&#x0000000041;</p>", ["\ufffdA"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([8, 1 << 26]))
def test_longest_common_subsequence(a, b, bits):
    before, html.TABLE_BITS = html.TABLE_BITS, bits
    try:
        places = common_places(a, b)
    finally:
        html.TABLE_BITS = before
    assert places == sorted(set(places)) and len(places) == length(a, b)
    it = iter(b)
    assert all(a[i] in it for i in places)


@pytest.mark.parametrize("page", ["<a " * 10**6, '<a "' * 10**6, "<div>" * 10**5 + "</p>" * 10**5, "</a" * 10**6, "<script></a" * 10**5, "<span class=ad>x" * 10**5, "<form>" + "<div class=ad>" * 10**5 + "<article>" * 10**5])
def test_hostile_pages_take_one_pass(page):
    start = time.time()
    blocks(page)
    assert time.time() - start < 10


def test_alignment_of_many_lines():
    start = time.time()
    assert len(common_places([7] * 10**5, [7] * 10**5)) == 10**5
    assert len(common_places([1, *[7] * 10**5, 2], [3, *[7] * 10**5, 4])) == 10**5
    rng = random.Random(0)
    assert len(common_places([rng.randrange(2) for _ in range(50_000)], [rng.randrange(2) for _ in range(50_000)])) > 35_000
    assert time.time() - start < 20


SCHEMA = "page_id long, url string, html string"


def test_shared_lines_of_the_nearest_page_go(spark):
    page = lambda i: f"<div>Welcome to the site</div><div><p>text {i} of its own</p><p>and more {i}</p></div><div>Imprint and contact</div>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/x/{i:03}", page(i)) for i in range(60)] + [(100, "http://lone.org/", page(100)), (101, None, page(101)), (102, "no url", page(102))]
    rows += [(200 + i, f"http://copy.org/{i}", page(7)) for i in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(60):
        assert got[i] == f"text {i} of its own\n\nand more {i}"
    whole = lambda i: f"Welcome to the site\n\ntext {i} of its own\n\nand more {i}\n\nImprint and contact"
    assert got[100] == whole(100) and got[101] == whole(101) and got[102] == whole(102)
    assert {got[200], got[201], got[202]} == {whole(7)}  # copies: nothing would be left


def test_copies_meet_the_nearest_different_page(spark):
    page = lambda x: f"<p>Home</p><p>about {x}</p><p>more of {x}</p><p>Imprint</p>"
    rows = [(i, f"http://c.org/a/{i}", page("one")) for i in range(4)] + [(4, "http://c.org/b/4", page("two"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "about one\n\nmore of one" for i in range(4)} | {4: "about two\n\nmore of two"}


def test_near_copies_are_no_neighbours(spark):
    para = lambda x: f"<p>paragraph {x} of the article, as long as such are</p>"
    page = lambda own: f"<p>Home</p>{''.join(map(para, 'abcde'))}{para(own)}<p>Imprint</p>"
    other = "<p>Home</p>" + "".join(map(para, "vwxyz")) + "<p>Imprint</p>"
    rows = [(i, f"http://m.org/b/{i:02}", page(i)) for i in range(30)] + [(99, "http://m.org/c", other), (98, "http://m.org/a", other)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in main_text(df).collect()}
        for i in range(30):
            assert got[i].startswith("paragraph a") and got[i].count("\n\n") == 5 and "Imprint" not in got[i]
        assert got[98] == got[99] and got[99].startswith("paragraph v") and "Home" not in got[99]
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_structure_vetoes_and_settles(spark):
    page = lambda i, core: f"<p>Home</p><article><p>quoted by all</p><p>{core}</p></article><nav>only {i}</nav><p>Imprint</p>"
    rows = [(i, f"http://v.org/{i}", page(i, f"core of page {i} with words of its own {'xyz' * i}")) for i in range(4)]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text.startswith("quoted by all\n\ncore of page") and "only" not in r.text and (r.n_shared, r.n_settled) == (3, 0) for r in got)
    # alone, or beside a page that has no such places, structure settles what the neighbour can't tell
    rows = [(0, "http://w.org/0", page(0, "alone")), (1, "http://z.org/1", page(1, "core one")), (2, "http://z.org/2", "<article><p>core two</p></article><div>x</div>")]
    got = {r.page_id: (r.text, r.n_shared, r.n_settled) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: ("quoted by all\n\nalone", 0, 3), 1: ("quoted by all\n\ncore one", 0, 3), 2: ("core two", 0, 1)}


def test_the_alignment_decides_around_an_article(spark):
    """In a main element around the article structure can't tell a lead from a notice: lines of the neighbour go, those of the page's own stay."""
    core = lambda i: f"<article><p>quoted by all</p><p>core of page {i} with words of its own {'xyz' * (i + 1)}</p></article>"
    page = lambda i: f"<nav>menu {i}</nav><main><div>You are here</div><h1>Title {i}</h1>{core(i)}<div class='x{i}'>Read our app's terms</div></main><p>Imprint</p>"
    rows = [(i, f"http://v.org/{i}", page(i)) for i in range(4)] + [(9, "http://lone.org/", page(9))]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(4):
        assert got[i].text == f"Title {i}\n\nquoted by all\n\ncore of page {i} with words of its own {'xyz' * (i + 1)}" and (got[i].n_shared, got[i].n_settled) == (4, 0)
        # the stage has an effect: if it names nothing, structure leaves another text
        lines = [f"{z}{t}" for t, z in blocks(page(i))]
        assert "\n\n".join(html.kept_lines(lines, set(), True)[0]) != got[i].text
    assert got[9].text.startswith("You are here\n\nTitle 9\n\nquoted") and got[9].text.endswith("terms") and (got[9].n_shared, got[9].n_settled) == (0, 2)
    # a headline that stands elsewhere on the neighbour is none of its lines
    page = lambda i, h1, foot: f"<main><h1>{h1}</h1>{core(i)}</main><footer>{foot}</footer>"
    got = main_text(spark.createDataFrame([(0, "http://u.org/0", page(0, "Contact", "me")), (1, "http://u.org/1", page(1, "Other", "Contact"))], SCHEMA)).collect()
    assert {r.page_id: (r.text.split("\n\n")[0], r.n_shared) for r in got} == {0: ("Contact", 1), 1: ("Other", 1)}
    # a main element with more text than the articles in it is the article, and vetoes as before
    page = lambda i: f"<div role=main><p>a passage that both pages quote at length</p><p>text {i}</p><article>teaser {i}</article></div>"
    got = main_text(spark.createDataFrame([(i, f"http://t.org/{i}", page(i)) for i in range(2)], SCHEMA)).collect()
    assert {r.page_id: (r.text, r.n_shared) for r in got} == {i: (f"a passage that both pages quote at length\n\ntext {i}\n\nteaser {i}", 0) for i in range(2)}


def test_slots_decide(spark):
    """Boilerplate that is drawn anew for each page, in elements whose names and classes say nothing, and in another order: the alignment takes it all; without it most of it stays."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def page(i):
        parts = [f"<div class='x{i} q'><p>{word()} {word()}</p></div>", *[f"<section><ul>{''.join(f'<li>{word()}' for _ in range(rng.randrange(1, 6)))}</ul></section>"], f"<div class='z-{rng.randrange(9)}'>{word()}</div>"]
        rng.shuffle(parts)
        cut = rng.randrange(4)
        return "".join(parts[:cut]) + f"<article><h1>{word()}</h1><p>{' '.join(word() for _ in range(30))}</p></article>" + "".join(parts[cut:])

    rows = [(i, f"http://{'ab'[i % 2]}.org/{i:02}", page(i)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = main_text(df).collect()
    for r in got:
        core = [t for t, z in blocks(rows[r.page_id][2]) if z == html.ARTICLE]
        assert r.text == "\n\n".join(core) and r.n_settled == 0 and r.n_shared >= 3
    plain = {r.page_id: r.text for r in main_text(df, aligned=False).collect()}
    assert all(plain[r.page_id] != r.text for r in got)


def test_alignment_changes_most_pages(spark):
    """On the test pages what goes, goes by the alignment; structure settles what is left, and the text of most pages is another without it."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in main_text(df).collect()}
    plain = {r.page_id: r.text for r in main_text(df, aligned=False).collect()}
    assert sum(r.text != plain[i] for i, r in got.items()) > 0.9 * len(got)
    assert sum(r.n_shared for r in got.values()) > 20 * sum(r.n_settled for r in got.values())


@pytest.mark.parametrize("made", [False, True])
def test_against_brute_force(spark, made):
    if made:
        rng = random.Random(3)
        bit = lambda: rng.choice(["<p>line %d</p>", "<div class='ad'>buy %d</div>", "<ul><li>item %d<li>more</ul>", "<nav>menu %d</nav>", "a &lt; %d <b>b</b><br>c"]) % rng.randrange(12)
        body = lambda: "".join(bit() for _ in range(rng.randrange(1, 9)))
        rows = [(i, f"http://{rng.choice('ab')}.org/{rng.randrange(60)}?{i}", body() if rng.random() < 0.7 else f"{body()}<article>{body()}</article>{body()}") for i in range(150)]
    else:
        pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
        rows = list(zip(pages.page_id.tolist(), pages.url, pages.html))
    got = {r.page_id: (r.text, r.n_shared) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.main_text(rows)


def test_does_not_depend_on_partitions(spark):
    rng = random.Random(0)
    line = lambda: f"<p>line {rng.randrange(30)}</p>"
    rows = [(i, f"http://h.org/{rng.randrange(40)}/{i}", "".join(line() for _ in range(rng.randrange(1, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({r.page_id: r.text for r in main_text(df.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1] and len(out[0]) == 300


def test_odd_rows(spark):
    rows = [(1, "http://a.org/1", None), (2, "http://a.org/2", ""), (None, None, "<p>x</p>"), (3, "http://a.org/3", "<p>y</p>"), (3, "http://a.org/3", "<p>y</p>"), (4, "http://a.org/4", "<p>" + "long " * 200_000 + "</p>")]
    out = main_text(spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("mine")).withColumn("_x", F.lit(1)))
    got = out.collect()
    assert len(got) == 6 and "_x" in out.columns and sorted(r.text[:2] for r in got) == ["", "", "lo", "x", "y", "y"]
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
