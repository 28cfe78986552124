import time

import numpy as np
import pytest

from rankmill.llm.boosting import Trees
from rankmill.llm.html_main import Page, extract, main_text, template_pages, train, weak_labels

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>'


@pytest.fixture(scope="module")
def trees(spark):
    return train(spark.createDataFrame([], "page_id long, html string"))


CASES = [
    (None, ""), ("", ""), ("plain &amp; <!-- x --> simple", "plain & simple"), ("<p>only one", "only one"),
    (f"<html><head><title>T</title><body>{NAV}<article><h1>Name  of it</h1><p>One &lt;b&gt;<br>two.<p>Three <i>fo</i>ur</article></html>", "Name of it\n\nOne <b> two.\n\nThree four"),
    (f"<body>{NAV}<div class=sidebar><p>Read other things here.</p></div><article><p>The text of the page, at last.</p><p>And a second part of it.</p>"
     '<div class="comments"><p>I liked it very much.</p></div></article><footer>&copy; 2020 someone</footer>', "The text of the page, at last.\n\nAnd a second part of it."),
    ('<article><p>First part of the story.</p><script>var x = "<p>no</p>";</script><style>p{}</style><p>Sec<script>1</script>ond&nbsp;part, the end.</p></article>',
     "First part of the story.\n\nSecond part, the end."),
    ("<article><p>A story with a form below it.</p><form><p>Name</p><input><button>Send</button></form></article>", "A story with a form below it."),
]


BLOCKS = [
    ("<p>Buy <button><div>CLICK</div></button> now</p>", "Buy now"),
    ("<p>See <svg><g><text>LBL</text></g></svg> chart of it</p>", "See chart of it"),
    ("<p>a <nobr>b</nobr> c <x-term>d</x-term> e</p>", "a b c d e"),
    ("<p>film <video controls><p>no video here</p><a href=x>load</a></video> end</p>", "film end"),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>", "if x=2 then"),
    ("<p>one<label>Name <b>x</b></label><div>two</div>three", "one\n\ntwo\n\nthree"),
    ("<div><button>open <p>hidden</div><p>after</p>", "after"),
    ("<select><option>a<option>b</select>rest", "rest"),
    ("<svg/>x<svg><script/>y</svg>z", "xz"),
    ("<head><title>T</title><meta charset=x><link rel=y>said<div>body</div>", "body"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<textarea>not closed <p>x", ""), ("<template>open <p>x", "open\n\nx"), ("a</p>b", "a\n\nb"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("source, want", BLOCKS)
def test_blocks(source, want):
    page = Page.parse(source)
    assert page.text(np.ones(len(page.tags), bool)) == want


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p>" + "<b>" * 100_000 + "x<div>y", "<ul>" + "<li><div>" * 50_000, "</p>" * 100_000, "<template>" * 50_000 + "x",
    "<p><div>" * 50_000 + "</p>" * 50_000, "<button>" + "<p>" * 100_000,
])
def test_deep_pages_take_proportional_time(trees, source):
    start = time.perf_counter()
    main_text(source, trees)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("source, want", CASES)
def test_pages(trees, source, want):
    assert main_text(source, trees) == want


def test_decoding_is_consistent_and_optimal(trees):
    for source in template_pages(40, seed=77):
        page = Page.parse(source)
        odds = trees.log_odds(page.features())
        kept = page.decode(odds)
        assert all(kept[p] for i, p in enumerate(page.parents) if i and kept[i])
        if len(odds) <= 12:
            best = 0.0
            for bits in range(1 << (len(odds) - 1)):
                pick = [True] + [bool(bits >> i & 1) for i in range(len(odds) - 1)]
                if all(pick[p] for i, p in enumerate(page.parents) if i and pick[i]):
                    best = max(best, float(sum(odds[1:][np.array(pick[1:])])))
            assert abs(best - float(odds[1:][kept[1:]].sum())) < 1e-9


def test_held_out_templates(trees):
    found, want, both = 0, 0, 0
    for source in template_pages(120, seed=1234):
        page = Page.parse(source)
        a = set(page.text(page.decode(trees.log_odds(page.features()))).split("\n\n"))
        b = set(page.text(weak_labels(page) > 0).split("\n\n"))
        found, want, both = found + len(a), want + len(b), both + len(a & b)
    assert both / found > 0.95 and both / want > 0.95


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(1).random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Trees(depth=3).fit(x[:2000], y[:2000], np.ones(2000))
    assert ((model.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_table(spark, trees):
    long = "<article>" + "<p>Many words stand here, again.</p>" * 20000 + "</article>"
    rows = [(1, "u", source, "x") for source, _ in CASES] + [(2, None, long, None), (2, None, long, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = extract(pages, trees).collect()
    assert sorted(r.text for r in got if r.page_id == 1) == sorted(want for _, want in CASES)
    assert [r.text for r in got if r.page_id == 2] == ["\n\n".join(["Many words stand here, again."] * 20000)] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(pages.limit(0), trees).count() == 0
