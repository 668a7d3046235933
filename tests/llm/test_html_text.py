import itertools
import random
import time

import pytest

from tessera.llm.html_text import PRIOR, Model, _cut, extract, fit, labelled, main_text, minimum_cut, train

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>no";</script></head><body class="home"><header><h1>Site</h1><a href="/">Home</a></header>
<nav><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></nav><div id="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<div class="sidebar"><p>Popular posts are here for you to read today, all of them very long.</p></div>
<article><h1>My &amp; title</h1><p>First paragraph, with <b>bold</b> words<br>and a <a href="y">link</a> &lt;ok&gt; a &lt; b.<p>Second&nbsp;one,
over lines.</p><div class="ad">Buy now, cheaper than ever before, only today.</div><p>Short.</p><form><label>Mail</label><input name=x></form></article>
<section class="comments"><p>I like this very much, thank you for writing it, said the reader.</p></section><aside><p>About the author and other long things that nobody reads.</p></aside><footer>&copy; Site</footer></body></html>"""


def test_an_article():
    assert main_text(PAGE) == "My & title\nFirst paragraph, with bold words and a link <ok> a < b.\nSecond one, over lines.\nShort."


@pytest.mark.parametrize("page, text", [("", ""), ("<p>just a paragraph of plain text", "just a paragraph of plain text"), ("<script>if (a < b) x()", ""), ("<!-- no", ""), ("<nav><a href=x>menu</a></nav>", ""), ("<p>a &amp b &#233; &bogus; c d e f g h</p>", "a & b é &bogus; c d e f g h"), ('<p title="a>b">x y z long enough to be read</p>', "x y z long enough to be read")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_cuts_are_the_least():
    r = random.Random(0)
    for _ in range(150):
        n = r.randrange(1, 9)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        ties = {(a, b): r.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        cost = lambda l: sum(abs(s) for s, x in zip(scores, l) if (s > 0) != x) + sum(w for (a, b), w in ties.items() if l[a] != l[b])  # noqa: B023, E731, E741
        assert cost(minimum_cut(scores, ties)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x"), (3, "w", "<p>" + "long words and more " * 30000 + "</p>", "")], "page_id long, url string, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "html", "text_in", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == len("long words and more " * 30000) - 1
    assert extract(df.limit(0)).collect() == []


def _made(n, seed=0, lists=True):
    """Pages with their articles' texts: lists of links within articles, whole sentences among menus and notices without names."""
    r = random.Random(seed)
    words = lambda a, b: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) for _ in range(r.randrange(a, b)))
    out = []
    for _ in range(n):
        body, keep = [], []
        for k in range(r.randrange(3, 8)):
            text = words(8, 40) + "."
            body.append(f"<p>{text}</p>")
            keep.append(text)
            if k % 2 and lists:
                items = [words(1, 3) for _ in range(2)]
                body.append("<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in items) + "</ul>")
                keep += items
        menu = "".join(f"<li><a href=y>{words(1, 3)}</a></li>" for _ in range(6))
        out.append((f"<html><body><nav><ul>{menu}</ul></nav><div class=notice>{words(5, 20)}.</div><article><h1>{words(3, 9)}</h1>{''.join(body)}</article><footer>{words(4, 9)}</footer></body></html>", keep))
    return out


def test_the_cut_mends_what_the_classifier_gets_wrong():
    model = fit([p for p, _ in _made(50, 1, lists=False)])  # the sample shows no lists of links within articles
    whole, alone = 0, 0
    for page, keep in _made(100):
        blocks, cut, classifier = labelled(page, model)
        want = [False] * 7 + [True] * (len(keep) + 1) + [False]
        whole += cut == want
        alone += classifier == want
    assert whole > 50 and alone < 10, (whole, alone)


def test_fitting_falls_back_to_the_prior():
    assert fit([]).weights == PRIOR and fit(["<p>no article here</p>"]).weights == PRIOR
    model = fit([p for p, _ in _made(30)] * 2)
    assert model.weights["<article>"] > 1 and model.weights[".notice"] < -3 and model.weights[".sidebar"] == PRIOR[".sidebar"]


def test_the_query_gives_the_articles(spark, sf_dir):
    from tessera.llm.queries import op8_html_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = op8_html_text(spark, sf_dir)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(pages)
    for r in got:
        want = []
        for block, _, e in _cut(pages[r.page_id], {}):
            while e is not None and e.tag != "article":
                e = e.up
            if e is not None:
                want.append(block)
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


@pytest.mark.parametrize("junk", ["<a ", '<a "', "<div>", "<svg>", "<!-- ", "</p>", "<b></i>", "<p>x", "<i><div><span></i>", "<li><a href=x>y</a>"])
def test_long_broken_markup_takes_time_by_its_length(junk):
    began = time.process_time()
    main_text(junk * ((1 << 20) // len(junk)))
    assert time.process_time() - began < 8  # a second or so; squares would take minutes


def test_elements_without_an_end_lose_only_themselves():
    assert main_text("<article><p>One two three four. <svg><p>Five six seven eight.</article>") == "One two three four.\nFive six seven eight."
    assert main_text("<article><p>One two three four <math>x</math> five.</article>") == "One two three four x five."


def test_a_sample_trains(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(_made(20))] + [(99, None)], "page_id long, html string")
    assert train(df).weights["<article>"] > 1
    assert isinstance(train(df.limit(0)), Model)
