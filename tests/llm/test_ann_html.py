"""Nearest neighbours against brute force; HTML extraction on made pages."""

import numpy as np

from driftwise.llm import ann, html_extract
from driftwise.llm.common import table
from tests.conftest import MEDIUM


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, key string, b int")


def test_recall_and_order(spark):
    df = table(spark, MEDIUM, "embeddings")
    got = ann.nearest(df)
    rows = got.collect()
    assert ann.recall(got, spark, df) >= 0.9
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    by = {}
    for r in rows:
        assert r.score == np.float64(r.score) and abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert set(by) == {i for i in x if i % 20 == 0}
    for own in by.values():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, 21)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_many_buckets_and_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 300)
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 12)) * rng.uniform(0.2, 3, (1500, 1))
    df = vectors(spark, [(i, [float(v) for v in row], 1, "k", 2) for i, row in enumerate(x)])
    assert ann.recall(ann.nearest(df, every=20, k=10), spark, df, k=10) >= 0.9


def test_recall_with_a_third_in_one_tight_cluster(spark):
    """Recall of the cluster's queries and of the others, each; those others have far neighbours, which few lists hold."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 48))
    x[::3] = rng.standard_normal(48) + 0.05 * x[::3]
    df = vectors(spark, [(i, [float(v) for v in row], 1, "k", 2) for i, row in enumerate(x)]).cache()
    got = ann.nearest(df).cache()
    assert ann.recall(got, spark, df) >= 0.95
    assert ann.recall(got.where("query_id % 3 = 0"), spark, df, every=60) >= 0.95


def test_recall_counts_lost_queries(spark):
    df = vectors(spark, [(i, [1.0, float(i)], 1, "k", 2) for i in range(60)])
    got = ann.nearest(df, every=20, k=5)
    assert ann.recall(got, spark, df, k=5) == 1
    assert ann.recall(got.where("query_id <> 20"), spark, df, k=5) < 0.7


def test_vector_edges(spark):
    same = [1.0, 0.0]
    rows = [(i, same, 0, "", 0) for i in range(0, 60)]  # a group of copies larger than a result
    rows += [(100, [0.0, 1.0], 0, "", 0), (101, None, 0, "", 0), (102, [0.0, 0.0], 0, "", 0), (103, [float("nan"), 1.0], 0, "", 0), (104, [1.0, None], 0, "", 0),
             (105, [float("inf"), 1.0], 0, "", 0), (106, [1.0], 0, "", 0), (None, same, 0, "", 0), (40, same, 0, "", 0), (120, None, 0, "", 0)]
    got = ann.nearest(vectors(spark, rows), every=20, k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 100}
    for q in (0, 20, 40):
        assert by[q] == [i for i in range(21) if i != q][:20]
    few = ann.nearest(vectors(spark, rows[58:61]), every=20, k=20).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(100, 58, 0.0), (100, 59, 0.0)]
    assert ann.nearest(vectors(spark, [])).collect() == []


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><div id="header"><a href="/">Home</a></div>
<nav><ul><li><a href="/{n}">Link {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><aside>Side {n}</aside><{tag}><h1>Head &amp; line {n}</h1><p>First <i>pa</i>ra&nbsp;{n}.<p>Second<br>line {n}<ul><li>one {n}<li>two</ul>
<p class="share">Share this</p><section class="comments"><p>nice {n}!</p></section><script>var t="</p>";</script></{tag}></div><form><p>Mail</p></form><footer>foot {n}</footer>"""


def test_extraction(spark):
    rows = [(n, f"https://A.example/{n}", PAGE.format(n=n, tag="article" if n % 2 else "main")) for n in range(14)]
    rows += [(100, "https://b.example/x", "<p>only &lt;text&gt;"), (101, None, None), (102, "", ""), (103, "https://c/", "no tags at all"),
             (104, "https://c/1", "<div" + " a" * 50_000), (105, "https://c/2", "<p>" + "long words " * 60_000 + "</p>"), (None, "https://c/3", "<article><p>x</p>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for n in range(14):
        assert got[n].text == f"Head & line {n}\nFirst para {n}.\nSecond line {n}\none {n}\ntwo"
        assert got[n].n_chars == len(got[n].text)
    assert got[100].text == "only <text>" and got[101].text == got[102].text == "" and got[103].text == "no tags at all"
    assert got[105].text == ("long words " * 60_000).strip() and got[None].text == "x"
    assert html_extract.extract(df.limit(0)).collect() == []


def test_constant_slot_is_template_and_copies_keep_their_text():
    pages = [f"<article><p>Story {n} of the day.</p><div class=x>Same words below every story</div></article>" for n in range(12)]
    template = None
    for p in pages:
        own = html_extract._page_tree(p)[1]
        template = own if template is None else html_extract.merge(template, own)
    assert html_extract.main_text(pages[3], template) == "Story 3 of the day."
    same = None
    for _ in range(12):
        own = html_extract._page_tree(pages[0])[1]
        same = own if same is None else html_extract.merge(same, own)
    assert html_extract.main_text(pages[0], same) == "Story 0 of the day.\nSame words below every story"


def test_tree_matching_brute_force():
    def brute(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), brute(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a[6], b[6])

    import random

    rng = random.Random(1)

    def tree(depth):
        return [rng.choice("ab"), 1, 1, 0, 0, {}, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]

    for _ in range(60):
        a, b = tree(2), tree(2)
        assert html_extract.match(a, b, {}) == brute(a, b)


def test_deep_nesting_keeps_all_text(spark):
    """5 000 nested elements, blocks or inline: every text comes out, in order, and what follows them too."""
    for tag in ("div", "span", "b", "ul"):
        page = "<html><body><article><h1>Head</h1>" + "".join(f"<{tag}>t{i} " for i in range(5000)) + f"</{tag}>" * 5000 + "<p>After them</p></article><footer>foot</footer></body></html>"
        got = html_extract.main_text(page)
        assert got.split() == ["Head", *(f"t{i}" for i in range(5000)), "After", "them"], tag
    assert html_extract.main_text("<div>" * 5000 + "unclosed") == "unclosed"
    pages = spark.createDataFrame([(i, "http://h.example/a", "<div>" * 2000 + f"<p>text {i}</p>") for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(pages).collect()} == {f"text {i}" for i in range(3)}


def test_near_copies_of_an_article_keep_it(spark):
    """Twelve pages of a host share an article but for its date; other hosts' constant blocks in an article still go."""
    article = "<h1>Shared headline</h1><p>" + "first paragraph of the story " * 5 + "</p><p>" + "second paragraph of it " * 5 + "</p>"
    copies = [(i, "http://copy.example/" + str(i), f"<nav>menu</nav><article>{article}<p>Updated on day {i}</p></article>") for i in range(12)]
    own = [(100 + i, "http://own.example/" + str(i), f"<article><p>Share this story with friends</p><p>{' '.join(f'w{i}x{j}' for j in range(60))}</p></article>") for i in range(12)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(copies + own, "page_id long, url string, html string")).collect()}
    assert all(len(got[i]) == 4 and got[i][0] == "Shared headline" and got[i][3] == f"Updated on day {i}" for i in range(12))
    assert all(got[100 + i] == [" ".join(f"w{i}x{j}" for j in range(60))] for i in range(12))
