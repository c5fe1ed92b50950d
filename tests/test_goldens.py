"""Small known results of text rules, scores, addresses, ranks and windows."""

import math
import random
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.functions import scoring, urls
from searchloom.functions import text as T
from searchloom.operators import graph, index, lexicon, links, papers, search, stats


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_doc_tokens(spark):
    text = "1.2.3 covid-19 9/11 1,000 3..4 a1.2b x_y"
    assert one(spark, "t string", [(text,)], T.doc_tokens(F.col("t")))[0][0] == ["1.2.3", "covid", "19", "9/11", "1,000", "3", "4", "a1.2b", "x_y"]


def test_doc_tokens_property(spark):
    rnd = random.Random(1)
    alphabet = list("ab1 2.,/-_é \n’9Z")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(500)]

    def rule(t):
        t = re.sub(r"(?<!\d)[^\w\s]|[^\w\s](?!\d)", " ", t.replace("\n", " "))
        return re.sub(r"\s+", " ", t).strip().lower().split()

    got = one(spark, "t string", [(t,) for t in texts], T.doc_tokens(F.col("t")))
    assert [g[0] for g in got] == [rule(t) for t in texts]


def test_paper_tokens_property(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(list("aB3 .,-éß—\n_")) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    got = one(spark, "t string", [(t,) for t in texts], T.paper_tokens(F.col("t")))
    assert [g[0] for g in got] == [[w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)] for t in texts]


@pytest.mark.parametrize(
    ("query", "together", "apart"),
    [
        ("9/11", ["9/11"], ["9/11"]), ("COVID-19", ["covid19"], ["covid", "19"]), ("1,000 (cases)", ["1000", "cases"], ["1000", "cases"]), ("f(x)=3.14", ["fx3.14"], ["f", "x", "3.14"]),
        ("state-of-the-art", ["stateoftheart"], ["state", "of", "the", "art"]), ("C++ & C#", ["c", "c"], ["c", "c"]), ("", [""], [""]),
    ],
)
def test_query_tokens(spark, query, together, apart):
    q = F.col("q")
    assert one(spark, "q string", [(query,)], T.query_tokens(q, True), T.query_tokens(q, False)) == [(together, apart)]


def test_html(spark):
    html = """<html><head><title>A &amp; B</title><meta name="description"><meta name="description" content="d &lt;e&gt;"><script>var a="<p>x</p>";</script></head>
<body><!-- c --><h1>One</h1><h6>Six <b>x</b></h6><a href="/p?a=1&amp;b=2">Go <i>on</i></a><a href="">no</a><li>a</li><li>b</li></body></html>"""
    h = F.col("h")
    got = one(spark, "h string", [(html,)], T.html_title(h), T.html_description(h), T.html_headings(h), T.html_anchors(h), T.html_text(h))[0]
    assert got[:3] == ("A & B", "d <e>", ["One", "Six x"])
    assert [(a.href, a.text) for a in got[3]] == [("/p?a=1&b=2", "Go on")]
    assert "ab" in got[4] and "var" not in got[4] and " c " not in got[4]
    assert one(spark, "h string", [("foo<b>bar the dog's strngth aeiouyaeiouyaeiouy",)], T.strict_words(h))[0][0] == ["foobar"]


def test_titles(spark):
    t = F.col("t")
    rows = [("COVID-19 (SARS-CoV-2): A [Review], 2020",), ("Étude of the <i>virus</i>",), ("Short. The longest part, tail",), (None,), ("[a (b] c) d(e)f",)]
    got = one(spark, "t string", rows, T.normalise_title(t), T.clean_title(t))
    assert [g[0] for g in got[:2]] == ["covid a", "tude of the virus"]
    assert got[2][1] == "The longest part" and got[3] == ("", "") and got[4][0] == "c d f"


def test_urls(spark):
    clean = {"http://a.com/x?page=2&ref=x#top": "http://a.com/x?page=2", "http://a.com/x?b=&a=1&a=2&_ga=3": "http://a.com/x?a=1&a=2", "http://a.com/x?q=a%20b&utm_source=z": "http://a.com/x?q=a+b"}
    got = one(spark, "a string", [(u,) for u in clean], urls.cleaned(F.col("a")))
    assert [r[0] for r in got] == list(clean.values())
    resolve = {("http://a.com/fr/825?page=2", "/The"): "http://a.com/The", ("http://a.com/d/e", "../f"): "http://a.com/f", ("http://a.com/d", "//b.org/z"): "http://b.org/z", ("http://a.com/d", "#frag"): "http://a.com/d"}
    got = one(spark, "a string, b string", [*resolve, ("http://a.com", "http://[bad"), (None, "/x"), ("http://a.com", None)], urls.resolved(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [*resolve.values(), None, None, None]


def test_addresses_against_the_standard_library(spark):
    def clean(url):
        parts = urlsplit(url)
        pairs = [(k, v) for k, v in parse_qsl(parts.query) if k[:1] != "_" and k not in urls.TRACKING_KEYS]
        first = {k: n for n, (k, _) in reversed(list(enumerate(pairs)))}
        return parts._replace(query=urlencode(sorted(pairs, key=lambda p: first[p[0]])), fragment="").geturl()

    rnd = random.Random(8)
    step = lambda: rnd.choice(["a", "b.c", "..", ".", "", "d%20e", "f~g", "...", "h;i=1"])
    pair = lambda: rnd.choice(["a=1", "b=x%2Fy", "a=2", "ref=z", "_g=1", "q=a b", "q=%zz", "e=", "f", "=v", "c=*~", "\u00e9=\u00fc", "a=b=c", "k=1+2", "utm_source=q", "%61=3"])
    query = lambda: "?" + "&".join(pair() for _ in range(rnd.randrange(0, 5))) if rnd.random() < 0.6 else ""
    way = lambda: "/".join(step() for _ in range(rnd.randrange(1, 6)))
    end = lambda: query() + rnd.choice(["", "", "#", "#f?x=1", "#/a"])
    base = lambda: rnd.choice(["http://a.com", "https://b.org:80", "HTTP://A.com", " http://u@c.d"]) + rnd.choice(["", "/", "/" + way()]) + end()
    href = lambda: rnd.choice([lambda: way() + end(), lambda: "/" + way() + end(), lambda: "//x.y/" + way() + end(), base, lambda: end(), lambda: rnd.choice(["mailto:a@b.c", "javascript:f()", "data:text/plain,x", ""])])()
    rows = [(base(), href()) for _ in range(1500)]
    got = one(spark, "a string, b string", rows, urls.cleaned(F.col("a")), urls.resolved(F.col("a"), F.col("b")))
    for (a, b), r in zip(rows, got):
        assert r[0] == clean(a), a
        assert r[1] == clean(urljoin(a, b)), (a, b)
    rows = [(1, "http://a.com/d", '<a href="#x">self</a><a href="http://[bad">bad</a><a href="/e">e</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [tuple(r) for r in links.page_links(pages).collect()] == [("http://a.com/d", "http://a.com/e", "e")]
    assert [r.href for r in links.link_errors(pages).collect()] == ["http://[bad"]


# (positions, counters) -> score
HTML_CASES = [([837], (0, 0, 0, 1, 0, 0, 0, 4031), 4), ([487, 500], (0, 0, 0, 6, 0, 0, 1, 2690), 18), ([], (0, 0, 0, 0, 0, 1, 1, 100), 15), ([0, 3], (2, 1, 3, 30, 4, 1, 1, 200), 64)]
PAPER_CASES = [([5943], (0, 7, 3, 10, 7902), 26), ([1283], (0, 55, 1, 56, 7732), 44), ([3], (9, 40, 10, 59, 3000), 80)]


def test_scores(spark):
    c = F.col
    rows = [(p, *h) for p, h, _ in HTML_CASES]
    schema = "p array<int>, t int, m int, h int, n int, a int, d int, u int, l int"
    score = scoring.html_score(c("t"), c("m"), c("h"), c("n"), c("d"), c("u"), c("l"), c("p"), F.lit(0), F.lit(0))
    assert [r[0] for r in one(spark, schema, rows, score)] == [s for *_, s in HTML_CASES]
    rows = [(p, *h) for p, h, _ in PAPER_CASES]
    score = scoring.paper_score(c("g1"), c("g2"), c("g3"), c("n"), c("l"), c("p"), F.lit(0))
    assert [r[0] for r in one(spark, "p array<int>, g1 int, g2 int, g3 int, n int, l int", rows, score)] == [s for *_, s in PAPER_CASES]


def test_nearness(spark):
    rnd = random.Random(3)
    rows = [([sorted(rnd.sample(range(60), rnd.randint(1, 6))) for _ in range(rnd.randint(1, 4))],) for _ in range(150)] + [([[], [1]],), ([[5]],)]
    flat = F.flatten("l")
    got = one(spark, "l array<array<int>>", rows, scoring.close_matches(flat), scoring.cluster_range(flat), scoring.closest_cluster(F.col("l")))
    for (lists,), (close, width, cluster) in zip(rows, got):
        p = sorted(x for own in lists for x in own)
        assert close == sum(b - a <= 2 for a, b in zip(p, p[1:])) and width == p[-1] - p[0]
        if not all(lists):
            assert cluster is None
            continue
        best = min((max(min((y for y in own if y >= v), default=math.inf) for own in lists) - v, v) for v in p)
        assert (cluster.width, cluster.begin) == best


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 2)], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node int")
    got = {r.node: round(r["rank"], 6) for r in graph.pagerank(edges, nodes).collect()}
    assert got == {0: 0.359062, 1: 0.188746, 2: 0.379903, 3: 0.036145, 4: 0.036145}
    assert [r.node for r in graph.ranked(graph.pagerank(edges, nodes, fixed_iter=1, reverse=True)).collect()]


def test_deciles(spark):
    def loop(n):
        out = [0] * n
        for i in range(10):
            for k in range(int(i * 0.1 * (n - 1)), int((i + 1) * 0.1 * (n - 1)) + 1):
                out[k] = 10 - i
        return out

    for n in (1, 2, 9, 25, 101):
        rows = spark.createDataFrame([(k, float(-k)) for k in range(n)], "key int, rank double")
        got = [r.score for r in graph.decile_scores(rows).orderBy("key").collect()]
        assert got == loop(n), n


@given(st.lists(st.integers(1, 60), max_size=30))
@settings(max_examples=15, deadline=None)
def test_barrels(spark, sizes):
    rows = [(f"w{k:03d}", s) for k, s in enumerate(sizes)]
    got = [(r.barrel_id, r.offset) for r in index.barrels(spark.createDataFrame(rows, "word string, size long"), 50).orderBy("word").collect()]
    barrel = at = used = 0
    want = []
    for s in sizes:
        if used + s >= 50:
            barrel, at, used = barrel + 1, 0, 0
        want.append((barrel, at))
        at, used = at + 1, used + s
    assert got == want


def test_postings_keep_and_drop(spark):
    pages = spark.createDataFrame([(1, "http://www.b1000.com/x", "<p>1,000 words</p>"), (2, None, "")], "page_id long, url string, html string")
    got = {(r.doc_id, r.word): r for r in index.html_postings(pages).collect()}
    assert got["H1", "b1000"].n_total == 0 and got["H1", "b1000"].positions == [] and got["H1", "b1000"].in_domain == 1  # words of the address stay
    assert got["H1", "1,000"].n_total == 1 and not any(d == "H2" for d, _ in got)
    papers_ = spark.createDataFrame([("P1", "A title", "a body a")], "doc_id string, title string, body string")
    got = {r.word: r for r in index.paper_postings(papers_).collect()}
    assert (got["a"].positions, got["a"].g1, got["a"].g2, got["a"].doc_len) == ([0, 2, 4], 1, 2, 5)
    many = spark.createDataFrame([("P1", "", "x " * 40)], "doc_id string, title string, body string")
    assert index.paper_postings(many).first().positions == list(range(15))


def test_lexicon_rules(spark):
    rows = [("common", 50, 1), ("spread", 5, 2), ("short", 3, 1), ("longerword", 4, 1), ("x" * 21, 99, 9), ("9/11", 10, 2), ("1,000", 5, 2), ("www.x", 99, 9), ("a(b", 99, 9), ("1/2", 50, 1)]
    s = spark.createDataFrame(rows, "word string, freq long, n_domains long")
    assert {r.word for r in lexicon.plain_words(s).collect()} == {"common", "spread", "short"}
    assert {r.word for r in lexicon.remaining_words(s).collect()} == {"9/11", "1000"}
    ids = lexicon.with_ids(lexicon.html_lexicon(s)).orderBy("word_id").collect()
    assert [r.word_id for r in ids] == [0, 1, 2, 3, 4] and [r.word for r in ids] == sorted(r.word for r in ids)


def test_search_ignores_unknown_words(spark):
    p = spark.createDataFrame([("P1", "alpha beta", "gamma alpha"), ("P2", "alpha", "x beta y"), ("P3", "beta", "")], "doc_id string, title string, body string")
    postings = search.all_postings(None, index.paper_postings(p))
    docs = p.select("doc_id", F.lit("").alias("url"), "title")
    q = spark.createDataFrame([(1, "alpha nosuch beta"), (2, "nosuch")], "qid int, query string")
    got = search.multi_word(q, postings, docs).collect()
    assert {(r.qid, r.doc_id) for r in got} == {(1, "P1"), (1, "P2")}
    assert [r.combined_score for r in got] == sorted((r.combined_score for r in got), reverse=True)
    assert [r.doc_id for r in search.top(search.single_word(q, postings, docs).where("qid = 1"), 1).collect()] == ["P2"]  # the lesser density


def test_compact_papers(spark):
    rows = [("p", {"title": "Long title here, short"}, [("an abstract", None), (" ", None)], [("t1", "Intro"), ("", "Skip"), ("t2", "Intro"), ("t3", ""), ("t4", "End")], {"b0": ("T", {"DOI": ["x"]})})]
    schema = "paper_id string, metadata struct<title:string>, abstract array<struct<text:string,section:string>>, body_text array<struct<text:string,section:string>>, bib_entries map<string,struct<title:string,other_ids:map<string,array<string>>>>"
    got = papers.compact(spark.createDataFrame(rows, schema)).first()
    assert got.title == "Long title here"
    assert got.body_text == ["%Abstract%", "an abstract", "%Intro%", "t1", "t2", "t3", "%End%", "t4"]
    assert got.bib_entries["b0"].other_ids == {"DOI": ["x"]}


def test_timing_of_one_run(spark):
    got = stats.timing_stats(spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "k string, v double"), "k", "v").orderBy("k").collect()
    assert (got[0].deviation, got[1].median) == (0.0, 3.0)
