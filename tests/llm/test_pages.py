import itertools
import random

import duckdb

from millrace.llm import html_extract, url_filter
from millrace.llm.html_extract import main_text


def test_main_text_of_hostile_pages(spark):
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First  part &lt;b&gt;
    goes<b> on</b>.<p>Second<br>line<ul><li>item</ul><div class="comments"><p>Reader says hello, what a long and great story this was!</p></div><form><p>Your mail</p></form></article>
    <aside>Other</aside><footer>&copy; 2020</footer>"""
    assert main_text(page) == "Head & line\nFirst part <b> goes on.\nSecond line\nitem"
    assert main_text("<article><p>cut off in the mid<b") == "cut off in the mid"
    assert main_text("<article>" + "<p>a" * 3000) == "\n".join(["a"] * 3000)
    assert main_text('<article><p x="' + "y" * 10_000 + "<p>") is not None
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_extract.extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).collect() == []


def test_figures_and_formulas_stay():
    page = "<article><p>A long first paragraph of the article goes here.</p><figure><pre>code of the figure</pre><figcaption>Its caption</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>"
    assert main_text(page) == "A long first paragraph of the article goes here.\ncode of the figure\nIts caption\nSo x=2 holds."


def test_names_of_subjects_in_an_article():
    said = "This whole paragraph belongs to the article and tells of {} at some length."
    first = "A long first paragraph of the article goes here."
    boxes = ['div class="share-price"', 'section class="related-work"', 'div id="search-algorithms"', 'section class="form-and-structure"', 'div class="header-image"', 'div class="comment-on-the-law"']
    inner = "".join(f"<{b}><p>{said.format(i)}</p></{b.split()[0]}>" for i, b in enumerate(boxes))
    assert main_text(f"<body><article><p>{first}</p>{inner}</article></body>") == "\n".join([first, *(said.format(i) for i in range(len(boxes)))])
    around = ['div class="share-buttons"', 'div class="ad-3"', 'div id="newsletter-cta"', 'div class="cookie_notice wide"', 'section class="site-footer"', 'div class="reader-comments"', 'ul class="related-posts"', 'div class="comment-list"']
    noise = "".join(f"<{b}><p>{said.format(i)}</p></{b.split()[0]}>" for i, b in enumerate(around))
    assert main_text(f"<body><article><p>{first}</p>{noise}<p>End.</p></article></body>") == f"{first}\nEnd."
    # a doubtful box without a sentence goes, its sentences stay
    assert main_text(f'<article><p>{first}</p><div class="share-price"><ul><li><a href="/">More</a></li></ul></div></article>') == first


def test_outer_boxes_without_an_article():
    long = "A long paragraph of the story, which goes on and on for the whole line and some more words."
    page = f'<body><div><p>{long}</p><p>{long}</p></div><div class="rightcol"><p>{long}</p></div><div class="site-foot"><p>{long}</p></div></body>'
    assert main_text(page) == f"{long}\n{long}"


def test_minimum_cut_is_minimal():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        scores = [rnd.randrange(-9, 10) for _ in range(n)]
        edges = [(i, j, rnd.randrange(1, 6)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda keep: sum(-s if k and s < 0 else s if not k and s > 0 else 0 for s, k in zip(scores, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: E731, B023
        assert cost(html_extract.minimum_cut(scores, edges)) == min(cost(k) for k in itertools.product((False, True), repeat=n))


def test_url_rules_and_reputation(spark):
    urls = ["https://A.Example.NET/en/x?q", "http://x.net/", "http://x.net", "https://example.com/de/1", "https://wexample.com/de/1", "https://a.org/fr/", "nothing", None, "ftp://h?x/", "https://bad.host.com/p", "https://bad.host.com/q", "//x.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    outcomes = spark.createDataFrame([("bad.host.com", True)] * 60 + [("bad.host.com", None)] + [(f"h{i}.ok.com", False) for i in range(200)], "host string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, outcomes).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict, got[2].rule) == ("net/", "block", None)
    assert got[3].verdict == "block" and got[4].rule is None and got[5].rule == "org/fr/"
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and (got[8].host, got[8].path) == ("h", "")
    assert got[9].verdict == got[10].verdict == "block" and got[4].verdict == "allow"
    none = url_filter.judge(pages, outcomes.limit(0)).collect()
    assert len(none) == len(urls) and {r.verdict for r in none if r.rule is None} == {"allow"}
    assert url_filter.judge(pages.limit(0), outcomes).collect() == []


def test_url_hosts_without_outcomes(spark):
    urls = ["http://new.evil.com/p", "http://new.fine.com/p", "http://new.other.com/p", "http://new.some.bad/p", "http://a.never.seen/p", "http://s1.evil.com/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = [(f"s{i}.evil.com", True) for i in range(20) for _ in range(9)] + [(f"s{i}.fine.com", False) for i in range(60) for _ in range(9)]
    outcomes += [(f"s.d{i}.bad", True) for i in range(20) for _ in range(9)]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(outcomes, "host string, bad boolean")).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_smoothness_decides_doubtful_blocks():
    long = "A long paragraph of the story, which goes on and on for the whole line and some more words. " * 2
    page = f'<body><div><p>{long}</p><p>Yes.</p><p>{long}</p><p class="share-price">The share price fell by a half.</p><p>{long}</p></div><ul class="related-links"><li>Yes.</li></ul></body>'
    kept = [" ".join(long.split()), "Yes.", " ".join(long.split()), "The share price fell by a half.", " ".join(long.split())]
    found = html_extract.blocks(page)
    signs = [html_extract.score(b, False) >= 0 for b in found]
    assert signs == [True, False, True, False, True, False] and main_text(page) == "\n".join(kept)
    article = '<article><p>Some words.</p><p class="share-price">Price.</p><fieldset><legend>Facts</legend><p>One fact.</p></fieldset><div class="share-buttons">Send it</div><p class="ad">Buy</p></article>'
    assert main_text(article) == "Some words.\nPrice.\nFacts\nOne fact."


def test_hostile_pages_in_time():
    import time

    pages = ["<b " * 340_000, "<article>" + "<p>a" * 200_000, "<b \"><b '> x" * 90_000, "<p x=\"'> a <i y='\"> b " * 50_000, "<div>" * 160_000, "<div>x</p>" * 90_000, "< " * 500_000, "<script>" * 120_000, "<!-- " * 200_000, "<div><p>abc</p></div><p>xyz xyz xyz xyz</p>" * 20_000]
    for page in pages:
        began = time.time()
        main_text(page)
        assert time.time() - began < 6, page[:40]  # seconds for a megabyte, on a slow machine


def test_minimum_cut_of_long_chains():
    rnd = random.Random(6)
    for _ in range(40):
        n = rnd.randrange(2, 13)
        scores = [rnd.randrange(-500, 500) for _ in range(n)]
        edges = [(i - 1, i, rnd.choice([30, 60, 300])) for i in range(1, n)] + [(rnd.randrange(n), rnd.randrange(n), 90) for _ in range(n // 2)]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda keep: sum(-s if k and s < 0 else s if not k and s > 0 else 0 for s, k in zip(scores, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: E731, B023
        assert cost(html_extract.minimum_cut(scores, edges)) == min(cost(k) for k in itertools.product((False, True), repeat=n))


def test_articles_of_made_pages(spark):
    rnd = random.Random(17)
    words = lambda n: " ".join(rnd.choice(["rain", "hill", "&amp;", "stone", "river", "bird", "over", "under", "and"]) for _ in range(n))
    rows = []
    for i in range(60):
        own = [words(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 12))]
        inner = "".join(rnd.choice([f"<p>{x}</p>", f"<h2>{x}</h2>", f"<blockquote><p>{x}</p></blockquote>", f"<figure><figcaption>{x}</figcaption></figure>", f"<p>{x}"]) + rnd.choice(["", "", "<div class='advert'>Buy now</div>", "<!-- c -->", "<script>x='<p>'</script>"]) for x in own)
        page = f"<html><head><title>t</title></head><body><header>Site name</header><nav><a href='/'>Home</a></nav><div class='cookie-banner'>We use cookies</div><article>{inner}</article><div id='comments'><p>{words(40)}</p></div><aside>{words(30)}</aside><footer>{words(20)}</footer></body></html>"
        rows.append((i, page, "\n".join(x.replace("&amp;", "&") for x in own)))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(i, "u", p) for i, p, _ in rows], "page_id long, url string, html string")).collect()}
    assert got == {i: t for i, _, t in rows}


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.example.com", "com", "10.0.0.1:80", "a.b.c.de", "shop.example.com.au:8080", "co.com", ""]
    domain, suffix = url_filter._levels(url_filter.F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").orderBy("i").select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("10.0.0.1", ""), ("c.de", "de"), ("example.com.au", "com.au"), ("co.com", "com"), ("", "")]


def test_url_oracle_with_unlabelled_hosts(spark, tmp_path):
    rnd = random.Random(2)
    hosts = [f"h{i}.d{i % 9}.{['com', 'co.uk', 'de', 'bad'][i % 4]}" for i in range(60)]
    pages = [(i, f"https://{rnd.choice(hosts)}/p{i}") for i in range(900)]
    labels = [(i, 1, int(rnd.random() < 0.1 + 0.8 * (i % 5 == 0 or u.split("/")[2].endswith(".bad")))) for i, u in pages if i % 4]
    labels = [(i, q, t) for i, q, t in labels if int(pages[i][1].split("/")[2].split(".")[0][1:]) % 3]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    made = db.sql(url_filter.ORACLE_SQL)
    got = [tuple(r[c] for c in made.columns) for r in url_filter.op10_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, made.fetchall())) and {r[-1] for r in got} == {"allow", "block"}
