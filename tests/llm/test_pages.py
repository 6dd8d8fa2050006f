"""Page parsing, template slots and extraction on small sites."""

import pytest
from pyspark.sql import functions as F

from spendlens.llm import pages
from tests.llm.common import CLASH, prose

SITE = (
    '<!DOCTYPE html><html><head><title>t{i}</title><script>var a="</p><article>";</script><style>p{{x:1}}</style></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
    '<div id="wrap"><div class="story"><h2>Head {i}</h2><p>{body}</p><div class="ad-slot">Buy {i}</div><p>More &amp; more {i}</div>'
    '<div class="reader-comments"><p>First! {i}</p></div></div><form><p>Sign up</p></form><footer>&copy; {i}</footer></body></html>'
)


def build(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in CLASH + ["slot", "n_chars", "text"]})


def test_slot_of_a_site_without_article_elements(spark):
    bodies = [prose(i, 50) for i in range(12)]
    rows = [(i, f"http://a.example/{i}", SITE.format(i=i, body=b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r for r in pages.extract(build(spark, rows)).collect()}
    for i, b in enumerate(bodies):
        assert got[i].text == f"Head {i}\n{b}\nMore & more {i}"
        assert got[i].n_chars == len(got[i].text)
        assert got[i].slot == "/html/body/div/div.story"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a  b\n c</p><p>d", "a b c\nd"), ("a<b>b</b>c<br>d", "abc\nd"),
        ("<article><p><b>one<br><p>two</p></article><footer>x", "one\ntwo"), ("<article>&lt;p&gt; &#x41;&nbsp;&eacute;</article>", "<p> A é"),
        ("<nav>n<article><p>kept</p></article>", "kept"), ("<main><aside>no</aside><p>yes</p></main>", "yes"), ("<p>cut off <a hre", "cut off"),
        ("<article><h1>T</h1><section class='comments'>c</section>end</article>", "T\nend"), ("<script>x<p>y</p></script>z", "z"),
        ("<article><header><h1>T</h1><p>by</p></header><p>x</p></article>", "T\nx"), ("<article>a<!-- b -->c<!-- open", "ac"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div hidden>h</div><p title='a>b'>v</p>", "v"), ("<p>x < y and z</p>", "x < y and z"),
    ],
)
def test_page_text(html, text):
    assert pages.Page(html or "").main_text(None) == text


def test_headline_and_lead_beside_the_body_stay(spark):
    inside = '<h1>Head {i}</h1><p class="lead">Lead {i}</p><div class="entry-content">{body}</div>'
    one = "<h1>Head {i}</h1><p>{body}</p>"
    rows, want = [], {}
    for site, (tag, form) in enumerate([("article", inside), ("main", inside), ("article", one)]):
        for i in range(site * 10, site * 10 + 5):
            body = prose(i, 80)
            lines = form.format(i=i, body=body if form is one else f"<p>{body}</p><p>more {i}</p>")
            rows.append((i, f"http://s{site}.example/{i}", f"<html><body><nav>menu</nav><div><{tag}>{lines}</{tag}></div><footer>f</footer></body></html>"))
            want[i] = f"Head {i}\n{body}" if form is one else f"Head {i}\nLead {i}\n{body}\nmore {i}"
    assert {r.page_id: r.text for r in pages.extract(build(spark, rows)).collect()} == want


def test_repeated_articles_stay_and_rows_stay(spark):
    same = SITE.format(i=0, body=prose(1, 40))
    rows = [(i, "http://a.example/x", same) for i in range(8)] + [(8, None, None), (9, None, ""), (9, None, ""), (10, "bad", "<p>" + "x " * 50_000)]
    got = pages.extract(build(spark, rows)).collect()
    assert len(got) == 12
    for r in got:
        if r.page_id < 8:
            assert r.text == f"Head 0\n{prose(1, 40)}\nMore & more 0"
    assert {r.text for r in got if r.page_id in (8, 9)} == {""}
    assert next(r for r in got if r.page_id == 10).n_chars == 99_999


def test_tokens_of_one_vector_share_a_class(spark):
    rows = [(i, "http://a.example/x", SITE.format(i=i, body=prose(i, 20))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("a.example"))
    found = {r.path: r["class"] for r in pages.classes(pages.tokens(df)).collect() if r.path}
    assert found["/html/body/nav"] == found["/html/body/footer"] != found["/html/body/div/div.story/p"]


def test_empty_table(spark):
    assert pages.extract(build(spark, [(1, "u", "h")]).where("false")).collect() == []


def texts_of(spark, htmls, host="h.example"):
    rows = [(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in pages.extract(build(spark, rows)).orderBy("page_id").collect()]


def test_headline_beside_the_body_without_article_elements(spark):
    form = '<body><nav>menu</nav><div class="title"><h1>Head {i}</h1></div><p class="lead">Lead {i}</p><div class="text"><p>{body}</p><p>{more}</p></div><div class="box">Seen {i} times</div></body>'
    pieces = [(prose(i, 60), prose(100 + i, 60)) for i in range(5)]
    got = texts_of(spark, [form.format(i=i, body=b, more=m) for i, (b, m) in enumerate(pieces)])
    assert got == [f"Head {i}\nLead {i}\n{b}\n{m}" for i, (b, m) in enumerate(pieces)]


@pytest.mark.parametrize("opening", ['div class="ad-astra"', 'div id="comment-policy-essay"', 'section class="related-work"'])
def test_names_inside_an_article_mark_furniture_only_as_a_whole(spark, opening):
    bodies = [prose(i, 60) for i in range(5)]
    form = "<body><article><h1>T {i}</h1><{o}><p>{b}</p></{t}><div class='ad-slot'>Buy</div><div class='reader-comments'>c {i}</div></article></body>"
    got = texts_of(spark, [form.format(i=i, b=b, o=opening, t=opening.split()[0]) for i, b in enumerate(bodies)])
    assert got == [f"T {i}\n{b}" for i, b in enumerate(bodies)]


def test_template_text_inside_articles_goes_and_chance_repeats_stay(spark):
    bodies = [prose(i, 60) for i in range(6)]
    form = '<body><article><h1>T {i}</h1><p>{b}</p><div class="daily"><p>Sign up to our <b>daily letter</b> today</p></div>{x}</article></body>'
    shared = [f"<p>{prose(50, 60)}</p>" if i < 4 else "" for i in range(6)]
    got = texts_of(spark, [form.format(i=i, b=b, x=shared[i]) for i, b in enumerate(bodies)])
    assert got == [f"T {i}\n{b}" + (f"\n{prose(50, 60)}" if i < 4 else "") for i, b in enumerate(bodies)]
    # an article that every page of a host repeats stays whole
    same = f"<body><article><h1>One</h1><p>{bodies[0]}</p></article><div>seen {{i}} times</div></body>"
    assert texts_of(spark, [same.format(i=i) for i in range(6)]) == [f"One\n{bodies[0]}"] * 6


def plain_template(htmls):
    """Slots and template lines of one host from whole occurrence vectors in dictionaries."""
    held = [pages.Page(h) for h in htmls]
    vectors = {}
    for k, page in enumerate(held):
        for path, n in page.paths.items():
            vectors.setdefault(("element", path), [0] * len(held))[k] = n
        for line in page.lines():
            vectors.setdefault(("line", line), [0] * len(held))[k] += 1
    often = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= pages.SUPPORT * len(held) and sum(map(bool, v)) > 1}
    frame = {path for kind, path in often if kind == "element"}
    frame = {p for p in frame if all("/".join(p.split("/")[:k]) in frame for k in range(2, p.count("/") + 1))}
    shared = {often["element", p] for p in frame}
    return {line for (kind, line), v in often.items() if kind == "line" and v in shared and line[0] in frame and sum(map(bool, v)) >= pages.MIN_TEXT_PAGES}


def test_template_text_against_whole_vectors(spark):
    import random

    draw, htmls = random.Random(5), []
    notes = [f"<p>note {k} of the house</p>" for k in range(4)]
    for i in range(14):
        inside = [f"<p>{prose(1000 * i + k, draw.randint(20, 40))}</p>" for k in range(draw.randint(1, 4))]
        inside += [n for k, n in enumerate(notes) if draw.random() < (1, 0.9, 0.7, 0.3)[k]] + ['<div class="daily">Write to us</div>'] * (i % 7 != 0)
        draw.shuffle(inside)
        htmls.append(f"<body><article><h1>Title {i}</h1>{''.join(inside)}</article><div>tail</div></body>")
    fixed = plain_template(htmls)
    assert any(text == "Write to us" for _, text in fixed) and any(text.startswith("note 0") for _, text in fixed)
    want = ["\n".join(t for p, t in page.lines() if "/article" in p and (p, t) not in fixed) for page in map(pages.Page, htmls)]
    assert texts_of(spark, htmls) == want
