"""Main text of pages."""

import random
import time

import pytest

from rootseek.llm import maintext

PAGE = (
    '<!DOCTYPE html><html><head><title>T t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x y z</a></li></ul></nav>'
    '<!-- ad --><div class="ad">buy this now please</div><article><h1>Head {i}</h1><p><b>One &amp; two{i}<br><p>three  four</p></article>'
    '<footer>&copy; all of it</footer></body></html>'
)


@pytest.fixture(scope="module")
def weights(spark):
    return maintext.learn(spark.createDataFrame([(PAGE.format(i=i),) for i in range(30)], "html string"))


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE.format(i=1), "Head 1\nOne & two1\nthree four"),
        (None, ""), ("", ""), ("<p>hi", "hi"), ("   ", ""), ("<script>x y z", ""), ("<nav>a b c</nav>", ""),
        ("<div class='sidebar'>x y z</div><p>Some text &amp; more</p><div id=comments><p>nice post</p></div>", "Some text & more"),
        ('<body><a href="x>y</a> text <b>bold</b>er', "y text bolder"),
        ("<article><p>one two</p><aside>no no no no</aside><p>three four <script>if(a<b){}</script>five</p><form>f f</form></article>", "one two\nthree four five"),
        ("<div class=ad>out</div><main><p>in &#233;&nbsp;x</p></main><p>after the end</p>", "in é x"),
        ("a < b and c > d", "a < b and c > d"),
        ("<div>x</div><div class='cookie-notice'>we use cookies</div><p>y z</p>", "x\ny z"),
        ("<p>a&am b&amp c", "a&am b& c"),
    ],
)
def test_pages(weights, page, text):
    assert maintext.Extractor(weights).text(page) == text


def test_learned_weights(weights):
    assert weights["div.ad"][1] and not weights["p"][1] and weights["p"][0] == maintext.TAG_COST


def test_broken_markup_takes_linear_time():
    start = time.time()
    for page in ("<" * 50_000, "<a " * 50_000, "<p>x</b>" * 20_000, "<div>" * 20_000 + "x", '<a href="' * 10_000, "&" * 100_000):
        maintext.Extractor({}).text(page)
    assert time.time() - start < 20


def test_table(spark):
    rows = [(1, "u", PAGE.format(i=5), 7, "t"), (1, None, None, 8, "t"), (None, "v", "<p>x y</p>", 9, "t"), (2, "w", "<article>" + "<p>a b</p>" * 20_000, 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, id int, text string")
    got = maintext.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 3), (1, "", 0), (1, "u", 28), (2, "w", 20_000 * 4 - 1)]
    assert maintext.extract(df.limit(0)).count() == 0


def wrapped(i, opening="<div class='container' id=page>", closing="</div>"):
    return f"<html><body>{opening}<div class=teaser>buy this {i}</div><section class=wrap><main><p>One two {i}</p></main></section>{closing}</body></html>"


def test_elements_around_an_article_are_no_boilerplate(spark):
    learned = maintext.learn(spark.createDataFrame([(wrapped(i),) for i in range(30)], "html string"))
    assert learned["div.teaser"][1] and not any(learned.get(k, (0, False))[1] for k in ("div.container", "div.page", "section.wrap"))
    own = maintext.Extractor(learned)
    assert own.text(wrapped(7)) == "One two 7"
    assert own.text("<div class=container><div class=teaser>no</div><p>three four</p></div>") == "three four"
    always = maintext.Extractor({"div.container": (0.1, True), "section.wrap": (0.1, True), "div.teaser": (0.1, True)})
    assert always.text(wrapped(8)) == "One two 8"
    for opening, closing in (("<form id=aspnetForm>", "</form>"), ("<div class=header>", "</div>"), ("<div hidden><aside>", "</aside></div>")):
        assert own.text(wrapped(9, opening, closing)) == "One two 9"


def test_articles_in_boilerplate_stay_out_beside_others(weights):
    page = "<main><p>One two</p></main><aside><div><article><p>more to read elsewhere on these pages</p></article></div></aside>"
    assert maintext.Extractor(weights).text(page) == "One two"


@pytest.mark.parametrize(
    "page",
    [
        "<ul class=menu>" + "<li><a>x</a>" * 600 + "</ul><main><p>One two</p></main>",
        "<div class=sidebar>" + "<p>x y" * 600 + "</div><main><p>One two</p></main>",
        "<div class=sidebar>" + "<b><i>x y" * 600 + "</div><main><p>One two</p></main>",
        "<table class=ads>" + "<tr><td>x y<td>z" * 600 + "</table><main><p>One two</p></main>",
        "<main><p>One two" + "<b><span>" * 600 + "</main><p>and much more behind it</p>",
        "<main><p>One two</p></main><div class=related>" + "<dt>a<dd>b" * 600 + "</div>",
        "<p class=promo>buy this<p>One two",
        "<ul><li class=promo>buy<div>this</div><li>One two</ul>",
        "<table><tr><td class=promo>buy this<td>One two</table>",
    ],
)
def test_elements_end_at_any_depth_and_without_closing_tags(page):
    assert maintext.Extractor({}).text(page) == "One two"


def test_inner_lists_and_tables_do_not_end_the_outer_ones():
    own = maintext.Extractor({})
    assert own.text("<ul><li class=promo>no<ul><li>no<li>no</ul>no<li>yes</ul>") == "yes"
    assert own.text("<table><tr><td class=promo>no<table><tr><td>no<td>no</table>no<td>yes</table>") == "yes"
    walk = maintext.Walk(maintext.hinted)
    for tag in ["ul", "li", "p", "li", "select", "option", "option", "/x", "/select", "p", "div"]:
        walk.step("close" if tag[0] == "/" else "open", tag.strip("/"), "")
    assert [name for name, *_ in walk.open] == ["ul", "li", "div"]


def test_deep_markup_takes_linear_time():
    start = time.time()
    for page in ("<div>" * 20_000 + "</x>" * 20_000, "<b>" * 20_000 + "</i></p>" * 20_000 + "</b>" * 20_000, "<p><button>" + "<div>" * 40_000, "<main>" + "<div><article>" * 20_000):
        maintext.Extractor({}).text(page)
    assert time.time() - start < 20


@pytest.mark.parametrize("keys,chars,counted", [(2, 4_000_000, 3), (6, 4_000_000, 100), (50_000, 50_000 * 8, 7)])
def test_rare_keys_count_as_much_as_frequent_ones(spark, monkeypatch, keys, chars, counted):
    sites = [f"s{i}" for i in range(12)]
    rows = [(k, f"u{s}", f"<html><body><div class=site-{s}x>buy {s}</div><x-{s}>very</x-{s}><main><div><p>One two {s}</p></div></main></body></html>") for s in sites for k in range(6)]
    rows += [(7, f"v{s}", f"<div class='site-{s}x'>no no</div><p>three four {s}</p>") for s in sites for _ in range(2)] + [(8, None, None), (None, "w", "<p class=seldom>five</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = maintext.learn(df)
    assert whole.rest is None and all(whole[f"div.site-{s}x"][1] for s in sites)
    want = sorted(map(str, maintext.extract(df, weights=whole).collect()))
    monkeypatch.setattr(maintext, "KEYS", keys)
    monkeypatch.setattr(maintext, "KEY_CHARS", chars)
    monkeypatch.setattr(maintext, "COUNTED", counted)
    part = maintext.learn(df)
    assert len(part) <= keys and part.rest is not None
    got = maintext.extract(df)
    assert sorted(map(str, got.collect())) == want and got.schema == maintext.extract(df, weights=whole).schema
    assert {r.text for r in got.collect() if r.page_id == 7} == {f"three four {s}" for s in sites}


BODY = "One two three four five six"


@pytest.mark.parametrize(
    "page",
    [
        f"<p>{BODY}</p><!-- <article> -->",
        f"<script>var a = '<article>';</script><p>{BODY}</p>",
        f"<!-- <main> --><script>x = \"<main>\"</script><div><p>{BODY}</p></div>",
        f"<main></main><div><p>{BODY}</p></div>",
        f"<article> </article><article><nav>a b</nav></article><p>{BODY}</p>",
        f"<aside><article>read this too</article></aside><p>{BODY}</p>",
        f"<div class=related><article>read this</article></div><p>{BODY}</p>",
        f"<article hidden>x y z</article><p>{BODY}</p>",
        f"<main style='display: none'>x y z</main><p>{BODY}</p>",
        f'<div class="post comments-open">{BODY}</div>',
        f'<div class="has-sidebar layout"><p>{BODY}</p><div class=sidebar>more here</div></div>',
        f'<div class="share-price-article"><p>{BODY}</p></div><p class=share>share it</p>',
        f'<article><div class="related-topics-body">{BODY}</div><div class="related">see that</div></article>',
        f'<form id=aspnetForm><div id=form><p>{BODY}</p></div></form>',
        f'<div style="overflow:hidden" data-id="sidebar"><p>{BODY}</p></div>',
        f"<body style='display:none'><p>{BODY}</p></body>",
        f"<p>{BODY}</p><div id=comments>{'a reader says much more than the article did ' * 9}</div>",
        f"<p>{BODY}</p><div class='comment-list post-comments'>{'much more than the article ' * 9}</div>",
        f"<article>{BODY}<div class=comments>{'much more than the article ' * 9}</div></article>",
        f"<main>{BODY}</main><div class='sidebar-left'>{'much more than the article ' * 9}</div>",
    ],
)
def test_marks_and_names_are_evidence_not_proof(page):
    assert maintext.Extractor({}).text(page) == BODY


def test_learned_keys_decide_where_names_do_not(spark):
    page = "<html><body><div class=zone7>buy this {i} now</div><main><div class=zone8><p>One two {i}</p></div></main></body></html>"
    learned = maintext.Extractor(maintext.learn(spark.createDataFrame([(page.format(i=i),) for i in range(9)], "html string")))
    other = "<div class=zone7>three more words</div><div class=zone8><p>One two three four</p></div>"
    assert learned.text(other) == "One two three four"
    assert maintext.Extractor({}).text(other) == "three more words\nOne two three four"
    assert learned.text("<div class=zone7><p>One two three four</p></div>") == "One two three four"


def test_linear_scan_equals_trying_all_regions():
    rng = random.Random(5)
    for _ in range(300):
        penalties = {n: (rng.choice([0.3, 0.75, 1.5, 4.0]), False) for n in ("p", "b", "div")}
        parts, gains, words = [], [], []
        for i in range(rng.randrange(1, 25)):
            if rng.random() < 0.5:
                n = rng.randrange(1, 5)
                parts.append(" ".join(f"w{i}x{k}" for k in range(n)) + " ")
                gains.append(n)
                words.append(parts[-1].split())
            else:
                name = rng.choice(list(penalties))
                parts.append(f"<{rng.choice(['', '/'])}{name}>")
                gains.append(-penalties[name][0])
                words.append([])
        runs = [(sum(gains[a:b]), a, b) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)]
        best = max(s for s, _, _ in runs)
        got = maintext.Extractor(penalties).text("".join(parts)).split()
        wanted = [[w for part in words[a:b] for w in part] for s, a, b in runs if abs(s - best) < 1e-9]
        assert got in wanted if best > 0 else got == []


def test_very_long_pages_are_read_whole():
    page = "<body><nav>" + "<a>x</a>" * 50_000 + "</nav><div class=has-sidebar>" + "<p>One two</p>" * 60_000 + "</div></body>"
    assert maintext.Extractor({}).text(page) == "\n".join(["One two"] * 60_000)
