import random

from courtlake.llm import html_text, url_filter
from courtlake.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string, host string, path string, rule string, verdict string, k string, u string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None, "y", "z", None, "u") for i, u, h in rows], SCHEMA).repartition(2)


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_urls_equal_plain_matching(spark):
    draw = random.Random(1)
    rules = URL_RULES + [("b.org", "/", "block"), ("org", "/a/b", "allow"), ("b.org", "/a/", "allow"), ("", "/q", "block"), ("é.com", "/", "block"), ("b.org", "/", "allow")]
    hosts = ["org", "b.org", "a.b.ORG", "ab.org", "example.org", "x.example.org", "com", "m.com", "é.com", "É.com", "", "a..org", "org.", "u:p@b.org:80"]
    paths = ["", "/", "/a", "/a/b/c", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/de/x?y", "?/de/", "#/fr/", "/fr/\n/de/", "/q", "/A/b"]
    urls = [f"{draw.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "org/fr/", "http:/com/de/", "a://b://com/de/"]
    rows = list(enumerate(urls)) + [(None, "http://com/de/"), (0, urls[0])]
    got = url_filter.url_verdicts(pages(spark, [(i, u, None) for i, u in rows]), url_filter.rules_frame(spark, rules))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, *judged(u, rules))) for i, u in rows)


def test_no_rules_and_no_pages(spark):
    nothing = url_filter.rules_frame(spark, [])
    rows = pages(spark, [(1, "http://a.org/", None)])
    assert tuple(url_filter.url_verdicts(rows, nothing, default="block").first()) == (1, "a.org", "/", None, "block")
    assert url_filter.url_verdicts(rows.limit(0), url_filter.rules_frame(spark, URL_RULES)).collect() == []


BODY = "Prose about the matter at hand, in whole sentences, of some length."
BESIDE = (
    '<header class="top"><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies and a long text about them.</div>'
    '<div id="sidebar-2"><p>Popular things, with many many words about nothing in particular at all.</p></div><aside>More</aside><form><p>Name</p></form>'
)
AFTER = '<div class="comments"><p>A reader says a lot of things about this article, at great length.</p></div><footer>&copy; Site</footer><script>var a="<p>no</p>";</script>'


def page(n, inner):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{BESIDE}<div class="post-{n}">{inner}</div>{AFTER}</body></html>'


def test_article_without_what_is_beside_it(spark):
    inner = f'<h1>Title &amp; more</h1><p><b>One {BODY}<br><p>Two&nbsp;&#8212; {BODY}</p><div class="ad">Buy <b>now</b></div><ul><li>a<li>b</ul><!-- x --><p>Th<i>re</i>e\n\t{BODY}'
    want = f"Title & more One {BODY} Two — {BODY} a b Three {BODY}"
    short = "<p>Tiny.</p>"
    rows = [(i, "http://a.org/x", page(i, inner)) for i in range(5)] + [(9, "http://a.org/y", page(9, short)), (10, "http://b.org/", f"<p>{BODY}"), (11, None, BODY)]
    rows += [(12, "http://a.org/", None), (13, "x", ""), (None, "http://a.org/", page(3, inner)), (14, "http://c.org/", "<![endif]><p>a<script>"), (15, "http://a.org/", "<article><p>Other frame.</p></article>")]
    df = html_text.main_texts(pages(spark, rows))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in df.collect()}
    assert all(got[i].text == want for i in [*range(5), None])
    # the host's path finds the text of a page on which it is shorter than what is beside it
    assert got[9].text == "Tiny." and got[10].text == got[11].text == BODY and got[12].text == got[13].text == "" and got[14].text == "a"
    assert got[15].text == "Other frame." and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_texts(pages(spark, [])).collect() == []


def test_votes_of_a_host(spark):
    rows = [(i, "http://a.org/", page(i, f"<p>{BODY}</p>" * 3)) for i in range(3)] + [(7, "http://a.org/", "<article><p>Other frame.</p></article>")]
    assert html_text.host_paths(pages(spark, rows)).count() == 1
    assert abs(sum(s for _, s in html_text.page_votes(rows[0][2])) - 1) < 1e-9 and html_text.page_votes("") == []


def test_deep_and_broken_pages():
    assert html_text.page_text("<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"
    assert html_text.page_text("a</p>b</div>c<", None).startswith("a b")
    assert html_text.page_text("<main><table><tr><td>x<td>y<tr><td>z</table></main>", None) == "x y z"
    sections = "".join(f"<section><div><p>{'word ' * n}end</p></div></section>" for n in (90, 20, 5))
    assert html_text.page_text(f"<body><div><article>{sections}</article></div><p>outside</body>", None).count("end") == 3


def test_names_and_forms_around_the_article():
    side = '<div class="sidebar"><p>Popular things.</p></div><div id="comments"><article class="comment"><p>A reader says a lot.</p></article></div>'
    for wrap in ("div class='content-sidebar-wrap'", "div class='has-sidebar'", "div class='no-sidebar'", "div class='elementor-widget-container'", "div class='nav-scrolled page'", "form id='aspnetForm'", "span class='no-sidebar'"):
        end = wrap.split()[0]
        for inner in (f"<article><p>{BODY}</p></article>", f"<div class='post'><p>{BODY} {BODY}</p></div>"):
            html = f"<body><{wrap}><div class='menu-open'>{inner}{side}</div></{end}><footer>Site</footer></body>"
            assert html_text.page_text(html, None) == " ".join([BODY] * inner.count(BODY)), (wrap, inner)
    # an article outside what seems to lie beside it leaves comments out, however they are marked
    assert html_text.page_text(f"<article><p>{BODY}</p></article>{side}", None) == BODY


def test_title_intro_outro_and_second_template(spark):
    parts = f"<h1>Title</h1><div class=intro>Intro. {BODY}</div><div class=body>{''.join(f'<p>{BODY} {i}</p>' for i in range(9))}</div><div class=outro>Outro.</div>"
    want = f"Title Intro. {BODY} {' '.join(f'{BODY} {i}' for i in range(9))} Outro."
    first = f"<html><body><div class=top><a href=/>Home</a></div><div class=post>{parts}</div></body></html>"
    second = f"<html><body><div class=post><div class=body>A few words.</div></div><div class=story><h2>Other</h2><p>{BODY}</p><p>{BODY} {BODY}</p></div></body></html>"
    rows = [(i, "http://a.org/", first) for i in range(30)] + [(i, "http://a.org/", second) for i in range(30, 33)]
    got = {r.page_id: r.text for r in html_text.main_texts(pages(spark, rows)).collect()}
    assert all(got[i] == want for i in range(30))
    assert all("Other" in got[i] and got[i].count(BODY) == 3 for i in range(30, 33))


def test_short_article_above_a_long_footer():
    assert html_text.page_text(f"<article><p>Tiny.</p></article><div class='ad'>{BODY} {BODY}</div><footer>{BODY} {BODY}</footer>", None) == "Tiny."


def test_conditional_comments():
    old = "<!--[if lt IE 9]><script src=x></script><p>Old.</p><![endif]-->"
    for html in (f"{old}<p>{BODY}</p><!-- end --><p>More.</p>", f"<p>{BODY}</p>{old}<p>More.</p>", f"<!--[if !IE]><!--><p>{BODY}</p><!--<![endif]--><p>More.</p>", f"<![if !IE]><p>{BODY}</p><![endif]><!--><p>More.</p><!-- x -->"):
        assert html_text.page_text(f"<body>{html}</body>", None) == f"{BODY} More.", html
    assert html_text.page_text("<p>a<![CDATA[b]]>c<![odd name]>d<script>var a='<![x';</script>e", None) == "acd e"
