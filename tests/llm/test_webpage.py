"""HTML extraction: tags by HTML's rules, names that don't decide alone, and labelled pages."""

import collections

import pytest

from tarnweave.llm import webpage

TEXT = " ".join(f"word{k}" for k in range(60))
MORE = " ".join(f"more{k}" for k in range(40))


@pytest.mark.parametrize(("page", "text"), [
    ("<body class='no-sidebar has-banner'><article><p>Hello</p></article></body>", "Hello"),
    ("<body class='page search'><article><p>Hello</p></article></body>", "Hello"),
    ("<article><p title=it's>Hello world</p><p>it's fine</p></article>", "Hello world it's fine"),
    ("<article><p title='a>b' data-x=\"c>d\">Hello</p><p a = 'x'b=\"y\"/>there</article>", "Hello there"),
    (f"<article><p>{TEXT}</p><section class='search-results'><p>{MORE}</p></section></article>", f"{TEXT} {MORE}"),
    (f"<article><p>{TEXT}</p><ul class=links><li><a href=x>one</a><li><a href=y>two</a></ul></article>", TEXT),
    (f"<article><p>{TEXT}</p><div class='userComment'>{MORE}</div><div class=cookieBar>{MORE}</div></article>", TEXT),
    (f"<article><p>{TEXT}</p><script/>var x = 1; if (a < b) f();</script><p>end</p></article>", f"{TEXT} end"),
    (f"<article><svg/><p>{TEXT}</p><svg><g><text>no</text></g></svg>end</article>", f"{TEXT} end"),
    (f"<div id=page class='widget-page'><p>{TEXT}</p><p>{MORE}</p></div>", f"{TEXT} {MORE}"),
    (f"<div class='sidebarLayout'><div class=nav><a href=x>home</a></div><p>{TEXT}</p></div>", TEXT),
    (f"<article><p>{TEXT}</p><select><option>red<option>blue</select><textarea>your <b>mail</b></textarea></article>", TEXT),
    (f"<article><!--><p>{TEXT}</p><!-- > a -- b --!><![CDATA[x]]></article>", TEXT),
    (f"<article><p>{TEXT} &amp; &#8217; &eacute; &nosuch; AT&T", f"{TEXT} & ’ é &nosuch; AT&T"),
    ("<article><p>a<b>b</b>c &nbsp;d</p></article>", "abc d"),
    ("<p", ""), ("<article><p>x<a href='", "x"), ("<article>1 < 2 <> 3 </ article>", "1 < 2 <> 3"),
])
def test_probes(page, text):
    assert webpage.main_text(page) == text


#: Pages without an article element, with the blocks that are main text.
PAGES = [
    (f"<div><a href=1>Home</a> <a href=2>News</a></div><div>Search the site</div><h2>Of mice</h2><p>{TEXT}</p><p>{MORE} <a href=x>there</a></p><p>Short words between long ones stay here too.</p><p>{MORE}</p><div><a href=a>Terms</a> <a href=b>About</a></div>",
     f"Of mice {TEXT} {MORE} there Short words between long ones stay here too. {MORE}"),
    (f"<table><tr><td><a href=1>one</a><td><a href=2>two</a></table><p>{TEXT}</p><p>{TEXT}</p><hr><p><a href=x>{MORE}</a></p>", f"{TEXT} {TEXT}"),
    (f"<div class=header><h1>Site</h1><a href=x>in</a></div><div class=content><h1>The long title</h1><p>{TEXT}</p><blockquote>{MORE}</blockquote></div><div class=comments><p>{MORE}</p></div><div id=footer>all rights</div>",
     f"The long title {TEXT} {MORE}"),
    (f"<main><h1>T</h1><p>{TEXT}</p><div class=related><a href=1>a b c</a><a href=2>d e</a></div><p>{MORE}</p></main><aside><p>{TEXT}</p></aside>", f"T {TEXT} {MORE}"),
    (f"<header><p>{MORE}</p></header><p>{TEXT}</p><p>{TEXT}</p><form><p>{MORE}</p></form><div style='display:none'>{MORE}</div><p hidden>{MORE}</p>", f"{TEXT} {TEXT}"),
]


def test_labelled_pages():
    hit = found = wanted = 0
    for page, text in PAGES:
        got, want = (collections.Counter(x.split()) for x in (webpage.main_text(page), text))
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    assert hit / found >= 0.97 and hit / wanted >= 0.97


def uses(node):
    return set() if isinstance(node, bool) else {node[0]} | uses(node[2]) | uses(node[3])


def test_the_tree_asks_words_links_and_neighbours():
    asked = {webpage.FEATURES[f] for f in uses(webpage.tree())}
    assert {"words", "links", "beside", "article"} <= asked and asked & {"links_before", "links_after"}


def test_frames(spark):
    long = f"<article>{f'<p>{TEXT}</p>' * 20_000}</article>"
    rows = [(0, None, "u", "clash"), (1, "", "u", "clash"), (2, long, "u", "clash"), (3, "<article>x y</article>", "u", None), (3, "<article>x y</article>", "u", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, TEXT string")
    got = webpage.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(0, ""), (1, ""), (2, " ".join([TEXT] * 20_000)), (3, "x y"), (3, "x y")]
    assert webpage.extract(df.limit(0)).count() == 0
