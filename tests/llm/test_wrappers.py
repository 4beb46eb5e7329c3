"""Wrappers with names that elsewhere mark something beside the text."""

import pytest

from tarnweave.llm import webpage

TEXT = " ".join(f"word{k}" for k in range(60))


@pytest.mark.parametrize(("page", "text"), [
    (f"<body class='has-sidebar'><article><p>{TEXT}</p></article></body>", TEXT),
    (f"<body class=sidebar><article><p>{TEXT}</p></article><div class=sidebar>more</div></body>", TEXT),
    (f"<div id=page class='no-sidebar'><article><p>{TEXT}</p></article><div class='sidebar'>more</div></div>", TEXT),
    (f"<main class='search-results'><p>{TEXT}</p></main>", TEXT),
    (f"<div class='share-page'><div class=menu>x</div><article><p>{TEXT}</p><div class=ad>buy</div></article></div>", TEXT),
    (f"<form id=aspnet><nav>home</nav><article><p>{TEXT}</p></article></form>", TEXT),
    (f"<form id=aspnet><p>{TEXT}</p><p>{TEXT}</p></form>", f"{TEXT} {TEXT}"),
    (f"<article><p>short text</p></article><div id=comments><article><p>{TEXT}</p></article></div>", "short text"),
    (f"<article><p>short text</p></article><form><p>{TEXT}</p></form>", "short text"),
    (f"<aside><article><p>{TEXT}</p></article></aside>", ""),
])
def test_wrappers(page, text):
    assert webpage.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<p>Short page.</p>", "Short page."),
    ("a bare text without tags", "a bare text without tags"),
    ("<h1>Title</h1><p>One short sentence.</p><p>Another short sentence.</p>", "Title One short sentence. Another short sentence."),
    ("<p>Roses are red,</p><p>violets are blue,</p><p>sugar is sweet</p><p>and so are you.</p>", "Roses are red, violets are blue, sugar is sweet and so are you."),
    ("<nav><a href=/>Home</a></nav><p>Short page.</p><footer>Imprint</footer>", "Short page."),
    ("<ul><li><a href=/>Home</a><li><a href=/b>News</a></ul><p>A short note for you.</p>", "A short note for you."),
    ("<h2>Where is it?</h2><p>In the north.</p><h2>Who rules it?</h2><p>Nobody does.</p>", "Where is it? In the north. Who rules it? Nobody does."),
    ("<div class=sidebar>Some words here</div><p>Short page.</p>", "Short page."),
    (f"<article><div class='comment-body-text'>{TEXT}</div></article>", TEXT),
    (f"<article><p>The text.</p><div class='comments'>{TEXT}</div></article>", "The text."),
    (f"<div class='ad-free'><article><p>{TEXT}</p></article></div>", TEXT),
    (f"<article><div class='ad-free'><p>{TEXT}</p></div><p>{TEXT}</p></article>", f"{TEXT} {TEXT}"),
    (f"<div class='comments-layout'><article><p>{TEXT}</p></article></div><article><p>short</p></article>", f"{TEXT} short"),
    (f"<article><p>{TEXT}</p></article><ol id='responses'><li>{TEXT}</li></ol>", TEXT),
    (f"<article><p>{TEXT}</p><div class='discussion'><p>{TEXT}</p></div></article>", TEXT),
    (f"<article><p>{TEXT}</p></article><section class='kommentare'><p>{TEXT}</p></section>", TEXT),
])
def test_short_pages_and_names(page, text):
    assert webpage.main_text(page) == text
