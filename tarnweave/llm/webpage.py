"""HTML extraction: flat text blocks, classified by a decision tree.

The page is cut at block-level tags into flat blocks of text. A block has few features: its words and link density,
those of the blocks before and after it, and what its place says (inside an article, inside something beside the text,
a heading). A small decision tree, trained here on `LABELLED`, keeps or drops it. Kept blocks are joined in page order.

Tags are cut as HTML says: quotes count only where an attribute's value begins, a slash closes nothing but drawings and
formulas, scripts and the like are raw up to their own end. Words in class, id and role are one feature among several:
some (navigation, advert, comment) say strongly that something is beside the text, others (search, share, related)
weakly, so that words and links, of the block and its neighbours, decide. Names on html, body, main and article, and
states such as has-sidebar or ad-free, don't count, nor does a name on what wraps the text, or all text of an article. Pages whose
blocks are all short, outside articles, have a tree of their own, grown on `SHORT`: there a block isn't dropped for being short.

Cases: null or empty html, and pages without a kept block, give an empty text; unclosed or truncated tags end with
the page; comments, scripts, styles and templates are no text; repeated rows are extracted each; an input column named
like an output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw up to their own end tag, and no text.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
#: Nothing inside these is text either. The second ones may close themselves.
SILENT = frozenset("template object canvas select svg math audio video".split())
FOREIGN = frozenset(("svg", "math"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ARTICLE = frozenset(("article", "main"))
#: Elements that are beside the text whatever they hold.
BESIDE = frozenset("nav footer aside button dialog menu".split())
#: Names on elements that hold the text itself don't count.
HOLDERS = frozenset(("html", "body", "main", "article"))
#: Words in class, id or role that say strongly, or weakly, that something is beside the text.
STRONG = frozenset(
    "kommentare kommentar commentaires commentaire comentarios comentario commenti commento discussion responses "
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disqus footer gdpr menu "
    "modal nav navbar navigation newsletter pager pagination paywall popup promo sidebar sponsor sponsored subscribe subscription toolbar".split()
)
WEAK = frozenset("alert banner complementary header links masthead notice notification promoted recommended related replies reply respond search share sharing social tags teaser teasers widget".split())
#: A class that says what a page has or lacks, as no-sidebar, names nothing.
STATES = frozenset(("has", "no", "with", "without", "is", "hide"))
#: Nor does one whose word says what kind of page this is, or that it has none of it.
KINDS = frozenset(("layout", "page", "theme", "free", "enabled", "disabled"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_MARK = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+", re.S)
_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for x in RAW}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Hand-labelled blocks: words, links' share of them, words before, links' share before, words after, links' share
#: after, inside an article, beside the text (1 by a weak name, 2 by a strong one, 3 by its element), heading; and whether
#: the block is main text.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "beside", "heading")
LABELLED = (
    (6, 1.0, 0, 0.0, 8, 0.0, 0, 3, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0, 2, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 3, 0, 0), (14, 0.0, 1, 1.0, 10, 0.0, 0, 2, 0, 0),
    (60, 0.0, 40, 0.0, 30, 0.0, 0, 2, 0, 0), (45, 0.1, 90, 0.0, 20, 0.0, 1, 3, 0, 0), (20, 0.0, 200, 0.0, 3, 0.0, 1, 2, 0, 0), (3, 0.0, 20, 0.0, 40, 0.0, 1, 2, 1, 0), (12, 0.0, 300, 0.0, 0, 0.0, 0, 3, 0, 0),
    (4, 0.0, 35, 0.0, 0, 0.0, 0, 2, 0, 0), (2, 1.0, 120, 0.0, 2, 1.0, 1, 2, 0, 0), (90, 0.0, 8, 0.0, 110, 0.0, 1, 0, 0, 1), (110, 0.0, 90, 0.0, 12, 0.0, 1, 0, 0, 1), (2, 0.0, 9, 0.0, 4, 0.0, 1, 0, 0, 1),
    (9, 0.0, 14, 0.0, 90, 0.0, 1, 0, 1, 1), (5, 0.0, 1, 1.0, 2, 0.0, 1, 0, 1, 1), (1, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1), (40, 0.2, 60, 0.0, 70, 0.0, 1, 0, 0, 1), (25, 0.3, 10, 0.0, 8, 0.0, 1, 0, 0, 1),
    (3, 0.0, 120, 0.0, 6, 0.0, 1, 0, 1, 1), (7, 0.0, 110, 0.0, 12, 0.0, 1, 0, 0, 1), (6, 0.4, 80, 0.0, 50, 0.0, 1, 0, 0, 1), (30, 0.6, 70, 0.0, 40, 0.0, 1, 0, 0, 1), (1, 1.0, 30, 0.0, 45, 0.0, 1, 0, 0, 1),
    (3, 1.0, 60, 0.1, 80, 0.0, 1, 0, 0, 1), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 1), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (5, 0.8, 40, 0.0, 4, 1.0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 0), (3, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0), (9, 0.1, 50, 0.0, 3, 1.0, 0, 0, 0, 0),
    (7, 0.6, 6, 0.5, 9, 0.7, 0, 0, 0, 0), (25, 0.7, 8, 0.9, 12, 0.8, 0, 0, 0, 0), (40, 0.9, 5, 0.0, 60, 0.0, 0, 0, 0, 0), (30, 0.5, 70, 0.0, 5, 1.0, 0, 0, 0, 0), (80, 0.0, 6, 0.0, 95, 0.0, 0, 0, 0, 1),
    (120, 0.05, 80, 0.0, 40, 0.0, 0, 0, 0, 1), (35, 0.1, 120, 0.0, 5, 0.0, 0, 0, 0, 1), (22, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1), (18, 0.2, 45, 0.0, 50, 0.1, 0, 0, 0, 1), (10, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0, 1),
    (70, 0.0, 80, 0.0, 90, 0.0, 0, 3, 0, 0), (100, 0.0, 60, 0.0, 120, 0.0, 1, 2, 0, 0), (15, 0.0, 90, 0.0, 80, 0.0, 1, 2, 0, 0), (8, 0.5, 90, 0.0, 110, 0.0, 1, 3, 0, 0), (2, 0.0, 50, 0.0, 60, 0.0, 0, 2, 1, 0),
    (130, 0.1, 9, 0.0, 45, 0.0, 0, 2, 0, 0), (1, 1.0, 1, 1.0, 85, 0.0, 0, 3, 0, 0), (40, 0.0, 1, 1.0, 75, 0.0, 0, 2, 0, 0), (55, 0.0, 55, 0.0, 55, 0.0, 1, 2, 0, 0), (4, 0.0, 0, 0.0, 90, 0.0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 95, 0.0, 0, 0, 0, 0), (7, 0.9, 60, 0.0, 70, 0.0, 0, 0, 0, 0), (50, 0.8, 90, 0.0, 85, 0.0, 0, 0, 0, 0), (90, 0.7, 40, 0.0, 60, 0.0, 0, 0, 0, 0), (3, 1.0, 80, 0.0, 100, 0.0, 0, 0, 0, 0),
    (150, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 1), (60, 0.0, 60, 0.0, 10, 0.0, 0, 0, 0, 1), (45, 0.0, 45, 0.0, 45, 0.0, 0, 0, 0, 1), (1, 0.0, 2, 0.0, 1, 0.0, 1, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1),
    (20, 1.0, 30, 0.5, 4, 0.0, 1, 0, 0, 1), (6, 0.0, 4, 1.0, 80, 0.0, 0, 0, 1, 1), (4, 0.0, 60, 0.0, 75, 0.0, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 1, 0),
    (14, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (12, 0.0, 8, 0.9, 6, 0.8, 0, 0, 0, 0), (9, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (11, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (16, 0.0, 5, 1.0, 4, 0.9, 0, 0, 0, 0), (13, 0.1, 3, 0.8, 6, 1.0, 0, 0, 0, 0), (15, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (10, 0.2, 7, 0.9, 2, 1.0, 0, 0, 0, 0),
    (14, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (12, 0.0, 9, 0.0, 11, 0.1, 0, 0, 0, 1), (9, 0.0, 12, 0.0, 14, 0.0, 0, 0, 0, 1), (11, 0.1, 30, 0.1, 12, 0.0, 0, 0, 0, 1),
    (16, 0.0, 20, 0.0, 25, 0.0, 0, 0, 0, 1), (13, 0.0, 50, 0.1, 60, 0.0, 0, 0, 0, 1), (15, 0.1, 18, 0.0, 22, 0.0, 0, 0, 0, 1), (10, 0.0, 25, 0.0, 90, 0.1, 0, 0, 0, 1),
    (30, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (26, 0.1, 2, 1.0, 40, 0.0, 0, 0, 0, 1), (28, 0.0, 35, 0.0, 3, 1.0, 0, 0, 0, 1), (24, 0.6, 3, 1.0, 4, 1.0, 0, 0, 0, 0),
    (60, 0.0, 20, 0.0, 30, 0.0, 1, 1, 0, 1), (25, 0.1, 40, 0.0, 50, 0.0, 1, 1, 0, 1), (90, 0.0, 5, 0.0, 5, 0.0, 1, 1, 0, 1), (35, 0.0, 60, 0.1, 1, 1.0, 1, 1, 0, 1),
    (2, 1.0, 60, 0.0, 2, 1.0, 1, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0, 0), (3, 0.0, 50, 0.0, 2, 1.0, 1, 1, 0, 0), (6, 0.8, 2, 1.0, 7, 0.9, 1, 1, 0, 0),
    (5, 1.0, 6, 1.0, 40, 0.0, 1, 1, 0, 0), (22, 0.9, 18, 0.8, 20, 0.9, 1, 1, 0, 0), (4, 0.0, 80, 0.0, 0, 0.0, 1, 1, 0, 0), (3, 1.0, 30, 0.0, 3, 1.0, 1, 1, 0, 0),
    (6, 0.0, 0, 0.0, 50, 0.0, 1, 1, 1, 1), (9, 0.0, 2, 0.0, 80, 0.1, 1, 1, 1, 1), (40, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 0), (12, 0.0, 3, 1.0, 50, 0.0, 0, 1, 0, 0),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0, 0), (20, 0.3, 30, 0.0, 5, 1.0, 0, 1, 0, 0), (5, 0.0, 0, 0.0, 6, 0.7, 0, 1, 1, 0), (70, 0.0, 90, 0.0, 4, 0.0, 0, 1, 0, 0),
    (80, 0.0, 60, 0.0, 90, 0.0, 1, 2, 0, 0), (6, 0.0, 100, 0.0, 40, 0.0, 1, 2, 1, 0), (20, 0.3, 0, 0.0, 15, 0.2, 1, 3, 0, 0), (8, 0.0, 3, 0.0, 70, 0.0, 0, 3, 1, 0),
    (2, 0.0, 0, 0.0, 2, 0.0, 1, 0, 0, 1), (60, 0.0, 0, 0.0, 1, 0.0, 1, 0, 0, 1), (1, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (60, 0.0, 0, 0.0, 63, 0.0, 1, 0, 0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (30, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 1), (45, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (5, 0.0, 2, 1.0, 60, 0.0, 1, 0, 0, 1),
    (80, 0.0, 90, 0.0, 3, 1.0, 1, 0, 0, 1), (15, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0, 1), (8, 0.0, 60, 0.0, 4, 1.0, 1, 0, 0, 1), (3, 0.0, 80, 0.0, 1, 1.0, 1, 0, 0, 1),
    (100, 0.1, 1, 1.0, 1, 1.0, 1, 0, 0, 1), (20, 0.0, 0, 0.0, 3, 0.9, 1, 0, 0, 1), (6, 0.0, 8, 0.7, 5, 0.8, 1, 0, 0, 1), (9, 0.0, 15, 0.0, 0, 0.0, 1, 0, 0, 1),
    (50, 0.3, 40, 0.2, 0, 0.0, 1, 0, 0, 1), (7, 0.3, 30, 0.0, 0, 0.0, 1, 0, 0, 1), (4, 1.0, 6, 0.0, 5, 1.0, 1, 0, 0, 1), (11, 0.0, 2, 1.0, 4, 1.0, 1, 0, 1, 1),
    (70, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (60, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (60, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (90, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1), (55, 0.1, 4, 1.0, 0, 0.0, 0, 0, 0, 1), (35, 0.0, 50, 0.0, 4, 0.8, 0, 0, 0, 1), (110, 0.2, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (25, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1), (20, 0.1, 35, 0.0, 45, 0.0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 25, 0.0, 0, 0, 0, 1), (45, 0.2, 50, 0.3, 0, 0.0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (3, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.5, 0, 0.0, 5, 1.0, 0, 0, 0, 0), (8, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0), (1, 0.0, 1, 1.0, 90, 0.0, 0, 0, 0, 0), (35, 1.0, 30, 1.0, 40, 1.0, 0, 0, 0, 0),
    (60, 0.0, 30, 0.0, 0, 0.0, 1, 2, 0, 0), (50, 0.0, 0, 0.0, 50, 0.0, 0, 2, 0, 0), (90, 0.0, 40, 0.0, 0, 0.0, 1, 3, 0, 0), (5, 0.0, 0, 0.0, 0, 0.0, 0, 3, 0, 0),
    (75, 0.1, 80, 0.0, 60, 0.0, 1, 2, 0, 0), (30, 0.0, 30, 0.0, 35, 0.0, 0, 2, 0, 0), (120, 0.0, 100, 0.0, 80, 0.0, 0, 3, 0, 0), (40, 0.2, 60, 0.0, 0, 0.0, 1, 3, 0, 0),
)
#: A page is short if no block of so many words, mostly without links, is free (not beside the text) and none is in an article.
LONG_BLOCK = 25
#: Hand-labelled blocks of short pages: a note, a poem, questions and answers, a list, a card.
SHORT = (
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 6, 0.0, 0, 0, 0, 1), (6, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 1),
    (4, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 1), (3, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 1), (8, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 1), (12, 0.0, 2, 0.0, 9, 0.0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1), (7, 0.2, 5, 0.0, 0, 0.0, 0, 0, 0, 1), (9, 0.1, 0, 0.0, 1, 1.0, 0, 0, 0, 1),
    (14, 0.0, 6, 0.0, 11, 0.0, 0, 0, 0, 1), (2, 0.0, 14, 0.0, 12, 0.0, 0, 0, 0, 1), (4, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1), (15, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0), (3, 1.0, 8, 0.0, 0, 0.0, 0, 0, 0, 0), (4, 0.8, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (5, 1.0, 6, 0.0, 3, 1.0, 0, 0, 0, 0), (6, 0.7, 3, 1.0, 9, 0.0, 0, 0, 0, 0), (4, 0.0, 6, 0.0, 0, 0.0, 0, 3, 0, 0), (9, 0.0, 3, 0.0, 5, 0.0, 0, 2, 0, 0),
    (2, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0, 0), (3, 0.0, 4, 0.0, 3, 0.0, 0, 0, 1, 1), (4, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1), (3, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0, 1),
    (20, 0.0, 4, 0.0, 18, 0.0, 0, 0, 0, 1), (24, 0.3, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), (10, 0.9, 4, 0.0, 5, 0.0, 0, 0, 0, 0),
    (6, 0.0, 0, 0.0, 5, 0.0, 0, 3, 1, 0),
)


class Block:
    """around: the articles and named elements that hold the block, each with the strength of its name."""

    __slots__ = ("article", "around", "beside", "heading", "linked", "text", "words")

    def __init__(self, text: str, linked: int, article: bool, beside: bool, heading: bool, around: tuple[tuple[str, int, int], ...]):
        self.text, self.linked, self.article, self.heading, self.around = text, linked, article, heading, around
        self.beside = ELEMENT if beside else 0
        self.words = text.count(" ") + 1


#: How sure it is that what an element holds is beside the text.
BY_WEAK, BY_STRONG, ELEMENT = 1, 2, 3


def strength(value: str) -> int:
    """Of the words of a class, id or role."""
    out = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for k, w in enumerate(words):
            if w in STRONG or w in WEAK:
                if k and words[k - 1] in STATES or k + 1 < len(words) and words[k + 1] in KINDS:
                    continue
                out = max(out, BY_STRONG if w in STRONG else BY_WEAK)
    return out


def named_beside(tag: str, attributes: str, article: bool) -> int:
    """How sure it is that an element is beside the text. A header is, but inside an article, where it has the article's title."""
    if tag in BESIDE or tag == "header" and not article:
        return ELEMENT
    out = BY_STRONG if tag == "form" else 0
    if "=" in attributes or "hidden" in attributes.lower():
        for name, a, b, c in _NAMED.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return ELEMENT
            if name in ("class", "id", "role") and tag not in HOLDERS:
                out = max(out, strength(value))
    return out


def settle(found: list[Block]) -> None:
    """Tells each block how sure it is that it lies beside the text. Names of wrappers don't count: if every article lies in
    named elements, those around the one with most words are wrappers; without an article outside, so are a form and a
    weakly named element around over half of the page's words; and where no text at all is outside, any name's element
    around over half of them."""
    words: dict[tuple[tuple[str, int, int], ...], int] = {}
    held: dict[tuple[str, int, int], int] = {}
    free = bare = False
    for b in found:
        if b.beside:
            continue
        names = [x for x in b.around if x[0] not in ARTICLE]
        bare |= not names
        for x in names:
            held[x] = held.get(x, 0) + b.words
        for k, x in enumerate(b.around):
            if x[0] in ARTICLE:
                words[b.around[: k + 1]] = words.get(b.around[: k + 1], 0) + b.words
                free |= all(y[0] in ARTICLE for y in b.around[:k])
    wrappers: set[tuple[str, int, int]] = set()
    if not free:
        if words:
            wrappers.update(max(words, key=words.__getitem__))
        total = sum(b.words for b in found)
        wrappers.update(x for x, n in held.items() if 2 * n > total and (x[0] == "form" or x[2] == BY_WEAK or not bare and not words))
    # an article all of whose text lies in named elements has it in the one with most words
    inside: dict[tuple[str, int, int], dict[tuple[str, int, int] | None, int]] = {}
    for b in found:
        for k, a in enumerate(() if b.beside else b.around):
            if a[0] in ARTICLE:
                own = inside.setdefault(a, {})
                name = next((x for x in b.around[k + 1 :] if x[0] not in ARTICLE and x not in wrappers), None)
                own[name] = own.get(name, 0) + b.words
    wrappers.update(max(own, key=own.__getitem__) for own in inside.values() if None not in own)
    for b in found:
        b.beside = max([b.beside, *(x[2] for x in b.around if x[0] not in ARTICLE and x not in wrappers)])


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    around: list[tuple[str, int, int]] = []
    article = beside = link = silent = 0
    heading = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, len(" ".join(linked).split()), article > 0, beside > 0, heading, tuple(around)))
            parts.clear()
            linked.clear()

    def close(upto: int) -> None:
        nonlocal article, beside, link, silent
        while len(stack) > upto:
            tag, own = stack.pop()
            article -= tag in ARTICLE
            beside -= own == ELEMENT
            silent -= tag in SILENT
            if tag in ARTICLE or own in (BY_WEAK, BY_STRONG):
                around.pop()
            link -= tag == "a"

    at = 0
    while True:
        mark = _MARK.search(page, at)
        if not silent:
            text = page[at : mark.start() if mark else len(page)]
            if text:
                text = unescape(text) if "&" in text else text
                parts.append(text)
                if link:
                    linked.append(text)
        if not mark:
            break
        at = mark.end()
        tag = mark[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(mark[1])
        if tag in RAW:
            if not closing:
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in ("head", "img") or tag in FOREIGN and not closing and mark[3].endswith("/"):
            continue
        if tag not in INLINE:
            flush()
            heading = tag in HEADINGS and not closing
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
        elif tag not in VOID:
            if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = "p" if tag in _CLOSES_P else tag
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == same:
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            own = named_beside(tag, mark[3], article > 0)
            stack.append((tag, own))
            article += tag in ARTICLE
            beside += own == ELEMENT
            silent += tag in SILENT
            if tag in ARTICLE or own in (BY_WEAK, BY_STRONG):
                around.append((tag, mark.start(), own))
            link += tag == "a"
    flush()
    settle(out)
    return out


def rows_of(found: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block."""
    own = [(b.words, min(1.0, b.linked / b.words)) for b in found]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(*own[i], *around[i], *around[i + 2], int(b.article), b.beside, int(b.heading)) for i, b in enumerate(found)]


def is_short(found: list[Block]) -> bool:
    return not any(not b.beside and (b.article or b.words >= LONG_BLOCK and 2 * b.linked < b.words) for b in found)


def grow(table: tuple[tuple[float, ...], ...], depth: int = 8) -> tuple | bool:
    """A decision tree by Gini impurity: (feature, cut, tree up to the cut, tree above it), or the answer. Among equal
    splits, the first feature and least cut win."""
    good = sum(r[-1] for r in table)
    if good in (0, len(table)) or not depth:
        return 2 * good > len(table)
    best = None
    for f in range(len(table[0]) - 1):
        seen = sorted({r[f] for r in table})
        for cut in ((a + b) / 2 for a, b in zip(seen, seen[1:])):
            sides = [r[-1] for r in table if r[f] <= cut], [r[-1] for r in table if r[f] > cut]
            impurity = sum(2 * sum(s) * (1 - sum(s) / len(s)) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return 2 * good > len(table)
    _, f, cut = best
    return f, cut, grow(tuple(r for r in table if r[f] <= cut), depth - 1), grow(tuple(r for r in table if r[f] > cut), depth - 1)


@lru_cache(2)
def tree(short: bool = False) -> tuple | bool:
    return grow(SHORT if short else LABELLED)


def keeps(node: tuple | bool, row: tuple[float, ...]) -> bool:
    while not isinstance(node, bool):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    node = tree(is_short(found))
    return " ".join(b.text for b, row in zip(found, rows_of(found)) if keeps(node, row))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df without the html, with the column `text`: the main text of each page. Narrow: no shuffle."""
    kept = [f for f in df.schema if f.name.lower() not in (text.lower(), html.lower())]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([main_text(x.as_py()) for x in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), got], [*names, text])

    return df.select(*[f"`{n}`" for n in [*names, html]]).mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))
