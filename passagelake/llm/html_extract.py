"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can:
blocks in page furniture (menus, headers, footers, sidebars, adverts, notices,
forms, comments: by element, role, class or id), blocks outside the articles where
the page marks any, and blocks that are mostly links are out; long blocks with many
stop words are in. Blocks that are short or poor in stop words stay open. The
second pass gives each open block the label of its nearest decided neighbours: if
both sides agree, theirs, else the nearer one's. Before the first decided block and
after the last one there is but one neighbour, whose label a bare word or two in a
``div`` (a menu without links) and a copyright line do not take. Where the page's
language has none of the stop words, length and links alone decide.

What counts as furniture. Attributes are parsed, so a word inside another attribute's
value means nothing. A class (each on its own) or an id names furniture if all of its
words are furniture words or neutral ones ("ad-slot", "main-nav"), never because
one of them is ("related-work", "comments-open"). ``html``, ``body`` and ``main`` are
never furniture, an ``article`` only as a comment or hidden. Inline elements that name
furniture (an advert in a ``span``) are cut out of their block. All top-level articles
of a page are kept, in page order.

Some furniture is known only at the end of the page. A ``form`` outside the articles is
none if it holds an ``article`` or ``main``, or long blocks and half of the page's text:
then it wraps the page. A ``section`` of an article with a name that is as often a topic
("login") is none if half of it are long blocks. The first ``article`` ends open
furniture, as ``main`` does; if that is closed after it, it held the article and is
furniture with it.

Defined cases: null or empty html gives an empty text; unclosed and crossed tags
are closed by the next enclosing end tag; ``main`` ends open furniture; a page without
any decided block keeps its text elements and sentences, or if it has neither all blocks; very long pages are read whole; page_id and
url pass through (nulls too); other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

# The commonest function words of four languages.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it was on are be with as by this from or an at have not but which they his her "
        "der die das und in zu den von mit ist des sich dem nicht ein eine als auf für im auch an werden aus er hat dass sie nach bei "
        "de la le les et des du en un une que est dans qui par pour au sur pas avec ce il sont ne se plus ou "
        "el los las y del al una con por para su lo como más pero sus este ha son entre"
    ).split()
)
# Element, role and class names of page furniture.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button select option datalist noscript template iframe object svg canvas audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentform commentbox respond disqus".split())
FURNITURE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adsbygoogle adsense adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo banner nav navbar navigation navi "
    "topnav subnav sidenav sitenav leftnav menu menubar submenu sidebar footer sitefooter masthead siteheader topbar breadcrumb breadcrumbs cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe signup sharing pager pagination toolbar widget widgets".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right global primary secondary mobile desktop post entry article blog user reader inner outer container wrapper wrap box bar list "
    "item items block area section panel link links button buttons body text thread form slot unit row col column group content title sticky fixed label message".split()
)
#: Names that are as often a topic as furniture: furniture with fewer neutral words, and
#: as an id only of elements that are no text of their own.
WEAK_NAMES = frozenset("notice notices notification alert share social related recommended recommendations promotion discussion reply replies subscription copyright disclaimer login search".split())
#: Weak names that stay furniture whatever a section of that name holds.
NOTICES = frozenset("notice notices notification alert copyright disclaimer".split())
WEAK_NEUTRAL = frozenset("container wrapper wrap box bar list links buttons button block panel area widget post posts entry article articles page site icons form".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 section blockquote article li dd dt td th pre a span".split())
RAW_TAGS = frozenset("script style textarea title xmp".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
#: Parts of lists and tables: text after a text, though they are no sentences.
PART_TAGS = frozenset("li dt td th caption summary".split())
SECTION_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul "
    "button iframe object svg canvas audio video map datalist".split()
)
VOID_TAGS = frozenset("hr br img input meta link area base col embed param source track wbr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
_MAY_NAME = re.compile("|".join(sorted(_READ)), re.I)
_SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_COPYRIGHT = re.compile(r"©|\(c\)\s|copyright\b|all rights reserved", re.I)
_SENTENCE_END = re.compile(r"[.!?:;…。！？।]['\")\]»”’]*$")

#: Blocks of this many characters are long; shares of stop words and of link text.
LONG = 140
STOP_HIGH = 0.25
#: Below this share of stop words over all long blocks the language is another.
STOP_NONE = 0.08
LINK_MOST = 0.5

BAD, OPEN, GOOD = -1, 0, 1
#: Kinds of furniture: none, for sure, to be seen from what it holds.
NO, SURE, SEEN = 0, 1, 2


@lru_cache(1 << 14)
def _named(name: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names furniture for sure, perhaps, or a page header."""
    words = [w for w in _SPLIT_NAME.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
    plain = all(w in FURNITURE_NAMES or w in WEAK_NAMES or w in NEUTRAL or w == "header" for w in words)
    sure = plain and any(w in FURNITURE_NAMES for w in words)
    weak = any(w in WEAK_NAMES for w in words) and all(w in WEAK_NAMES or w in WEAK_NEUTRAL for w in words)
    return sure, weak, plain and "header" in words


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """NO, SURE, or SEEN for a form around a page and a section whose name may be its topic."""
    if tag in FURNITURE_TAGS and (tag != "form" or in_article):
        return SURE
    if tag == "header" and not in_article:
        return SURE
    found = SEEN if tag == "form" else NO
    if tag in ("html", "body", "main") or not attrs or not _MAY_NAME.search(attrs):
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name not in _READ:
            continue
        value = a or b or c
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
            return SURE
        if name == "role" and tag != "article" and FURNITURE_ROLES.intersection(value.lower().split()):
            return SURE
        if name in ("class", "id"):
            for one in value.split() if name == "class" else [value]:
                if tag == "article":
                    if one.lower() in COMMENT_NAMES:
                        return SURE
                    continue
                sure, weak, header = _named(one)
                if not sure and weak and in_article and tag == "section" and NOTICES.isdisjoint(_SPLIT_NAME.split(one.lower())):
                    found = SEEN if name == "class" else found
                elif sure or weak and not (name == "id" and tag in TEXT_TAGS) or header and not in_article and tag not in TEXT_TAGS:
                    return SURE
    return found


class _Block:
    __slots__ = ("text", "links", "furniture", "article", "tag", "group", "label")

    def __init__(self, text, links, furniture, article, tag, group):
        self.text, self.links, self.furniture, self.article, self.tag, self.group, self.label = text, links, furniture, article, tag, group, OPEN

    @property
    def heading(self) -> bool:
        return self.tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    @property
    def prose(self) -> bool:
        return len(self.text) >= LONG and self.links <= LINK_MOST * len(self.text)


class _Group:
    """A form or section that is furniture or not by what it holds; ``up`` is the number
    of the one around it."""

    __slots__ = ("up", "form", "page", "text", "prose")

    def __init__(self, up, form):
        self.up, self.form, self.page, self.text, self.prose = up, form, False, 0, 0


def _settle(blocks: list[_Block], groups: list[_Group]) -> None:
    """Marks the blocks of those groups that are furniture. Number 0 is the page."""
    for b in blocks:
        if not b.furniture:
            groups[b.group].text += len(b.text) - b.links
            groups[b.group].prose += len(b.text) * b.prose
    for g in reversed(groups[1:]):
        groups[g.up].text += g.text
        groups[g.up].prose += g.prose
    text = [True]
    for g in groups[1:]:
        holds = g.page or g.prose > 0 and 2 * g.text >= groups[0].text if g.form else 2 * g.prose >= g.text > 0
        text.append(holds and text[g.up])
    for b in blocks:
        b.furniture = b.furniture or not text[b.group]


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page in order. ``article``: the number of the top article (or
    main) that holds the block, 0 outside; text of an article inside an article (a
    comment) is furniture."""
    out: list[_Block] = []
    # an open block-level element: (tag, furniture, article number, group, number of the
    # first block of the outermost furniture around it, whether it is that)
    stack: list[tuple[str, bool, int, int, int, bool]] = []
    page_top = ("", False, 0, 0, 0, False)
    groups = [_Group(0, False)]
    # first block of furniture that an article ended
    ended: int | None = None
    # open inline furniture: (tag, size of the stack, open elements of that tag)
    mute: list | None = None
    pieces: list[str] = []
    links = in_link = articles = 0
    at, n = 0, len(page)

    def flush():
        nonlocal links, pieces
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                top = stack[-1] if stack else page_top
                out.append(_Block(text, links, top[1], top[2], top[0], top[3]))
        pieces, links = [], 0

    def add(piece):
        nonlocal links
        if mute is None:
            pieces.append(piece)
            if in_link:
                links += len(piece.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in RAW_TAGS:
            if not closing:
                end = _RAW_ENDS[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK_TAGS:
            if mute is not None and tag == mute[0]:
                mute[2] += -1 if closing else 1
                if not mute[2]:
                    mute = None
                    pieces.append(" ")
            elif mute is None and not closing and tag not in VOID_TAGS and _furniture(tag, m[3], bool(stack and stack[-1][2])):
                mute = [tag, len(stack), 1]
                pieces.append(" ")
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            in_link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if ended is not None and stack[i][5] and stack[i][4] == ended:
                        for b in out[ended:]:
                            b.furniture = True
                        ended = None
                    del stack[i:]
                    break
            if mute is not None and len(stack) < mute[1]:
                mute = None
        elif tag not in VOID_TAGS:
            if stack and stack[-1][0] == "p":
                stack.pop()  # a block ends an open paragraph
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            _, inside, article, group, since, _ = stack[-1] if stack else page_top
            kind = SURE if tag == "head" else NO if tag == "main" else _furniture(tag, m[3], bool(article))
            if tag == "article" and kind == NO and not articles and (inside or mute is not None):
                ended, inside, mute = since if inside else None, False, None
            bad = tag != "main" and (inside or mute is not None or kind == SURE)
            if tag in SECTION_TAGS and not bad:
                if article and tag == "article" and any(t[0] == "article" for t in stack):
                    bad = True
                elif not article:
                    articles += 1
                    article = articles
                    groups[group].page = True
                    group = 0
            if kind == SEEN and not bad:
                groups.append(_Group(group, tag == "form"))
                group = len(groups) - 1
            outermost = bad and not inside
            stack.append((tag, bad, article, group, len(out) if outermost else since, outermost))
    flush()
    _settle(out, groups)
    return out


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»") in STOP_WORDS for w in words) / len(words)


def _sentence(text: str) -> bool:
    """Whether a text is more than a word or two of a menu."""
    words = text.lower().split()
    return len(words) > 3 or len(words) > 1 and (_SENTENCE_END.search(text) is not None or not STOP_WORDS.isdisjoint(words))


def classify(blocks: list[_Block]) -> list[_Block]:
    """Both passes; sets ``label`` of every block to GOOD or BAD."""
    inside = sum(len(b.text) for b in blocks if b.article and not b.furniture)
    outside = sum(len(b.text) - b.links for b in blocks if not b.article and not b.furniture)
    marked = inside > 0 and inside >= outside / 2  # else the marked articles are but teasers
    scope = []
    for b in blocks:
        if b.furniture or marked and not b.article:
            b.label = BAD
        else:
            scope.append(b)
    shares = [b.links / max(1, len(b.text)) for b in scope]
    stops = [_stop_share(b.text) if len(b.text) >= LONG and share <= LINK_MOST else 0.0 for b, share in zip(scope, shares)]
    known = [(len(b.text), stop) for b, share, stop in zip(scope, shares, stops) if len(b.text) >= LONG and share <= LINK_MOST]
    foreign = sum(n * s for n, s in known) < STOP_NONE * sum(n for n, _ in known)
    for b, share, stop in zip(scope, shares, stops):
        if share > LINK_MOST:
            # a linked heading or paragraph of an article is text, a list of links is not
            b.label = OPEN if marked and b.tag in PROSE_TAGS else BAD
        elif len(b.text) >= LONG:
            if stop >= STOP_HIGH or foreign and share <= LINK_MOST / 2:
                b.label = GOOD
            elif share > LINK_MOST / 2:
                b.label = BAD
    decided = [i for i, b in enumerate(scope) if b.label != OPEN]
    if not decided and not marked:
        plain = [b for b in scope if b.tag in PROSE_TAGS or _sentence(b.text)]
        for b in scope if plain else ():
            b.label = BAD
        for b in plain or scope:
            b.label = GOOD
    labels = [b.label for b in scope]
    k = 0
    for i, b in enumerate(scope):
        while k < len(decided) and decided[k] <= i:
            k += 1
        if b.label != OPEN:
            continue
        left = decided[k - 1] if k else None
        right = decided[k] if k < len(decided) else None
        if left is None and right is None:
            b.label = GOOD
        elif marked and b.tag in PROSE_TAGS:
            # lists of links in an article say nothing of its paragraphs
            b.label = GOOD
        elif left is None or right is None:
            # one neighbour only: words of a menu and a copyright line do not take its label
            one = labels[right if left is None else left]
            text = b.tag in PROSE_TAGS or left is not None and b.tag in PART_TAGS or _sentence(b.text)
            b.label = GOOD if marked else one if text and not _COPYRIGHT.match(b.text) else BAD
        elif labels[left] == labels[right]:
            b.label = labels[left]
        elif b.heading:
            b.label = labels[right]
        elif i - left != right - i:
            b.label = labels[left] if i - left < right - i else labels[right]
        else:
            b.label = GOOD
    return blocks


def extract_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks_of(page or "")) if b.label == GOOD)


def _extract_batches(batches):
    for batch in batches:
        texts = [extract_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract_batches, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


#: For pages of the test tables: one article element, block tags and four references.
OP10_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM a),
s AS (SELECT page_id, url, trim(regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM s
"""
