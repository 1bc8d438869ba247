"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of text pieces and tags. Words score positive and tags negative, with weights learned from
the labelled pages: those that mark their own main content with one <article>. One linear scan finds the contiguous
region with the highest total, and the region's blocks are the page's text.

Weights are log odds of standing inside the marked content against outside, counted over all labelled pages: words by
the container they stand in, tags by name and class, apart for tags of containers that are never article text. Lists and
tables without a name of their own count as the container around them. A tag's weight is held below zero. A container no
labelled page has shown gets the weight of a word in general. No key is left out: keys are hashed to SLOTS weights, so
the model is bounded however many names the pages have; keys that share a slot share its weight.

Inside the region, containers that are never article text are left out whole: by element, because they are hidden, or
because a whole class, id or role token is a junk name: 'sidebar' or 'leftSidebar', not 'has-sidebar' or
'social-science' (see `junk_names`). The elements html, body, main and article are never judged by name. A form or named
container that holds the page's <main> or <article> is not junk, unless another one stands outside such containers, as
when comments are marked as articles; on a page with neither, a form that holds most of the words is not junk. Of
several articles side by side, one with most of their words is the content and the others are teasers. A junk container
that interrupts a container's text, or stands between two of the same name, costs its tags only, so that text after an
advert is still reached. If nothing is left of a page although it has words outside junk elements, names do not count.

A page is scanned once from left to right, in time linear in its length whatever is broken in it: a tag ends at the next
> outside a quoted value, an unclosed tag, comment or script reaches to the end of the page, as browsers read it.
Defined cases: a null or empty page gives an empty text; without any labelled page the weights are +1 for a word and
TAG_CEILING for a tag; rows with repeated or null ids get one result each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import Columns, map_slices

SLOTS = 1 << 18
TAG_CEILING = -0.05
WEIGHT_LIMIT = 6.0

TAG_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
VALUE_OR_END = re.compile(r"=\s*[\"']|>")
COMMENT_END = re.compile(r"--!?\s*>")
# Elements whose content is not text of the page.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in "script style noscript template textarea select svg iframe object".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A new one of these ends an open one.
UNNESTED = frozenset("p li dt dd tr td th option".split())
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
HIDDEN_FLAG = re.compile(r"(?:^|\s)hidden(?=[\s/=]|\Z)", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*?|'[^']*?|[^\s\"']*?)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements that hold other blocks; the innermost one is what a word is said to stand in.
CONTAINERS = frozenset("html head title body nav div article section main aside footer header form ul ol dl table figure dialog menu details fieldset button".split())
UNNAMED = frozenset("ul ol dl table figure details".split())
PAGE = frozenset(("", "html", "body"))
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
JUNK_ELEMENTS = frozenset("head title nav aside footer header form menu dialog fieldset button".split())
NEVER_NAMED = frozenset("html body main article".split())
COMMENTS = re.compile(
    r"comments?|commentlist|commentform|replies|reply|responses?|respond|discussion|disqus|livefyre|utterances|guestbook|kommentare?|commentaires?|comentarios?", re.I)
JUNK = re.compile(
    rf"{COMMENTS.pattern}|ads?|advert(?:s|isements?|ising|orials?)?|banners?|promo(?:s|ted|tions?)?|sponsor(?:s|ed|ship)?|nav(?:s|bar|igation)?|menu(?:s|bar)?"
    r"|toolbar|topbar|masthead|colophon|dropdown|offcanvas|sidebars?|side|footers?|headers?|cookies?|consent|gdpr|overlays?|modals?|lightbox|paywall|notices?|alerts?|popups?"
    r"|social|share|sharing|related|recommended|recommendations|trending|teasers?|outbrain|taboola|newsletters?|subscri(?:be|bers?|ptions?)|signup|signin|login"
    r"|searchbox|searchform|searchbar|breadcrumbs?|pagination|pager|widgets?|complementary|contentinfo|werbung|anzeigen?|publicit[eé]|publicidad",
    re.I,
)
# What may stand beside a junk name in one token without changing what the container is.
BESIDE = re.compile(
    r"\d*|site|global|main|primary|secondary|top|bottom|left|right|area|bar|box|block|container|wrapper|wrap|inner|outer|list|links?|items?|buttons?|icons?|media"
    r"|posts|articles|stories|section|slot|unit|panel|form|thread|policy",
    re.I,
)
# What may stand beside a name of comments as well.
BESIDE_COMMENTS = re.compile(r"body|content|text|meta|author|count|date|avatar|title|heading|users?|readers?|visitors?|customers?|guests?|open|closed|odd|even|depth|parent|children|child|nested", re.I)
# Two names that stand for comments only together.
READERS = re.compile(r"users?|readers?|visitors?|customers?|guests?", re.I)
OPINIONS = re.compile(r"opinions?|reviews?|feedback|remarks|thoughts|voices|letters|reactions?", re.I)
# Beside these, a header or banner holds the title.
TITLED = re.compile(r"post|article|entry|page|story", re.I)
WORD = "\x00word"
WORD_SLOT = -1


class Piece:
    """A stretch of text with the container it stands in, or a tag."""

    __slots__ = ("article", "breaks", "form", "inside", "interrupts", "junk", "key", "text")

    def __init__(self, key: str, text: str | None, within: Container, breaks: bool):
        self.key, self.text, self.breaks, self.article = key, text, breaks, within.article
        self.junk, self.inside, self.interrupts, self.form = within.junk, within.inside, within.interrupts, within.form


class Container:
    """An open element that holds other blocks or is hidden; `worded` once text other than junk stands in it.

    `layers` are the places of the forms and named containers around and including it that make it junk, None within an
    element that is junk by itself; `form` is the place of the outermost such form, `article` that of the outermost
    article, -1 without one."""

    __slots__ = ("article", "form", "inside", "interrupts", "junk", "label", "layers", "tag", "worded")

    def __init__(self, tag: str, label: str, inside: bool, interrupts: bool, layers: tuple | None, form: int, article: int):
        self.tag, self.label, self.inside, self.interrupts, self.layers, self.form, self.article = tag, label, inside, interrupts, layers, form, article
        self.junk, self.worded = layers != (), False


@lru_cache(maxsize=65536)
def junk_names(names: str) -> bool:
    """Whether a whole token is a junk name, alone or in a compound with other junk names and words of BESIDE only."""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])", name)]
        found = [p.lower() for p in parts if JUNK.fullmatch(p)]
        if any(map(TITLED.fullmatch, parts)):
            found = [p for p in found if not p.startswith(("header", "banner"))]
        opinions = any(map(OPINIONS.fullmatch, parts)) and any(map(READERS.fullmatch, parts))
        if not found and not opinions:
            continue
        of_comments = opinions or any(map(COMMENTS.fullmatch, parts))
        if all(
            JUNK.fullmatch(p) or BESIDE.fullmatch(p) or TITLED.fullmatch(p)
            or (of_comments and BESIDE_COMMENTS.fullmatch(p)) or (opinions and OPINIONS.fullmatch(p)) for p in parts
        ):
            return True
    return False


class Choices:
    """What is known of a page before it is read for good: places of containers that are not junk although they look like
    it, whether names count at all, and the place of the one article that is the content, if there are several."""

    __slots__ = ("article", "by_name", "lifted")

    def __init__(self, lifted: frozenset[int] = frozenset(), by_name: bool = True, article: int = -1):
        self.lifted, self.by_name, self.article = lifted, by_name, article


def opened(tag: str, names: str, around: Container, place: int, hidden: bool, choices: Choices) -> Container:
    first = names.split()[0].lower() if names else ""
    label = around.label if tag in UNNAMED and not first else f"{tag}.{first}" if first else tag
    layers, form, article = around.layers, around.form, around.article
    if tag == "article" and article < 0:
        article = place
    if layers is not None:
        if hidden or (tag in JUNK_ELEMENTS and tag != "form") or (article >= 0 <= choices.article != article):
            layers = None
        elif place not in choices.lifted and choices.by_name and (tag == "form" or (names and tag not in NEVER_NAMED and junk_names(names))):
            # Layers are linked, not copied, so deep nesting costs no more than flat.
            layers = (place, layers, layers[2] + 1 if layers else 1)
            if tag == "form" and not around.junk:
                form = place
    interrupts = around.interrupts or (layers != () and not around.junk and around.worded)
    return Container(tag, label, around.inside or tag == "article", interrupts, layers, form, article)


def named(attributes: str) -> str:
    return " ".join(next(v for v in m.groups()[1:] if v is not None) for m in NAMED.finditer(attributes)).strip() if "=" in attributes else ""


def is_hidden(attributes: str) -> bool:
    lower = attributes.lower()
    return ("hidden" in lower or "none" in lower) and bool(HIDDEN_STYLE.search(attributes) or HIDDEN_FLAG.search(QUOTED.sub("=", attributes)))


def tokens(html: str) -> Iterator[tuple[int, str, str]]:
    """(place, name, rest) of every text and tag in one scan: a text has no name and stands in `rest`, an end tag's name
    begins with a slash. Comments, declarations and the content of RAW_END elements are passed over."""
    at, start, end = 0, 0, len(html)
    while (lt := html.find("<", at)) >= 0:
        name = TAG_NAME.match(html, lt + 1)
        if name is None and html[lt + 1:lt + 2] not in ("!", "?"):
            at = lt + 1
            continue
        if start < lt:
            yield start, "", html[start:lt]
        if name is None:
            if html.startswith("!--", lt + 1):
                close = COMMENT_END.search(html, lt + 2)
                at = close.end() if close else end
            else:
                at = html.find(">", lt) + 1 or end
        else:
            at = name.end()
            while (stop := VALUE_OR_END.search(html, at)) is not None and html[stop.end() - 1] != ">":
                # A quote that never ends is a character like others; there are two kinds, so this looks in vain twice at most.
                at = html.find(html[stop.end() - 1], stop.end()) + 1 or stop.end()
            if stop is None:
                return
            at = stop.end()
            tag, rest = name[0].lower(), html[name.end():at - 1]
            yield lt, tag, rest
            if tag in RAW_END and not rest.endswith("/"):
                close = RAW_END[tag].search(html, at)
                at = (html.find(">", close.end()) + 1 or end) if close else end
        start = at
    if start < end:
        yield start, "", html[start:]


def scanned(html: str, choices: Choices = Choices()) -> tuple[list[Piece], dict[str, list[tuple]]]:
    """The page's text stretches and tags in order, and the layers around each of its mains and articles.

    Containers nest; a stray end tag closes what it can."""
    stack = [Container("", "", False, False, (), -1, -1)]
    open_tags: Counter = Counter()
    read: list[Piece] = []
    marked: dict[str, list[tuple]] = {"main": [], "article": []}
    for place, tag, rest in tokens(html):
        within = stack[-1]
        if not tag:
            if not within.junk and not within.worded and not rest.isspace():
                within.worded = True
                # Text of a block is also text of the container around it, but not of the page.
                if len(stack) > 1 and within.tag not in ("article", "main") and stack[-2].tag not in PAGE:
                    stack[-2].worded = True
            read.append(Piece(within.label, rest, within, False))
        elif tag[0] == "/":
            tag = tag[1:]
            if open_tags[tag]:
                while (closed := stack.pop().tag) != tag:
                    open_tags[closed] -= 1
                open_tags[tag] -= 1
            read.append(Piece(f"/{tag}", None, within, tag not in INLINE))
        else:
            if tag in UNNESTED and within.tag == tag:
                open_tags[tag] -= 1
                stack.pop()
                within = stack[-1]
            hidden = bool(rest) and tag not in VOID and is_hidden(rest)
            if tag in CONTAINERS or hidden or within.tag == tag:
                names = named(rest)
                new = opened(tag, names, within, place, hidden, choices)
                if tag in marked and new.layers is not None:
                    marked[tag].append(new.layers)
                if not rest.endswith("/"):
                    stack.append(new)
                    open_tags[tag] += 1
                read.append(Piece(f"{tag}.{names.split()[0].lower()}" if names else tag, None, new, tag not in INLINE))
            else:
                read.append(Piece(tag, None, within, tag not in INLINE))
                if tag == "br":
                    read.append(Piece(within.label, " ", within, False))
    return read, marked


def wrappers(read: list[Piece], marked: dict[str, list[tuple]]) -> frozenset[int]:
    """Places of the forms and named containers that only wrap the page's content: those around the main or article with
    the fewest of them; without any main and article, a form that holds most of the page's words."""
    found: set[int] = set()
    for around in marked.values():
        least = min((layers[2] if layers else 0 for layers in around), default=0)
        for layers in around:
            if layers and layers[2] == least:
                while layers and layers[0] not in found:
                    found.add(layers[0])
                    layers = layers[1]
    if not any(marked.values()) and any(p.form >= 0 for p in read):
        held: Counter = Counter()
        for piece in read:
            if piece.text is not None and piece.key not in ("head", "title"):
                held[piece.form] += len(piece.text.split())
        found.update(form for form, n in held.items() if form >= 0 and 2 * n > held.total())
    return frozenset(found)


def content_article(read: list[Piece]) -> int:
    """The place of the article that holds most of the words of several articles, -1 if there is none."""
    held: Counter = Counter()
    for piece in read:
        if piece.article >= 0 and piece.text is not None and not piece.junk:
            held[piece.article] += len(piece.text.split())
    if len(held) < 2:
        return -1
    place, most = held.most_common(1)[0]
    return place if 2 * most > held.total() else -1


def pieces(html: str) -> list[Piece]:
    """The page's text stretches and tags in order, read again if containers taken for junk turn out to wrap its content,
    if teasers stand beside an article, or if nothing would be left."""
    read, marked = scanned(html)
    lifted = wrappers(read, marked)
    if lifted:
        read, _ = scanned(html, Choices(lifted))
    if len(marked["article"]) > 1 and (chosen := content_article(read)) >= 0:
        read, _ = scanned(html, Choices(lifted, article=chosen))
    if not any(p.text is not None and not p.junk and p.text.strip() for p in read):
        read, _ = scanned(html, Choices(by_name=False))
    return read


def tag_key(piece: Piece) -> str:
    return f"<{piece.key}> in junk" if piece.junk else f"<{piece.key}>"


def counted(html: str) -> Counter:
    """How often each key occurs inside and outside the marked content of a labelled page; empty for other pages."""
    if len(re.findall(r"<article\b", html, re.I)) != 1:
        return Counter()
    found: Counter = Counter()
    for piece in pieces(html):
        main = piece.inside and not piece.junk
        if piece.text is None:
            found[(tag_key(piece), main)] += 1
        elif n := len(piece.text.split()):
            found[(piece.key, main)] += n
            found[(WORD, main)] += n
    return found


@lru_cache(maxsize=65536)
def slot(key: str) -> int:
    """Where a key's weight lies; words and tags have a half of the slots each."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(key.encode("utf-8", "surrogatepass")) % (SLOTS // 2) + (SLOTS // 2 if key.startswith("<") else 0)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[int, float]:
    """Weights by slot from all labelled pages. Counts are combined before the shuffle; the driver gets a row for each of
    the slots that occur, SLOTS at most."""

    def start():
        def work(rows: Columns) -> Columns:
            total: Counter = Counter()
            for html in rows["html"]:
                for (key, main), n in counted(html).items():
                    total[(WORD_SLOT if key == WORD else slot(key), main)] += n
            keys = sorted({key for key, _ in total})
            return {"slot": keys, "inside": [total[(k, True)] for k in keys], "outside": [total[(k, False)] for k in keys]}

        return work

    source = pages.select(F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sums = map_slices(source, start, "slot long,inside long,outside long", "html").groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    weights = {WORD_SLOT: 1.0}
    for row in sums.collect():
        odds = max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, math.log((row.inside + 0.5) / (row.outside + 0.5))))
        weights[row.slot] = min(TAG_CEILING, odds) if row.slot >= SLOTS // 2 else odds
    if weights[WORD_SLOT] <= 0:
        weights[WORD_SLOT] = 1.0
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest positive sum, the first of equal ones; (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, where = total, (start, i + 1)
    return where


def between_alike(read: list[Piece]) -> list[bool]:
    """For every piece whether it is junk and text of equally named containers stands before and after it."""
    worded = [p.key if p.text is not None and not p.junk and not p.text.isspace() else None for p in read]
    following: list[str | None] = [None] * len(read)
    key = None
    for i in range(len(read) - 1, -1, -1):
        following[i] = key
        key = worded[i] or key
    found, key = [], None
    for piece, own, after in zip(read, worded, following):
        found.append(piece.junk and key is not None and key == after)
        key = own or key
    return found


def main_text(html: str, weights: dict[int, float]) -> str:
    read = pieces(html)
    general, scores = weights[WORD_SLOT], []
    for piece, alike in zip(read, between_alike(read)):
        interrupts = piece.interrupts or alike
        if piece.text is None:
            scores.append(TAG_CEILING if interrupts else weights.get(slot(tag_key(piece)), TAG_CEILING))
        elif n := len(piece.text.split()):
            weight = weights.get(slot(piece.key), general)
            scores.append(0.0 if interrupts else n * (-abs(weight) if piece.junk else weight))
        else:
            scores.append(0.0)
    lo, hi = best_region(scores)
    blocks, block = [], []
    for piece in read[lo:hi]:
        if piece.text is None:
            if piece.breaks:
                blocks.append("".join(block))
                block = []
        elif not piece.junk:
            block.append(unescape(piece.text))
    blocks.append("".join(block))
    return "\n".join(clean for b in blocks if (clean := " ".join(b.split())))


def extract_pages(pages_df: DataFrame, weights: dict[int, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def start():
        def work(rows: Columns) -> Columns:
            found = [main_text(html, weights) for html in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": found, "n_chars": [len(t) for t in found]}

        return work

    source = pages_df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    return map_slices(source, start, "page_id long,url string,text string,n_chars long", "html")
