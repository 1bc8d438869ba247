"""Operators that judge each text by itself: against brute force, on awkward rows, and on empty tables."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from awkward_rows import AWKWARD, awkward, given, listed, no_docs, plain  # noqa: F401

from sluiceway.llm import licences, pages, personal, pieces, repetition
from sluiceway.llm.queries import tokenizer_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


TRICKY = ["a@b.c@d.e.f", "x@y a@b..c a@b.c. ..@q.r", "1.2.3.4.5.6.7.8 256.1.1.1.9 001.02.3.4", "+1+2 +123456789 +1 (2) 3-", "5 5 5 5 5 5 5 5 5 5 5 5 5", "4539148803436467-4539148803436467", "1" * 200, "+" * 50 + "1" * 12, "@" * 9]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_at_anchors(text):
    found = personal.find(text, personal.automaton())
    assert personal.written(found, personal.BASE_KINDS) == ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text))


def test_random_base_spans():
    r = np.random.default_rng(5)
    anchors = personal.automaton()
    for _ in range(3000):
        text = "".join(r.choice(list("a.@-+ 0129()_%"), r.integers(0, 40)))
        assert personal.written(personal.find(text, anchors), personal.BASE_KINDS) == ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)), text


def test_personal_data(awkward, no_docs, given):
    for docs in (awkward, given("documents")):
        want = Counter((i, sha(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(t)))) for i, t in plain(docs))
        assert Counter((r.doc_id, r.base_sha256) for r in personal.personal_spans(docs).collect()) == want
    assert personal.personal_spans(no_docs).count() == 0
    found = listed(personal.personal_spans(awkward.where("doc_id = 14")))[14]
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 1, 1) and "secret:" in found.spans


def test_redaction_keeps_columns(awkward):
    done = personal.redact(awkward)
    assert done.columns == awkward.columns
    row = listed(done.where("doc_id = 14"))[14]
    assert row.text == 'mail [EMAIL], [IP] and [PHONE] or [CARD]; token = "[SECRET]"' and row.n_chars == len(row.text) and row.spans == "clash"
    assert done.where("text is null").count() == 2


def test_accounts_and_addresses():
    anchors = personal.automaton()
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, see https://u:p@example.org:80/x?y=1. tokens are fine, ssn 123-45-6789"
    found = personal.find(text, anchors)
    assert [text[s:e] for s, e in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678", "123-45-6789"]
    assert [text[s:e] for s, e in found["url"]] == ["https://u:p@example.org:80/x?y=1"] and not found["secret"]


def test_main_text_of_given_pages(given):
    table = given("pages")
    got = listed(pages.extract_pages(table, pages.learn_weights(table)), "page_id")
    for row in table.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)


def test_pages_of_other_shapes(spark, given):
    page = (
        "<html><head><title>T t</title><style>p{}</style></head><body><header>Site head</header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy now good cheap</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text&nbsp;here<br>and more.</p><script>var x='<p>no</p>'</script>"
        "<form>Name <input></form><p>Second &lt;one&gt;.</p><div class='comments'><p>Reader says no</p></div></article><aside>Side bar</aside><footer>&copy; us</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>5 < 6 & plain words only"), (1, "u", page), (4, "u", "<article></article>")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    weights = pages.learn_weights(given("pages"))
    got = [(r.page_id, r.text) for r in pages.extract_pages(table, weights).collect()]
    article = "Head & line\nFirst bold text here and more.\nSecond <one>."
    assert Counter(got) == Counter([(1, article), (2, ""), (3, ""), (None, "5 < 6 & plain words only"), (1, article), (4, "")])
    empty = table.limit(0)
    assert pages.extract_pages(empty, pages.learn_weights(empty)).count() == 0
    assert pages.learn_weights(empty) == {pages.WORD_SLOT: 1.0}


@pytest.mark.parametrize(("page", "text"), [
    ("<body><main><h1>A b</h1><p>One two three.</p><ul><li>c</li><li>d</li></ul></main><footer>f g</footer></body>", "A b\nOne two three.\nc\nd"),
    ("<nav><ul><li>n</li></ul></nav><article><p>One.</p><ol><li>a</li><li>b</li></ol><p>Two.</p></article>", "One.\na\nb\nTwo."),
    ("<article><p>One two.</p><div class=ad>x y z x y z x y z x y z</div><p>End.</p></article><div class=comments>q r s t</div>", "One two.\nEnd."),
    ("<div id=content><div class=part>One two.</div><form>x <input> y</form><p>End.</p></div><div class=sidebar>x</div>", "One two.\nEnd."),
])
def test_lists_and_interruptions(given, page, text):
    assert pages.main_text(page, pages.learn_weights(given("pages"))) == text


ARTICLE = "<article{}><h1>A b</h1><p>One two three.</p></article>"
AROUND = "<nav><a>m n</a></nav>{}<div class=comments><p>q r s t u v w</p></div><footer>f g</footer>"


@pytest.mark.parametrize("page", [
    *(f"<body class='{names}'>" + AROUND.format(ARTICLE.format("")) + "</body>" for names in ("home has-sidebar", "no-sidebar", "sidebar")),
    *("<body>" + AROUND.format(ARTICLE.format(f" class='{names}'")) + "</body>" for names in ("post has-comments", "post related", "with-header")),
    *("<body>" + AROUND.format(f"<{tag} {names}>{ARTICLE.format('')}</{tag}>") + "</body>" for tag, names in (
        ("main", "class=layout-side"), ("main", "class=side"), ("section", "class=social-science"), ("div", "id=navbar-offset"), ("div", "class=navy"),
        ("div", "class=left-sidebar"), ("form", "id=page"), ("form", "class=side"),
    )),
    "<body><form>" + AROUND.format(ARTICLE.format("")) + "</form></body>",
    "<body><form><div class=side>" + AROUND.format(ARTICLE.format("")) + "</div></form></body>",
    "<body><main><div class=sidebar>" + AROUND.format(ARTICLE.format("")) + "</div></main></body>",
    "<body>" + AROUND.replace("<p>q r", "<article>c d</article><p>q r").format(ARTICLE.format("")) + "</body>",
    "<body><form>" + AROUND.replace("<p>q r", "<article>c d</article><p>q r").format(ARTICLE.format("")) + "</form></body>",
    "<body><a>s</a><form>" + AROUND.format("<section class=text><h1>A b</h1><p>One two three.</p></section>") + "</form></body>",
])
def test_wrapped_and_compound_names(given, page):
    weights = pages.learn_weights(given("pages"))
    assert pages.main_text(page, weights).replace("s\n", "") == "A b\nOne two three."
    if page.count("<article") == 1:
        counts = pages.counted(page)
        assert counts[(pages.WORD, True)] == 5


@pytest.mark.parametrize(("names", "junk"), [
    ("sidebar", True), ("x site-header", True), ("comment-list", True), ("widget_area", True), ("ad-728", True), ("related-posts", True), ("social-share", True), ("post-comments", True),
    ("has-sidebar", False), ("no-sidebar", False), ("with-nav", False), ("social-science", False), ("navbar-offset", False), ("layout-side", False),
    ("entry-header", False), ("article-header", False), ("navy", False), ("main-content", False), ("", False), ("-", False),
])
def test_junk_names_are_whole_tokens(names, junk):
    assert pages.junk_names(names) is junk


NEVER_TEXT = (
    "commentlist comment__body commentBody user-comments-list reader-opinions responses reply cookieBanner gdpr-overlay mainNav userComments comment-content comments-area replyForm "
    "respond discussion__thread disqus_thread kommentare commentaires comentarios-list readerReviews guestbook topAds adBox ad_slot_12 advertisement sponsored-posts promoBox shareButtons "
    "social-icons relatedStories recommended newsletterSignup searchform siteHeader page_footer breadcrumb pagination sidebarRight widgetArea cookie-consent modal popup paywall werbung "
    "teaser-list trending-articles login-form subscribe topbar masthead"
).split()


@pytest.mark.parametrize("name", NEVER_TEXT)
def test_containers_that_are_never_text(given, name):
    weights = pages.learn_weights(given("pages")) if not _WEIGHTS else _WEIGHTS[0]
    _WEIGHTS[:] = [weights]
    box = f"<div class='{name}'><p>q r s t u v w x y z</p></div>"
    for page in (f"<body><article><h1>A b</h1><p>One two three.</p>{box}<p>End.</p></article></body>", f"<body>{box}<div id=text><h1>A b</h1><p>One two three.</p>{box}<p>End.</p></div>{box}</body>"):
        assert pages.main_text(page, weights) == "A b\nOne two three.\nEnd."
    # Nothing else on the page: better the text than nothing.
    assert pages.main_text(f"<body><nav>m n</nav><div class='{name}'><p>Only this text here.</p></div></body>", weights) == "Only this text here."


_WEIGHTS: list = []


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>One two.</p><p hidden>no</p><p>End.</p></article>", "One two.\nEnd."),
    ("<article><p>One two.</p><div style='color:red; display: none'><p>no</p></div><p>End.</p></article>", "One two.\nEnd."),
    ("<article><p>One <span style=\"visibility:hidden\">no <span>no</span> no</span>two.</p><button>Click me</button><p>End.</p></article>", "One two.\nEnd."),
    ("<article><p>One two.</p><p hidden>no no<p>End.</p></article>", "One two.\nEnd."),
    ("<article><p>One <img alt='a hidden door' hidden>two.</p><p title='hidden'>End.</p></article>", "One two.\nEnd."),
    ("<div class=story><p>One two three.</p></div><div class=related>" + "x y " * 200 + "</div><div class=story><p>Four five.</p></div>", "One two three.\nFour five."),
    ("<article><p>One two three four five six seven.</p></article><article><p>a b</p></article><article><p>c d</p></article>", "One two three four five six seven."),
    ("<article><p>One two.</p><p>a > b, \"c\" and 'd.</p><p class=it's>End.</p></article>", "One two.\na > b, \"c\" and 'd.\nEnd."),
    ("<article><p>One two.</p><p class='x", "One two."),
    ("<article><p>One <!-- no --> two.</p><script>if (a < b) '</p>'</SCRIPT ><p>End.</p></article><!-- never closed <p>no</p>", "One two.\nEnd."),
])
def test_hidden_broken_and_divided_pages(given, page, text):
    _WEIGHTS[:] = _WEIGHTS or [pages.learn_weights(given("pages"))]
    assert pages.main_text(page, _WEIGHTS[0]) == text


@pytest.mark.parametrize("unit", ["<div ", "<script ", "<script>", "<div>", "</section>", "<a href=\"", "<a b='", "<!--", "<!x", "< ", "<div class=ad>", "<p hidden>x", "<svg ", "<a =  ", "<b>x</b>"])
def test_pages_take_time_in_proportion(unit):
    def seconds(size):
        page = "<div>" * 2000 + (unit * (size // len(unit) + 1))[:size]
        started = time.process_time()
        pages.main_text(page, {pages.WORD_SLOT: 1.0})
        return time.process_time() - started

    assert seconds(800_000) < 20 * max(seconds(100_000), 0.02)


def test_the_scan_covers_the_page():
    r = random.Random(6)
    bits = ["<p>", "</p>", "<div class='a>b'>", "text ", "<", ">", "<b", "'", '"', "=", "<!-- ", "-->", "<!", "<script>", "</script>", "<br/>", "&amp;", "<a x=\"y\" z='<i>'>"]
    for _ in range(3000):
        page = "".join(r.choices(bits, k=r.randint(0, 12)))
        places = [place for place, _, _ in pages.tokens(page)]
        assert places == sorted(set(places)) and all(page[p] == "<" for p, tag, _ in pages.tokens(page) if tag)
        assert all(page.startswith(rest, p) for p, tag, rest in pages.tokens(page) if not tag)


def test_best_region_is_the_best_of_all():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores = r.integers(-5, 6, r.integers(0, 12)).astype(float).tolist()
        lo, hi = pages.best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[lo:hi]) == best


def test_licences(awkward, no_docs, given):
    for docs in (awkward, given("documents")):
        want = Counter()
        for i, t in plain(docs):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            places = [k for phrase in licences.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
            want[(i, len(w), len(places), min(places, default=None), max(places, default=None))] += 1
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in licences.scan_licences(docs).collect()) == want
    assert licences.scan_licences(no_docs).count() == 0


def test_licence_expressions():
    scan = licences.Scanner().scan
    row = scan("x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nAll rights, reserved. CC-BY; cc by")
    assert row["labels"] == "apache-2.0,cc-by,classpath-exception-2.0,gpl-2.0-only,mit,reserved" and row["base_labels"] == "cc-by,reserved"
    assert row["n_base"] == 3 and row["duty"] == 1 and 0 < row["score"] < 1
    assert scan("SPDX-License-Identifier: MIT OR")["duty"] is None and "mit" in scan("SPDX-License-Identifier: MIT OR")["labels"]
    assert licences.evaluate("MIT AND GPL-3.0 OR Apache-2.0".split()) == 1
    for broken in ("( MIT", "MIT )", "", "MIT AND"):
        with pytest.raises(ValueError):
            licences.postfix(broken.split())


@pytest.mark.parametrize("text, labels, duty", [
    ("SPDX-License-Identifier: MIT.", "mit", 1), ("SPDX-License-Identifier: MIT or later is fine", "mit", 1),
    ("A License-Identifier: tag names the licence", "", None), ("spdx-License-identifier: apache-2.0", "apache-2.0", 1),
    ("// SPDX-License-Identifier: (MIT OR\n//   GPL-2.0-or-later)", "gpl-2.0-or-later,mit", 1),
    ("# SPDX-License-Identifier: EPL-2.0 OR\n# GPL-2.0+ WITH Classpath-exception-2.0", "classpath-exception-2.0,epl-2.0,gpl-2.0+", 2),
    ("SPDX-License-Identifier: MIT\nOR not", "mit", 1), ("SPDX-License-Identifier: (MIT OR Nothing-4.2)", "mit", None),
    ("SPDX-License-Identifier: LicenseRef-Own-1. Then", "licenseref-own-1", 5),
    ("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b AND ISC", "documentref-a:licenseref-b,isc", 5),
    ("SPDX-License-Identifier: NOASSERTION", "", None), ("SPDX-License-Identifier:GPL-9.9", "", None), ("İSPDX-License-Identifier: Zlib", "zlib", 1),
    ("SPDX-License-Identifier: MIT AND (whatever", "mit", 1), ("SPDX-License-Identifier: GPL-2.0-only WITH MIT", "gpl-2.0-only", 3),
])
def test_licence_tags(text, labels, duty):
    row = licences.Scanner().scan(text)
    assert (row["labels"], row["duty"]) == (labels, duty)


def licences_by_hand(text):
    """Labels and score of a text of one-line expressions, by trying every prefix of what follows a tag."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)) + " "
    labels = {label for listed in (licences.NOTICES, licences.BASE) for phrase, label in listed.items() if f" {phrase} " in words}
    grammar = r"E(?:(?:and|or)E)*"  # E: an operand, with its exception if any
    named = set()
    for line in lowered.split("\n"):
        for rest in re.split(r"license-(?:identifier|expression):", line)[1:]:
            tokens = re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", rest)
            for size in range(len(tokens), 0, -1):
                shape = " ".join(t if t in ("and", "or", "(", ")") else "with" if t == "with" else "X" if "exception" in t else "E" if t in licences.KNOWN else "?" for t in tokens[:size])
                shape = re.sub("E with X", "E", shape).replace(" ", "")
                while (smaller := re.sub(rf"\({grammar}\)", "E", shape)) != shape:
                    shape = smaller
                if re.fullmatch(grammar, shape):
                    named |= {t for t in tokens[:size] if t not in ("and", "or", "with", "(", ")")}
                    break
    return labels | named, 1 - 0.5 ** (len(labels | named) + len(named))


def test_random_licence_expressions():
    r, scan = random.Random(4), licences.Scanner().scan
    operands = ["MIT", "gpl-2.0+", "Apache-2.0", "CC-BY-SA-4.0", "EPL-2.0 WITH gcc-exception-3.1", "cc by"]

    def made(depth):
        if depth == 0 or r.random() < 0.4:
            return r.choice(operands[:5])
        inner = made(depth - 1) + r.choice([" AND ", " or ", " Or "]) + made(depth - 1)
        return f"({inner})" if r.random() < 0.7 else inner

    for _ in range(2000):
        text = "\n".join(
            r.choice(["All rights  reserved", "plain, words", "Mozilla (Public) License", f"// {r.choice(['SPDX-', ''])}License-Identifier: {made(3)}{r.choice(['', ' ', ' today', ' or so', ' and others'])}"])
            for _ in range(r.randint(0, 4)))
        row, (labels, score) = scan(text), licences_by_hand(text)
        assert (set(filter(None, row["labels"].split(","))), row["score"]) == (labels, score), text


@pytest.mark.parametrize("unit", ["SPDX-License-Identifier: MIT ", "SPDX-License-Identifier:(", "(", "license-identifier:mit or ", "a.", "exception", "\n//"])
def test_licence_scan_is_linear(unit):
    scan = licences.Scanner().scan
    for head in ("", "SPDX-License-Identifier: ( GPL-2.0 WITH "):
        started = time.process_time()
        scan(head + unit * (2_000_000 // len(unit)))
        assert time.process_time() - started < 5


def test_quality_rules(awkward, no_docs, given):
    for docs in (awkward, given("documents")):
        want = Counter()
        for i, t in plain(docs):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
            cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))] += 1
        got = repetition.quality(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert repetition.quality(no_docs).count() == 0


def test_longest_repeats_against_all_pairs():
    r = np.random.default_rng(8)
    texts = [[str(x) for x in r.integers(0, 3, n)] for n in (0, 1, 2, 7, 30, 55)]
    sizes = [len(t) for t in texts]
    symbols = np.array([int(x) for t in texts for x in t])
    owner, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    got = repetition.repeat_lengths(repetition.suffix_ranks(symbols, ends, owner), ends)
    want = []
    for t in texts:
        for p in range(len(t)):
            best = 0
            for q in range(len(t)):
                k = 0
                while p != q and max(p, q) + k < len(t) and t[p + k] == t[q + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert got.tolist() == want


def test_piece_encoding(awkward, no_docs, given):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for docs in (awkward, given("documents")):
        want = Counter()
        for i, t in plain(docs):
            ids = model.encode(t)
            want[(i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(docs, tokenizer_path()).collect()) == want
    assert pieces.encode_documents(no_docs, tokenizer_path()).count() == 0


def test_piece_spans_cover_the_source():
    encoder = pieces.Encoder(tokenizer_path())
    assert encoder.by_word
    for _, text in AWKWARD:
        data, spans = (text or "").encode(), encoder.spans(text or "")
        assert b"".join(data[s:e] for _, s, e in spans) == data and all(a[2] == b[1] for a, b in zip(spans, spans[1:]))
        for i, s, e in spans:
            piece = encoder.model.id_to_piece(i)
            if not pieces.BYTE_PIECE.match(piece):
                assert data[s:e].decode().replace(pieces.MARK, " ") in (piece.replace(pieces.MARK, " "), piece.replace(pieces.MARK, " ")[1:])
        assert encoder.digest([text or ""])[0][2] == hashlib.sha256(np.array([e for _, _, e in spans], dtype="<i8").tobytes()).hexdigest()


def test_compiled_character_map():
    """A hand-made double array with the single prefix "ab", replaced by "X"."""
    units = [0] * 1024
    units[0] = (256 << 10)
    a = 256 ^ ord("a")
    units[a] = ord("a") | ((a ^ 512) << 10)
    b = 512 ^ ord("b")
    units[b] = ord("b") | (1 << 8) | ((b ^ 768) << 10)
    units[768] = 0x80000000
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"X\0"
    normal = pieces.Normalizer(blob, add_prefix=True, trim=True)
    assert normal(" abc  ab ") == (" Xc X", [0, 1, 3, 4, 6], [0, 3, 4, 5, 8])
