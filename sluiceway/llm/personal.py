"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, digits, plus signs, schemes and identifier cues.
A deterministic parser at each anchor expands to the boundaries of the item and validates it. Per kind, matches are
leftmost and do not overlap; a match that fails validation is dropped and not tried again further on.

Defined cases: a null text reads as empty and has no items; rows with a null or repeated id are treated like any other
row, one result each; an empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sluiceway.llm.common import Columns, map_slices, slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# Fixed patterns of the base kinds, from the place their anchor stands at.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SCHEMES = ("http://", "https://", "ftp://")
ADDRESS = re.compile(r"(?:[A-Za-z0-9._~%!$&'*+,;=:-]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
TRAILING = ".,;:!?)]}"

ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
ACCOUNT_LEAD = re.compile(r"(?:\s{0,3}(?:number|no\.?|nr\.?))?\s{0,3}[:=#]?\s{0,3}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NUMBERED = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,16}")

SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key")
SECRET_VALUE = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})")

AT, DIGIT, PLUS, SCHEME, ACCOUNT, SECRET = range(6)


def automaton() -> ahocorasick.Automaton:
    words = {"@": AT, "+": PLUS, **{str(d): DIGIT for d in range(10)}}
    for listed, what in ((SCHEMES, SCHEME), (ACCOUNT_CUES, ACCOUNT), (SECRET_CUES, SECRET)):
        for word in listed:
            words |= {form: what for form in (word, word.capitalize(), word.upper())}
    built = ahocorasick.Automaton()
    for word, what in words.items():
        built.add_word(word, (what, len(word)))
    built.make_automaton()
    return built


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(found: str) -> bool:
    code = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def small_number(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def word_before(text: str, start: int) -> bool:
    return start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")


class Spans:
    """Collects the spans of one text, anchor by anchor."""

    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        self.next = dict.fromkeys(KINDS, 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.found[kind].append((start, end))
        self.next[kind] = end

    def at(self, p: int) -> None:
        start, floor = p, self.next["email"]
        while start > floor and self.text[start - 1] in LOCAL:
            start -= 1
        if start < p and (domain := DOMAIN.match(self.text, p + 1)):
            self.add("email", start, domain.end())

    def digit(self, p: int) -> None:
        if p >= self.next["ip"]:
            if m := IP.match(self.text, p):
                self.next["ip"] = m.end()
                if all(map(small_number, m[0].split("."))):
                    self.add("ip", p, m.end())
            else:
                self.next["ip"] = DIGITS.match(self.text, p).end()
        if p >= self.next["card"] and (m := CARD.match(self.text, p)):
            self.next["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                self.add("card", p, m.end())

    def plus(self, p: int) -> None:
        if p >= self.next["phone"] and (m := PHONE.match(self.text, p)):
            self.next["phone"] = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                self.add("phone", p, m.end())

    def scheme(self, p: int, after: int) -> None:
        if p >= self.next["url"] and not word_before(self.text, p) and (m := ADDRESS.match(self.text, after)):
            end = m.end()
            while self.text[end - 1] in TRAILING:
                end -= 1
            self.add("url", p, end)

    def account(self, p: int, after: int) -> None:
        if word_before(self.text, p) or after < self.next["account"]:
            return
        start = ACCOUNT_LEAD.match(self.text, after).end()
        if (m := IBAN.match(self.text, start)) and iban_ok(m[0]):
            self.add("account", start, m.end())
        elif start > after and (m := NUMBERED.match(self.text, start)):
            self.add("account", start, m.end())

    def secret(self, p: int, after: int) -> None:
        if word_before(self.text, p) or after < self.next["secret"]:
            return
        if (m := SECRET_VALUE.match(self.text, after)) and any(map(str.isdigit, m[1])):
            self.add("secret", m.start(1), m.end(1))


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]] | None:
    """Spans by kind (code points, end exclusive), or None where the text has no anchor."""
    spans = None
    for end, (what, size) in anchors.iter(text):
        if spans is None:
            spans = Spans(text)
        p = end - size + 1
        if what == DIGIT:
            spans.digit(p)
        elif what == AT:
            spans.at(p)
        elif what == PLUS:
            spans.plus(p)
        elif what == SCHEME:
            spans.scheme(p, end + 1)
        elif what == ACCOUNT:
            spans.account(p, end + 1)
        else:
            spans.secret(p, end + 1)
    return spans and spans.found


def written(found: dict[str, list[tuple[int, int]]] | None, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in found[kind]) if found else ""


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    schema = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,n_spans long"

    def start():
        anchors = automaton()

        def work(rows: Columns) -> Columns:
            found = [find(t, anchors) for t in rows["text"]]
            out: Columns = {"doc_id": rows["doc_id"]}
            for kind in BASE_KINDS:
                out[f"n_{kind}"] = [len(f[kind]) if f else 0 for f in found]
            out["base_sha256"] = [hashlib.sha256(written(f, BASE_KINDS).encode()).hexdigest() for f in found]
            out["spans"] = [written(f, KINDS) for f in found]
            out["n_spans"] = [sum(map(len, f.values())) if f else 0 for f in found]
            return out

        return work

    return map_slices(texts(docs, id_col, text_col), start, schema)


def redacted(text: str, found: dict[str, list[tuple[int, int]]] | None) -> str:
    """The text with each item replaced by its kind in brackets; of overlapping items the one that starts first."""
    if not found:
        return text
    marks = sorted((s, -e, kind) for kind, spans in found.items() for s, e in spans)
    out, at = [], 0
    for s, e, kind in marks:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced; all columns stay, the length follows the text. Null stays null."""

    def run(batches):
        anchors = automaton()
        for part in slices(batches, text_col, 2 << 20):
            place = part.schema.get_field_index(text_col)
            new = [None if t is None else redacted(t, find(t, anchors)) for t in part.column(place).to_pylist()]
            columns = list(part.columns)
            columns[place] = pa.array(new, part.schema.field(place).type)
            if (length := part.schema.get_field_index(length_col)) >= 0:
                columns[length] = pa.array([None if t is None else len(t) for t in new], part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
