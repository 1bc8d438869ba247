"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Words are runs of 0-9, a-z and everything beyond ASCII after A-Z was lower-cased. Phrases are searched in the words
joined by single spaces, so any separators may stand between them. Identifier tags are searched in the lower-cased text;
what follows one is read as an expression of identifiers, `and`, `or`, `with` and parentheses. An operand is a known
identifier (a family of `FAMILIES`, alone or with one of its versions), a `LicenseRef-` name or, after `with`, an
exception; points and hyphens at its end are not its own. The expression ends where the text stops to be one, so that of
"MIT or later is fine" only MIT is read. Within parentheses and after an operator it may go on in the next line, behind
the marks of a comment. One whose line or text ends before it does has labels, but no value.

An expression evaluates to the duties it leaves the licensee: `and` takes the stricter side, `or` the laxer, `with` one
step less.

The score is 1 - 0.5 ** (distinct labels + distinct labels that whole expressions name).
Defined cases: a null text reads as empty (no words, null first and last word, empty labels, score 0); repeated or
null ids get one result per row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from sluiceway.llm.common import Columns, map_slices, texts

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases as words, and their labels.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "business source license": "busl",
    "creative commons": "cc",
    "common development and distribution license": "cddl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "gnu general public licence": "gpl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "microsoft public license": "ms-pl",
    "mozilla public license": "mpl",
    "open database license": "odbl",
    "open font license": "ofl",
    "open software license": "osl",
    "postgresql license": "postgresql",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "unlicense": "unlicense",
    "universal permissive license": "upl",
    "zlib license": "zlib",
}

TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")

# Families of licence identifiers and their versions. A version may be followed by one of SUFFIXES.
FAMILIES = {
    "0bsd": "", "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0",
    "blueoak": "1.0.0", "bsd": "1-clause 2-clause 3-clause 4-clause 2-clause-patent 3-clause-clear", "bsl": "1.0", "busl": "1.1",
    "cc0": "1.0", "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-sa": "1.0 2.0 2.5 3.0 4.0",
    "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1", "cecill-b": "", "cecill-c": "", "cpl": "1.0", "ecl": "1.0 2.0", "efl": "1.0 2.0",
    "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "hpnd": "", "isc": "", "lgpl": "2.0 2.1 3.0",
    "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mit": "", "mit-0": "", "mpl": "1.0 1.1 2.0", "ms-pl": "", "ms-rl": "", "mulanpsl": "1.0 2.0", "ncsa": "",
    "odbl": "1.0", "odc-by": "1.0", "ofl": "1.0 1.1", "openssl": "", "osl": "1.0 1.1 2.0 2.1 3.0", "pddl": "1.0", "php": "3.0 3.01",
    "postgresql": "", "psf": "2.0", "python": "2.0 2.0.1", "ruby": "", "sspl": "1.0", "unlicense": "", "upl": "1.0", "vim": "",
    "wtfpl": "", "x11": "", "zlib": "", "zpl": "1.1 2.0 2.1",
}
SUFFIXES = ("", "+", "-only", "-or-later")
KNOWN = frozenset(FAMILIES) | {f"{family}-{version}{s}" for family, versions in FAMILIES.items() for version in versions.split() for s in SUFFIXES}

TOKEN = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?(?::licenseref-[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)?")
OWN_NAME = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception(?:-[0-9.]+)?|[a-z0-9.-]+-note|additionref-[a-z0-9.-]+")
SPACE = re.compile(r"[ \t]*")
# A line break with the marks of a comment at the next line's start.
BREAK = re.compile(r"(?:[ \t]*\r?\n[ \t]*(?://+|#+|\*+(?!/)|--+|;+|%+)?)?[ \t]*")
OPERATORS = {"or": 1, "and": 2, "with": 3}

# How much an identifier asks of the licensee, by the start of its name; the first that fits counts.
DUTIES = (
    ("0bsd", 0), ("cc0", 0), ("mit-0", 0), ("pddl", 0), ("unlicense", 0), ("wtfpl", 0),
    ("afl", 1), ("apache", 1), ("artistic", 1), ("blueoak", 1), ("bsd", 1), ("bsl", 1), ("cecill-b", 1), ("ecl", 1), ("efl", 1), ("hpnd", 1), ("isc", 1),
    ("lppl", 1), ("mit", 1), ("ms-pl", 1), ("mulanpsl", 1), ("ncsa", 1), ("odc-by", 1), ("ofl", 1), ("openssl", 1), ("php", 1), ("postgresql", 1),
    ("psf", 1), ("python", 1), ("ruby", 1), ("upl", 1), ("vim", 1), ("x11", 1), ("zlib", 1), ("zpl", 1),
    ("apsl", 2), ("cddl", 2), ("cecill-c", 2), ("cpl", 2), ("epl", 2), ("lgpl", 2), ("mpl", 2), ("ms-rl", 2),
    ("cc-by-sa", 3), ("cecill", 3), ("eupl", 3), ("gfdl", 3), ("gpl", 3), ("odbl", 3), ("osl", 3),
    ("agpl", 4), ("busl", 4), ("cc-by-nc", 4), ("cc-by-nd", 4), ("sspl", 4), ("cc-by", 1),
)
UNKNOWN_DUTY = 5

SEPARATORS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(SEPARATORS).split()


def duty(identifier: str) -> int:
    name = identifier.lower()
    return next((level for prefix, level in DUTIES if name.startswith(prefix)), UNKNOWN_DUTY)


def is_operand(token: str, after: str | None) -> bool:
    if after == "with":
        return EXCEPTION.fullmatch(token) is not None
    return token in KNOWN or OWN_NAME.fullmatch(token) is not None


def expression_tokens(text: str, start: int) -> list[str]:
    """The longest run from `start`, in lower-cased text, that alternates operands and operators as an expression does."""
    taken, depth, operand_next, at = [], 0, True, start
    while True:
        # A line may break where the expression cannot be at its end.
        at = (BREAK if depth or (operand_next and taken) else SPACE).match(text, at).end()
        m = TOKEN.match(text, at)
        if not m and (at == len(text) or text[at] in "\r\n"):
            return taken
        if not m:
            break
        token = m[0]
        if token == "(" and operand_next:
            if taken and taken[-1] == "with":
                break
            depth += 1
        elif token == ")" and not operand_next and depth:
            depth -= 1
        elif token in OPERATORS and not operand_next:
            operand_next = True
        elif token not in OPERATORS and operand_next and is_operand(token, taken[-1] if taken else None):
            operand_next = False
        else:
            break
        taken.append(token)
        at = m.end()
    # Other text follows: an operator that leads into it is a word of that text.
    while taken and (taken[-1] in OPERATORS or taken[-1] == "("):
        taken.pop()
    return taken


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard; raises ValueError on an expression that is not whole."""
    out, held, operands = [], [], 0
    for token in tokens:
        word = token.lower()
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a parenthesis is closed that was not opened")
            held.pop()
        elif word in OPERATORS:
            while held and held[-1] != "(" and OPERATORS[held[-1]] >= OPERATORS[word]:
                out.append(held.pop())
            held.append(word)
        else:
            out.append(token)
            operands += 1
    while held:
        if held[-1] == "(":
            raise ValueError("a parenthesis stays open")
        out.append(held.pop())
    if operands == 0 or len(out) != 2 * operands - 1:
        raise ValueError("an operand is missing")
    return out


def evaluate(tokens: list[str]) -> int:
    stack: list[int] = []
    for token in postfix(tokens):
        if token in OPERATORS:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "and" else min(left, right) if token == "or" else max(0, left - 1))
        else:
            stack.append(duty(token))
    return stack[0]


class Scanner:
    def __init__(self):
        self.phrases = ahocorasick.Automaton()
        for listed, base in ((NOTICES, False), (BASE, True)):
            for phrase, label in listed.items():
                self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: str) -> dict:
        words = words_of(text)
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, labels = [], set(), set()
        for end, (size, label, is_base) in self.phrases.iter(line):
            labels.add(label)
            if is_base:
                base.add(label)
                starts.append(end - size + 1)
        duties, named, seen = [], set(), -1
        # One character a byte: only A-Z change, and identifiers are ASCII.
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("latin-1")
        for end, _ in self.tags.iter(lowered):
            if end <= seen:
                continue
            seen = end
            tokens = expression_tokens(lowered, end + 1)
            found = {t for t in tokens if t not in "()" and t not in OPERATORS}
            labels |= found
            try:
                duties.append(evaluate(tokens))
                named |= found
            except ValueError:
                pass
        weight = len(labels) + len(named)
        first, last = (line.count(" ", 0, p) for p in (min(starts), max(starts))) if starts else (None, None)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 - 0.5 ** weight,
            "duty": max(duties, default=None),
        }


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base phrase places, labels, score, and the strictest duty of its expressions."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "duty")

    def start():
        scanner = Scanner()

        def work(rows: Columns) -> Columns:
            found = [scanner.scan(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"]} | {n: [f[n] for f in found] for n in names}

        return work

    schema = "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double,duty long"
    return map_slices(texts(docs, id_col, text_col), start, schema)
