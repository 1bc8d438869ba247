"""Rules over text as column expressions: every row is handled where it lies, with no join and no shuffle.

Patterns follow Java syntax and are searched in the whole text, ignoring case, with ^ and $ at
line ends ('\\n' only). Searching a long text for a pattern costs far more than looking for plain words,
so a pattern is only tried where the words it needs are present; pattern and words must agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH = "(?imd)"
LINE = "(?id)"

# What stands for a masked secret, the shortest secret, and the excerpt width.
MASK = "***REDACTED***"
SHORTEST_SECRET = 4
EXCERPT_WIDTH = 240
BLANKS = " \t\n\r\x0b\x0c"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Patterns a script line must not match, in the order they are tried. With each, our own
# list of words it needs: all entries of the list, any of the '|' alternatives of an entry.
SCRIPT_RULES = (
    ("rm-root", r"\brm\s+(-[a-zA-Z]*\s+)*-?[a-zA-Z]*[rR][a-zA-Z]*f?\s+/(\s|$|\*)", ("rm", "/")),
    ("rm-wildcard-sys", r"\brm\s+.*-[a-zA-Z]*r[a-zA-Z]*\s+/(etc|var|usr|boot|bin|sbin|lib)/?(\s|$)", ("rm", "-", "/")),
    ("dd-disk", r"\bdd\b[^|;&]*\bof=/dev/(sd|nvme|vd|hd|xvd)", ("dd", "of=/dev/")),
    ("mkfs", r"\bmkfs(\.[a-z0-9]+)?\b", ("mkfs",)),
    ("overwrite-auth", r">\s*/etc/(passwd|shadow|sudoers|group)\b", ("/etc/",)),
    ("chmod-777-root", r"\bchmod\s+(-[a-zA-Z]+\s+)*777\s+/(\s|$)", ("chmod", "777")),
    ("chown-root-recursive", r"\bchown\s+(-[a-zA-Z]+\s+)*[^\s]+\s+/(\s|$)", ("chown", "/")),
    ("fork-bomb", r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:", (":()",)),
    ("pipe-to-shell", r"\b(curl|wget)\b[^|]*\|\s*(sudo\s+)?(ba|z|k|)sh\b", ("curl|wget", "sh")),
    ("power-state", r"^\s*(sudo\s+)?(reboot|shutdown|halt|poweroff)\b", ("reboot|shutdown|halt|poweroff",)),
    ("userdel-root", r"\buserdel\b.*\broot\b", ("userdel", "root")),
    ("iptables-flush", r"\biptables\s+(-F|--flush)\b", ("iptables",)),
    ("history-wipe", r"\bhistory\s+-c\b|>\s*~?/?\.bash_history", ("history",)),
)


def necessary_words(pattern: str) -> tuple[str, ...]:
    """Words that every match of a pattern contains, read off the parsed pattern, as a `needs` list.

    Only what is certain is listed: runs of plain characters outside of options, and alternatives of which each has a word.
    Looked up in lower-cased text they hide no match. A pattern without such words, or with syntax that means something else
    to Java than to the parser used here (nested classes, vertical blanks), gives an empty list and is tried on every text.
    """
    tokens = re.findall(r"\\.|.", pattern, re.DOTALL)
    bare = "".join("x" if len(token) > 1 else token for token in tokens)
    if r"\v" in tokens or "&&" in bare or re.search(r"\[\^?\]?[^\]]*\[", bare):
        return ()
    try:
        parsed = re._parser.parse(pattern, re.IGNORECASE | re.MULTILINE)
    except re.error:
        return ()
    return tuple("|".join(sorted(words)) for words in dict.fromkeys(_certain(parsed)))


def _certain(sequence) -> list[frozenset[str]]:
    """Sets of words of which each match contains at least one; all sets hold."""
    found, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        kind = str(kind)
        # A bar separates words in a list.
        if kind == "LITERAL" and chr(value) != "|":
            run += chr(value).lower()
            continue
        if run.strip():
            found.append(frozenset([run]))
        run = ""
        if kind == "SUBPATTERN":
            found += _certain(value[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            found += _certain(value[2])
        elif kind == "ATOMIC_GROUP":
            found += _certain(value)
        elif kind == "BRANCH":
            ways = [_certain(way) for way in value[1]]
            if all(ways):
                found.append(frozenset().union(*[max(way, key=lambda words: min(map(len, words))) for way in ways]))
    return found


@dataclass(frozen=True)
class Rule:
    """A log rule. `steps` and `code` narrow it to rows that name such a step or return code.

    `needs` lists words every match of the patterns contains (see SCRIPT_RULES). It may be left out,
    and is then read off each pattern.
    """

    rule_id: str
    patterns: Sequence[str]
    steps: Sequence[str] = ()
    code: int | None = None
    needs: Sequence[str] = ()


def _has(lower: Column, needs: Sequence[str]) -> Column:
    out = F.lit(True)
    for entry in needs:
        out = out & _any(lower, entry.lower().split("|"))
    return out


def _any(lower: Column, words: Sequence[str]) -> Column:
    out = lower.contains(words[0])
    for word in words[1:]:
        out = out | lower.contains(word)
    return out


def _applies(rule: Rule, step: Column | None, code: Column | None) -> Column:
    """A row without a step (or code) is in scope of every rule."""
    out = F.lit(True)
    if rule.steps and step is not None:
        out = out & (F.coalesce(step, F.lit("")) == "") | step.isin(list(rule.steps))
    if rule.code is not None and code is not None:
        out = out & (code.isNull() | (code == rule.code))
    return out


def classify(text: Column, rules: Sequence[Rule], step: Column | None = None, code: Column | None = None) -> Column:
    """`(rule_id, excerpt)` of the first rule in order that matches, NULL if none does.

    The excerpt is the hit of the rule's first matching pattern with the text around it.
    """
    if not any(rule.patterns for rule in rules):
        raise ValueError("classify needs at least one rule")

    def first(row: Column) -> Column:
        out = None
        for rule in rules:
            scope = _applies(rule, step, code) & _has(row["low"], rule.needs)
            for pattern in rule.patterns:
                words = () if rule.needs else necessary_words(pattern)
                found = scope & _has(row["low"], words) & row["plain"].rlike(SEARCH + pattern)
                hit = F.struct(F.lit(rule.rule_id).alias("rule_id"), excerpt(row["plain"], SEARCH + pattern).alias("excerpt"))
                out = F.when(found, hit) if out is None else out.when(found, hit)
        return out

    text = F.coalesce(text, F.lit(""))
    return _once(F.struct(text.alias("plain"), F.lower(text).alias("low")), first)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row, however often and in whichever branch it is used."""
    return F.transform(F.array(value), use)[0]


def where_found(column: Column) -> Column:
    """For `select`: a row only where the column is not NULL. A filter on such a costly column would be
    moved below the projection and work it out a second time."""
    return F.explode(F.array_compact(F.array(column)))


def excerpt(text: Column, pattern: str, width: int = EXCERPT_WIDTH) -> Column:
    """The first hit with up to half of `width` characters on each side; '...' marks text left out."""
    def cut(hit: Column) -> Column:
        size = F.length(text)
        first = F.greatest(F.lit(0), hit["at"] - 1 - width // 2)
        last = F.least(size, hit["at"] - 1 + hit["size"] + width // 2)
        body = F.btrim(F.substring(text, first + 1, last - first), F.lit(BLANKS))
        return F.concat(F.when(first > 0, "...").otherwise(""), body, F.when(last < size, "...").otherwise(""))

    at = F.regexp_instr(text, F.lit(pattern)).alias("at")
    size = F.length(F.regexp_substr(text, F.lit(pattern))).alias("size")
    return _once(F.struct(at, size), cut)


def mask(text: Column, secrets: Sequence[str]) -> Column:
    """Every known secret replaced, longest first so that one inside another cannot leave a rest."""
    out = text
    for secret in sorted({s for s in secrets if len(s.strip()) >= SHORTEST_SECRET}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(secret), F.lit(MASK))
    return out


def script_hits(text: Column, rules: Sequence[tuple[str, str, Sequence[str]]] = SCRIPT_RULES) -> Column:
    """Ids of the rules a script breaks, in the order of the lines that break them, each once.

    Blank lines and comments are skipped, and a line counts for its first rule only. A script without
    the words of any rule is not split into lines at all.
    """
    def first_rule(line: Column) -> Column:
        out = None
        for rule_id, pattern, needs in rules:
            found = _has(line["low"], needs) & line["plain"].rlike(LINE + pattern)
            out = F.when(found, F.lit(rule_id)) if out is None else out.when(found, F.lit(rule_id))
        return out

    def worth(lower: Column) -> Column:
        out = F.lit(False)
        for _, _, needs in rules:
            out = out | _has(lower, needs)
        return out

    text = F.coalesce(text, F.lit(""))
    plain = F.transform(F.split(text, LINE_ENDS), lambda line: F.btrim(line, F.lit(BLANKS)))
    code = F.filter(plain, lambda line: (line != "") & ~line.startswith("#"))
    lines = F.transform(code, lambda line: F.struct(line.alias("plain"), F.lower(line).alias("low")))
    hits = F.array_distinct(F.array_compact(F.transform(lines, first_rule)))
    return F.when(_once(F.lower(text), worth), hits).otherwise(F.array().cast("array<string>"))
