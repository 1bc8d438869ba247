"""Quality rules from a suffix array over each document's words.

Words are runs of anything but the six ASCII white-space characters. The words of many documents are numbered and sorted
together as suffixes that end with their document (prefix doubling); the longest common prefixes of neighbours give
the maximal repeated substrings. Their spans are united; a document is kept if it passes the base rules, if the spans
of repeats of at least MIN_REPEAT words cover at most MAX_COVERED of its words, and if its longest repeat has at most
MAX_REPEAT words. The base count of words in repeated five-word windows is the same union for five words and more.

A task holds the words of one slice of texts, or of one document if that is longer.
Defined cases: a null text has no words, so it fails the base rule; repeated or null ids get one result per row; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from sluiceway.llm.common import Columns, map_slices, order_by, texts

MIN_REPEAT = 8
MAX_COVERED = 0.2
MAX_REPEAT = 50
WINDOW = 5

# Fixed values of the base rules.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def refine(rank: np.ndarray, active: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split the groups of equal `rank` by `second`. A rank is the place of its group's first member.
    Returns the new ranks and the members of groups that still have more than one."""
    n = len(rank)
    bits = np.uint64(max(1, int(n).bit_length()))
    if 2 * int(bits) > 63:
        order = np.lexsort((second, rank[active]))
    else:
        order = order_by_pair(rank[active], second, int(bits))
    members, first, then = active[order], rank[active][order], second[order]
    at = np.arange(len(members))
    group = np.ones(len(members), bool)
    group[1:] = first[1:] != first[:-1]
    part = group.copy()
    part[1:] |= then[1:] != then[:-1]
    group_at = np.maximum.accumulate(np.where(group, at, 0))
    part_at = np.maximum.accumulate(np.where(part, at, 0))
    fresh = rank.copy()
    fresh[members] = first + (part_at - group_at)
    alone = part.copy()
    alone[:-1] &= part[1:]
    return fresh, members[~alone]


def order_by_pair(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Order by two numbers below 2**bits: one sort of packed keys where they fit 64 bits, else a stable argsort."""
    key = (first.astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64)
    index_bits = max(1, int(len(key) - 1).bit_length())
    if 2 * bits + index_bits > 64:
        return np.argsort(key, kind="stable")
    packed = np.sort((key << np.uint64(index_bits)) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << index_bits) - 1)).astype(np.int64)


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first h symbols, for h = 1, 2, 4, ... until all differ. `ends` is the end of
    each position's document; suffixes of different documents never share a rank."""
    n = len(symbols)
    rank = np.zeros(n, np.int64)
    key = owner.astype(np.uint64) * np.uint64(int(symbols.max()) + 1 if n else 1) + symbols.astype(np.uint64)
    order = order_by(key << np.uint64(max(0, 63 - int(key.max()).bit_length()))) if n else np.zeros(0, np.int64)
    edge = np.ones(n, bool)
    edge[1:] = key[order][1:] != key[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    alone = edge.copy()
    alone[:-1] &= edge[1:]
    active, levels, h = order[~alone], [(1, rank)], 1
    while len(active):
        onward = active + h
        second = np.where(onward < ends[active], rank[np.minimum(onward, n - 1)] + 1, 0)
        rank, active = refine(rank, active, second)
        h *= 2
        levels.append((h, rank))
    return levels


def repeat_lengths(levels: list[tuple[int, np.ndarray]], ends: np.ndarray) -> np.ndarray:
    """For each position the longest substring from it that also starts elsewhere in its document: the larger of
    the common prefixes with its two neighbours in suffix order."""
    rank = levels[-1][1]
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    first = levels[0][1]
    pair = np.flatnonzero(first[suffix[1:]] == first[suffix[:-1]]) + 1
    p, q = suffix[pair - 1], suffix[pair]
    length = np.zeros(len(pair), np.int64)
    for h, ranks in reversed(levels):
        a, b = p + length, q + length
        whole = (a < ends[p]) & (b < ends[q])
        same = whole & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        length += np.where(same, h, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, p, length)
    np.maximum.at(longest, q, length)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions the spans of all repeats of at least `least` symbols cover."""
    change = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def measure(listed: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated windows, words under long repeats, longest repeat."""
    sizes = np.array([len(words) for words in listed], dtype=np.int64)
    numbers: dict[str, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for words in listed for w in words], dtype=np.int64)
    none = np.zeros(len(listed), np.int64)
    if not len(symbols):
        return none, none, none
    owner = np.repeat(np.arange(len(listed)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    longest = repeat_lengths(suffix_ranks(symbols, ends, owner), ends)
    top = none.copy()
    np.maximum.at(top, owner, longest)

    def per_document(least: int) -> np.ndarray:
        return np.bincount(owner, covered(longest, least), len(listed)).astype(np.int64)

    return per_document(WINDOW), per_document(MIN_REPEAT), top


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base measures, its repeats and the verdict."""
    schema = (
        "doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,"
        "n_covered_words long,longest_repeat long"
    )

    def start():
        def work(rows: Columns) -> Columns:
            listed = [WORD.findall(t) for t in rows["text"]]
            repeated, under, longest = (x.tolist() for x in measure(listed))
            sizes = [len(words) for words in listed]
            failed = [n < MIN_WORDS or 100 * r > MAX_REPEATED_PERCENT * n for n, r in zip(sizes, repeated)]
            return {
                "doc_id": rows["doc_id"], "n_words": sizes, "word_chars": [sum(map(len, words)) for words in listed],
                "n_symbols": [sum(map(t.count, SYMBOLS)) for t in rows["text"]],
                "n_dup_lines": [duplicate_lines(t) for t in rows["text"]], "n_repeat_words": repeated, "base_failed": failed,
                "kept": [not f and c <= MAX_COVERED * n and top <= MAX_REPEAT for f, n, c, top in zip(failed, sizes, under, longest)],
                "n_covered_words": under, "longest_repeat": longest,
            }

        return work

    return map_slices(texts(docs, id_col, text_col), start, schema)
