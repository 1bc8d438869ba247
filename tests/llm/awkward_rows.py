"""A table of awkward documents for every operator, and the smallest given tables for comparisons with brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, class_id long, copies string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "ür", "so", "vé"]) for _ in range(r.randint(1, 4))) for _ in range(words))


LONG = prose(1, 6000)
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, prose(2, 80)), (8, prose(2, 80) + " more"), (9, prose(2, 80)),
    (10, "same same " * 60), (None, prose(3, 40)), (None, None), (11, prose(4, 30)), (11, prose(4, 30)), (12, "x" * 50_000), (13, "日本語のテキスト、空白なし" * 5),
    (14, "mail a.b@c.de, 10.0.0.1 and +49 (30) 1234-567 or 4539 1488 0343 6467; token = \"a1b2c3d4e5\""), (15, "▁ mark  two   spaces ▁▁ end "),
    (-3, prose(2, 79) + " other"), (16, "a\x1cb\x85c\xa0d   e"),
]


def frame(spark, rows, source=lambda i: f"s{i % 3}"):
    full = [(i, t, "en", None if k % 7 == 6 else source(k), None if t is None else len(t), "clash", 7, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    from sluiceway.llm.common import open_table

    return lambda name: open_table(spark, DATA, name)


def listed(df, key="doc_id"):
    """Rows by id, for tables whose ids are unique."""
    return {r[key]: r for r in df.collect()}


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
