"""The splitter against a plain loop, and on a very long page."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagelode.functions import lexicon as lx
from pagelode.sources import prepare as pp


def plain(text):
    chunks, held = [], []
    for line in (" ".join(x.split()) for x in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text or "")):
        if not line:
            continue
        if any(k in line for k in lx.FINANCIAL) and re.search(r"\d", line):
            chunks += ([" ".join(held)] if held else []) + [line]
            held = []
            continue
        held.append(line)
        if len(" ".join(held)) >= 260:
            chunks.append(" ".join(held))
            held = []
    return chunks + ([" ".join(held)] if held else [])


def test_random_pages(spark):
    rng = random.Random(1)
    money = lx.FINANCIAL[0]

    def line():
        kind = rng.random()
        if kind < 0.12:
            return f"{money} {rng.randrange(10**6)}"
        if kind < 0.2:
            return ""
        return "x" * rng.choice([1, 3, 20, 40, 129, 130, 131, 258, 259, 260, 261, 600])

    pages = ["\n".join(line() for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 31, 70]))) for _ in range(150)]
    pages += [None, "", "\n\n", "x" * 5000, f"{money} 1", f"{money} 1\n{money} 2", "a\r\nb\x0bc d", "y" * 259 + "\n", "y" * 129 + "\n" + "z" * 130, "y" * 129 + "\n" + "z" * 129 + "\nw"]
    df = spark.createDataFrame(list(enumerate(pages)), "no int, page_text string")
    got = {r["no"]: r["c"] for r in df.select("no", pp.text_chunks(F.col("page_text")).alias("c")).collect()}
    for no, text in enumerate(pages):
        assert got[no] == plain(text), no


@pytest.mark.parametrize("kind", ["short", "mixed"])
def test_a_page_of_100_000_lines(spark, kind):
    rng = random.Random(2)
    money = lx.FINANCIAL[0]
    text = "\n".join("word " * rng.randint(1, 9) if kind == "short" or k % 3 else f"{money} {k}" for k in range(100_000))
    df = spark.createDataFrame([(text,)], "page_text string")
    began = time.time()
    got = df.select(pp.text_chunks(F.col("page_text")).alias("c")).first()["c"]
    assert time.time() - began < 30
    assert got == plain(text)
