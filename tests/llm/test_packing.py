import random
import zlib
from array import array

import numpy as np
import pytest

from pagelode.llm import packing

SCHEMA = "doc_id long, text string, row string, length int"


def check_patterns(counts, capacity):
    found = np.zeros(capacity + 1, int)
    bins = 0
    for m, sizes in packing.pack_histogram(counts, capacity):
        assert m > 0 and sum(sizes) <= capacity
        bins += m
        for s in sizes:
            found[s] += m
    assert (found == counts).all()
    return bins


def fewest(items, capacity):
    """Exact minimum by search over small instances."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
    counts = np.bincount(np.array(items, int), minlength=capacity + 1)
    left = counts.copy()
    fixed = sum(m for m, _ in packing.reduce_instance(left, capacity))
    rest = [s for s in range(capacity + 1) for _ in range(left[s])]
    assert fixed + fewest(rest, capacity) == fewest(items, capacity)
    assert check_patterns(counts, capacity) <= fewest(items, capacity) + 1


def test_large_histogram():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6.5, 1, 200_000).astype(int), 1, 4096), minlength=4097)
    bins = check_patterns(counts, 4096)
    assert bins <= -(-int((counts * np.arange(4097)).sum()) // 4096) * 1.01


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = "a b​c \x0bd <|endoftext|> it's 12ab Été"
    rows = [(1, "Hello World", "x", 1), (2, None, None, None), (3, "", "x", 2), (4, "wörd " * 9000, "x", 3), (1, "Hello World", "x", 1), (None, odd, "x", 4)]
    got = packing.packed_documents(spark.createDataFrame(rows, SCHEMA), with_ids=True).collect()
    want = {}
    for doc_id, text, _, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc_id, []).append(ids)
    for doc_id in want:
        pieces = sorted((x for x in got if x["doc_id"] == doc_id), key=lambda x: x["start"])
        joined = [i for x in pieces for i in x["ids"]]
        assert joined == [i for ids in want[doc_id] for i in ids]
        for x in pieces:
            assert x["ids_crc32"] == zlib.crc32(array("I", x["ids"]).tobytes()) and x["length"] == len(x["ids"])
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
