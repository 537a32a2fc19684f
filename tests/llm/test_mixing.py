import pytest

from pagelode.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, start int"


def filled(sizes, weights, total):
    """Targets by repeated resharing."""
    targets, capped = {}, {}
    left = total
    free = dict(sizes)
    while free:
        scale = left / sum(weights[s] for s in free)
        over = [s for s in free if scale * weights[s] > 2 * sizes[s]]
        if not over:
            targets |= {s: scale * weights[s] for s in free}
            break
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]
            del free[s]
    return targets | capped


def test_plan(spark):
    rows = []
    for i in range(400):
        source = None if i % 40 == 0 else f"s{min(i % 10, 6)}"
        rows.append((i, "w " * (i % 17) if i % 50 else None, source, "x", 1))
    rows += [(7, "w " * 7, "s6", "x", 1), (None, "a b", "s1", "x", 1)]
    got = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in order:
        mine = [x for x in got if x["source"] == s]
        assert sum(x["size"] for x in mine) == mine[0]["source_size"] == sizes[s]
        assert mine[0]["target"] == pytest.approx(want[s])
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 1
        assert all(0 <= x["taken"] <= 2 * x["size"] for x in mine)
    drawn = [x["position"] for x in got if x["position"] is not None]
    assert all(0 <= p <= 1 for p in drawn)


def test_documents(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", "x", 1) for i in range(300)] + [(3, "w " * 4, "s3", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    total = sum(len(x["text"].split()) for x in out.collect())
    assert abs(total - 1.5 * sum(len(r[1].split()) for r in rows)) < 40


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_plan(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    one = spark.createDataFrame([(1, None, None, "x", 1)], SCHEMA)
    assert [x["taken"] for x in mixing.mix_plan(one).collect()] == [0]
