import hashlib

from pagelode.llm import exact_dedup

SCHEMA = "doc_id long, text string, row string, best int"


def test_groups(spark):
    rows = [(i, "Same Text" if i % 3 else "same text", "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (101, "", None, None), (102, "ÉTÉ", "x", 1), (103, "ÉtÉ", "x", 1), (104, "été", "x", 1)]
    rows += [(105, "twin", "x", 1), (105, "twin", "x", 1), (None, "alone", "x", 1), (None, "twin", "x", 1), (106, "long " * 30000, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.duplicate_groups(df, heavy=2).collect()
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(hashlib.sha256(lower(text).encode()).hexdigest(), []).append(doc_id)
    assert len(got) == len(rows)
    for x in got:
        ids = groups[x["text_sha256"]]
        assert x["group_size"] == len(ids)
        assert x["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(x["kept"] for x in got) == len(groups)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_groups(df).count() == 0
    assert exact_dedup.drop_duplicates(df).count() == 0
