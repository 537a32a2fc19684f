import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_shingle_join import brute
from test_toxicity import corpus

import corpus_pipeline
from pagelode.llm import packing, toxicity
from pagelode.llm.text import lower_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = corpus(420, seed=8)
    texts = {i: t for i, t, *_ in rows}
    for k in range(40):  # exact copies in other letter case, near copies
        texts[1000 + k] = texts[k * 3].upper()
        words = texts[k * 5 + 1].split()
        words[rng.randrange(len(words))] = "changed"
        texts[2000 + k] = " ".join(words)
    texts |= {3000: None, 3001: "", 3002: "ba do ri " * 5000}
    docs = [(i, t, "en", None if i % 50 == 0 else f"s{i % 3}", len(t or "")) for i, t in texts.items()] + [(7, texts[7], "en", "s1", 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    steps, have = [], docs
    for name, stage in corpus_pipeline.STAGES:
        have = stage(spark, have, path).persist()
        steps.append(have)
        if name != "packing":
            assert have.columns == docs.columns
    got = [Counter((r["doc_id"], r["text"]) for r in s.collect()) for s in steps[:4]]
    # toxicity: the model's own decision, text by text
    score = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    want = Counter((i, t) for i, t, *_ in rows if score([lower_bytes(t)])[0] < 0.5)
    assert got[0] == want
    toxic = {i for i, *_ in rows if i < 420 and i % 6 == 0}
    assert sum(i in toxic for i, _ in got[0]) < 0.1 * len(toxic)
    # exact copies: the largest id stays, once
    best = {}
    for i, t in got[0]:
        key = lower_bytes(t)
        best[key] = max(best.get(key, i), i)
    want = Counter({(i, t): 1 for i, t in got[0] if best[lower_bytes(t)] == i})
    assert got[1] == want
    # near copies: the smallest id of each group stays
    parts = brute([(i, t) for i, t in got[1]], 5, 4, 5)
    assert {i for i, _ in got[2]} == {i for i, _, least in parts if i == least}
    # mixing: whole documents, at most twice, totals near the targets
    assert all(n <= 2 and got[2][k] for k, n in got[3].items())
    size = lambda c: sum(n * len((t or "").split()) for (_, t), n in c.items())
    assert abs(size(got[3]) - 1.5 * size(got[2])) <= 0.02 * size(got[2]) + 30000
    # packing: every drawn document is there in full
    packed = steps[4].collect()
    by = Counter()
    for r in packed:
        by[r["doc_id"]] += r["length"]
    encoder = packing._Encoder(packing.default_tokenizer())
    for (i, t), n in got[3].items():
        assert by[i] == n * (len(next(encoder.batch([t or ""]))) // 4 + 1)
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    first = out.groupBy("sequence_id").agg(F.min("offset").alias("o")).agg(F.max("o")).first()[0]
    assert first == 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = "doc_id long, text string, source string, __id long, __n long, __digest string, digest string, best_id long, hot long, own long, place long, places long, words long, node long, key long, size long, `row` long, start long, position string, pass long"


def test_stages_with_clashing_names_and_odd_rows(spark, folder):
    """Extra columns with the operators' own names go through; nulls, repeated rows and an empty table do not crash."""
    path, _ = folder
    more = (1, 2, "a", "b", 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, "f", 14)
    rows = [(i, f"plain words of text number {i} " * 8, f"s{i % 2}", *more) for i in range(12)]
    rows += [(20, rows[0][1].upper(), None, *more), (21, None, "s1", *more), (None, "no id here " * 4, "s0", *more), (None, None, None, *more)]
    rows += [rows[3], rows[3], (22, "Long Text " * 60000, "s1", *[None] * 17)]
    for have in (rows, []):
        docs = spark.createDataFrame(have, CLASHING)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path).persist()
            if name != "packing":
                assert docs.columns == [f.split()[0].strip("`") for f in CLASHING.split(", ")], name
            if name == "ngram_jaccard_join" and have:
                kept = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
                assert kept == [*range(1, 12), 20, 21, 22]
        assert (docs.count() > 0) == bool(have)


def test_packed_rows_carry_the_training_order(spark, folder, tmp_path):
    """The same places for any files that the mix is written to."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60 and text is not null")
    corpus_pipeline.mix_sources(spark, docs, path).write.parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    names = sorted(f for f in os.listdir(tmp_path / "mix") if f.startswith("part-"))
    want = [r["doc_id"] for f in names for r in spark.read.parquet(str(tmp_path / "mix" / f)).collect()]
    got = corpus_pipeline.pack_sequences(spark, mixed, path).collect()
    places = {r["position"]: r["doc_id"] for r in got}
    assert [places[k] for k in range(len(want))] == want and len(places) == len(want)
    passes = {r["position"]: r["pass"] for r in got}
    seen = Counter()
    for k, doc in enumerate(want):
        assert passes[k] == (None if doc is None else seen[doc])
        seen[doc] += 1
    assert seen[7] == 4 and max(n for doc, n in seen.items() if doc != 7) == 2  # two rows have the id 7
    mixed.coalesce(1).write.parquet(str(tmp_path / "again"))
    again = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "again")), path)
    assert {r["position"] for r in again.collect()} == set(range(len(want)))
