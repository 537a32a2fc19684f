import random

from pagelode.llm import toxicity
from pagelode.llm.ppm import is_held_out

SCHEMA = "doc_id long, text string, score string, toxic int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    parts = ["ba", "do", "ri", "ten", "mus", "lo", "ka", "sel", "vi"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 150))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Grunkle", "zwepft", "hockmar"]))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_windows_cover_the_text():
    for raw in (b"", b"a", b"x" * 1000, b"some words here " * 50, b" lead"):
        joined = b"".join(w[:-1] for w in toxicity.windows(raw))
        assert joined == raw


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    rows += [(5000, None, "x", 1), (5001, "", "x", 1), (None, "grunkle", None, None), (5002, "ba do " * 30000, "x", 1), (0, rows[0][1], "x", 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (7000, 1, 1), (5, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 1500]
    right = sum(x["predicted"] == (x["doc_id"] % 6 == 0) for x in held)
    assert right / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert all(x["predicted"] == 0 for x in got if x["doc_id"] in (5000, 5001, 5002))
    kept = toxicity.ordinary_documents(docs, marks)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x["predicted"] == 0 for x in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    other = marks.withColumn("toxic", toxicity.F.when(is_held_out(marks.doc_id, 0), 1 - marks.toxic).otherwise(marks.toxic))
    first, second = (toxicity.score_documents(docs, toxicity.train(docs, m)).orderBy("doc_id").collect() for m in (marks, other))
    assert first == second


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, toxicity.train(docs, none)).first()["score"] == 0.0
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_documents(empty, toxicity.train(empty, none)).count() == 0


def test_one_very_long_text_does_not_empty_its_class(spark):
    rows, labels = corpus(300)
    order = toxicity.F.xxhash64("doc_id", toxicity.F.lit("toxicity"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = marks.where("toxic = 1").where(~is_held_out(marks.doc_id, 0)).orderBy(order).first()["doc_id"]
    docs = spark.createDataFrame([(i, t + " ba" * 50_000 if i == first else t, *x) for i, t, *x in rows], SCHEMA)
    model = toxicity.train(docs, marks, most_chars=200_000)
    assert len(model.weights)
    got = toxicity.score_documents(docs, model).where("predicted = 1").collect()
    assert sum(x["doc_id"] % 6 == 0 for x in got) > 25


def test_scores_against_plain_compression(spark):
    """Window by window with the dictionaries, thresholds and logistic formula written out."""
    import math

    import zstandard

    rows, labels = corpus(600, seed=3)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=15, hash_log=15, search_log=6, min_match=6, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )

    def length(content, window):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress(window))

    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(docs, model).collect()}
    for i, text, *_ in rows[:25]:
        margins = sorted((length(model.ordinary, w) - length(model.toxic + model.ordinary, w) for w in toxicity.windows(text.lower().encode())), reverse=True)
        n, high, very = len(margins), sum(m >= 3 for m in margins), sum(m >= 5 for m in margins)
        facts = [*(margins + [0, 0])[:3], min(10, high), min(10, very), high / n, very / n, math.log(n)]
        z = sum((f - c) / s * w for f, c, s, w in zip(facts, model.center, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9
