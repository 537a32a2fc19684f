"""Tables of many rows are never broadcast by Spark's own estimate, and results do not depend on how tables are joined."""

import pytest

from pagelode import store
from pagelode.operators import evidence as ev
from pagelode.operators import retrieval as rt
from pagelode.operators import scoring
from pagelode.operators import sufficiency as sf
from pagelode.plans import report_queries as rq
from pagelode.store import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def planned(spark, monkeypatch):
    """Plans as they stand before they run, with tables of more than 50 rows counted as large."""
    # a written table or one read from suppliers is below it, what joins give is expected to be far larger
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    if hasattr(store, "BROADCAST_ROWS"):
        monkeypatch.setattr(store, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(rt, "BROADCAST_HITS", 50)
    yield lambda df: df._jdf.queryExecution().sparkPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_no_broadcast_of_exploded_rows(spark, planned, method):
    q, nodes = rq.report_queries(spark, SMALL), rq.report_nodes(spark, SMALL)
    found, _, items = rt.search(q, rt.node_items(nodes), method, 2, "document")
    hits = rt.as_hits(found, items, method)
    assert q.count() > 50
    for df in (found, hits, sf.cases(q, hits, 2)):
        assert "SortMergeJoin" in planned(df) and "Broadcast" not in planned(df)


def test_no_broadcast_of_candidates(spark, planned):
    assert "Broadcast" not in planned(rq.report_candidates(spark, SMALL))
    assert "Broadcast" not in planned(rq.report_breakdowns(spark, SMALL))
    assert "Broadcast" not in planned(rq.report_evidence_set(spark, SMALL))


def test_scores_by_either_join(spark, monkeypatch):
    q, nodes = rq.report_queries(spark, SMALL), rq.report_nodes(spark, SMALL)
    q, items = rt.with_scope(q, materialize(rt.node_items(nodes), "items"), "document")
    shown = lambda: sorted(map(tuple, scoring.top_k(q, items, scoring.bm25(q, items), 3).select("query_id", "item", "rank").collect()))
    few = shown()
    monkeypatch.setattr(store, "BROADCAST_ROWS", 5)
    assert len(few) > 50 and shown() == few


def test_scores_are_computed_once(spark):
    """The best of a question are read twice (to fill up, and as they are), so they are written."""
    q = spark.createDataFrame([("q", "d"), ("r", "d")], "query_id string, scope string")
    items = spark.createDataFrame([("d", f"i{k}", k) for k in range(5)], "scope string, item string, ord long")
    same = lambda batches: batches
    scores = q.join(items, "scope").where("ord < 2").selectExpr("query_id", "scope", "item", "ord", "1D / (ord + 1) AS score")
    scores = scores.mapInArrow(same, scores.schema)
    best = scoring.top_k(q, items, scores, 3)
    assert "MapInArrow" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query_id"], r["item"], r["rank"]) for r in best.collect()) == [(q, f"i{k}", k + 1) for q in "qr" for k in range(3)]


def test_fusion_reads_the_texts_once(spark, monkeypatch):
    from pagelode.operators.index import TextIndex
    from pagelode.plans import queries

    built, build = [], TextIndex.build.__func__
    monkeypatch.setattr(TextIndex, "build", classmethod(lambda cls, *a, **b: built.append(1) or build(cls, *a, **b)))
    assert queries.rrf_fusion(spark, SMALL).count() and len(built) == 1


def test_evidence_sets_leave_only_their_hits(spark, monkeypatch):
    """What a slice of documents writes goes with it, and results don't depend on slices."""
    shown = lambda: sorted(map(tuple, rq.report_evidence_set(spark, SMALL).collect()))
    before = set(store._written)
    whole = shown()
    left = sorted(path.rsplit("/", 1)[1] for path in store._written if path not in before)
    assert left == ["evidence_hits", "report_queries"] and len(whole) == 400
    monkeypatch.setattr(ev, "SLICE", 30)
    runs, run = [], ev._evidence_set
    monkeypatch.setattr(ev, "_evidence_set", lambda *a: runs.append(1) or run(*a))
    assert shown() == whole and len(runs) == 3


@pytest.mark.parametrize("scorer", [scoring.bm25, scoring.tfidf])
def test_scores_by_asked_tokens_or_all(spark, monkeypatch, scorer):
    """Only asked tokens of an item are scored; scopes that ask for many keep all, with the same scores."""
    q, nodes = rq.report_queries(spark, SMALL), rq.report_nodes(spark, SMALL)
    q, items = rt.with_scope(q, materialize(rt.node_items(nodes), "items"), "document")
    shown = lambda: sorted((r["query_id"], r["item"], round(r["score"], 9)) for r in scorer(q, items).collect())
    few = shown()
    monkeypatch.setattr(scoring, "ASKED", 1)
    assert len(few) > 50 and shown() == few
