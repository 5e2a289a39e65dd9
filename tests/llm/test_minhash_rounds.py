"""Components of near-duplicates are not found again where no new link came."""

from lectern.llm import minhash


def test_components_are_found_once_where_the_first_links_are_all(spark, monkeypatch):
    calls, real = [], minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda *a, **k: calls.append(1) or real(*a, **k))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(f"v{i}" for i in range(60)))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert len(calls) == 1
