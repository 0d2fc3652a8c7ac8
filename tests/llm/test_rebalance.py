from collections import Counter

import pytest

from wagetide.llm import slots


def test_rebalance_edits_the_stored_version(spark, tmp_path):
    path = f"{tmp_path}/map"
    rows = [(i, "x" * (i % 97)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(ValueError):
        slots.rebalance(docs, path, 4)
    first = {r["doc_id"]: r for r in slots.shard(docs, 4, n_slots=512, path=path).collect()}
    more = spark.createDataFrame(rows + [(i, "y" * 50) for i in range(3000, 3300)], "doc_id long, text string")
    second = {r["doc_id"]: r for r in slots.rebalance(more, path, 5, n_slots=512).collect()}
    third = {r["doc_id"]: r for r in slots.rebalance(more, path, 5, n_slots=512).collect()}
    assert slots.versions(spark, path) == [1, 2, 3]
    assert {r["map_version"] for r in second.values()} == {2} and {r["map_version"] for r in third.values()} == {3}
    # only a part moves, nearly all of it to the new shard; with nothing to do nothing moves
    moved = [i for i in first if second[i]["shard"] != first[i]["shard"]]
    assert 0 < len(moved) < 0.3 * len(rows) and sum(second[i]["shard"] == 4 for i in moved) > 0.8 * len(moved)
    assert all(third[i]["shard"] == second[i]["shard"] for i in second)
    load, places = Counter(), {}
    for r in second.values():
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(load.values()) <= 1.05 * sum(load.values()) / 5 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.rebalance(more.limit(0), path, 5, n_slots=512).count() == 0 and slots.rebalance(docs, path, 4, n_slots=512).count() == len(rows)
