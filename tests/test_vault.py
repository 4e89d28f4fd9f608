"""The facade gives the rows of the plans it names."""

import pytest

from skeinlake.vault import Vault


@pytest.fixture(scope="module")
def vault(spark):
    return Vault(spark, "/root/testdata/sf0.001")


def test_retrieval(vault):
    hits = vault.search("the tion", 5).collect()
    assert len(hits) == 5 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    own = vault.vectors.where("id = 3").first()["embedding"]
    first = vault.vsearch(own, 3).where("place = 1").first()
    assert first["id"] == 3 and first["score"] == pytest.approx(1)
    assert 3 not in {r["id"] for r in vault.find_similar(3).collect()}
    assert vault.mode("why was it so") == "causal" and vault.mode("what did we do yesterday") == "timeline"
    assert vault.intent("why was it blocked")[0] == "WHY"
    assert vault.memory_retrieve("what happened last", 3, focus=42).count() >= 3


def test_modes_with_vectors(vault):
    own = [float(x) for x in vault.vectors.where("id = 3").first()["embedding"]]
    assert vault.memory_retrieve("explain the concept", own, 3).orderBy("score", ascending=False).first()["id"] == 3
    for found in (vault.memory_retrieve("why was it so", own, 3), vault.intent_search("why was it so", own, 3), vault.query_plan("the tion", own, 3)):
        assert 0 < found.count() <= 3
    with pytest.raises(ValueError):
        vault.intent_search("why")


def test_acts_change_what_is_there(spark):
    vault = Vault(spark, "/root/testdata/sf0.001")
    rows = lambda: {r["id"]: r for r in vault.documents.where("id in (1, 2, 3, 19)").collect()}
    before = rows()
    assert before[1]["active"] and not before[1]["pinned"] and not before[19]["active"]
    vault.pin(1, 2)
    vault.pin(2, unpin=True)
    vault.snooze(1, 3, until="2024-05-01 00:00:00")
    vault.snooze(3, until=None)
    vault.forget(2)
    vault.restore(19)
    vault.touch(1)
    vault.touch(1, 999)
    after = rows()
    assert (after[1]["pinned"], after[2]["pinned"], after[2]["active"], after[19]["active"]) == (True, False, False, True)
    assert str(after[1]["snoozed_until"]) == "2024-05-01 00:00:00" and after[3]["snoozed_until"] is None
    assert after[1]["access_count"] == before[1]["access_count"] + 2 and after[3]["access_count"] == before[3]["access_count"]
    assert 2 not in {r["id"] for r in vault.search("the", 500).collect()}
    assert vault.documents.count() == 200 and vault.status().agg({"documents": "sum"}).first()[0] == 200


def test_export(spark, vault, tmp_path):
    vault.export(f"{tmp_path}/out", ("src1",))
    assert spark.read.json(f"{tmp_path}/out").count() == vault.documents.where("active and collection = 'src1'").count() > 0


def test_lookup_and_lifecycle(vault):
    path = vault.documents.where("id = 42").first()["path"]
    assert vault.get(path).first()["id"] == 42 and vault.get(path[4:]).first()["id"] == 42
    assert {r["id"] for r in vault.multi_get(path).collect()} == {42}
    steps = {r["steps"] for r in vault.timeline(42, 2).collect()}
    assert 0 in steps and steps <= {-2, -1, 0, 1, 2}
    assert vault.lifecycle_sweep().count() > 0 and vault.recall_stats().count() > 0
    assert all(str(r["valid_from"]) <= "1997-01-01" for r in vault.kg_query(7, "1997-01-01").collect())
    backbone, near = vault.build_graphs()
    assert backbone.count() == vault.documents.where("active").count() - 1 and near.count() >= 0
