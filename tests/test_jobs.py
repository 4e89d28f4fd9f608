"""Ledger, leases, fences, the journal and the streams that work once for each batch."""

import threading

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import jobs
from skeinlake.sources.leases import FencedTable, Leases, Stale
from skeinlake.sources.ledger import Ledger
from skeinlake.streaming import streams, workers


def test_an_entry_is_put_once(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/log")
    assert ledger.latest() == (-1, {}) and ledger.versions() == []
    assert ledger.put(0, {"a": 1}) and not ledger.put(0, {"a": 2}) and ledger.put(1, {"ä": [1, None]})
    assert ledger.get(0) == {"a": 1} and ledger.latest() == (1, {"ä": [1, None]})
    ledger.drop_before(1)
    assert ledger.versions() == [1] and not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_")]


def test_leases(spark, tmp_path):
    a = Leases(spark, str(tmp_path))
    one = a.acquire("w", 10, now=100.0)
    assert one and a.acquire("w", 10, now=109.9) is None and a.acquire("other", 10, now=100.0)
    longer = a.renew(one, 10, now=105.0)
    assert longer.fence == one.fence and a.acquire("w", 10, now=114.0) is None
    two = a.acquire("w", 10, now=115.0)
    assert two.fence > one.fence and not a.holds(longer) and a.renew(longer, 10, now=115.0) is None and not a.release(longer)
    assert a.release(two) and a.acquire("w", 10, now=115.0).fence > two.fence
    with pytest.raises(ValueError):
        a.acquire("w", 0)
    with pytest.raises(ZeroDivisionError):
        a.under("v", 10, lambda lease: 1 / 0, now=1.0)
    assert a.under("v", 10, lambda lease: lease.fence, now=2.0)[0], "given back after the failure"


def test_of_two_writers_one_wins(spark, tmp_path):
    won = []

    def take():
        if (lease := Leases(spark, str(tmp_path)).acquire("w", 60, now=1.0)) is not None:
            won.append(lease)

    threads = [threading.Thread(target=take) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1


def fragments(spark, texts):
    return spark.createDataFrame([(i, k, t) for (i, k), t in texts.items()], "id long, seq long, content string")


def test_embedding_is_fenced_and_goes_on(spark, tmp_path):
    leases, table = Leases(spark, f"{tmp_path}/leases"), FencedTable(spark, f"{tmp_path}/vectors", jobs.VECTORS.format(id="bigint"))
    texts = {(1, 0): "aa", (1, 1): "bad", (2, 0): "cccc", (3, 0): None, (4, 0): "odd"}

    def embed(batch):
        if "bad" in batch:
            raise RuntimeError("no")
        return [[1.0] if t == "odd" else [float(len(t)), 1.0] for t in batch]

    old = leases.acquire("embed", 10, now=0.0)
    new = leases.acquire("embed", 10, now=20.0)
    with pytest.raises(Stale):
        jobs.embed_job(fragments(spark, texts), table, leases, old, embed, 2)
    assert jobs.embed_job(fragments(spark, texts), table, leases, new, embed, 2, key="b1")
    with pytest.raises(Stale):
        table.commit(spark.createDataFrame([], jobs.VECTORS.format(id="bigint")), old.fence)
    assert not jobs.embed_job(fragments(spark, texts), table, leases, new, embed, 2, key="b1"), "the batch is there"
    rows = {(r["id"], r["seq"]): (r["state"], r["attempts"], r["error"]) for r in table.read().collect()}
    assert rows == {(1, 0): ("synced", 0, None), (2, 0): ("synced", 0, None), (3, 0): ("synced", 0, None), (1, 1): ("failed", 1, "no"), (4, 0): ("failed", 1, "1 components")}

    tried = lambda: {(r["id"], r["seq"], r["attempts"]) for r in jobs.embedding_backlog(fragments(spark, texts), table.read()).collect()}
    assert tried() == {(1, 1, 1), (4, 0, 1)}
    for k in (2, 3):
        jobs.embed_job(fragments(spark, texts), table, leases, new, embed, 2, key=f"b{k}")
    assert tried() == set(), "three failures are enough"
    texts |= {(1, 1): "good", (2, 0): "c"}
    assert tried() == {(1, 1, 0), (2, 0, 0)}, "until the content changes"
    jobs.embed_job(fragments(spark, texts), table, leases, new, embed, 2)
    got = {(r["id"], r["seq"]): r["embedding"] for r in jobs.current_vectors(table, fragments(spark, texts)).collect()}
    assert got == {(1, 0): [2.0, 1.0], (1, 1): [4.0, 1.0], (2, 0): [1.0, 1.0], (3, 0): [0.0, 1.0]}


def test_gate(spark):
    usages = spark.createDataFrame([(k,) for k in ("2024-01-01 02:55:00", "2024-01-01 02:59:00", "2024-01-01 02:00:00")], "t string").select(F.to_timestamp("t").alias("ts"))
    now = F.to_timestamp(F.lit("2024-01-01 03:00:00"))
    ask = lambda **k: tuple(jobs.gate_of(usages, now, F.hour(now), **k).first())
    assert ask() == (True, None) and ask(most=1) == (False, "query_rate_high") and ask(most=2) == (True, None)
    assert ask(window=(2, 4)) == (True, None) and ask(window=(22, 4)) == (True, None) and ask(window=(22, 3)) == (False, "outside_window")


def test_ticks_are_written_down_and_not_run_twice(spark, tmp_path):
    journal, leases, done = jobs.Journal(spark, f"{tmp_path}/journal"), Leases(spark, f"{tmp_path}/leases"), []

    def good(run):
        done.append("good")
        run.selected, run.metrics = 3, {"b": 1}

    def bad(run):
        done.append("bad")
        raise RuntimeError("broken")

    phases = {"consolidate": bad, "deductive": good}
    assert jobs.tick(journal, leases, "r1", phases) == ["failed", "completed"]
    assert jobs.tick(journal, leases, "r1", phases) == ["known", "known"] and done == ["bad", "good"]
    held = leases.acquire("heavy-lane", 1000)
    assert jobs.tick(journal, leases, "r2", phases) == ["skipped"] and leases.release(held)
    assert jobs.tick(journal, leases, "r3", phases, gate="outside_window") == ["skipped"]
    journal.open(jobs.Run("r4", "heavy", "consolidate"))
    rows = {(r["run"], r["phase"]): (r["status"], r["reason"], r["selected"], r["metrics"]) for r in journal.runs().collect()}
    assert rows == {
        ("r1", "consolidate"): ("failed", "consolidate_exception", 0, '{"error": "broken"}'),
        ("r1", "deductive"): ("completed", None, 3, '{"b": 1}'),
        ("r2", "gate"): ("skipped", "lease_unavailable", 0, "{}"),
        ("r3", "gate"): ("skipped", "outside_window", 0, "{}"),
        ("r4", "consolidate"): ("started", None, 0, "{}"),
    }


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path):
    """The stream dies before it has written down the second phase; the restarted one plays the batch again."""

    class Fragile(jobs.Journal):
        def finalise(self, run):
            if run.phase == "second" and calls.count("second") == 1:
                raise OSError("the machine is lost")
            return super().finalise(run)

    journal, leases = Fragile(spark, f"{tmp_path}/journal"), Leases(spark, f"{tmp_path}/leases")
    out, calls = FencedTable(spark, f"{tmp_path}/out", "id long"), []
    spark.range(5).write.parquet(f"{tmp_path}/in")

    def phases(rows, number):
        def first(run):
            calls.append("first")
            run.created = rows.count()
            out.commit(rows.select("id"), key=f"{number}")

        def second(run):
            calls.append("second")

        return {"first": first, "second": second}

    def run():
        stream = streams.file_stream(spark, f"{tmp_path}/in", "id long")
        workers.periodic(stream, f"{tmp_path}/checkpoint", journal, leases, phases).awaitTermination()

    with pytest.raises(Exception):  # noqa: B017
        run()
    run()
    assert calls == ["first", "second", "second"] and sorted(r["id"] for r in out.read().collect()) == list(range(5))
    spark.range(5, 7).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r["id"] for r in out.read().collect()) == list(range(7))
    assert {(r["run"], r["phase"], r["status"], r["created"]) for r in journal.runs().collect()} == {
        (f"heavy-{n:012d}", p, "completed", c if p == "first" else 0) for n, c in ((0, 5), (1, 2)) for p in ("first", "second")
    }


def test_paths_that_are_watched(spark):
    cases = {"a/b.md": True, "a/b.txt": False, ".beads/x.jsonl": True, "a/.beads/x.jsonl": True, "a/x.jsonl": False, "node_modules/a.md": False, "a/.git/b.md": False, "mynode_modules/a.md": True}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", workers.watched(F.col("path")).alias("w")).collect()
    assert {r["path"]: r["w"] for r in rows} == cases


def test_bursts_are_debounced(spark, tmp_path):
    """One row for each burst, whether what follows it comes in the same batch or a later one."""
    feed = f"{tmp_path}/in"

    def add(*rows):
        df = spark.createDataFrame(list(rows), "path string, ms long").select("path", F.timestamp_millis("ms").alias("at"))
        df.coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = streams.file_stream(spark, feed, "path string, at timestamp")
        query = workers.debounced(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").select("path", F.unix_millis("first_at").alias("a"), F.unix_millis("last_at").alias("b"), "n")
        return sorted(tuple(r) for r in rows.collect())

    add(("a.md", 1000), ("a.md", 1500), ("a.md", 3400), ("b.md", 2000), ("a.md", 9000))
    assert run() == [("a.md", 1000, 3400, 3), ("b.md", 2000, 2000, 1)], "a.md is quiet from 3.4 on, b.md by the watermark"
    add(("a.md", 10500), ("c.md", 10600))
    assert len(run()) == 2
    add(("z.md", 20000))
    assert run() == [("a.md", 1000, 3400, 3), ("a.md", 9000, 10500, 2), ("b.md", 2000, 2000, 1), ("c.md", 10600, 10600, 1)]
