"""Reassembly against a simulation, row by row, of what the batches say."""

import random
from collections import defaultdict

import pytest

from skeinlake.llm import queries, turns


def simulate(arrivals, batches, patience):
    """Events as sorted tuples of the operator's columns."""
    firsts, by_batch = {}, [defaultdict(list) for _ in range(batches)]
    for conv, turn, role, text, batch in arrivals:
        if turn is not None:
            firsts[conv] = min(firsts.get(conv, turn), turn)
            by_batch[batch][conv, turn].append((f"{role or ''}|{text or ''}".encode(), role or "", text or ""))
    out, kept, given, last, closed = [], defaultdict(dict), defaultdict(set), {}, set()

    def close(conv, batch):
        held = kept[conv]
        breaks = sum(t - 1 in held and held[t - 1][0] == held[t][0] for t in held)
        out.append(("close", conv, -1, batch, None, None, ",".join(str(t) for t in sorted(held) if t not in given[conv]), max(held) - firsts[conv] + 1 - len(held), breaks))
        closed.add(conv)

    for b in range(batches):
        for (conv, turn), rows in by_batch[b].items():
            _, role, text = min(rows)
            if conv in closed:
                out.append(("reject", conv, turn, b, role, text, None, None, None))
            else:
                last[conv] = b
                kept[conv].setdefault(turn, (role, text))
        for conv in [c for c in last if c not in closed]:
            t = firsts[conv]
            while t in kept[conv]:
                if t not in given[conv]:
                    given[conv].add(t)
                    out.append(("release", conv, t, b, *kept[conv][t], None, None, None))
                t += 1
            if b - last[conv] >= patience:
                close(conv, b)
    for conv in [c for c in last if c not in closed]:
        close(conv, batches)
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("event", "conv_id", "turn", "batch", "role", "text", "pending", "n_missing", "n_breaks").collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, batch int, seg long, n string"


@pytest.mark.parametrize("seed", [1, 2])
def test_events_match_a_simulation(spark, monkeypatch, seed):
    """Short conversations, some with gaps, some that end early; long ones that are cut into segments of four."""
    monkeypatch.setattr(turns, "BUCKET_ROWS", 25)
    rng = random.Random(seed)
    arrivals = []
    for conv in [None, -5, *range(60)]:
        base, n = rng.choice([0, 3, -2]), rng.choice([1, 2, 4, 5, 9, 30])
        span = sorted(rng.sample(range(8), rng.choice([1, 2, 3, 8])))
        for turn in range(base, base + n):
            if n > 2 and rng.random() < 0.08:
                continue
            for _ in range(rng.choice([1, 1, 1, 2, 4])):
                arrivals.append((conv, turn, rng.choice(["user", "assistant", None, "a|b"]), rng.choice(["x", "é", "", None, f"t{turn}"]), rng.choice(span)))
    arrivals += arrivals[::7] + [(3, None, "user", "lost", 0)]
    rng.shuffle(arrivals)
    df = spark.createDataFrame([(*a, 7, "n") for a in arrivals], SCHEMA)
    want = simulate(arrivals, 8, 3)
    assert rows_of(turns.reassemble(df, segment=4)) == want
    assert {e[0] for e in want} == {"release", "reject", "close"}


def test_far_numbers_and_empty_batches(spark):
    arrivals = [(1, 0, "u", "a", 2), (1, 10**12, "u", "b", 2), (2, 5, "u", "c", 0), (2, 6, "u", "d", 7), (3, -(2**62), "u", "e", 1), (3, 2**62, "u", "f", 1)]
    df = spark.createDataFrame([(*a, 7, "n") for a in arrivals], SCHEMA)
    assert rows_of(turns.reassemble(df)) == simulate(arrivals, 8, 3)
    assert turns.reassemble(df.limit(0)).count() == 0


def test_query_on_odd_rows(spark, tmp_path):
    """The batches of the registered query, by the same hash in Python."""
    import hashlib

    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["x", "y", None])) for c in [None, *range(40)] for t in range(rng.randrange(1, 9))]
    rows += rows[:5] + [(1, None, "user", "lost")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, extra string").write.parquet(f"{tmp_path}/conversations.parquet")
    arrivals = []
    for c, t, role, text in rows:
        if t is not None:
            h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
            arrivals.append((c, t, role, text, h % 8))
            if h % 7 < 2:
                arrivals.append((c, t, "user", text, (h + 3) % 8))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((e, digest(p if e == "close" else f"{r}|{x}"), c, t, b, m, k) for e, c, t, b, r, x, p, m, k in simulate(arrivals, 8, 3)), key=repr)
    assert sorted((tuple(r) for r in queries.op12_turn_reassembly(spark, str(tmp_path)).collect()), key=repr) == want
