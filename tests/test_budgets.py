"""Transcripts and profiles by hand and by loops."""

import random

from pyspark.sql import functions as F

from skeinlake.operators import budgets


def test_classes():
    roles = ["system", "assistant", "user", "user", "assistant", "assistant", "user"]
    texts = ["s", "[tool_use x", "hello", "more", "answer", "[tool_result y", "[tool_use in mine"]
    assert budgets.classes(roles, texts) == [budgets.SYSTEM, budgets.TOOL, budgets.REQUEST, budgets.TALK, budgets.ANSWER, budgets.TOOL, budgets.TOOL]


def test_tools_are_cut_and_talk_is_passed_over():
    roles = ["user", "assistant", "user", "assistant", "user", "assistant"]
    texts = ["ask " + "a" * 500, "[tool_use " + "t" * 700, "long " + "b" * 300, "[tool_use " + "u" * 700, "ok", "done"]
    whole = budgets.filled(roles, texts)
    assert [i for i, _, _ in whole] == [0, 1, 2, 3, 4, 5]
    assert [len(x) for _, _, x in whole] == [8 + 403, 13 + 500, 8 + 203, 13 + 500, 8 + 2, 13 + 4]
    tight = budgets.filled(roles, texts, 412 + 18 + 514 + 100 + 12)
    assert [i for i, _, _ in tight] == [0, 1, 3, 5], "the second tool takes what is left"
    room = budgets.filled(roles, texts, 412 + 18 + 514 + 514 + 60)
    assert [i for i, _, _ in room] == [0, 1, 3, 4, 5], "the long message doesn't fit, the short one after it does"


def test_transcripts_of_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["x" * rng.randrange(900), "[tool_use " + "y" * rng.randrange(900), "", None])) for c in (1, 2, None) for t in range(rng.choice([1, 30, 140]))]
    got = {}
    for r in budgets.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=25).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["class"], r["line"]))
    for c in (1, 2, None):
        last = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)[-25:]
        want = [(last[i][0], k, line) for i, k, line in budgets.filled([r for _, r, _ in last], [x for _, _, x in last])]
        assert sorted(got.get(c, [])) == sorted(want)


def test_near_is_an_edit_distance():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        assert budgets._near(a, b) == (distance(a, b) < 5)


def test_profile(spark):
    say = lambda n: f"decision number {n} concerns topic {chr(97 + n % 26) * 9}"
    bodies = [
        (1, "decision", "- " + say(1) + "\n- short\n* " + say(2) + "\nplain\n- " + say(1).upper(), True, 5),
        (2, "decision", "- " + say(3) + "\n- " + say(1) + "!!", True, 9),
        (3, "hub", "- hub fact of some length here\n- " + "long " * 60, True, 1),
        (4, "decision", "- never shown as inactive fact", False, 10),
        (5, "note", "- never shown as it is a note", True, 10),
    ]
    docs = spark.createDataFrame(bodies, "id long, content_type string, body string, active boolean, d int")
    docs = docs.withColumn("effective_at", F.expr("date_add(date'2024-01-01', d)").cast("timestamp")).withColumn("modified_at", F.col("effective_at"))
    got = budgets.profile_facts(docs)
    assert got == [say(3), say(1) + "!!", say(2), "hub fact of some length here", ("long " * 60)[:200].strip()]
    many = budgets.different(f"{chr(97 + n % 26) * 20}{chr(97 + n // 26) * 9}" for n in range(100))
    assert len(many) == 30
    assert budgets.within(["a" * 900, "b" * 900, "c" * 300, "d"], 30, 2000) == ["a" * 900, "b" * 900]


def test_items_and_text():
    body = "# Handoff\n## Current State\nhalf of the import is done\nmore\n## Next session should\n\nfinish the import\n"
    assert budgets.section(body, "Current State") == "half of the import is done"
    assert budgets.section(body, "Next Session Should") is None, "only the line under the heading counts"
    items = budgets.profile_items([body, "nothing"], [("Parser", "2024-01-30")])
    assert items == ["Current: half of the import is done", "Progress: Parser (2024-01-30)"]
    assert budgets.profile_text(["f"], items).split("\n")[7:11] == ["## Known Context", "", "- f", ""]
    assert "## Known Context" not in budgets.profile_text([], items)
