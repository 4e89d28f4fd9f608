"""Greedy fills of a budget: a conversation's transcript by priority, and a profile's facts without near repeats.

Both are sequential by nature, so they run on what a bounded cut leaves: a
conversation's newest messages, thirty documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import truncate

# Messages and characters of a transcript, facts and items of a profile.
MESSAGES, TRANSCRIPT_CHARS, USER_CHARS, OTHER_CHARS, TOOL_CHARS = 100, 8000, 200, 500, 500
TOOL_MARKS = ("[tool_use", "[tool_result")
FACTS, FACT_CHARS, ITEMS, ITEM_CHARS = 30, 2000, 10, 1200
#: The request, the last answer, tools, the rest, the system's messages.
REQUEST, ANSWER, TOOL, TALK, SYSTEM = range(5)


def classes(roles: Sequence[str], texts: Sequence[str]) -> list[int]:
    """The class of each message of a conversation, in order."""
    tool = [any(m in t for m in TOOL_MARKS) for t in texts]
    last = max((i for i, (r, t) in enumerate(zip(roles, tool, strict=True)) if r == "assistant" and not t), default=-1)
    first = next((i for i, (r, t) in enumerate(zip(roles, tool, strict=True)) if r == "user" and not t), -1)
    return [TOOL if t else REQUEST if i == first else ANSWER if i == last else SYSTEM if r == "system" else TALK for i, (r, t) in enumerate(zip(roles, tool, strict=True))]


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def filled(roles: Sequence[str], texts: Sequence[str], budget: int = TRANSCRIPT_CHARS) -> list[tuple[int, int, str]]:
    """(place, class, line) of the messages that a transcript has room for, in their own order.

    The request and the answer are always in, cut to twice a message's length.
    Tools come next and are cut to what room is left; of the rest each message
    that fits is taken and one that doesn't is passed over.  The system's are left out.
    """
    kinds = classes(roles, texts)
    limit = [USER_CHARS if r == "user" else OTHER_CHARS for r in roles]
    of = lambda *which: [i for i, k in enumerate(kinds) if k in which]
    lines = {i: f"[{roles[i]}]: {_short(texts[i], 2 * limit[i])}" for i in of(REQUEST, ANSWER)}
    used = sum(len(x) + 1 for x in lines.values())
    for i in of(TOOL):
        head = f"[{roles[i]}]: "
        room = budget - used - len(head) - 1
        if room <= 20:
            break
        most = min(TOOL_CHARS, room)
        lines[i] = head + (texts[i] if len(texts[i]) <= most else texts[i][: most - 3] + "...")
        used += len(lines[i]) + 1
    for i in of(TALK):
        line = f"[{roles[i]}]: {_short(texts[i], limit[i])}"
        if used + len(line) + 1 <= budget:
            lines[i] = line
            used += len(line) + 1
    return [(i, kinds[i], lines[i]) for i in sorted(lines)]


def transcripts(turns: DataFrame, budget: int = TRANSCRIPT_CHARS, most: int = MESSAGES) -> DataFrame:
    """(conv_id, turn, class, line): each conversation's newest ``most`` messages as ``filled`` lays them out.

    The newest are told by a window with a rank limit, which keeps ``most`` rows
    of a conversation for each task before anything is shuffled.  Null roles and
    texts are empty.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", place).where(F.col("n") <= most).drop("n")

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("turn", kind="stable")
        got = filled(part.role.tolist(), part.text.tolist(), budget)
        out = part.iloc[[i for i, _, _ in got]][["conv_id", "turn"]].copy()
        return out.assign(**{"class": [k for _, k, _ in got], "line": [x for _, _, x in got]})

    kinds = dict(turns.dtypes)
    return rows.groupBy("conv_id").applyInPandas(lay, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, class int, line string")


def within(facts: Iterable[str], most: int, chars: int) -> list[str]:
    """The first ``most`` facts up to the one that no longer fits."""
    out: list[str] = []
    for fact in list(facts)[:most]:
        if sum(map(len, out)) + len(fact) > chars:
            break
        out.append(fact)
    return out


def _near(a: str, b: str, under: int = 5) -> bool:
    """Whether fewer than ``under`` edits make one key the other."""
    if abs(len(a) - len(b)) >= under:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) >= under:
            return False
    return row[-1] < under


def different(bullets: Iterable[str], most: int = FACTS) -> list[str]:
    """The first ``most`` bullets that are no repeats: by the first 60 letters, up to four edits."""
    keys: list[str] = []
    out: list[str] = []
    for bullet in bullets:
        key = bullet.lower().strip()[:60]
        if not any(_near(key, k) for k in keys):
            keys.append(key)
            out.append(bullet)
            if len(out) == most:
                break
    return out


def profile_facts(docs: DataFrame, decisions: int = 20, hubs: int = 10) -> list[str]:
    """What is known of a user: bullets of the newest decisions, then of hubs, without near repeats, thirty and 2,000 characters at most.

    ``docs``: id, content_type, body, active, effective_at, modified_at.
    Bullets are found where the texts are and read in order until there are enough.
    """
    newest = lambda kind, at, most, part: docs.where(F.col("active") & (F.col("content_type") == kind)).orderBy(F.desc(at), "id").limit(most).select(F.lit(part).alias("part"), F.unix_micros(at).alias("at"), "id", "body")
    cut = newest("decision", "effective_at", decisions, 0).unionByName(newest("hub", "modified_at", hubs, 1))
    lines = cut.select("part", "at", "id", F.posexplode(F.split("body", "\n", -1)).alias("k", "line"))
    found = lines.select("part", "at", "id", "k", F.trim(F.regexp_extract("line", r"^[-*]\s+(.{10,200})", 1)).alias("bullet")).where("bullet <> ''")
    rows = found.orderBy("part", F.desc("at"), "id", "k").select("bullet").toLocalIterator()
    return within(different(r["bullet"] for r in rows), FACTS, FACT_CHARS)


def section(body: str, name: str) -> str | None:
    """The line under a heading; None if it is empty or says little."""
    m = re.search(rf"^#{{1,3}}\s+{re.escape(name)}\b[^\n]*\n([^\n]*)", body, re.M | re.I)
    text = m[1].strip() if m else ""
    return text if len(text) > 10 else None


def profile_items(handoffs: Sequence[str], progress: Sequence[tuple[str, str]]) -> list[str]:
    """What a user is at: states and next steps of handoffs, newest first, then (title, day) of recent progress."""
    out = []
    for body in handoffs:
        out += [f"{label}: {truncate(text, 150)}" for label, name in (("Current", "Current State"), ("Next", "Next Session Should")) if (text := section(body, name))]
    out += [f"Progress: {title} ({day})" for title, day in progress]
    return within(out, ITEMS, ITEM_CHARS)


def profile_text(facts: Sequence[str], items: Sequence[str]) -> str:
    lines = ["---", "content_type: hub", "tags: [auto-generated, profile]", "---", "", "# User Profile", ""]
    for title, part in (("## Known Context", facts), ("## Current Focus", items)):
        if part:
            lines += [title, "", *[f"- {x}" for x in part], ""]
    return "\n".join(lines)
