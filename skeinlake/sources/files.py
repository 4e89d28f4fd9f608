"""File sources and sinks: collections of text files, conversation exports, issue trackers, JSON export."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import front_matter
from ..functions.text import glob_regex

# Folders that are never scanned, and how dependencies of issues become edges.
SKIPPED = ("node_modules", "dist", "build", "vendor")
ISSUE_RELATIONS = {
    **dict.fromkeys(("blocks", "conditional-blocks", "waits-for", "caused-by"), "causal"),
    **dict.fromkeys(("discovered-from", "supersedes", "duplicates"), "supporting"),
    **dict.fromkeys(("relates-to", "related", "parent-child"), "semantic"),
}


def collection(spark: SparkSession, path: str, glob: str = "**/*.md") -> DataFrame:
    """(path, body, modified_at) of the files of a folder that match, without hidden and build folders; paths from the folder on."""
    root = "/" + path.rstrip("/").split("://")[-1].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.substring_index("path", root + "/", -1).alias("path"), F.decode("content", "utf-8").alias("body"), F.col("modificationTime").alias("modified_at"))
    hidden = "(^|/)(\\.[^/]*|" + "|".join(SKIPPED) + ")/"
    return rows.where(F.col("path").rlike(glob_regex(glob)) & ~F.col("path").rlike(hidden))


def with_front_matter(docs: DataFrame) -> DataFrame:
    """``docs`` with a map of their header's fields and the body without it; what is no header stays body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parsed = [front_matter(b or "") for b in rows.body]
            yield rows.assign(meta=[m for m, _ in parsed], body=[b for _, b in parsed])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, kinds + ", meta map<string,string>")


def messages(text: str, name: str = "") -> list[dict[str, str | None]]:
    """role, content and time of each message of an exported conversation; empty if no format fits.

    The first format that fits counts: JSON lines of sessions (type and
    message), JSON lines of event logs after a ``session_meta`` line, lists of
    messages, alone, wrapped or as exports of several conversations, trees of
    messages by id, chats of two speakers, and plain text with both roles as
    prefixes.  Lines that aren't JSON are passed over.  Two messages at least,
    of plain text four.  Times are UTC, null where they are no full instant.
    """
    body = text.strip()
    if not body:
        return []
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if end == "jsonl" or (body.startswith("{") and "\n{" in text):
        rows = [r for r in map(_parsed, body.split("\n")) if isinstance(r, dict)]
        for reader in (_sessions, _events):
            if len(found := reader(rows)) >= 2:
                return found
    if end == "json" or body[0] in "{[":
        data = _parsed(body)
        for reader in (_lists, _tree, _chat) if data is not None else ():
            if len(found := reader(data)) >= 2:
                return found
    plain = _plain(text.split("\n"))
    return plain if len(plain) >= 4 and len({m["role"] for m in plain}) == 2 else []


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _said(role: str | None, content: str, at: str | None) -> list[dict[str, str | None]]:
    return [{"role": role, "content": content, "timestamp": at}] if role and content else []


def _content(value) -> str:
    """Text of a string, of the text blocks of a list, or of a block."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return " ".join(x if isinstance(x, str) else (x.get("text") or "") if isinstance(x, dict) and x.get("type") == "text" else "" for x in value).strip()
    return str(value.get("text") or "").strip() if isinstance(value, dict) else ""


_INSTANT = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def instant(value) -> str | None:
    """An ISO instant in UTC to the millisecond; null for dates that don't exist and times without an offset."""
    m = _INSTANT.fullmatch(value.strip()) if isinstance(value, str) else None
    if not m:
        return None
    try:
        at = datetime(*map(int, m.groups()[:6]), tzinfo=UTC)
        zone = m[8]
        if zone not in "Zz":
            if int(zone[1:3]) > 23 or int(zone[4:]) > 59:
                return None
            at -= (-1 if zone[0] == "-" else 1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:]))
        at += timedelta(milliseconds=round(float("0" + m[7]) * 1000) if m[7] else 0)
    except (ValueError, OverflowError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def from_epoch(seconds) -> str | None:
    if isinstance(seconds, bool) or not isinstance(seconds, int | float):
        return None
    try:
        at = datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=int(seconds * 1000))
    except (ValueError, OverflowError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _sessions(rows: list[dict]) -> list:
    roles = {"human": "user", "user": "user", "assistant": "assistant"}
    return [m for r in rows for m in _said(roles.get(r.get("type")), _content((r.get("message") or {}).get("content") if isinstance(r.get("message"), dict) else None), instant(r.get("timestamp")))]


def _events(rows: list[dict]) -> list:
    if not any(r.get("type") == "session_meta" for r in rows):
        return []
    roles = {"user_message": "user", "agent_message": "assistant"}
    out = []
    for r in rows:
        said = r.get("payload")
        if r.get("type") == "event_msg" and isinstance(said, dict) and isinstance(said.get("message"), str):
            out += _said(roles.get(said.get("type")), said["message"].strip(), instant(r.get("timestamp")))
    return out


def _lists(data) -> list:
    roles = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
    if isinstance(data, list) and data and isinstance(data[0], dict) and data[0].get("chat_messages"):
        rows = [m for talk in data if isinstance(talk, dict) for m in talk.get("chat_messages") or []]
    elif isinstance(data, dict):
        rows = data["messages"] if data.get("messages") is not None else data.get("chat_messages") or []
    else:
        rows = data
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return [m for r in rows for m in _said(roles.get(r.get("role")), _content(r.get("content")), instant(r.get("created_at")))]


def _tree(data) -> list:
    """Messages from the root down, along first children; a root without a message goes before one with."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    roots = [k for k, n in nodes.items() if isinstance(n, dict) and "parent" in n and n["parent"] is None]
    now = next((k for k in roots if not nodes[k].get("message")), roots[0] if roots else None)
    out, seen = [], set()
    while now is not None and now not in seen and isinstance(nodes.get(now), dict):
        seen.add(now)
        if m := nodes[now].get("message"):
            role = (m.get("author") or {}).get("role")
            parts = (m.get("content") or {}).get("parts") or []
            out += _said(role if role in ("user", "assistant") else None, " ".join(p for p in parts if isinstance(p, str)).strip(), from_epoch(m.get("create_time")))
        now = next(iter(nodes[now].get("children") or []), None)
    return out


def _chat(data) -> list:
    """A chat of exactly two speakers, the first of whom is the user."""
    rows = [r for r in data if isinstance(r, dict) and r.get("type") == "message"] if isinstance(data, list) else []
    who = lambda r: r["user"] if r.get("user") is not None else r.get("username") or ""
    names = list(dict.fromkeys(who(r) for r in rows if who(r)))
    if len(names) != 2:
        return []
    at = lambda ts: from_epoch(float(ts)) if isinstance(ts, str) and re.fullmatch(r"\d{10}\.\d+", ts) else None
    return [m for r in rows if who(r) for m in _said(("user", "assistant")[names.index(who(r))], str(r.get("text") or "").strip(), at(r.get("ts")))]


# The prefixes of roles in plain text.
_USER, _ASSISTANT = r"(?:User|Human)\s*:\s*", r"(?:Assistant|AI|Claude|GPT|Bot)\s*:\s*"


def _plain(lines: list[str]) -> list[dict[str, str | None]]:
    out: list[tuple[str, list[str]]] = []
    for line in map(str.strip, lines):
        for role, prefix in (("user", _USER), ("assistant", _ASSISTANT)):
            if m := re.match(prefix, line, re.I):
                out.append((role, [line[m.end() :]]))
                break
        else:
            if out:
                out[-1][1].append(line)
    return [m for role, said in out for m in _said(role, "\n".join(said).strip(), None)]


# What a scan of a folder of conversations takes, and folders it passes over.
CONVERSATION_FILES = ("txt", "md", "json", "jsonl")
CONVERSATION_SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".mempalace", ".grepai", "tool-results")


def conversation_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of the files of a folder that may be conversations."""
    root = "/" + path.rstrip("/").split("://")[-1].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.substring_index("path", root + "/", -1).alias("path"), F.decode("content", "utf-8").alias("body"))
    skipped = "(^|/)(" + "|".join(re.escape(d) for d in CONVERSATION_SKIPPED) + ")/"
    return rows.where(F.lower("path").rlike(r"\.(" + "|".join(CONVERSATION_FILES) + ")$") & ~F.col("path").rlike(skipped))


def conversations(files: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, timestamp) of files (path, body); files of no known format give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(p, k, m["role"], m["content"], m["timestamp"]) for p, b in zip(rows.path, rows.body, strict=True) for k, m in enumerate(messages(b or "", p or ""))]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "timestamp"])

    return files.select("path", "body").mapInPandas(run, "conv_id string, turn long, role string, text string, timestamp string")


def issues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Issues (id, title, body) and edges (src, dst, rel) of a tracker's JSON lines; loops are left out."""
    schema = "id string, title string, description string, status string, dependencies array<struct<depends_on_id: string, type: string>>"
    rows = spark.read.schema(schema).json(path)
    edges = rows.select(F.col("id").alias("dst"), F.explode("dependencies").alias("d")).select(F.col("d.depends_on_id").alias("src"), "dst", relation_of(F.col("d.type")).alias("rel"))
    return rows.select("id", "title", F.col("description").alias("body"), "status"), edges.where("src <> dst").distinct()


def relation_of(kind: Column) -> Column:
    out = F.lit("semantic")
    for name, rel in ISSUE_RELATIONS.items():
        out = F.when(kind == name, rel).otherwise(out)
    return out


def export_json(docs: DataFrame, path: str) -> None:
    """One JSON object for each active document."""
    docs.where("active").drop("active").write.mode("overwrite").json(path)


def formatted(results: DataFrame, kind: str) -> DataFrame:
    """(line) for each result: json, csv, files, md or xml."""
    cells = [F.col(c).cast("string") for c in results.columns]
    quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in cells]
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = {
        "json": lambda: F.to_json(F.struct(*results.columns)),
        "csv": lambda: F.concat_ws(",", *quoted),
        "files": lambda: F.col("path"),
        "md": lambda: F.concat(F.lit("- "), F.concat_ws(" | ", *cells)),
        "xml": lambda: F.concat(F.lit("<result>"), *[F.concat(F.lit(f"<{n}>"), escaped(c), F.lit(f"</{n}>")) for n, c in zip(results.columns, cells, strict=True)], F.lit("</result>")),
    }[kind]()
    return results.select(line.alias("line"))
