"""Keyword search against SQLite's full-text index, stems word by word, and the composed plans on small tables."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import stem
from skeinlake.operators import mining, models, ranking, retrieval, search

DOCS = [
    (1, "a", "notes/arch.md", "Architecture overview", "The gRPC communication of services is described; before_compaction runs."),
    (2, "a", "notes/q4_k_m.md", "Quantised models", "A model of q4_k_m form. Relational communication communicates."),
    (3, "b", "architecture/plan.md", "Plans", "Caf\u00e9 plans for the ARCHITECTURES, planned and planning. It's agreed."),
    (4, "b", "x/empty.md", "", ""),
    (5, "b", "x/short.md", "Hopping", "Hop hopped hopping; controlling, controlled, rational, conditional, flies, dies, agreed, feed, sized."),
    (6, "a", "x/same.md", "Architecture overview", "The gRPC communication of services is described; before_compaction runs."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, collection string, path string, title string, body string")


@pytest.fixture(scope="module")
def index():
    try:
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table t using fts5(filepath, title, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    db.executemany("insert into t(rowid, filepath, title, body) values (?, ?, ?, ?)", [(i, f"{c}/{p}", t, b) for i, c, p, t, b in DOCS])
    return db


@pytest.mark.parametrize("query", ["architecture", "gRPC communication", "before_compaction", "q4_k_m", "plan", "hop", "cafe", "caf\u00e9 plans", "conditions", "communicate relate", "the", "x", "xyznonexistent123", "a a", '"quoted" (x) AND-OR*'])
def test_scores_are_those_of_the_index(spark, docs, index, query):
    terms = [t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split()]
    match = " AND ".join(f'"{t}"*' for t in terms)
    want = dict(index.execute("select rowid, bm25(t, 10.0, 1.0) from t where t match ?", (match,)).fetchall())
    asked = spark.createDataFrame([(7, query)], "query_id long, term string")
    got = {r["id"]: (r["bm25"], r["score"]) for r in retrieval.bm25(docs, asked).collect()}
    assert got.keys() == want.keys()
    for i, (b, s) in got.items():
        assert b == pytest.approx(want[i], rel=1e-6) and s == pytest.approx(-want[i] / (1 - want[i]), rel=1e-6)


def test_stems_are_those_of_the_index(spark, index):
    text = "caresses ponies ties cats agreed plastered motoring conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational valenci digitizer conformabli radicalli decisiveness callousness formaliti triplicate formative electriciti hopeful goodness revival allowance inference airliner adjustable irritant replacement adoption activate homologous effective bowdlerize probate rate cease controll roll lyaned by is at"
    words = sorted(set(text.split()))
    index.execute("create virtual table w using fts5(a, tokenize='porter unicode61')")
    index.execute("create virtual table v using fts5vocab(w, 'instance')")
    index.executemany("insert into w(rowid, a) values (?, ?)", list(enumerate(words)))
    want = {words[d]: t for t, d in index.execute("select term, doc from v")}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem.stems("array(w)")[0].alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == want
    assert all(s.startswith(stem.reach(s)) and w.startswith(stem.reach(s)) for w, s in want.items()), "no stem is out of its word's reach"


def test_mmr_puts_likenesses_last(spark):
    rows = [(1, k, s, t, "") for k, s, t in ((1, 0.9, "alpha beta gamma delta"), (2, 0.8, "alpha beta gamma delta"), (3, 0.7, "other words entirely here"), (4, 0.6, "alpha beta gamma delta epsilon"))]
    df = spark.createDataFrame(rows, "query_id int, id long, score double, title string, body string")
    order = sorted((r["position"], r["id"]) for r in ranking.mmr_order(df).collect())
    assert [i for _, i in order] == [1, 3, 2, 4]
    assert [i for _, i in sorted((r["position"], r["id"]) for r in ranking.mmr_order(df.where("id < 3")).collect())] == [1, 2]


def test_short_lists_and_whole_tables_blend_alike(spark):
    df = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.1, 0.9), (3, 0.05, None)], "id long, rrf double, rerank double")
    one, two = ({r["id"]: r["blended"] for r in ranking.rerank_blend(df, bounded=b).collect()} for b in (True, False))
    assert one == two == pytest.approx({1: 0.19, 2: 0.86, 3: 0.025})
    none = df.withColumn("rerank", F.lit(0.0))
    assert {r["id"]: r["blended"] for r in ranking.rerank_blend(none, bounded=True).collect()} == pytest.approx({1: 1.0, 2: 0.5, 3: 0.25})


def test_windows_and_fusion(spark):
    body = "x" * 4100 + " needle " + "y" * 3000
    df = spark.createDataFrame([(1, body), (2, "short needle"), (3, "")], "id long, body string")
    got = {r["id"]: r["w"] for r in df.select("id", search.best_window(F.col("body"), ["needle"]).alias("w")).collect()}
    assert got == {1: body[3800:7800], 2: "short needle", 3: ""}
    hits = spark.createDataFrame([(5, 0.5), (6, 0.9), (7, 0.9)], "id long, score double")
    lists = [search.listed(hits, 1, 2.0, 2), search.listed(hits.where("id = 5"), 2, 1.0, 2)]
    assert {r["id"]: r["rrf"] for r in search.fused(lists).collect()} == pytest.approx({6: 2 / 61 + 0.05, 7: 2 / 62 + 0.02, 5: 1 / 61 + 0.05})


def test_traversal_prefers_what_is_near_the_query(spark):
    """Two neighbours by equal edges: the one whose vector is the query's scores exp(.4) times as much beyond its parent."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3)], "id long, title string")
    vectors = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    edges = spark.createDataFrame([(1, 2, "causal", 0.5), (1, 3, "causal", 0.5)], "src long, dst long, rel string, weight double")
    corpus = search.Corpus(docs, vectors, docs, docs, edges, docs, F.current_timestamp())
    hits = spark.createDataFrame([(1, 1.0)], "id long, score double")
    got = {r["id"]: r["score"] for r in search.traversed(corpus, hits, {"causal": 1.0}, [2.0, 0.0], push=False).collect()}
    near, far = (0.9 + math.exp(0.6 + 0.4 * c) * 0.5 for c in (1.0, 0.0))
    assert got == pytest.approx({1: 1.0, 2: 0.8, 3: 0.8 * far / near})


def test_models_that_fail_or_repeat(spark):
    assert models.expansions("q") == [("hyde", "Information about q")]
    assert models.expansions("q", lambda q: 1 / 0) == [("hyde", "Information about q")]
    assert models.expansions("q", lambda q: [("lex", "a /no_think b"), ("lex", "a  b"), ("vec", "q"), ("odd", "x"), ("vec", "<think>x")]) == [("lex", "a b")]
    pairs = spark.createDataFrame([(1, "q", k, t) for k, t in enumerate(["same", "same", "x" * 900, None, "bad"])], "query_id int, query string, id long, text string")

    def score(q, texts):
        if "bad" in texts:
            return [0.5, math.nan] if len(texts) > 1 else [math.inf]
        return [len(t) / 1000 for t in texts]

    for bounded in (True, False):
        got = {r["id"]: r["rerank"] for r in models.reranked(pairs, score, batch=1, bounded=bounded).collect()}
        assert got == {0: 0.004, 1: 0.004, 2: 0.4, 3: 0.0, 4: 0.0}


def test_remote_models():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = {
                "/v1/embeddings": lambda: {"data": [{"index": k, "embedding": [len(t)]} for k, t in reversed([*enumerate(body["input"])])]},
                "/v1/rerank": lambda: {"results": [{"index": 1, "relevance_score": 0.7}, {"index": 9, "relevance_score": 1}]},
                "/v1/chat/completions": lambda: {"choices": [{"message": {"content": "ok " + body["messages"][0]["content"]}}]},
            }[self.path]()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert models.remote_embedder(url, "m")(["a", "bbb"]) == [[1], [3]]
    assert models.remote_reranker(url, "key")("q", ["a", "b"]) == [None, 0.7]
    assert models.remote_generator(url, "m")("x") == "ok x"
    server.shutdown()


def test_json_in_model_output():
    assert mining.repaired('Sure:\n```json\n{"a": [1, 2,],}\n```\ndone') == {"a": [1, 2]}
    assert mining.repaired('prose {"a": {"b": "x, ]"}} more') == {"a": {"b": "x, ]"}}
    assert mining.repaired('[{"q": "one"}, {"q": "tw') == [{"q": "one"}]
    assert mining.repaired('{"a": 1, "b": [1, 2') == {"a": 1, "b": [1]}
    assert mining.repaired("no value") is None and mining.repaired("") is None and mining.repaired(None) is None and mining.repaired("[1}") is None


V, E = '[{"key":"value"}]', '[{"key":"example"}]'
VALUE, EXAMPLE = [{"key": "value"}], [{"key": "example"}]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (V, VALUE),
        (f"```json\n{V}\n```", VALUE),
        (f"```\n{V}\n```", VALUE),
        (f"```json\n{V}", VALUE),
        (f"Here is the result:\n\n{V}", VALUE),
        (f"{V}\nAdditional explanation follows.", VALUE),
        ('{"outer": {"inner": [1, 2, 3]}}', {"outer": {"inner": [1, 2, 3]}}),
        ('[{"a": 1}, {"b": 2}, {"c": 3', [{"a": 1}, {"b": 2}]),
        ("This is just plain text with no JSON", None),
        ("Here is the JSON:\n```json\n[]\n```", []),
        ('{"context":"Use ```json code fences``` in docs."}', {"context": "Use ```json code fences``` in docs."}),
        ('[\n  "alpha"\n  "beta"\n]', None),
        ('["alpha" "beta"]', None),
        (f"Example:\n```\n[]\n```\nActual:\n```json\n{V}\n```", VALUE),
        (f"```json\n{V}\n```\nExample:\n```\n[]\n```", VALUE),
        (f"Here is the result:\n```json\n{V}\n```\nExample:\n```\n[]\n```", VALUE),
        (f"```json\n{V}\n```\nExample: {E}", VALUE),
        (f"Result:\n[]\nExample:\n```json\n{E}\n```", []),
        (f"```\n[]\n```\nActual:\n```json\n{V}\n```", VALUE),
        (f"Result:\n```\n[]\n```\nExample:\n```\n{E}\n```", []),
        (f"Here is the result:\n```\n{V}\n```\nExample: {E}", VALUE),
        (f"Example:\n```json\n[]\n```\nActual:\n```json\n{V}\n```", VALUE),
        (f"```json\n[]\n```\nActual:\n{V}", VALUE),
        (f"Example:\n```json\n[]\n```\nActual:\n```\n{V}\n```", VALUE),
        (f"```ts\nconst result = {E};\n```\nActual:\n```json\n{V}\n```", VALUE),
        (f"```ts\nconst result = {E};\n```\n{V}\nExample:\n```json\n[]\n```", VALUE),
        (f"```json\n[]\n```\nFinal answer:\n{V}", VALUE),
        (f"```json\n[]\n```\nAnswer:\n{V}", VALUE),
        (f"```json\n{V}\n```\nThe result schema is {E}", VALUE),
        (f"Return empty array [] if no structured facts found.\n```json\n{V}\n```", VALUE),
        (f'Schema: {{"key":1}}\n{V}', VALUE),
        ('{\n  "keywords": ["a b"]\n  "tags": ["x", "y"]\n  "context": "short"\n}', {"keywords": ["a b"], "tags": ["x", "y"], "context": "short"}),
        ('{"a": "x, }", "b": 1,}', {"a": "x, }", "b": 1}),
    ],
)
def test_json_among_fences_labels_and_prose(raw, want):
    assert mining.repaired(raw) == want


def test_observations_of_tags():
    triple = "<triple><subject>App</subject><predicate>Depends on</predicate><object>db</object></triple>"
    odd = "<triple><subject>App</subject><predicate>likes</predicate><object>db</object></triple><triple><subject>A</subject><predicate>uses</predicate><object>db</object></triple>"
    xml = f"<type> Decision </type><title>Use it</title><facts><fact>it is so</fact><fact>abc</fact><fact>Atomic  fact.</fact></facts><concepts><concept>Gotcha</concept><concept>odd</concept></concepts><files_read><file>a.py</file></files_read><triples>{odd}{triple * 7}</triples>"
    got = mining.observation(xml)
    assert (got["type"], got["title"], got["facts"], got["concepts"], got["files_read"], got["files_modified"]) == ("decision", "Use it", ["it is so"], ["gotcha"], ["a.py"], [])
    assert got["triples"] == [("App", "depends_on", "db")] * 5
    for bad in ("<type>guess</type><title>x y</title>", "<type>decision</type>", "<type>decision</type><title>brief descriptive title</title>", "", None):
        assert mining.observation(bad) is None


def test_clauses_from_a_model(spark):
    prompts = spark.createDataFrame([(1, "why so"), (2, "what is the parser doing and also how does the index work here"), (3, "one two three four five six seven and what about nine ten")], "prompt_id long, prompt string")
    multi = (r"\band\s+(?:also|what|how|why)\b",)
    said = {2: '[{"query": "parser", "type": "graph", "priority": 9}, {"query": "index", "type": "odd", "priority": 2}, {"query": ""}]', 3: "nothing"}
    out = mining.decomposed(prompts, F.when(F.col("prompt_id") == 1, "WHY").otherwise("WHAT"), multi, lambda q: said[2 if "parser" in q else 3])
    got = sorted((r["prompt_id"], r["type"], r["query"][:6], r["priority"]) for r in out.collect())
    assert got == [(1, "graph", "why so", 1), (1, "vector", "why so", 3), (2, "bm25", "index", 2), (2, "graph", "parser", 5), (3, "bm25", "one tw", 1), (3, "vector", "one tw", 2)]
