"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from skeinlake.llm import automaton, bpe, fingerprint, langid, linededup, ngram_join, packing, quality, secrets, toxicity, urls  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "One  TWO", "É é ß 漢字 😀 x", "a\x0bb\x0cc\x1cd", "word " * 3000]


def table(spark, texts, extra=True):
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("width", "percent", "deletions"), [(3, 90, None), (5, 80, None), (3, 80, 2), (2, 60, 1)])
def test_ngram_join(spark, width, percent, deletions):
    rng = random.Random(width * percent)
    licence = " ".join(f"licence{k}" for k in range(12))
    texts = list(ODD)
    for k in range(25):
        base = prose(rng, rng.choice([3, 8, 20, 60, 200]))
        texts += [base, base.upper() if k % 2 else base, *(edited(rng, base, e) for e in (1, 2, 4)), licence + " " + prose(rng, 30)]
    big = prose(rng, 150)
    texts += [edited(rng, big, rng.randrange(8)) for _ in range(60)]
    sets = shingle_sets(texts, width)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(table(spark, texts), width=width, percent=percent, deletions=deletions).collect()}
    assert got == {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def test_ngram_join_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(3, 14)) for _ in range(80)]
    whole = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(table(spark, texts), width=3, percent=80).collect()}
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "KEY_ROWS", 512)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(table(spark, texts), width=3, percent=80).collect()} == whole
    assert ngram_join.ngram_jaccard_join(table(spark, ["x"]).limit(0)).collect() == []


def test_urls(spark):
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"))
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://A.Example.org/es/1", ""),
        (2, "https://net.net/a", link("http://x.com/de/1")),
        (3, "https://net.net/b", "<meta http-equiv=refresh content='0; url=/a'>"),
        (4, "http://x.com/de/1?utm_source=q#z", None),
        (5, "https://net.net/c", link("http://good.org/")),
        (6, "https://net.net/d", link("https://net.net/c") + link("http://x.com/de/9")),
        (7, None, None),
        (8, "no scheme", ""),
        (9, "ftp://EXAMPLE.org?x/es/", ""),
        (10, "http://other.io/e/?b=2&a=1&ref=z", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as verdict")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[k][3] for k in (2, 3, 4)] == ["block"] * 3 and got[4][2] == "com/de/"
    assert [got[k][3] for k in (5, 6)] == ["allow"] * 2, "an explicit allow in the component goes before blocks"
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("example.org", "", None, "allow") and got[10][:2] == ("other.io", "/e/")
    more = spark.createDataFrame([("https://other.io/e?a=1&b=2", "http://x.com/de/")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, rules, more).collect()}[10] == "block"
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_links_of_all_forms(spark):
    from pyspark.sql import functions as F

    link = '<link rel="{}" href="{}">'.format
    rows = [
        # (url, html, what the page is an alias of)
        ("http://a.net/x/y/1", link("canonical", "page2.html"), "a.net/x/y/page2.html"),
        ("http://a.net/x/y/2", link("canonical", "../z"), "a.net/x/z"),
        ("http://a.net/x/y/3", link("canonical", "../../../q/./r/.."), "a.net/q"),
        ("http://a.net/x/y/4", link("canonical", "?id=3"), "a.net/x/y/4?id=3"),
        ("http://a.net/x/y/5?p=1", link("canonical", "?u=http://b.net/"), "a.net/x/y/5?u=http://b.net/"),
        ("http://a.net", link("canonical", "r?s=../t"), "a.net/r?s=../t"),
        ("http://a.net/6", link("canonical", "http://h.net/p?a=1&amp;b=2"), "h.net/p?a=1&b=2"),
        ("http://a.net/7", link("canonical", "&#104;ttp&#x3A;//h.net/&#xe9;&#x6F22;&nosuch;&"), "h.net/\u00e9\u6f22&nosuch;&"),
        ("http://a.net/8", link("alternate canonical", "/s/8"), "a.net/s/8"),
        ("http://a.net/9", "<LINK HREF=/s/9 REL='Nofollow\tCANONICAL'>", "a.net/s/9"),
        ("http://a.net/10", '<meta content="0;URL=\'t/10?a=1&amp;b=2\'" http-equiv="Refresh">', "a.net/t/10?a=1&b=2"),
        ("http://a.net/11", '<meta http-equiv="refresh" content="3; u11">', "a.net/u11"),
        ("http://a.net/12", '<base href="/deep/er/"><link rel=canonical href=v12>', "a.net/deep/er/v12"),
        # none of these is a link to another page
        ("http://a.net/13", link("canonicals", "/s/13") + link("canonical", "#top") + link("canonical", "mailto:x@y.z") + link("canonical", ""), None),
        ("http://a.net/14", '<meta http-equiv="refresh" content="30"><link rel="next" href="/canonical">', None),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    named = pages.select("page_id", F.explode(urls.targets_of(F.col("html"))).alias("t"), urls.base_of(F.col("url"), F.col("html")).alias("base"))
    named = named.select("page_id", urls.identity_of(urls.resolved(F.col("base"), F.col("t"))).alias("name")).where("name is not null")
    assert {r["page_id"]: r["name"] for r in named.collect()} == {k: x for k, (_, _, x) in enumerate(rows) if x}


def test_blocks_reach_aliases_by_any_link(spark):
    link = '<link rel="{}" href="{}">'.format
    rows = [
        (1, "http://a.net/x/1", link("canonical", "../bad/page?a=1&amp;b=2")),
        (2, "http://b.net/bad2", link("alternate canonical", "http://a.net/bad/page?b=2&#38;a=1")),
        (3, "http://a.net/x/1", link("canonical", "?id=3")),
        (4, "http://a.net/x/1?id=3", ""),
        (5, "http://a.net/x/5", link("canonical", "1?id=9")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in urls.filter_urls(pages, (("block", "a.net", "/bad/"),)).collect()}
    assert [out[k][0] for k in (1, 2, 3, 4, 5)] == ["block"] * 4 + ["allow"]
    assert len({out[k][1] for k in (1, 2, 3, 4)}) == 1


def test_components_on_long_paths(spark):
    from skeinlake.llm.components import components

    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}


@pytest.fixture(scope="module")
def multi():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe(spark, multi):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(multi)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "abc  \n\t'séß漢字😀\x1c\x85ⅷ-_=É123٣́ "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(80)] + ["a" * 3000, "abcdefgh" * 300, "漢" * 700]
    expected = [exact.encode_ordinary(t or "") for t in texts]
    docs = table(spark, texts)
    path = (multi, public_tokenizers.PATTERN)
    encoded = bpe.encode(docs, *path)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == dict(enumerate(expected))
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, *path).collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    for r in bpe.round_trip(docs, *path).collect():
        raw = np.array(expected[r["doc_id"]], "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.choice([4, 30, 300])) for _ in range(40)]
    texts += [edited(rng, t, 2) for t in texts[-20:]] + texts[-5:]
    got = {r["doc_id"]: r for r in fingerprint.splice_probe(table(spark, texts), parts=5).collect()}
    assert len(got) == len(texts)
    sets = shingle_sets(texts, 5)
    errors = []
    for k, t in enumerate(texts):
        t, after = t or "", texts[k - 1] or ""
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        pairs = ((sets[k], shingle_sets([changed], 5)[0], got[k]["near_edited"]), (sets[k], sets[k - 1], got[k]["near_next"]))
        errors += [abs(x - (len(a & b) / len(a | b) if a | b else 1)) for a, b, x in pairs]
    assert max(errors) < 0.2 and np.mean(errors) < 0.04
    marks = {}
    for k, t in enumerate(texts):
        assert marks.setdefault(t or "", got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert fingerprint.splice_probe(table(spark, ["x"]).limit(0)).count() == 0
    assert fingerprint.splice_probe(table(spark, ["only one here"])).first()["near_next"] == 1.0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["scum", "idiot", "trash"]
    texts, grades = [], []
    for _ in range(400):
        words, g = prose(rng, 40).split(), rng.choice([0, 0, 0, 1, 2])
        for _ in range(g):
            words.insert(rng.randrange(40), rng.choice(bad))
        texts.append(" ".join(words))
        grades.append(g)
    docs = table(spark, texts + ODD)
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(grades[:300])] + [(1, None), (None, 1)], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert np.mean([got[k]["toxic"] == (grades[k] > 0) for k in range(300, 400)]) > 0.97
    severity = [np.mean([got[k]["severity"] for k in range(300, 400) if grades[k] == g]) for g in (0, 1, 2)]
    assert severity[0] < severity[1] < severity[2]
    assert not any(got[len(texts) + k]["toxic"] for k in range(len(ODD)))
    nothing = toxicity.fit(docs, labels.where("grade = 0"))
    assert not toxicity.grade(docs, nothing).where("toxic or grade > 0").count()


RULES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 18, 0), ("hex", re.compile("[0-9a-f]+"), 16, 0)]


def spans(text):
    found = [(m.start(), k, m.end()) for k, (_, r, least, g) in enumerate(RULES) for m in r.finditer(text or "") if len(m[g]) >= least]
    return [(a, b, RULES[k][0]) for a, k, b in sorted(found)]


def test_secrets(spark):
    rng = random.Random(6)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "é", "\n", "x", "-", "/", "漢", "ſ"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(300)]
    texts += ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "see https://joe:pw@host/", "secret=token=abcdefghijklmnop", "secret:token:abcdefghijklmnop"]
    docs = table(spark, texts)
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    base = {"assign", "access", "hex"}
    assert {k: [s for s in v if s[2] in base] for k, v in got.items()} == {k: spans(t) for k, t in enumerate(texts)}
    assert [[s[2] for s in got[len(texts) - k]] for k in (5, 4, 3)] == [["private_key"], ["github"], ["url_password"]]
    row = {r["doc_id"]: r for r in secrets.digest(docs).collect()}
    for k, t in enumerate(texts):
        text = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans(t))
        assert row[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row[k]["n_hex"] == sum(s[2] == "hex" for s in spans(t))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(clean[k] == t for k, t in enumerate(texts) if not got[k])
    assert not any(set(s[2] for s in spans(t)) for t in clean.values())
    assert secrets.redact(docs).columns == docs.columns


def test_whole_private_keys(spark):
    rng = random.Random(16)
    line = lambda n: "".join(rng.choice("ABCDEFghijkl0189+/") for _ in range(n))
    lines = [line(64), line(64), line(64), line(22) + "=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    armor = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    key = "\n".join(lines)
    # (text, what redact() leaves of it)
    cases = [
        (f"é a\n{begin}\n{key}\n{end}\nb", "é a\n<SECRET>\nb"),
        (f"a\r\n{begin}\r\n" + "\r\n".join([*lines, end]) + "\r\nb", "a\r\n<SECRET>\r\nb"),
        (f"> {begin}\n> " + "\n> ".join([*lines, end]), "> <SECRET>"),
        (f"{begin}\n{armor}{key}\n{end}", "<SECRET>"),
        (f"{begin}\n{armor}{key}\nand more", "<SECRET>\nand more"),
        (f"{begin}\n{key}", "<SECRET>"),
        (f'"{begin}' + "\\n".join(["", *lines, end]) + '", x', '"<SECRET>", x'),
        (f'"{begin}' + "\\n".join(["", *lines]) + '", x', '"<SECRET>", x'),
        (f"{begin} {' '.join(lines)} {end} b", "<SECRET> b"),
        (f"{begin}\n{key}\n{begin}\n{key}\n{end}\nb", "<SECRET>\n<SECRET>\nb"),
        (f"the line {begin} opens a key\nof RSA", "the line <SECRET> opens a key\nof RSA"),
        (f"{begin}", "<SECRET>"),
    ]
    docs = table(spark, [t for t, _ in cases] + [key])
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert [clean[k] for k in range(len(cases))] == [left for _, left in cases]
    assert clean[len(cases)] == key, "the next row's key isn't part of the last one's"
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "private_key"] for r in secrets.find_secrets(docs).collect()}
    assert found[0] == [(4, len(cases[0][0]) - 2)]


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(9)
    for pattern in ["a(b|c)*d", "[a-c]{2,3}x?", "(ab|a)(c|bcd)+", "a{2}b{1,}", "[^a]b"]:
        own, exact = automaton.compile_rules([(pattern, False)], search=False), re.compile(pattern)
        for _ in range(300):
            s = "".join(rng.choice("abcdx") for _ in range(8))
            ends = [k for k in range(len(s) + 1) if exact.fullmatch(s[:k])]
            assert own.longest(s.encode(), 0) == (max(ends) if ends else -1)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    exact = tokenizers.Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.choice([1, 30, 300, 900])) for _ in range(60)] + ["x <|endoftext|> \x01 y\x1cz", "dup", "dup"]
    got = packing.pack(table(spark, texts), path, keep_ids=True).toPandas()
    expected = {}
    for k, t in enumerate(texts):
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        expected |= {(k, a // 4096): ids[a : a + 4096] for a in range(0, len(ids), 4096)}
    assert {(d, p): list(ids) for d, p, ids in zip(got.doc_id, got.piece, got.ids, strict=True)} == expected
    assert all(zlib.crc32(np.array(expected[d, p], "<u4").tobytes()) == c and p * 4096 == s for d, p, c, s in zip(got.doc_id, got.piece, got.ids_crc32, got.start, strict=True))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 4096
    assert packing.pack(table(spark, ["x"]).limit(0), path).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (np.clip(rng.lognormal(6.5, 1, 50000).astype(int), 1, 4096), rng.integers(1, 4097, 20000), np.full(100, 1400)):
        size, n = np.unique(lengths, return_counts=True)
        plan = packing.best_plan(dict(zip(size.tolist(), n.tolist(), strict=True)), 4096)
        fill, seen = np.zeros(plan.sequences, int), {}
        for length, first, count, sequence, offset in plan.runs:
            assert first == seen.get(length, 0) and (fill[sequence : sequence + count] == offset).all()
            fill[sequence : sequence + count] += length
            seen[length] = first + count
        assert fill.max() <= 4096 and seen == dict(zip(size.tolist(), n.tolist(), strict=True))
        least = -(-lengths.sum() // 4096) if lengths.min() < 1400 else 50
        assert plan.sequences <= 1.01 * least


def brute_runs(texts, least):
    lines = [[x for x in (t or "").split("\n") if WORDS.search(x)] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, some in enumerate(lines):
        n, runs = [len(WORDS.findall(x)) for x in some], set()
        for a in range(len(some)):
            for b in range(a + 1, len(some) + 1):
                if sum(n[a:b]) >= least:
                    runs.add((a, b))
        for a, b in sorted(runs):
            if first.setdefault(tuple(some[a:b]), (d, a)) != (d, a):
                gone[d] |= set(range(a, b))
    return [len(x) for x in gone]


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.choice([1, 3, 9])) for _ in range(14)]
    texts = ODD + ["\n".join(rng.choice([*pool, "", prose(rng, 5)]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [texts[-1], "same\n" * 30]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs, min_words=10).collect()}
    assert {k: r["lines_removed"] for k, r in got.items()} == dict(enumerate(brute_runs(texts, 10)))
    for k, t in enumerate(texts):
        if not got[k]["lines_removed"]:
            assert got[k]["text"] == t
        else:
            kept = [x for x in got[k]["text"].split("\n") if x.strip()]
            assert len(kept) + got[k]["lines_removed"] == len([x for x in t.split("\n") if WORDS.search(x)])
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_quality_statistics(spark):
    rng = random.Random(7)
    texts = ODD + ["\n".join(prose(rng, rng.randrange(6), 30) + rng.choice(["", " #", "|"]) for _ in range(rng.randrange(9))) for _ in range(80)]
    got = {r["doc_id"]: r for r in quality.statistics(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        t, w, seen, dups, cover = t or "", WORDS.findall(t or ""), set(), 0, set()
        for line in t.split("\n"):
            if WORDS.search(line):
                dups, _ = dups + (line in seen), seen.add(line)
        triples = list(zip(w, w[1:], w[2:], strict=False))
        for i, x in enumerate(triples):
            if triples.count(x) > 1 if len(triples) < 500 else len(set(triples)) < len(triples):
                cover |= {i, i + 1, i + 2}
        assert tuple(got[k][c] for c in quality.STATISTICS) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(cover)), t[:50]


def test_quality_forest(spark):
    rng = random.Random(11)
    texts, good = [], []
    for k in range(600):
        bad, share = k % 24 == 0, rng.random()  # junk differs: a cluster of equal rows would be no anomaly to the forest
        texts.append(" ".join(w + ("%" * rng.randrange(1, 9) if bad and rng.random() < share + 0.3 else "") for w in prose(rng, 120, 5000).split()))
        good.append(0 if bad else 1)
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(good) if k % 2 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_rules(table(spark, texts + ODD), labels).collect()}
    clean = [got[k]["kept"] for k in range(600) if good[k]]
    assert np.mean(clean) > 0.98 and not any(got[k]["kept"] for k in range(600) if not good[k])
    assert all(got[600 + k]["base_failed"] and not got[600 + k]["kept"] for k in range(len(ODD)))
    none = quality.quality_rules(table(spark, ["x"]).limit(0), labels)
    assert none.count() == 0


def test_language_models(spark):
    rng = random.Random(12)
    sounds = {"aa": "ba na ki lo tu".split(), "bb": "sch ei ung ach keit".split(), "cc": "ção é ne ment eau".split()}
    texts, langs = [], []
    for k in range(300):
        lang = ["aa", "bb", "cc"][k % 3]
        texts.append(" ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(40)))
        langs.append(lang)
    docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate(zip(texts, langs, strict=True))] + [(1000 + k, t, None) for k, t in enumerate([*ODD, "漢字" * 200])], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[k]["lang_pred"] == langs[k] for k in range(300) if k % 4 == 2]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[k]["rejected"] for k in range(300))
    assert [got[1000 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[1000 + len(ODD)]["rejected"]
    # probabilities after any context add up to one
    symbols = np.arange(len(model.alphabet) + 2, dtype=model.dtype)
    for context in (0, 1, 5):
        codes = (model.dtype(context) << model.dtype(model.bits)) | symbols
        assert np.allclose(np.exp(model.log(codes).astype(float)).sum(axis=0), 1, atol=1e-3)
    none = langid.fit(docs.where("lang = 'none'"))
    assert none.languages == [] and {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(docs, none).collect()} == {("und", 0.0, True)}
    assert langid.keep_identified(docs, none).count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(60)]
    passage = prose(rng, 70)
    texts += [passage + "\n" + prose(rng, 60), passage + "\n" + prose(rng, 60), texts[0], edited(rng, texts[1], 1), "token = 0123456789abcdef0123", None, "", "漢字 " * 60]
    docs = table(spark, texts, extra=False).withColumn("lang", spark.range(1).selectExpr("'en'").first()[0] and __import__("pyspark").sql.functions.expr("case when doc_id < 60 then 'en' end")).selectExpr("*", "1 as sid", "2 as key")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == docs.columns
        out.write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in kept.collect()}
    assert set(range(60)) <= set(seen["language ID"]) and not {65, 66, 67} & set(seen["language ID"])
    assert passage not in seen["line dedup"][61]["text"] and passage in seen["line dedup"][60]["text"] and 62 not in seen["line dedup"]
    assert 63 not in seen["n-gram Jaccard join"] and set(range(60)) <= set(seen["n-gram Jaccard join"])
    if 64 in seen["secret scans"]:
        assert "0123456789abcdef" not in seen["secret scans"][64]["text"]
    assert set(seen["best-fit packing"]) == set(seen["secret scans"])
    repeated = docs.where("doc_id < 5").unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 4").selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    assert corpus_pipeline.join_near_duplicates(spark, repeated, "").count() == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_registered_queries_run(spark):
    from skeinlake.llm.queries import ORACLE, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


