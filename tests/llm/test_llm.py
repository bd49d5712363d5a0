"""The corpus operators against brute force, libraries, SQL and odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from batchloom.llm import common, decontaminate, html_text, line_dedup, mixing, near_dups, neighbours, quality, sharding, tokens, warc
from batchloom.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rows = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "a b c"), (None, None), (4, "word " * 50_000), (5, "a b c d e f"), (6, "a b c d e f"),
            (6, "a b c d e f"), (7, "É x y 😀")]
    extra = "fp long, shard string, score string, n_words string, spans string, rest int, epochs string, `__x` string"
    return spark.createDataFrame([(i, t, "en", "src1" if i else None, 0, 1, "s", "q", "w", "p", 3, "e", "x") for i, t in rows], f"{DOC}, {extra}")


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", [n for n in llm_queries.QUERIES if n in llm_queries.ORACLES])
def test_sql(spark, name):
    assert compare.check(llm_queries.QUERIES[name](spark, SF), compare.connect(SF), llm_queries.ORACLES[name]) is None


def test_registered():
    assert set(llm_queries.QUERIES) <= set(entry.queries())
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in llm_queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and 4 <= len(corpus_pipeline.STAGES) <= 5


# near duplicates

def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    edges = [(a, b) for a, b in itertools.combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(texts, edges)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in llm_queries.QUERIES["op3_near_dups"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_fingerprint_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices("the of And a to É in is".split(), k=400))
    monkeypatch.setattr(near_dups, "_SHINGLES_AT_ONCE", 7)
    monkeypatch.setattr(near_dups, "pieces", lambda data: common.pieces(data, size=40))
    assert near_dups.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_crowded_variants(spark, block):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = near_dups.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block)
    got = {(r["node"], r["root"]) for r in near_dups.components(found).collect()}
    edges = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = components(signed, edges)
    grown = dict(got)
    assert {v: grown.get(v, v) for v in signed} == want


def test_components_long_chain(spark):
    edges = [(i + 1, i) for i in range(200)] + [(500, 400)]
    got = {r["node"]: r["root"] for r in near_dups.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}


def test_near_duplicates_odd(spark):
    rows = near_dups.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 11
    wordless = [r for r in rows if r["fp"] == 0]
    assert len(wordless) == 5 and {r["component_id"] for r in wordless} == {1}
    left = near_dups.one_of_each(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[1] == 1 and ids[5] == 1 and ids[2] == ids[6] == 0 and max(ids.values()) == 1
    assert near_dups.near_duplicates(empty_docs(spark)).count() == 0 and near_dups.one_of_each(empty_docs(spark)).count() == 0


# decontamination

def test_index_finds_all():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 60)), 0) for _ in range(30)])
    index = decontaminate.ShardIndex(symbols)
    items = [(str(i), [b"%d" % x for x in rng.integers(1, 4, 4)]) for i in range(20)]
    phrases = decontaminate.Phrases(items, window=3)
    names = {v: int(k) for k, v in phrases.vocabulary.items()}
    renamed = np.array([[names.get(x, 0) for x in row] for row in phrases.symbols])
    phrases.symbols = renamed
    phrase, at = index.search(phrases)
    want = {(p, i) for p, row in enumerate(renamed) for i in range(len(symbols)) if list(symbols[i:i + phrases.lengths[p]]) == list(row[:phrases.lengths[p]])}
    assert set(zip(phrase.tolist(), at.tolist())) == want and len(at) == len(want)


@pytest.mark.parametrize("limit", [30, 1 << 20])
def test_decontamination_small(spark, monkeypatch, limit):
    words = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Short É item"), (3, None), (None, "lone"), (2, "Short É item")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "x " * 50 + "! ".join(words[:11]).upper() + " y"), (2, " ".join(words[:9])), (3, "a short É item, LONE"), (4, None), (5, ""),
        (6, " ".join(words) + " z " + " ".join(words[2:12]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, bench, shard_size=limit).collect()}
    spans = {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()}
    assert spans == {1: [(50, 61)], 2: [], 3: [(1, 5)], 4: [], 5: [], 6: [(0, 12), (31, 41)]}
    assert [got[i]["items"] for i in (1, 3, 6)] == [["1"], ["2", "null"], ["1"]]
    assert [r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.excised(docs, bench).collect()}
    assert cut[3] == "a " and cut[2] == " ".join(words[:9]) and cut[6] == " " + " ".join(words[12:]) + " z "


def test_decontamination_blocks(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 4000)
    assert {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()} == whole
    assert any(r["contaminated"] for r in whole.values())


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    out = decontaminate.without_contaminated(odd_docs(spark), bench)
    assert out.columns == odd_docs(spark).columns and out.filter("text = 'a b c d e f'").count() == 0 and out.count() == 8
    none = bench.limit(0)
    assert decontaminate.report(odd_docs(spark), none).filter("contaminated").count() == 0
    assert decontaminate.report(empty_docs(spark), bench).count() == 0


# tokens

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(llm_queries.vocabulary_path("byte_bpe_50k.json"))


def test_tokens_match_library(spark):
    rng = random.Random(4)
    odd = ["a" * 3000, "x<|endoftext|> y<|endoftext|>", "日本語 😀😀 é", "it's we'LL  \n\n x", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000)),
           "".join(rng.choice("abcd") for _ in range(3000)), "1234567 ½ ²", "\x00\x1c\x85"]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    vocabulary = tokens.load(llm_queries.vocabulary_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, vocabulary).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for (i, text), e in zip(texts, library().encode_batch([t for _, t in texts], add_special_tokens=False)):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(e.ids), len(text.encode()), len(e.ids) > 1024)
    few = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(odd_docs(spark), vocabulary).collect()}
    assert few[1] == few[2] == 0 and few[4] > 50_000
    assert tokens.token_counts(empty_docs(spark), vocabulary).count() == 0


# WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/é x", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (4, "u", ""), (None, "n", "<p>é</p>"), (5, "r\nn", "z" * 300_000), (1, "http://b", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    index = warc.write(warc.with_revisits(pages), tmp_path.as_uri())
    got = sorted((r["page_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in warc.read(index, tmp_path.as_uri()).collect())
    sha = {h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}
    first = {"<p>é</p>": 1, None: 2, "": 2, rows[5][2]: 5}
    want = sorted((str(i or ""), "response" if i == first[h] else "revisit", "" if i == first[h] else str(first[h]), len((h or "").encode()), sha[h]) for i, _, h in rows)
    assert got == want
    some = warc.read(index.filter("page_id = '5'"), tmp_path.as_uri()).collect()
    assert len(some) == 1 and bytes(some[0]["payload"]) == b"z" * 300_000 and some[0]["url"] == "r%0An"
    assert {r["record_type"] for r in warc.read(warc.write(warc.with_revisits(pages, least=10), tmp_path.as_uri()), tmp_path.as_uri()).filter("payload_bytes < 10").collect()} == {"response"}
    assert warc.write(warc.with_revisits(pages.limit(0)), tmp_path.as_uri()).count() == 0


def test_warc_ranges():
    entries = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("b", 105, 5), ("b", 110, 50)]
    assert [len(g) for g in warc._ranges(entries, most=40, gap=20)] == [2, 1, 1, 1]
    with pytest.raises(ValueError):
        warc.parse(warc.record("1", "u", b"abc", None).replace(b"abc", b"abd"))


# neighbours

def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [math.nan, 1.0]),
            (7, [math.inf, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (9, []), (2, [1.0, 0.0])]
    out = neighbours.nearest(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, code string"), k=3)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 20 * 32 * 8)
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    scores = data[::20] @ data.T
    hits = 0
    for k, q in enumerate(range(0, 1500, 20)):
        scores[k, q] = -np.inf
        hits += len(set(np.argsort(-scores[k])[:20]) & set(got[q]))
    assert len(got) == 75 and hits / (75 * 20) >= 0.99


# quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = llm_queries.QUERIES["op10_quality"](spark, sf).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in judged) / len(judged) > 0.97
    assert sum(p for p, q in judged if q) / sum(q for _, q in judged) > 0.98


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0), (6, None, 0), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for judged in (labels, labels.limit(0)):
        model = quality.fit(odd_docs(spark), judged)
        rows = quality.scored(odd_docs(spark), model).collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows} == {0.5}
    assert quality.good_only(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert quality.scored(empty_docs(spark), quality.fit(empty_docs(spark), labels)).count() == 0


# HTML

@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>A<th>B<tr><td>long<td>2</table>", "A     B\nlong  2"), ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x  y\n   z"),
    ("<td>a<td>b", "a b"), ("<pre> a\n  b</pre>", " a\n  b"), ("x<script>if(a<b){}</script><style>p{}</style><!-- c -->y", "xy"),
    ("<p hidden>a<p style='display: none'>b<p style='visibility:hidden'>c<i style='visibility:visible'>d</i>", "d"), ("<title>t</title>a &amp;&lt;", "a &<"),
    ("<![foo[x]]>a<!DOCTYPE html>", "a"), ("<div>" * 3000 + "deep", "deep"), ("a</p></div></b>b", "ab"), ("<b>a <i> b</b> c</i>", "a b c"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"), ("<blockquote>q</blockquote>", "  q"),
])
def test_html(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>t</title><body><p>text", "text"), ("<head><meta charset=x><title>t</title><div>a</div>b", "a\nb"),
    ("<head><style>p{}</style>\n<script>s</script> plain <b>c</b>", "plain c"), ("<head><title>t</title>\n</head><body>a", "a"),
    ("<head><template><p>x</p></template><link rel=y><p>z", "z"), ("<head><noscript><link rel=y></noscript><title>t</title><p>a", "a"),
    ("<head><noscript><img src=x></noscript><p>a", "a"),
])
def test_html_open_head(html, want):
    assert html_text.render(html) == want


@pytest.mark.parametrize("html, want", [
    ("<table><colgroup><col><col><tr><td>a<td>b<tr><td>c</table>d", "a  b\nc\n\nd"), ("<table><colgroup><col><td>a<td>b</table>", "a  b"),
    ("<table><colgroup><col><th>a<tr><td>b</table>", "a\nb"), ("<table><caption>c<tr><td>a<td>b</table>", "c\na  b"),
    ("<table><caption>c<colgroup><col><colgroup><col><tr><td>a<td>b</table>", "c\na  b"), ("<table><colgroup><col><caption>c<tr><td>a</table>", "c\na"),
])
def test_html_open_colgroup(html, want):
    assert html_text.render(html) == want


def test_html_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = llm_queries.QUERIES["op5_html_text"](spark, SF).collect()
    assert len(rows) == pages.count() and all(len(r["text"]) == r["n_chars"] and (r["text"].count("\n") + 1 if r["text"] else 0) == r["n_lines"] for r in rows)
    assert not any("<script" in r["text"] for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>é", "y"), (2, "<p>" + "w " * 100_000, "z")], "page_id long, html string, text string")
    assert Counter((r["page_id"], r["n_lines"]) for r in html_text.extract(odd).collect()) == {(1, 0): 2, (None, 1): 1, (2, 1): 1}


# lines

def test_line_templates(spark):
    docs = spark.createDataFrame(
        [(i, f"Own line {chr(97 + i)} with words of its own {chr(98 + i)}{chr(99 + i)}\nUser {i} logged in from host{i}.example\n\nRead more by author{chr(97 + i)} in our great archive today")
         for i in range(8)] + [(20, None), (21, ""), (22, "\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring(docs).collect()}
    assert all(got[i]["n_lines"] == 4 and got[i]["n_dropped"] == 2 and got[i]["text"].endswith("\n") and "logged" not in got[i]["text"] and "archive" not in got[i]["text"] for i in range(8))
    assert (got[20]["text"], got[20]["n_lines"]) == (None, 0) and (got[21]["text"], got[21]["n_lines"]) == ("", 1) and got[22]["text"] == "\n"
    copies = spark.createDataFrame([(i, "same line here again\nand one more") for i in range(9)], "doc_id long, text string")
    assert line_dedup.drop_recurring(copies).agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup.drop_recurring(odd_docs(spark)).count() == 11 and line_dedup.drop_recurring(empty_docs(spark)).count() == 0


def test_lines_of_one_leaf_have_templates_of_their_own(spark):
    names = [f"{a}{b}" for a in "kmnprs" for b in ("ora", "iel")]
    rows = []
    for k, name in enumerate(names):
        rows.append((len(rows), f"the new item {name} was sold to us quite late"))
        rows.append((len(rows), f"the new item went to {name} after many long days"))
        rows.append((len(rows), f"the new item cost far more than {name} had thought"))
        rows.append((len(rows), f"the new item {name} {name}a x{name} and {name}b are ours {name}c"))  # most of it differs
        rows.append((len(rows), f"He said that {name}."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.drop_recurring(docs).collect()}
    # three templates of ten tokens that open alike, each with one variable word; the others stay whole
    assert got == {i: (1, "") if i % 5 < 3 else (0, t) for i, t in rows}


@pytest.mark.parametrize("words, texts, dropped", [(60, 2, True), (51, 2, True), (50, 5, False), (50, 6, True), (60, 1, False)])
def test_long_lines_recur_sooner(spark, words, texts, dropped):
    line = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}w" for k in range(words))
    docs = spark.createDataFrame([(i, f"{line}\nonly text {'abcdefgh'[i]}") for i in range(texts)] + [(9, line.replace("w", "v"))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring(docs).collect()}
    assert got == {**{i: int(dropped) for i in range(texts)}, 9: 0}


def test_line_dedup_with_maps(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('this line is in all texts\nown ', chr(97 + id)) AS text, map('k', id) AS `a.b`, array(map(1, 2)) AS n_lines2, 'x' AS leaf FROM range(7)")
    rows = line_dedup.drop_recurring(docs.unionByName(docs)).collect()
    assert len(rows) == 14 and all(r["n_dropped"] == 1 and r["a.b"] == {"k": r["doc_id"]} for r in rows)


def test_lines_are_masked_once_and_digested_in_generated_code(spark):
    plan = line_dedup._lines(documents(spark), "text", line_dedup.DEPTH, line_dedup.MIN_TEXTS)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") == 2
    above, below = plan.split("Generate ")
    assert "n_chars" not in above and "n_chars" in below  # whole rows are digested once a document, not once a line


def test_templates_are_equal_where_all_but_one_run_are(spark):
    runs = {n: n * line_dedup.OPEN // 10 for n in range(1, 500)}
    assert max(-(-n // run) for n, run in runs.items() if run) == line_dedup.RUNS
    draw = random.Random(7)
    lines = [[draw.choice(["ab", "cd", "<*>"]) for _ in range(n)] for n in range(1, 25) for _ in range(12)]
    lines += [[w if i != draw.randrange(len(x)) else "ef" for i, w in enumerate(x)] for x in lines for _ in range(3)]
    gaps = [" ", "  ", "\t", " \r", "\x0b\f "]
    written = [draw.choice(["", " ", "\t"]) + "".join((f"x{draw.randrange(99)}" if w == "<*>" else w) + draw.choice(gaps[:1 + 4 * (k % 2)]) for w in x) for k, x in enumerate(lines)]
    docs = spark.createDataFrame([(0, "\n \t\n".join(written))], "doc_id long, text string")
    got = sorted(line_dedup._lines(docs, "text", 3, 6).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == [2 * k for k in range(len(lines))]
    pairs = {"exact": set(), "leaf": set(), "templates": set()}
    for r, x in zip(got, lines, strict=True):
        n, run = len(x), max(0, (len(x) - 3) * line_dedup.OPEN // 10)
        pairs["exact"].add((r["exact"], tuple(x)))
        pairs["leaf"].add((r["leaf"], (n, *x[:3])))
        want = [(n, k, *x[:3 + k * run], "|", *x[3 + (k + 1) * run:]) for k in range(-(-(n - 3) // run))] if run else None
        assert (r["templates"] is None) == (want is None)
        pairs["templates"] |= set(zip(r["templates"] or [], want or [], strict=True))
    for both in pairs.values():
        assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


# mixing

def test_budgets_move_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", None, 1000)], "dom string, lang string, held long")
    got = {(r["dom"], r["lang"]): r["budget"] for r in mixing.budgets(leaves, ["dom", "lang"], {"dom": {"a": 1, "b": 1}}, 400).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", None): 100}
    short = leaves.filter("lang = 'x'")
    got = {(r["dom"], r["lang"]): r["budget"] for r in mixing.budgets(short, ["dom", "lang"], {}, 400).collect()}
    assert got == {("a", "x"): 10, ("b", "x"): 390}


@pytest.mark.parametrize("per_slice", [3, 50_000])
def test_mix_slices_and_epochs(spark, monkeypatch, per_slice):
    monkeypatch.setattr(mixing, "PER_SLICE", per_slice)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "s0" if i < 60 else "s1", "e") for i in range(80)], "doc_id long, text string, source string, epochs string")
    out = mixing.mix(docs, {"source": F.col("source")}, {"source": {"s0": 1, "s1": 3}}, mixing.word_count(), budget=200).collect()
    got, own = Counter(), {}
    for r in out:
        got[r["source"]] += r["mix_tokens"] * r["mix_epochs"]
        own[r["doc_id"]] = r["mix_epochs"]
    assert 50 <= got["s0"] < 55 and 150 <= got["s1"] < 155 and set(own[i] for i in range(60, 80)) <= {2, 3}
    order = sorted(range(60), key=lambda i: hashlib.md5(f"7|0|{i}".encode()).hexdigest())
    want, used = set(), 0
    for i in order:
        if used < 50:
            want.add(i)
        used += 1 + i % 5
    assert {i for i in own if i < 60} == want
    rows = mixing.repeated(mixing.mix(docs, {"source": F.col("source")}, {}, mixing.word_count()), docs.columns)
    assert rows.columns == docs.columns


def test_mix_odd(spark):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd_docs(spark), levels, {}, mixing.word_count())
    assert out.filter("trim(coalesce(text, '')) = ''").count() == 0 and out.filter("doc_id is null").count() == 1
    assert mixing.mix(empty_docs(spark), levels, {}, mixing.word_count()).count() == 0


# sharding

def check_shards(rows, shards):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    counts = [len(per[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(shards))


def test_shards_keep_groups(spark):
    rows = llm_queries.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    check_shards(rows, 40)
    homes = defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "rows"
        homes[text].add(r["shard"])
    assert len(rows) == len(texts) and sum(len(h) > 1 for h in homes.values()) <= 4


def test_shards_hot_group_and_odd(spark):
    docs = spark.createDataFrame([(i, "hot" if i < 700 else f"t{i // 2}") for i in range(2000)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=10).collect()
    check_shards(rows, 10)
    assert len({r["shard"] for r in rows if r["doc_id"] < 700}) <= 6 and len(rows) == 2000
    odd = sharding.shard(odd_docs(spark)).collect()
    check_shards(odd, 40)
    assert len(odd) == 11 and {(r["size"], r["text_crc32"]) for r in odd if r["doc_id"] in (1, 2)} == {(16, 0)}
    whole = sharding.with_shards(odd_docs(spark))
    assert whole.count() == 11 and len(set((r["shard"], r["slot"]) for r in whole.collect())) == 11
    assert sharding.shard(empty_docs(spark)).count() == 0


# pipeline

def test_pipeline_stages(spark):
    docs = documents(spark)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in quality.scored(docs, model).collect()}
    good = corpus_pipeline.classify(spark, docs, SF)
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in good.collect()}
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    single = corpus_pipeline.dedupe(spark, good, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(components(prints, edges).values()))
    clean = corpus_pipeline.decontaminated(spark, single, SF)
    bad = {r["doc_id"] for r in decontaminate.report(single, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - bad
    mixed = corpus_pipeline.mixed(spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.schema[1].dataType == T.StringType()
    last = corpus_pipeline.sharded(spark, mixed, SF)
    check_shards(last.collect(), 40)
    assert last.count() == mixed.count()


def test_pipeline_odd_rows(spark):
    docs = odd_docs(spark)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() > 0


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[-2:] == ["shard", "slot"]


def five_word_sets(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in texts.items()}
    return {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}


def near_copy_edges(texts):
    sets = five_word_sets(texts)
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    alike = [(a, b) for a, b in itertools.combinations(texts, 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return alike, alike + [(a, b) for a, b in itertools.combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]


def test_pipeline_near_copies(spark):
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    _, edges = near_copy_edges(texts)
    assert sorted(r["doc_id"] for r in stage(spark, documents(spark), SF).collect()) == sorted(set(components(texts, edges).values()))


def test_near_copies_groups(spark):
    """Groups, chains whose ends are not alike, lone texts and short ones."""
    rng, texts = random.Random(9), {}
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for step in range(8):
            if group % 2:
                words = list(words)
            copy = words if group % 2 else list(words)
            for at in rng.sample(range(200), 3):
                copy[at] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {200 + k: t for k, t in enumerate(["a b", "A  b", "c d e f g", "c d e f g h", "", None])}
    alike, edges = near_copy_edges(texts)
    ends = five_word_sets(texts)
    assert 5 * len(ends[8] & ends[15]) < 4 * len(ends[8] | ends[15])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, similarity=0.8).collect()}
    assert got == components(texts, edges) and got != components(texts, set(edges) - set(alike))
    assert near_dups.one_of_each(odd_docs(spark), similarity=0.8).count() > 0 and near_dups.one_of_each(empty_docs(spark), similarity=0.8).count() == 0


def copies_of_one(count, changes, rng):
    """Texts of 300 words, each made from the same one by as many changed words."""
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(count):
        copy = list(words)
        for at in rng.sample(range(300), changes):
            copy[at] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_links_in_cell_brute_force():
    rng = random.Random(4)
    texts = copies_of_one(40, 5, rng) + copies_of_one(20, 12, rng) + [" ".join(f"x{rng.randrange(40)}" for _ in range(60)) for _ in range(5)]
    sets = [np.unique(np.concatenate([np.array(h, np.uint64) for h in near_dups._hashed(t, 5, 42)])) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(65), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for roots in (range(65), [0] * 30 + [1] * 30 + list(range(60, 65))):
        made = near_dups.links_in_cell(np.array(roots), np.arange(65), sets, 0.8)
        own = [(min(a for a in range(65) if roots[a] == roots[b]), b) for b in range(65)]
        assert components(range(65), made + own) == components(range(65), edges + own)
        assert set(made) <= {p for e in edges for p in (e, e[::-1])}


def test_similar_links_rows_grow_linearly(spark, monkeypatch):
    """Hundreds of texts that share bands and are 0.67 alike, and their source, which is 0.82 like all."""
    rows, kept = {}, near_dups.stored

    def counted(df, name):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dups, "stored", counted)
    monkeypatch.setattr(near_dups, "CELL", 64)
    for n in (100, 400):
        rng = random.Random(n)
        texts = dict(enumerate(copies_of_one(n, 6, rng) + copies_of_one(1, 0, rng)))
        assert len(near_copy_edges(texts)[0]) >= n
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r["component_id"] for r in near_dups.near_duplicates(docs, similarity=0.8).collect()} == {0}
        # a row a text and band at most; no band holds two groups after that
        assert sum(rows.pop("pivots")) <= near_dups.BANDS * n and sum(rows.pop("cells")) == 0
        del texts[n]
        alone = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(alone, similarity=0.8).collect()}
        assert got == components(texts, near_copy_edges(texts)[1])
        assert sum(rows.pop("pivots")) <= near_dups.BANDS * n and sum(rows.pop("cells")) <= near_dups.BANDS * n


def test_pipeline_mixing_sql(spark, tmp_path):
    """The mixing stage takes the documents, and as often, as op2's SQL over the rows it is given."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    decontaminate.without_contaminated(documents(spark), bench).write.parquet(f"{tmp_path}/kept")
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/kept/*.parquet'")
    con.execute(f"CREATE TABLE taken AS {llm_queries.ORACLES['op2_mixing']}")
    want = dict(con.execute("SELECT doc_id, epochs FROM taken").fetchall())
    mixed = corpus_pipeline.mixed(spark, spark.read.parquet(f"{tmp_path}/kept"), SF)
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == want and len(want) > 50


def test_places_of_many_copies(spark, monkeypatch):
    """Lists of places and places of their own give each copy one place; ids that are null and texts that are null are kept apart."""
    rows = [(None, "x")] * 7 + [(1, "x")] * 3 + [(1, None)] * 4 + [(2, "")] * 2 + [(k, f"t{k}") for k in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"Shard": F.lit(-1), "grp": F.lit("g")})
    monkeypatch.setattr(sharding, "_LIST", 3)
    got = sharding.with_shards(docs, shards=7)
    assert got.columns == ["doc_id", "text", "grp", "shard", "slot"]
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    check_shards(out, 7)


def test_passing_tables_go(spark, tmp_path, monkeypatch):
    """Only what a stage decided stays of the tables it stored; nothing if it fails."""
    monkeypatch.setattr(common, "staging_dir", lambda _: str(tmp_path))
    kept = near_dups.one_of_each(documents(spark), similarity=0.8)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"chosen", "repeated"} and kept.count() > 0
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, "broken", lambda: common.stored(spark.range(3), "part") and 1 / 0)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"chosen", "repeated"}


def test_stages_on_empty_and_repeated_rows(spark):
    """An empty table gives no rows in any stage; rows repeated as they are stay or go together until one of each is taken."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), SF).count() == 0
    docs = documents(spark)
    twice = docs.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES[:3]:
        once = Counter(r["doc_id"] for r in stage(spark, docs, SF).select("doc_id").collect())
        again = Counter(r["doc_id"] for r in stage(spark, twice, SF).select("doc_id").collect())
        assert again == (once if name == "near duplicates" else once + once)
