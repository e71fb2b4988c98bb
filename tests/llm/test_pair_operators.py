"""Jaccard join, decontamination, url filters, WARC and the pipeline against brute force."""

import base64
import hashlib
import io
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from spinward.llm import decontaminate, jaccard, urls, warc
from spinward.llm.queries import ORACLE, QUERIES, RULES
from tests.llm.helpers import TEXTS, edge_docs, empty_docs, shingles, words


def brute_components(rows):
    sets = [(d, set(shingles(t))) for d, t in rows]
    parts = jaccard.Components(len(sets))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parts.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            ids[parts.find(i)] = min(d, ids.get(parts.find(i), d))
    return sorted((str(d), len(s), str(ids.get(parts.find(i)) if s else d)) for i, (d, s) in enumerate(sets))


def test_jaccard_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_components(rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in QUERIES["op9_jaccard_join"](spark, sf_dir).collect())
    assert got == want


def near_copies(spark, n=60):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = [f"w{g}_{i}" for i in range(80)]
        for _ in range(n // 3):
            w = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                w[at] = f"z{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(w[: rng.integers(60, 81)])))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_jaccard_by_long_lists_and_blocks(spark):
    docs, rows = near_copies(spark)
    want = brute_components(rows)
    for options in ({}, {"short": 2}, {"block": 7}, {"short": 3, "extra": 0, "block": 3}):
        got = jaccard.jaccard_components(docs.repartition(5), **options).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want, options


def test_jaccard_edge_cases(spark):
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    got = jaccard.jaccard_components(edge_docs(spark)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    assert jaccard.jaccard_components(empty_docs(spark)).count() == 0
    kept = jaccard.keep_one(edge_docs(spark), jaccard.jaccard_components(edge_docs(spark)))
    assert kept.columns == edge_docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted([*{str(r.doc_id) for r in got if r.doc_id is not None and r.doc_id == r.component_id}, "None", "None"])


def test_one_of_each_component_stays_whatever_ids_repeat(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog number one", "wholly other words that nothing else in this table holds", "a third text of its own that has no copy at all here")
    rows = [(1, a), (1, b), (2, a + " "), (3, b), (4, c), (4, c), (5, ""), (5, ""), (5, None), (6, ""), (None, a), (None, a)]
    names = ["_kept", "_rows", "_nth", "row", "key", "root", "doc_id2", "digest", "copies"]
    docs = spark.createDataFrame([(i, t, *["v"] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = jaccard.keep_one(docs, jaccard.jaccard_components(docs))
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all({r[n] for n in names} == {"v"} for r in got)
    assert sorted([(str(r.doc_id), (r.text or "").strip()) for r in got]) == sorted([("1", a), ("1", b), ("4", c), ("5", ""), ("6", ""), ("None", a), ("None", a)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14))
def test_link_sets_is_exact(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = jaccard.Components(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard.linked(len(a & b), len(a), len(b)):
                want.join(i, j)
    assert jaccard.link_sets(arrays, block=2) == [want.find(i) for i in range(len(sets))]


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        own = words(text)
        for i, item in items:
            other = words(item)
            if not own or not other:
                continue
            size = min(5, len(other))
            want = Counter(shingles(item, size))
            if not want.keys() & set(shingles(text, size)):
                continue  # no window shares anything with the item
            n = min(len(own), len(other))
            for s in range(len(own) - n + 1):
                got = Counter(tuple(own[s + k : s + k + size]) for k in range(n - size + 1)) if n >= size else Counter([tuple(own)])
                least = (got & want).total()
                if least and least / (got | want).total() >= 0.8:
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for block in (1_000_000, 300):
        got = decontaminate.find_leaks(docs, items, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        kept = decontaminate.drop_leaks(docs, items, block_words=block)
        assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {d for d, _ in want}


def test_leaks_edge_cases(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no id here"), (4, "dog"), (5, TEXTS[10]), (6, "word " * 40)], "item_id long, text string")
    docs = edge_docs(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert decontaminate.find_leaks(empty_docs(spark), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=decontaminate.RADIUS, unique=True))
def test_multi_index_finds_all_within_the_radius(p, flips):
    q = p
    for b in flips:
        q ^= 1 << b
    assert (0, len(flips)) in decontaminate.HammingIndex([p, p ^ (2**64 - 1)]).within(q)


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules_equal_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = [None, "", "no scheme", "http://", "HTTP://COM/en/x", "https://a.b.Example.com/en/7", "http://example.com?x=/en/7", "http://xexample.com/en/7", "http://net/de/#/", "x://y://z/en/", "http://example.net/de/8", "http://ÉCOLE.com/en/é"]
    extra = spark.createDataFrame([(10_000 + i, u, None, "clash") for i, u in enumerate(odd)] + [(None, odd[5], None, "clash")], "page_id long, url string, html string, verdict string")
    every = pages.unionByName(extra.drop("verdict"))
    model = urls.fit_urls(every, RULES)
    got = urls.judge_urls(every, RULES, model).collect()
    url_of = {r.page_id: r.url for r in every.collect()}
    assert len(got) == len(url_of)
    for r in got:
        host, path, rule = brute_rule(url_of[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == (rule.verdict if rule else ("block" if r.block_odds > 0 else "allow"))
    assert urls.judge_urls(pages.limit(0), RULES, urls.fit_urls(pages.limit(0), RULES)).count() == 0
    assert urls.judge_urls(extra, RULES, urls.fit_urls(extra, RULES)).count() == len(odd) + 1


def test_block_odds_equal_exact_naive_bayes(spark):
    def name(i):
        return "".join("abcdefghijklmnopqrstuvwxyz"[i // 26**k % 26] for k in range(4))

    hosts = ("a.com", "b.org", "c.net")
    rows = [(i, f"http://{hosts[i % 3]}/" + "/".join(name(j * 7 % 90_000) for j in (*range(i * 150, i * 150 + 200), i % 11)), None) for i in range(300)]
    rows += [rows[2], rows[2], (None, rows[5][1], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [urls.Rule("block", "com/"), urls.Rule("allow", "org/")]
    model = urls.fit_urls(pages, rules)
    words = {i: model.tokens(*u.removeprefix("http://").split("/", 1)) for i, u, _ in rows}
    count = {v: Counter(t for i, u, _ in rows if hosts[k] in u for t in words[i]) for k, v in enumerate(("block", "allow"))}
    seen = len(count["block"] | count["allow"])
    weight = lambda v, t: math.log((count[v][t] + 0.5) / (count[v].total() + 0.5 * (seen + 1)))
    got = urls.judge_urls(pages, rules, model).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _, _ in rows) and seen > 1 << 15
    for r in got:
        odds = sum(weight("block", t) - weight("allow", t) for t in words[r.page_id])
        assert r.block_odds == pytest.approx(odds, abs=1e-6)
        assert r.verdict == ({"a.com": "block", "b.org": "allow"}.get(r.host) or ("block" if r.block_odds > 0 else "allow"))


def test_viterbi_segments_concatenated_words():
    model = {w: np.log(p) for w, p in {"free": 0.1, "online": 0.1, "games": 0.1, "on": 0.05, "line": 0.05, "a": 0.1}.items()}
    assert urls.segment("freeonlinegames", model) == ["free", "online", "games"]
    assert urls.segment("", model) == []


def test_warc_equals_its_sql(spark, sf_dir):
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op8_warc"](spark, sf_dir).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert got == sorted(db.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLE['op8_warc']})").fetchall())


def test_warc_revisits_and_edge_cases(spark):
    rows = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "v", ""), (None, "w", "same"), (None, "w", "lone"), (7, "r", "é\r\n\r\nWARC/1.1"), (7, "r", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "v", "v", "v", "v") for r in rows], "page_id long, url string, html string, id string, payload string, record_type string, digest string")
    got = warc.round_trip(pages).collect()
    facts = Counter((r.record_id, r.record_type, r.payload_bytes, r.refers_to) for r in got)
    u = "<urn:page:{}>".format
    assert facts == Counter([(u(1), "revisit", 4, u(5)), (u(5), "response", 4, None), (u(3), "revisit", 4, u(5)), (u(2), "revisit", 0, u(4)), (u(4), "response", 0, None), (u(""), "revisit", 4, u(5)), (u(""), "response", 4, None), (u(7), "response", 14, None), (u(7), "response", 14, None)])
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert all(r.record_type == "response" for r in warc.round_trip(pages, least_bytes=100).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_closed_at_their_size(spark):
    rows = [(i, f"http://h/{i}", "".join(map(chr, np.random.default_rng(i).integers(33, 120, 20_000)))) for i in range(20)] + [(99, "http://long/", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    records = warc.plan_records(pages)
    made = warc.write_archives(records, warc.shared_dir(spark, "few"), archive_bytes=5000).collect()
    assert len(made) > 3 and sum(r.records for r in made) == len(rows)
    got = {r.record_id: r.payload for r in warc.round_trip(pages, archive_bytes=5000).collect()}
    assert {f"<urn:page:{i}>": t.encode() for i, _, t in rows} == {k: bytes(v) for k, v in got.items()}


def test_the_normaliser_streams_any_members(tmp_path):
    records = [warc.record_bytes(i, f"http://h/{i}", b"x" * i * 70_000, "response", None) for i in range(5)]
    def gz(b):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(b) + c.flush()
    for data in (gz(b"".join(records)), b"".join(map(gz, records)), gz(records[0]) + gz(b"".join(records[1:]))):
        assert [r for _, r in warc.inflate_records(io.BytesIO(data))] == records
    try:
        list(warc.inflate_records(io.BytesIO(gz(b"".join(records)[:-9]))))
        raise AssertionError("a cut archive was read")
    except ValueError:
        pass


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf_dir).cache()
        assert kept.columns == columns and kept.count() <= before.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in kept.collect()}
    assert not any("token = " in (r.text or "") for r in kept.collect())


def test_pipeline_stages_on_edge_cases(spark, sf_dir):
    edge = edge_docs(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "spans AS source", "CAST(length(text) AS BIGINT) AS n_chars", "n_tokens")
    for docs in (edge, edge.limit(0)):
        for _name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count()
            assert out.columns == docs.columns or _name == "encode"
    masked = corpus_pipeline.mask_secrets(spark, edge, sf_dir).collect()
    assert sum("[SECRET]" in (r.text or "") for r in masked) == 2 and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in masked)
