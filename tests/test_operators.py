"""Micro-fixtures with known results."""

import datetime as dt
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from weftwork.functions import scalars as C
from weftwork.operators import graph, mesh, relations, search, state, telemetry, text
from weftwork.plans.meshes import FACES
from weftwork.sources import files
from weftwork.streaming import logs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_tool_summary_of_twenty_calls(spark):
    rows = [("t", float(k), k % 4 == 3, k) for k in range(1, 21)]
    df = spark.createDataFrame([(t, ms, e, i, dt.datetime(2026, 1, 1, 0, 0, i)) for t, ms, e, i in rows], "tool string, ms double, err boolean, seq int, ts timestamp")
    r = telemetry.tool_summary(df, "tool", "ms", F.col("err"), "ts", "seq").first()
    assert (r.calls, r.errors, r.error_rate, r.max_ms, r.avg_ms, r.p95_ms) == (20, 5, 0.25, 20.0, 10.5, 19.0)


@pytest.mark.parametrize(("values", "want"), [(list(range(12)), 10), ([7], 7), ([3, 3, 3], 3), (list(range(100)), 94)])
def test_nearest_rank(spark, values, want):
    df = spark.createDataFrame([(1, v) for v in values] + [(1, None)], "k int, v long")
    assert telemetry.nearest_rank_by(df, ["k"], F.col("v"), 0.95, "p").first().p == want


@pytest.mark.parametrize(("t", "want"), [("你好 world hello 12345", 6), ("hello world", 2), ("", 0), ("a", 1)])
def test_token_estimate(spark, t, want):
    assert one(spark, telemetry.estimated_tokens(F.col("t")), t=t) == want


def test_cost(spark):
    assert round(one(spark, telemetry.cost_usd(F.lit(1_000_000), F.lit(500_000))), 6) == 0.82
    assert round(one(spark, telemetry.cost_usd(F.lit(1_000_000), F.lit(0), "no such model")), 6) == 1.0


def test_cost_summary(spark):
    rows = spark.createDataFrame([("bug_scan", "d", "projA", 100, 200), ("bug_scan", "d", "projB", 50, 50), ("x", "d", "projA", 10, 5)], "tool string, day string, project string, tokens_in long, tokens_out long")
    got = {(r.by, r.key): (r.calls, r.tokens_in, r.tokens_out) for r in telemetry.cost_summary(rows).collect()}
    assert got[("all", "*")] == (3, 160, 255) and got[("tool", "bug_scan")][:2] == (2, 150) and got[("project", "projA")][0] == 2 and sum(k[0] == "day" for k in got) == 1


def test_suppression_counts_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 100, 1799, 1800, 3500, 3600)] + [("b", 5.0)], "k string, at double")
    assert sorted((r.k, r.at) for r in telemetry.suppress(df, ["k"], "at", 1800).collect()) == [("a", 0.0), ("a", 1800.0), ("a", 3600.0), ("b", 5.0)]


@pytest.mark.parametrize(("name", "want"), [("placementTarget", ["placement", "target"]), ("hit_module", ["hit", "module"]), ("HTTPRequest", ["http", "request"])])
def test_identifier_parts(spark, name, want):
    assert one(spark, text.identifier_parts(F.col("n")), n=name) == want


def test_cjk_bigrams(spark):
    assert one(spark, text.cjk_bigrams(F.col("t")), t="命中盒 a 你") == ["命中", "中盒", "你"]


def test_bm25_finds_the_document(spark):
    docs = spark.createDataFrame([("a", "cats and dogs"), ("b", "rust functions and traits"), ("c", "green tea")], "id string, t string")
    tok = text.plain_tokens(F.col("t"))
    terms = spark.createDataFrame([(1, "rust"), (1, "functions")], "query int, term string")
    got = text.bm25(text.postings(docs, "id", tok), docs.select(F.col("id").alias("doc"), F.size(tok).alias("dl")), terms).collect()
    assert [r.doc for r in got] == ["b"]


def test_rrf(spark):
    lists = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 0), (1, "c", 1)], "query int, doc string, rank int")
    got = {r.doc: r.score for r in text.rrf(lists).collect()}
    assert got == pytest.approx({"a": 1 / 60, "b": 1 / 61 + 1 / 60, "c": 1 / 61})


def test_secrets(spark):
    docs = spark.createDataFrame([(1, "x\nkey ghp_" + "a" * 36 + "\npassword = 'abcdefghijkl'"), (2, "nothing")], "id int, t string")
    got = sorted((r.doc, r.line, r.kind, r.masked) for r in text.secrets(docs, "id", "t").collect())
    assert got == [(1, 2, "token", "ghp_aaaaaaaa"), (1, 3, "assigned", "password = '")]
    assert text.secrets(docs, "id", "t", F.lit(True)).count() == 1


def test_clean_samples(spark):
    rows = [("c", "f", ["import x", "value.unwrap()"], ["ok"], 1), ("c", "f", ["later is a copy"], [], 2), ("d", "f", ["# note"], [], 3), ("e", "f", ["short"], [], 4), ("e", "g", ["short"], ["fix"], 5)]
    df = spark.createDataFrame(rows, "commit string, file string, bug_patterns array<string>, fix_patterns array<string>, seq int")
    got = {(r.commit, r.file): r.bug_patterns for r in text.clean_samples(df, F.col("seq")).collect()}
    assert got == {("c", "f"): ["value.unwrap()"], ("e", "g"): ["short"]}


def test_jaccard_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(6)
    sets = {i: {rng.randint(0, 30) for _ in range(rng.randint(1, 12))} for i in range(60)}
    for i in range(60, 90):
        sets[i] = set(sets[i - 60]) | {100 + i}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, x int")
    got = {(r.a, r.b): round(r.jaccard, 9) for r in relations.jaccard_pairs(df, "id", "x", 0.6).collect()}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    ids = sorted(rep.values())
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in ids for b in ids if a < b and 0.6 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 1}
    assert got == want and want


def test_asof_join_is_inclusive(spark):
    left = spark.createDataFrame([("f", 5), ("f", 1), ("f", 10), ("g", 3)], "file string, line int")
    right = spark.createDataFrame([("f", 5, "a"), ("f", 8, "b")], "file string, line int, name string")
    got = {(r.file, r.line): r.asof_name for r in relations.asof_join(left, right, ["file"], "line", "line", ["name"]).collect()}
    assert got == {("f", 5): "a", ("f", 1): None, ("f", 10): "b", ("g", 3): None}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "k string, h string")
    assert {r.k: r.status for r in relations.snapshot_diff(old, new, "k", "h").collect()} == {"a": "removed", "b": "changed", "d": "added"}
    assert {r.k for r in relations.snapshot_diff(old, new, "k", "h", truncated=True).collect()} == {"b", "d"}


def test_lesson_fold_clamps_in_order(spark):
    df = spark.createDataFrame([("l", 1, 0.3), ("l", 2, 0.4), ("l", 3, -1.0)], "id string, seq int, d double")
    r = state.lesson_utility(df, "id", ["seq"], "d").first()
    assert (r.utility, r.recall, r.archived) == (0.0, 3, True)
    assert state.lesson_utility(df.where("seq < 3"), "id", ["seq"], "d").first().utility == 1.0


def test_graph_fixture(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (6, 2), (9, 9)], "src long, dst long")
    starts = spark.createDataFrame([(4,)], "id long")
    assert {r.id: r.depth for r in graph.impact(edges, starts, 3).collect()} == {3: 1, 2: 2, 1: 3, 6: 3}
    assert {r.id: r.component for r in graph.components(edges).collect()} == dict.fromkeys([1, 2, 3, 4, 5, 6], 1)


def test_unit_cube(spark):
    v = spark.createDataFrame([(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "mesh_id int, vid int, x double, y double, z double")
    f = spark.createDataFrame([(1, i, *t) for i, t in enumerate(FACES)], "mesh_id int, fid int, a int, b int, c int")
    m = mesh.mass(v, f).first()
    assert (round(m.volume, 9), round(m.area, 9), round(m.ratio, 9), round(m.cx, 9)) == (1.0, 6.0, 6.0, 0.5)
    assert mesh.check(v, f).first().closed and mesh.check(v, f).first().euler == 2
    split = v.unionByName(spark.createDataFrame([(1, 8, 0.0, 0.0, 0.0)], v.schema))
    v2, f2 = mesh.weld(split, f)
    assert v2.count() == 8 and f2.count() == 12
    moved = mesh.transform(v, [[2, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    assert moved.agg(F.max("x"), F.min("x")).first()[:] == (3.0, 1.0)


@pytest.mark.parametrize(("column", "want"), [
    (lambda: C.div(F.lit(7), F.lit(2)), 3.5), (lambda: C.div(F.lit(1), F.lit(0)), None), (lambda: C.power(F.lit(2), F.lit(10)), 1024.0), (lambda: C.sqrt(F.lit(16)), 4.0), (lambda: C.sqrt(F.lit(-1)), None), (lambda: C.factorial(F.lit(5)), "120"),
    (lambda: C.factorial(F.lit(100000)), None), (lambda: C.factorial(F.lit(25)), "15511210043330985984000000"), (lambda: C.fibonacci(F.lit(10)), "55"), (lambda: C.fibonacci(F.lit(100)), "354224848179261915075"), (lambda: C.is_prime(F.lit(17)), True),
    (lambda: C.is_prime(F.lit(18)), False), (lambda: C.is_prime(F.lit(1)), False), (lambda: C.is_prime(F.lit(4)), False), (lambda: C.celsius_to_fahrenheit(F.lit(0)), 32.0), (lambda: C.median(F.array(F.lit(1), F.lit(2), F.lit(3))), 2.0),
    (lambda: C.median(F.array(F.lit(4), F.lit(1))), 2.5), (lambda: C.binary_search(F.array(F.lit(3), F.lit(1)), F.lit(3)), 1), (lambda: C.binary_search(F.array(F.lit(3), F.lit(1)), F.lit(2)), -1),
])
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


def test_jsonl_with_bad_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('not-json\n{"kind":"tool","ts":1.0,"tool":"a","wall_ms":2.5}\n\n')
    rows = files.read_jsonl(spark, str(tmp_path / "t.jsonl"))
    r = files.line_counts(rows).first()
    assert (r.good, r.bad) == (1, 1) and rows.where("tool = 'a'").first().wall_ms == 2.5


def test_tail_and_tree(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", float(i), i) for i in range(50)], "tool string, ts double, seq int")
    assert [r.tool for r in files.tail(df, 5).collect()] == ["t45", "t46", "t47", "t48", "t49"]
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "node_modules/b.py").write_text("y")
    got = files.read_tree(spark, str(tmp_path), ["py"]).collect()
    assert [(r.ext, r.text) for r in got] == [("py", "x = 1")]


def test_chat_adapters(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: A note\nts: 12.5\n---\nbody text\n")
    (tmp_path / "entries.json").write_text(json.dumps({"entries": [{"id": str(i), "timestamp": 1000.0 * i, "source": "s"} for i in range(9)]}))
    f = files.read_tree(spark, str(tmp_path))
    r = files.front_matter(f.where("ext = 'md'"), "me").first()
    assert (r.title, r.ts, r.text.strip()) == ("A note", 12.5, "body text")
    assert files.editor_entries(f.where("ext = 'json'"), "ed").count() == 5
    assert len(files.with_hash(f.select("text")).first().hash) == 16


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda n, rows: (src / n).write_text("".join(json.dumps(r) + "\n" for r in rows))
    put("1.json", [{"kind": "tool", "tool": "a", "ts": 0.0}, {"kind": "tool", "tool": "a", "ts": 3.0}, {"kind": "tool", "tool": "a", "ts": 5.0}])
    run = lambda: logs.run_available(logs.emit_gapped(logs.follow(spark, str(src)), "tool", "ts", 5.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    time.sleep(1)
    put("2.json", [{"kind": "tool", "tool": "a", "ts": 9.0}, {"kind": "tool", "tool": "a", "ts": 10.0}])
    run()
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 5.0, 10.0]


def test_append_unseen_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string").write.parquet(str(src))
    for cp in ("a", "b"):
        logs.append_unseen(logs.follow_parquet(spark, str(src), "id int, v string"), str(tmp_path / "store"), ["id"], str(tmp_path / cp)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_windowed_counts_wait_for_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(dt.datetime(2026, 1, 1, 0, m), "a") for m in (0, 1, 11, 12, 40)]
    spark.createDataFrame(rows, "at timestamp, k string").coalesce(1).write.parquet(str(src))
    logs.run_available(logs.windowed_counts(logs.follow_parquet(spark, str(src), "at timestamp, k string"), "at", "k", "10 minutes", "5 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 2]


def test_line_tokens_and_identifiers():
    from weftwork.operators.search import identifier_words, line_tokens

    assert identifier_words("placementTarget") == ["placement", "target"] and identifier_words("hit_module") == ["hit", "module"]
    assert identifier_words("HTTPRequest") == ["http", "request"] and identifier_words("AReq") == ["areq"] and identifier_words("a1B") == ["a1b"]
    assert line_tokens("let x = 'the value'; // 命中盒 calc the 12") == ["let", "x", "value", "命中", "中盒", "calc"]
    assert line_tokens("don't stop the 3") == ["don", "stop"]
    assert line_tokens(r"a = 'its \'red of' + b1 # of cup") == ["a", "red", "b1", "cup"]
    assert line_tokens("中a文") == ["a", "中文"] and line_tokens("中 文") == ["中", "文"] and line_tokens("") == []


def test_near_sentences_match_the_greedy_choice():
    import random

    from weftwork.operators.rules import near_sentences

    rng = random.Random(5)
    for _ in range(40):
        base = ["".join(rng.choice("abcd e") for _ in range(20)).strip() + "xyzxyz" for _ in range(4)]
        own = list(dict.fromkeys(b[:k] + rng.choice("abcde") + b[k + 1 :] for b in base for k in rng.sample(range(18), 3)))
        grams = [{c[i : i + 2] for i in range(len(c) - 1)} for c in ("".join(s.split()) for s in own)]
        over = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
        counted, want = set(), []
        for a in range(len(own)):
            free = a not in counted
            for b in range(a + 1, len(own)):
                if over(a, b) > 0.7:
                    hit = free and b not in counted
                    if hit:
                        counted.add(b)
                        free = False
                    want.append((a, b, over(a, b), hit))
        assert near_sentences(own, 0.7) == want


def test_symbol_bonus_adds_for_every_symbol_that_begins_with_a_term(spark):
    from weftwork.operators.search import symbol_bonus

    scored = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], "query string, doc string, score double")
    named = spark.createDataFrame([("a", 3, "fooBar"), ("a", 2, "Foo"), ("a", 1, "x"), ("c", 1, "foo")], "doc string, line int, symbol string")
    terms = spark.createDataFrame([("q", "foo"), ("q", "foob")], "query string, term string")
    assert sorted(map(tuple, symbol_bonus(scored, named, terms).collect())) == [("q", "a", 5.0, "Foo", 2), ("q", "b", 1.0, None, 0)]


def test_links_of_identical_sets_are_not_lost(spark):
    from weftwork.operators.relations import jaccard_links

    sets = {1: "abcde", 2: "abcde", 3: "abcdef", 4: "xyz"}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, x string")
    assert sorted(map(tuple, jaccard_links(rows, "id", "x", 0.8).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 4, 0)]


def test_term_density_by_plain_counts(spark):
    texts = [None, "", "The the aaa", "nothing", "AAAA a"]
    terms = ["the", "AA", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(search.term_density(F.col("t"), terms)).collect()]
    assert got == pytest.approx([sum((t or "").lower().count(g) for g in ("the", "aa")) / (len(t or "") + 1) for t in texts])
    assert spark.createDataFrame([("x",)], "t string").select(search.term_density(F.col("t"), [])).first()[0] == 0


def test_hash_embedding_by_plain_loops(spark):
    rows = [("f", 2, True, 3, ["a"] * 12, ["cache('x')", "both('\")", "back\\slash"]), ("g", 0, False, 1, [], []), (None, 1, True, 1, ["b"], ["c"])]
    df = spark.createDataFrame(rows, "name string, args int, doc boolean, statements int, calls array<string>, decorators array<string>")
    got = [r[0] for r in df.select(search.hash_embedding(*(F.col(c) for c in df.columns))).collect()]
    keys = ("name", "arg_count", "has_docstring", "stmt_count", "calls", "decorators")
    for have, r in zip(got, rows, strict=True):
        values = [*r[:4], r[4][:10], r[5]]
        assert have == [None if v is None else int(hashlib.sha256(f"{k}:{v}".encode()).hexdigest()[:4], 16) % 1024 for k, v in zip(keys, values, strict=True)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, {}),
        ("", {}),
        ("[1]", {}),
        ("{bad", {}),
        ('{"a": {"b": 1, "c": {}}}', {}),
        ('{"a": {"$value": 3}}', {".a": ("", "3")}),
        ('{"g": {"a": {"$type": "t", "$value": "x"}, "b": {"$value": {"value": 2}}}}', {"g.a": ("t", "x"), "g.b": ("", "2")}),
        ('{"g": {"a": {"$value": {"components": [0.33333, 1], "alpha": 0.5}}}}', {"g.a": ("", "rgba(0.333,1, 0.5)")}),
        ('{"g.a": {"b": {"$value": "1"}}, "g": {"a.b": {"$value": "2"}}}', {"g.a.b": ("", "2")}),
    ],
)
def test_tree_tokens(text, want):
    assert search.tree_tokens(text) == want


def test_lookup_tokens_of_empty_and_null_trees(spark):
    df = spark.createDataFrame([(1, None), (None, '{"a": {"b": {"$value": "é"}}}')], "id long, tree string")
    assert [tuple(r) for r in search.lookup_tokens(df, "id", "tree").collect()] == [(None, "a.b", "", "é")]
    assert search.lookup_tokens(df.where("false"), "id", "tree").collect() == []
