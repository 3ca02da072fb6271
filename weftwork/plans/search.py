"""Search over code and notes, and small operators over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import records as N
from weftwork.operators import search as S
from weftwork.operators import text as X
from weftwork.plans.registry import query, table

#: What the files are made of: each part is one, its name and number in symbols, strings and comments.
_LINES = ["pub fn makeThing_{k}(x: i32) -> i32 {{", "    let total = x + {z}; // the {n} 命中盒", "    say('{n} of \\'the\\' day')", "}}", "struct HTTPRequest{m}<T> {{ a: T }}"]


def _files(spark, sf_dir):
    parts = [x.replace("{{", "{").replace("}}", "}") for x in _LINES]
    text = F.lit("\n".join(parts))
    for mark, value in (("{k}", F.col("p_partkey")), ("{z}", F.col("p_size")), ("{n}", F.col("p_name")), ("{m}", F.col("p_partkey") % 7)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return table(spark, sf_dir, "part").select(F.format_string("src/m%d.rs", "p_partkey").alias("path"), text.alias("text"))


#: Tokens of a file by the rules of the tokenizer, in SQL by parts: code, string, comment.
_TOKENS = """list_concat(
    ['pub', 'fn', 'make', 'thing', CAST(p_partkey AS VARCHAR), 'x', 'i32', 'i32', 'let', 'total', 'x', CAST(p_size AS VARCHAR)], string_split(p_name, ' '), ['命中', '中盒', 'say'], string_split(p_name, ' '), ['day', 'struct', 'http', 'request' || (p_partkey % 7), 't', 'a', 't'],
    ['make', 'thing', CAST(p_partkey AS VARCHAR), 'total', 'http', 'request' || (p_partkey % 7) || '<t'])"""


@query("code_tokens", f"WITH t AS (SELECT unnest({_TOKENS}) AS term, p_partkey FROM part) SELECT term, count(DISTINCT p_partkey) AS df, count(*) AS tf FROM t GROUP BY term")
def code_tokens(spark, sf_dir):
    return S.code_postings(_files(spark, sf_dir), "path", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_PATH = "'src/m' || p_partkey || '.rs'"


@query("symbol_lines", f"SELECT {_PATH} AS doc, 1 AS line, 'makeThing_' || p_partkey AS symbol FROM part UNION ALL SELECT {_PATH}, 2, 'total' FROM part UNION ALL SELECT {_PATH}, 5, 'HTTPRequest' || (p_partkey % 7) || '<T' FROM part")
def symbol_lines(spark, sf_dir):
    return S.symbols(_files(spark, sf_dir), "path", "text")


_ASKED = [("make thing", ["make", "thing"]), ("widget total", ["widget", "total"]), ("httprequest3", ["httprequest3"]), ("request3 red", ["request3", "red"])]
_SQL_ASKED = ", ".join(f"('{q}', '{t}')" for q, ts in _ASKED for t in ts)


@query("code_search", f"""
    WITH t AS (SELECT {_PATH} AS doc, p_partkey, unnest({_TOKENS}) AS term FROM part), p AS (SELECT doc, p_partkey, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc, count(*) AS dl FROM t GROUP BY doc),
    s AS (SELECT count(*) AS n, avg(dl) AS a FROM l), q(query, term) AS (VALUES {_SQL_ASKED}), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    sc AS (SELECT query, doc, p_partkey, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc), s GROUP BY ALL),
    y AS (SELECT p_partkey, line, lower(symbol) AS symbol FROM part, LATERAL (VALUES (1, 'makeThing_' || p_partkey), (2, 'total'), (5, 'HTTPRequest' || (p_partkey % 7) || '<T')) v(line, symbol)),
    b AS (SELECT query, p_partkey, count(*) AS n, min(line) AS line FROM y, (SELECT query, list(term) AS terms FROM q GROUP BY query) WHERE len(list_filter(terms, lambda t: starts_with(symbol, t))) > 0 GROUP BY ALL),
    r AS (SELECT query, doc, round(score + 2 * coalesce(n, 0), 6) AS score, coalesce(line, 0) AS line FROM sc LEFT JOIN b USING (query, p_partkey))
    SELECT query, doc, score, CAST(line AS INTEGER) AS line FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS k FROM r) WHERE k <= 10""")
def code_search(spark, sf_dir):
    f = _files(spark, sf_dir)
    terms = spark.createDataFrame([(q, t) for q, ts in _ASKED for t in ts], "query string, term string")
    index = S.code_postings(f, "path", "text")
    stats = X.collection(index.groupBy("doc").agg(F.first("dl").alias("dl")))
    hits = index.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    scored = S.symbol_bonus(X.bm25_scores(hits, stats, terms), S.symbols(f, "path", "text"), terms)
    return X.first_by(scored.select("query", "doc", F.round("score", 6).alias("score"), "line"), ["query"], [F.desc("score"), F.col("doc")], 10)


_PLACES = ["make thing 7", "makething_12", "request", "widget"]


@query("code_locate", f"""
    WITH y AS (SELECT {_PATH} AS doc, line, symbol, regexp_replace(lower(symbol), '[_-]', '', 'g') AS s FROM part, LATERAL (VALUES (1, 'makeThing_' || p_partkey), (2, 'total'), (5, 'HTTPRequest' || (p_partkey % 7) || '<T')) v(line, symbol)),
    q AS (SELECT query, regexp_replace(lower(query), '[_-]', '', 'g') AS whole, regexp_extract_all(lower(query), '[a-z0-9]+') AS words FROM (VALUES {", ".join(f"('{q}')" for q in _PLACES)}) v(query)),
    a AS (SELECT query, doc, line, symbol, CASE WHEN contains(s, whole) THEN 200 WHEN len(list_filter(words, lambda w: contains(s, w))) = len(words) THEN 150 WHEN len(list_filter(words, lambda w: contains(s, w))) > 0 THEN 60 END AS score FROM y, q),
    x AS (SELECT {_PATH} AS doc, line, lower(t) AS t FROM part, LATERAL (VALUES (1, 'pub fn makeThing_' || p_partkey || '(x: i32) -> i32 {{'), (2, 'let total = x + ' || p_size || '; // the ' || p_name), (3, 'say(' || p_name || ' of the day'), (4, '}}'), (5, 'struct HTTPRequest' || (p_partkey % 7) || '<T> {{ a: T }}')) v(line, t)),
    b AS (SELECT query, doc, line, '' AS symbol, 50 AS score FROM (SELECT query, doc, line, row_number() OVER (PARTITION BY query, doc ORDER BY line) AS k FROM x, q WHERE len(list_filter(words, lambda w: contains(t, w))) > 0) z
          WHERE k <= 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query = z.query AND a.doc = z.doc AND a.score IS NOT NULL)),
    u AS (SELECT * FROM a WHERE score IS NOT NULL UNION ALL SELECT * FROM b)
    SELECT query, doc, CAST(line AS INTEGER) AS line, symbol, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc, line) AS k FROM u) WHERE k <= 10""")
def code_locate(spark, sf_dir):
    return S.locate(_files(spark, sf_dir), spark.createDataFrame([(q,) for q in _PLACES], "query string"), "path", "text")


@query("search_rerank", """
    WITH c AS (SELECT event_type AS query, event_id AS doc, value AS score FROM events),
    k AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM c) WHERE rank < 20),
    v AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT DISTINCT event_type AS query, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS e FROM events),
    n AS (SELECT query, doc, round(coalesce(list_cosine_similarity(v.e, q.e), 0), 9) AS cosine FROM k LEFT JOIN v USING (doc) JOIN q USING (query)),
    r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) - 1 AS rank FROM n)
    SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM r) GROUP BY query, doc""")
def search_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("event_id").alias("doc"), F.col("value").alias("score"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = e.select("query").distinct().join(F.broadcast(v.where("doc = 0").select("vector")))
    return S.rerank(e, v, asked).withColumn("score", F.round("score", 12))


@query("cjk_spacing", "SELECT p_partkey, p_name || ' 命 中 盒 ' || p_size || ' 查 询' AS asked, p_name || '命 中 盒 ' || p_size || '查 询 ' AS content FROM part")
def cjk_spacing(spark, sf_dir):
    t = F.concat("p_name", F.lit("命中盒"), F.col("p_size").cast("string"), F.lit("查询"))
    return table(spark, sf_dir, "part").select("p_partkey", S.spaced_query(t).alias("asked"), S.spaced_content(t).alias("content"))


@query("document_upsert", "SELECT doc_id, lang, 'old' AS state FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(lang), 'new' FROM documents WHERE doc_id % 3 = 0")
def document_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.upsert(d.select("doc_id", "lang", F.lit("old").alias("state")), d.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("state")), "doc_id")


@query("substring_search", "WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE NOT contains(text, chr(0))) SELECT doc, CAST(line AS INTEGER) AS line, text FROM l WHERE contains(text, 'Th') ORDER BY doc, line LIMIT 100")
def substring_search(spark, sf_dir):
    return S.containing(table(spark, sf_dir, "documents"), "Th", "doc_id", "text")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("rule_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def rule_filter(spark, sf_dir):
    return N.keep_rules(_events(spark, sf_dir), ["error", "click"], "event_type").select("event_id", "event_type")


@query("set_union", "SELECT o_orderstatus, list_sort(list_distinct(list(o_orderpriority))) AS o_orderpriority FROM orders GROUP BY o_orderstatus")
def set_union(spark, sf_dir):
    return N.set_union(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")


@query("directory_summary", "SELECT CASE WHEN o_custkey % 13 = 0 THEN '.' ELSE 'src/d' || (o_custkey % 13) END AS dir, count(*) AS files, CAST(sum(least(o_orderkey % 17, 10)) AS BIGINT) AS symbols FROM orders GROUP BY 1 ORDER BY files DESC, dir LIMIT 20")
def directory_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.when(F.col("o_custkey") % 13 == 0, F.format_string("f%d.py", "o_orderkey")).otherwise(F.format_string("src/d%d/f%d.py", F.col("o_custkey") % 13, "o_orderkey"))
    return N.directory_summary(o.select(path.alias("path"), (F.col("o_orderkey") % 17).alias("n")), "path", "n")


@query("health_score", "SELECT l_orderkey, count(*) AS items, CAST(greatest(100 - sum(CASE WHEN l_quantity > 45 THEN 8 WHEN l_quantity > 30 THEN 4 WHEN l_quantity > 15 THEN 2 ELSE 0 END), 0) AS BIGINT) AS score FROM lineitem GROUP BY l_orderkey")
def health_score(spark, sf_dir):
    severity = F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") > 30, "medium").when(F.col("l_quantity") > 15, "low").otherwise("info")
    return N.health(table(spark, sf_dir, "lineitem").select("l_orderkey", severity.alias("severity")), "l_orderkey")


@query("dependents_of_changed", """
    WITH d AS (SELECT DISTINCT l_suppkey AS unit, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 5 = 0), k AS (SELECT unit, symbol FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY symbol) AS rn FROM d) WHERE rn <= 8),
    r AS (SELECT DISTINCT l_suppkey AS unit, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'A')
    SELECT r.unit, list_sort(list_distinct(list(k.unit))) AS depends_on FROM r JOIN k USING (symbol) WHERE r.unit <> k.unit GROUP BY r.unit""")
def dependents_of_changed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("symbol"), "l_returnflag")
    changed = li.where("unit % 5 = 0").select("unit").distinct()
    return N.dependents(li.where("l_returnflag = 'R'").drop("l_returnflag"), li.where("l_returnflag = 'A'").drop("l_returnflag"), changed)


@query("failure_evidence", """
    WITH f AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND value > 200),
    s AS (SELECT user_id AS k, 1 AS rank, ts AS "at", event_id AS what FROM events WHERE event_type = 'error' UNION ALL SELECT o_custkey, 2, o_orderdate, o_orderkey FROM orders UNION ALL SELECT user_id, 3, ts, event_id FROM events WHERE event_type = 'click'),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, "at" DESC, what) AS rn FROM s WHERE k IN (SELECT k FROM f))
    SELECT k, rank, "at", what FROM c WHERE rn <= 5""")
def failure_evidence(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("what"), "event_type", "value")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("what"))
    return N.evidence(e.where("event_type = 'error' AND value > 200").select("k"), [(1, e.where("event_type = 'error'")), (2, orders), (3, e.where("event_type = 'click'"))], "k")


@query("causal_trace", """
    WITH c AS (SELECT 'commit' AS kind, 0 AS o, o_orderdate AS "at", o_orderkey AS id, o_orderpriority AS what FROM orders ORDER BY "at" DESC, id DESC LIMIT 20), t AS (SELECT 'tool_call' AS kind, 1 AS o, ts AS "at", event_id AS id, event_type AS what FROM events ORDER BY "at" DESC, id DESC LIMIT 30)
    SELECT kind, "at", id, what FROM (SELECT * FROM c UNION ALL SELECT * FROM t) ORDER BY o, "at" DESC, id DESC LIMIT 15""")
def causal_trace(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("what"))
    return N.causal_chain(c, _events(spark, sf_dir).select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("what")))


@query("failed_calls", "SELECT event_id FROM events WHERE contains(lower(event_type), 'err') OR value < 5")
def failed_calls(spark, sf_dir):
    return N.failures(_events(spark, sf_dir).withColumn("ok", F.col("value") >= 5), "ERR", "event_type", "ok").select("event_id")


@query("note_counts", "SELECT 'kind' AS what, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'tag', o_orderpriority, count(*) FROM orders WHERE o_orderpriority <> '' GROUP BY 2")
def note_counts(spark, sf_dir):
    return N.note_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("recent_notes", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3")
def recent_notes(spark, sf_dir):
    return N.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 3).select("o_orderkey", "o_orderdate")


@query("list_traces", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20")
def list_traces(spark, sf_dir):
    return N.newest(_events(spark, sf_dir), "ts", "event_id", 20, F.col("user_id") == 7).select("event_id", "ts")


@query("collected", "SELECT event_type AS agent, count(*) AS found, count(DISTINCT user_id * 1000 + CAST(floor(value) AS BIGINT)) FILTER (WHERE user_id * 1000 + CAST(floor(value) AS BIGINT) NOT IN (SELECT user_id * 1000 + CAST(floor(value) AS BIGINT) FROM events WHERE event_id % 4 = 0)) AS new FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def collected(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("agent"), (F.col("user_id") * 1000 + F.floor("value")).alias("k"))
    return N.collected(e.where("event_id % 4 <> 0"), e.where("event_id % 4 = 0"), "agent", "k")


@query("log_after_cursor", "SELECT event_id, CAST(seq AS INTEGER) AS seq FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM events WHERE user_id = 3) WHERE seq > 5 AND seq <= 25")
def log_after_cursor(spark, sf_dir):
    return N.after(_events(spark, sf_dir).where("user_id = 3").select("event_id"), 5, "event_id", 20)


@query("activity_status", """
    WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50), m AS (SELECT max(ts) AS now FROM events)
    SELECT CAST(floor(epoch_us(now) / 1000000 - epoch_us((SELECT max(ts) FROM t WHERE event_type = 'click')) / 1000000) AS BIGINT) AS age,
           floor(epoch_us(now) / 1000000 - epoch_us((SELECT max(ts) FROM t WHERE event_type = 'click')) / 1000000) < 30 AS active, (SELECT arg_max(event_id, (ts, event_id)) FROM t WHERE event_type = 'click' AND value > 50) AS last_write FROM m""")
def activity_status(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return N.activity(e, now, F.col("event_type") == "click", F.col("value") > 50, "ts", "event_id")


@query("next_predictions", """
    WITH p AS (SELECT event_type AS tool, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), c AS (SELECT tool, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL),
    k AS (SELECT tool, next, row_number() OVER (PARTITION BY tool ORDER BY n DESC, next) AS o FROM c), u AS (SELECT tool, next, o FROM k WHERE o <= 3 AND next IN ('click', 'view') UNION ALL SELECT tool, next, o + 1000 FROM (SELECT DISTINCT tool FROM k), (VALUES ('scan', 0), ('check', 1)) v(next, o))
    SELECT tool, next, CAST(rank AS INTEGER) AS rank FROM (SELECT tool, next, row_number() OVER (PARTITION BY tool ORDER BY o) AS rank FROM u) WHERE rank <= 3""")
def next_predictions(spark, sf_dir):
    from weftwork.plans.logs import bigram_transitions

    return N.predictions(bigram_transitions(spark, sf_dir).select("tool", "next", "rank"), ["click", "view"], ["scan", "check"])


@query("changed_file_scan", "SELECT 'src/m' || p_partkey || '.rs' AS doc, 2 AS line FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 50)")
def changed_file_scan(spark, sf_dir):
    changed = table(spark, sf_dir, "part").orderBy("p_partkey").limit(50).select(F.format_string("src/m%d.rs", "p_partkey").alias("path"))
    return S.containing(_files(spark, sf_dir).join(changed, "path", "left_semi"), "total =", "path", "text").select("doc", "line")


@query("ragged_flatten", "SELECT p_partkey, [CAST(p_size AS VARCHAR), p_name, '3', 'true', CAST(p_partkey AS VARCHAR)] AS leaves FROM part")
def ragged_flatten(spark, sf_dir):
    t = F.format_string('[[%d, ["%s", [[3]]]], true, [], [[%d]]]', "p_size", "p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", N.flattened(t).alias("leaves"))


@query("term_density", """
    SELECT doc_id, round(((length(low) - length(replace(low, 'the', ''))) / 3 + (length(low) - length(replace(low, 'data', ''))) / 4) / (length(coalesce(text, '')) + 1), 9) AS score
    FROM (SELECT doc_id, text, lower(coalesce(text, '')) AS low FROM documents)""")
def term_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.term_density(F.col("text"), ["the", "Data", ""]), 9).alias("score"))


@query("hash_embedding", """
    SELECT p_partkey, list_transform([
        'name:' || p_name, 'arg_count:' || p_size, 'has_docstring:' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END, 'stmt_count:' || length(p_name),
        'calls:[''' || array_to_string(string_split(p_name, ' ')[:10], ''', ''') || ''']', 'decorators:[''' || p_brand || ''']'],
        lambda x: CAST('0x' || left(sha256(x), 4) AS INTEGER) % 1024)::VARCHAR AS vector FROM part""")
def hash_embedding(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = S.hash_embedding(F.col("p_name"), F.col("p_size"), F.col("p_size") % 2 == 0, F.length("p_name"), F.split("p_name", " "), F.array("p_brand"))
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join(v, ", "), F.lit("]")).alias("vector"))


#: A tree of tokens for each part: a size two levels down, a colour three levels down, a name at the top, and a branch without tokens.
_TREE = '{"size": {"%s": {"$type": "dimension", "$value": {"value": %d, "unit": "px"}}}, "name": {"$type": "text", "$value": "%s"}, "a": {"b": {"c": {"$type": "color", "$value": {"components": [0.12345, 1, 0.5]}}}, "n": {"m": {}}}}'


@query("lookup_tokens", """
    SELECT p_partkey, 'size.' || p_brand AS name, 'dimension' AS type, p_size || 'px' AS value FROM part
    UNION ALL SELECT p_partkey, '.name', 'text', p_name FROM part
    UNION ALL SELECT p_partkey, 'a.b.c', 'color', 'rgba(0.123,1,0.5, 1.0)' FROM part""")
def lookup_tokens(spark, sf_dir):
    trees = table(spark, sf_dir, "part").select("p_partkey", F.format_string(_TREE, "p_brand", "p_size", "p_name").alias("tree"))
    return S.lookup_tokens(trees, "p_partkey", "tree")
