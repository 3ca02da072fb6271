"""Text retrieval, similarity and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import rules as R
from weftwork.operators import text as X
from weftwork.plans.registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)"


@query("identifier_split", r"""SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name || 'HTTPRequest_' || p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM part""")
def identifier_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.identifier_parts(F.concat("p_name", F.lit("HTTPRequest_"), "p_brand")).alias("parts"))


@query("inverted_index", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def inverted_index(spark, sf_dir):
    return X.postings(_docs(spark, sf_dir), "doc_id", X.plain_tokens(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_BM25 = f"""
    WITH tok AS (SELECT doc_id AS doc, unnest({_TOK}) AS term FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
    dl AS (SELECT doc_id AS doc, len({_TOK}) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
    q AS (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    sc AS (SELECT query, p.doc, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score, count(*) AS matched
           FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl ON dl.doc = p.doc, s GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc)
"""


def _bm25(spark, sf_dir, conjunctive=False):
    d = _docs(spark, sf_dir)
    t = X.plain_tokens(F.col("text"))
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(t).alias("term"))
    if conjunctive:
        return X.conjunctive_scores(d, "doc_id", t, terms)
    return X.bm25_scores(*X.term_hits(d, "doc_id", t, terms), terms)


def _ranked(scored):
    return X.first_by(scored.withColumn("score", F.round("score", 6)), ["query"], [F.desc("score"), F.col("doc")], 10)


@query("bm25_search", _BM25 + "SELECT query, doc, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_search(spark, sf_dir):
    return _ranked(_bm25(spark, sf_dir))


@query("fts_conjunctive", _BM25 + ", need AS (SELECT query, count(*) AS need FROM q GROUP BY query) SELECT query, doc, round(score, 6) AS score FROM sc JOIN need USING (query) WHERE matched = need")
def fts_conjunctive(spark, sf_dir):
    return _bm25(spark, sf_dir, True).withColumn("score", F.round("score", 6))


@query("rrf_fusion", """
    WITH a AS (SELECT event_type AS query, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank FROM events),
    b AS (SELECT event_type AS query, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) - 1 AS rank FROM events),
    u AS (SELECT * FROM a WHERE rank < 50 UNION ALL SELECT * FROM b WHERE rank < 50)
    SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY query, doc""")
def rrf_fusion(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("event_id").alias("doc"), "value", "ts")
    parts = [e.select("query", "doc", (F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "doc")) - 1).alias("rank")).where("rank < 50") for c in ("value", "ts")]
    return X.rrf(parts[0].unionByName(parts[1])).withColumn("score", F.round("score", 12))


@query("cosine_top_k", """
    WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 9) AS cosine FROM embeddings, q WHERE query <> vec_id)
    SELECT query, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rn FROM s) WHERE rn <= 5""")
def cosine_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return X.cosine_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 9))


_L = "l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("secret_scan", f"""
    WITH {_L}, h AS (SELECT doc, line, regexp_extract(text, {_sql(X.SECRET)}, 0) AS strong, regexp_extract(text, {_sql(X.SECRET_ASSIGNED)}, 0) AS weak FROM l)
    SELECT doc, CAST(line AS INTEGER) AS line, CASE WHEN strong <> '' THEN 'token' ELSE 'assigned' END AS kind, left(CASE WHEN strong <> '' THEN strong ELSE weak END, 12) AS masked
    FROM h WHERE strong <> '' OR weak <> ''""")
def secret_scan(spark, sf_dir):
    return X.secrets(_docs(spark, sf_dir), "doc_id", "text")


@query("secret_lines", f"WITH {_L} SELECT doc, CAST(line AS INTEGER) AS line, left(regexp_extract(text, {_sql(X.SECRET_ASSIGNED)}, 0), 12) AS masked FROM l WHERE regexp_matches(text, {_sql(X.SECRET_ASSIGNED)})")
def secret_lines(spark, sf_dir):
    hit = F.regexp_extract("text", X.SECRET_ASSIGNED, 0)
    return X.lines(_docs(spark, sf_dir), "doc_id", "text").where(hit != "").select("doc", "line", F.substring(hit, 1, 12).alias("masked"))


@query("keyword_classifier", "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.DROP_DOMAINS + X.DROP_KEYWORDS) + " THEN 'drop' WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.KEEP_DOMAINS) + " THEN 'keep' ELSE 'keep_unknown' END AS verdict FROM documents")
def keyword_classifier(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.classify(F.col("text")).alias("verdict"))


@query("data_filter_counts", "SELECT CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in X.KEEP_DOMAINS) + " THEN 'keep' ELSE 'keep_unknown' END AS verdict, count(*) AS n FROM conversations GROUP BY 1")
def data_filter_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(X.classify(F.to_json(F.struct("role", "text"))).alias("verdict"))
    return c.groupBy("verdict").agg(F.count("*").alias("n"))


@query("commit_tags", "SELECT doc_id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in X.TAGS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM documents")
def commit_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.tags(F.col("text")).alias("tags"))


@query("lesson_lines", """
    WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS line, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
    s AS (SELECT doc, line, CASE WHEN length(t) <= 200 THEN t ELSE left(t, 197) || '...' END AS summary FROM l WHERE length(t) >= 8 AND (""" + " OR ".join(f"contains(t, '{w}')" for w in X.LESSON_SIGNALS) + """))
    SELECT doc, CAST(line AS INTEGER) AS line, left(sha256(summary), 16) AS id, summary FROM s""")
def lesson_lines(spark, sf_dir):
    return X.lessons(_docs(spark, sf_dir), "doc_id", "text")


@query("repeated_sentences", r"""
    WITH s AS (SELECT doc_id AS doc, trim(unnest(regexp_split_to_array(text, '[.!?。！？\n]+'))) AS sentence FROM documents)
    SELECT doc, sentence, count(*) AS n FROM s WHERE length(sentence) >= 12 GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_sentences(spark, sf_dir):
    return X.repeated_sentences(_docs(spark, sf_dir), "doc_id", "text")


@query("chat_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(role || ' ' || text), 'the ha') AND role = 'user' ORDER BY conv_id, turn LIMIT 50")
def chat_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.where(F.contains(F.lower(F.concat_ws(" ", "role", "text")), F.lit("the ha")) & (F.col("role") == "user")).orderBy("conv_id", "turn").limit(50).select("conv_id", "turn")


@query("word_references", r"""
    WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
    SELECT doc, CAST(line AS INTEGER) AS line, starts_with(text, 'The ') AS defines FROM l WHERE regexp_matches(text, '\bthe\b')""")
def word_references(spark, sf_dir):
    return X.lines(_docs(spark, sf_dir), "doc_id", "text").where(F.rlike("text", F.lit(r"\bthe\b"))).select("doc", "line", F.col("text").startswith("The ").alias("defines"))


@query("email_valid", r"SELECT doc_id, regexp_matches(lower(source) || '@x-' || lang || '.org', '^[\w.+-]+@[\w-]+\.[\w.]+$') AS ok, regexp_matches(source, '^[\w.+-]+@[\w-]+\.[\w.]+$') AS bad FROM documents")
def email_valid(spark, sf_dir):
    pattern = F.lit(r"(?U)^[\w.+-]+@[\w-]+\.[\w.]+$")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.rlike(F.concat(F.lower("source"), F.lit("@x-"), "lang", F.lit(".org")), pattern).alias("ok"), F.rlike("source", pattern).alias("bad"))


_EMPTY_CLASS = r"[\s\x0B" + "".join("\\" + c if c in "[]\\^-" else c for c in dict.fromkeys(R.EMPTY_CHARS)).replace("'", "''") + "]"
_REASONS = X.DROP_DOMAINS + X.DROP_KEYWORDS
_MARKED = f"SELECT to_json({{'role': role, 'text': text || CASE WHEN conv_id % 3 = 0 THEN ([{', '.join(repr(w) for w in _REASONS)}])[1 + conv_id % {len(_REASONS)}] || CASE WHEN turn % 2 = 0 THEN '{_REASONS[0]}' ELSE '' END ELSE '' END}}) AS t FROM conversations"


@query(
    "data_filter_reasons",
    f"""
    WITH c AS ({_MARKED}), r AS (SELECT list_filter([{', '.join(repr(w) for w in _REASONS)}], lambda w: contains(lower(t), w)) AS why FROM c)
    SELECT reason, count(*) AS n FROM (SELECT unnest(why) AS reason FROM r) GROUP BY reason UNION ALL SELECT 'dropped', count(*) FROM r WHERE len(why) > 0 UNION ALL SELECT 'kept', count(*) FROM r WHERE len(why) = 0""",
)
def data_filter_reasons(spark, sf_dir):
    """A third of the conversations name something that is dropped, some of them two things."""
    k = F.col("conv_id")
    word = F.element_at(F.array(*map(F.lit, _REASONS)), (k % len(_REASONS) + 1).cast("int"))
    more = F.when(k % 3 == 0, F.concat(word, F.when(F.col("turn") % 2 == 0, _REASONS[0]).otherwise(""))).otherwise("")
    c = table(spark, sf_dir, "conversations").select(X.drop_reasons(F.to_json(F.struct("role", F.concat("text", more).alias("text")))).alias("why"))
    both = F.concat("why", F.array(F.when(F.size("why") > 0, "dropped").otherwise("kept")))
    return c.select(F.explode(both).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "text_densities",
    f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' 的是 好。好' WHEN 1 THEN '' ELSE ' The end' END AS t FROM documents UNION ALL SELECT -doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' 的,' END FROM documents WHERE doc_id > 0),
    c AS (SELECT doc_id, t, regexp_replace(t, '{_EMPTY_CLASS}', '', 'g') AS c, regexp_extract_all(t, '[A-Za-z]+') AS w FROM t)
    SELECT doc_id, round(CASE WHEN c = '' THEN 1 ELSE len(list_distinct(regexp_extract_all(c, '(?s).'))) / length(c) END, 9) AS diversity, round(CASE WHEN t = '' THEN 0 ELSE length(c) / length(t) END, 9) AS density,
           round(CASE WHEN len(w) = 0 THEN -1 ELSE len(list_filter(w, lambda x: lower(x) NOT IN ({', '.join(repr(w) for w in R.EMPTY_WORDS)}))) / len(w) END, 9) AS content_words FROM c""",
)
def text_densities(spark, sf_dir):
    """Texts with words and characters that say nothing, and with them texts without a letter or without anything."""
    d, k = _docs(spark, sf_dir).select("doc_id", "text"), F.col("doc_id")
    more = F.when(k % 3 == 0, " 的是 好。好").when(k % 3 == 1, "").otherwise(" The end")
    bare = d.where(k > 0).select((-k).alias("doc_id"), F.when(k % 2 == 0, "").otherwise(" 的,").alias("t"))
    t = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t")).unionByName(bare)
    return t.select("doc_id", R.text_density(F.col("t")).alias("d")).select("doc_id", *(F.round(f"d.{c}", 9).alias(c) for c in ("diversity", "density", "content_words")))


@query("text_density", "SELECT doc_id, len(list_distinct(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), ''))) AS distinct_letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) AS letter_share FROM documents WHERE length(text) > 0 AND regexp_matches(text, '[A-Za-z]')")
def text_density(spark, sf_dir):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    d = _docs(spark, sf_dir).where((F.length("text") > 0) & F.rlike("text", F.lit("[A-Za-z]")))
    return d.select("doc_id", F.size(F.array_distinct(F.split(letters, ""))).cast("long").alias("distinct_letters"), (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.length("text")).alias("letter_share"))


@query("pattern_mining", r"""
    WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS pattern FROM documents)
    SELECT pattern, count(*) AS n FROM w GROUP BY pattern HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 20""")
def pattern_mining(spark, sf_dir):
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)).alias("pattern"))
    return w.groupBy("pattern").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "pattern").limit(20)


@query("truncated_view", "SELECT doc_id, left(text, 80) AS snippet, left(text, 200) AS title FROM documents")
def truncated_view(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 80).alias("snippet"), F.substring("text", 1, 200).alias("title"))


@query("layer_check", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS code, (length(text) - length(replace(text, 'and', ''))) // 3 AS ui, CASE WHEN (length(text) - length(replace(text, 'the', ''))) // 3 < 3 THEN 'code' WHEN (length(text) - length(replace(text, 'and', ''))) // 3 < 3 THEN 'ui' ELSE 'done' END AS stage FROM documents")
def layer_check(spark, sf_dir):
    count = lambda w: F.regexp_count("text", F.lit(w)).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count("the").alias("code"), count("and").alias("ui"), F.when(count("the") < 3, "code").when(count("and") < 3, "ui").otherwise("done").alias("stage"))
