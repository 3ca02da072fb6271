"""WordPiece over all documents, with a small stated vocabulary of letters and syllables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import wordpiece as W
from weftwork.plans.registry import query, table

_SYLLABLES = "a b c d e f g h i l m n o p r s t u v w th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi the and ing tion ent".split()
_VOCABULARY = [W.PAD, W.UNKNOWN, W.BEGIN, W.END, ",", ". ", *_SYLLABLES, *(W.INNER + s for s in _SYLLABLES if s not in ("b", "w")), "this", "with"]
_SQL_VOCABULARY = ", ".join(f"('{p}', {i})" for i, p in enumerate(_VOCABULARY))
_CLASS = r"""\s\x0B.,!?;:()\[\]{}<>"''`~@#$%^&*_+=\-/\\|"""


@query(
    "wordpiece_ids",
    rf"""
    WITH RECURSIVE v(piece, id) AS (VALUES {_SQL_VOCABULARY}),
    d AS (SELECT doc_id, list_filter(regexp_extract_all(substr(coalesce(text, ''), 1, 4096), '[{_CLASS}]+|[^{_CLASS}]+'), lambda x: regexp_matches(x, '[^\s\x0B]')) AS w FROM documents),
    u AS (SELECT DISTINCT unnest(w) AS word FROM d),
    t AS (SELECT word, pos, n, CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, n) AS piece
          FROM (SELECT word, pos, unnest(range(1, least(5, len(word) - pos + 1) + 1)) AS n FROM (SELECT word, unnest(range(1, len(word) + 1)) AS pos FROM u))),
    b AS (SELECT word, pos, max(n) AS n, max_by(id, n) AS id FROM t JOIN v USING (piece) GROUP BY word, pos),
    c AS (SELECT word, CAST(1 AS BIGINT) AS pos, CAST([] AS INTEGER[]) AS ids, false AS bad FROM u
          UNION ALL SELECT c.word, c.pos + coalesce(b.n, 1), CASE WHEN b.n IS NULL THEN [1] ELSE list_append(c.ids, b.id) END, b.n IS NULL
          FROM c LEFT JOIN b ON b.word = c.word AND b.pos = c.pos WHERE NOT c.bad AND c.pos <= len(c.word)),
    e AS (SELECT word, CASE WHEN bool_or(bad) THEN [1] ELSE max_by(ids, pos) END AS ids FROM c WHERE bad OR pos > len(word) GROUP BY word),
    a AS (SELECT doc_id, i, e.ids FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) JOIN e USING (word)),
    f AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM a GROUP BY doc_id)
    SELECT doc_id, CAST(len(x) AS INTEGER) AS n, sha256(array_to_string(x, ',')) AS ids FROM (SELECT doc_id, [2] || coalesce(ids, [])[:254] || [3] AS x FROM d LEFT JOIN f USING (doc_id))""",
)
def wordpiece_ids(spark, sf_dir):
    vocabulary = spark.createDataFrame(list(enumerate(_VOCABULARY)), "id int, piece string")
    out = W.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return out.select("doc_id", F.size("input_ids").alias("n"), F.sha2(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ","), 256).alias("ids"))


@query("wordpiece_padding", "SELECT doc_id % 97 AS batch, count(*) AS n, 1::BIGINT AS lengths FROM documents GROUP BY ALL")
def wordpiece_padding(spark, sf_dir):
    """In a batch all rows are of one length."""
    vocabulary = spark.createDataFrame(list(enumerate(_VOCABULARY)), "id int, piece string")
    out = W.padded(W.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), F.col("doc_id") % 97)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct(F.size("input_ids"), F.size("attention_mask")).alias("lengths"))
