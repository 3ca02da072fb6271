"""Line diffs of documents: an edited version of each with numbered lines, and each document against the next, a word a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import line_diff as D
from weftwork.plans.registry import query, table


@query(
    "line_diff_opcodes",
    """
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, i, (i * 7 + doc_id) % 11 AS act FROM l),
    f AS (SELECT doc_id, i, CASE WHEN act IN (0, 3) THEN 0 ELSE 1 END AS kept, CASE WHEN act = 3 THEN 1 ELSE 0 END AS changed, CASE WHEN act = 6 THEN 1 ELSE 0 END AS put FROM a),
    g AS (SELECT *, sum(kept) OVER w AS gap, sum(kept + changed + put) OVER w AS upto FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    e AS (SELECT doc_id, gap, sum(1 - kept) AS gone, sum(changed + put) AS came, CASE WHEN gap = 0 THEN 0 ELSE min(i) END AS i1, CASE WHEN gap = 0 THEN 0 ELSE min_by(upto - put, i) END AS j1 FROM g GROUP BY doc_id, gap)
    SELECT doc_id, CASE WHEN gone > 0 AND came > 0 THEN 'replace' WHEN gone > 0 THEN 'delete' ELSE 'insert' END AS tag,
           CAST(i1 AS INTEGER) AS i1, CAST(i1 + gone AS INTEGER) AS i2, CAST(j1 AS INTEGER) AS j1, CAST(j1 + came AS INTEGER) AS j2
    FROM e WHERE gone + came > 0""",
)
def line_diff_opcodes(spark, sf_dir):
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("i"), F.concat((i + 1).cast("string"), F.lit(": "), F.regexp_replace(x, r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", " ")).alias("x")))
    act = lambda s: (s["i"] * 7 + F.col("doc_id")) % 11
    edited = lambda s: F.when(act(s) == 0, F.array().cast("array<string>")).when(act(s) == 3, F.array(F.concat(s["x"], F.lit("!")))).when(act(s) == 6, F.array(s["x"], F.concat(s["x"], F.lit(" and more")))).otherwise(F.array(s["x"]))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", numbered.alias("n"))
    pairs = d.select("doc_id", F.concat_ws("\n", F.transform("n", lambda s: s["x"])).alias("before"), F.concat_ws("\n", F.flatten(F.transform("n", edited))).alias("after"))
    return D.line_diff(pairs, "before", "after").select("doc_id", F.inline(D.edits(F.col("ops"))))


@query(
    "line_diff_rebuilt",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \n\r\t\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]+') AS w FROM documents)
    SELECT a.doc_id, sha256(array_to_string(b.w, chr(10))) AS rebuilt, CAST(len(b.w) - len(a.w) AS BIGINT) AS growth, CAST(len(b.w) AS BIGINT) AS n_new
    FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""",
)
def line_diff_rebuilt(spark, sf_dir):
    words = F.concat_ws("\n", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n\r\t\x0B\x0C\x1C-\x1E\x85\u2028\u2029]+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("next")), "doc_id")
    ops, old, new = F.col("ops"), F.col("old"), F.col("new")
    growth = F.size(D.added(ops)) - F.size(D.removed(ops, old))
    out = D.line_diff(pairs, "w", "next")
    return out.select("doc_id", F.sha2(F.concat_ws("\n", D.rebuilt(ops, old, new)), 256).alias("rebuilt"), growth.cast("long").alias("growth"), F.size("new").cast("long").alias("n_new"))
