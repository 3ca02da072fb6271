"""Rule tables, detectors and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import rules as R
from weftwork.operators.recipes import Recipes
from weftwork.plans.registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query("line_rules", r"""
    WITH l AS (SELECT doc_id AS doc, lang, source, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
    r AS (SELECT * FROM (VALUES ('en', 'caps', '[A-Z]{6,}', 'Warning'), ('en', 'digits', '[0-9]{6,}', 'Info'), ('fr', 'symbols', '[#*$%&]{3}', 'Warning')) t(lang, rule, pattern, severity)),
    h AS (SELECT doc, line, rule, severity, row_number() OVER (PARTITION BY doc, rule ORDER BY line) AS k FROM l JOIN r USING (lang) WHERE regexp_matches(text, pattern) AND NOT starts_with(ltrim(text), 'The'))
    SELECT doc, CAST(line AS INTEGER) AS line, rule, severity FROM h WHERE k <= 5""")
def line_rules(spark, sf_dir):
    rules = spark.createDataFrame([("en", "caps", "[A-Z]{6,}", "Warning"), ("en", "digits", "[0-9]{6,}", "Info"), ("fr", "symbols", "[#*$%&]{3}", "Warning")], "ext string, rule string, pattern string, severity string")
    return R.apply_rules(_docs(spark, sf_dir), F.broadcast(rules), "doc_id", "text", "lang", F.lit("The"), 5)


#: What is put behind each document, by its number: something for each detector, with places that almost count.
_ENDINGS = [
    "\n\nIn recent years it grew.\nThis plays a key role, clearly; CLEARLY not. In Conclusion, to sum up, it plays a key role.",
    "\n\n" + "- item\n" * 12 + "\n##### deep\n",
    "\n\n# one\n## two\nSome words (Smith, 2020) and (Smith and Jones, 2021a) and [Smith 2020]\nand Smith et al. (2019), not (smith, 2020).",
    "\n\n" + "aba bab abba baab " * 8 + "\n\n众所周知，显然地。\n  近年来，随着 必定会 值得注意的是",
    "\n\nA sentence that stands here twice. Another one here. A sentence that stands here twice! A sentence that stood here twice? A sentence which stands here twice.",
]
_SQL_ENDINGS = ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in _ENDINGS)
_PHRASED = f"SELECT doc_id AS doc, coalesce(text, '') || ([{_SQL_ENDINGS}])[1 + doc_id % 5] AS text FROM documents"


def _phrased(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.coalesce("text", F.lit("")), end).alias("text"))


def _sum_of_places(column: str, phrases: list[str]) -> str:
    first = [p for k, p in enumerate(phrases) if not any(p != q and p.startswith(q) or p == q and j < k for j, q in enumerate(phrases))]
    quoted = [p.replace("'", "''") for p in first]
    return " + ".join(f"(length({column}) - length(replace({column}, '{p}', ''))) // {len(q)}" for p, q in zip(quoted, first, strict=True))


_BLANK = r"^[\s\x0B]*$"
_EMPTY = "".join(dict.fromkeys(R.EMPTY_CHARS))
_EMPTY_CLASS = r"[\s\x0B" + "".join("\\" + c if c in "[]\\^-" else c for c in _EMPTY).replace("'", "''") + "]"
_CITED = "|".join("(?:" + c + ")" for c in R.CITATIONS)
_HITS = f"""
    WITH d AS ({_PHRASED}),
    l AS (SELECT doc, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM d),
    m AS (SELECT doc, line, t, regexp_matches(t, '{_BLANK}') AS blank FROM l),
    g AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS part FROM m),
    p AS (SELECT doc, CAST(min(line) AS INTEGER) AS line, string_agg(t, chr(10) ORDER BY line) AS t FROM g WHERE NOT blank GROUP BY doc, part),
    c AS (SELECT doc, line, regexp_replace(t, '[#*`>\\-]', '', 'g') AS clean, regexp_replace(regexp_replace(t, '[#*`>\\-]', '', 'g'), '{_EMPTY_CLASS}', '', 'g') AS content FROM p),
    s AS (SELECT doc, line, nth, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT doc, line, unnest(a) AS x, generate_subscripts(a, 1) AS nth FROM (SELECT doc, line, regexp_split_to_array(t, '[。.！!？?\\n]+') AS a FROM p))),
    u AS (SELECT doc, min(line) AS line, min((line, nth)) AS place, count(*) AS n, s FROM s WHERE length(s) >= 12 GROUP BY doc, s),
    o AS (SELECT doc, line, s, row_number() OVER (PARTITION BY doc ORDER BY place) AS k, list_distinct(list_transform(range(1, length(regexp_replace(s, '\\s', '', 'g'))), lambda i: substr(regexp_replace(s, '\\s', '', 'g'), i, 2))) AS grams FROM u),
    f AS (SELECT doc, line, 'TEXT-001' AS rule, 1 AS n FROM p WHERE list_bool_or([{", ".join("starts_with(ltrim(t), '" + w.replace("'", "''") + "')" for w in R.OPENINGS)}])
          UNION ALL SELECT doc, CAST(line AS INTEGER), 'TEXT-002', {_sum_of_places("t", R.VAGUE)} FROM l
          UNION ALL SELECT doc, 0, 'TEXT-003', CAST(count(*) FILTER (WHERE regexp_matches(t, '^\\s*([-*+]|\\d+\\.)\\s+')) > greatest(10, 0.5 * count(*) FILTER (WHERE NOT blank)) AS INTEGER)
                 + CAST(max(CASE WHEN regexp_matches(t, '^#####{{1,2}}\\s') AND regexp_matches(t, '^#{{5,6}}\\s') THEN 1 ELSE 0 END) AS INTEGER)
                 + CAST(count(*) FILTER (WHERE regexp_matches(t, '^#{{1,6}}\\s')) > 0.2 * count(*) FILTER (WHERE NOT blank) AS INTEGER) FROM m GROUP BY doc
          UNION ALL SELECT doc, CAST(line AS INTEGER), 'TEXT-004', {_sum_of_places("t", R.CONFIDENT)} FROM l
          UNION ALL SELECT doc, CAST(line AS INTEGER), 'TEXT-005', {_sum_of_places("lower(t)", [x.lower() for x in R.TRANSITIONS])} FROM l
          UNION ALL SELECT doc, line, 'TEXT-006', 1 FROM c WHERE length(regexp_replace(clean, '[\\s\\x0B]', '', 'g')) >= 100
                 AND (len(list_distinct(regexp_extract_all(content, '(?s).'))) < 0.45 * length(content) OR length(content) < 0.55 * length(clean))
          UNION ALL SELECT doc, line, 'TEXT-007', count(*) FROM u WHERE n >= 2 GROUP BY doc, line
          UNION ALL SELECT doc, 0, 'TEXT-007', count(*) FROM near WHERE counted GROUP BY doc
          UNION ALL SELECT doc, CAST(line AS INTEGER), 'TEXT-008', len(regexp_extract_all(t, '{_CITED}')) FROM l)
"""
# what the detector of near sentences counts is an ordered choice: the pairs of a document are gone through one after the other
_PAIRS = """
    SELECT a.doc, a.k AS a, b.k AS b, len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) AS overlap
    FROM o a JOIN o b ON a.doc = b.doc AND a.k < b.k AND least(len(a.grams), len(b.grams)) >= 0.7 * greatest(len(a.grams), len(b.grams))
    WHERE len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) > 0.7"""
_HITS = _HITS.replace("    WITH d AS", "    WITH RECURSIVE d AS").replace("    f AS (", f"""    pr AS (SELECT doc, a, b, row_number() OVER (PARTITION BY doc ORDER BY a, b) AS k FROM ({_PAIRS})),
    walk AS (SELECT doc, 0 AS k, CAST(0 AS BIGINT) AS a, false AS done, CAST([] AS BIGINT[]) AS counted FROM pr GROUP BY doc
             UNION ALL SELECT doc, k, a, spent OR hit, CASE WHEN hit THEN list_append(counted, b) ELSE counted END
             FROM (SELECT *, NOT spent AND NOT list_contains(counted, b) AS hit
                   FROM (SELECT w.doc, p.k, p.a, p.b, w.counted, CASE WHEN p.a = w.a THEN w.done ELSE list_contains(w.counted, p.a) END AS spent FROM walk w JOIN pr p ON p.doc = w.doc AND p.k = w.k + 1))),
    near AS (SELECT doc, max(len(counted)) AS n FROM walk GROUP BY doc),
    f AS (""").replace("SELECT doc, 0, 'TEXT-007', count(*) FROM near WHERE counted GROUP BY doc", "SELECT doc, 0, 'TEXT-007', n FROM near")
_SEVERITY = "CASE rule WHEN 'TEXT-001' THEN 'Critical' WHEN 'TEXT-008' THEN 'Critical' ELSE 'Warning' END"


@query("text_findings", _HITS + f"SELECT doc, line, rule, {_SEVERITY} AS severity, CAST(n AS BIGINT) AS n FROM f WHERE n > 0")
def text_findings(spark, sf_dir):
    return R.text_findings(_phrased(spark, sf_dir), "doc", "text")


@query("text_scores", _HITS + f"SELECT doc, CAST(least(sum(n * CASE {_SEVERITY} WHEN 'Critical' THEN 15 ELSE 5 END), 100) AS BIGINT) AS score, count(*) FILTER (WHERE {_SEVERITY} = 'Critical') = 0 AS gate FROM f WHERE n > 0 GROUP BY doc")
def text_scores(spark, sf_dir):
    return R.text_score(R.text_findings(_phrased(spark, sf_dir), "doc", "text"))


@query("sentence_near_duplicates", _HITS.split("    pr AS (")[0].rstrip().rstrip(",") + f" SELECT doc, count(*) AS pairs, round(sum(overlap), 6) AS overlap FROM ({_PAIRS}) GROUP BY doc")
def sentence_near_duplicates(spark, sf_dir):
    pairs = R.sentence_pairs(_phrased(spark, sf_dir), "doc", "text")
    return pairs.groupBy("doc").agg(F.count("*").alias("pairs"), F.round(F.sum("overlap"), 6).alias("overlap"))


@query("traceback_frames", "SELECT p_partkey, 'a' || p_size || '.py' AS file, p_size AS line FROM part UNION ALL SELECT p_partkey, 'b.py', 7 FROM part")
def traceback_frames(spark, sf_dir):
    t = F.format_string('Traceback (most recent call last):\n  File "a%d.py", line %d, in f\n    g()\n  File "b.py", line 7, in g\nValueError: x', "p_size", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(R.traceback_frames(t)).alias("f")).select("p_partkey", "f.file", "f.line")


@query("claim_extraction", "SELECT p_partkey, ['src/m' || p_size || '.py:' || p_size, 'lib.rs:12'] AS claims FROM part")
def claim_extraction(spark, sf_dir):
    t = F.format_string("See src/m%d.py:%d and lib.rs:12, again lib.rs:12, not http://x.py:80/", "p_size", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", R.claims(t).alias("claims"))


@query("claim_rollup", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'refuted' WHEN bool_or(o_orderstatus = 'P') THEN 'unverified' ELSE 'pass' END AS verdict FROM orders GROUP BY o_custkey")
def claim_rollup(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "F", "refuted").when(F.col("o_orderstatus") == "P", "unverifiable").otherwise("verified")
    return R.claim_rollup(table(spark, sf_dir, "orders").select("o_custkey", v.alias("v")), "o_custkey", "v")


@query("diff_hunks", "SELECT p_partkey AS doc, 1::BIGINT AS hunk, p_size AS old_start, p_size + 1 AS new_start, 2::BIGINT AS removed, 1::BIGINT AS added FROM part UNION ALL SELECT p_partkey, 2, 90, 91, 0, 1 FROM part")
def diff_hunks(spark, sf_dir):
    t = F.format_string("diff\n@@ -%d,3 +%d,2 @@\n ctx\n-old\n-old2\n+new\n@@ -90 +91 @@\n+x", F.col("p_size"), F.col("p_size") + 1)
    return R.diff_hunks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), t.alias("t")), "doc", "t")


@query("outside_tokens", "SELECT p_partkey AS doc, CAST(p_size AS DOUBLE) AS value, 2::BIGINT AS n FROM part WHERE p_size NOT IN (4, 8, 16, 24, 32) UNION ALL SELECT p_partkey, 0.5, 1 FROM part")
def outside_tokens(spark, sf_dir):
    allowed = spark.createDataFrame([(float(x),) for x in (4, 8, 16, 24, 32)], "value double")
    t = F.format_string("pad: %d; gap: %d; w8 a 8 0.5", "p_size", "p_size")
    return R.outside_tokens(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d"), t.alias("t")), F.broadcast(allowed), "d", "t")


@query("goal_synonyms", "SELECT DISTINCT lower(o_orderpriority) AS goal, list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(o_orderpriority), '[\\s,;/]+'), lambda x: x <> ''), CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN ['fast'] ELSE [] END))) AS keys FROM orders")
def goal_synonyms(spark, sf_dir):
    goals = table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("goal")).distinct()
    words = spark.createDataFrame([("1-urgent", "fast"), ("urgent", "fast")], "word string, synonym string")
    return R.synonyms(goals, F.broadcast(words), "goal")


@query("pipeline_recipe", "SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def pipeline_recipe(spark, sf_dir):
    r = Recipes()
    r.step("filter", lambda rows, where: rows.where(where))
    r.step("count", lambda rows, by: rows.groupBy(by).agg(F.count("*").alias("n")))
    r.step("top", lambda rows, k: rows.orderBy(F.desc("n"), "event_type").limit(k))
    r.preset("busiest", [("slow", "filter", {"rows": "${events}", "where": "value > 100"}), ("counts", "count", {"rows": "${slow}", "by": "event_type"}), ("top", "top", {"rows": "${counts}", "k": 3})])
    return r.run("busiest", events=table(spark, sf_dir, "events"))["top"]
