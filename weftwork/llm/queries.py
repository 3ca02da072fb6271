"""The registered queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers

from weftwork.llm import bradley_terry, brown_lm, decontaminate, filter_audit, language_id, pieces, quality_rules, simhash, spelling, suffix_dedup, token_counts, toxicity, warc
from weftwork.plans.registry import table

#: The public SentencePiece model that the queries encode with; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The public word-level BPE whose tokens are counted; likewise.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES, ORACLES = {}, {}


def _query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@_query("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query(
    "op8_benchmark_decontamination",
    r"""
    WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
    items AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, size, w[i : i + size - 1] AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
    sizes AS (SELECT DISTINCT size FROM items),
    places AS (SELECT doc_id, size, i, w[i : i + size - 1] AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
    names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
    """,
)
def op8(spark, sf_dir):
    return decontaminate.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


@_query(
    "op2_quality_rules",
    rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    win AS (SELECT doc_id, i, w[i : i + 7] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 len(lines) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stops,
                 length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
          FROM w LEFT JOIN rep USING (doc_id)),
    r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                 word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
                 n_stops / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                 n_capitals / greatest(word_chars, 1) AS capital_ratio FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND mean_word_length BETWEEN 2 AND 15 AND symbol_ratio <= 0.05 AND stop_word_ratio >= 0.02
           AND dup_line_ratio <= 0.5 AND capital_ratio <= 0.5 AS kept
    FROM r
    """,
)
def op2(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))


@_query(
    "op1_warc_capture_index",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
    FROM f
    """,
)
def op1(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_query("op4_sentencepiece")
def op4(spark, sf_dir):
    return pieces.summary(table(spark, sf_dir, "documents"), PIECE_MODEL)


@_query("op3_language_id")
def op3(spark, sf_dir):
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


@_query("op6_quality_ranking")
def op6(spark, sf_dir):
    return bradley_terry.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_toxicity_chain")
def op9(spark, sf_dir):
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_class_lm")
def op5(spark, sf_dir):
    return brown_lm.scored(table(spark, sf_dir, "documents"))


@_query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.summary(table(spark, sf_dir, "documents"))


@_query("op11_whole_token_counts")
def op11(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


@_query(
    "op12_filter_audit",
    r"""
    WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    t AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM t),
    f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS fails FROM w),
    c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT *, substr(filter_order, step, 1) AS filter, list_filter([1, 2, 3, 4, 5], lambda k: contains(fails, substr(filter_order, k, 1)))[1] AS gone
          FROM c, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
    r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
                 coalesce(sum(n) FILTER (contains(fails, filter) AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
                 coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic), 0) AS toxic_lost
          FROM s GROUP BY ALL)
    SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
    """,
)
def op12(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
