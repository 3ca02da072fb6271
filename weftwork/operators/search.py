"""Search over source files: the line tokenizer, symbols, the symbol bonus, location of code, spacing and re-ranking."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.relations import first_by
from weftwork.operators.text import SYMBOL_BONUS, cosine, rrf

#: Words that are dropped in strings and comments.
STOP_WORDS = frozenset(
    "the a an and or for if in of is to with on at by as it this that from are was be not do does but we you they he she them our your my its into out up down".split()
)
#: What stands before a symbol, in the order of trial.
SYMBOL_KEYWORDS = ["fn ", "def ", "struct ", "class ", "impl ", "enum ", "type ", "const ", "function ", "func ", "let ", "pub fn ", "pub struct ", "pub enum ", "mod ", "trait "]

_CJK = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002b73f"
_CODE = re.compile(rf"(?P<ident>[A-Za-z0-9_]+)|(?P<cjk>[{_CJK}]+)|(?P<note>#|//)|(?P<quote>[\"'`])|(?P<rest>.)", re.S)
_PROSE = re.compile(rf"(?P<word>[A-Za-z]+)|(?P<cjk>[{_CJK}]+)|(?P<rest>.)", re.S)
_PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z]{2})(?=[A-Z][a-z])|_+")


def identifier_words(name: str) -> list[str]:
    """Parts of an identifier in lower case: at underscores, before a capital after a small letter, and before the last of three capitals or more that a small letter follows."""
    return [x.lower() for x in _PARTS.split(name) if x]


def line_tokens(line: str) -> list[str]:
    """Tokens of a line of code: parts of identifiers; words but stop words in strings and comments; pairs of neighbours of CJK runs.

    A quote of any kind opens a string, an apostrophe too; ``#`` and ``//`` open a comment. A CJK run goes on over
    identifiers in code and over words in comments, and ends at any other character.
    """
    out, run, at = [], "", 0

    def close() -> None:
        nonlocal run
        if run:
            out.extend([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])
            run = ""

    def prose(part: str, words_close: bool) -> None:
        nonlocal run
        for m in _PROSE.finditer(part):
            if m["cjk"]:
                run += m["cjk"]
                continue
            if m["word"]:
                w = m["word"].lower()
                if len(w) > 1 and w not in STOP_WORDS:
                    out.append(w)
            if m["rest"] or words_close:
                close()

    while at < len(line):
        m = _CODE.match(line, at)
        at = m.end()
        if m["ident"]:
            out.extend(identifier_words(m["ident"]))
        elif m["cjk"]:
            run += m["cjk"]
        elif m["note"]:
            if m["note"] == "//":
                close()
            prose(line[at:], False)
            break
        elif m["quote"]:
            end = re.compile(rf"(?<!\\){m['quote']}").search(line, at)
            prose(line[at : end.start() + 1 if end else len(line)], True)
            at = end.end() if end else len(line)
        else:
            close()
    close()
    return out


def symbol(line: Column) -> Column:
    """The symbol that a line defines: the identifier behind the first keyword, in the order of trial, that one follows; else null."""
    t = F.trim(line)
    found = []
    for k in SYMBOL_KEYWORDS:
        at = F.instr(t, k)
        name = F.regexp_replace(F.regexp_extract(F.substr(t, at + len(k)), "^([A-Za-z0-9_<]*)", 1), "<+$", "")
        found.append(F.when((at > 0) & F.rlike(name, F.lit("^[A-Za-z]")), name))
    return F.coalesce(*found)


def symbols(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(doc, line, symbol)."""
    rows = files.select(F.col(path_col).alias("doc"), F.posexplode(F.split(text_col, "\r?\n")).alias("k", "text"))
    return rows.select("doc", (F.col("k") + 1).alias("line"), symbol(F.col("text")).alias("symbol")).where("symbol IS NOT NULL")


def code_postings(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf, dl): tokens of each file, those of its symbols once more; ``dl`` counts them all. A file stays in its row, so nothing is shuffled."""
    kind = files.schema[path_col].dataType.simpleString()
    named = F.transform(F.split(text_col, "\r?\n"), lambda x: symbol(x))

    def count(batches):
        for b in batches:
            docs, terms, tfs, dls = [], [], [], []
            for i, (text, names) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                held = Counter(t for line in (text or "").splitlines() for t in line_tokens(line))
                held.update(t for n in names or () if n for t in identifier_words(n))
                docs += [i] * len(held)
                terms += held.keys()
                tfs += held.values()
                dls += [sum(held.values())] * len(held)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(dls, pa.int64())], names=["doc", "term", "tf", "dl"])

    return files.select(F.col(path_col).alias("doc"), F.col(text_col).alias("text"), named.alias("names")).mapInArrow(count, f"doc {kind}, term string, tf long, dl long")


def symbol_bonus(scored: DataFrame, named: DataFrame, terms: DataFrame, bonus: float = SYMBOL_BONUS) -> DataFrame:
    """(query, doc, score, symbol, line): each symbol of a scored document that begins with a term of the query adds to its score; the first such symbol is named.

    scored: (query, doc, score); named: (doc, line, symbol); terms: (query, term), a stated query set.
    """
    asked = terms.groupBy("query").agg(F.collect_set("term").alias("terms"))
    hit = scored.join(named, "doc").join(asked, "query").where(F.exists("terms", lambda t: F.startswith(F.lower("symbol"), t)))
    sums = hit.groupBy("query", "doc").agg(F.count("*").alias("n"), F.min_by("symbol", F.struct("line", "symbol")).alias("symbol"), F.min("line").alias("line"))
    return scored.join(sums, ["query", "doc"], "left").select("query", "doc", (F.col("score") + bonus * F.coalesce("n", F.lit(0))).alias("score"), "symbol", F.coalesce("line", F.lit(0)).alias("line"))


def locate(files: DataFrame, queries: DataFrame, path_col: str, text_col: str, per_file: int = 3, limit: int = 10) -> DataFrame:
    """(query, doc, line, symbol, score): places in code for each of a stated set of queries (column ``query``), the best ``limit``.

    A symbol that holds the whole query scores 200, one that holds all its words 150, one that holds any 60 (ten at
    most a file); in files without such a symbol, the first ``per_file`` lines that hold a word score 50. Names are
    compared in lower case without underscores. One place keeps its highest score.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    asked = queries.select("query", plain("query").alias("whole"), F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9]+)"), 1)).alias("words"))
    named = symbols(files, path_col, text_col).groupBy("doc", "symbol").agg(F.min("line").alias("line")).withColumn("s", plain("symbol"))
    has = lambda w: F.contains(F.col("s"), w)
    score = F.when(F.contains("s", "whole"), 200).when(F.forall("words", has), 150).when(F.exists("words", has), 60)
    by_symbol = named.join(F.broadcast(asked), score.isNotNull() & (F.size("words") > 0)).select("query", "doc", "line", "symbol", score.alias("score"))
    by_symbol = first_by(by_symbol, ["query", "doc"], [F.desc("score"), F.col("line"), F.col("symbol")], 10)
    rows = files.select(F.col(path_col).alias("doc"), F.posexplode(F.split(text_col, "\r?\n")).alias("k", "text")).select("doc", (F.col("k") + 1).alias("line"), F.lower("text").alias("t"))
    lined = rows.join(F.broadcast(asked), F.exists("words", lambda w: F.contains(F.col("t"), w))).select("query", "doc", "line")
    lined = first_by(lined, ["query", "doc"], [F.col("line")], per_file).join(by_symbol.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
    every = by_symbol.unionByName(lined.select("query", "doc", "line", F.lit("").alias("symbol"), F.lit(50).alias("score")))
    best = every.groupBy("query", "doc", "line").agg(F.max("score").alias("score"), F.max_by("symbol", F.struct("score", "symbol")).alias("symbol"))
    return first_by(best, ["query"], [F.desc("score"), F.col("doc"), F.col("line")], limit)


def spaced_query(text: Column) -> Column:
    """A query with a blank before and behind every CJK character, but at its ends."""
    return F.regexp_replace(text, r"(?s)(?<=[\x{4e00}-\x{9fff}])(?=.)|(?<=.)(?=[\x{4e00}-\x{9fff}])", " ")


def spaced_content(text: Column) -> Column:
    """A text with a blank behind every CJK character."""
    return F.regexp_replace(text, "([\\x{4e00}-\\x{9fff}])", "$1 ")


def rerank(candidates: DataFrame, vectors: DataFrame, query_vectors: DataFrame, recall: int = 20, k: int = 60) -> DataFrame:
    """(query, doc, score): the first ``recall`` candidates of each query ranked anew by cosine, both rankings fused.

    candidates: (query, doc, score); vectors: (doc, vector); query_vectors: (query, vector). A candidate or query without a vector has cosine 0.
    """
    first = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    kept = candidates.withColumn("rank", F.row_number().over(first) - 1).where(F.col("rank") < recall)
    both = kept.join(vectors.withColumnRenamed("vector", "_v"), "doc", "left").join(query_vectors.withColumnRenamed("vector", "_q"), "query", "left")
    near = both.select("query", "doc", F.round(F.coalesce(cosine(F.col("_v"), F.col("_q")), F.lit(0.0)), 9).alias("cosine"))
    second = near.select("query", "doc", (F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "doc")) - 1).alias("rank"))
    return rrf(kept.select("query", "doc", "rank").unionByName(second), k)


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with rows put in place of those with the same key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def containing(files: DataFrame, needle: str, path_col: str, text_col: str, most: int = 100) -> DataFrame:
    """(doc, line, text): lines that hold a text as it is written, the first ``most`` by path and line; files with a NUL are left out."""
    rows = files.where(~F.contains(F.col(text_col), F.lit("\x00"))).select(F.col(path_col).alias("doc"), F.posexplode(F.split(text_col, "\r?\n")).alias("k", "text"))
    return rows.where(F.contains("text", F.lit(needle))).select("doc", (F.col("k") + 1).alias("line"), "text").orderBy("doc", "line").limit(most)


def term_density(text: Column, terms: list[str]) -> Column:
    """Places of the terms in a text, overlaps of one term with itself not counted, over its length and one more; in any case of letters.

    A null text scores 0, and so does one searched for no terms; an empty term is not searched for.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0.0)
    for t in (t.lower() for t in terms if t):
        hits = hits + (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
    return hits / (F.length(F.coalesce(text, F.lit(""))) + 1)


def _listed(names: Column) -> Column:
    """A list of names as it is printed: in single quotes, or in double ones around a name with single quotes alone."""
    def quoted(x: Column) -> Column:
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))


def hash_embedding(name: Column, arg_count: Column, has_docstring: Column, stmt_count: Column, calls: Column, decorators: Column) -> Column:
    """Six numbers from 0 to 1023 of a function: of its name, arguments, docstring, statements, first ten calls and decorators.

    Each is the first 16 bits of the SHA-256 of the feature's name and value. A null feature gives a null in its place.
    """
    features = {
        "name": name, "arg_count": arg_count.cast("string"), "has_docstring": F.when(has_docstring, "True").when(~has_docstring, "False"),
        "stmt_count": stmt_count.cast("string"), "calls": _listed(F.slice(calls, 1, 10)), "decorators": _listed(decorators),
    }
    return F.array(*(F.conv(F.substring(F.sha2(F.concat(F.lit(k + ":"), v), 256), 1, 4), 16, 10).cast("int") % 1024 for k, v in features.items()))


def _token_value(v: object) -> str:
    if isinstance(v, dict) and "value" in v:
        return f"{v['value']}{v.get('unit', '')}"
    if isinstance(v, dict) and "components" in v:
        return f"rgba({','.join(str(round(c, 3)) for c in v['components'])}, {v.get('alpha', 1.0)})"
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def tree_tokens(text: str | None) -> dict[str, tuple[str, str]]:
    """Dotted name -> (type, value) of the design tokens of a JSON tree: objects with ``$value``, at any depth.

    A size is value and unit, a colour ``rgba(...)``; other values are as they stand, those that are no strings as JSON. A token at the top
    is named with a leading dot. Of equal names the last one counts. What is no JSON object has no tokens.
    """
    try:
        tree = json.loads(text or "")
    except ValueError:
        return {}
    found, todo = {}, [("", tree)] if isinstance(tree, dict) else []
    while todo:
        name, node = todo.pop()
        if name and "$value" in node:
            found[name] = (str(node.get("$type", "")), _token_value(node["$value"]))
            continue
        inner = [(k, v) for k, v in node.items() if isinstance(v, dict)]
        todo += [(f"{name}.{k}" if name or "$value" in v else k, v) for k, v in reversed(inner)]
    return found


def lookup_tokens(trees: DataFrame, key_col: str, json_col: str) -> DataFrame:
    """(key, name, type, value): a row for each token of each tree."""
    at = pa.schema([(c, pa.string()) for c in ("name", "type", "value")])

    def walk(batches):
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                rows = [{"name": n, "type": t, "value": v} for n, (t, v) in tree_tokens(text).items()]
                if rows:
                    made = pa.RecordBatch.from_pylist(rows, at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows))), *made.columns], names=[key_col, *at.names])

    kind = trees.schema[key_col].dataType.simpleString()
    return trees.select(key_col, json_col).mapInArrow(walk, f"`{key_col}` {kind}, name string, type string, value string")
