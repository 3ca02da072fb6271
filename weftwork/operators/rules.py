"""Rule tables over text lines, document detectors and structured extraction."""

from __future__ import annotations

import itertools
import math
import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.text import lines

#: Openings of paragraphs.
OPENINGS = [
    "在当今社会", "在当今时代", "当今社会", "随着社会的发展", "随着技术的发展", "随着科技的发展", "随着信息技术的发展", "随着互联网的发展", "随着人工智能的发展",
    "众所周知", "众所周知地", "毋庸置疑", "近年来", "近年来，随着", "在信息化时代", "在数字化时代", "在大数据时代", "在人工智能时代", "自古以来", "从古至今",
    "In today's society", "In today's world", "With the development of", "In the modern era", "As we all know", "It is well known that", "In recent years", "Since the dawn of",
]
#: Expressions that say nothing.
VAGUE = [
    "具有重要意义", "具有深远意义", "具有重要意义和作用", "具有重要作用", "发挥着重要作用", "发挥着关键作用", "起到了重要作用", "值得关注", "值得注意", "值得深思", "值得探讨",
    "不可或缺", "必不可少", "至关重要", "举足轻重", "日益增长", "日益重要", "日趋重要", "蓬勃发展", "提供了有力支持", "奠定了坚实基础", "开辟了新道路", "注入了新活力",
    "of great significance", "plays an important role", "is of great importance", "is worth noting", "is worth mentioning", "plays a key role", "plays a crucial role",
]
#: Words of confidence.
CONFIDENT = [
    "显然", "显然地", "显而易见", "毫无疑问", "毫无疑义", "毋庸置疑", "无可置疑", "必定", "必然", "必将", "必定会", "绝对", "绝对地", "绝对的", "一定", "一定会", "肯定会", "注定",
    "obviously", "clearly", "undoubtedly", "without a doubt", "certainly", "definitely", "absolutely", "it is evident that", "it goes without saying",
]
#: Phrases of transition, in any case.
TRANSITIONS = [
    "让我们深入探讨", "让我们深入", "让我们来", "让我们一起", "值得注意的是", "需要注意的是", "需要指出的是", "应当指出", "总而言之", "综上所述", "总的来说", "总体而言", "总之",
    "在此过程中", "在这一过程中", "在这个过程中", "这不仅...而且", "不仅...还", "一方面...另一方面", "众所周知", "如前所述", "正如我们所知", "在本文中，我们将", "接下来，我们将", "首先，其次，最后",
    "深入探讨", "深入分析", "深入剖析", "深度解析", "let's dive into", "let's explore", "let's delve into", "it is worth noting that", "it should be noted that",
    "in conclusion", "to sum up", "in summary", "all in all", "first and foremost", "last but not least", "in this article, we will", "in this blog post, we",
]
#: Citations in academic form.
CITATIONS = [
    r"\([A-Z][a-zA-Z]+(?:\s+(?:et al\.|and|&)\s+[A-Z][a-zA-Z]+)?\s*,\s*\d{4}[a-z]?\s*\)", r"\([\x{4e00}-\x{9fa5}]{2,4}(?:\s*等)?\s*[,，]\s*\d{4}\s*\)",
    r"\[[A-Z][a-zA-Z]+\s+\d{4}\]", r"[A-Z][a-zA-Z]+\s+et al\.\s*\(\d{4}\)",
]
#: Characters without content, besides white space.
EMPTY_CHARS = "的了是在我有和人这中大为以与及或之其也而则对于上下来去到被把将该些" + "，。、；：？！\"\"''（）【】《》〈〉「」『』—…·,.:;!?\"'()[]{}<>-_/\\@#$%^&*+=|~`"
#: English words without content.
EMPTY_WORDS = (
    "the a an is are was were be been being of to in on at for with by as from and or but not this that these those it its they them their we you he she his her our your which who whom what when "
    "where why how can could will would should may might must shall do does did have has had"
).split()
#: Severities of the detectors, and what a finding adds to a text's score.
SEVERITY = {"TEXT-001": "Critical", "TEXT-002": "Warning", "TEXT-003": "Warning", "TEXT-004": "Warning", "TEXT-005": "Warning", "TEXT-006": "Warning", "TEXT-007": "Warning", "TEXT-008": "Critical"}
WEIGHTS = {"Blocker": 25, "Critical": 15, "Warning": 5}


def text_density(text: Column) -> Column:
    """A struct of three shares of a text: distinct characters with content among those with content (1 without any), those among all (0 of an empty text),
    and words of letters that are no empty ones among all such words (-1 without any). A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    content = F.regexp_replace(t, _class(EMPTY_CHARS), "")
    words = F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))
    full = F.filter(words, lambda w: ~F.lower(w).isin(EMPTY_WORDS))
    return F.struct(
        F.when(content == "", 1.0).otherwise(F.size(F.array_distinct(F.regexp_extract_all(content, F.lit("(?s)."), F.lit(0)))) / F.length(content)).alias("diversity"),
        F.when(t == "", 0.0).otherwise(F.length(content) / F.length(t)).alias("density"), F.when(F.size(words) == 0, -1.0).otherwise(F.size(full) / F.size(words)).alias("content_words"),
    )


def apply_rules(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str, ext_col: str, comment: Column | None = None, cap: int = 100) -> DataFrame:
    """(doc, line, rule, severity): lines that match the patterns of their suffix, the first ``cap`` of each rule and document.

    rules: (ext, rule, pattern, severity), a small table; ``comment``: the prefix of whole-line comments, which never match.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(ext_col).alias("ext"), (comment if comment is not None else F.lit(None).cast("string")).alias("mark"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    code = rows.where(F.col("mark").isNull() | ~F.startswith(F.ltrim("text"), F.col("mark")))
    hits = code.join(rules, "ext").where(F.rlike("text", F.col("pattern"))).select("doc", (F.col("line") + 1).alias("line"), "rule", "severity")
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc", "rule").orderBy("line"))).where(F.col("_k") <= cap).drop("_k")


def shortest(phrases: list[str]) -> list[str]:
    """The phrases that begin with no other: any place of another one is a place of one of these."""
    return [p for k, p in enumerate(phrases) if not any(p.startswith(q) and (q != p or j < k) for j, q in enumerate(phrases) if j != k)]


def _class(chars: str) -> str:
    """A pattern of one of the characters, or white space."""
    return "(?U)[\\s" + "".join("\\" + c if c in "[]\\^-&{}" else c for c in dict.fromkeys(chars)) + "]"


def _places(t: Column, phrases: list[str]) -> Column:
    """At how many places of a text one of the phrases begins. Most texts hold none, which is told without a pattern."""
    return sum((F.when(F.contains(t, F.lit(p)), F.regexp_count(t, F.lit("\\Q" + p + "\\E"))).otherwise(0) for p in shortest(phrases)), F.lit(0))


#: How each citation ends, looked for before the citations are.
CITED_END = r"\d{4}[a-z]?\s*[)\]]"
#: Chinese characters, as a range in patterns.
HAN = "\u4e00-\u9fff"


def text_findings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, rule, severity, n): findings of the eight detectors, ``n`` of a rule in a line (line 0 speaks of the whole text). An id names one document.

    001 a paragraph's opening; 002, 004, 005 phrases, counted once a place; 003 lists, deep or many headings;
    006 a long paragraph of few different characters or little content; 007 a sentence that stands again, at its
    first paragraph, or nearly again (line 0); 008 citations. Nothing is shuffled. Texts are read twice: once for what
    is found by phrase or pattern, where only texts that hold one are cut into lines, and once for ``structure``.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    told = base.select("doc", "text", F.rlike("text", F.lit(f"[{HAN}]")).alias("han"))
    phrases = {"TEXT-002": VAGUE, "TEXT-004": CONFIDENT, "TEXT-005": [x.lower() for x in TRANSITIONS]}
    # most phrases are Chinese, and can't stand in a text without such a character
    listed = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    some = lambda words, han: listed([w for w in shortest(words) if bool(re.search(f"[{HAN}]", w)) == han])
    among = lambda words: F.when(F.col("han"), F.concat(some(words, False), some(words, True))).otherwise(some(words, False))
    held = lambda t, words: F.filter(among(words), lambda w: F.contains(t, w))
    row = lambda rule, t, words: F.struct(F.lit(rule).alias("rule"), t.alias("text"), words.alias("words"))
    found = lambda rule, words: lambda t: row(rule, t, held(t, words))
    # a text in lower case is worked out once, not for each phrase
    rows = [F.transform(F.array(F.lower("text") if rule == "TEXT-005" else F.col("text")), found(rule, words)) for rule, words in phrases.items()]
    # a citation may go on over a line's end, so it is looked for in the whole text and placed by its start; a place counts once, whichever pattern begins there
    marked = F.when(F.rlike("text", F.lit(CITED_END)), F.regexp_replace("text", "(?=" + "|".join(CITATIONS) + ")", "\x01"))
    rows.append(F.array(row("TEXT-008", marked, F.array(F.lit("\x01")))))
    hits = told.select("doc", F.explode(F.filter(F.concat(*rows), lambda r: r["text"].isNotNull() & F.exists(r["words"], lambda w: F.contains(r["text"], w)))).alias("r"))
    hits = hits.select("doc", "r.rule", "r.words", F.posexplode(F.split("r.text", "\n")).alias("k", "text")).where(F.exists("words", lambda w: F.contains(F.col("text"), w)))
    n = F.regexp_count("text", F.lit("\x01"))
    for rule, words in phrases.items():
        n = F.when(F.col("rule") == rule, _places(F.col("text"), words)).otherwise(n)
    hits = hits.select("doc", (F.col("k") + 1).alias("line"), "rule", n.cast("long").alias("n"))
    every = hits.unionByName(structure(base)).where("n > 0")
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return every.select("doc", "line", "rule", severity[F.col("rule")].alias("severity"), "n")


def structure(base: DataFrame) -> DataFrame:
    """(doc, line, rule, n): what TEXT-001, 003, 006 and 007 find in the lines, paragraphs and sentences of each row (doc, text)."""

    def find(batches):
        for batch in batches:
            at, found = [], []
            for k in range(batch.num_rows):
                own = structure_of(batch.column(1)[k].as_py())
                at += [k] * len(own)
                found += own
            line, rule, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int32()), pa.array(rule, pa.string()), pa.array(n, pa.int64())], names=["doc", "line", "rule", "n"])

    return base.mapInArrow(find, f"doc {base.schema['doc'].dataType.simpleString()}, line int, rule string, n long")


# white space as Unicode has it, without the separators that Python adds
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_MARKS, _EMPTY = frozenset("#*`>-"), frozenset(EMPTY_CHARS) | _WHITE
_ITEM, _HEADING = re.compile(r"[^\S\x1c-\x1f]*(?:[-*+]|\d+\.)[^\S\x1c-\x1f]"), re.compile(r"(#{1,6})[^\S\x1c-\x1f]")


def structure_of(text: str) -> list[tuple[int, str, int]]:
    """(line, rule, n) of one text. A paragraph is a run of lines that aren't blank, by the number of its first."""
    rows = list(enumerate(text.splitlines(), 1))
    out = []
    first: dict[str, int] = {}
    times: Counter = Counter()
    for full, run in itertools.groupby(rows, lambda x: x[1].strip() != ""):
        if full:
            run = list(run)
            line, p = run[0][0], "\n".join(x for _, x in run)
            if p.lstrip().startswith(tuple(OPENINGS)):
                out.append((line, "TEXT-001", 1))
            if len(p) >= 100 and hollow(p):
                out.append((line, "TEXT-006", 1))
            for x in _sentences(p):
                first.setdefault(x, line)
                times[x] += 1
    n_lines, n_items = sum(x.strip() != "" for _, x in rows), sum(_ITEM.match(x) is not None for _, x in rows)
    levels = [len(m[1]) for _, x in rows if x.startswith("#") and (m := _HEADING.match(x))]
    shape = (n_items > 10 and n_items / n_lines > 0.5) + any(v >= 5 for v in levels) + (bool(levels) and n_lines / len(levels) < 5)
    if shape:
        out.append((0, "TEXT-003", shape))
    out += [(line, "TEXT-007", n) for line, n in Counter(first[x] for x, n in times.items() if n >= 2).items()]
    near = sum(x[3] for x in near_sentences(list(times), NEAR))
    return [*out, (0, "TEXT-007", near)] if near else out


def hollow(p: str) -> bool:
    """Whether a paragraph of 100 characters or more, without white space and marks, has few different characters or little content."""
    there = set(p)
    count = lambda chars: sum(map(p.count, there & chars))
    clean = len(p) - count(_MARKS)
    if clean - count(_WHITE) < 100:
        return False
    content = clean - count(_EMPTY - _MARKS)
    return content < 0.55 * clean or len(there - _EMPTY - _MARKS) / content < 0.45


_ENDS = "[。.！!？?\n]+"
LEAST_SENTENCE, NEAR = 12, 0.7


def sentence_pairs(docs: DataFrame, id_col: str, text_col: str, least: float = NEAR) -> DataFrame:
    """(doc, a, b, overlap, counted): different sentences of a document whose sets of character pairs overlap by more than ``least``.

    a and b number the document's distinct sentences in order. ``counted``: a sentence is compared with those
    after it in order, the first near one that isn't counted yet is, and a counted one is not compared itself.
    A document stays in its row. Few sentences are compared by bits; of many, candidates share one of the rarest pairs of both (as a
    sentence of n pairs can only be near another if they share one of any n - ceil(least n) + 1), so long documents are not squared.
    """
    out = f"doc {docs.schema[id_col].dataType.simpleString()}, a long, b long, overlap double, counted boolean"

    def find(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                own = distinct_sentences(batch.column(1)[lo].as_py() or "")
                found = near_sentences(own, least)
                if found:
                    a, b, v, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(lo, 1)] * len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float64()), pa.array(c, pa.bool_())], names=["doc", "a", "b", "overlap", "counted"])

    return docs.select(F.col(id_col).alias("doc"), text_col).mapInArrow(find, out)


def distinct_sentences(text: str) -> list[str]:
    """A text's distinct sentences in order; a blank line ends one as any line does."""
    return list(dict.fromkeys(x for line in text.splitlines() for x in _sentences(line)))


def _sentences(text: str) -> list[str]:
    return [x for x in map(str.strip, re.split(_ENDS, text)) if len(x) >= LEAST_SENTENCE]


def near_sentences(own: list[str], least: float) -> list[tuple[int, int, float, bool]]:
    """(a, b, overlap, counted) of the near pairs, in order."""
    plain = ["".join(x.split()) for x in own]
    pairs = _near_by_bits(plain, least) if len(own) <= MOST_SQUARED else _near_by_rarest(plain, least)
    counted, last, done = set(), -1, False
    out = []
    for a, b, overlap in sorted(pairs):
        if a != last:
            last, done = a, a in counted
        hit = not done and b not in counted
        if hit:
            counted.add(b)
            done = True
        out.append((a, b, overlap, hit))
    return out


#: Sentences of a document that are compared each with each, by their bits alone; of more, only those that share a rare pair are.
MOST_SQUARED = 2048


def _near_by_bits(own: list[str], least: float) -> list[tuple[int, int, float]]:
    """(a, b, overlap) of the near ones. Each set of character pairs is hashed to some bits; sets differ by at least as many pairs as their bits do, which excludes nearly all."""
    chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(own), dtype=np.uint64), [len(x) for x in own])
    keys = np.sort((owner[:-1] << np.uint64(42) | chars[:-1] << np.uint64(21) | chars[1:])[owner[:-1] == owner[1:]])
    if not len(keys):
        return []
    keys = keys[np.append(True, keys[1:] != keys[:-1])]  # np.unique takes ten times as long
    owner, grams = (keys >> np.uint64(42)).astype(np.int64), keys & np.uint64((1 << 42) - 1)
    size = np.bincount(owner, minlength=len(own))
    width = min(12, max(8, int(size.max() * 2).bit_length()))
    held = np.zeros((len(own), 1 << width), bool)
    held[owner, (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width)).astype(np.int64)] = True
    bits = np.packbits(held, axis=1).view(np.uint64)
    ends, sets, pairs = np.cumsum(size), {}, []
    pick = lambda k: sets[k] if k in sets else sets.setdefault(k, set(grams[ends[k] - size[k] : ends[k]].tolist()))
    step = max(1, (1 << 19) // bits.size)
    for lo in range(0, len(own), step):
        differ = np.bitwise_count(bits[lo : lo + step, None] ^ bits[None, lo:]).sum(axis=2, dtype=np.int64)
        m, n = size[lo : lo + step, None], size[None, lo:]
        a, b = np.nonzero((differ <= (1 - least) / (1 + least) * (m + n) + 1e-6) & (np.minimum(m, n) > least * np.maximum(m, n) - 1e-9) & (np.minimum(m, n) > 0))
        for a, b in zip((a + lo).tolist(), (b + lo).tolist(), strict=True):
            if a < b:
                both = len(pick(a) & pick(b))
                overlap = both / (int(size[a]) + int(size[b]) - both)
                if overlap > least:
                    pairs.append((a, b, overlap))
    return pairs


def _near_by_rarest(own: list[str], least: float) -> list[tuple[int, int, float]]:
    """(a, b, overlap) of the near ones, in any order: candidates share one of the rarest pairs of both."""
    sets = []
    for x in own:
        sets.append(set(map(operator.add, x, x[1:])))
    rarity = Counter(itertools.chain.from_iterable(sets))
    # pairs of characters as their places in the order from the rarest on; whatever the order of ties, it is one for all sentences
    place = {g: i for i, g in enumerate(sorted(rarity, key=rarity.__getitem__))}
    sets = [set(map(place.__getitem__, s)) for s in sets]
    held: dict[int, list[int]] = {}
    pairs = []
    for b, s in enumerate(sets):
        prefix = sorted(s)[: len(s) - math.ceil(least * len(s)) + 1]
        n = len(s)
        for a in {a for g in prefix if g in held for a in held[g]}:
            m = len(sets[a])
            if min(m, n) > least * max(m, n) - 1e-9:
                both = len(sets[a] & s)
                overlap = both / (m + n - both)
                if overlap > least:
                    pairs.append((a, b, overlap))
        for g in prefix:
            held.setdefault(g, []).append(b)
    return pairs


def text_score(findings: DataFrame) -> DataFrame:
    """(doc, score, gate): weights of the findings, 100 at most; the gate holds without critical findings."""
    w = F.lit(0)
    for s, v in WEIGHTS.items():
        w = F.when(F.col("severity") == s, v).otherwise(w)
    return findings.groupBy("doc").agg(F.least(F.sum(w * F.col("n")), F.lit(100)).cast("long").alias("score"), (F.count_if(F.col("severity").isin("Critical", "Blocker")) == 0).alias("gate"))


def traceback_frames(text: Column) -> Column:
    """Frames (file, line) of a Python traceback in order."""
    pattern = r'File "([^"]+)", line (\d+)'
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("file"), F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda x: x.cast("int")).alias("line"))


def claims(text: Column) -> Column:
    """Distinct ``path:line`` claims of a text; parts of URLs are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w/:.])((?:[\w.-]+/)*[\w-]+\.(?:py|rs|go|ts|js|c|cpp|h|java|lua|gd|cs):\d+)"), 1)
    return F.array_distinct(found)


def claim_rollup(verdicts: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, verdict): refuted before unverified before pass."""
    any_of = lambda v: F.bool_or(F.col(verdict) == v)
    return verdicts.groupBy(key).agg(F.when(any_of("refuted"), "refuted").when(any_of("unverifiable"), "unverified").otherwise("pass").alias("verdict"))


def diff_hunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hunk, old_start, new_start, removed, added) of unified diffs."""
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    rows = lines(docs, id_col, text_col).withColumn("is_head", F.rlike("text", F.lit(head)))
    rows = rows.withColumn("hunk", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("doc").orderBy("line"))).where("hunk > 0")
    start = lambda k: F.max(F.when(F.col("is_head"), F.regexp_extract("text", head, k).cast("int")))
    starts = lambda c: F.count_if(F.startswith(F.col("text"), F.lit(c)))
    return rows.groupBy("doc", "hunk").agg(start(1).alias("old_start"), start(2).alias("new_start"), starts("-").alias("removed"), starts("+").alias("added"))


def outside_tokens(docs: DataFrame, allowed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, value, n): numbers in a text that are not among the allowed values (column ``value``), rounded to four digits."""
    v = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(text_col, F.lit(r"(?<![\w.])(\d{1,9}(?:\.\d{1,6})?)(?![\w.])"), 1)).alias("v")).select("doc", F.round(F.col("v").cast("double"), 4).alias("value"))
    return v.groupBy("doc", "value").agg(F.count("*").alias("n")).join(allowed.select("value"), "value", "left_anti").select("doc", "value", "n")


def synonyms(goals: DataFrame, table: DataFrame, goal: str) -> DataFrame:
    """(goal, keys): a goal's words with the synonyms that the table (word, synonym) has for them, sorted."""
    w = goals.select(goal, F.explode(F.filter(F.split(F.lower(goal), r"[\s,;/]+"), lambda x: x != "")).alias("word"))
    both = w.join(table, "word", "left")
    return both.groupBy(goal).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("word", "synonym")))))).alias("keys"))
