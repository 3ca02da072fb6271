"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Measures are column expressions over the text; each row of the threshold table names a measure and
the range it must lie in, and the table becomes one boolean expression beside the measures. Nothing
is shuffled, and a plan with these rules is a scan and a projection.

Repeated word windows are found per text: windows become 64-bit hashes, a text whose hashes are all
distinct is done with (the common case), otherwise they are sorted with their places and the places
of equal neighbours are covered. Two different windows of one text are taken for equal with a
probability of about n^2 / 2^65 for n words.

Edge cases: a null or empty text has no words, so it fails the base rule; rows are judged one by one, so
repeated rows and ids are no special case; a value that ties with a bound keeps to it (bounds are inclusive);
a very long text is an array of its words in one row; an empty table gives an empty one; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import fresh

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: What parts words, as a regular expression's class.
BLANK = r"\x20\x09-\x0D"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour qui que se sur un une "
    "auf das dem den der die ein eine es für ich im ist mit nicht sich sie und von zu "
    "al como con del el lo los las más no o para su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must be at least ``low`` and at most ``high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word, per code point in words, or per line with a word.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("capitals", "capital_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever loop the body reads it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(hashes: Column, n: Column, window: int) -> Column:
    """Words in windows found twice or more, from an array of word hashes."""

    def widened(h: Column, size: int) -> Column:
        """Hashes of windows of ``window`` from those of ``size`` words: each step joins two neighbouring windows."""
        if size == window:
            return let(F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))), covered)
        step = min(size, window - size)
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), lambda wider: widened(wider, size + step))

    def covered(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)
        )

    def neighbours(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(F.lit(True)) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(F.lit(True)))
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("t"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["t"] + F.least(F.lit(window), x - a["last"])).alias("t"), x.alias("last")))["t"]

    return F.when(n < window + 1, F.lit(0)).otherwise(let(hashes, lambda h: widened(h, 1))).cast("long")


def measures(text: Column, stop_words: Iterable[str] = STOP_WORDS, window: int = WINDOW) -> Column:
    """A struct of counts and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
        stops = F.size(F.filter(w, lambda x: x.isin(list(stop_words))))
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

        def ratios(line: Column) -> Column:
            chars = F.length(F.concat_ws("", w)).cast("long")
            symbols = (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")
            dup = (F.size(line) - F.size(F.array_distinct(line))).cast("long")
            some = F.greatest(n, F.lit(1)).cast("double")
            return F.struct(
                n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
                _repeated_words(F.transform(w, lambda x: F.xxhash64(x)), n, window).alias("n_repeat_words"),
                (chars / some).alias("mean_word_length"), (symbols / F.greatest(chars, F.lit(1))).alias("symbol_ratio"),
                (stops / some).alias("stop_word_ratio"), (dup / F.greatest(F.size(line), F.lit(1))).alias("dup_line_ratio"),
                (capitals / F.greatest(chars, F.lit(1))).alias("capital_ratio"),
            )

        return let(lines, ratios)

    return let(F.array_remove(F.split(text, f"[{BLANK}]+"), ""), of)


def verdict(m: Column, rules: Iterable[Rule] = RULES) -> Column:
    """All rules of the table as one condition on a struct of measures."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (m[r.measure] >= r.low)
        if r.high is not None:
            out = out & (m[r.measure] <= r.high)
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED_PERCENT)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """Per document: the base counts, whether the base rule failed, and whether it is kept."""
    m = F.col("m")
    return docs.select(id_col, measures(F.col(text_col)).alias("m")).select(
        id_col, *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    (name,) = fresh(docs, "measures")
    m = F.col(name)
    return docs.withColumn(name, measures(F.col(text_col))).where(~base_failed(m) & verdict(m, rules)).select(*docs.columns)
