"""Quality rules: a table of thresholds compiled into one Spark projection, with no user functions.

quality() adds the base measures and a verdict. A rule is (name, measure, least, most); a document is kept if it passes
the base limits and every rule. All measures are built-in expressions over the row, so nothing is shuffled, and a
long text costs n log n in its own words at most.

Repeated windows are told by a 64-bit hash of their words' hashes within one document. Defined cases: a null or blank
text has no words: all measures are 0, base_failed is true and kept is false; a line counts only if it has a word, and
equals another by its characters; equal rows get equal verdicts; an empty table gives no rows; other columns stay, one named as an output (in any
case of letters) as <name>_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, clean_name, make_room

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus' languages.
STOP_WORDS = "the of and to in is that it for on with as was be by this are from or an at le la les de des et en un une que qui dans pour pas sur avec au der die das und ist von den mit ein eine zu im nicht sich auf dem des el los las y una por con para su se del es lo al".split()
#: (name, measure, least, most); None: no limit.
RULES = (
    ("mean word length", "mean_word", 1.5, 14.0),
    ("symbols for each word", "symbol_ratio", None, 0.35),
    ("exclamation marks for each word", "exclaim_ratio", None, 0.5),
    ("share of stop words", "stop_ratio", 0.02, None),
    ("share of lines that repeat", "dup_line_ratio", None, 0.5),
    ("share of words like the one before", "echo_ratio", None, 0.3),
)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once; a lambda's argument is the only name that an expression can have."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in the array of words."""

    def hashes(word_hashes):
        starts = F.sequence(F.lit(0), F.size(word_hashes) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(window)]))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            beside = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(beside(x, j - 1) | beside(x, j + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"))
        return F.aggregate(let(placed, places), start, step)["n"]

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: let(hashes(wh), some))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(found)


def measures(text: Column) -> dict[str, Column]:
    """Base measures of a text that isn't null; words is an array that other measures read."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_exclaim": F.length(text) - F.length(F.translate(text, "!", "")),
        "line_counts": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
    }


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the first rule that fails."""
    docs = make_room(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")
    own = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    words_at, m_at = clean_name(docs, "q_words"), clean_name(docs, "q")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    first = docs.select(*own, words.alias(words_at), F.struct(*[v.alias(k) for k, v in measures(text).items()]).alias(m_at))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    bare = F.transform(F.col(words_at), lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?#*$%&|"))))
    n_stop = F.size(F.filter(bare, lambda w: F.array_contains(stop, w)))
    n_echo = F.size(F.filter(F.transform(F.col(words_at), lambda w, i: F.coalesce(F.get(F.col(words_at), i - 1) == w, F.lit(False))), lambda x: x))
    m, n = F.col(m_at), F.size(words_at)
    second = first.select(*own, n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["line_counts"]["dup"].alias("n_dup_lines"), repeated_words(F.col(words_at)).alias("n_repeat_words"), F.struct(m["word_chars"].alias("chars"), m["n_symbols"].alias("symbols"), m["n_exclaim"].alias("exclaim"), m["line_counts"]["n"].alias("lines"), n_stop.alias("stop"), n_echo.alias("echo")).alias(m_at))
    per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    value = {
        "mean_word": per(m["chars"], F.col("n_words")),
        "symbol_ratio": per(m["symbols"], F.col("n_words")),
        "exclaim_ratio": per(m["exclaim"], F.col("n_words")),
        "stop_ratio": per(m["stop"], F.col("n_words")),
        "echo_ratio": per(m["echo"], F.col("n_words")),
        "dup_line_ratio": per(F.col("n_dup_lines"), m["lines"]),
    }
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fails = [F.when(((value[k] < low) if low is not None else F.lit(False)) | ((value[k] > high) if high is not None else F.lit(False)), F.lit(name)) for name, k, low, high in rules]
    verdict = F.coalesce(F.when(base_failed, F.lit("base")), *fails)
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return second.select(*own, *longs, base_failed.alias("base_failed"), verdict.isNull().alias("kept"), verdict.alias("failed_rule"))
