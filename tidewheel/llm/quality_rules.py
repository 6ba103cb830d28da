r"""Document quality rules with adaptive thresholds, in DataFrame functions only.

Each rule's metric is a whole number.  Its distribution in each (language, source) is kept in a
mergeable quantile sketch: a log-linear histogram (exact below 64, then 32 buckets for each power
of two, so within 1/32), whose merge is the addition of counts.  Being sums, the sketches come out
the same in any partitioning.  A rule rejects a document that lies beyond

    max(q75 + (3 * (q75 - q25) + share * m) * max(1, sqrt(median words / words)), least)

of its group, where the quartiles are those of all documents, m is the median of the documents whose
metric is not zero, and the rule's ``share`` says how much of it is room: metrics that most documents
have none of, like symbols, have quartiles of zero, and their scale is that of the documents that have
some.  What so few documents have that it has no
spread is no fault as long as there is little of it: ``least`` of a metric never fails a document.  Short documents, whose ratios scatter more, get the room that their length explains.  Each
quantile is drawn toward that of the language, and this toward that of all documents, as if the
wider group gave ``PRIOR`` documents more: a group of any size has a fence of its own.  Documents are joined
to their group's fences and filtered.

Metrics: symbols per 1000 word characters, mean word length in hundredths, duplicate lines per
1000 lines.  Beside them stands the fixed base rule of the contract (too few words, or over a
fifth of the words inside repeated five-word windows).

Defined edge cases: null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; documents without words enter no sketch; a document right at a
fence is kept; repeated rows count each; texts of any length are read whole; an empty table gives no rows; all columns of the input stay, and an
added one whose name the input has gets a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.shared import pinned, unused, written

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Documents that the wider group adds to a group's own, when its quantiles are drawn toward that.
PRIOR = 50
#: Each rule's room, as a share of the median of values that are not zero.
SHARES = {"symbols": 0.125, "length": 0.0625, "dup_lines": 1.0}
#: How much of each metric is never too much: a symbol in 50 characters, a line in 20 that repeats another.
LEAST = {"symbols": 20, "length": 0, "dup_lines": 50}
ADDED = (*METRICS, "n_lines", "base_failed", "kept")
_BLANK = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more; exact, by sorting the windows themselves."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
    places = _let(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    gained = lambda p: F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), at + WINDOW) - at))
    return _let(places, lambda p: F.aggregate(gained(p), F.lit(0).cast("bigint"), lambda a, x: a + x))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row`` (the row of ``docs``), lang, source, the base metrics, ``base_failed`` and the number of lines that hold a word."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.`{lang}`").alias("lang"), F.col(f"row.`{source}`").alias("source"))
    own = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    words = F.array_remove(F.split(own, _BLANK + "+"), "")
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"__words": words, "__lines": lines})
    hashes = F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    # Equal windows have equal hashes, so most documents are settled without comparing windows.
    suspect = F.when(F.size("__words") > WINDOW, _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))).otherwise(False)
    out = out.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.length(own) - F.length(F.regexp_replace(own, r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_repeat_words": F.when(suspect, _repeat_words(F.col("__words"))).otherwise(F.lit(0)).cast("bigint"),
    }).drop("__words", "__lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rule_metrics() -> dict[str, Column]:
    ratio = lambda a, b, scale: F.floor(scale * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("bigint")
    return {"symbols": ratio("n_symbols", "word_chars", 1000), "length": ratio("word_chars", "n_words", 100), "dup_lines": ratio("n_dup_lines", "n_lines", 1000)}


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds ``value``."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measures: DataFrame) -> DataFrame:
    """Mergeable sketches: lang, source, metric, bucket, n."""
    all_ = {**rule_metrics(), "words": F.col("n_words")}
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in all_.items()]))
    rows = measures.filter("n_words > 0").select("lang", "source", pairs.alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """For each metric M of each group: its documents M_n and quartiles M_25, M_50 and M_75; and the number M_some and the median M_mid of those above zero."""
    own, some = W.partitionBy(*by, "metric"), F.when(F.col("bucket") > 0, F.col("n")).otherwise(F.lit(0))
    upto = own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.withColumns({"up_to": F.sum("n").over(upto), "total": F.sum("n").over(own), "some_to": F.sum(some).over(upto), "some": F.sum(some).over(own)})
    out = []
    for name in (*SHARES, "words"):
        mine = F.col("metric") == name
        out += [F.coalesce(F.max(F.when(mine, F.col(x))), F.lit(0)).alias(f"{name}_{as_}") for x, as_ in (("total", "n"), ("some", "some"))]
        out += [F.coalesce(F.min(F.when(mine & (100 * F.col("up_to") >= p * F.col("total")), F.col("bucket"))), F.lit(0)).alias(f"{name}_{p}") for p in (25, 50, 75)]
        out.append(F.coalesce(F.min(F.when(mine & (F.col("bucket") > 0) & (2 * F.col("some_to") >= F.col("some")), F.col("bucket"))), F.lit(0)).alias(f"{name}_mid"))
    return ranked.groupBy(*by).agg(*out)


def _drawn(own: Column, n: Column, wider: Column) -> Column:
    return (n * own + PRIOR * wider) / (n + PRIOR)


def fences(sketch: DataFrame) -> DataFrame:
    """For each (lang, source) the quantiles that hold for it, drawn toward those of its language and these toward all documents'."""
    groups, langs, every = quantiles(sketch, "lang", "source"), quantiles(merged(sketch, "lang"), "lang"), quantiles(merged(sketch))
    joined = groups.alias("g").join(langs.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).join(F.broadcast(every.alias("e")), F.lit(True))  # one row
    out = []
    for name in (*SHARES, "words"):
        for c in (25, 50, 75, "mid"):
            n = f"{name}_{'some' if c == 'mid' else 'n'}"
            language = _drawn(F.col(f"l.{name}_{c}"), F.col(f"l.{n}"), F.col(f"e.{name}_{c}"))
            out.append(_drawn(F.col(f"g.{name}_{c}"), F.col(f"g.{n}"), language).alias(f"{name}_{c}"))
    return joined.select(F.col("g.lang").alias("of_lang"), F.col("g.source").alias("of_source"), *out)


def judged(measures: DataFrame, fence: DataFrame) -> DataFrame:
    """``measures`` with ``kept``: the base rule has not failed and no metric lies beyond its fence."""
    room = F.greatest(F.lit(1.0), F.sqrt(F.col("words_50") / F.greatest(F.col("n_words"), F.lit(1))))
    beyond = F.lit(False)
    for name, value in rule_metrics().items():
        spread = 3 * (F.col(f"{name}_75") - F.col(f"{name}_25")) + SHARES[name] * F.col(f"{name}_mid")
        beyond = beyond | (value > F.greatest(F.col(f"{name}_75") + spread * room, F.lit(float(LEAST[name]))))
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    out = measures.join(fence, on, "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False)))
    return out.select(*measures.columns, "kept")


def _judged(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    # The measured documents are written once: sketches and verdicts read the numbers, and no later
    # filter can draw the expressions that make them into itself.
    measures = written(measured(docs, text, lang, source), "measured")
    return judged(measures, pinned(fences(sketches(measures))))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with its metrics, ``n_lines``, ``base_failed`` and ``kept``.  Fences come from all of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    added = [F.col(c).alias(unused(docs, c) if c in taken else c) for c in ADDED]
    return _judged(docs, text, lang, source).select("row.*", *added)


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return _judged(docs, text, lang, source).filter("kept").select("row.*")
