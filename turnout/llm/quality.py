"""Quality rules with adaptive thresholds.

Every document is measured; each measure is a whole number of millionths.  A rate of rare events is only known up to one event, the more
coarsely the shorter the text, so each document has an upper end (one event more) and a lower end (one event fewer).  Per language
and source the upper ends are summed up in a quantile sketch: counts per bucket, where a bucket keeps the leading
``SKETCH_BITS`` bits of the value, so any quantile is known within 1/2^(SKETCH_BITS - 1) of its value.  Sketches merge by adding counts.

The fence of a measure is ``q75 + reach * (q90 - q50)`` of the sketch, for the word length also ``q25 - reach * (q50 - q10)``, so up to a tenth of
a group may be outliers without moving it.  No room is narrower than ``reach`` buckets.  A group's fences are drawn towards those of its language, and
a language's towards those of the corpus, as if ``weight`` documents of the wider group had been seen, so few documents never decide alone and
there is no size at which the rule changes.  A document is refused when the lower end of a measure lies above its group's
fence, or the upper end below the lower one.  All
arithmetic is on integers, so the result does not depend on the order of rows.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources form groups of
their own; repeated rows are judged row by row; an empty table gives an empty result; a text of any length is measured whole, inside its own row; other
columns pass through, those named like a result column are replaced by it.
Windows are compared by 64-bit digests within one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.session import durable

SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"  # as it stands inside a character class
SKETCH_BITS = 7

#: Measure -> (numerator, denominator, what one event adds to the numerator, whether small values are bad too).  An event is a long word's
#: length, a symbol, a line, the words of a window.  Lines and words that repeat are
#: set against those that do not, as a share of all could not pass a fence near 1.
MEASURES = {
    "m_length": ("word_chars", "n_words", 16, True),
    "m_symbols": ("n_symbols", "n_words", 1, False),
    "m_lines": ("n_dup_lines", "n_lines - n_dup_lines", 1, False),
    "m_repeats": ("n_repeat_words", "n_words - n_repeat_words", 5, False),
}
SCALE = 1_000_000

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "group_docs", "kept")


def upper(measure: str) -> str:
    """Name of a measure's upper end; the lower end has the measure's own name."""
    return measure.replace("m_", "u_")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window whose words occur as a window of the text more than once."""

    def covered(digests: Column) -> Column:
        # Sorted by digest, equal windows are neighbours; their positions, sorted again, cover min(window, gap) new words each.
        ordered = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"]))
        starts = let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        return F.aggregate(
            starts, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(window), x - a["last"])).alias("total")),
            lambda a: a["total"])

    def of_words(hashes: Column) -> Column:
        last = F.size(hashes) - window
        digests = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))
        some = lambda d: F.when(F.size(F.array_distinct(d)) < F.size(d), covered(d)).otherwise(F.lit(0).cast("long"))
        return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(digests, some))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def measure(docs: DataFrame, text: str = "text", min_words: int = 10, repeat_percent: int = 20, window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and both ends of MEASURES."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, window).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # Not deterministic in Spark's eyes, so that a filter on a measure is not pushed below it, which would compute it again.
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    out = docs.withColumns({"_words": once(counts), "_lines": once(line_counts)}).withColumns({
        "n_words": F.col("_words.n_words"),
        "word_chars": F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[" + SYMBOLS + "]+", ""))).cast("long"),
        "n_dup_lines": F.col("_lines.n_dup_lines"),
        "n_repeat_words": F.col("_words.n_repeat_words"),
        "n_lines": F.col("_lines.n_lines"),
    }).drop("_words", "_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rates = {}
    for name, (of, over, event, _) in MEASURES.items():
        for column, value in ((name, f"greatest({of} - {event}, 0)"), (upper(name), f"{of} + {event}")):
            rates[column] = F.when(F.expr(over) > 0, F.expr(f"(({value}) * {SCALE}L) div ({over})")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("base_failed", failed).withColumns(rates)


def bucket(value: Column, bits: int = SKETCH_BITS) -> Column:
    """The value with all but its ``bits`` leading binary digits cleared: the lower edge of its sketch bucket."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts per language, source and measure, of the documents that pass the base rule."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(upper(m))).alias("bucket")) for m in MEASURES)))
    rows = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups: counts of equal buckets add up."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure: document count and the quantiles that the fences need, read off the cumulative counts."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    at = lambda part: F.min(F.when(F.col("upto") * 20 >= F.col("total") * part, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("n"), at(2).alias("q10"), at(5).alias("q25"), at(10).alias("q50"), at(15).alias("q75"), at(18).alias("q90"))


def _fences(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Per group and measure: document count and fences, before they are drawn towards the wider group's."""
    both = F.col("measure").isin([m for m, v in MEASURES.items() if v[3]])
    step = lambda q: F.call_function("shiftright", F.col(q), F.lit(SKETCH_BITS - 1))
    room = lambda far, near, q: reach * F.greatest(F.col(far) - F.col(near), step(q))
    return quantiles(sketch, keys).select(
        *keys, "measure", "n",
        F.when(both, F.greatest(F.col("q25") - room("q50", "q10", "q25"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("low"),
        (F.col("q75") + room("q90", "q50", "q75")).alias("high"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", reach: int = 3, weight: int = 50) -> DataFrame:
    """One row per language and source with group_docs and, for each measure, the struct t_… of its low and high fence."""
    fine = sketches(measured, lang, source)
    per_lang = merge_sketches(fine, ["lang"])
    own, wide, all_of = _fences(fine, ["lang", "source"], reach), _fences(per_lang, ["lang"], reach), _fences(merge_sketches(per_lang, []), [], reach)
    named = lambda t, p: t.select(*(F.col(c).alias(c if p == "a" and c in ("lang", "source", "measure") else f"{p}_{c}") for c in t.columns))
    joined = (named(own, "a").join(named(wide, "b"), F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure")))
              .join(named(all_of, "c"), F.col("measure") == F.col("c_measure")))

    def drawn(end: str) -> Column:
        # From a billion documents on, the wider group moves a fence by less than a unit, so the product stays in 64 bits.
        n = lambda p: f"least({p}_n, 1000000000L)"
        wider = f"({n('b')} * b_{end} + {weight}L * c_{end}) div ({n('b')} + {weight}L)"
        return F.expr(f"({n('a')} * a_{end} + {weight}L * ({wider})) div ({n('a')} + {weight}L)")

    fence = F.struct(drawn("low").alias("low"), drawn("high").alias("high"))
    return joined.groupBy("lang", "source").agg(
        F.max("a_n").alias("group_docs"), *(F.max(F.when(F.col("measure") == m, fence)).alias(m.replace("m_", "t_")) for m in MEASURES))


def judge(measured: DataFrame, table: DataFrame, lang: str = "lang", source: str = "source", broadcast_rows: int = 50_000) -> DataFrame:
    """Adds group_docs (documents of the group past the base rule) and ``kept``: past the base rule and inside every fence of the group.

    A threshold table of up to ``broadcast_rows`` groups is broadcast; a larger one is joined by shuffle, where the adaptive
    plan splits a hot group (the table has one row a group).  Fences come from the edges of buckets, so a value counts as the edge of its bucket.
    """
    table = durable(table)
    few = table.count() <= broadcast_rows
    names = [m.replace("m_", "t_") for m in MEASURES]
    side = table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("group_docs").alias("_docs"), *names)
    both = measured.join(F.broadcast(side) if few else side,
                         F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, t in zip(MEASURES, names, strict=True):
        ends = (bucket(F.col(m)) <= F.col(t)["high"]) & (bucket(F.col(upper(m))) >= F.col(t)["low"])
        inside = inside & F.coalesce(ends, F.lit(True))
    return both.withColumns({"kept": ~F.col("base_failed") & inside, "group_docs": F.coalesce("_docs", F.lit(0).cast("long"))}).drop(
        "_lang", "_source", "_docs", *names)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = 3, weight: int = 50) -> DataFrame:
    """``docs`` with the measures, base_failed, group_docs and ``kept``.

    Two passes over the input: one for the sketches, one for the verdicts, so nothing but sketches is shuffled.  Where the
    text is not wanted back, ``judge_measures`` saves the second pass.
    """
    measured = _measured(docs, text, lang, source)
    return _unpacked(judge(measured, thresholds(measured, reach=reach, weight=weight)), docs.columns)


def judge_measures(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = 3, weight: int = 50) -> DataFrame:
    """As ``quality_rules`` without the text: the measures are written once and read for both steps."""
    rest = [c for c in docs.columns if c != text]
    measured = durable(_measured(docs, text, lang, source, rest))
    return _unpacked(judge(measured, thresholds(measured, reach=reach, weight=weight)), rest)


def _measured(docs: DataFrame, text: str, lang: str, source: str, carried: list[str] | None = None) -> DataFrame:
    """The measures beside the carried columns in one struct, so no name clashes."""
    row = F.struct(*(F.col(c) for c in (docs.columns if carried is None else carried))).alias("_row")
    return measure(docs.select(row, F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))).drop("text")


def _unpacked(judged: DataFrame, columns: list[str]) -> DataFrame:
    return judged.select(*(F.col("_row")[c].alias(c) for c in columns if c not in RESULTS), *RESULTS)
