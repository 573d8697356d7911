"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

The patterns ``assign``, ``access`` and ``hex`` are always reported.  Besides, every maximal run of at least ``MIN_TOKEN``
characters of the base64 alphabets is a candidate.  Its encoding is inferred (hex, letters of one case, base32, base36, base64; plain
decimals are none) and three statistics compare it with what language written in these characters would give at its length (``LANGUAGE``):

* chi-squared of the character counts against a uniform alphabet (language piles up on few letters),
* the number of runs: of one character class (language changes class seldom), and for letters of one case of vowels and of consonants
  (language alternates more often than chance),
* the serial correlation of neighbouring character values, beyond what independent characters would show (sequences have it).

Their sum is a z-value against language.  Within a stratum, an encoding and a length class, all candidates of the corpus are counted in z-bins, and
the step-up rule of Benjamini and Hochberg takes the lowest bin from which on the expected share of false finds stays below ``rate``.
Those candidates are reported as ``random``.  The rule alone decides: there is no least z-value.  ``MIN_TOKEN`` bounds recall: random tokens of fewer
characters are found by the fixed patterns only; from 32 characters on, nine in ten of every encoding pass 2.25 standard deviations, at 16 only half of those of
letters alone.

Spans are code points, end exclusive.  Defined cases: a null or empty text has no span; repeated rows give the same spans;
an empty table gives an empty result; of
equal z-values all or none are reported; other columns pass through, those named like a result are replaced; a text of any length is scanned as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.quality import let
from turnout.session import durable

#: Fixed patterns of the base rules, in the order in which equal starts are listed.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN
KINDS = ("assign", "access", "hex", "random")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
VALUES = DIGITS + UPPER + LOWER + "+/_-"

#: What language is like in the characters of an encoding, by alphabet size: index of coincidence, and changes per character (between vowels and
#: consonants for the 26 letters of one case, else between lower case, upper case, digits and marks).
LANGUAGE = {16: (0.15, 0.2), 26: (0.07, 0.62), 32: (0.065, 0.1), 36: (0.06, 0.2), 64: (0.05, 0.35)}
VOWELS = "AEIOUYaeiouy"
#: Serial correlation that independent characters seldom exceed, in standard deviations, and the variance of the sum of the statistics.
CORRELATION, SUM_VARIANCE = 2.0, 2.0
BINS, LOWEST, HIGHEST = 8, -40, 96
LENGTH_CLASSES = (16, 24, 32, 48, 64, 128)

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def prefix_sums(values: Column, chunk: int = 512) -> Column:
    """Sum of the elements before each one.  By chunks, as appending to an array copies it."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))
    sums = lambda xs: F.aggregate(xs, nothing, lambda a, x: F.struct(
        (a["total"] + x).alias("total"), F.array_append(a["before"], a["total"]).alias("before")), lambda a: a["before"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda c: F.slice(values, c * chunk + 1, chunk))
    merged = let(pieces, lambda ps: F.flatten(F.zip_with(ps, sums(F.transform(ps, total)), lambda p, base: F.transform(sums(p), lambda v: v + base))))
    return F.when(F.size(values) > 0, merged).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, stop, value), value being ``group``."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
                     F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["whole"], lambda w: F.length(w).cast("bigint"))
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["whole"])), sizes, lambda g, n: F.length(g) + n)
        starts = F.zip_with(let(steps, lambda x: prefix_sums(x)), F.slice(x["gaps"], 1, F.size(x["whole"])), lambda p, g: p + F.length(g))
        return F.zip_with(F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("stop"))), x["value"],
                          lambda p, v: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), v.alias("value")))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return F.when(F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False)), let(found, placed)).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["stop"].alias("stop"))).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    assign = F.filter(matches(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= 6)
    return F.array_sort(F.concat(_spans(assign, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")))


def alphabet_size(token: Column) -> Column:
    """Characters in the inferred encoding: hex 16, base32 32, base36 36, letters 26, base64 64; null for decimals."""
    fits = lambda p: F.rlike(token, F.lit(p))
    return (F.when(fits(r"\A[0-9]+\z"), F.lit(None).cast("double"))
            .when(fits(r"\A([0-9a-f]+|[0-9A-F]+)\z"), 16.0)
            .when(fits(r"\A([a-z]+|[A-Z]+)\z"), 26.0)
            .when(fits(r"\A[A-Z2-7]+\z"), 32.0)
            .when(fits(r"\A([0-9a-z]+|[0-9A-Z]+)\z"), 36.0)
            .otherwise(64.0))


def z_value(token: Column, alphabet: Column) -> Column:
    """How far the token is from language towards randomness, in standard deviations; null where alphabet is."""
    n = F.length(token).cast("double")
    chars = F.split(token, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0).cast("bigint"), lambda a, c: a + let(
        (F.length(token) - F.length(F.replace(token, c))).cast("bigint"), lambda k: k * k))
    shape, letters = token, token
    for one_class, mark in (("[a-z]+", "l"), ("[A-Z]+", "U"), ("[0-9]+", "0"), ("[+/_-]+", "-")):
        shape = F.regexp_replace(shape, one_class, mark)
    for one_class, mark in ((f"[{VOWELS}]+", "0"), ("[A-Za-z]+", "l")):
        letters = F.regexp_replace(letters, one_class, mark)
    runs = F.when(alphabet == 26.0, F.length(letters)).otherwise(F.length(shape))
    value = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(VALUES)).cast("bigint"))
    plus = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")

    def correlation(v: Column) -> Column:
        turned = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
        total, square = F.aggregate(v, zero, plus), F.aggregate(v, zero, lambda a, x: a + x * x)
        product = F.aggregate(F.zip_with(v, turned, lambda x, y: x * y), zero, plus)
        return let(F.struct(total.alias("t"), square.alias("s"), product.alias("p"), F.size(v).cast("bigint").alias("n")), lambda x: F.when(
            x["n"] * x["s"] == x["t"] * x["t"], 1.0).otherwise(
            (x["n"] * x["p"] - x["t"] * x["t"]).cast("double") / (x["n"] * x["s"] - x["t"] * x["t"]).cast("double")))

    of = lambda value: F.coalesce(*(F.when(alphabet == float(size), value(*language)) for size, language in LANGUAGE.items()))
    coincidence, changes, variance = of(lambda c, ch: F.lit(c)), of(lambda c, ch: F.lit(ch)), of(lambda c, ch: F.lit(ch * (1.0 - ch)))
    chi = alphabet / n * squares.cast("double") - n
    pile = alphabet * coincidence - 1.0
    z_chi = ((alphabet - 1.0) + (n - 1.0) * pile - chi) / F.sqrt(2.0 * (alphabet - 1.0) + 4.0 * (n - 1.0) * F.abs(pile))
    more = ((runs.cast("double") - 1.0) - (n - 1.0) * changes) / F.sqrt((n - 1.0) * variance)
    z_runs = F.when(alphabet == 26.0, -more).otherwise(more)
    z_serial = F.least(F.lit(CORRELATION) - F.abs(let(value, correlation)) * F.sqrt(n), F.lit(0.0))
    return (z_chi + z_runs + z_serial) / math.sqrt(SUM_VARIANCE)


def z_bin(z: Column) -> Column:
    return F.least(F.greatest(F.floor(z * BINS), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")


def stratum(token: Column, alphabet: Column) -> Column:
    """Number of the encoding and length class."""
    out = F.lit(0)
    for k, least in enumerate(LENGTH_CLASSES):
        out = F.when(F.length(token) >= least, k).otherwise(out)
    kind = F.coalesce(*(F.when(alphabet == float(size), len(LENGTH_CLASSES) * k) for k, size in enumerate(LANGUAGE)))
    return (kind + out).cast("int")


def candidates(text: Column) -> Column:
    """Tokens with the statistics: array of (start, stop, stratum, z-bin)."""
    tested = F.transform(matches(text, TOKEN), lambda m: let(alphabet_size(m["value"]), lambda a: F.struct(
        m["start"].alias("start"), m["stop"].alias("stop"), stratum(m["value"], a).alias("size"), z_bin(z_value(m["value"], a)).alias("z"))))
    return F.filter(tested, lambda t: t["size"].isNotNull())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns) and ``tested`` (candidates with their statistics)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"base": base_spans(whole), "tested": candidates(whole)})


def tail(z: int) -> float:
    """Chance that a standard normal value reaches the lower edge of bin ``z``."""
    return 0.5 * math.erfc(z / BINS / math.sqrt(2.0))


def cut_offs(scanned: DataFrame, rate: float = 0.05) -> list[tuple[int, int]]:
    """(stratum, lowest reported bin); at most one row for each of the fixed strata.

    The counts per stratum and bin, of all candidates, combine before the shuffle: at most
    ``len(LANGUAGE) * len(LENGTH_CLASSES) * (HIGHEST - LOWEST + 1)`` rows a task, whatever the corpus.
    """
    bins = scanned.select(F.explode("tested").alias("t")).groupBy("t.size", "t.z").agg(F.count(F.lit(1)).alias("n"))
    chance = F.element_at(F.array(*(F.lit(tail(z)) for z in range(LOWEST, HIGHEST + 1))), F.col("z") - LOWEST + 1)
    totals = bins.groupBy("size").agg(F.sum("n").alias("m"), F.collect_list(F.struct("z", "n")).alias("bins"))
    reached = totals.select("size", "m", F.explode("bins").alias("b"), "bins").select(
        "size", "m", F.col("b.z").alias("z"),
        F.aggregate("bins", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["z"] >= F.col("b.z"), x["n"]).otherwise(F.lit(0).cast("bigint"))).alias("found"))
    good = reached.where(F.col("m") * chance <= rate * F.col("found"))
    return [(r["size"], r["z"]) for r in good.groupBy("size").agg(F.min("z").alias("z")).orderBy("size").collect()]


def with_spans(scanned: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Replaces ``base`` and ``tested`` by ``base_spans`` and ``all_spans``, each by start and then kind."""
    found = lambda t: F.lit(False) if not cuts else F.exists(
        F.array(*(F.struct(F.lit(s).alias("s"), F.lit(z).alias("z")) for s, z in cuts)), lambda c: (c["s"] == t["size"]) & (t["z"] >= c["z"]))
    random = _spans(F.filter("tested", found), "random")
    return scanned.withColumns({"all_spans": F.array_sort(F.concat("base", random)), "base_spans": F.col("base")}).drop("base", "tested")


def secret_scan(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``; two passes over the input, nothing but bin counts is shuffled."""
    return _reported(_scanned(docs, text, docs.columns), docs.columns, rate)


def scan_only(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """As ``secret_scan`` without the text, in one pass: what was found is written once and read for both steps."""
    rest = [c for c in docs.columns if c != text]
    return _reported(durable(_scanned(docs, text, rest)), rest, rate)


def _scanned(docs: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """What was found beside the carried columns in one struct, so no name clashes."""
    return scan(docs.select(F.struct(*carried).alias("_row"), F.col(text).alias("text"))).drop("text")


def _reported(scanned: DataFrame, columns: list[str], rate: float) -> DataFrame:
    found, spans = with_spans(scanned, cut_offs(scanned, rate)), ("base_spans", "all_spans")
    return found.select(*(F.col("_row")[c].alias(c) for c in columns if c not in spans), *spans)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every stretch covered by spans replaced by one mark.

    The characters are split once, so the work is linear in the text however many spans there are.
    """
    start = F.struct(F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("done"), F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("stop"))
    merge = lambda a, s: F.when(s["start"] <= a["stop"], F.struct(
        a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["stop"], s["stop"]).alias("stop"))).otherwise(F.struct(
            F.when(a["start"] < 0, a["done"]).otherwise(F.array_append(a["done"], F.struct(a["start"].alias("start"), a["stop"].alias("stop")))).alias("done"),
            s["start"].alias("start"), s["stop"].alias("stop")))
    merged = F.aggregate(spans, start, merge, lambda a: F.array_append(a["done"], F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))

    def rebuilt(parts: Column, chars: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(parts, k - 1)["stop"]).otherwise(F.lit(0).cast("bigint"))
        kept = F.transform(parts, lambda p, k: F.concat(F.array_join(F.slice(chars, before(k).cast("int") + 1, (p["start"] - before(k)).cast("int")), ""), F.lit(mark)))
        last = F.element_at(parts, -1)["stop"].cast("int")
        return F.concat(F.array_join(kept, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), ""))

    both = F.struct(merged.alias("parts"), F.split(text, "").alias("chars"))
    return F.when(F.size(spans) > 0, let(both, lambda x: rebuilt(x["parts"], x["chars"]))).otherwise(text)
