"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule such as ``block example.org/es/`` fits its host and every subdomain when the path starts with the
rule's path; the longest fitting rule wins, equally long ones in the order given.  Urls that no rule fits are judged by a
gradient-boosted tree model trained from labelled urls.  Its features are lexical (length, depth, digit ratio, entropy, parameter counts, hyphens)
and statistics of the host's suffix and, beside the method's own list, of the path's first section: how common they are, and how often they are blocked.
A training row's rates leave out all rows whose host falls into the same fold of a hash, its own among them, so the trees do not read a label back
from the statistics; rows to be judged get the rates of all folds.  The training rows are the first by a hash of the url, so a refit gives the same trees.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the model; repeated
urls are judged alike, row by row; with no labelled row, or labels of one kind only, the model is that constant
(``allow`` without labels); an empty table gives an empty result; urls of any length are measured whole, in work that
is linear in them; other columns pass through, those named like a
result column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.files import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters whose shares make up the entropy; all others count as one more symbol.
ALPHABET = LOWER + "0123456789-._~/?&=%"

#: Folds of hosts, and places of the hash that picks training rows.
FOLDS, PLACES = 5, 1 << 40

FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix_log", "f_suffix_rate",
            "f_section_log", "f_section_rate")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """``verdict host/path``, e.g. ``Rule.parse("block example.org/es/")``."""

    verdict: str
    text: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        verdict, text = line.split(maxsplit=1)
        if verdict not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a url rule: {line!r}")
        return cls(verdict, text)

    def fits(self, host_col: Column, path_col: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host_col == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit("/" + rest))


def with_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict; the last two are null where no rule fits."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    pages = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    pick = lambda value: F.coalesce(
        F.lit(None).cast("string"), *(F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))) for r in ranked))
    return pages.withColumns({"rule": pick(lambda r: r.text), "rule_verdict": pick(lambda r: r.verdict)})


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits over ALPHABET and one symbol for all else; work is linear in the text."""
    n = F.length(text)
    known = F.transform(F.array(*(F.lit(c) for c in ALPHABET)), lambda c: n - F.length(F.replace(text, c)))
    other = F.length(F.translate(text, ALPHABET, ""))
    share = F.transform(F.concat(known, F.array(other)), lambda k: k / n)
    bits = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the features of one url alone, with its suffix (last host label) and section (first path segment)."""
    low = F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    n = F.length(low)
    return pages.withColumns({
        "suffix": F.substring_index(F.col("host"), ".", -1),
        "section": F.regexp_extract("path", r"\A/([^/]*)/", 1),
        "f_length": F.log1p(n.cast("double")),
        "f_depth": _count(F.col("path"), "/").cast("double"),
        "f_digits": F.when(n > 0, _count(low, "0123456789") / n).otherwise(0.0),
        "f_entropy": _entropy(low),
        "f_params": (_count(low, "&=") + F.when(F.instr(low, "?") > 0, 1).otherwise(0)).cast("double"),
        "f_hyphens": _count(F.col("host"), "-").cast("double"),
    })


def fold_counts(pages: DataFrame, key: str, label: str) -> DataFrame:
    """For each value of ``key`` and fold of hosts, as a table: pages, labelled pages, blocked ones among these.

    One aggregation that combines before the shuffle, so a hot value costs ``FOLDS`` rows a task.
    """
    return written(pages.groupBy(key, fold().alias("fold")).agg(
        F.count(F.lit(1)).alias("pages"), F.count(label).alias("known"), F.coalesce(F.sum(label), F.lit(0.0)).alias("bad")))


def fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def suffix_statistics(counts: DataFrame, key: str, prior: float = 0.5, weight: float = 20.0) -> DataFrame:
    """For each value of ``key`` and each fold left out (-1: none): log of the page count, and the smoothed rate of blocked pages among the labelled."""
    total = counts.groupBy(key).agg(F.sum("pages").alias("all_pages"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
    rows = counts.join(total, key).select(key, "fold", "all_pages", (F.col("all_known") - F.col("known")).alias("known"), (F.col("all_bad") - F.col("bad")).alias("bad"))
    rows = rows.unionByName(total.select(key, F.lit(-1).alias("fold"), "all_pages", F.col("all_known").alias("known"), F.col("all_bad").alias("bad")))
    return written(rows.select(key, "fold", F.log1p(F.col("all_pages").cast("double")).alias(f"f_{key}_log"),
                               ((F.col("bad") + prior * weight) / (F.col("known") + weight)).alias(f"f_{key}_rate")))


@dataclass
class UrlModel:
    """A fitted filter: the statistics per suffix and section and fold left out, and the trees (or the constant they come down to)."""

    statistics: dict[str, DataFrame]
    trees: Model | None
    constant: float

    def score(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """Adds ``url_score``, the probability of ``block``; pages need host and path."""
        extra = [c for c in (*FEATURES, "suffix", "section")]
        if self.trees is None:
            return pages.withColumn("url_score", F.lit(self.constant))
        out = _featured(pages, {key: table.where("fold = -1").drop("fold") for key, table in self.statistics.items()}, url)
        out = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(out))
        out = out.withColumn("url_score", vector_to_array("_probability")[1])
        return out.drop(*extra, "_features", "_raw", "_probability", "_prediction")


def _featured(pages: DataFrame, statistics: dict[str, DataFrame], url: str) -> DataFrame:
    out = lexical(pages, url)
    for key, table in statistics.items():
        out = out.join(table, [c for c in (key, "fold") if c in table.columns], "left")
    return out.fillna({"f_suffix_log": 0.0, "f_section_log": 0.0, "f_suffix_rate": 0.5, "f_section_rate": 0.5})


def fit(pages: DataFrame, label: str, url: str = "url", training_rows: int = 20_000, rounds: int = 15, depth: int = 4,
        seed: int = 7) -> UrlModel:
    """Trains on the rows whose ``label`` (1.0 block, 0.0 allow) is set.

    The statistics cover all rows.  The trees are grown on at most ``training_rows`` labelled rows, the first by a hash
    of the url; up to that many, all are used.  They are written, in order, as one partition, so that trees do not depend on how the rows arrive.
    """
    pages = lexical(pages, url)
    statistics = {key: suffix_statistics(fold_counts(pages, key, label), key) for key in ("suffix", "section")}
    counted = pages.agg(F.count(label).alias("n"), F.sum(label).alias("bad")).first()
    n, bad = counted["n"], counted["bad"] or 0.0
    if not 0 < bad < n:
        return UrlModel(statistics, None, 1.0 if n and bad else 0.0)
    # The hash alone bounds what is sorted, to about twice the rows wanted.
    place = F.pmod(F.xxhash64(url), F.lit(PLACES))
    near = pages.where(F.col(label).isNotNull() & (place < int(min(1.0, 2.0 * training_rows / n) * PLACES)))
    chosen = near.select(url, "host", "path", label, place.alias("place"), fold().alias("fold")).orderBy("place", url, label).limit(training_rows)
    rows = written(_featured(chosen, statistics, url).select("place", url, label, *FEATURES).repartition(1).sortWithinPartitions("place", url, label))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows).select("_features", label)
    trees = GBTClassifier(featuresCol="_features", labelCol=label, predictionCol="_prediction", maxIter=rounds, maxDepth=depth, seed=seed)
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return UrlModel(statistics, trees.fit(vectors), bad / n)


def url_filter(pages: DataFrame, rules: list[Rule], url: str = "url", block_at: float = 0.5, **training) -> DataFrame:
    """Adds host, path, rule, url_score and verdict (``allow`` or ``block``) to every row.

    The urls a rule fits are the labelled ones; the model learnt from them judges the others.
    """
    packed = pages.select(F.struct(*pages.columns).alias("_row"), F.col(url).alias("url"))
    ruled = with_rules(packed, rules)
    labelled = ruled.withColumn("_label", F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0))
    model = fit(labelled.select("url", "host", "path", "_label"), "_label", **training)
    scored = model.score(ruled)
    verdict = F.coalesce("rule_verdict", F.when(F.col("url_score") >= block_at, "block").otherwise("allow"))
    out = ("host", "path", "rule", "url_score")
    return scored.select(*(F.col("_row")[c].alias(c) for c in pages.columns if c not in (*out, "verdict")), *out, verdict.alias("verdict"))
