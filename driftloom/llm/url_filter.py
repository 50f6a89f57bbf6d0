"""URL filter: rules by host and path, gradient-boosted trees where no rule fits.

A rule names a host and the start of a path; it fits its host and all subdomains, and the
longest one that fits wins.  URLs that a rule decides are the labelled ones.  For the others,
boosted trees read lexical features: lengths, depth, digit and letter shares, entropy, numbers of
parameters, and statistics of suffixes: how often URLs with the same last labels of the host, the
same host, file ending or first path segment were blocked.  Those shares are counted over all
distinct labelled URLs in ``SLOTS`` hashed slots per kind; for a URL in training, its own fold is
left out of its shares.  The trees are fitted on at most about ``TRAIN_URLS`` of them.

Features are DataFrame expressions.  Rules and shares join by broadcast: rules are a list of the
caller, shares have a fixed number of slots.  No URL is shuffled but the distinct labelled ones,
whose copies are combined before.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no rule
fits; it is judged like any other; where labelled URLs are all of one verdict, that verdict holds
for the rest, and where there are none, all are allowed; of rules equally long the one with the
longer host wins, and of equal rules the blocking one; repeated rows are judged alike; an empty
table gives no rows; extra columns never matter, and ``judge`` returns them unless their names are
those of its results.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import query, table, unit, written

#: (host and path, verdict) of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Most labelled URLs of a fit, about.
TRAIN_URLS = 200_000
#: Hashed slots of a kind of suffix, and folds of the labelled URLs.
SLOTS, FOLDS = 65_536, 4
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 7
#: A slot counts as if it had so many more URLs with the overall share.
PRIOR = 4.0
#: Most rules: they are broadcast.
MOST_RULES = 500_000
KINDS = ("label", "domain", "site", "host", "ending", "head")


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))


def host(url: Column) -> Column:
    """The host with A-Z in lower case; empty for null."""
    found = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """The path between host and ``?`` or ``#``; empty for null."""
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame, rules: Iterable[tuple[str, str]], host_column: str, path_column: str) -> DataFrame:
    """``urls`` with ``_rule``, a struct of the ``rule`` that fits and its ``verdict``, null where none does."""
    by_labels: dict[int, dict[str, list[tuple[int, int, bool, str, str]]]] = {}
    for number, (rule, verdict) in enumerate(rules):
        if number >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        if verdict not in ("allow", "block") or not rule.split("/", 1)[0]:
            raise ValueError(f"rule {rule!r} {verdict!r} is not a host, a path and allow or block")
        at = rule.split("/", 1)[0].lower()
        starts = rule[len(at) :]
        by_labels.setdefault(at.count(".") + 1, {}).setdefault(at, []).append((len(rule), len(at), verdict == "block", at + starts, starts))
    fits = "array<struct<size:int,host:int,block:boolean,rule:string,path:string>>"
    out, arrays = urls, []
    for labels, hosts in sorted(by_labels.items()):
        known = urls.sparkSession.createDataFrame(list(hosts.items()), f"_suffix string, _fits{labels} {fits}")
        out = out.join(F.broadcast(known), F.substring_index(host_column, ".", -labels) == F.col("_suffix"), "left").drop("_suffix")
        arrays.append(f"_fits{labels}")
    if not arrays:
        return urls.withColumn("_rule", F.lit(None).cast("struct<rule:string,verdict:string>"))
    every = F.concat(*[F.coalesce(F.col(a), F.array().cast(fits)) for a in arrays])
    best = F.array_max(F.filter(every, lambda r: F.startswith(F.col(path_column), r["path"])))
    found = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), F.when(best["block"], "block").otherwise("allow").alias("verdict")))
    return out.withColumn("_rule", found).drop(*arrays)


def entropy(text: Column) -> Column:
    """Bits per character."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    n = F.length(text).cast("double")
    spent = F.aggregate(runs, F.lit(0.0), lambda total, run: total + F.length(run) * F.log2(F.length(run).cast("double")))
    return F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(url: Column, host_: Column, path_: Column) -> list[Column]:
    """Lexical features of a URL without nulls."""
    asked = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    return [
        F.length(url).cast("double"), F.length(host_).cast("double"), F.length(path_).cast("double"), F.length(asked).cast("double"),
        _count(path_, "/[^/]"), _count(host_, r"\."), _count(url, "[0-9]") / n, _count(host_, "[0-9]"), _count(url, "[A-Za-z]") / n,
        _count(url, "[A-Z]"), _count(host_, "-"), _count(path_, "[-_]"), entropy(url), entropy(host_), _count(asked, "[^&]+"), _count(asked, "="),
        _count(url, "%[0-9A-Fa-f]{2}"), F.array_max(F.transform(F.split(path_, "/"), F.length)).cast("double"),
        F.array_max(F.transform(F.split(host_, r"\."), F.length)).cast("double"), url.startswith("https://").cast("double"), _count(host_, "[@:]"),
        F.endswith(path_, F.lit("/")).cast("double"), F.contains(url, F.lit("#")).cast("double"),
    ]


def suffixes(host_: Column, path_: Column) -> dict[str, Column]:
    """The texts whose share of blocked URLs is a feature, by kind."""
    return {
        "label": F.substring_index(host_, ".", -1), "domain": F.substring_index(host_, ".", -2), "site": F.substring_index(host_, ".", -3), "host": host_,
        "ending": F.regexp_extract(path_, r"\.([^./]*)$", 1), "head": F.regexp_extract(path_, r"^/([^/]*)", 1),
    }


def _prepared(urls: DataFrame, url: str) -> DataFrame:
    """``urls`` with ``_lexical`` and one slot per kind of suffix."""
    text = F.coalesce(F.col(url), F.lit(""))
    out = urls.withColumn("_lexical", F.array(*features(text, F.col("_host"), F.col("_path"))))
    return out.withColumns({f"_at_{k}": F.pmod(F.xxhash64(F.lit(k), v), F.lit(SLOTS)).cast("int") for k, v in suffixes(F.col("_host"), F.col("_path")).items()})


class Model:
    """Shares of blocked URLs by slot, and the trees; without trees one verdict for all."""

    def __init__(self, shares: DataFrame | None, overall: float, trees: GBTClassificationModel | None) -> None:
        self.shares, self.overall, self.trees = shares, overall, trees

    def inputs(self, prepared: DataFrame, own_fold: bool) -> DataFrame:
        """``prepared`` with ``features``; in training the row's ``_fold`` is left out of its shares."""
        out, values = prepared, [F.col("_lexical")]
        for kind in KINDS:
            slots = self.shares.where(F.col("kind") == kind).select(F.col("slot").alias(f"_at_{kind}"), F.col("n").alias("_n"), F.col("b").alias("_b"))
            out = out.join(F.broadcast(slots), f"_at_{kind}", "left")  # at most SLOTS rows

            def count(name: str) -> Column:
                every = F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x)
                return F.coalesce(every - F.element_at(name, F.col("_fold") + 1) if own_fold else every, F.lit(0.0))

            share = (count("_b") + F.lit(PRIOR * self.overall)) / (count("_n") + F.lit(PRIOR))
            out = out.withColumns({f"_share_{kind}": share, f"_seen_{kind}": F.log1p(count("_n"))}).drop(f"_at_{kind}", "_n", "_b")
            values.append(F.array(f"_share_{kind}", f"_seen_{kind}"))
        return out.withColumn("_features", array_to_vector(F.concat(*values))).drop("_lexical", *[f"_{a}_{k}" for a in ("share", "seen") for k in KINDS])

    def scored(self, urls: DataFrame, url: str) -> DataFrame:
        """``urls`` (with ``_host`` and ``_path``) and ``_score``, the probability of being blocked."""
        if self.trees is None:
            return urls.withColumn("_score", F.lit(self.overall))
        out = self.trees.transform(self.inputs(_prepared(urls, url), False))
        return out.withColumn("_score", vector_to_array("_probability")[1]).drop("_features", "_probability")


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", most: int = TRAIN_URLS) -> Model:
    """Fit on labelled URLs (``label``: 1 blocked, 0 allowed; null takes no part); of a URL with both, the larger counts."""
    known = labelled.where(F.col(label).isNotNull()).groupBy(F.coalesce(F.col(url), F.lit("")).alias("_url")).agg(F.max(label).cast("double").alias("_y"))
    known = known.withColumns({"_host": host(F.col("_url")), "_path": path(F.col("_url")), "_fold": F.pmod(F.xxhash64("_url"), F.lit(FOLDS)).cast("int")})
    known = written(_prepared(known, "_url"))
    n, blocked = known.agg(F.count("*"), F.sum("_y")).first()
    if not n or blocked in (0, n):
        return Model(None, float(blocked / n) if n else 0.0, None)
    each = known.select("_fold", "_y", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_at_{k}").alias("slot")) for k in KINDS])).alias("_s"))
    folds = [(F.sum((F.col("_fold") == i).cast("double")), F.sum(F.when(F.col("_fold") == i, F.col("_y")).otherwise(0.0))) for i in range(FOLDS)]
    shares = each.groupBy("_s.kind", "_s.slot").agg(F.array(*[a for a, _ in folds]).alias("n"), F.array(*[b for _, b in folds]).alias("b"))
    model = Model(written(shares), blocked / n, None)
    some = known.where(unit(F.xxhash64("_url", F.lit("fit"))) < min(1.0, most / n))
    rows = written(model.inputs(some, True).select("_features", "_y"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, minInstancesPerNode=5,
    )
    model.trees = trees.setPredictionCol("").fit(rows).setRawPredictionCol("").setProbabilityCol("_probability")
    return model


def judge(urls: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", model: Model | None = None) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides).

    Without a ``model``, the URLs that rules decide are its labels.
    """
    rules = list(rules)
    own = ("host", "path", "rule", "verdict", "score")
    some = urls.withColumns({"_host": host(F.col(url)), "_path": path(F.col(url))})
    some = with_rule(some, rules, "_host", "_path")
    if model is None:
        known = some.where("_rule IS NOT NULL").select(F.col(url).alias("url"), (F.col("_rule.verdict") == "block").cast("int").alias("blocked"))
        model = fit(known)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    score = F.when(F.col("_rule").isNull(), F.col("_score"))
    results = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score")]
    return model.scored(some, url).select(*[F.col(f"`{c}`") for c in urls.columns if c.lower() not in own], *results)


@query("op11_url_filter")
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages").select("page_id", "url"), RULES)
