"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path; it fits the host and all its subdomains where
the path of a URL starts with the rule's, and the longest fitting rule decides.
The URLs that rules decide are the labelled ones: trees are boosted on them and
judge all others. All work is DataFrame expressions and the JVM's own learner.

The trees are fitted on a bounded sample of labelled rows, MOST_LABELLED, in the
order of a hash of the URL; the statistics of suffixes cover all labelled rows.
A labelled URL takes its suffix's share from the other folds of labelled URLs
only, so the trees never see a label within the feature that they learn it from.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
an empty path fits no rule; repeated rows are judged each; where the labelled
URLs are all of one kind the method gives that verdict, and ``allow`` without
any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch

# The rules as (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled rows that the trees are fitted on, at most; trees and their depth.
MOST_LABELLED, TREES, DEPTH = 20_000, 20, 4
#: Labels of a suffix that count before its own share does; folds of labelled URLs, by hash.
SMOOTHING, FOLDS = 20.0, 5

FEATURES = ("n_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "n_params", "param_chars", "has_fragment", "n_labels", "longest_label", "n_hyphens", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def deciding_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``(length, rule, action)`` of the longest rule that fits, or null."""
    fitting = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")))
        for action, h, p in rules
    ]
    # Rules are literals of the job; greatest() skips those that don't fit.
    return F.greatest(*fitting) if len(fitting) > 1 else fitting[0]


def entropy(text: Column) -> Column:
    """Bits a character of the text's characters."""
    n = F.length(text)

    def term(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), term)).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (``url, host, path``) with all features but that of the suffix."""
    url, host = F.coalesce(F.col("url"), F.lit("")), F.col("host")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return urls.withColumns(
        {
            "n_chars": F.length(url),
            "host_chars": F.length(host),
            "path_chars": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy(host),
            "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "param_chars": F.length(query),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "n_labels": F.size(labels),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
            "n_hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
            # The ending of a host and the first part of a path, as lists of sites are ordered by.
            "suffix": F.concat_ws("/", F.element_at(labels, -1), F.get(F.split("path", "/"), F.lit(1))),
        }
    )


def train(labelled: DataFrame) -> GBTClassificationModel | None:
    """Trees for ``blocked`` (0 or 1) by the features, or None if the sample lacks a class."""
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED)
    rows = Scratch(labelled.sparkSession, "urls").keep(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", F.col("blocked").cast("double").alias("label")))
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(rows)


def described_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, the rule that fits, features, and ``blocked`` (0 or 1) where a rule decides."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("fit", deciding_rule(F.col("host"), F.col("path"), rules))
    return lexical_features(urls).withColumn("blocked", F.when(F.col("fit").isNotNull(), (F.col("fit.action") == "block").cast("int")))


def with_suffix_share(described: DataFrame, prior: float) -> DataFrame:
    """``suffix_share``: the smoothed share of blocked URLs among the labelled ones of the suffix, in other folds for a labelled URL."""
    folded = described.withColumn("fold", F.expr(f"cast(pmod(xxhash64(url), {FOLDS}) as int)"))
    of_fold = lambda f, value: F.array(*[F.coalesce(f(F.when(F.col("fold") == i, value)), F.lit(0)) for i in range(FOLDS)])
    known = folded.where("blocked is not null").groupBy("suffix").agg(
        F.sum("blocked").alias("n_blocked"), F.count("*").alias("n_known"), of_fold(F.sum, F.col("blocked")).alias("blocked_of"), of_fold(F.count, F.lit(1)).alias("known_of")
    )
    joined = folded.join(known.withColumnRenamed("suffix", "of"), F.col("suffix").eqNullSafe(F.col("of")), "left")
    own = lambda c: F.when(F.col("blocked").isNotNull(), F.get(F.col(c), F.col("fold"))).otherwise(0)
    share = (F.col("n_blocked") - own("blocked_of") + SMOOTHING * prior) / (F.col("n_known") - own("known_of") + SMOOTHING)
    return joined.withColumn("suffix_share", F.coalesce(share, F.lit(prior))).drop("of", "fold", "n_blocked", "n_known", "blocked_of", "known_of")


def scored_urls(described: DataFrame) -> DataFrame:
    """``described`` with ``block_score`` (0 to 1), learnt from its rows where ``blocked`` is set."""
    totals = described.agg(F.avg("blocked")).first()[0]
    prior = 0.0 if totals is None else float(totals)
    complete = with_suffix_share(described, prior)
    model = train(complete.where("blocked is not null"))
    if model is None:
        return complete.withColumn("block_score", F.lit(1.0 if prior >= 0.5 else 0.0))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(complete)
    return model.transform(assembled).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict, block_score``."""
    scored = scored_urls(Scratch(pages.sparkSession, "urls").keep(described_urls(pages, rules)))
    learnt = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), learnt).alias("verdict"), "block_score")


def held_out_accuracy(pages: DataFrame, rules=RULES, every: int = 3) -> float | None:
    """The share of rule-decided URLs, one in ``every`` by hash, that trees learnt from the others judge as their rule does; None without any."""
    held = F.expr(f"coalesce(pmod(xxhash64(url, 1), {every}) = 0, false)")
    described = Scratch(pages.sparkSession, "urls").keep(described_urls(pages, rules))
    scored = scored_urls(described.withColumn("blocked", F.when(~held, F.col("blocked"))))
    right = (F.col("block_score") >= 0.5) == (F.col("fit.action") == "block")
    return scored.where(held & F.col("fit").isNotNull()).agg(F.avg(right.cast("int"))).first()[0]
