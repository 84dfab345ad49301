"""Operator 4: URL filter: rules first, then logistic regression on character n-grams.

Host and path are cut from the url with SQL functions.  A rule is a host with a
path, like ``example.net/en/``: it fits that host and its subdomains where the
url's path starts with the rule's path, and the longest fitting rule decides.
Urls without a rule are judged by a logistic regression (Spark ML) on hashed
character n-grams of host and path, trained from a small labelled table of urls
(`SEEDS` unless given), and blocked when that is twice as likely as not (BLOCK_AT).

Everything is a projection of the scan: no shuffle of the pages, whatever hosts
are hot.  Rules are part of the plan, at most MAX_RULES.  Training reads nothing but the
table of labelled urls; `accuracy` measures it on names that were held out.

Defined cases: null urls and urls without ``://`` have empty host and path, no
rule, and the model's verdict on the empty host; repeated rows are judged alike;
of rules of the same length the first by code point decides; empty tables give
no rows; very long urls are judged whole; other columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES, FEATURES, SIZES, BLOCK_AT = 1_000, 1 << 14, (3, 4, 5), 2 / 3
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Words of a small labelled table of urls, by the trade that they tell of, and what
# they are joined with.  There are two good words for each bad one, so a host that tells nothing is let through.
BAD = (
    "adult", "ads", "bets", "betting", "cams", "casino", "clicks", "crack", "dating", "escort", "fakes", "gambling", "jackpot", "keygen", "links",
    "loans", "lottery", "meds", "payday", "phishing", "pills", "poker", "popups", "porn", "prizes", "replica", "seo", "sex", "slots", "spam",
    "steroids", "tracker", "viagra", "warez", "xxx",
)
GOOD = (
    "academy", "agency", "airport", "archive", "arts", "astronomy", "bakery", "biology", "books", "botany", "chess", "cinema", "choir", "clinic",
    "college", "crafts", "cycling", "dental", "design", "docs", "energy", "farmers", "festival", "film", "football", "forum", "gallery", "garden",
    "geology", "hiking", "history", "hospital", "hotel", "housing", "journal", "kitchen", "language", "law", "library", "literature", "maps",
    "museum", "music", "news", "observatory", "opera", "orchestra", "parks", "parish", "philosophy", "photos", "physics", "pottery", "radio",
    "railway", "recipes", "research", "restaurant", "sailing", "school", "science", "software", "statistics", "theatre", "travel", "university",
    "weather", "wiki", "winery", "zoology",
)
_WITH = {"block": ("free-{}", "{}-win", "cheap-{}", "hot{}", "{}247"), "allow": ("city-{}", "{}-group", "old-{}", "open{}", "{}24")}
_ANY = ("my-{}", "{}-online", "new-{}", "best{}", "{}", "the-{}")
_BEFORE, _AFTER = ("", "www.", "m.", "blog."), (".example.com/en/{}", ".example.org/de/{}.html", ".example.net/fr/{}?page=2", ".example.com/es/{}/", ".example.org/en/{}#top")
#: (name, label): each word in two names of its label's kind and one of any kind.
NAMES = tuple(
    (form.format(word), label)
    for label, words in (("block", BAD), ("allow", GOOD))
    for k, word in enumerate(words)
    for form in (_WITH[label][k % 5], _WITH[label][(k + 2) % 5], _ANY[k % 6])
)
#: Every name in the same surroundings, so only the names tell the labels apart.
SEEDS = tuple((f"https://{_BEFORE[(k + j) % 4]}{name}{after.format(17 * j)}", label) for k, (name, label) in enumerate(NAMES) for j, after in enumerate(_AFTER))


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a plan")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits stays
        at, _, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column, sizes=SIZES) -> Column:
    """Character n-grams of ``^host$`` and of the path, marked with what they come from."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        for n in sizes:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(_slices(text, starts, n, mark))
    return F.concat(*parts)


def _slices(text: Column, starts: Column, n: int, mark: str) -> Column:
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def _features(urls: DataFrame) -> DataFrame:
    df = urls.withColumn("_grams", ngrams(F.col("_host"), F.col("_path")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(df)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """A model of P(block) from a small table (url, label)."""
    df = labelled.select(host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"), (F.col("label") == "block").cast("double").alias("_label"))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.01, maxIter=60, standardization=False)
    return lr.fit(_features(df.coalesce(1)))


def accuracy(spark: SparkSession, labelled=SEEDS, folds: int = 5) -> tuple[float, float]:
    """Shares of the blocked and of the allowed urls that are judged right when they are left out of training."""
    right = {"block": [], "allow": []}
    each = [zlib.crc32(re.sub(r"^\w+://(www\.|m\.|blog\.)?|[./].*", "", u).encode()) % folds for u, _ in labelled]  # a name is in one fold
    for k in range(folds):
        model = train(spark.createDataFrame([x for x, at in zip(labelled, each, strict=True) if at != k], "url string, label string"))
        held = [x for x, at in zip(labelled, each, strict=True) if at == k]
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
        for r in judge(pages, model, rules=()).collect():
            right[held[r["page_id"]][1]].append(r["verdict"] == held[r["page_id"]][1])
    return tuple(sum(v) / len(v) for v in right.values())


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEEDS), "url string, label string")


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and p_block, the model's probability."""
    df = pages.select("page_id", host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    model.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    df = model.transform(_features(df)).withColumn("_block", F.element_at(_dense(F.col("_p")), 2))
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    said = F.coalesce(verdict, F.when(F.col("_block") >= BLOCK_AT, "block").otherwise("allow"))
    return df.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), said.alias("verdict"), F.col("_block").alias("p_block"))


def _dense(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), train(seeds(spark)))
