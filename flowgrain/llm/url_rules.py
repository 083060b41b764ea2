"""URL filters: fixed host and path rules, and association rules mined from labels by FP-growth.

A url is a set of tokens (host labels, host endings, path segments, query keys). FP-growth over the urls of
labelled pages, with the label as one more token, gives combinations that imply a rejected page; those of
enough support and confidence are rules. Matching is by an inverted index: each rule is filed under its rarest
token, a url meets only the rules filed under its own tokens, and such a meeting counts if the url has all of
the rule's tokens. A url that no fixed rule fits takes the verdict of the mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label=block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


@dataclass(frozen=True)
class Mining:
    support: float = 0.005
    confidence: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?`` or ``#``; both empty without it."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest fitting rule, null where none fits; the first of equally long ones."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)) if rules else ():
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a url."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    ending = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), lambda x: x != "")
    parts = [F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.array(F.concat(F.lit("e:"), ending)), F.transform(segments, lambda x: F.concat(F.lit("p:"), x)), F.transform(keys, lambda x: F.concat(F.lit("q:"), x))]
    return F.array_distinct(F.concat(*parts))


def mine(pages: DataFrame, labels: DataFrame, how: Mining = Mining()) -> DataFrame | None:
    """(rule_id, items, confidence, support) of combinations that imply a rejected page; None without labelled pages.

    A page is rejected if any of its labels has quality 0 or toxic 1; page_id meets doc_id.
    """
    from pyspark.ml.fpm import FPGrowth

    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = pages.select(F.col("page_id").cast("bigint").alias("id"), "url").join(said.where("bad is not null"), "id")
    baskets = materialize(known.select(F.concat(tokens(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items")), "baskets")
    if baskets.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=how.support, minConfidence=how.confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BLOCKED))
    return materialize(found.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), F.col("antecedent").alias("items"), "confidence", "support"), "rules")


def blocked_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url) of the distinct urls that hold all items of a rule, by an inverted index under each rule's rarest item."""
    urls = pages.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    filed = rules.select("rule_id", "items", F.explode("items").alias("item"))
    usage = filed.groupBy("item").agg(F.count("*").alias("used"))
    # Rarest: in the fewest rules, so that the lists of the index stay short.
    index = filed.join(usage, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("used", "item")).alias("item"), F.first("items").alias("items"))
    met = urls.select("url", "tokens", F.explode("tokens").alias("item")).join(index, "item")
    return met.where(F.size(F.array_except("items", "tokens")) == 0).select("url").distinct()


def op7(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, how: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed; repeated rows repeat.
    """
    mined = mine(pages, labels, how)
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    if mined is None:
        judged = base.withColumn("hit", F.lit(False))
    else:
        hits = blocked_urls(base, mined).select(F.col("url").alias("hit_url"))
        judged = base.join(hits, F.col("url") == F.col("hit_url"), "left").withColumn("hit", F.col("hit_url").isNotNull())
    name, verdict = fixed_rule(host, path, rules)
    return judged.select("page_id", host.alias("host"), path.alias("path"), name.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
