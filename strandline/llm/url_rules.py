"""URL filtering by fixed rules and mined association rules, in DataFrame operations.

Fixed rules name a host and a path prefix; the longest that fits decides. Every other URL is judged by association rules:
labelled URLs become token sets (host labels, path segments with numbers folded, query names), Spark's FP-growth finds the
combinations with the label ``block``, and rules below the least support or confidence, or with a more general rule at least as
confident, are dropped. Rules are matched through an inverted index on one token each, the one fewest rules have, and a
check of the others. URLs that no rule matches are allowed.

The learning set is the URLs whose number (a numeric path segment) is the id of a labelled document; it may be empty. Defined
cases: a null URL, or one without ``://``, has an empty host and path, matches nothing and is allowed; null labels teach
nothing; repeated rows are judged each, and count as often in the mining; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SUPPORT, CONFIDENCE = 0.005, 0.6
BLOCK = "label=block"
SMALL_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is ``host`` or a domain above it and whose path begins ``path``; null if none fits."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        found.append(F.when(fits & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a URL."""
    named = lambda mark, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))
    segments = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, "[0-9]+", "#"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", segments), named("q:", names)))


def parsed(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn(
        "tokens", F.when(F.col("host") != "", tokens_of(F.col("host"), F.col("path"), url)).otherwise(F.array().cast("array<string>"))
    )


def labelled(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the URLs of labelled documents, with the item ``label=block`` or ``label=allow``."""
    number = F.regexp_extract("path", "/([0-9]+)", 1)
    named = urls.where((F.size("tokens") > 0) & (number != "")).select("tokens", F.expr(f"try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, BLOCK).otherwise("label=allow").alias("label"))
    return named.join(marked, "doc_id").select(F.concat("tokens", F.array("label")).alias("items"))


def mined(sets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(rule_id, antecedent, confidence)`` of the rules to ``label=block`` that survive pruning."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence")
    rules = Shared(sets.sparkSession).write(rules.withColumn("rule_id", F.monotonically_increasing_id()), "rules")
    # A more general rule shares every token of its antecedent, so it is found through each rule's own tokens.
    parts = rules.select("rule_id", "confidence", "antecedent", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    wide = parts.select(F.col("rule_id").alias("wide_id"), F.col("confidence").alias("wide_confidence"), F.col("n").alias("wide_n"), "token")
    met = parts.join(wide, "token").where("wide_n < n and wide_confidence >= confidence").groupBy("rule_id", "wide_id", "wide_n").count()
    redundant = met.where("count = wide_n").select("rule_id").distinct()
    return rules.join(redundant, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Tokens sets of the URLs that some rule matches (distinct)."""
    parts = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    held = parts.groupBy("token").agg(F.count("*").alias("rules"))
    keys = parts.join(held, "token").groupBy("rule_id").agg(F.min(F.struct("rules", "token")).alias("rarest"), F.first("antecedent").alias("antecedent"))
    index = keys.select(F.col("rarest.token").alias("token"), "antecedent")
    sets = urls.select("tokens").where(F.size("tokens") > 0).distinct()
    asked = sets.withColumn("token", F.explode("tokens")).join(small(index, SMALL_RULES), "token")
    return asked.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("tokens").distinct()


def judged(pages: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None, **options) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every URL."""
    rules = RULES if rules is None else rules
    urls = parsed(pages).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    found = mined(labelled(urls, labels), **options)
    verdict = F.lit(None).cast("string")
    for rule, decision in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(decision)).otherwise(verdict)
    if found.isEmpty():
        return urls.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit("allow")).alias("verdict"))
    blocked = matched(urls.where("rule is null"), found).withColumn("blocked", F.lit(True))
    blocked = small(blocked, SMALL_RULES)
    decided = F.coalesce(verdict, F.when(F.col("blocked"), "block"), F.lit("allow"))
    return urls.join(blocked, "tokens", "left").select("page_id", "host", "path", "rule", decided.alias("verdict"))
