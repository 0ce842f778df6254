"""URL filters: given host and path rules, and association rules mined from labels.

FP-growth finds the token combinations of labelled URLs; those that go with a bad label often enough, by support and
confidence, become rules. An inverted index from tokens to rules matches them: a rule holds for a URL if as many of its
tokens are found as it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
BAD = "label=bad"
SALTS = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest fitting rule, or null. rules: (verdict, host, path)."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments with numbers as #, names of query fields."""
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#")))
    fields = F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(labels, segments, fields), lambda x: F.length(x) > 2))


def mine_rules(labelled: DataFrame, *, least_support: float = 0.002, least_confidence: float = 0.5) -> DataFrame:
    """(rule_id, tokens, support, confidence) from rows (tokens, bad): combinations of tokens, of any length, that go with bad.

    Tokens that are found in the very same labelled rows can't be told apart and count as one item, so a long URL that
    repeats is one item and not all combinations of its parts; tokens holds the alternatives of each item, any of which will
    do. Tokens in too few bad rows are in no rule. A rule that holds all items of another one is left out: it fits no URL
    that the other doesn't. An empty table gives no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = materialize(labelled.where(F.col("bad") | (F.size("tokens") > 0)).select("tokens", "bad", F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    none = spark.createDataFrame([], "rule_id string, tokens array<array<string>>, support double, confidence double")
    if not n:
        return none
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.count_if("bad").alias("g"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("g") >= F.ceil(F.lit(least_support * n)))
    # At most tokens of a row / least_support tokens are that frequent.
    items = materialize(marks.groupBy("f", "g", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("alternatives")).select(F.col("alternatives")[0].alias("item"), "alternatives"))
    named = items.select("item", F.explode("alternatives").alias("token"))
    sets = each.join(F.broadcast(named), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    held = rows.select("row", "bad").join(sets, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    baskets = materialize(held.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1) == BAD)
    rules = materialize(found.select(F.md5(F.array_join(F.array_sort("antecedent"), "\x01")).alias("rule_id"), "antecedent", "support", "confidence"))
    spread = rules.select("rule_id", F.explode("antecedent").alias("item")).join(items, "item").groupBy("rule_id").agg(F.array_sort(F.collect_list("alternatives")).alias("tokens"))
    rules = materialize(rules.join(spread, "rule_id").select("rule_id", "tokens", "support", "confidence"))
    wider = match_rules(rules.select(F.col("rule_id").alias("url"), F.flatten("tokens").alias("tokens")), rules).where("n_rules > 1")  # each fits itself
    return materialize(rules.join(wider, rules["rule_id"] == wider["url"], "left_anti"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n_rules) of the distinct URLs (url, tokens) that some rule holds for, by an inverted index of the rules' tokens."""
    index = rules.select("rule_id", F.size("tokens").alias("needs"), F.posexplode("tokens").alias("item", "any")).select("rule_id", "needs", "item", F.explode("any").alias("token"))
    held = urls.select("url", F.explode("tokens").alias("token")).join(index, "token")
    full = held.groupBy("url", "rule_id").agg(F.size(F.collect_set("item")).alias("got"), F.first("needs").alias("needs")).where("got = needs")
    return full.groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None, least_support: float = 0.002, least_confidence: float = 0.5) -> DataFrame:
    """One row per input row: (id_col, host, path, rule, verdict, n_rules).

    The verdict is that of the longest given rule that fits (its host or a subdomain, and a path that starts with the
    rule's), else block if a mined rule holds, else allow; n_rules counts the mined rules that hold. Null URLs and URLs
    without :// have an empty host and path, so no rule holds for them. Equal URLs are matched once; repeated rows and null
    ids are answered row by row. Labels without a page, or of null value, are not used. Other columns are ignored; an empty
    table gives none.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    marks = labels.select(F.col(label_id).alias("id"), bad.alias("bad")).where("bad is not null")
    labelled = source.join(marks, "id").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = mine_rules(labelled, least_support=least_support, least_confidence=least_confidence)
    distinct = source.select("url").where("url is not null").distinct().select("url", url_tokens(F.col("url")).alias("tokens"))
    hits = match_rules(distinct, mined)
    # A much repeated URL is dealt over salts, and so are null URLs.
    salted = source.withColumn("salt", F.when(F.col("url").isNull(), F.pmod(F.xxhash64("id"), F.lit(1000))).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS))).cast("int"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted.join(hits, ["url", "salt"], "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("n_rules") > 0, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
