"""Query expansion: stored replies where they are valid, rules otherwise."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, contains_any, strip, text
from ..lexicons import EXPANSION_RULES, SUMMARY_TAIL

REPLY = "search_query string, summary string"
TRIGGER_WORDS = 3


def rule_words(query, rules=EXPANSION_RULES) -> Column:
    """Words of every rule the query fires, in rule order.

    A rule fires on its domain or on one of its first three words. The rules are few and fixed,
    so they are part of the expression and no join is needed.
    """
    low = F.lower(text(query))
    fired = [
        F.when(contains_any(low, [domain.lower()] + [w.lower() for w in words.split()[:TRIGGER_WORDS]]), words)
        for domain, words in rules
    ]
    return F.concat_ws(" ", *fired)


def expand_by_rules(query, rules=EXPANSION_RULES) -> tuple[Column, Column]:
    q = text(query)
    extra = rule_words(query, rules)
    wide = F.when(extra == "", q).otherwise(F.concat_ws(" ", q, extra))
    return strip(wide), F.concat(F.substring(q, 1, 20), F.lit(SUMMARY_TAIL))


def decode_reply(reply) -> Column:
    """The JSON object in a stored reply, perhaps inside code fences; null unless both keys exist."""
    bare = F.regexp_replace(col(reply), "```(?:json)?", "")
    bare = strip(F.regexp_replace(strip(bare), "`+$", ""))
    keys = F.json_object_keys(bare)
    valid = F.array_contains(keys, "search_query") & F.array_contains(keys, "summary")
    return F.when(F.coalesce(valid, F.lit(False)), F.from_json(bare, REPLY))


def expand_queries(queries: DataFrame, replies: DataFrame | None = None, query="query", rules=EXPANSION_RULES) -> DataFrame:
    """Adds search_query, summary and provider.

    `replies` (query, provider, priority, reply): the valid reply of the lowest priority wins.
    """
    by_rule, summary = expand_by_rules(query, rules)
    if replies is None:
        return queries.select("*", by_rule.alias("search_query"), summary.alias("summary"), F.lit("rules").alias("provider"))
    valid = replies.select(F.col("query").alias("_q"), "provider", "priority", decode_reply("reply").alias("r")).where("r IS NOT NULL")
    best = valid.groupBy("_q").agg(F.min_by(F.struct("provider", "r"), F.struct("priority", "provider")).alias("best"))
    joined = queries.join(best, F.col(query) == F.col("_q"), "left").drop("_q")
    return joined.select(
        *queries.columns,
        F.when(F.col("best").isNull(), by_rule).otherwise(F.col("best.r.search_query")).alias("search_query"),
        F.when(F.col("best").isNull(), summary).otherwise(F.col("best.r.summary")).alias("summary"),
        F.coalesce("best.provider", F.lit("rules")).alias("provider"),
    )
