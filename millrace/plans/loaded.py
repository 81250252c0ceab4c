"""The rules of the registered queries, written to a folder file and loaded from it as a user's rules are."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

from millrace import policy as P
from millrace.operators.feeds import FEED_RULES, FeedRule
from millrace.session import fresh_path
from millrace.sources.compiled import RuleSet, compile_rules, compile_scopes, write_rule_set, write_scopes
from millrace.sources.rules_xml import read_folders


@lru_cache(maxsize=2)
def _loaded(spark: SparkSession, application: str) -> RuleSet:
    path = fresh_path(spark, "rule-set")
    own = RuleSet(
        tuple(P.ALLOW_PATTERNS), tuple(P.BLOCK_PATTERNS), tuple(P.HEADER_RULES), tuple(P.TEXT_RULES), tuple(P.TAG_RULES), tuple(P.IMAGE_RULES),
        tuple(P.QUALITY_RULES), tuple(P.RatingRule(sid, tuple(limits.items())) for sid, limits in P.RATING_LIMITS.items()),
        (*FEED_RULES, FeedRule("wc.99", "/rdf:RDF/textinput", "remove")),
    )
    write_rule_set(spark, own, path)
    return compile_rules(read_folders(spark, path))


def rule_set(t) -> RuleSet:
    """Loaded once in a session."""
    return _loaded(t.spark, t.spark.sparkContext.applicationId)


@lru_cache(maxsize=2)
def _scopes(spark: SparkSession, application: str):
    path = fresh_path(spark, "rule-scopes")
    write_scopes(spark, P.SCOPED_RULES, path)
    return compile_scopes(read_folders(spark, path))


def scoped_rules(t):
    """Loaded once in a session."""
    return _scopes(t.spark, t.spark.sparkContext.applicationId)
