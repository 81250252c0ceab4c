"""Registered queries, each with the SQL that must give the same rows."""

import importlib

MODULES = ["url_plans", "verdict_plans", "http_plans", "header_plans", "html_plans", "rule_plans", "rating_plans", "dns_plans", "source_plans", "content_plans", "stream_plans"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"millrace.plans.{name}")
