"""Queries of the account rules."""

from __future__ import annotations

from tradeglass.catalog.oracle import status_sql
from tradeglass.catalog.registry import query
from tradeglass.operators.history import KEY
from tradeglass.plans.account_rules import RULES, rule_outcomes


def _register(rule) -> None:
    @query(f"{rule.id}_{rule.issue}", f"SELECT report_id, entity_key, {status_sql(rule.id)} AS status FROM ora_rule")
    def run(b):
        return rule_outcomes(b.tradelines(), b.cells(), [rule.id], keep=KEY).select(*KEY, "status")


for _rule in RULES:
    _register(_rule)
