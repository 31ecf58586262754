"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import entities, graph, network, scores, series, text
from .views import Tables

_ALL = graph.Q | scores.Q | series.Q | network.Q | text.Q | entities.Q


def _query(plan: Callable[[Tables], DataFrame], kept: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir, kept))


#: Plans that read the pairs of banks and companies more than once.
_KEPT = {*network.Q, "q5_loans_to_rpt_of_other", "q7_subsidiary_two_hop", "q8_borrower_holds_other", "q9_rpt_bridge", "q10_conflict_triangle", "q15_rpt_and_borrower", "q19_company_ego", "q20_degree_proxy", "q27_owner_bank_borrower", "q28_circular", "q29_rpt_lending_overlap", "q30_overview", "graph_counts"} - {"base_stress", "leaf_view", "bank_network_edges"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(plan, name in _KEPT) for name, (plan, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: oracle for name, (_, oracle) in _ALL.items() if oracle}
