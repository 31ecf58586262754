"""Nodes, stand-ins, predicates and sector operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import predicates as B
from tideline.operators import edges as E
from tideline.operators import matching as M
from tideline.operators import nodes as N
from tideline.operators import sectors as S


def test_company_nodes_keep_what_is_filled(spark):
    docs = spark.createDataFrame([("c1", "Old", 5, 1), ("c1", "", None, 2), ("c1", "New", None, 3), ("", "x", 1, 4), (None, "x", 1, 5)], "cin string, name string, n int, seq int")
    assert [tuple(r) for r in N.company_nodes(docs, "cin", "seq").collect()] == [("c1", "New", 5)]


def test_bank_nodes_seed_the_registry(spark):
    docs = spark.createDataFrame([("A", "Bank A", 7, None, 0.2, 1), ("B", "", 1, 1, 0.1, 1), (None, "x", 1, 1, 0.1, 2)], "symbol string, name string, shares long, holders long, stress double, seq int")
    registry = spark.createDataFrame([("A", "other"), ("B", "Bank B")], "symbol string, name string")
    assert sorted(map(tuple, N.bank_nodes(docs, registry, "seq").collect())) == [("A", "Bank A", 7, 0, 0.2), ("B", "Bank B", 0, 0, None)]


def test_ownership_of_all_six_kinds(spark):
    """The last holding of a pair stands; what is held has to be a node; nothing holds itself."""
    held = [(raw, kind, dst, 1.5, 10, 1) for raw in ("Bank A", "Comp C", "Someone") for kind, dst in (("Bank", "bB"), ("Company", "cD"), ("Company", "cGone"))]
    held += [("Bank A", "Bank", "bA", 9.0, 1, 1), ("", "Bank", "bA", 1.0, 1, 1), ("Someone", "Bank", "bB", 99.0, 99, 0), ("Someone", "Bank", "bB", 70.0, 5, 2)]
    holdings = spark.createDataFrame(held, "raw string, dst_kind string, dst string, pct double, shares long, seq int")
    resolved = spark.createDataFrame([("Bank A", "Bank", "bA"), ("Comp C", "Company", "cC"), ("Someone", None, None)], "raw string, kind string, entity string")
    targets = spark.createDataFrame([("Bank", "bA"), ("Bank", "bB"), ("Company", "cD"), ("Bank", "cGone")], "kind string, node string")
    got = {(r.src_kind, r.src, r.dst_kind, r.dst): (r.pct, r.shares) for r in N.ownership_edges(holdings, resolved, targets, "seq").collect()}
    assert len(got) == 6 and got["Shareholder", "Someone", "Bank", "bB"] == (70.0, 5) and got["Bank", "bA", "Company", "cD"] == (1.5, 10)


def test_subsidiaries_have_weights(spark):
    rows = [("c1", "b1", "cash_in", "old", 1e7, 4e7, 1), ("c1", "b1", "cash_in", "new", 0.0, 1e7, 3), ("c1", "b1", "cash_out", "mid", 2e7, 1e7, 2), ("c1", "b1", "unknown", "mid", 9e7, 9e7, 2), ("c1", "b2", "cash_out", "x", 1e7, 5e7, 1), ("c1", "b2", "contingent", "y", 1.0, 3e7, 0)]
    tier1 = spark.createDataFrame([("b1", 20.0)], "bank string, tier1 double")
    got = {r.bank: tuple(r)[2:] for r in N.subsidiaries(spark.createDataFrame(rows, "company string, bank string, direction string, relation string, approved double, outstanding double, seq int"), tier1, "seq").collect()}
    assert got == {"b1": (4, "new", 5.0, 1.0, 0.0, 0.25, 0.5), "b2": (2, "x", 0.0, 5.0, 3.0, None, 1.0)}


def test_sector_nodes(spark):
    rows = spark.createDataFrame([("b1", "msme"), ("b2", "msme"), ("b1", "msme"), ("b1", "odd"), ("b1", None)], "bank string, category string")
    got = {r.category: (r.name, r.banks) for r in N.priority_sector_nodes(rows).collect()}
    assert len(got) == 10 and got["msme"] == ("MSME", 2) and got["housing"] == ("Housing", 0)


def test_lenders_without_an_entity_get_stand_ins(spark):
    loans = spark.createDataFrame([("c1", "Bank A", 60.0), ("c1", "Acme & Sons", 30.0), ("c1", "acme sons", 10.0), ("c1", "N/A", 99.0), ("c1", " nil ", 99.0), ("c1", None, 99.0), ("c2", "N/A", 1.0)], "borrower string, lender string, amount double")
    resolved = spark.createDataFrame([("Bank A", "Bank", "bA")], "raw string, kind string, entity string")
    edges, stubs = N.lender_edges(loans, resolved)
    assert sorted(map(tuple, edges.collect())) == [("Bank", "bA", "c1", 60.0, 0.6), ("Company", "LSTUB_acme_sons", "c1", 40.0, 0.4)]
    assert [tuple(r) for r in stubs.collect()] == [("LSTUB_acme_sons", "Acme & Sons")]


def test_party_stubs_number_within_their_bank(spark):
    rows = spark.createDataFrame([("A", "Zed", 1), ("A", "zed", 2), ("A", "Bob", 3), ("B", "Bob", 4), ("B", "Known", 5)], "bank string, raw string, seq int")
    got = N.party_stubs(rows, spark.createDataFrame([("Known", "Bank", "k")], "raw string, kind string, entity string"), "seq")
    assert sorted(map(tuple, got.collect())) == [("RPT_A_0001", "A", "Zed"), ("RPT_A_0002", "A", "Bob"), ("RPT_B_0001", "B", "Bob")]
    might = spark.createDataFrame([("Bob", 2, "bob co", "c2", 70.9), ("Bob", 1, "bobs", "c1", 86.0)], "raw string, rank int, known string, entity string, score double")
    told = N.party_stubs(rows, spark.createDataFrame([("Known", "Bank", "k")], "raw string, kind string, entity string"), "seq", might).collect()
    assert {r.cin: r.top_candidates for r in told} == {"RPT_A_0001": [], "RPT_A_0002": ["bobs:c1:86", "bob co:c2:70"], "RPT_B_0001": ["bobs:c1:86", "bob co:c2:70"]}


@pytest.mark.parametrize(("reply", "score", "reasoning"), [('```json\n{"stress_score": 0.71234, "reasoning": "bad"}\n```', 0.7123, "bad"), ('{"stress_score": 7}', 1.0, ""), ('{"stress_score": "x", "reasoning": "y"}', 0.5, "y"), ("sorry", 0.5, "Parse error"), (None, 0.5, "Parse error")])
def test_score_reply(spark, reply, score, reasoning):
    r = spark.createDataFrame([(reply,)], "r string").select(S.score_reply(F.col("r")).alias("x")).first().x
    assert (r.score, r.reasoning) == (score, reasoning)


def test_merged_category_of_known_ones(spark):
    rows = [("b", "c", "term loan", None, 5.0), ("b", "c", "xyz", None, 5.0), ("b", "d", "xyz", None, 1.0), ("b", "e", "term loan", None, 1.0), ("b", "e", "letter of credit", None, 1.0)]
    got = {r.company: (r.lgd_category, r.t_category) for r in E.lends_merged(spark.createDataFrame(rows, "bank string, company string, facility string, bucket string, amt double")).collect()}
    assert got == {"c": ("Secured", "TermLoan"), "d": ("Unknown", "Unknown"), "e": ("Mixed", "Mixed")}


@pytest.mark.parametrize(("a", "b", "veto"), [("tata steel", "tata steels", False), ("global securities", "sbi global securities", True), ("smc global", "smc global services", False), ("d global services holdings", "x global services holdings", True), ("rane", "brake", False), ("abc global services holdings", "abc global services holdings", True)])
def test_generic_words(spark, a, b, veto):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(M.too_generic(F.col("a"), F.col("b"))).first()[0] is veto


def test_candidates_of_unresolved_names(spark):
    banks = spark.createDataFrame([("b1", "First Bank")], "entity string, known string")
    companies = spark.createDataFrame([("c1", "Zeta Mills"), ("c2", "Zeta Motors Works"), ("c3", "Zeta"), ("c4", "Other")], "entity string, known string")
    names = spark.createDataFrame([("Zeta Mining Rare",), ("First Bank",)], "name string")
    out = M.candidates(M.resolve(names, "name", banks, companies), "name", companies, 2).collect()
    assert [(r["rank"], r.entity) for r in sorted(out, key=lambda r: r["rank"])][0] == (1, "c3") and len(out) == 2 and {r.name for r in out} == {"Zeta Mining Rare"}


def test_markdown_and_predicates(spark):
    assert S.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string"), "T") == "## T\n\n| k | v |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"
    r = spark.createDataFrame([("J&KBANK", None)], "a string, b string").select(B.is_ticker(F.col("a")), B.is_lender(F.col("b")), B.is_corporate(F.lit("Prince")), B.year_in(F.lit("no year"))).first()
    assert tuple(r) == (False, False, True, None)
