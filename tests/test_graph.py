"""Graph queries against their DuckDB twins on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans.catalog import QUERIES, SQL

D = "/root/testdata/sf0.001"
#: One query of every operator family; the driver compares all of them.
PICKED = """or_precedence or_chain contains_wildcard prop_json_true hop_in multi_hop_cycle optional_match unwind_list not_exists_or count_varpath order_nulls_first paging_offset default_limit varpath_zero
bfs_paths_in trace_with_risk risk_summary impact_callers call_path_shortest pagerank_seeded pagerank_file_max node_degree_both degree_union_types ranked_headings trigram_index layers code_search_lines snippets
scalar_functions call_resolution_tiers import_resolution heritage_edges typeof_merge route_match_best route_heuristic test_by_name parse_anomalies folder_edges cochange_pairs edge_upsert_last_wins
supersede_edges delete_cascade catalog_hash classify_changes stale_files gc_expired project_upsert trace_ingest_json debounce_sessions""".split()


def rows(names, data):
    clean = lambda v: round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return sorted((tuple(clean(r[n]) for n in names) for r in data), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f[:-8]} as from '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_twin(spark, duck, name):
    mine, twin = QUERIES[name](spark, D), duck.sql(SQL[name])
    names = sorted(mine.columns)
    assert names == sorted(twin.columns)
    assert rows(names, mine.collect()) == rows(names, [dict(zip(twin.columns, r)) for r in twin.fetchall()])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
