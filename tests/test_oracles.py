"""Registered graph queries against their DuckDB SQL, on the smallest tables."""

import pytest
from compare import differences

from codeloom import registry

#: One or two of each family; the driver compares all of them.
NAMES = ["flt_06_resolve_symbol", "flt_11_explorer", "agg_02_site_counts", "agg_12_group_partition", "agg_16_class_lens", "win_01_site_dedup", "win_05_enclosing_symbol", "win_10_comment_run", "srt_01_search_rank", "set_04_map_equality", "set_08_overlap_override", "grf_01_reachable", "grf_02_shortest_path", "grf_09_tree", "cls_05_member_resolution", "cls_07_dispatch_callers", "qry_03_find_callers", "cov_02_coverage", "jon_01_bare_name", "jon_10_var_call", "jon_11_chain_call", "txt_12_label_offsets", "lnt_12_runner", "lnt_13_suppression_map", "src_02_classify_file", "src_05_catalog_table_ids", "src_06_plugin_commands", "src_11_components", "src_12_form_walk", "qry_19_semantic_tokens", "txt_04_tokens", "ext_02_call_sites", "str_03_batch_policy", "str_04_apply_batch"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], sf_dir) == []


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
