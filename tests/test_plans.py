"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regimecast.operators import clean, features, normalise
from tests.conftest import SMALL

# Queries whose work is keyed: no step may gather all rows in one partition.
KEYED = [
    "map4_circular_step", "map6_z_score", "cln1_linear_fill", "cln5_outlier_repair", "val6_report", "agg2_describe",
    "win1_lag_features", "win2_rolling", "win7_transition_regions", "win9_equal_count_bins", "jon2_align_models",
    "tif1_regime_uncertainty_summary", "unc4_temporal_patterns", "unc6_weights", "int1_enhanced", "int7_calibrate_gamma",
    "met15_comprehensive", "iev3_calibration", "eva2_ljung_box", "tst3_wilcoxon", "tst4_friedman",
]
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "AggregateInPandas")
TRAINED = ("snk", "src3", "exp", "mdl2_tree", "mdl7", "mdl8", "mdl9", "ens4", "clu12_dual_fit", "clu5", "clu8_objective")
LAZY = [n for n in entry.oracle_sql() if not n.startswith(TRAINED) and not re.match(r"op\d+_|pipeline", n)]


def plan(df, mode="executedPlan"):
    return getattr(df._jdf.queryExecution(), mode)().toString()


@pytest.mark.parametrize("name", KEYED)
def test_no_single_partition_exchange(spark, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, SMALL))


def test_no_python_in_checked_queries(spark):
    for name in LAZY:
        text = plan(entry.queries()[name](spark, SMALL))
        assert not any(node in text for node in PYTHON_NODES), name


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    """The JVM never optimises a method above 8000 bytes of bytecode."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in KEYED + ["clu6_soft_memberships", "ent5_side_by_side", "unc3_composites", "dt7_cyclical"]:
            df = entry.queries()[name](spark, SMALL)
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scoped_scan_pushes_filters_and_prunes_columns(spark):
    text = plan(entry.queries()["src2_scoped_scan"](spark, SMALL))
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts" in pushed and "IsNotNull(event_type)" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


def test_partition_folders_are_pruned(spark, views, tmp_path):
    from regimecast.sources import tables

    path = str(tmp_path / "zone")
    source = views.table("events").select("event_id", "ts", "value", "event_type")
    tables.write_raw_zone(source, path, ["event_type"])
    text = plan(tables.read_raw_zone(spark, path, source.schema).where("event_type = 'view'"))
    assert "PartitionFilters: [isnotnull(event_type" in text


def test_all_table_features_share_one_sort(views):
    df = features.add_table_features(views.hourly_type, ["event_type"], "ts", "y")
    text = plan(df)
    assert len(re.findall(r"\bSort \[", text)) == 1 and len(re.findall(r"\bWindow \[", text)) == 1


def test_fill_uses_one_exchange_on_the_series(views):
    text = plan(clean.fill(views.hourly_gappy, ["event_type"], ["ts"], "y"))
    assert len(re.findall(r"Exchange hashpartitioning\(event_type#\d+, \d+\)", text)) == 1


def test_parameter_join_reuses_the_upstream_exchange(views):
    keys = ["user_id"]
    df = normalise.apply(views.hourly_user, normalise.fit(views.hourly_user, keys, "y"), keys, "y")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_parameter_join_is_not_forced_to_broadcast(spark, views):
    keys = ["user_id"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = normalise.apply(views.hourly_user, normalise.fit(views.hourly_user, keys, "y"), keys, "y")
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_last_rows_limits_groups_before_the_exchange(views):
    from regimecast.operators.ordering import last_rows

    text = plan(last_rows(views.table("events"), ["event_type"], "ts", 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_forest_scoring_stays_in_the_jvm(spark, views):
    from regimecast.operators.forest import vanilla_forest

    rows = features.add_lags(views.hourly_type, ["event_type"], ["ts"], "y", [1, 2]).withColumn("target", F.col("y"))
    scored = vanilla_forest(rows, rows, ["lag_1", "lag_2"], trees=3, depth=3)
    assert not any(node in plan(scored) for node in PYTHON_NODES)
