"""What rounds of graph searches send to all tasks, and how many tasks small files become."""

import re

import __spark_entry__ as entry
from auralake.operators.rounds import dealt

FOLDER = "/root/testdata/sf0.001"


def _plans(spark, name):
    """The physical plans of all that a query runs."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    entry.queries()[name](spark, FOLDER).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(before, 1000)
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]


def test_searches_send_no_table_to_all_tasks(spark):
    plans = _plans(spark, "greedy_actions")
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_places_look_once_for_their_nearest_node(spark):
    """Points of one place are looked up together: the search is not by point."""
    searches = [p for p in _plans(spark, "distance_to_prediction") if "min(struct" in p]
    assert searches and not any(re.search(r"keys=\[[^\]]*c_custkey", p, re.I) or re.search(r"Keys \[\d+\]: \[[^\]]*c_custkey", p) for p in searches)


def test_small_files_become_as_many_tasks_as_their_rows_ask_for(spark):
    assert dealt(spark.range(0, 10_001, 1, 1), 1000, "id").rdd.getNumPartitions() == 11


def test_images_are_dealt_by_their_rows(spark):
    plan = entry.queries()["depth_map"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # by vec_id: images stay whole and no later shuffle joins tasks again
