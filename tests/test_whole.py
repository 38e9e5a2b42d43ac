"""Queries over whole tables reach every row, and every hundredth id as a query."""

import pytest
from pyspark.sql import functions as F

from vecspark.plans import queries as core


@pytest.mark.parametrize("name, column", [("hnsw_layer0_candidates", "src"), ("hnsw_edges_symmetric", "dst"), ("batch_insert_ok", "id"), ("upsert", "id"), ("ivf_assign", "id"), ("single_inserts", "id")])
def test_every_row_is_reached(spark, sf_dir, name, column):
    rows = core.vectors(spark, sf_dir)
    assert core.QUERIES[name](spark, sf_dir).select(column).distinct().count() == rows.count()


@pytest.mark.parametrize("name", ["knn_batch", "knn_batch_cosine", "ivf_search_np1", "ivf_search_trained", "hnsw_search", "ivf_parts"])
def test_queries_grow_with_the_table(spark, sf_dir, name):
    want = {r.id for r in core.vectors(spark, sf_dir).where("id % 100 = 0").collect()}
    assert {r.query_id for r in core.QUERIES[name](spark, sf_dir).select("query_id").collect()} == want


def test_trained_lists_reach_recall(spark, sf_dir):
    assert core.QUERIES["recall_ivf_trained"](spark, sf_dir).agg(F.avg("recall")).first()[0] >= 0.9


def test_seeds_are_rows_and_do_not_depend_on_partitions(spark, sf_dir):
    rows = core.vectors(spark, sf_dir)
    a, b = (core.kmeans.seed_table(r, 8, core.L2, 42) for r in (rows, rows.repartition(7)))
    known = {tuple(r.vector) for r in rows.collect()}
    assert (a == b).all() and len({tuple(x) for x in a}) == 8 and all(tuple(x) in known for x in a)
