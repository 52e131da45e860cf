"""Queries that make a page of each row: rows are dealt to all cores, and a
page is made once."""

import pytest

from webrec.plans import all_queries
from webrec.plans.inputs import view

QUERIES = all_queries()


@pytest.mark.parametrize("name", ["company_pages", "business_pages", "phone_texts", "hours_forms", "companies"])
def test_views_are_spread(name, spark, sf_dir):
    assert view(spark, sf_dir, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["html_serp_items", "html_listing_cards", "extract_phones_by_region", "extract_inline_prices", "extract_price_struct"])
def test_queries_are_spread(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_best_phone_makes_its_page_once(spark, sf_dir):
    plan = QUERIES["best_phone"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Opening hours") == 1
