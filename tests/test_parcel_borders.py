"""Borders of parcels in the contiguous plans: joined by equal places; study areas of the largest tables are planned."""

import re

from urbanloom.operators import allocation
from urbanloom.plans import area_queries

SF = "/root/testdata/sf0.001"


def test_borders_do_not_pair_all_parcels_of_a_brand(spark):
    plan = area_queries.contiguous_allocation(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"\bJoin\b", line)]
    assert joins and not any(re.search(r"\bOR\b|[<>]", line) for line in joins)


def test_a_brand_of_the_largest_tables_is_one_plan():
    # 360 times sf0.1: 7,200,000 parts of 25 brands.
    assert allocation.PARCELS >= 7_200_000 // 25
