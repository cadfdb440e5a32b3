"""Queries over a pages table whose one file would be one task."""

import pytest
from pyspark.sql import functions as F

from shelflink.operators import clean
from shelflink.plans import queries as Q
from shelflink.plans import tables as T

PAGES = 3 * 500 - 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    html = (
        "concat('<html><head><title>Work ', id % 7, ' 第', id % 30, '話 | Example</title></head><body><article>',"
        " case id % 6 when 0 then '<p>Tags: a Artist： b' when 1 then '<p>ARTISTS : a 12 Pages' when 2 then '<p>原作: x サークル： y'"
        " when 3 then '<p>24 ページ pages 3' when 4 then '<p>Parodies  :x pages:7' else '' end, '</article></body></html>')"
    )
    pages = spark.range(0, PAGES, 1, 1).select(F.col("id").alias("page_id"), F.expr("concat('http://a.example.net/x/', id)").alias("url"), F.expr(html).alias("html"))
    pages.write.parquet(f"{folder}/pages.parquet")
    yield folder
    T.forget()


def test_titles_are_cleaned_in_tasks_of_a_few_hundred_pages(spark, folder):
    found = Q.clean_titles(spark, folder)
    assert found.rdd.getNumPartitions() == 3
    whole = clean.clean_titles(T.page_info(spark, folder).select("page_id", "host", F.col("title").alias("raw")))
    assert {(r.page_id, r.cleaned, r.confidence) for r in found.collect()} == {(r.page_id, r.clean.cleaned, r.clean.confidence) for r in whole.collect()}
    assert found.count() == PAGES


def test_titles_are_cleaned_without_the_rest_of_the_summary(spark, folder):
    plan = Q.clean_titles(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_ld" not in plan and "<article" not in plan and "ld+json" not in plan


def test_pages_are_summarised_in_tasks_of_a_few_hundred_pages(spark, folder):
    T.forget()
    assert len(T.page_info(spark, folder).inputFiles()) == 3
    assert sum(r.pages for r in Q.page_reasons(spark, folder).collect()) == PAGES
