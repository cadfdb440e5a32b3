"""The driver tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..operators.classify import classify_pages
from ..operators.clean import effective_queries, work_titles
from ..operators.extract import extract_pages
from ..scale import release, spread, stage
from ..operators.match import match_forms, with_item_forms
from ..operators.search import answers, search_similar, search_titles
from .resolve import Search, by_request, distinct_requests, from_numbers, from_table, page_answers, page_level, staged_answers, with_requests

# Every page of the generated data is treated as a work page, as the engine's own
# switch for that allows; guards before it (host, address, root) still apply.
FORCED = DEFAULTS.with_overrides({"ignore_site_filter": True})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant (the files carry UTC wall-clock times), so no
    result depends on the session's time zone."""
    instant = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"
    return table(spark, sf_dir, "events").withColumn("ts", F.expr(instant))


_shared: dict[tuple, DataFrame] = {}


def shared(build):
    """Build a staged table once per session and input; ``forget()`` drops them."""

    def run(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        args += (build.__defaults__ or ())[len(args) :]
        key = (spark.sparkContext.applicationId, build.__name__, sf_dir, args)
        if key not in _shared:
            _shared[key] = stage(build(spark, sf_dir, *args))
            release(spark)
        return _shared[key]

    return run


def forget() -> None:
    _shared.clear()


#: Pages of one task; reading one page costs some milliseconds.
PAGE_ROWS = 500


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages dealt over tasks: a file packs so many that its scan is one or two of them."""
    return spread(table(spark, sf_dir, "pages"), rows_per_task=PAGE_ROWS)


@shared
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page-summary table: read by everything after it, so it is written once."""
    return extract_pages(pages(spark, sf_dir))


@shared
def work_pages(spark: SparkSession, sf_dir: str, cfg: Config = FORCED) -> DataFrame:
    titled = work_titles(classify_pages(page_info(spark, sf_dir), cfg), cfg)
    return effective_queries(titled, cfg).drop("text_sample", "info_text", "headings", "body_length")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as store items: the headline is the title, the source picks the store
    and the section, the length is the price."""
    source = F.expr("cast(substr(source, 4) as int)")
    steps = (
        "case pmod(s, 5) when 0 then if(s < 10, 'primary', 'female') when 3 then if(s < 10, 'tag', 'title-caption')"
        " else 'search' end"
    )
    return (
        table(spark, sf_dir, "documents")
        .withColumn("s", source)
        .select(
            F.col("doc_id").alias("item_id"),
            F.expr("element_at(array('dlsite', 'fanza', 'melonbooks', 'pixiv', 'fantia'), pmod(s, 5) + 1)").alias("store"),
            F.expr(steps).alias("step_id"),
            F.col("doc_id").alias("pos"),
            F.expr("concat('D', doc_id)").alias("product_id"),
            F.expr("trim(split(text, '\n')[0])").alias("title"),
            F.expr("cast(n_chars as int)").alias("price"),
            F.lit("JPY").alias("currency"),
        )
        .where("title <> ''")
    )


def keyword_search(requests: DataFrame, items: DataFrame, cfg: Config = DEFAULTS) -> Search:
    """A catalogue as the stores' search engine: a step returns the items of its section that
    share enough words with the query (``search_match_percent``).  Forms are made once a title,
    not once an answer that holds it."""
    own = stage(items)
    hits = search_titles(requests.select(F.explode("queries").alias("query")), own, cfg)
    titles = stage(hits.titles.select("_i", "title", F.col("nfkc").alias("title_nfkc"), F.expr(match_forms("nfkc", "nfkc")).alias("forms")))
    found = answers(hits, cfg).join(own.drop("store", "step_id", "pos", "title").hint("merge"), "item_id")
    return from_numbers(found, titles)


def similarity_search(requests: DataFrame, items: DataFrame, cfg: Config = DEFAULTS) -> Search:
    """A catalogue searched by the score itself: a step returns every item of its section with a
    title that could be a candidate (score ``min_candidate`` or more), whatever words it shares.
    Forms are compared once for all stores; the rounds read on what they ask."""
    formed = stage(with_item_forms(items))
    found, scores = search_similar(requests.select(F.explode("queries").alias("query")), formed, cfg.min_candidate)
    return from_table(found.join(formed.drop("pos"), ["item_id", "store", "step_id"]), scores)


@shared
def answered(spark: SparkSession, sf_dir: str, cfg: Config = FORCED) -> DataFrame:
    """One row per request and store asked."""
    requests = stage(distinct_requests(with_requests(work_pages(spark, sf_dir, cfg))))
    return staged_answers(requests, keyword_search(requests, catalogue(spark, sf_dir), cfg), cfg=cfg)


@shared
def page_states(spark: SparkSession, sf_dir: str, cfg: Config = FORCED) -> DataFrame:
    return page_answers(work_pages(spark, sf_dir, cfg), page_level(by_request(answered(spark, sf_dir, cfg)), cfg), cfg)
