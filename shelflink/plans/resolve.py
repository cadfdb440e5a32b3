"""Pages + search answers -> one state per page.

Pages that search the same words get the same answer, so the work is done once per
distinct request (query list + chapter hint) and joined back: a title shared by a
third of all pages costs one search.  Once the rows are scored (a Python stage forgets
how its input was partitioned) they are hashed by ``request_id`` once; every window and
aggregation after that is partitioned by that column, so none of them shuffles again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import text as X
from ..functions import urls as U
from ..functions.scores import estimate_cny, match_label, resolve_rate
from ..functions.sql import Sql, case, let, quote
from ..operators import match as M
from ..operators.cache import cache_key
from ..operators.health import severity, step_health, verdict_of
from ..scale import release, stage
from .stores import planned_steps, stores

ITEM_FIELDS = [
    "product_id", "title", "url", "maker", "author", "category", "price", "price_text", "currency",
    "is_free", "original_price_text", "discount_label", "approx_cny", "image_url",
]

_ITEM_TYPES = {"price": "int", "approx_cny": "int", "is_free": "boolean"}


def request_id(queries: Sql, hint: Sql) -> Sql:
    return f"left(sha2(concat(array_join({queries}, '\\u0001'), '\\u0002', coalesce(cast({hint} as string), '')), 256), 32)"


def with_requests(pages: DataFrame) -> DataFrame:
    """Adds ``searched`` (does the page get a search?) and its ``request_id``."""
    searched = (
        "allowed and extraction.cleaned_title <> '' and extraction.confidence <> 'low' and size(queries) > 0"
    )
    key = request_id("queries", "extraction.chapter_hint")
    return pages.withColumn("searched", F.expr(searched)).withColumn(
        "request_id", F.expr(f"if(searched, {key}, null)")
    )


def distinct_requests(pages: DataFrame) -> DataFrame:
    """One row per request, with the comparison forms of its queries."""
    unique = (
        pages.where("searched")
        .select("request_id", "queries", F.col("extraction.chapter_hint").alias("chapter_hint"))
        .groupBy("request_id")
        .agg(F.first("queries").alias("queries"), F.first("chapter_hint").alias("chapter_hint"))
    )
    return M.with_query_forms(unique)


def _with_answers(
    requests: DataFrame,
    search_items: DataFrame,
    search_steps: DataFrame | None,
    cached: DataFrame | None,
    cfg: Config,
    only: Sql = "true",
    titles: DataFrame | None = None,
) -> DataFrame:
    """request x planned step x item rows; a step without items is one row.  ``only`` is a
    condition on the step.  Where ``titles`` has the titles and their forms, items name them by ``_i``
    and get them last, so that until then rows are numbers."""
    steps_asked = f"filter({planned_steps('queries', cfg)}, step -> {only})"
    plan = requests.withColumn("_step", F.explode(F.expr(steps_asked)))
    # a store is scored with the queries it was asked: all forms of the first ones
    own = (
        f"filter(query_forms, q -> q.pos < if(_step.store_rank = 0, size(queries), {cfg.searched_variants_other}))"
    )
    flat = plan.withColumn("query_forms", F.expr(own)).select("request_id", "queries", "chapter_hint", "query_forms", "_step.*")
    payload = [
        F.col(c) if c in search_items.columns else F.lit(None).cast(_ITEM_TYPES.get(c, "string")).alias(c)
        for c in ITEM_FIELDS
    ]
    formed = search_items if titles is not None or "forms" in search_items.columns else M.with_item_forms(search_items)
    items = formed.select(
        "store", "step_id", "query", "pos", *(["title_nfkc", "forms"] if titles is None else ["_i"]), F.struct(*payload).alias("item")
    )
    if search_steps is None:
        # a catalogue answers every step; nothing found is an explicit "not found"
        joined = flat.join(items, ["store", "step_id", "query"], "left").withColumns(
            {
                "http_status": F.lit(200),
                "ok": F.lit(True),
                "step_reason": F.expr("if(item is null, 'not-found', 'ok')"),
            }
        )
    else:
        steps = search_steps.select(
            "store", "step_id", "query", "http_status", "ok", F.col("reason").alias("step_reason")
        )
        joined = (
            flat.join(steps, ["store", "step_id", "query"], "left")
            .withColumns(
                {
                    "http_status": F.coalesce("http_status", F.lit(0)),
                    "ok": F.coalesce("ok", F.lit(False)),
                    "step_reason": F.coalesce("step_reason", F.lit("network-error")),
                }
            )
            .join(items, ["store", "step_id", "query"], "left")
        )
    if titles is not None:
        # rows without an item have no number: spread them instead of joining on null
        own = titles.select(F.col("_i").alias("_t"), F.col("title").alias("_title"), "title_nfkc", "forms").hint("merge")
        joined = joined.withColumn("_t", F.expr("coalesce(_i, -1 - pmod(xxhash64(request_id, step_ord), 1000000007))")).join(own, "_t", "left")
        joined = joined.withColumn("item", F.when(F.col("item").isNotNull(), F.col("item").withField("title", F.col("_title")))).drop("_i", "_t", "_title")
    if cached is None:
        return joined.withColumns({"from_cache": F.lit(False), "cache_entry_found": F.lit(False)})
    asked = f"slice(queries, 1, if(store_rank = 0, {cfg.searched_variants}, {cfg.searched_variants_other}))"
    entries = cached.groupBy("cache_key").agg(F.max("n_items").alias("_cached"))
    return (
        joined.withColumn("cache_key", F.expr(cache_key("store", asked)))
        .join(entries, "cache_key", "left")
        .withColumns(
            {
                "from_cache": F.expr(f"coalesce(_cached > 0, false) or ({str(cfg.serve_negative).lower()} and _cached is not null)"),
                "cache_entry_found": F.col("_cached").isNotNull(),
            }
        )
        .drop("cache_key", "_cached")
    )


def _executed(rows: DataFrame, cfg: Config) -> DataFrame:
    """Keep the rows of steps that are really taken.

    First-tier steps stop at a convincing hit, an age gate or a full list; the second
    tier only starts when the first found nothing usable.  "Stop" is a running maximum
    over the earlier steps, so it is a window with a frame that ends before the step.
    """
    store = ["request_id", "store"]
    before = Window.partitionBy(*store, "tier").orderBy("step_ord").rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*store)
    first_tier = rows.withColumn(
        "_new",
        F.when(
            F.col("item").isNotNull(),
            F.row_number().over(Window.partitionBy(*store, "tier", "item.product_id").orderBy("step_ord", "pos")),
        ),
    ).withColumns(
        {
            "_best": F.max("score").over(before),
            "_age": F.max(F.expr("cast(step_reason = 'age-check' as int)")).over(before),
            "_count": F.count(F.expr("if(_new = 1, 1, null)")).over(before),
        }
    )
    most = "cast(null as int)" if cfg.items_total is None else str(cfg.items_total)
    open_list = f"coalesce(_age, 0) = 0 and coalesce(coalesce(_count, 0) < {most}, true)"
    ran_first = first_tier.withColumn(
        "_ran1", F.expr(f"tier = 1 and coalesce(_best, 0) < {cfg.high} and {open_list}")
    ).withColumns(
        {
            "_best1": F.max(F.expr("if(_ran1, score, null)")).over(whole),
            "_age1": F.max(F.expr("cast(_ran1 and step_reason = 'age-check' as int)")).over(whole),
            "_count1": F.count(F.expr("if(_ran1 and _new = 1, 1, null)")).over(whole),
        }
    )
    ran = (
        f"_ran1 or (tier = 2 and coalesce(_age1, 0) = 0 and coalesce(_best1, 0) < {cfg.possible}"
        f" and coalesce(_best, 0) < {cfg.possible} and coalesce(_age, 0) = 0"
        f" and (coalesce(_count, 0) = 0 or coalesce(coalesce(_count, 0) + _count1 < {most}, true)))"
    )
    return ran_first.where(ran).drop("_new", "_best", "_age", "_count", "_ran1", "_best1", "_age1", "_count1")


#: What a round asks: the open requests' (store, step_id, query), answered by items and, where
#: known, scores of their forms and the titles that items name by ``_i``.
Search = Callable[[DataFrame], tuple[DataFrame, DataFrame | None] | tuple[DataFrame, None, DataFrame]]


def from_table(search_items: DataFrame, scores: DataFrame | None = None) -> Search:
    """Answers that are a table already: only the asked rows are read on."""
    formed = stage(search_items if "forms" in search_items.columns else M.with_item_forms(search_items))
    return lambda asked: (formed.join(asked, ["store", "step_id", "query"], "left_semi"), scores)


def from_numbers(found: DataFrame, titles: DataFrame) -> Search:
    """Answers that name their titles by ``_i``, unique by ``store, step_id, query, pos``; a round
    reads the rows of its own steps."""
    held = stage(found, by=("store", "step_id"))
    return lambda asked: (held.join(asked, ["store", "step_id", "query"], "left_semi"), None, titles)


def answer_requests(
    requests: DataFrame,
    search: DataFrame | Search,
    search_steps: DataFrame | None = None,
    cached: DataFrame | None = None,
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """One row per request: status, best match, candidates, per-store answers."""
    return page_level(by_request(staged_answers(requests, search, search_steps, cached, cfg)), cfg)


def by_request(per_store: DataFrame) -> DataFrame:
    """The answers of at most five stores as one list, in the order asked."""
    return per_store.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("store_rank", *STORE_FIELDS))).alias("stores"))


def staged_answers(
    requests: DataFrame,
    search: DataFrame | Search,
    search_steps: DataFrame | None = None,
    cached: DataFrame | None = None,
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """One row per request and store that was asked.  Stores are asked in order, one round each:
    a request whose answer is convincing leaves (``left_anti``), and a store's second tier starts
    only for requests whose first tier found nothing usable and met no age gate.  So no row is
    made, scored or ranked that the stop rules would throw away; the result is that of asking
    everything and cutting afterwards (``store_answers`` and its slice).

    Every round is a table, so a lost executor repeats one round at most, and the driver lets go
    of a round's plans, shuffles and broadcasts before the next one."""
    if not callable(search):
        search = from_table(search)
    open_ = stage(requests)
    answers: DataFrame | None = None
    for rank, store in enumerate(cfg.stores):
        rows = [_round(open_, search, search_steps, cached, cfg, store, 1)]
        if any(tier == 2 for _, tier in _tiers(store)):
            head = rows[0].groupBy("request_id").agg(F.max("score").alias("_best"), F.max(F.expr("step_reason = 'age-check'")).alias("_age"))
            needy = head.where(f"coalesce(_best, 0) < {cfg.possible} and not _age").select("request_id")
            rows.append(_round(open_.join(needy, "request_id", "left_semi"), search, search_steps, cached, cfg, store, 2))
        scored = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        answer = stage(_graded(scored.repartition("request_id"), cfg))
        answers = answer if answers is None else answers.unionByName(answer)
        release(open_.sparkSession)
        if rank + 1 < len(cfg.stores):
            open_ = stage(open_.join(answer.where("kind = 'high'").select("request_id"), "request_id", "left_anti"))
            if open_.isEmpty():
                break
    return answers


def _tiers(store: str) -> tuple[tuple[str, int], ...]:
    return next(s.steps for s in stores() if s.id == store)


def _round(open_, search: Search, search_steps, cached, cfg: Config, store: str, tier: int) -> DataFrame:
    """Scored rows of one store's steps of one tier."""
    only = f"step.store = {quote(store)} and step.tier = {tier}"
    asked = open_.select(F.explode(F.expr(f"filter({planned_steps('queries', cfg)}, step -> {only})")).alias("s")).select("s.store", "s.step_id", "s.query").distinct()
    items, scores, *titles = search(asked)
    steps = [step for step, number in _tiers(store) if number == tier]
    items = items.where((F.col("store") == store) & F.col("step_id").isin(steps))
    once = bool(titles) and search_steps is None
    rows = stage(_scored(_with_answers(open_, items, search_steps, cached, cfg, only, *titles), cfg, scores, once))
    release(open_.sparkSession)
    return rows


_PAYLOAD = ["store_rank", "tier", "step_id", "query", "http_status", "ok", "step_reason", "from_cache", "cache_entry_found", "item"]


def _scored(rows: DataFrame, cfg: Config, scores: DataFrame | None = None, once: bool = False) -> DataFrame:
    scored = M.score_rows(rows, ["request_id", "store", "step_ord", "pos"], _PAYLOAD, cfg, scores, once)
    return scored.withColumn("score", F.expr("if(item is null, null, score)"))


STORE_FIELDS = [
    "store", "kind", "health", "item_count", "requests", "errors", "needs_age_check", "from_cache",
    "cache_entry_found", "first_error", "query", "best", "candidates", "preview",
]


def store_answers(requests, search_items, search_steps=None, cached=None, cfg: Config = DEFAULTS) -> DataFrame:
    """One row per request and store, every store asked (no cross-store stop yet)."""
    rows = _with_answers(requests, search_items, search_steps, cached, cfg)
    return _graded(_scored(rows, cfg).repartition("request_id"), cfg)


def _graded(scored: DataFrame, cfg: Config) -> DataFrame:
    """One row per request and store from its scored rows, partitioned by request."""
    ran = _executed(scored, cfg)
    store = ["request_id", "store"]
    step_head = F.row_number().over(Window.partitionBy(*store, "step_ord").orderBy("pos"))
    fresh = F.row_number().over(Window.partitionBy(*store, "item.product_id").orderBy("step_ord", "pos"))
    step_items = F.count("item").over(Window.partitionBy(*store, "step_ord"))
    marked = ran.withColumns(
        {"_head": step_head == 1, "_fresh": F.col("item").isNotNull() & (fresh == 1), "_step_items": step_items}
    ).withColumn("_verdict", F.expr(step_health("http_status", "step_reason", "_step_items")))
    rank = F.row_number().over(
        Window.partitionBy(*store).orderBy(F.desc("_fresh"), F.desc("score"), F.asc("step_ord"), F.asc("pos"))
    )
    ranked = marked.withColumn("_rank", F.when(F.col("_fresh"), rank))
    keep = max(cfg.preview_size, cfg.max_candidates, 2)
    card = (
        "if(_rank <= {n}, named_struct('rank', _rank, 'score', score, 'store', store, 'item', item,"
        " 'raw_score', raw_score, 'method', method, 'matched_query', matched_query), null)"
    ).format(n=keep)
    head_and = lambda cond: F.count_if(F.expr(f"_head and not from_cache and {cond}"))
    rolled = ranked.groupBy("request_id", "store", "store_rank").agg(
        F.count_if("_fresh").cast("int").alias("item_count"),
        head_and("true").cast("int").alias("requests"),
        head_and("not ok").cast("int").alias("errors"),
        head_and("ok and _step_items = 0").alias("_not_found"),
        head_and("step_reason = 'age-check'").alias("_age"),
        head_and("_verdict not in ('no-result', 'healthy')").alias("_failures"),
        F.max(F.expr(f"if(_head and not from_cache, {severity('_verdict')}, null)")).alias("_worst"),
        F.max("from_cache").alias("from_cache"),
        F.max("cache_entry_found").alias("cache_entry_found"),
        F.min_by(F.expr("if(_head and not ok, step_reason, null)"), F.expr("if(_head and not ok, step_ord, null)")).alias("first_error"),
        F.min_by("query", "step_ord").alias("query"),
        F.array_sort(F.collect_list(F.expr(card))).alias("_top"),
    )
    grade = M.grade("get(_top, 0).score", "get(_top, 1).score", cfg)
    shown = f"filter(slice(_top, 1, {cfg.max_candidates}), x -> x.score >= {cfg.min_candidate})"
    graded = rolled.withColumn("_grade", F.expr(grade))
    kind = case(
        ("_age > 0 and item_count = 0", "'age_check'"),
        ("_grade = 'none' and requests > 0 and errors = requests and _not_found = 0", "'error'"),
        ("_grade in ('high', 'high_with_alternatives')", "'high'"),
        default="_grade",
    )
    health = case(
        ("from_cache and item_count > 0", "'healthy'"),
        ("from_cache", "'no-result'"),
        default=verdict_of("item_count", "_failures", "_worst"),
    )
    return graded.withColumns(
        {
            "kind": F.expr(kind),
            "health": F.expr(health),
            "needs_age_check": F.expr("_age > 0"),
            "first_error": F.expr("coalesce(first_error, '')"),
            "best": F.expr("if(_grade = 'none', null, get(_top, 0))"),
            "candidates": F.expr(f"case when _grade = 'none' then slice(_top, 1, 0) when _grade = 'high' then slice(_top, 1, 1) else {shown} end"),
            "preview": F.expr(f"slice(_top, 1, {cfg.preview_size})"),
        }
    ).select("request_id", "store_rank", *STORE_FIELDS)


def page_level(asked: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Status, overall best and page candidates from the at most five store answers."""
    by_score = "(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.o < b.o then -1 else 1 end"
    flat = "flatten(transform(stores, s -> s.{f}))"

    def ordered(field: str) -> str:
        indexed = f"transform({flat.format(f=field)}, (c, i) -> named_struct('score', c.score, 'o', i, 'c', c))"
        return f"transform(array_sort({indexed}, {by_score}), x -> x.c)"

    distinct = let(
        ordered("candidates"),
        lambda cs: f"filter({cs}, (c, i) -> array_position(transform({cs}, o -> concat(o.store, ':', o.item.product_id)),"
        f" concat(c.store, ':', c.item.product_id)) = i + 1)",
    )
    best = "transform(filter(stores, s -> s.best is not null), s -> s.best)"
    best = let(best, lambda bs: f"get(filter({bs}, b -> b.score = array_max(transform({bs}, o -> o.score))), 0)")
    out = asked.withColumn("match", F.expr(best)).withColumns(
        {
            "candidates": F.expr(f"if(match is null, slice({flat.format(f='candidates')}, 1, 0), slice({distinct}, 1, {cfg.max_candidates}))"),
            "preview": F.expr(f"slice({ordered('preview')}, 1, {cfg.preview_size})"),
            "requests": F.expr("aggregate(stores, 0, (n, s) -> n + s.requests)"),
            # what a repeat visit costs: only stores with items are served from the cache
            "repeat_requests": F.expr(
                "aggregate(stores, 0, (n, s) -> n + if(s.item_count > 0, 0, s.requests))"
                if not cfg.serve_negative
                else "aggregate(stores, 0, (n, s) -> n + if(s.item_count > 0 or s.health = 'no-result', 0, s.requests))"
            ),
            "from_cache": F.expr("size(stores) > 0 and forall(stores, s -> s.from_cache)"),
            "cache_entry_found": F.expr("exists(stores, s -> s.cache_entry_found)"),
            "needs_age_check": F.expr("exists(stores, s -> s.needs_age_check)"),
        }
    )
    status = case(
        (f"match.score >= {cfg.high}", "'ok_high'"),
        ("match is not null", "'ok_possible'"),
        ("size(stores) > 0 and forall(stores, s -> s.kind = 'error')", "'error'"),
        default="'no_result'",
    )
    return out.withColumn("status", F.expr(status))


def candidate_card(c: Sql, cfg: Config = DEFAULTS) -> Sql:
    """What is shown of a scored item; the store's own CNY price wins over the estimate."""
    labels = "map(" + ", ".join(f"{quote(s.id)}, {quote(s.label)}" for s in stores()) + ")"
    fields = ", ".join(f"'{f}', {c}.item.{f}" for f in ITEM_FIELDS if f != "approx_cny")
    estimate = f"coalesce({c}.item.approx_cny, {estimate_cny(f'{c}.item.price', str(resolve_rate(cfg)))})"
    return (
        f"named_struct('store', {c}.store, 'store_label', coalesce({labels}[{c}.store], {c}.store), {fields},"
        f" 'approx_cny', {estimate}, 'score', {c}.score, 'score_label', {match_label(f'{c}.score')},"
        f" 'matched_query', {c}.matched_query, 'method', {c}.method)"
    )


def search_links(cfg: Config = DEFAULTS) -> Sql:
    """Store links that found something, artist links (in front when nothing was
    found), then the stores without a result."""
    labels = "map(" + ", ".join(f"{quote(s.id)}, {quote(s.label)}" for s in stores()) + ")"
    link = f"named_struct('label', {labels}[s.store], 'url', {U.reader_search_url('s.store', 's.query')}, 'found', s.best is not null)"
    artist = f"named_struct('label', concat('Pixiv 作者: ', a), 'url', {U.artist_search_url('a')}, 'found', {{found}})"
    shown = "artists" if cfg.artist_fallback else "slice(artists, 1, 0)"

    def build(links: Sql) -> Sql:
        found = f"filter({links}, l -> l.found)"
        empty = f"filter({links}, l -> not l.found)"
        bold = f"transform(if(size({found}) = 0, {shown}, slice(artists, 1, 0)), a -> {artist.replace('{found}', 'true')})"
        plain = f"transform(if(size({found}) > 0, {shown}, slice(artists, 1, 0)), a -> {artist.replace('{found}', 'false')})"
        return f"concat({found}, {bold}, {empty}, {plain})"

    return let(f"transform(stores, s -> {link})", build)


def resolve(
    pages: DataFrame,
    search: DataFrame | Search,
    search_steps: DataFrame | None = None,
    cached: DataFrame | None = None,
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """Page states.  ``pages`` is the output of classify + work titles + queries;
    ``search`` is the stores' answers ``(store, step_id, query, pos, product...)`` or a function
    that searches what a round asks; captured responses come with ``search_steps``."""
    return page_answers(pages, answer_requests(distinct_requests(with_requests(pages)), search, search_steps, cached, cfg), cfg)


def page_answers(pages: DataFrame, answers: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The answers of the requests, back on their pages."""
    keyed = with_requests(pages)
    answered = answers.withColumnRenamed("status", "_status")
    # pages without a search have no request: spread them instead of joining on null
    spread_key = F.expr("coalesce(request_id, concat('none:', page_id))")
    joined = (
        keyed.withColumn("_key", spread_key)
        .join(answered.withColumnRenamed("request_id", "_key"), "_key", "left")
        .drop("_key")
    )
    status = case(
        ("not allowed or extraction.cleaned_title = '' or extraction.confidence = 'low'", "'unrecognized'"),
        default="coalesce(_status, 'no_result')",
    )
    why = case(
        ("not allowed", "reason"),
        ("status = 'unrecognized'", "'title-unrecognized'"),
        ("status = 'ok_high'", "'high'"),
        ("status = 'ok_possible'", "'possible'"),
        ("status = 'error'", "'search-failed'"),
        default="'no-match'",
    )
    return (
        joined.withColumn("status", F.expr(status))
        .withColumn("state_reason", F.expr(why))
        .withColumns(
            {
                "requests": F.expr("coalesce(requests, 0)"),
                "repeat_requests": F.expr("coalesce(repeat_requests, 0)"),
                "from_cache": F.expr("coalesce(from_cache, false)"),
                "cache_entry_found": F.expr("coalesce(cache_entry_found, false)"),
                "needs_age_check": F.expr("coalesce(needs_age_check, false)"),
                "match": F.expr(f"if(match is null, null, {candidate_card('match', cfg)})"),
                "candidates": F.expr(f"transform(candidates, c -> {candidate_card('c', cfg)})"),
                "search_links": F.expr(search_links(cfg)),
            }
        )
        .drop("_status")
    )
