"""Comparing search requests with the items a store returned for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import text as X
from ..functions.scores import best_score
from ..functions.sql import case, let


def title_variants(nfkc: str, original: str) -> str:
    """As is, without decoration, without chapter markers (distinct, in this order)."""

    def build(bare: str) -> str:
        chapterless = X.strip_chapters(f"coalesce(nullif({bare}, ''), {nfkc})")
        return f"array_remove(array_distinct(array({original}, {bare}, {chapterless})), '')"

    return let(X.strip_decorations(nfkc), build)


def match_forms(nfkc: str, original: str) -> str:
    """Distinct comparison forms of a title's variants; the first one is the plain title."""
    return f"array_distinct(transform({title_variants(nfkc, original)}, t -> {X.match_form('t')}))"


def with_item_forms(items: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``title_nfkc`` and ``forms`` once per catalogue row."""
    return items.withColumn("title_nfkc", X.nfkc(F.coalesce(title, F.lit("")))).withColumn(
        "forms", F.expr(match_forms("title_nfkc", "title_nfkc"))
    )


def with_query_forms(requests: DataFrame, queries: str = "queries") -> DataFrame:
    """Adds ``query_forms``: (position, query, form) of every query variant."""
    normalized = requests.withColumn("_nfkc", X.nfkc_each(queries))
    return normalized.withColumn("query_forms", F.expr(_query_forms(queries))).drop("_nfkc")


def _query_forms(queries: str) -> str:
    return (
        f"flatten(transform(_nfkc, (q, i) -> transform({match_forms('q', 'q')},"
        f" f -> named_struct('pos', i, 'query', {queries}[i], 'form', f))))"
    )


def with_both_forms(hits: DataFrame, title: str = "title", queries: str = "queries") -> DataFrame:
    """``with_item_forms`` and ``with_query_forms`` in one crossing to Python, hence one worker a task."""
    normalized = hits.withColumns({"title_nfkc": X.nfkc(F.coalesce(title, F.lit(""))), "_nfkc": X.nfkc_each(queries)})
    return normalized.withColumns(
        {"forms": F.expr(match_forms("title_nfkc", "title_nfkc")), "query_forms": F.expr(_query_forms(queries))}
    ).drop("_nfkc")


def score_rows(
    rows: DataFrame, keys: list[str], payload: list[str], cfg: Config = DEFAULTS, scores: DataFrame | None = None, once: bool = False
) -> DataFrame:
    """Best score of every row over all (query form, title form) pairs.

    ``rows`` carries ``query_forms``, ``forms``, ``title_nfkc`` and ``chapter_hint``.
    A row has at most 2 queries x 3 forms x 3 title forms; all its pairs are scored where the row
    is, and rows of the same keys become one after that, unless it is known that each has its own
    (``once``).  Of equal scores the first pair wins; penalties push fallback
    queries back.  Where ``scores(a, b, score, method)`` of distinct forms are known already they
    are joined instead of computed again; pairs they lack are below their floor and count 0.
    """
    penalty = lambda pos: case(
        *[(f"{pos} = {i}", str(p)) for i, p in enumerate(cfg.variant_penalties[:-1])],
        default=str(cfg.variant_penalties[-1]),
    )
    if scores is None:
        forms = "transform(query_forms, q -> q.form)"
        penalties = f"transform(query_forms, q -> {penalty('q.pos')})"
        best = rows.withColumn("_found", best_score(F.expr(forms), F.expr(penalties), "forms")).select(
            *keys, *payload, "title_nfkc", "chapter_hint", F.expr("query_forms[0].query").alias("_first_query"),
            F.expr("named_struct('_adjusted', _found._adjusted, 'raw', _found.raw, 'method', _found.method, 'query', get(query_forms, _found.at).query)").alias("_best"),
            F.expr("coalesce(_found.at, 0)").alias("_at"),
        )
        if not once:
            others = ["title_nfkc", "chapter_hint", "_first_query", *payload]
            best = best.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in others], F.max_by("_best", F.struct("_best._adjusted", -F.col("_at"))).alias("_best"))
    else:
        pairs = rows.withColumn(
            "_pair",
            F.explode_outer(
                F.expr(
                    "flatten(transform(query_forms, (q, i) -> transform(forms, (f, j) ->"
                    " named_struct('qpos', q.pos, 'qtext', q.query, 'a', q.form, 'b', f, 'ord', i * 16 + j))))"
                )
            ),
        )
        flat = pairs.select(*keys, *payload, "title_nfkc", "chapter_hint", "query_forms", "_pair.*")
        scored = flat.join(scores, ["a", "b"], "left").fillna(0, ["score"]).fillna("none", ["method"])
        adjusted = scored.withColumn("_adjusted", F.expr(f"greatest(0, score - {penalty('qpos')})"))
        best = adjusted.groupBy(*keys).agg(
            F.any_value("title_nfkc").alias("title_nfkc"),
            F.any_value("chapter_hint").alias("chapter_hint"),
            F.any_value(F.expr("query_forms[0].query")).alias("_first_query"),
            *[F.any_value(c).alias(c) for c in payload],
            F.max_by(
                F.struct("_adjusted", F.col("score").alias("raw"), "method", F.col("qtext").alias("query")),
                F.struct("_adjusted", -F.col("ord")),
            ).alias("_best"),
        )
    hinted = (
        f"chapter_hint > 0 and _best._adjusted >= {cfg.possible} and"
        " rlike(title_nfkc, concat('(?:^|[^0-9])', chapter_hint, '(?:[^0-9]|$)'))"
    )
    nothing = "coalesce(_best._adjusted, 0) = 0"
    return best.withColumns(
        {
            "hint_applied": F.expr(f"coalesce({hinted}, false)"),
            "score": F.expr(
                f"if(coalesce({hinted}, false), least(100, _best._adjusted + {cfg.chapter_bonus}),"
                " coalesce(_best._adjusted, 0))"
            ),
            "raw_score": F.expr(f"if({nothing}, 0, _best.raw)"),
            "method": F.expr(f"if({nothing}, 'none', _best.method)"),
            "matched_query": F.expr(f"if({nothing}, coalesce(_first_query, ''), _best.query)"),
        }
    ).drop("_best", "_at", "_first_query", "title_nfkc", "chapter_hint")


def rank_candidates(hits: DataFrame, key: str = "request_id", cfg: Config = DEFAULTS) -> DataFrame:
    """Score and rank item lists: ``hits(key, pos, title, queries, chapter_hint)`` ->
    ``key, pos, title, score, method, matched_query, rank`` (score desc, pos asc)."""
    payload = [c for c in hits.columns if c not in (key, "pos", "queries", "chapter_hint")]
    prepared = with_both_forms(hits)
    scored = score_rows(prepared, [key, "pos"], payload, cfg)
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("pos"))
    return scored.withColumn("rank", F.row_number().over(order))


def grade(top: str, second: str, cfg: Config = DEFAULTS) -> str:
    """Kind of an answer from its two best scores."""
    tie = f"coalesce({second} >= {cfg.possible} and {top} - {second} < {cfg.tie_margin}, false)"
    return case(
        (f"{top} is null or {top} < {cfg.possible}", "'none'"),
        (f"{top} >= {cfg.high} and {tie}", "'high_with_alternatives'"),
        (f"{top} >= {cfg.high}", "'high'"),
        default="'possible'",
    )


def classify_ranked(ranked: DataFrame, key: str = "request_id", cfg: Config = DEFAULTS) -> DataFrame:
    """One row per key: kind, best item, shown candidates.  Only the first
    ``max_candidates`` ranks are looked at, so the lists stay tiny."""
    keep = max(2, cfg.max_candidates)
    top = ranked.where(F.col("rank") <= keep).withColumn(
        "_item", F.struct("rank", "pos", "title", "score", "method", "matched_query")
    )
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list("_item")).alias("_top"))
    kind = grade("get(_top, 0).score", "get(_top, 1).score", cfg)
    shown = f"filter(slice(_top, 1, {cfg.max_candidates}), x -> x.score >= {cfg.min_candidate})"
    return listed.withColumn("kind", F.expr(kind)).select(
        key,
        "kind",
        F.expr("if(kind = 'none', null, get(_top, 0))").alias("best"),
        F.expr(f"if(kind = 'high', slice(_top, 1, 1), {shown})").alias("candidates"),
    )
