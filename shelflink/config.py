"""Every tunable of the engine in one immutable object, passed to operators as literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # matching
    high: int = 85
    possible: int = 62
    min_candidate: int = 50
    tie_margin: int = 6
    max_candidates: int = 3
    chapter_bonus: int = 5
    variant_penalties: tuple[int, ...] = (0, 5, 10)
    preview_size: int = 5
    # cache
    hit_ttl_s: int = 30 * 60
    miss_ttl_s: int = 5 * 60
    # capacities of a personal log; unset: everything is kept
    cache_entries: int | None = None
    serve_negative: bool = False
    # search
    min_query_length: int = 3
    max_queries: int = 3
    searched_variants: int = 2
    searched_variants_other: int = 1
    # page sizes of an answer; unset: a step returns every item that answers the query
    items_per_step: int | None = None
    items_total: int | None = None
    search_match_percent: int = 70
    stores: tuple[str, ...] = ("dlsite", "fanza", "melonbooks", "pixiv", "fantia")
    # page reading
    # longest part of a page's text that is looked at; unset: all of it
    text_sample: int | None = None
    settle_quiet_ms: int = 400
    settle_deadline_ms: int = 5000
    # a tab without an event for so long is closed: streams forget its address and content
    tab_lifetime_s: int = 24 * 60 * 60
    # switches
    artist_fallback: bool = True
    ignore_site_filter: bool = False
    # price estimate
    jpy_to_cny: float = 0.044
    min_rate: float = 0.001
    max_rate: float = 1.0
    cny_per_jpy: float | str | None = None
    # quality log
    max_captures: int | None = None
    max_observations: int = 6
    budget_work_page: int = 8
    budget_other_page: int = 0
    max_structures: int | None = None
    max_analyses: int = 4
    similar_from: float = 0.85

    def with_overrides(self, *layers: dict | None) -> "Config":
        """Defaults, then each layer on top (stored settings, then a patch); unknown
        names and nulls are ignored so an old settings file cannot break a job."""
        known = {f.name for f in fields(self)}
        out = self
        for layer in layers:
            out = replace(
                out, **{k: v for k, v in (layer or {}).items() if k in known and v is not None}
            )
        return out


DEFAULTS = Config()
