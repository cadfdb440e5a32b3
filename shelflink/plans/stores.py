"""The store dimension: search order, search plan, and who parses a response."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS, Config
from ..functions.sql import Sql, quote


@dataclass(frozen=True)
class Store:
    """A store: its steps are (step id, tier); ``parse`` is a pair of SQL-text functions,
    body -> array of items and (body, number of items) -> reason."""

    id: str
    label: str
    steps: tuple[tuple[str, int], ...]
    parse: tuple[Callable[[Sql, int], Sql], Callable[[Sql, Sql], Sql]] | None = None
    age_check_url: str = ""
    empty_note: str = ""


# Labels, steps and tiers, in search order.
_REGISTRY: dict[str, Store] = {
    s.id: s
    for s in (
        Store("dlsite", "DLsite", (("primary", 1), ("female", 2))),
        Store(
            "fanza",
            "FANZA",
            (("search", 1),),
            age_check_url="https://www.dmm.co.jp/age_check/=/?rurl=https%3A%2F%2Fwww.dmm.co.jp%2Fdc%2Fdoujin%2F",
        ),
        Store("melonbooks", "Melonbooks", (("search", 1),)),
        Store("pixiv", "Pixiv", (("tag", 1), ("title-caption", 2))),
        Store("fantia", "Fantia", (("search", 1),), age_check_url="https://fantia.jp/age_check"),
    )
}


def register(store: Store) -> None:
    """Add or replace a store; name it in ``Config.stores`` to have it searched."""
    _REGISTRY[store.id] = store


def store(store_id: str) -> Store:
    return _REGISTRY[store_id]


def stores() -> list[Store]:
    return list(_REGISTRY.values())


def search_plan(spark: SparkSession, cfg: Config = DEFAULTS) -> DataFrame:
    rows = [
        (s, rank, step, number, tier)
        for rank, s in enumerate(cfg.stores)
        for number, (step, tier) in enumerate(_REGISTRY[s].steps)
    ]
    return spark.createDataFrame(
        rows, "store string, store_rank int, step_id string, step_no int, tier int"
    )


def planned_steps(queries: Sql, cfg: Config = DEFAULTS) -> Sql:
    """Array of the steps one request may take, in order: per store the first-tier step
    of every query, then the second-tier steps of the first query.  The primary store
    is asked every query, the others only the first."""
    steps = []
    for rank, s in enumerate(cfg.stores):
        limit = cfg.searched_variants if rank == 0 else cfg.searched_variants_other
        for number, (step, tier) in enumerate(_REGISTRY[s].steps):
            last = max(1, limit) if tier == 1 else 1
            steps.append(
                f"transform(slice({queries}, 1, {last}), (q, i) -> named_struct('store', {quote(s)},"
                f" 'store_rank', {rank}, 'step_id', {quote(step)}, 'tier', {tier},"
                f" 'step_ord', {tier * 1000 + number} + i * 100, 'query', q))"
            )
    return f"concat({', '.join(steps)})"
