"""Secret scan with corpus-wide ownership frequency, all in Spark's own functions.

Three base kinds are found by pattern in every whole text.  Beside them the scan collects
generic candidates (long runs that mix letters and digits).  Every candidate value is hashed
and counted over the corpus by distinct owners and repositories: a value that more than
``max_owners`` owners hold is a widely copied example, a value held by few is a live-looking
credential.  Live generic candidates outside base spans become spans of their own.

Offsets come from the pieces between matches: ``split`` and ``regexp_extract_all`` cut the text
at the same places, so running lengths give code-point positions without any Python.

Edge cases: null text is empty and has no span; null owner or repository count as one owner
without a name; repeated rows give equal rows; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stage
from .common import text_of

# The base kinds in their order, each with pattern, value group and least length of the value.
KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
GENERIC = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"


#: Matches whose places are summed up together; a text of n matches costs n times this at most.
RUN = 256
#: Code points of a text in which generic and base spans are compared with each other.
STRETCH = 4096


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sums(lengths: str) -> str:
    """Running sums of an array of lengths: runs first, so that appending stays short."""
    add = "(acc, x) -> named_struct('pos', acc.pos + x, 'out', concat(acc.out, array(acc.pos + x)))"
    runs = f"transform(sequence(0, (size({lengths}) - 1) div {RUN}), k -> slice({lengths}, k * {RUN} + 1, {RUN}))"
    totals = "transform(runs, r -> aggregate(r, 0, (a, x) -> a + x))"
    ends = f"aggregate({totals}, named_struct('pos', 0, 'out', cast(array() as array<int>)), {add}, acc -> acc.out)"
    inside = f"aggregate(r, named_struct('pos', if(k = 0, 0, ends[k - 1]), 'out', cast(array() as array<int>)), {add}, acc -> acc.out)"
    return _let(runs, "runs", _let(ends, "ends", f"flatten(transform(runs, (r, k) -> {inside}))"))


def _found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one kind in ``body``, in text order."""
    matches, values = (f"regexp_extract_all(body, r'{pattern}', {g})" for g in (0, group))
    lengths = _let(f"split(body, r'{pattern}', -1)", "p", "transform(m, (x, i) -> length(p[i]) + length(x))")
    spans = (
        f"filter(transform(m, (x, i) -> named_struct('start', e[i] - length(x), 'end', e[i], 'rank', {rank}, 'kind', '{kind}', 'value', v[i])),"
        f" s -> length(s.value) >= {least})"
    )
    placed = _let(lengths, "n", _let(_sums("n"), "e", _let(values, "v", spans)))
    return _let(matches, "m", f"if(size(m) = 0, cast(array() as array<{SPAN}>), {placed})")


def _untouched(generic: str, base: str) -> str:
    """The generic spans that overlap no base span, compared stretch by stretch of the text."""
    own = f"filter({generic}, x -> x.start div {STRETCH} = k)"
    near = f"filter({base}, b -> b.end > k * {STRETCH} and b.start < array_max(transform(own, x -> x.end)))"
    kept = _let(near, "near", "filter(own, x -> not exists(near, b -> b.start < x.end and x.start < b.end))")
    stretches = f"sequence(0, array_max(transform({generic}, x -> x.start)) div {STRETCH})"
    every = f"flatten(transform({stretches}, k -> {_let(own, 'own', f'if(size(own) = 0, own, {kept})')}))"
    return f"if(size({generic}) = 0 or size({base}) = 0, {generic}, {every})"


def find_spans(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """(doc_id, owner, repo, base, extra): base spans sorted by start and kind, and generic
    candidates that touch none of them."""
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repository is None else repository
    base = ", ".join(_found(kind, rank, *rest) for rank, (kind, *rest) in enumerate(KINDS))
    mixed = "length(translate(x.value, '0123456789', '')) <= length(x.value) - 4 and regexp_count(x.value, '[A-Za-z]') >= 4"
    return (
        docs.select("doc_id", F.col(owner).cast("string").alias("owner"), repo.alias("repo"), text_of().alias("body"))
        .withColumn("base", F.expr(f"array_sort(concat({base}))"))
        .withColumn("generic", F.expr(_found(GENERIC[0], len(KINDS), *GENERIC[1:])))
        .withColumn("generic", F.expr(f"filter(generic, x -> {mixed})"))
        .withColumn("extra", F.expr(_untouched("generic", "base")))
        .drop("body", "generic")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repos): in how many places each candidate value occurs.  Values
    are reduced to one row an owner and repository before they meet."""
    values = found.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode(F.concat("base", "extra")).alias("span"))
    return (
        values.select("owner", "repo", F.sha2("span.value", 256).alias("value_hash"))
        .distinct()
        .groupBy("value_hash")
        .agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    )


def _listed(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)))")


def scan_secrets(docs: DataFrame, max_owners: int = 2, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """One row a document: ``base`` spans, ``spans`` (base and the live generic ones), each
    with its class (``live`` or ``example``) and the number of owners and repositories."""
    found = stage(find_spans(docs, owner, repository).withColumn("row_key", F.sha2(F.to_json(F.struct("doc_id", "owner", "repo", "base", "extra")), 256)))
    frequency = stage(ownership(found))
    some = (F.size("base") > 0) | (F.size("extra") > 0)
    span = F.struct(*[f"span.{c}" for c in ("start", "end", "rank", "kind", "value")], (F.when(F.col("owners") > max_owners, "example").otherwise("live")).alias("class"), "owners", "repos")
    each = found.where(some).dropDuplicates(["row_key"]).select("row_key", F.explode(F.concat("base", "extra")).alias("span"))
    judged = (
        each.withColumn("value_hash", F.sha2("span.value", 256))
        .join(frequency, "value_hash")
        .select("row_key", span.alias("s"))
        .where(f"s.rank < {len(KINDS)} or s.class = 'live'")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )
    listed = found.where(some).join(judged, "row_key", "left").drop("row_key", "extra")
    nothing = found.where(~some).drop("row_key", "extra").withColumn("spans", F.expr("cast(array() as array<struct<start:int,end:int,rank:int,kind:string,value:string,class:string,owners:bigint,repos:bigint>>)"))
    return listed.withColumn("spans", F.coalesce("spans", F.array())).unionByName(nothing)


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as counts, a digest of the base spans and all spans as text."""
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    classed = lambda name: F.expr(f"cast(size(filter(spans, x -> x.class = '{name}')) as bigint)").alias(f"n_{name}")
    return scanned.select(
        "doc_id", *[count(k[0]) for k in KINDS], F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"), classed("live"), classed("example"),
    )
