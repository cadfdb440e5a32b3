"""Quality rules as a short-circuit cascade, all in Spark's own functions.

Each rule is a measure with bounds.  On a bounded sample the cost (seconds a row) and the
selectivity (share of rows it rejects) of every rule are measured; rules then run in order of
rejection per cost, and a document that one rule rejects is spared the rest.  The order
changes the work, never the verdict: a document is kept when it breaks no rule.

The sample is the ``SAMPLE_ROWS`` distinct (doc_id, text) rows with the smallest hashes of the
whole table, so it does not depend on how the table is sorted.  Only hashes travel to find the
border, one number reaches the driver, and the chosen texts are measured on the executors.

Words and lines are cut once a row; every measure and rule reads the same arrays.

Edge cases: null text has no words; empty text fails the length rule; ties, repeated rows and
extra columns do not matter, since every row is judged alone (repeated rows are sampled once); a
very long text is one row whose arrays hold its words and lines, in steps of n log n; an empty
table gives an empty result, and rules stay in the order given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, text_of

SAMPLE_ROWS = 2000

WORDS = f"regexp_extract_all(body, r'{WORD}', 0)"
WORD_CHARS = f"cast(length(regexp_replace(body, r'{BLANK}+', '')) as bigint)"
N_SYMBOLS = "cast(length(body) - length(translate(body, '#*$%&|<>', '')) as bigint)"
EVERY_LINE = r"split(body, '\n', -1)"
LINES = f"filter(every_line, x -> rlike(x, r'{WORD}'))"
N_DUP_LINES = "cast(size(lines) - size(array_distinct(lines)) as bigint)"


def _repeat_words(words: str) -> str:
    """Words inside three-word windows that occur twice or more, in n log n steps.

    A window's hash and its position share one number (as many low bits as the row's positions
    need), so sorting numbers brings equal windows together; what hashes alike is compared
    again word for word before it counts."""
    bits = "length(bin(size(w)))"
    packed = (
        f"transform(sequence(0, size(w) - 3), i -> shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), {bits} + 1), {bits}) | cast(i as bigint))"
    )
    head = f"shiftright(p[i], {bits})"
    alike = (
        f"filter(transform(p, (x, i) -> if((i > 0 and shiftright(p[i - 1], {bits}) = {head})"
        f" or (i + 1 < size(p) and shiftright(p[i + 1], {bits}) = {head}),"
        f" cast(x - shiftleft(shiftright(x, {bits}), {bits}) as int), -1)), x -> x >= 0)"
    )
    # exact check of the few windows whose hashes agree: sorted by their words, neighbours compared
    named = "sort_array(transform(a, i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as t, i as i)))"
    same = (
        "filter(transform(s, (x, i) -> if((i > 0 and s[i - 1].t = x.t) or (i + 1 < size(s) and s[i + 1].t = x.t), x.i, -1)), x -> x >= 0)"
    )
    covered = "cast(size(array_distinct(concat(d, transform(d, x -> x + 1), transform(d, x -> x + 2)))) as bigint)"
    return (
        f"aggregate(array({words}), 0L, (z, w) -> if(size(w) < 4, 0L, element_at(transform(array(sort_array({packed})),"
        f" p -> element_at(transform(array({alike}), a -> if(size(a) = 0, 0L, element_at(transform(array({named}),"
        f" s -> element_at(transform(array({same}), d -> {covered}), 1)), 1))), 1)), 1)))"
    )


N_REPEAT_WORDS = _repeat_words("words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over ``body`` (the text, never null), its ``words``, ``every_line``, the
    ``lines`` with a word, and measures already in the row."""

    name: str
    rejects: str


def base_rules(words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    return [
        Rule("too_short", f"n_words < {words}"),
        Rule("repeats", f"100 * n_repeat_words > {repeat_percent} * n_words"),
    ]


def default_rules() -> list[Rule]:
    """The method's own rules; bounds are wide, so that ordinary prose in any script passes."""
    return [
        Rule("symbols", "10 * n_symbols > 3 * n_words"),
        Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
        Rule("duplicate_lines", "10 * n_dup_lines > 5 * size(lines)"),
        Rule("shouting", "length(regexp_replace(body, r'[^\\p{Lu}]+', '')) * 10 > 6 * length(regexp_replace(body, r'[^\\p{L}]+', ''))"),
        Rule("bullets", r"size(filter(every_line, x -> rlike(x, r'^[\x20\x09-\x0D]*[-*•]'))) * 10 > 9 * size(every_line)"),
        Rule("ellipsis", r"size(filter(every_line, x -> rlike(x, r'(\.\.\.|…)[\x20\x09-\x0D]*\z'))) * 10 > 3 * size(every_line)"),
        Rule("letters", rf"regexp_count(body, r'[^\x20\x09-\x0D]*\p{{L}}[^\x20\x09-\x0D]*') * 10 < 6 * n_words"),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, ``body``, its words and lines, and the base measures of every whole text."""
    cut = docs.select("doc_id", text_of().alias("body")).selectExpr("doc_id", "body", f"{WORDS} as words", f"{EVERY_LINE} as every_line")
    return cut.selectExpr("*", f"{LINES} as lines").selectExpr(
        "*", "cast(size(words) as bigint) as n_words", f"{WORD_CHARS} as word_chars", f"{N_SYMBOLS} as n_symbols",
        f"{N_DUP_LINES} as n_dup_lines", f"{N_REPEAT_WORDS} as n_repeat_words",
    )


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text) of the ``rows`` distinct rows with the smallest hashes, over the whole table."""
    hashed = docs.select("doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text"))
    border = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    chosen = hashed.where(F.col("h") <= F.lit(border).cast("long"))
    return chosen.groupBy("h").agg(F.first(F.struct("doc_id", "text")).alias("row")).select("row.doc_id", "row.text")


def rank_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost on ``sample_rows`` documents chosen by hash.  The measured
    sample is cached only while it is timed; each rule's cost is the time of its own pass."""
    sample = measure(sample_of(docs, sample_rows)).cache()
    try:
        rows = max(sample.count(), 1)

        def seconds(expression: str) -> tuple[float, int]:
            start = time.perf_counter()
            hit = sample.agg(F.sum(F.expr(f"if({expression}, 1, 0)")).alias("hit")).first().hit
            return time.perf_counter() - start, hit or 0

        idle = min(seconds("n_words < 0")[0] for _ in range(2))
        scored = []
        for place, rule in enumerate(rules):
            took, hit = seconds(rule.rejects)
            cost = max(took - idle, 1e-4) / rows
            scored.append((-(hit / rows) / cost, place, rule))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def first_broken(rules: list[Rule]) -> Column:
    """Name of the first rule the row breaks, else null; later rules are not evaluated then."""
    if not rules:
        return F.lit(None).cast("string")
    return F.expr("case " + " ".join(f"when coalesce({r.rejects}, false) then '{r.name}'" for r in rules) + " end")


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document with its measures, ``base_failed``, ``broken`` (the rule that ended the
    cascade) and ``kept``.  Base rules need no further measure and always come first."""
    measured = measure(docs)
    ordered = rank_rules(docs, default_rules() if rules is None else rules, sample_rows)
    base = first_broken(base_rules())
    return (
        measured.withColumn("base_broken", base)
        .withColumn("broken", F.when(F.col("base_broken").isNull(), first_broken(ordered)).otherwise(F.col("base_broken")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.col("base_broken").isNotNull().alias("base_failed"), F.col("broken").isNull().alias("kept"), "broken",
        )
    )
