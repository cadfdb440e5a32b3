"""Replacing real titles and addresses by numbered placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions.sql import Sql
from ..scale import number_rows

# Order in which the texts of one capture are met; a capture has at most 32 of them.
_SLOTS = 32
_TEXTS = (
    "concat(array(page.title), slice(page.headings, 1, 6), array(extract.cleaned_title),"
    " slice(extract.variants, 1, 4), slice(extract.searched, 1, 4), slice(extract.artists, 1, 3),"
    " array(match.product_title))"
)


def values_of(captures: DataFrame) -> DataFrame:
    """Every text to hide as ``(value, seen)``; ``seen`` is unique per value occurrence."""
    return (
        captures.select("capture_no", F.posexplode(F.expr(_TEXTS)).alias("_slot", "value"))
        .where("coalesce(value, '') <> ''")
        .select("value", (F.col("capture_no") * _SLOTS + F.col("_slot")).alias("seen"))
    )


def redaction_dictionary(values: DataFrame, kind: str = "title") -> DataFrame:
    """``values(value, seen)`` -> one row per distinct value with its placeholder
    ``<kind-n>``, numbered by first sighting, and only the shape of the value.

    Repeats collapse in the map-side combine before anything is numbered."""
    first = values.groupBy("value").agg(F.min("seen").alias("first_seen"))
    numbered = number_rows(first, "first_seen", "n")
    label = F.expr(f"concat('<{kind}-', n, '>')").alias("label")
    if kind == "url":
        return numbered.select(
            "value",
            "n",
            label,
            F.expr(U.host_of("value")).alias("host"),
            F.expr(f"if({U.is_absolute('value')}, {U.path_shape(U.path_of('value'))}, '')").alias("path"),
        )
    return numbered.select(
        "value",
        "n",
        label,
        F.expr("length(value)").alias("length"),
        F.expr(X.script_of("value")).alias("script"),
        F.expr(X.short_hash("value")).alias("key"),
    )


def redact(captures: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Captures with every text replaced by its placeholder and the address columns
    dropped.  The dictionary grows with the data, so it is joined, never broadcast by
    hand; the texts of a capture (at most 19) are folded back per capture."""
    slots = captures.select("capture_no", F.posexplode(F.expr(_TEXTS)).alias("_slot", "_v")).withColumn(
        # empty texts have no entry; give each its own key so they do not meet in one task
        "value", F.expr("coalesce(nullif(_v, ''), concat('\\u0000', capture_no))")
    )
    labelled = (
        slots.join(dictionary.select("value", "label"), "value", "left")
        .groupBy("capture_no")
        .agg(F.array_sort(F.collect_list(F.struct("_slot", F.coalesce("label", F.lit("")).alias("label")))).alias("_labels"))
        .withColumn("_labels", F.expr("transform(_labels, l -> l.label)"))
    )

    def part(start: Sql, count: Sql) -> Sql:
        return f"slice(_labels, {start} + 1, {count})"

    h = "least(6, size(page.headings))"
    v, s, a = ("least(4, size(extract.variants))", "least(4, size(extract.searched))", "least(3, size(extract.artists))")
    joined = captures.drop("url", "page_key").join(labelled, "capture_no")
    return (
        joined.withColumns(
            {
                "_page": F.expr(
                    f"named_struct('title', _labels[0], 'title_script', page.title_script, 'headings', {part('1', h)},"
                    " 'image_count', page.image_count, 'info_fields', page.info_fields, 'navigation_type', page.navigation_type,"
                    " 'analysis_count', page.analysis_count, 'settled', page.settled)"
                ),
                "_extract": F.expr(
                    "named_struct('recognized', extract.recognized, 'reason', extract.reason, 'signals', extract.signals,"
                    f" 'title_source', extract.title_source, 'cleaned_title', _labels[1 + {h}], 'work_key', extract.work_key,"
                    f" 'confidence', extract.confidence, 'variants', {part(f'2 + {h}', v)},"
                    f" 'searched', {part(f'2 + {h} + {v}', s)}, 'artists', {part(f'2 + {h} + {v} + {s}', a)})"
                ),
                "_match": F.expr(
                    "named_struct('grade', match.grade, 'score', match.score, 'store_id', match.store_id,"
                    f" 'product_key', match.product_key, 'product_title', _labels[2 + {h} + {v} + {s} + {a}],"
                    " 'candidate_count', match.candidate_count, 'false_positive', match.false_positive)"
                ),
            }
        )
        .drop("page", "extract", "match", "_labels")
        .withColumnsRenamed({"_page": "page", "_extract": "extract", "_match": "match"})
    )
