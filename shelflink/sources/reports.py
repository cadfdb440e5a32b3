"""Reading and writing case files and report exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sql import case
from ..operators import quality as Q
from ..operators.captures import failed_fields, failure_id, is_failure
from ..operators.fingerprint import category_dir_of
from ..operators.redact import redact, redaction_dictionary, values_of

FEATURES = (
    "struct<page_type:string,h1:boolean,og_title:boolean,json_ld:boolean,gallery_info:boolean,"
    "many_images:boolean,spa_navigation:boolean>"
)
EXPECTED = (
    "struct<page_recognition:boolean,store_search:boolean,correct_match:boolean,false_positive:boolean,"
    "grade:string,cleaned_title:string,max_requests:int,limitation:boolean>"
)
SOURCE = "struct<fingerprint:string,page_type:string,novelty:int,verdict:string>"
CASES = f"id string, capture_id string, category string, captured_at string, note string, features {FEATURES}, expected {EXPECTED}, source {SOURCE}"
EXPORTS = (
    "kind string, generated_at string, contains_real_data boolean, _corrupt_record string,"
    f" cases array<struct<id:string,category:string,source:{SOURCE}>>,"
    " failures array<struct<id:string,failed_fields:array<string>,fingerprint:string,false_positive:boolean,grade:string,"
    "requests:int,health:map<string,string>>>, summary map<string,string>,"
    " structures array<struct<fingerprint:string,count:bigint>>"
)
# Export kinds and file names.
KINDS = {"qa-summary": "summary", "qa-failures": "failures", "qa-tests": "tests", "qa-run": "run"}
FILE_NAMES = {"summary": "qa-summary", "failures": "qa-failures"}


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files below ``path``: the folder is the category, the first file of an id
    wins, and only ids ``RW-...`` count."""
    files = (
        spark.read.schema(CASES)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .where("startswith(id, 'RW-')")
    )
    first = Window.partitionBy("id").orderBy("file")
    return (
        files.withColumn("dir", F.element_at(F.split("file", "/"), -2))
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n")
        .orderBy("id")
    )


def load_exports(spark: SparkSession, path: str) -> DataFrame:
    """Export files with ``route``: summary, failures, tests, run or unknown (also for
    files that are no JSON)."""
    read = (
        spark.read.schema(EXPORTS)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    route = case(*[(f"kind = '{k}'", f"'{v}'") for k, v in KINDS.items()], default="'unknown'")
    return read.withColumn("route", F.expr(f"if(_corrupt_record is not null, 'unknown', {route})"))


def _newest(rows: DataFrame, item: str) -> DataFrame:
    return (
        rows.select("generated_at", "file", F.explode(item).alias("_i"))
        .where("_i.id is not null and _i.id <> ''")
        .groupBy("_i.id")
        .agg(F.max_by("_i", F.struct(F.coalesce("generated_at", F.lit("")), "file")).alias("item"))
    )


def merge_exports(exports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, cases, failures): the newest summary is authoritative, bundles and cases
    are unioned by id with the newest version of each, and every failure known from a
    bundle or an index appears once."""
    of = lambda route: exports.where(F.col("route") == route)
    summary = of("summary").orderBy(F.desc("generated_at"), F.asc("file")).limit(1)
    packed = _newest(of("tests"), "cases")
    listed = _newest(summary, "cases")
    cases = (
        packed.join(listed.withColumnRenamed("item", "_listed"), "id", "full_outer")
        .select("id", F.coalesce("item", "_listed").alias("item"))
        .select("id", "item.category", "item.source.fingerprint", "item.source.verdict")
    )
    bundles = _newest(of("failures"), "failures").withColumnRenamed("item", "bundle")
    compact = _newest(of("summary"), "failures").withColumnRenamed("item", "compact")
    both = bundles.join(compact, "id", "full_outer").withColumn("_x", F.coalesce("bundle", "compact"))
    flat = both.select(
        "id",
        F.col("bundle").isNotNull().alias("has_bundle"),
        F.expr("coalesce(bundle.failed_fields, compact.failed_fields, cast(array() as array<string>))").alias("failed_fields"),
        F.expr("coalesce(bundle.fingerprint, compact.fingerprint, '')").alias("fingerprint"),
        F.expr("coalesce(bundle.false_positive, compact.false_positive, false)").alias("false_positive"),
        F.expr("coalesce(_x.grade, '')").alias("grade"),
        "_x.requests",
        F.expr("coalesce(_x.health, map())").alias("health"),
    )
    reason = f"if(has_bundle, {Q.one_line_reason()}, 'compact entry only — export the failure bundles for detail')"
    return summary, cases, flat.withColumn("reason", F.expr(reason))


def write_summary(captures: DataFrame, cases: DataFrame | None, path: str) -> None:
    """Small report: numbers, structures, case list and failure index; no real texts."""
    Q.summary(captures, cases).write.mode("overwrite").json(f"{path}/summary")
    Q.requests_by_store(captures).write.mode("overwrite").json(f"{path}/requests_by_store")
    Q.structures(captures).write.mode("overwrite").json(f"{path}/structures")
    Q.compact_failures(captures).write.mode("overwrite").json(f"{path}/failures")
    if cases is not None:
        Q.compact_cases(cases).write.mode("overwrite").json(f"{path}/cases")


def failure_bundles(captures: DataFrame, include_real: bool = False) -> DataFrame:
    """One detailed row per failure, with placeholders unless real texts are wanted."""
    failures = captures.where(is_failure())
    shown = failures if include_real else redact(failures, redaction_dictionary(values_of(failures)))
    return shown.select(
        F.expr(failure_id()).alias("failure_id"),
        F.col("id").alias("capture_id"),
        "category", "page_type", "fingerprint", "fingerprint_lines", "novelty", "verdict", "note",
        F.expr(failed_fields()).alias("failed_fields"),
        F.expr("coalesce(match.false_positive, false)").alias("false_positive"),
        "features", "page", "extract", "stores", "match", "requests", "results",
    )


def write_failures(captures: DataFrame, path: str, include_real: bool = False) -> None:
    """Bundles bucketed by failure id, so one id can be read without the rest, plus the
    breakdown by field.  (One folder per id would make millions of tiny files.)"""
    bundles = failure_bundles(captures, include_real).withColumn("bucket", F.expr("pmod(xxhash64(failure_id), 64)"))
    bundles.write.mode("overwrite").partitionBy("bucket").json(f"{path}/failures")
    Q.failure_breakdown(captures).write.mode("overwrite").json(f"{path}/breakdown")


def case_pack(captures: DataFrame, cases: DataFrame, include_real: bool = False) -> DataFrame:
    """Cases with their capture (left join by capture id) and their address: the real
    one, or its placeholder."""
    with_url = cases.join(captures.select(F.col("id").alias("capture_id"), "capture_no", "url"), "capture_id", "left")
    if include_real:
        urls = with_url.withColumn("site", F.coalesce("url", F.lit("")))
        shown = captures
    else:
        order = F.expr("coalesce(try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint), xxhash64(id))")
        seen = with_url.where("url is not null").select(F.col("url").alias("value"), order.alias("seen"))
        labels = redaction_dictionary(seen, "url").select(F.col("value").alias("url"), F.col("label").alias("site"))
        urls = with_url.join(labels, "url", "left").withColumn("site", F.coalesce("site", F.lit("")))
        shown = redact(captures, redaction_dictionary(values_of(captures)))
    keep = [c for c in ("page", "extract", "match", "stores", "requests", "results", "fingerprint", "page_type") if c in shown.columns]
    slim = shown.select(F.col("id").alias("capture_id"), F.struct("id", *keep).alias("capture"))
    return urls.drop("url", "capture_no").join(slim, "capture_id", "left")


def write_case_pack(captures: DataFrame, cases: DataFrame, path: str, include_real: bool = False) -> None:
    case_pack(captures, cases, include_real).write.mode("overwrite").json(path)


def import_case_pack(pack: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(public cases, private captures, private sites) of a case pack; placeholder
    addresses are dropped, the category picks the folder of a public case."""
    public = pack.select(
        F.expr(category_dir_of("category", "features")).alias("dir"), "id", F.coalesce("category", F.lit("unknown")).alias("category"),
        "features", "expected", "source", "note",
    )
    private = pack.where("capture is not null").select("id", "capture")
    sites = pack.where(r"coalesce(site, '') <> '' and not rlike(site, '^<.*>$')").select("id", "site", "captured_at")
    return public, private, sites


def write_imported(pack: DataFrame, public_path: str, private_path: str) -> None:
    public, private, sites = import_case_pack(pack)
    public.write.mode("overwrite").partitionBy("dir").json(public_path)
    private.write.mode("overwrite").json(f"{private_path}/captures")
    sites.write.mode("overwrite").json(f"{private_path}/sites")


def export_names(exports: DataFrame) -> DataFrame:
    """``exports(kind, at)`` -> file name with the day's running number (numbers restart every
    day).  A day is cut into minutes, numbered inside a minute and shifted by the minutes before
    it, so a busy day is no single task; rows of one instant are told apart by their columns."""
    base = case(*[(f"kind = '{k}'", f"'{v}'") for k, v in FILE_NAMES.items()], default="'qa-tests'")
    placed = exports.withColumn("day", F.date_format("at", "yyyy-MM-dd")).withColumn("_minute", F.date_trunc("minute", "at"))
    sizes = placed.groupBy("day", "_minute").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("day", "_minute", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("day", "_minute").orderBy("at", *[c for c in exports.columns if c != "at"])
    return (
        placed.join(offsets, ["day", "_minute"])
        .withColumn("seq", (F.row_number().over(inside) + F.col("_before")).cast("int"))
        .withColumn("file_name", F.expr(f"format_string('%s-%s-%03d.json', {base}, day, seq)"))
        .drop("_minute", "_before")
    )
