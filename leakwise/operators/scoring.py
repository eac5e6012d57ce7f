"""Scores of scans and workspaces: one grouped pass for the counts, one per secret for reuse, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwise.functions.text import has_tag
from leakwise.schema import CRITICAL, HIGH, INFO, LOW, MEDIUM

NAMES = {CRITICAL: "critical", HIGH: "high", MEDIUM: "medium", LOW: "low", INFO: "info"}


def _counters() -> dict[str, Column]:
    """What is counted of findings, by name."""
    level, test = F.col("confidence"), has_tag(F.col("tags"), "test")
    confidential = has_tag(F.col("tags"), "confidential")
    return (
        {"issues": F.lit(True)}
        | {f"{n}_count": level == k for k, n in NAMES.items() if k != INFO}
        | {"info_count": level.isNull() | ~level.isin(CRITICAL, HIGH, MEDIUM, LOW), "production_confidential_count": confidential & ~test, "production_count": ~test}
        | {f"{n}_file_count": confidential & ~test & (level == k) for k, n in NAMES.items()}
        | {"test_file_count": confidential & test}
    )


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts per confidence (anything unknown counts as info) and of production and confidential findings."""
    return findings.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in _counters().items()])


def reuse_clusters(findings: DataFrame, by: list[str]) -> DataFrame:
    """One row per secret: how often it occurs, in production and in tests."""
    test = has_tag(F.col("tags"), "test")
    return findings.where("sha256 is not null").groupBy(*by, "sha256").agg(
        F.count("*").alias("size"), F.count_if(~test).alias("prod"), F.count_if(test).alias("non_prod")
    )


def prod_and_test_reuse(findings: DataFrame, by: list[str]) -> DataFrame:
    """Where secrets stand that occur both in production and in tests: a row per place, with ``production``.

    Places stay rows (a secret may have very many), and the join that picks them can be split if one is hot.
    """
    mixed = reuse_clusters(findings, by).where("prod > 0 and non_prod > 0").select(*by, "sha256")
    places = findings.withColumn("production", ~has_tag(F.col("tags"), "test"))
    return places.select(*by, "sha256", "production", "location", "highlight_start_line", "highlight_start_char").join(mixed, [*by, "sha256"])


def shared_counts(findings: DataFrame, by: list[str], order: list[Column], strict: bool = True) -> DataFrame:
    """Per confidence, how production findings share secrets with tests.

    ``strict`` adds the running counts again at every row once both kinds were seen, in ``order``, and counts Medium
    for Critical; otherwise each production finding of a mixed cluster counts once under its own confidence.
    """
    test = has_tag(F.col("tags"), "test")
    base = findings.where("sha256 is not null").withColumn("_test", test)
    if not strict:
        per_secret = base.groupBy(*by, "sha256").agg(
            (F.max("_test") & F.max(~F.col("_test"))).alias("_both"), *[F.count_if(~F.col("_test") & (F.col("confidence") == k)).alias(f"{n}_shared") for k, n in NAMES.items()]
        )
        return per_secret.where("_both").groupBy(*by).agg(*[F.sum(f"{n}_shared").alias(f"{n}_shared") for n in NAMES.values()])
    # a common secret is dealt over parts in its order, so none is one task; each part is summed up for whichever kinds
    # were seen before it, and of a secret's parts, at most as many as there are partitions, the earlier ones are added
    secret = [*by, "sha256"]
    parts = base.repartitionByRange(*secret, *order).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy(*secret, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.withColumns({"_t": F.max("_test").over(upto), "_p": F.max(~F.col("_test")).over(upto)})
    for k, n in NAMES.items():
        counted = MEDIUM if k == CRITICAL else k
        found = F.coalesce(~F.col("_test") & (F.col("confidence") == counted), F.lit(False))
        seen = seen.withColumn(f"_{n}", F.sum(found.cast("long")).over(upto))
    before = {"neither": F.col("_t") & F.col("_p"), "tests": F.col("_p"), "production": F.col("_t"), "both": F.lit(True)}
    sums = [F.count_if(both).alias(f"_rows_{kind}") for kind, both in before.items()]
    sums += [F.sum(F.when(both, F.col(f"_{n}")).otherwise(0)).alias(f"_{n}_{kind}") for n in NAMES.values() for kind, both in before.items()]
    # running counts only grow, so a part's largest are its whole
    whole = [F.max(c).alias(c) for c in ("_t", "_p", *[f"_{n}" for n in NAMES.values()])]
    summed = seen.groupBy(*secret, "_part").agg(*sums, *whole)
    earlier = Window.partitionBy(*secret).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.coalesce(F.max(c).over(earlier), F.lit(False)) for c in ("_t", "_p")}
    held = {f"_{n}_held": F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)) for n in NAMES.values()}
    joined = summed.withColumns({"_t_held": known["_t"], "_p_held": known["_p"], **held})

    def of(name: str) -> Column:
        t, p = F.col("_t_held"), F.col("_p_held")
        column = lambda kind: F.col(f"_{name}_{kind}")
        return F.when(t & p, column("both")).when(t, column("tests")).when(p, column("production")).otherwise(column("neither"))

    # as without parts, a scan none of whose secrets is of both kinds has no row
    added = joined.where(of("rows") > 0)
    return added.groupBy(*by).agg(*[F.sum(of(n) + of("rows") * F.col(f"_{n}_held")).alias(f"{n}_shared") for n in NAMES.values()])


def model(findings: DataFrame, files: DataFrame, by: list[str], order: list[Column], strict: bool = True) -> DataFrame:
    """One row per scan: counts, reuse, shared counts and findings per file. ``files`` is (by..., file_count)."""
    # one pass over the findings: counts per secret (findings without one together), then per scan
    per_secret = findings.groupBy(*by, "sha256").agg(*[F.count_if(c).alias(n) for n, c in _counters().items()])
    size, real = F.col("issues"), F.col("sha256").isNotNull()
    counts = per_secret.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in _counters() if n != "issues"],
        F.count_if(real & (size > 1)).alias("reused_secrets"),
        F.coalesce(F.sum(F.when(real & (size > 1), size)), F.lit(0)).alias("reuse_total"),
        # the sizes of the clusters matter by their number and entropy only
        F.coalesce(F.sum(F.when(real, size)), F.lit(0)).alias("secret_findings"),
        F.coalesce(F.sum(F.when(real, size * F.log2(size))), F.lit(0.0)).alias("size_log_size"),
        F.sum("issues").alias("issues"),
    )
    shared = shared_counts(findings, by, order, strict)
    zero = {f"{n}_shared": 0 for n in NAMES.values()} | {"reused_secrets": 0, "reuse_total": 0, "secret_findings": 0, "size_log_size": 0.0, "file_count": 0}
    joined = counts.join(shared, by, "left").join(files, by, "left").fillna(zero)
    average = F.when(F.col("file_count") > 0, (F.col("issues") / F.col("file_count")).cast("float")).otherwise(F.lit(0.0).cast("float"))
    return joined.withColumn("average_per_file", average)


def merge_models(models: DataFrame, by: list[str]) -> DataFrame:
    """Models of parts into one: sums, and the average weighted by files."""
    sums = [c for c in models.columns if c not in (*by, "average_per_file") and not c.startswith("_")]
    numbers = [f.name for f in models.schema.fields if f.name in sums and f.dataType.typeName() in ("long", "integer", "double")]
    weighted = F.sum(F.col("average_per_file") * F.col("file_count")) / F.sum("file_count")
    return models.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers], F.when(F.sum("file_count") > 0, weighted).otherwise(0.0).cast("float").alias("average_per_file"))


def _steps(pairs: list[tuple[str, float]], otherwise: float) -> Column:
    """The value of the first count that is above zero."""
    out = F.lit(float(otherwise))
    for column, score in reversed(pairs):
        out = F.when(F.col(column) > 0, float(score)).otherwise(out)
    return out


# The steps of the sub-scores, worst first, their weights, the caps and the grades.
SHARED_STEPS = [("critical_shared", 0), ("high_shared", 20), ("medium_shared", 40), ("low_shared", 70), ("info_shared", 90)]
FILE_STEPS = [("critical_file_count", 0), ("high_file_count", 20), ("medium_file_count", 30), ("low_file_count", 50), ("info_file_count", 60), ("test_file_count", 70)]
CONFIDENCE_STEPS = [("critical_count", 40), ("high_count", 70), ("medium_count", 80), ("low_count", 90), ("info_count", 95)]
WEIGHTS = (0.3, 0.4, 0.1, 0.2)
CAPS = [("critical_count", 40), ("high_count", 60), ("medium_count", 80)]
GRADES = [(95, "A+"), (85, "A"), (70, "B"), (60, "C"), (50, "D"), (40, "E")]


def reuse_entropy(strict: bool = True) -> Column:
    """100 x entropy of the cluster sizes over its maximum: 100 without secrets; a single one is 0 / 0, which is NaN
    (``strict``) or 100."""
    n, s = F.col("secret_findings"), F.col("size_log_size")
    entropy = F.log2(n) - s / n
    return F.when(n == 0, 100.0).when(n == 1, F.lit(float("nan") if strict else 100.0)).otherwise(100.0 * entropy / F.log2(n))


def grade(metric: Column) -> Column:
    out = F.lit("F")
    for bound, name in reversed(GRADES):
        out = F.when(metric > bound, name).otherwise(out)
    return F.when(F.isnan(metric), "F").otherwise(out)


def score(models: DataFrame, strict: bool = True) -> DataFrame:
    """``models`` with metric (0 to 100) and grade."""
    parts = [_steps(SHARED_STEPS, 100), _steps(FILE_STEPS, 100), reuse_entropy(strict), _steps(CONFIDENCE_STEPS, 100)]
    total = sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])
    cap = _steps(CAPS, 101)
    metric = F.when(F.isnan(total), total).otherwise(F.least(total, cap)).cast("float")
    return models.withColumn("metric", metric).withColumn("grade", grade(F.col("metric")))


def store_score(c: Column, h: Column, m: Column, low: Column, n: Column) -> Column:
    """0 to 10, higher is worse: the weighted mean severity, capped."""
    return F.when(n > 0, F.least(F.lit(10.0), (10.0 * c + 5.0 * h + 2.0 * m + low) / n)).otherwise(0.0)


def score_trend(scans: DataFrame) -> DataFrame:
    """project -> map of "scan;time" to metric."""
    key = F.concat_ws(";", "scan_id", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return scans.groupBy("project_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "metric")))).alias("trend"))


def token_usage(findings: DataFrame, by: list[str], key: str = "promptTokens") -> DataFrame:
    """Sum of a number in the annotations' JSON, 0 without any."""
    return findings.groupBy(*by).agg(F.coalesce(F.sum(F.try_to_number(F.get_json_object("ai_annotation", f"$.{key}"), F.lit("999999999999")).cast("long")), F.lit(0)).alias("tokens"))


def unique_secrets(findings: DataFrame, order: list[Column]) -> DataFrame:
    """One finding per secret, the first in ``order``."""
    first = Window.partitionBy("sha256").orderBy(*order)
    return findings.where("sha256 is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
