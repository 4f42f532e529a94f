"""Files by week, manifests with hashes, ASCII grids, and lineage of weekly products."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import Grid
from ..functions.text import json_alias

WEEK_IN_NAME = r"y?(\d{4})[-_]?w(\d{1,2})"


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, content) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"), "content")


def weekly_files(files: DataFrame, pattern: str = WEEK_IN_NAME) -> DataFrame:
    """(path, epiyear, epiweek) of files whose name holds a week 1..53."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    year, week = (F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int") for i in (1, 2))
    return files.select("path", year.alias("epiyear"), week.alias("epiweek")).where("epiweek between 1 and 53")


def check_weekly_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(epiyear, epiweek, problem): weeks with several files, and expected ones without."""
    twice = found.groupBy("epiyear", "epiweek").count().where("count > 1").select("epiyear", "epiweek", F.lit("duplicate").alias("problem"))
    absent = expected.select("epiyear", "epiweek").join(found, ["epiyear", "epiweek"], "left_anti").withColumn("problem", F.lit("missing"))
    return twice.unionByName(absent)


def ascii_grid_header(spark: SparkSession, path: str) -> tuple[Grid, float]:
    """Geometry and missing value of an ASCII grid, from its first lines."""
    head = {}
    for r in spark.read.text(path, wholetext=False).limit(6).collect():
        k, _, v = r["value"].strip().partition(" ")
        head[k.lower()] = float(v)
    rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    x, y = head["xllcorner"], head["yllcorner"]
    return Grid(rows, cols, x, x + cols * size, y, y + rows * size), head.get("nodata_value", -9999.0)


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, cell_id, value) of ASCII grids, a row a cell; missing values are null. Each
    file is one row until it is split, so grids may be many but each must fit a task."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = text.select("path", F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("l"))
    missing = F.regexp_extract(F.element_at("l", 6), r"(?i)nodata_value\s+(\S+)", 1).cast("double")
    cells = F.split(F.trim(F.array_join(F.slice("l", 7, 1 << 30), " ")), r"\s+")
    out = lines.select("path", missing.alias("na"), F.posexplode(cells).alias("i", "v"))
    v = F.col("v").cast("double")
    return out.select("path", (F.col("i") + 1).cast("long").alias("cell_id"), F.when((v != F.col("na")) & ~F.isnan(v), v).alias("value"))


def grid_lines(values: DataFrame, grid: Grid, missing: float = -9999.0) -> DataFrame:
    """(row, line): an ASCII grid's lines below its header, from (cell_id, value)."""
    spine = values.sparkSession.range(1, grid.rows * grid.cols + 1).withColumnRenamed("id", "cell_id").join(values, "cell_id", "left")
    row = F.floor((F.col("cell_id") - 1) / grid.cols)
    cells = F.array_sort(F.collect_list(F.struct("cell_id", F.coalesce("value", F.lit(missing)).alias("v"))))
    return spine.groupBy(row.alias("row")).agg(F.array_join(F.transform(cells, lambda c: c["v"].cast("string")), " ").alias("line"))


def file_manifest(files: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """(path, artifact, role, format, sha256, bytes): one row a file; the role goes by the
    folder's name."""
    folder = F.element_at(F.split("path", "/"), -2)
    role = F
    for k, v in (roles or {}).items():
        role = role.when(folder == k, v)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("artifact"), (role.otherwise(folder) if roles else folder).alias("role"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.sha2("content", 256).alias("sha256"), "bytes")


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of a manifest (path, epiyear, epiweek, sha256) against its files:
    absent, malformed hash, other content, other week in the name, repeated week."""
    names = weekly_files(files).withColumnsRenamed({"epiyear": "_y", "epiweek": "_w"})
    have = files.select("path", F.sha2("content", 256).alias("_sha"))
    m = manifest.join(have, "path", "left").join(names, "path", "left")
    weeks = manifest.groupBy("epiyear", "epiweek").agg(F.count(F.lit(1)).alias("_n"))
    m = m.join(weeks, ["epiyear", "epiweek"])
    problem = F.when(F.col("_sha").isNull(), "absent").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "malformed hash").when(F.col("sha256") != F.col("_sha"), "other content").when((F.col("_y") != F.col("epiyear")) | (F.col("_w") != F.col("epiweek")), "other week").when(F.col("_n") > 1, "repeated week")
    return m.select("path", problem.alias("problem")).where("problem is not null")


def paired_maps(manifest: DataFrame, first: str, second: str) -> DataFrame:
    """Weeks that both products have (product, epiyear, epiweek, path)."""
    pick = lambda p: manifest.where(F.col("product") == p).select("epiyear", "epiweek", F.col("path").alias(p))
    return pick(first).join(pick(second), ["epiyear", "epiweek"])


def latest_portfolio(portfolios: DataFrame) -> DataFrame:
    """The valid portfolio of the last endpoint, completion and path."""
    return portfolios.where("status = 'complete'").orderBy(F.desc("endpoint"), F.desc("completed_at"), F.desc("path")).limit(1)


def sidecar_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Weekly lineage of JSON sidecars, fields by their first known name."""
    return text.select(
        json_alias(column, "$.variable_id", "$.variable").alias("variable"), json_alias(column, "$.week_id", "$.week").alias("week_id"), json_alias(column, "$.input_fingerprint", "$.fingerprint").alias("fingerprint"), json_alias(column, "$.output_sha256", "$.sha256").alias("sha256")
    )


def lineage_coverage(sidecars: DataFrame, variables: DataFrame, weeks: DataFrame) -> DataFrame:
    """(variable, week_id, problem) for each variable and week without just one sidecar
    that has a fingerprint and a hash."""
    want = variables.select("variable").distinct().crossJoin(F.broadcast(weeks.select("week_id").distinct()))
    got = sidecars.groupBy("variable", "week_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fingerprint").isNotNull() & F.col("sha256").rlike("^[0-9a-f]{64}$"), 1)).alias("good"))
    out = want.join(got, ["variable", "week_id"], "left")
    return out.select("variable", "week_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("good") == 0, "bad sidecar").alias("problem")).where("problem is not null")


def set_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (fingerprint): SHA-256 over the hashes of 4096 classes of rows, each of which is
    over its rows' sorted JSON hashes; the same in any row order. No task gets all rows."""
    rows = df.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("_h"))
    classes = rows.groupBy(F.substring("_h", 1, 3).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h"))
    return classes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("_p", "_h"))), ""), 256).alias("fingerprint"))


def portfolio_validity(products: DataFrame, required: list[str], weeks: int) -> DataFrame:
    """(portfolio, valid, problem): products: portfolio, status, product, product_status, missing,
    bad_sidecars, present, expected. A portfolio is valid when it and all required products
    succeeded, with no week or sidecar missing and all weeks present."""
    whole = (F.col("product_status") == "success") & (F.col("missing") == 0) & (F.col("bad_sidecars") == 0) & (F.col("present") >= F.col("expected")) & (F.col("expected") >= weeks)
    need = F.col("product").isin(required)
    out = products.groupBy("portfolio").agg(F.min(F.col("status") == "success").alias("_s"), F.count_distinct(F.when(need, F.col("product"))).alias("_have"), F.count(F.when(need & ~F.coalesce(whole, F.lit(False)), 1)).alias("_bad"))
    problem = F.when(~F.coalesce("_s", F.lit(False)), "not successful").when(F.col("_have") < len(required), "product missing").when(F.col("_bad") > 0, "product incomplete")
    return out.select("portfolio", problem.isNull().alias("valid"), problem.alias("problem"))


def coverage_certificate(sidecars: DataFrame, variables: DataFrame, weeks: DataFrame) -> DataFrame:
    """One row: variables, weeks, problems, a fingerprint over all sidecars' own, and whether
    coverage is complete."""
    faults = lineage_coverage(sidecars, variables, weeks).agg(F.count(F.lit(1)).alias("problems"))
    size = variables.agg(F.count_distinct("variable").alias("variables")).crossJoin(F.broadcast(weeks.agg(F.count_distinct("week_id").alias("weeks"))))
    mark = set_fingerprint(sidecars, ["variable", "week_id", "fingerprint", "sha256"])
    return size.crossJoin(F.broadcast(faults)).crossJoin(F.broadcast(mark)).withColumn("complete", F.col("problems") == 0)


def repeated_contents(manifest: DataFrame) -> DataFrame:
    """(sha256, copies, first_path) of contents that stand in several files."""
    return manifest.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def horizon_status(week: str, available: str) -> str:
    """equal, within or an error, of two week labels."""
    a, b = (re.fullmatch(r"(\d{4})-W(\d{1,2})", x or "") for x in (week, available))
    if not a or not b:
        raise ValueError("malformed week")
    p, q = (int(m[1]) * 100 + int(m[2]) for m in (a, b))
    if p > q:
        raise ValueError(f"{week} is beyond {available}")
    return "equal" if p == q else "within"


def stale_constants(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, line, label) of text lines that match a pattern; copies of one content share
    their hash in file_manifest."""
    lines = files.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))
    table = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("pattern")) for k, v in patterns.items()])
    return lines.select("path", (F.col("line") + 1).alias("line"), "text", F.explode(table).alias("p")).where(F.expr("text rlike p.pattern")).select("path", "line", "p.label")
