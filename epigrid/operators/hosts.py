"""Host names expanded to animals by patterns, and their composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pattern, common name, broad group, in order. Animals whose patterns overlap
# (a sheep in "bovino", a pig in "porcupine") follow the patterns as they stand.
HOST_PATTERNS = [
    ("bovin", "Cattle", "Livestock"), ("bufal|buffal", "Water Buffalo", "Livestock"), ("suin|porc", "Pig", "Livestock"), ("(?<!b)ovin", "Sheep", "Livestock"), ("caprin", "Goat", "Livestock"),
    ("equin", "Horse", "Equids"), ("burro", "Donkey", "Equids"), ("canin|carin", "Dog", "Companion Animals"), ("felin", "Cat", "Companion Animals"), ("human", "Human", "Human"),
    ("bird|ave|aviar|ardeid", "Birds", "Birds"), ("kinkaju", "Kinkajou", "Wildlife"), ("sloth|perezos", "Sloth", "Wildlife"), ("porcupin|porcuspin", "Porcupine", "Wildlife"), ("rabbit|lapine|leporid", "Rabbit/Hare", "Wildlife"),
    ("procyonlotor", "Raccoon", "Wildlife"), ("deer|crvido", "Deer", "Wildlife"), ("leon|lion", "Lion", "Wildlife"), ("leopard", "Leopard", "Wildlife"), ("wildterrestrial|faunasilvestre", "Unspecified Wildlife", "Wildlife"), ("other|unknown", "Unreported", "Unreported"),
    ("monkey", "Monkey", "Wildlife"), ("wildlife", "Unspecified Wildlife", "Wildlife"), ("avian", "Birds", "Birds"),
]
# Fixed value: the order of the broad groups.
GROUP_ORDER = ["Livestock", "Equids", "Companion Animals", "Human", "Wildlife", "Birds", "Unreported"]


def pattern_table(spark: SparkSession, patterns: list[tuple[str, str, str]] = HOST_PATTERNS) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(patterns)], "pattern_id int, pattern string, common_name string, broad_group string")


def expand_hosts(df: DataFrame, patterns: DataFrame, host: str, row_id: str) -> DataFrame:
    """A row a submission and pattern that its cleaned host matches; without a match, one
    "Unreported" row. patterns is a lookup of some dozen rows and broadcast."""
    clean = df.select(F.col(row_id).alias("submission"), F.regexp_replace(F.lower(F.coalesce(F.col(host), F.lit(""))), "[^a-z]", "").alias("host_cleaned"))
    out = clean.join(F.broadcast(patterns), F.expr("host_cleaned rlike pattern"), "left")
    return out.select("submission", "host_cleaned", "pattern_id", F.coalesce("common_name", F.lit("Unreported")).alias("common_name"), F.coalesce("broad_group", F.lit("Unreported")).alias("broad_group"))


def first_hosts(expanded: DataFrame) -> DataFrame:
    """One row a submission: its match of the lowest pattern."""
    return expanded.groupBy("submission").agg(F.min_by(F.struct("host_cleaned", "pattern_id", "common_name", "broad_group"), F.coalesce("pattern_id", F.lit(1 << 30))).alias("h")).select("submission", "h.*")


def composition(assigned: DataFrame, denominator: DataFrame, major_pct: float = 1.0) -> DataFrame:
    """Counts by animal with share, percent and tier, over a one-row denominator (n), and
    the position of their group in the fixed order."""
    counts = assigned.groupBy("common_name", "broad_group").agg(F.count(F.lit(1)).alias("count")).crossJoin(F.broadcast(denominator.select(F.col("n").alias("denominator"))))
    group = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), F.col("broad_group"))
    share = F.col("count") / F.col("denominator")
    return counts.select("common_name", "broad_group", "count", share.alias("prop"), (100 * share).alias("pct"), F.when(100 * share >= major_pct, "Major Hosts").otherwise("Minor Hosts (<1%)").alias("tier"), "denominator", group.alias("group_order"))


def host_audit(expanded: DataFrame, raw: DataFrame, host: str) -> DataFrame:
    """One row: submissions, expanded rows, compound and unmatched submissions, raw names."""
    per = expanded.groupBy("submission").agg(F.count("pattern_id").alias("m"))
    one = per.agg(F.count(F.lit(1)).alias("submissions"), F.sum(F.greatest("m", F.lit(1))).alias("expanded"), F.count(F.when(F.col("m") > 1, 1)).alias("compound"), F.count(F.when(F.col("m") == 0, 1)).alias("unmatched"))
    return one.crossJoin(F.broadcast(raw.agg(F.count_distinct(host).alias("raw_names"))))


def species_composition(df: DataFrame, species: str, categories: DataFrame, denominator: int) -> DataFrame:
    """Counts by species over a stated denominator with the first category seen of each;
    blank names are "unreported". categories: species, category, position."""
    named = df.select(F.when(F.trim(F.coalesce(F.col(species), F.lit(""))) == "", "unreported").otherwise(F.col(species)).alias("species"))
    first = categories.groupBy("species").agg(F.min_by("category", "position").alias("category"))
    return named.groupBy("species").agg(F.count(F.lit(1)).alias("count")).withColumn("prop", F.col("count") / F.lit(denominator)).join(first, "species", "left")
