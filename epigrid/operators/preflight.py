"""What must hold of a joint stack before a fit, over tables.

stack: row, link (1 or 2), y1, y2, exposure, a row an observation. matrix: row, column,
value, the sparse projection from latent columns to rows. latent: column and a column a term,
null where a term has no part in a latent column. A term's values are checked where an
active row's nonzero entries reach them, as the fit would see them.

Every function returns check rows (see ``gates.check_rows``) or numbers to make them of;
no table is read on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .gates import checks_from
from .sets import by_key, dealt

GATE = "preflight"
WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")
NUMBER_TYPES = (*WHOLE_TYPES, "float", "double")
#: How far an index may be off a whole number, a row of a field's weights off 1, and the fewest bins of a curve.
FRACTION, ROW_SUM, LEAST_BINS = 1.5e-8, 1e-10, 5
#: Terms that go through together, a bit each, and matrix entries of a task.
TERMS, ENTRIES = 60, 500_000


@dataclass(frozen=True)
class Term:
    """A fixed effect, or the index of a random one. active: the rows that it is checked on
    (tier1, tier2: with a response; tier1_rows, tier2_rows: all of the tier; any: any response)."""

    name: str
    active: str
    whole: bool = False
    least: int | None = None
    most: int | None = None
    levels: int | None = None
    contiguous: bool = False


#: The fixed effects of the two likelihoods.
TIER1_FIXED = ["intercept1", "north", "road_dens", "night_illum"]
TIER2_FIXED = ["intercept2", "mintemp", "soilmoist", "leafarea", "rhum", "cattle", "horses", "pigs", "goats", "sheep"]


def fixed_terms(names: list[str]) -> list[Term]:
    return [Term(n, "tier1" if n in TIER1_FIXED else "tier2" if n in TIER2_FIXED else "any") for n in names]


def random_terms(nodes: int, groups: int, bins: int | None = None) -> list[Term]:
    """The indices of the joint model: fields and their groups, weeks, areas, bins of a curve."""
    index = lambda n, active, **more: Term(n, active, whole=True, least=1, **more)
    fields = [(f, t) for f, t in (("tier1_field", "tier1"), ("tier2_field", "tier2"), ("tier2_copy_field", "tier2"))]
    return [
        *[index(f, t, most=nodes) for f, t in fields], *[index(f"{f}_group", t, most=groups, levels=groups) for f, t in fields],
        index("week_steps", "tier1_rows", contiguous=True), index("tier2_week", "tier2_rows", contiguous=True), index("admin_f", "tier1"),
        index("cattle_q", "tier2", most=bins), Term("cattle_mid_log1p", "tier2"),
    ]


def masks() -> dict[str, Column]:
    one, two = F.coalesce(F.col("link") == 1, F.lit(False)), F.coalesce(F.col("link") == 2, F.lit(False))
    y1, y2 = F.col("y1").isNotNull(), F.col("y2").isNotNull()
    return {"tier1": one & y1, "tier2": two & y2, "tier1_rows": one, "tier2_rows": two, "any": y1 | y2}


def response_checks(stack: DataFrame) -> DataFrame:
    """Responses, links and exposures; a response that is not a number is no missing one."""
    m = masks()
    y1, y2, two = F.col("y1"), F.col("y2"), m["tier2_rows"]
    count = lambda c: F.count(F.when(c, 1))
    return checks_from(stack, GATE, [
        ("rows_unique", "BLOCKING", F.count(F.lit(1)) - F.count_distinct("row"), "each row is there once"),
        ("no_simultaneous_responses", "BLOCKING", count(y1.isNotNull() & y2.isNotNull()), "one response at most in a row"),
        ("tier1_binary_values", "BLOCKING", count(y1.isNotNull() & ~(finite("y1") & y1.isin(0.0, 1.0))), "presence is 0 or 1"),
        ("tier2_positive_values", "BLOCKING", count(y2.isNotNull() & ~(finite("y2") & (y2 > 0))), "intensities are finite and positive"),
        ("link_type_values", "BLOCKING", count(~F.coalesce(F.col("link").isin(1, 2), F.lit(False))), "links are 1 or 2"),
        ("link_response_alignment", "BLOCKING", count((y1.isNotNull() & ~m["tier1_rows"]) | (y2.isNotNull() & ~two)), "responses stand in rows of their link"),
        ("tier1_exposure_semantics", "BLOCKING", count(m["tier1_rows"] & F.col("exposure").isNotNull()), "presences have no exposure"),
        ("tier2_active_exposure", "BLOCKING", count(two & y2.isNotNull() & ~(finite("exposure") & (F.col("exposure") > 0))), "counts have a finite and positive exposure"),
    ])


def projection_checks(stack: DataFrame, matrix: DataFrame, columns: int, field_columns: tuple[int, int] | None = None) -> DataFrame:
    """The matrix: entries finite, once each, within the stack's rows and ``columns`` latent
    columns (from 1); no active row sums to zero or is empty. field_columns: the first and last column
    of a field, whose weights must add up to 1 in every row that has any (a warning).

    One shuffle by row carries all of it; entries are added up before they move."""
    inside = F.col("column").between(1, columns)
    value = F.col("value")
    field = F.col("column").between(*field_columns) if field_columns else F.lit(False)
    rows = matrix.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce(inside, F.lit(False)), 1)).alias("outside"), F.count(F.when(~finite("value"), 1)).alias("nonfinite"),
        F.sum(F.when(finite("value"), value)).alias("total"), F.count(F.when(field, 1)).alias("in_field"), F.sum(F.when(field & finite("value"), value)).alias("weights"),
    )
    repeated = matrix.groupBy("row", "column").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    active = stack.select("row", masks()["any"].alias("active"))
    both = rows.join(active, "row", "full")
    count = lambda c: F.count(F.when(c, 1))
    checks = checks_from(both, GATE, [
        ("A_dimensions", "BLOCKING", F.when(F.coalesce(F.sum("n"), F.lit(0)) > 0, 0).otherwise(1) + F.lit(0 if columns > 0 else 1), "the matrix has rows and columns"),
        ("A_row_count", "BLOCKING", count(F.col("active").isNull()), "its rows are the stack's"),
        ("A_column_bounds", "BLOCKING", F.sum("outside"), "its columns are latent ones"),
        ("A_finite_entries", "BLOCKING", F.sum("nonfinite"), "its entries are finite"),
        ("active_nonzero_rows", "BLOCKING", count(F.col("active") & (F.coalesce("total", F.lit(0.0)) == 0)), "no row with a response sums to zero"),
        ("field_row_sums", "WARNING", count((F.col("in_field") > 0) & ~F.coalesce(F.abs(F.col("weights") - 1) <= ROW_SUM, F.lit(False))), "a row's weights of the field add up to 1"),
    ])
    return checks.unionByName(checks_from(repeated, GATE, [("A_repeated_entries", "BLOCKING", F.max("repeated"), "no entry is there twice")]))


def storage_checks(latent: DataFrame, terms: list[Term], columns: int) -> DataFrame:
    """Terms are there, in number types (indices in whole ones), and every latent column is there once."""
    kinds = {n.lower(): t for n, t in latent.dtypes}
    rules = [("latent_columns", "BLOCKING", F.abs(F.count(F.lit(1)) - F.lit(columns)) + F.lit(columns) - F.count_distinct(F.when(F.col("column").between(1, columns), F.col("column"))), "each latent column is there once")]
    for t in terms:
        good = kinds.get(t.name.lower()) in (WHOLE_TYPES if t.whole else NUMBER_TYPES)
        rules.append((f"{t.name}_type", "BLOCKING", F.lit(0 if good else 1), f"{t.name} has {'a whole' if t.whole else 'a'} number type"))
    return checks_from(latent, GATE, rules)


def _used(stack: DataFrame, matrix: DataFrame, latent: DataFrame, terms: list[Term]) -> tuple[DataFrame, DataFrame, list[Term]]:
    have = {n.lower() for n in latent.columns}
    terms = [t for t in terms if t.name.lower() in have]
    mask = F.array_compact(F.array(*[F.when(c, k) for k, c in masks().items()])).alias("masks")
    rows = stack.select("row", mask)
    if not terms:
        return rows, None, terms
    values = latent.select("column", *[F.col(t.name).cast("double").alias(t.name) for t in terms]).unpivot(["column"], [t.name for t in terms], "term", "v").where("v is not null")
    of = F.create_map(*[F.lit(x) for t in terms for x in (t.name, t.active)])
    entries = matrix.where("value <> 0").select("row", "column").join(rows, "row").where(F.size("masks") > 0)
    used = entries.join(values.withColumn("mask", of[F.col("term")]), "column").where(F.expr("array_contains(masks, mask)")).select("term", "row", "column", "v")
    return rows, used, terms


def term_metrics(stack: DataFrame, matrix: DataFrame, latent: DataFrame, terms: list[Term]) -> DataFrame:
    """(term, active_rows, unprojected_rows, finite_count, nonfinite_count, fractions, below,
    above, minimum, maximum, unique_count): of each term that latent has, over the latent values that
    its active rows reach, each value once; and how many active rows reach none."""
    have = {n.lower() for n in latent.columns}
    terms = [t for t in terms if t.name.lower() in have]
    if len(terms) > TERMS:
        return reduce(lambda a, b: a.unionByName(b), [term_metrics(stack, matrix, latent, terms[k : k + TERMS]) for k in range(0, len(terms), TERMS)])
    spark = stack.sparkSession
    names = "term string, mask string, whole boolean, least int, most int, levels int, contiguous boolean"
    spec = spark.createDataFrame([(t.name, t.active, t.whole, t.least, t.most, t.levels, t.contiguous) for t in terms], names)
    if not terms:
        return spec.select(*[c for c in names.replace(",", "").split() if c in spec.columns], *[F.lit(0).cast("long").alias(c) for c in ("active_rows", "unprojected_rows", "finite_count", "nonfinite_count", "fractions", "below", "above", "unique_count")], *[F.lit(None).cast("double").alias(c) for c in ("minimum", "maximum")])
    m = masks()
    active = stack.select(F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in m.items()]))).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("active_rows"))
    # A bit a term: an entry carries the terms that its row wants, a column those that it has. So an entry stays one row, whatever the terms.
    bits = lambda of: reduce(lambda a, b: a.bitwiseOR(b), [F.when(of(t), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(terms)])
    wanted = stack.select("row", bits(lambda t: m[t.active]).alias("wants")).where("wants <> 0")
    entries = dealt(matrix.where("value <> 0").select("row", "column"), "row", rows=ENTRIES).join(by_key(wanted), "row")
    held = latent.select("column", bits(lambda t: F.col(t.name).isNotNull()).alias("has"))
    hits = entries.join(by_key(held), "column").groupBy("row").agg(F.bit_or(F.col("wants").bitwiseAND(F.col("has"))).alias("hit"))
    each = F.array_compact(F.array(*[F.when(F.col("hit").bitwiseAND(F.lit(1 << k).cast("long")) != 0, t.name) for k, t in enumerate(terms)]))
    reached = hits.select(F.explode(each).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("reached"))
    v, good = F.col("v"), finite("v")
    asked = entries.groupBy("column").agg(F.bit_or("wants").alias("wants"))
    bit_of = F.create_map(*[x for k, t in enumerate(terms) for x in (F.lit(t.name), F.lit(1 << k).cast("long"))])
    reads = dealt(latent.select("column", *[F.col(t.name).cast("double").alias(t.name) for t in terms]), "column").join(by_key(asked), "column")
    long = reads.unpivot(["column", "wants"], [t.name for t in terms], "term", "v").where(v.isNotNull() & (F.col("wants").bitwiseAND(bit_of[F.col("term")]) != 0))
    values = long.groupBy("term", "column").agg(F.max("v").alias("v")).join(F.broadcast(spec.select("term", "least", "most")), "term")
    numbers = values.groupBy("term").agg(
        F.count(F.when(good, 1)).alias("finite_count"), F.count(F.when(~good, 1)).alias("nonfinite_count"), F.count(F.when(good & (F.abs(v - F.round(v)) > FRACTION), 1)).alias("fractions"),
        F.count(F.when(good & (v < F.col("least")), 1)).alias("below"), F.count(F.when(good & (v > F.col("most")), 1)).alias("above"),
        F.min(F.when(good, v)).alias("minimum"), F.max(F.when(good, v)).alias("maximum"), F.count_distinct(F.when(good, v)).alias("unique_count"),
    )
    out = F.broadcast(spec).join(active, "mask", "left").join(reached, "term", "left").join(numbers, "term", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rest = [zero(F.col(c)).alias(c) for c in ("finite_count", "nonfinite_count", "fractions", "below", "above", "unique_count")]
    return out.select(*spec.columns, zero(F.col("active_rows")).alias("active_rows"), (zero(F.col("active_rows")) - zero(F.col("reached"))).alias("unprojected_rows"), *rest, "minimum", "maximum")


def term_checks(metrics: DataFrame) -> DataFrame:
    """Check rows of ``term_metrics``: finite where rows reach them, some at all, whole, within
    bounds, levels 1 to n all there, or without gaps."""
    c = F.col
    span = F.coalesce(c("maximum") - c("minimum") + 1 - c("unique_count"), F.lit(0.0)).cast("long")
    rules = [
        ("active_finite", F.lit(True), c("nonfinite_count") + c("unprojected_rows"), "finite in all active rows"),
        ("active_values", F.lit(True), F.when(c("finite_count") > 0, 0).otherwise(1), "has active values"),
        ("integer_valued", c("whole"), c("fractions"), "whole numbers"),
        ("minimum", c("least").isNotNull(), c("below"), "not below the first level"),
        ("maximum", c("most").isNotNull(), c("above"), "not above the last level"),
        ("levels", c("levels").isNotNull(), F.abs(c("levels") - c("unique_count")) + c("below") + F.when(c("maximum") > c("levels"), 1).otherwise(0), "levels run from 1 to the last"),
        ("contiguous_levels", c("contiguous"), span, "levels have no gap"),
    ]
    each = F.filter(F.array(*[F.when(when, F.struct(F.lit(name).alias("name"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.lit(text).alias("text"))) for name, when, n, text in rules]), lambda x: x.isNotNull())
    long = metrics.select("term", F.explode(each).alias("r"))
    return long.select(F.lit(GATE).alias("gate"), F.concat_ws("_", "term", "r.name").alias("check"), F.lit("BLOCKING").alias("severity"), F.when(c("r.n") == 0, "PASS").otherwise("FAIL").alias("status"), c("r.text").alias("message"), F.lit("0").alias("expected"), c("r.n").cast("string").alias("observed"))


def curve_support(stack: DataFrame, matrix: DataFrame, latent: DataFrame, bins: int, index: str = "cattle_q", middle: str = "cattle_mid_log1p") -> DataFrame:
    """The bins of a smooth curve: all within 1 to ``bins`` over the tier's rows, at least five
    with responses, empty ones a warning; their middles are finite and stand in the same latent columns."""
    both = [Term(index, "tier2_rows"), Term(middle, "tier2_rows")]
    rows, used, _ = _used(stack, matrix, latent, both)
    tagged = used.join(rows.select("row", F.array_contains("masks", "tier2").alias("active")), "row")
    column = tagged.groupBy("column").agg(
        F.max(F.when(F.col("term") == index, F.col("v"))).alias("q"), F.max(F.when(F.col("term") == middle, F.col("v"))).alias("mid"), F.max("active").alias("active"),
        F.max((F.col("term") == index).cast("int")).alias("has_q"), F.max((F.col("term") == middle).cast("int")).alias("has_mid"),
    )
    q = F.col("q")
    good = F.coalesce(finite("q") & (F.abs(q - F.round(q)) <= FRACTION) & q.between(1, bins), F.lit(False))
    all_rows = rows.where(F.array_contains("masks", "tier2_rows")).agg(F.count(F.lit(1)).alias("all_rows"))
    seen = used.where(F.col("term") == index).select("row").distinct().agg(F.count(F.lit(1)).alias("seen_rows"))
    whole = column.crossJoin(F.broadcast(all_rows)).crossJoin(F.broadcast(seen))
    level = lambda c: F.count_distinct(F.when(c, F.round(q)))
    occupied = level(good & F.col("active"))
    return checks_from(whole, GATE, [
        (f"{index}_feature_support", "BLOCKING", F.count(F.when((F.col("has_q") == 1) & ~good, 1)) + F.lit(bins) - level(good) + F.coalesce(F.max(F.col("all_rows") - F.col("seen_rows")), F.lit(0)), "all bins, and nothing else, over the tier's rows"),
        (f"{index}_active_structural_support", "BLOCKING", F.greatest(F.lit(LEAST_BINS) - occupied, F.lit(0)), "at least five bins have responses"),
        (f"{index}_active_occupancy", "WARNING", F.lit(bins) - occupied, "bins without a response lean on their neighbours"),
        (f"{middle}_feature_alignment", "BLOCKING", F.count(F.when((F.col("has_q") != F.col("has_mid")) | ((F.col("has_mid") == 1) & ~F.coalesce(finite("mid"), F.lit(False))), 1)), "middles are finite and stand where the bins do"),
    ])


def shared_levels(stack: DataFrame, matrix: DataFrame, latent: DataFrame, terms: list[Term], levels: int, name: str = "quarter_group_count") -> DataFrame:
    """Whether the levels that several terms show together are 1 to ``levels``."""
    _, used, _ = _used(stack, matrix, latent, terms)
    seen = used.select("v").distinct()
    inside = finite("v") & (F.col("v") == F.round("v")) & F.col("v").between(1, levels)
    return checks_from(seen, GATE, [(name, "BLOCKING", F.lit(levels) - F.count(F.when(inside, 1)) + F.count(F.when(~inside, 1)), "the terms' levels together run from 1 to the last")])


def prediction_checks(counts: DataFrame) -> DataFrame:
    """counts: variable, nonfinite, of the variables that predictions need."""
    return checks_from(counts, GATE, [
        ("prediction_variables_audited", "BLOCKING", F.when(F.count(F.lit(1)) > 0, 0).otherwise(1), "the variables of predictions are audited"),
        ("prediction_required_variables_finite", "BLOCKING", F.count(F.when(~F.coalesce(F.col("nonfinite") == 0, F.lit(False)), 1)), "and finite"),
    ])


def theta_checks(theta: DataFrame, order: DataFrame) -> DataFrame:
    """theta: position, name, value of an earlier fit; order: position, name of the model at
    hand. Both start at the same position. Values are reused only where shape and order agree;
    here that is a warning."""
    both = theta.select("position", F.col("name").alias("_a"), "value", F.lit(1).alias("_t")).join(order.select("position", F.col("name").alias("_b"), F.lit(1).alias("_o")), "position", "full")
    return checks_from(both, GATE, [
        ("theta_shape", "WARNING", F.count(F.when(F.col("_t").isNull() | F.col("_o").isNull(), 1)) + F.count(F.when(F.col("_t").isNotNull() & ~finite("value"), 1)), "as many finite values as the model has"),
        ("theta_order_provenance", "WARNING", F.count(F.when(F.col("_t").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")), 1)), "in the model's order"),
    ])


def stack_preflight(stack: DataFrame, matrix: DataFrame, latent: DataFrame, *, columns: int, fixed: list[str], nodes: int, groups: int, bins: int, field_columns: tuple[int, int] | None = None, prediction: DataFrame | None = None, theta: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All checks of a stack, its matrix and its latent columns."""
    terms = [*fixed_terms(fixed), *random_terms(nodes, groups, bins)]
    field_groups = [t for t in terms if t.name.endswith("field_group")]
    parts = [
        response_checks(stack), projection_checks(stack, matrix, columns, field_columns), storage_checks(latent, terms, columns), term_checks(term_metrics(stack, matrix, latent, terms)),
        curve_support(stack, matrix, latent, bins), shared_levels(stack, matrix, latent, field_groups, groups),
    ]
    parts += [prediction_checks(prediction)] if prediction is not None else []
    parts += [theta_checks(*theta)] if theta is not None else []
    return reduce(lambda a, b: a.unionByName(b), parts)
