"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document (and its repeat) gets a virtual finish time: the words of
its source up to and including it, divided by the source's target. A global range
sort by that time, truncated at the total budget, serves all sources at their
targets together. No source is served beyond its target; where its next document is
too long for what is left of it, later ones that fit take the place.

All of a source's decisions are places in its queue up to which documents are taken, a
few numbers a source. So the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Apart, Workspace, running_total

#: Rounds in which shorter documents fill what is left of a source's target.
FILLS = 4
#: Places looked at in one such round: those of about so many times the words to fill.
REACH = 50
#: So many sources (a few hundred bytes each) are broadcast; more are joined.
BROADCAST_SOURCES = 50_000


def source_targets(ws: Workspace, sources: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """(source, source_size) with target: ``share`` of all sizes dealt by weight,
    stopped at ``most`` times the source's size, the excess dealt again until no
    target is above. Weights repeat over the sources in code-point order, null last.
    """
    ranked = running_total(ws, sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "sources")
    which = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ws.table(ranked.select("source", "source_size", which[(F.col("before") % len(weights)).cast("int")].alias("weight")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, stopped = share * total, 0.0, -1
    while True:  # the level only rises; each round stops at least one more source
        capped = F.lit(float(most)) * F.col("source_size") <= F.lit(level) * F.col("weight")
        n, held, free = ranked.agg(
            F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, F.col("source_size") * float(most))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, max(level, (budget - held) / free)
    target = F.least(F.col("source_size") * float(most), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _shuffle(seed: int, doc_id: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, size)


def _place(turn: Column, shuffle: Column, doc_id: Column, size: Column) -> Column:
    """A place in a source's queue; null ids come first."""
    return F.struct(turn.alias("turn"), shuffle.alias("shuffle"), doc_id.alias("doc_id"), size.alias("size"))


def _filled(ws: Workspace, queue: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (source, source_size, target, taken, cut) with ``fills``: an array of rounds
    (most, after, upto), each of which takes the documents of up to ``most`` words behind
    place ``after`` and not behind ``upto``."""
    state = cuts.select("source", "source_size", (F.floor("target") - F.col("taken")).alias("gap"), F.col("cut").alias("after"), F.array().cast("array<struct<most:long,after:struct<turn:int,shuffle:long,doc_id:long,size:long>,upto:struct<turn:int,shuffle:long,doc_id:long,size:long>>>").alias("fills"))
    queue = queue.select("source", "size", "mass", "turn", "shuffle", "place")
    for k in range(FILLS):
        state = ws.table(state, f"fill{k}")
        short = state.where("gap > 0").select(F.col("source").alias("s"), "gap", "after", "source_size")
        # Hashes are even, so a slice of them behind the last place holds about the words wanted.
        slice_ = F.least(F.lit(1.0), F.lit(float(REACH)) * F.col("gap") / F.col("source_size")) * F.lit(2.0**64)
        turn, low = F.coalesce(F.col("after.turn"), F.lit(0)), F.coalesce(F.col("after.shuffle").cast("double"), F.lit(-(2.0**63)))
        ahead = (F.col("turn") - turn) * F.lit(2.0**64) + F.col("shuffle").cast("double") - low
        near = queue.join(short, queue["source"].eqNullSafe(F.col("s")) & (F.col("size") <= F.col("gap")))
        near = near.where((F.col("after").isNull() | (F.col("place") > F.col("after"))) & (ahead <= slice_) & (F.col("mass") > 0))
        so_far = F.sum("mass").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        fits = so_far <= F.col("gap")
        got = near.withColumn("fits", fits).groupBy("source").agg(
            F.sum(F.when(F.col("fits"), F.col("mass"))).alias("more"), F.max(F.when(F.col("fits"), F.col("place"))).alias("upto"), F.coalesce(F.min(F.when(~F.col("fits"), F.col("place"))), F.max("place")).alias("next")
        ).withColumnRenamed("source", "g")
        state = state.join(got, state["source"].eqNullSafe(got["g"]), "left")
        round_ = F.array(F.struct(F.col("gap").alias("most"), F.col("after"), F.col("upto")))
        state = state.select("source", "source_size", (F.col("gap") - F.coalesce("more", F.lit(0))).alias("gap"), F.coalesce("next", "after").alias("after"), F.when(F.col("upto").isNotNull(), F.concat("fills", round_)).otherwise(F.col("fills")).alias("fills"))
    done = state.select(F.col("source").alias("f"), "fills")
    return cuts.join(done, cuts["source"].eqNullSafe(done["f"])).drop("f")


def mix_cuts(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """Where each source's queue is cut: (source, source_size, target, cut, fills).

    docs needs doc_id (an integer), text and source; other columns are ignored. Size is the
    number of words (null or empty text: 0). Rows with equal doc_id, source and size
    are decided together, as one. Documents without words get no copies. A null
    source is a source, and a null doc_id an id, of its own. Empty docs: no rows.
    """
    spark = docs.sparkSession
    with Workspace(spark, "mix") as ws:
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
        keys = ws.table(sized.groupBy("doc_id", "source", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("mass")), "sized")
        sources = keys.groupBy("source").agg(F.sum("mass").alias("source_size"))
        targets = ws.table(source_targets(ws, sources, weights, share, float(repeats)), "targets")
        shuffled = keys.withColumn("shuffle", _shuffle(seed, F.col("doc_id"), F.col("size")))
        order = [F.col("source").asc_nulls_last(), "shuffle", "doc_id", "size"]
        placed = running_total(ws, shuffled, order, "mass", "placed")
        firsts = placed.groupBy("source").agg(F.min("before").alias("first"))
        goals = firsts.join(targets, firsts["source"].eqNullSafe(targets["source"])).select(firsts["source"].alias("s"), "first", "source_size", "target")
        dealt = placed.join(goals, placed["source"].eqNullSafe(goals["s"])).drop("s")
        turns = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        served = (F.col("turn") * F.col("source_size") + F.col("before") - F.col("first") + F.col("mass")) / F.nullif(F.col("target"), F.lit(0.0))
        queue = turns.select("doc_id", "source", "size", "mass", "source_size", "target", "shuffle", "turn", served.alias("finish"))
        queue = running_total(ws, queue, [F.col("finish").asc_nulls_last(), "turn", "shuffle", "source", "doc_id", "size"], "mass", "queue")
        queue = queue.withColumn("place", _place(F.col("turn"), F.col("shuffle"), F.col("doc_id"), F.col("size")))
        budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
        # The slack is for sums of doubles; a document is one word at least.
        fits = (F.col("before") + F.col("mass") <= F.lit(budget + 1e-3)) & (F.col("finish") <= 1 + 1e-12)
        taken = F.sum(F.when(fits, F.col("mass")).otherwise(0))
        cuts = queue.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), taken.alias("taken"), F.max(F.when(fits, F.col("place"))).alias("cut"))
        return ws.result(_filled(ws, queue, ws.table(cuts, "cuts")).drop("taken"))


def _copies(size: Column, doc_id: Column, repeats: int, seed: int) -> Column:
    """How often a document of ``size`` words is taken, by its source's cut and fills."""
    total = F.lit(0)
    for turn in range(repeats):
        at = _place(F.lit(turn), _shuffle(seed, doc_id, size), doc_id, size)
        filled = F.exists("fills", lambda f: (size <= f["most"]) & (f["after"].isNull() | (at > f["after"])) & (at <= f["upto"]))  # noqa: B023
        total = total + F.when(F.coalesce(at <= F.col("cut"), F.lit(False)) | filled, 1).otherwise(0)
    return F.when(size > 0, total).otherwise(0)


def _decided(docs: DataFrame, weights: tuple, share: float, repeats: int, seed: int) -> tuple[Apart, DataFrame]:
    """docs' columns set apart, and its rows with size, source_size, target and copies."""
    cuts = mix_cuts(docs, weights, share, repeats, seed).withColumnRenamed("source", "of")
    apart = Apart(docs)
    doc_id, source = apart["doc_id"].cast("long"), apart["source"]
    rows = apart.df.withColumn("size", word_count(apart["text"]))
    few = cuts.count() <= BROADCAST_SOURCES
    # More sources than that are joined; a hot source's cuts are then one row that AQE splits around.
    rows = rows.join(F.broadcast(cuts) if few else cuts, source.eqNullSafe(F.col("of")))
    return apart, rows.withColumn("copies", _copies(F.col("size"), doc_id, repeats, seed))


def mix_report(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """One row a row of docs: doc_id, size, source_size, target, taken (its words in
    the mix, repeats counted). See ``mix_cuts`` for nulls, ties and repeated rows."""
    apart, rows = _decided(docs, weights, share, repeats, seed)
    return rows.select(apart["doc_id"].alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay, whatever their
    names. No row comes more than ``repeats`` times; the same input gives the same mix."""
    apart, rows = _decided(docs, weights, share, repeats, seed)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))))
    return apart.back(rows)
