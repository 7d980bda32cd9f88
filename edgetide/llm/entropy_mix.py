"""Mixing sources to target weights by entropy balancing (operator 3, DataFrame functions only).

Every document gets a rate between 0 and 2 copies. Among all rates that give each source its target of words, the
chosen ones are closest to one copy each in (Fermi) entropy; by the convex dual they are exponential tilts
``rate = 2 / (1 + exp(-theta_source * size / scale_source))``. One ``theta`` per source is found by damped Newton steps;
each step is one aggregation over the histogram of (source, size), which is all that the rates depend on.

Rates become copies in three steps. Along the sizes of a source, running sums of rates are rounded, which gives each
(source, size) cell whole copies. What a source still lacks or has too much is settled on one cell per power of two,
largest sizes first. Within a cell, copies are dealt evenly, the odd ones by the order of a hash of doc_id; positions
come from counts by bucket, so a cell with a third of all rows is dealt by many tasks.

Defined results: a null text has size 0 and is never taken; null is a source of its own, the last; repeated rows are
documents of their own; where all sizes are 0 all targets are 0; an empty table gives an empty table; extra columns are
carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch, fresh, word_count

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE, MOST = 1.5, 2  # words of the mix to words there are; copies of a document
STEPS, TOLERANCE = 60, 1e-9
FAILURE = 1e-6  # a gap of that share of a source after all steps is an error
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also ``target``: shares by weight, none above its cap.

    Resharing what capped sources leave ends where the open ones all stand at one level of target by weight. Sorted by
    cap and weight, that level is the first that does not exceed the source's own.
    """
    rank = "row_number() over (order by source asc nulls last) - 1"
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.expr(rank) % len(WEIGHTS) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    ordered = "over (order by cap / weight, source nulls last rows between"
    levels = ranked.withColumn("total", F.expr("sum(source_size) over ()") * SHARE).withColumn(
        "capped", F.coalesce(F.expr(f"sum(cap) {ordered} unbounded preceding and 1 preceding)"), F.lit(0.0))).withColumn(
        "open", F.expr(f"sum(weight) {ordered} current row and unbounded following)")).withColumn(
        "level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))
    return levels.withColumn("fit", fits).withColumn("found", F.expr("min(fit) over ()")["level"]).select(
        "source", "source_size", F.least("cap", F.col("found") * F.col("weight")).alias("target"))


def _tilt(theta: Column, x: Column) -> Column:
    return MOST / (1 + F.exp(-theta * x))


def solve(cells: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """``targets`` with ``theta`` and ``scale``; a source at its cap needs no theta, its rate is 2 (theta null)."""
    scales = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(
        F.col("n") * F.col("size"))).alias("scale"))
    state = scratch.save(
        targets.alias("t").join(scales.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select(
            "t.*", F.coalesce("scale", F.lit(1.0)).alias("scale"),
            F.when(F.col("target") < MOST * F.col("source_size") * (1 - 1e-12), 0.0).alias("theta"),
            F.lit(1.0).alias("gap")), "theta-0")
    for step in range(1, STEPS + 1):
        rate, x = _tilt(F.col("theta"), F.col("x")), F.col("x")
        sums = cells.alias("c").join(state.alias("s"), F.col("s.source").eqNullSafe(F.col("c.source"))).select(
            "c.source", "n", "size", "theta", (F.col("size") / F.col("scale")).alias("x")).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / MOST)).alias("slope"))
        move = (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-9))
        bound = 1 + F.abs("theta")
        seen = Observation(f"gap-{uuid.uuid4().hex}")
        moved = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
            "s.source", "source_size", "target", "scale",
            (F.col("theta") + F.greatest(-bound, F.least(bound, move))).alias("theta"),
            F.coalesce(F.abs(F.col("target") - F.col("got")) / F.greatest("source_size", F.lit(1)), F.lit(0.0)).alias("gap"))
        state = scratch.save(moved.observe(seen, F.max("gap").alias("gap")), f"theta-{step}")
        gap = seen.get["gap"] or 0.0
        if gap <= TOLERANCE:
            break
    else:
        if gap > FAILURE:
            raise RuntimeError(f"the mix is {gap:.1e} of a source off its target after {STEPS} steps")
    return state


def cell_copies(cells: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """Whole copies for each (source, size) cell: ``copies`` next to ``rate``, within 0 and 2 n."""
    rated = cells.alias("c").join(state.alias("s"), F.col("s.source").eqNullSafe(F.col("c.source"))).select(
        "c.source", "size", "n", "target", "source_size",
        F.when(F.col("target") <= 0, 0.0).otherwise(F.coalesce(
            _tilt(F.col("theta"), F.col("size") / F.col("scale")), F.lit(float(MOST)))).alias("rate"))
    upto = "sum(n * rate) over (partition by source order by size rows between unbounded preceding and"
    counted = rated.withColumn("copies", (
        F.floor(F.expr(f"{upto} current row)") + 0.5) - F.floor(F.coalesce(F.expr(f"{upto} 1 preceding)"), F.lit(0.0)) + 0.5)))
    counted = scratch.save(counted.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), MOST * F.col("n"))).cast("long")), "counted")

    # one cell for each power of two of the sizes: at most 64 for a source, whatever the corpus
    classes = counted.filter("size > 0").groupBy("source", F.floor(F.log2("size")).alias("class")).agg(
        F.max_by(F.struct("size", "n", "copies"), F.struct("n", "size")).alias("cell"))
    lacks = counted.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))

    def settle(state: Column, cell: Column) -> Column:
        wanted = F.when(cell["last"], F.round(state["lack"] / cell["size"])).otherwise(
            F.signum(state["lack"]) * F.floor(F.abs(state["lack"]) / cell["size"]))
        more = F.greatest(-cell["copies"], F.least(MOST * cell["n"] - cell["copies"], wanted.cast("long")))
        return F.struct((state["lack"] - more * cell["size"]).alias("lack"),
                        F.concat(state["moved"], F.array(F.struct(cell["size"].alias("size"), more.alias("more")))).alias("moved"))

    least = F.expr("array_min(transform(cells, x -> x.size))")
    listed = classes.groupBy("source").agg(F.sort_array(F.collect_list("cell"), asc=False).alias("cells")).withColumn(
        "cells", F.transform("cells", lambda c: F.struct(c["size"].alias("size"), c["n"].alias("n"), c["copies"].alias("copies"), (c["size"] == least).alias("last"))))
    start = F.struct(F.col("lack").cast("double").alias("lack"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("moved"))
    moved = listed.alias("l").join(lacks.alias("k"), F.col("l.source").eqNullSafe(F.col("k.source"))).select(
        "l.source", F.aggregate("cells", start, settle)["moved"].alias("moved")).select("source", F.inline("moved"))
    return counted.alias("c").join(
        moved.alias("m"), F.col("m.source").eqNullSafe(F.col("c.source")) & (F.col("m.size") == F.col("c.size")), "left").select(
        "c.source", "c.size", "n", "target", "source_size", "rate", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``_mix``: size, source_size, target, rate, copies and taken (words) of each row."""
    scratch = Scratch(docs.sparkSession)
    name, at = fresh(docs, "_mix"), fresh(docs, "_at")
    sized = docs.withColumn(at, F.struct(F.col("source").alias("source"), word_count(F.col("text")).alias("size"),
                                         F.xxhash64("doc_id").alias("hash")))
    counts = scratch.save(sized.select(f"{at}.*").groupBy("source", "size", F.pmod("hash", F.lit(65_536)).alias("part")).agg(
        F.count(F.lit(1)).alias("n")), "counts")
    cells = scratch.save(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    dealt = cell_copies(cells, solve(cells, scratch.save(targets, "targets"), scratch), scratch)

    # positions in a cell: those of the buckets before, then the order within the bucket
    total = cells.agg(F.sum("n")).first()[0] or 0
    buckets = 1
    while buckets < 65_536 and buckets * BUCKET_ROWS < total:
        buckets *= 2
    bucketed = counts.groupBy("source", "size", F.pmod("part", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))
    before = "sum(n) over (partition by source, size order by bucket rows between unbounded preceding and 1 preceding)"
    placed = bucketed.withColumn("before", F.coalesce(F.expr(before), F.lit(0))).drop("n")
    same = F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.size") == F.col("d.size"))
    lookup = scratch.save(placed.alias("p").join(dealt.alias("d"), same).select(
        "p.source", "p.size", "p.bucket", F.struct("source_size", "target", "rate", "before", "n", "copies").alias("cell")), "lookup")

    rows = sized.withColumn(at, F.struct(
        *(F.col(f"{at}.{c}").alias(c) for c in ("source", "size", "hash")), F.pmod(F.col(f"{at}.hash"), F.lit(buckets)).alias("bucket")))
    keys = {c: fresh(docs, f"_{c}") for c in ("source", "size", "bucket", "hash", "place")}
    for c in ("source", "size", "bucket", "hash"):
        rows = rows.withColumn(keys[c], F.col(f"{at}.{c}"))
    by = ", ".join(f"`{keys[c]}`" for c in ("source", "size", "bucket"))
    rows = rows.drop(at).withColumn(keys["place"], F.expr(f"row_number() over (partition by {by} order by `{keys['hash']}`) - 1"))
    lookup = lookup.select(F.col("source").alias("l_source"), F.col("size").alias("l_size"), F.col("bucket").alias("l_bucket"), F.col("cell").alias("l_cell"))
    for c in ("source", "size", "bucket", "cell"):
        lookup = lookup.withColumnRenamed(f"l_{c}", fresh(rows, f"_l_{c}"))
    l_source, l_size, l_bucket, l_cell = lookup.columns
    joined = rows.join(lookup, F.col(keys["source"]).eqNullSafe(F.col(l_source)) & (F.col(keys["size"]) == F.col(l_size))
                       & (F.col(keys["bucket"]) == F.col(l_bucket)))
    cell, size = F.col(l_cell), F.col(keys["size"])
    place = cell["before"] + F.col(keys["place"])
    copies = F.floor(cell["copies"] / cell["n"]) + F.when(place < cell["copies"] % cell["n"], 1).otherwise(0)
    return joined.withColumn(name, F.struct(
        size.alias("size"), cell["source_size"].alias("source_size"), cell["target"].alias("target"), cell["rate"].alias("rate"),
        copies.cast("long").alias("copies"), (copies * size).cast("long").alias("taken"))).drop(*keys.values(), *lookup.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as it is taken, its columns as they were."""
    name, nth = fresh(docs, "_mix"), fresh(docs, "_nth")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = mix(docs).filter(F.col(f"{name}.copies") > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).select(columns)
