"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from water-filling over the sources (closed form over one row per source).  A source
takes floor(target / size) complete epochs, and the rest by weighted sampling without
replacement: each document draws an exponential key -ln(u) / quality, keys are sorted within the
source, and documents are taken while their prefix sum stays within the budget.

The prefix sum is distributed: keys are cut into bins, bin sums are added up per source, and only
the one bin in which a budget ends is sorted, so a source with a third of all rows doesn't meet
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenql.llm.shared import saved

WEIGHTS = (3, 1, 2)


def size_of(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    squeezed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def quality_of(text: str = "text") -> Column:
    """Quality weight in 0.1 .. 1: falls with the share of symbol characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.length(t), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh weights[0], weights[1], ... in turn.  Targets share
    `share` of all sizes by weight, none over `most` times its size; what goes beyond is shared
    again among the others.  The level at which sources stop is found from running sums in the
    order of size per weight."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("left_", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_") / F.col("open_w"))
    # the first source that isn't filled to its cap sets the level of all after it
    s = s.withColumn("turn", F.row_number().over(fill))
    first = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("turn", "level"))).over(everything)
    s = s.withColumn("final", first.getField("level"))
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def mixed(docs: DataFrame, size: Column, quality: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, bins: int = 4096) -> DataFrame:
    """docs with size, source_size, target, taken and copies (how often a document is taken).

    Keys depend on doc_id and text only, so reruns agree; a null doc_id is drawn by its text.  Documents of size 0 and null
    sources are ordinary members.  Of a source's last, fractional epoch the documents are taken whose half lies within
    the budget, so that a source misses its target by half a document at most; of rows alike in doc_id and text that
    the budget ends among, as many are taken as fit.  No row is taken more than `most` times.  Texts stay
    where they are: what is sorted and shuffled is keys and sizes, and each source's cut comes back as one row.  Other
    columns are kept whatever their names; those named like the new ones are replaced."""
    named = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), text), F.lit("mix")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    drawn = docs.select(F.struct(*(F.col(f"`{c}`") for c in named)).alias("_row"), "source", size.cast("long").alias("size"), (-F.log(u) / quality).alias("_key"), F.concat(digest, text).alias("_tie"))
    # an exponential key scaled to [0, 1): bins of about equal rows, none outside
    drawn = drawn.withColumn("_at", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.lit(float(bins))).cast("int"))
    # rows alike are one class, so that repeats meet in no task
    slim = saved(drawn.groupBy("source", "_at", "_key", "_tie", "size").agg(F.count("*").alias("_n")), "zmixing")
    words = F.sum(F.col("size") * F.col("_n"))
    goal = targets(slim.groupBy("source").agg(words.alias("source_size")), weights, share, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long")
    goal = saved(goal.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "zgoals")
    sums = slim.groupBy("source", F.col("_at").alias("_bin")).agg(words.alias("_sum"))
    ahead = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = goal.select(F.col("source").alias("_source"), "_rest")
    plan = ahead.join(g, F.col("source").eqNullSafe(F.col("_source"))).select("_source", "_bin", "_rest", "_before", (F.col("_before") + F.col("_sum")).alias("_after"))
    whole = plan.where("_after <= _rest").groupBy("_source").agg(F.max("_bin").alias("_last"))
    # the one bin of a source in which its budget ends
    ends = plan.where("_after > _rest and _before <= _rest")
    inside = slim.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_bin")))
    upto = F.sum(F.col("size") * F.col("_n")).over(Window.partitionBy("_source", "_bin").orderBy("_key", "_tie", "size").rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"), F.col("size").alias("s"))
    room = F.col("_rest") - F.col("_before") - (upto - F.col("size") * F.col("_n"))
    fit = F.when(F.col("size") == 0, F.when(room >= 0, F.col("_n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("_n"), F.floor(room / F.col("size") + F.lit(0.5)))))
    cut = inside.withColumn("_fit", fit).where("_fit > 0").groupBy("_source", "_bin").agg(F.max(F.struct(place.alias("p"), "_fit", "_n")).alias("_m"))
    cut = cut.select("_source", "_bin", F.col("_m.p").alias("_cut"), F.col("_m._fit").alias("_fit"), F.col("_m._n").alias("_of"))
    o, w, c = goal.alias("o"), whole.alias("w"), cut.alias("c")
    sources = o.join(w, F.col("o.source").eqNullSafe(F.col("w._source")), "left").join(c, F.col("o.source").eqNullSafe(F.col("c._source")), "left")
    sources = saved(sources.select(F.col("o.source").alias("_source"), "source_size", "target", "_epochs", "_last", F.col("c._bin").alias("_end"), "_cut", "_fit", "_of"), "zsources")
    # one row a source: broadcast while Spark finds it small, a skew-split sort-merge join beyond
    rows = drawn.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    more = F.when(F.col("_at") <= F.col("_last"), 1).when((F.col("_at") == F.col("_end")) & (place <= F.col("_cut")), 1).otherwise(0)
    rows = rows.withColumn("_more", more.cast("long"))
    if not sources.where("_fit < _of").isEmpty():
        # some rows alike are taken and some not: those rows are written with a number, counted by task, and dealt from the first on
        edge = (F.col("_at") == F.col("_end")) & (place == F.col("_cut")) & (F.col("_fit") < F.col("_of"))
        edge = F.coalesce(edge, F.lit(False))
        alike = saved(rows.where(edge).withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)), "zedge")
        tally = alike.groupBy("source", "_task").agg(F.count("*").alias("_here"))
        first = F.coalesce(F.sum("_here").over(Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tally = tally.select(F.col("source").alias("_s"), F.col("_task").alias("_t"), first.alias("_first"))
        dealt = alike.join(tally, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
        turn = F.col("_first") + F.row_number().over(Window.partitionBy("source", "_task").orderBy("_id"))
        dealt = dealt.withColumn("_more", F.when(turn <= F.col("_fit"), 1).otherwise(0).cast("long")).select(*rows.columns)
        rows = rows.where(~edge).unionByName(dealt)
    copies = F.least(F.col("_epochs") + F.col("_more"), F.lit(int(most)).cast("long"))
    return rows.select("_row.*", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken; an empty table gives an empty one."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), "doc_id", "source", "text")
    chosen = mixed(whole, size_of(), quality_of()).where("copies > 0")
    return chosen.select("_all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_all.*")
