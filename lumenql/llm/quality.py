"""Quality rules with thresholds that adapt to each language and source.

Every text is measured inside the JVM with built-in functions; the ratios of all texts go into
log-linear histograms, which are mergeable quantile sketches with a relative error of 1/32:
counts of a bin add up, so source sketches merge into language sketches and those into one of
the corpus.  Each (language, source) gets its quartiles from the finest level that has enough
texts, an upper fence is drawn from them, and joining the fences filters the documents.

The sketches are exact integers, so reruns agree, and hot sources cost nothing: Spark adds bin
counts before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenql.llm.shared import saved

SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
#: Words up to which a window's hash keeps so many bits beside its place that two differing ones don't meet.
_PACKED = 1 << 16
#: metric -> least distance between the upper quartile and the fence, in thousandths.
SLACK = {"symbols": 50, "dup_lines": 350, "marks": 100, "word_length": 4000}


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_percent are the base rules; a fence is q75 + spread * (q75 - q25) plus the metric's slack;
    levels with fewer than min_group texts lend from the next coarser one."""

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 4
    min_group: int = 30


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks and n_lines (all long).

    A null or empty text has zeros.  The repeated 3-word windows are found by sorting (hash, place), so a text of n
    words costs n log n however repetitive it is; in texts of usual length both are packed into one integer, of which the
    place takes as many bits as the text needs."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(F.struct(*kept).alias("_docs"), F.col(f"`{text}`").alias("_text"))
    step = step.withColumn("_t", F.btrim(F.coalesce(F.col("_text"), F.lit("")), F.lit(BLANK)))
    step = step.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACE)))
    step = step.withColumn("_l", F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("_j", F.array_join("_w", ""))
    step = step.withColumn("_n", F.size("_w")).withColumn("_b", F.length(F.bin(F.size("_w").cast("long"))))
    step = step.withColumn(
        "_g",
        F.when(
            F.col("_n") >= 3,
            F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))), F.lit(1), F.col("_n") - 2),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    right, left = (lambda v, name=name: F.call_function(name, v, F.col("_b")) for name in ("shiftright", "shiftleft"))
    low = left(F.lit(1).cast("long")) - 1
    few = F.col("_n") <= _PACKED
    none = F.array().cast("array<bigint>")
    step = step.withColumn("_s", F.when(few, F.sort_array(F.transform("_g", lambda g, i: left(right(g)).bitwiseOR(i.cast("long"))))).otherwise(none))
    pairs = F.transform("_g", lambda g, i: F.struct(g.alias("h"), i.cast("long").alias("i")))
    step = step.withColumn("_x", F.when(few, F.array().cast("array<struct<h: bigint, i: bigint>>")).otherwise(F.sort_array(pairs)))

    def same(v: Column, other: Column) -> Column:
        at = lambda x: F.get("_g", x.bitwiseAND(low).cast("int"))
        return F.coalesce((right(v) == right(other)) & (at(v) == at(other)), F.lit(False))

    alike = lambda v, other: F.coalesce(v["h"] == other["h"], F.lit(False))
    packed = F.filter("_s", lambda v, k: same(v, F.get("_s", k - 1)) | same(v, F.get("_s", k + 1)))
    exact = F.filter("_x", lambda v, k: alike(v, F.get("_x", k - 1)) | alike(v, F.get("_x", k + 1)))
    step = step.withColumn("_p", F.sort_array(F.concat(F.transform(packed, lambda v: v.bitwiseAND(low)), F.transform(exact, lambda v: v["i"]))))
    covered = F.aggregate(
        F.transform("_p", lambda v, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_p", k + 1) - v, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    found = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length("_j").cast("long"),
        "n_symbols": F.length(F.regexp_replace("_j", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": covered,
        "n_marks": F.length(F.regexp_replace("_j", r"[^!]+", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
    }
    # a generator of one row: filters on the measures stay above it, where each is computed once
    return step.select("_docs.*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in found.items())))))


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Ratios in thousandths, as long."""

    def per(top: str, under: str) -> Column:
        return F.coalesce(F.expr(f"{top} * 1000 div nullif({under}, 0)"), F.lit(0)).cast("long")

    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "marks": per("n_marks", "n_words"), "word_length": per("word_chars", "n_words")}


def sketches(features: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bin, n): a mergeable histogram for each metric of each group and of the two coarser levels.

    A bin keeps the six highest bits of a value."""
    shift = "greatest(length(bin(value)) - 6, 0)"
    named = F.expr("stack(" + f"{len(SLACK)}, " + ", ".join(f"'{m}', m_{m}" for m in SLACK) + ") as (metric, value)")
    fine = (
        features.where(F.col("n_words") > 0)
        .select("lang", "source", *(c.alias(f"m_{m}") for m, c in metrics().items()))
        .select("lang", "source", named)
        .withColumn("bin", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})"))
        .groupBy("lang", "source", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )
    merged = lambda level, *gone: fine.withColumns({c: F.lit(None).cast("string") for c in gone}).groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
    return fine.withColumn("level", F.lit(2)).unionByName(merged(1, "source")).unionByName(merged(0, "lang", "source"))


def fences(features: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, fence_<metric>...): one row for each group that has a text with words."""
    of = ["level", "lang", "source", "metric"]
    run = Window.partitionBy(*of).orderBy("bin")
    ranked = sketches(features).withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*of)))
    quartiles = ranked.groupBy(*of).agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q75"),
    )
    slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))
    quartiles = quartiles.withColumn("fence", F.col("q75") + rules.spread * (F.col("q75") - F.col("q25")) + slack[F.col("metric")])
    wide = quartiles.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(m) for m in SLACK))
    at = lambda level: wide.where(F.col("level") == level).drop("level")
    fine = at(2).withColumn("source", F.col("source")).alias("f")
    lang, every = at(1).drop("source").alias("l"), at(0).drop("lang", "source").alias("e")
    # the corpus level has one row at most
    joined = fine.join(lang, F.col("f.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    return joined.select(
        F.col("f.lang").alias("lang"),
        F.col("f.source").alias("source"),
        *(
            F.when(F.col("f.total") >= rules.min_group, F.col(f"f.{m}")).when(F.col("l.total") >= rules.min_group, F.col(f"l.{m}")).otherwise(F.col(f"e.{m}")).alias(f"fence_{m}")
            for m in SLACK
        ),
    )


_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines", "base_failed", "kept")


def _verdict(measured: DataFrame, limits: DataFrame, rules: QualityRules) -> DataFrame:
    """measured with base_failed and kept, by the fences of its language and source.

    The join is left to Spark's own size check: fences are broadcast while small, a skew-split sort-merge join beyond."""
    d, t = measured.alias("d"), limits.alias("t")
    joined = d.join(t, F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    within = F.lit(True)
    for m, value in metrics().items():
        within = within & ((value <= F.col(f"t.fence_{m}")) | F.col(f"t.fence_{m}").isNull())
    failed = base_failed(rules)
    return joined.select("d.*", failed.alias("base_failed"), (~failed & within).alias("kept"))


def judged(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """docs without `text` (of which `text`, lang and source are read) with features, base_failed and kept.

    Nulls in lang or source form groups of their own, repeated rows are judged alike, an empty
    table gives an empty result, and columns of `docs` with the names of features are replaced.
    The measures are written once, for the sketches and the filter both."""
    measured = saved(with_features(docs.drop(*_ADDED), text).drop(text), "zquality")
    return _verdict(measured, fences(measured, rules), rules)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept documents with their columns, whatever their names.

    Texts are measured once for the fences and again for the verdict, so that none is written or shuffled."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "lang", "source", "text")
    limits = saved(fences(with_features(whole.drop("_row")).drop("text"), rules), "zfences")
    return _verdict(with_features(whole).drop("text"), limits, rules).where("kept").select("_row.*")
