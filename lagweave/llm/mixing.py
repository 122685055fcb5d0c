"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected number of copies grows with its
length class and is scaled so that the expectations of a source add up to its target, at most two
copies each. The whole part of an expectation is allocated for certain; what is left of the target is
filled by a Pareto sample: documents are ranked by the odds of a hashed uniform number divided by the
odds of their inclusion, and the lowest ranks are taken until the words reach the rest of the target.
The cut is found by narrowing a histogram of ranks twice, so no source is ever sorted in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm.common import lookup_join, pin, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2.0
#: Length class c (rounded log2 of the words) is preferred by 1 + c * PREFERENCE.
PREFERENCE = 0.1
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _indexed(sources: DataFrame) -> DataFrame:
    """sources (pinned, one row each) with their place by code point, null last; ranges are counted apart, then offset."""
    parts = max(1, min(256, sources.count() // 10_000))
    key = F.encode("source", "UTF-8")
    ranged = sources.withColumn("_null", F.col("source").isNull())
    ranged = (ranged.repartitionByRange(parts, "_null", key) if parts > 1 else ranged.coalesce(1)).sortWithinPartitions("_null", key)
    ranged = pin(ranged.select("*", F.monotonically_increasing_id().alias("_id")), "sources")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("p")).count().collect()  # at most 256 rows
    sizes = {r["p"]: r["count"] for r in counts}
    before = [sum(sizes.get(q, 0) for q in range(p)) for p in range(max(sizes, default=0) + 1)]
    # Not a table of the driver's rows: that would start Python workers of another kind on the executors, which stay.
    start = F.get(F.array(*map(F.lit, before)).cast("array<long>"), part.cast("int"))
    return ranged.withColumn("place", start + F.col("_id") - F.shiftleft(part, 33)).drop("_null", "_id")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: weights by place share `share` of all words; a target stops at `most` times its
    source's words and what it leaves is shared out again by weight, until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    known = pin(_indexed(sources).select("source", "source_size", weight.alias("weight")), "weights")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while True:
        free = most * F.col("source_size") > F.lit(level) * F.col("weight")
        r = known.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, most * F.col("source_size"))).alias("c"), F.count(F.when(~free, 1)).alias("n")
        ).first()
        if r["n"] == capped_before or not r["w"]:
            break
        capped_before, level = r["n"], (share * total - (r["c"] or 0.0)) / r["w"]
    target = F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double")
    return known.select("source", "source_size", target.alias("target"))


def _expectations(classes: DataFrame, most: float) -> DataFrame:
    """source, class, expected copies e = min(most, scale * preference), scaled so that the words expected meet the target."""

    def solve(batches):
        for b in batches:
            out = []
            for source, target, got in zip(b["source"], b["target"], b["classes"], strict=True):
                got = [(int(g["class"]), float(g["words"])) for g in got]
                low, high = 0.0, most
                for _ in range(60):
                    mid = (low + high) / 2
                    reached = sum(w * min(most, mid * (1 + PREFERENCE * c)) for c, w in got)
                    low, high = (mid, high) if reached < target else (low, mid)
                out += [(source, c, min(most, high * (1 + PREFERENCE * c))) for c, _ in got]
            yield pd.DataFrame(out, columns=["source", "class", "expected"]).astype({"class": "int32", "expected": "float64"})

    # A source has at most 64 classes.
    grouped = classes.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("class", "words"))).alias("classes"))
    return grouped.mapInPandas(solve, "source string, class int, expected double")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 17,
) -> DataFrame:
    """One row per input row: id_col, size, source_size, target, copies, taken (= copies * size).

    Null texts have size 0 and, like texts without words, take nothing; null sources form one source,
    last in order. Draws are hashed from ids, so reruns agree; rows with one id share a draw and ties
    are broken by size. An empty table gives an empty result. Other columns of docs are not read.
    """
    size = word_count(F.col(text_col))
    rows = pin(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    rows = rows.withColumn("class", F.round(F.log2(F.col("size") + 1)).cast("int"))
    by_class = pin(rows.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "classes")
    goals = pin(targets(pin(by_class.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), "totals"), weights, share, most), "goals")
    expected = _expectations(by_class.join(goals, by_class["source"].eqNullSafe(goals["source"])).drop(goals["source"]), most)
    sized = by_class.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    expected = pin(expected.join(sized.withColumnsRenamed({"source": "_s", "class": "_c"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).drop("_s", "_c"), "expected")

    whole = F.floor(F.col("expected") + 1e-9)
    chance = F.least(F.greatest(F.col("expected") - whole, F.lit(0.0)), F.lit(1 - 1e-9))
    draw = ((F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11)).cast("double") + 0.5) / float(1 << 53)
    ranked = lookup_join(rows, expected.drop("words"), ["source", "class"], weight="n").withColumns({"whole": whole, "chance": chance, "draw": draw})
    ratio = (F.col("draw") / (1 - F.col("draw"))) / (F.col("chance") / (1 - F.col("chance")))
    ranked = pin(ranked.withColumn("rank", F.when(F.col("chance") > 1e-9, ratio / (1 + ratio))).select("id", "source", "size", "whole", "rank"), "ranked")

    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.count("*").alias("n"))
    certain = certain.withColumnRenamed("source", "_s")
    state = pin(
        goals.join(certain, F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", (F.col("target") - F.col("certain")).alias("rest"), "n"), "state"
    )
    # Twice: the words of each of BINS bins of ranks, and the bin in which the rest of the target is reached.
    low, width, done = F.lit(0.0), 1.0, 0.0
    cut = state.withColumns({"low": low, "done": F.lit(done)})
    for _ in range(2):
        at = lookup_join(ranked.filter("rank IS NOT NULL AND size > 0"), cut.select("source", "low", "n"), ["source"], weight="n")
        bin_ = F.floor((F.col("rank") - F.col("low")) / F.lit(width / BINS)).cast("int")
        bins = at.withColumn("bin", bin_).filter(f"bin BETWEEN 0 AND {BINS - 1}").groupBy("source", "bin").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most BINS rows a source
        bins = bins.withColumn("upto", upto).withColumnRenamed("source", "_s")
        b = cut.join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("done") + F.col("upto") < F.col("rest")), "left")
        b = b.groupBy("source", "source_size", "target", "rest", "n", "low", "done").agg(F.max("bin").alias("bin"), F.max("upto").alias("upto"))
        # The next bin that has rows holds the cut.
        first = F.coalesce(F.col("bin"), F.lit(-1))
        nxt = bins.select(F.col("_s").alias("_t"), F.col("bin").alias("_b"))
        c = b.withColumn("first", first).join(nxt, F.col("source").eqNullSafe(F.col("_t")) & (F.col("_b") > F.col("first")), "left")
        c = c.groupBy("source", "source_size", "target", "rest", "n", "low", "done", "upto").agg(F.min("_b").alias("hit"))
        cut = pin(
            c.select(
                "source", "source_size", "target", "rest", "n",
                (F.col("low") + F.coalesce(F.col("hit"), F.lit(BINS)) * F.lit(width / BINS)).alias("low"),
                (F.col("done") + F.coalesce("upto", F.lit(0))).cast("double").alias("done"),
            ), "cut"
        )
        width /= BINS
    final = lookup_join(ranked, cut, ["source"], weight="n").withColumn(
        "place", F.when((F.col("rank") < F.col("low")), -1).when(F.col("rank") < F.col("low") + F.lit(width), 0).otherwise(1)
    )
    # About 1 row in BINS * BINS of a source is in its last bin; those are taken while they fit.
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "size", "id"))
    edge = final.filter("place = 0 AND size > 0").withColumn("upto", F.col("done") + inside).filter("upto <= rest")
    edge = pin(edge.groupBy("id", "source", "size").agg(F.count("*").alias("taken_edge")), "edge")
    at_edge = pin(edge.groupBy("source").agg(F.sum(F.col("size") * F.col("taken_edge")).alias("more"), F.count("*").alias("n")), "more")
    out = lookup_join(lookup_join(final, edge, ["id", "source", "size"]), at_edge.drop("n"), ["source"])
    # One more document of a source may close the gap that is left: the one whose size is nearest to it, lowest rank first.
    gap = F.col("rest") - F.col("done") - F.coalesce("more", F.lit(0))
    miss = F.abs(F.col("size") - gap)
    spare = out.filter((F.col("place") >= 0) & F.col("taken_edge").isNull() & F.col("rank").isNotNull() & (F.col("size") > 0) & (miss < gap))
    fill = spare.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "id", "size")).alias("f"))
    fill = pin(fill.select("source", F.col("f.id").alias("id"), F.col("f.size").alias("size"), F.lit(1).alias("filled")), "fill")
    out = lookup_join(out, fill, ["id", "source", "size"])
    chosen = ((F.col("place") == -1) & (F.col("size") > 0)) | F.col("taken_edge").isNotNull() | F.col("filled").isNotNull()
    extra = F.when(chosen, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, (F.col("whole") + extra).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as many times as the mix takes it; columns may have any names.

    Rows without words are not taken, null sources are one source. Rows with one id, source and size are taken as
    often as the one taken most. Reruns agree; an empty table gives an empty result.
    """
    taken = mix(docs, id_col, text_col, source_col).filter("copies > 0")
    taken = taken.groupBy(F.col(id_col).alias("t_id"), F.col(source_col).alias("t_source"), F.col("size").alias("t_size")).agg(F.max("copies").cast("int").alias("copies"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.struct("*").alias("row"))
    on = F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size"))
    out = rows.join(taken, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return out.select("row.*")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
