"""Filters of estimated networks, and scores against a true one. Links are rows (src, dst, lag, mit, sig)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def significant(links: DataFrame) -> DataFrame:
    return links.filter((F.abs("mit") > F.col("sig")) & ~((F.col("src") == F.col("dst")) & (F.col("lag") == 0)))


def parents(links: DataFrame) -> DataFrame:
    """Edges (dst, src, lag <= 0) of the significant links."""
    return significant(links).select("dst", "src", (-F.col("lag")).cast("int").alias("lag"))


def without_contemporaneous(links: DataFrame) -> DataFrame:
    return links.withColumn("mit", F.when(F.col("lag") == 0, 0.0).otherwise(F.col("mit")))


def strongest(links: DataFrame) -> DataFrame:
    """Per pair the lag-0 link and the strongest significant lagged one; thresholds of the others become 1."""
    ok = (F.abs("mit") > F.col("sig")) & (F.col("lag") > 0)
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(ok.desc(), F.abs("mit").desc(), "lag"))
    ranked = links.withColumns({"_ok": ok, "_rank": rank})
    return ranked.withColumn("sig", F.when((F.col("lag") == 0) | (F.col("_ok") & (F.col("_rank") == 1)), F.col("sig")).otherwise(1.0)).drop("_ok", "_rank")


def nearest(links: DataFrame) -> DataFrame:
    """Per pair the smallest significant lag; thresholds of the others become 1."""
    first = F.min(F.when((F.abs("mit") > F.col("sig")) & (F.col("lag") > 0), F.col("lag"))).over(Window.partitionBy("src", "dst"))
    return links.withColumn("_first", first).withColumn("sig", F.when((F.col("lag") == 0) | (F.col("lag") == F.col("_first")), F.col("sig")).otherwise(1.0)).drop("_first")


def above_level(links: DataFrame, level: float = 0.0) -> DataFrame:
    """Thresholds of links weaker than level are lifted above every strength."""
    top = links.agg(F.max("mit").alias("_top"))  # one row
    return links.crossJoin(F.broadcast(top)).withColumn("sig", F.when(F.col("mit") < level, F.col("_top") + 1e-5).otherwise(F.col("sig"))).drop("_top")


def parent_sets(links: DataFrame, level: float = 0.003) -> DataFrame:
    """name, dst, src, lag: five sets of parents from one estimation."""
    lagged = without_contemporaneous(links)
    kinds = {"all": lagged, "strongest": strongest(lagged), "level_strongest": strongest(above_level(lagged, level)), "nearest": nearest(lagged), "level": above_level(lagged, level)}
    out = None
    for name, k in kinds.items():
        one = parents(k).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dst", "src", "lag").intersect(b.select("dst", "src", "lag"))


def filtered_network(edges: DataFrame, links: DataFrame, contemporaneous: bool = True) -> DataFrame:
    """Per pair the lag-0 edge (if asked) and the lagged edge of largest strength."""
    e = edges.join(links.select("dst", "src", (-F.col("lag")).cast("int").alias("lag"), "mit"), ["dst", "src", "lag"], "left")
    rank = F.row_number().over(Window.partitionBy("dst", "src").orderBy((F.col("lag") < 0).desc(), F.col("mit").desc_nulls_last(), F.col("lag").desc()))
    best = e.withColumn("_r", rank).filter(((F.col("_r") == 1) & (F.col("lag") < 0)) | ((F.col("lag") == 0) & F.lit(contemporaneous)))
    return best.select("dst", "src", "lag")


def detection_rates(true: DataFrame, found: DataFrame, nvar: int, taumax: int) -> DataFrame:
    """dr = TP / N and fpr = FP / (FP + TN) over all targets."""
    t = true.select("dst", "src", "lag").distinct().withColumn("t", F.lit(1))
    f = found.select("dst", "src", "lag").distinct().withColumn("f", F.lit(1))
    both = t.join(f, ["dst", "src", "lag"], "full")
    agg = both.agg(F.sum(F.coalesce("t", F.lit(0)) * F.coalesce("f", F.lit(0))).alias("tp"), F.sum("t").alias("n"), F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("fp"), F.count("*").alias("u"))
    tn = F.lit(nvar * ((taumax + 1) * nvar - 1)) - F.col("u")
    return agg.select((F.col("tp") / F.col("n")).alias("dr"), (F.col("fp") / (F.col("fp") + tn)).alias("fpr"))


def cube(edges: DataFrame, links: DataFrame) -> DataFrame:
    """links with `present` and the strength of present links, else 0."""
    e = edges.select("dst", "src", (-F.col("lag")).cast("int").alias("lag")).distinct().withColumn("_p", F.lit(True))
    out = links.join(e, ["dst", "src", "lag"], "left").withColumn("present", F.coalesce("_p", F.lit(False)))
    return out.withColumn("strength", F.when(F.col("present"), F.col("mit")).otherwise(0.0)).drop("_p")


# Data behind figures


def strongest_lag(links: DataFrame) -> DataFrame:
    """Per pair the signed strength at the lag of largest absolute strength, and its lag."""
    best = F.max_by(F.struct("mit", "lag"), F.struct(F.abs("mit"), -F.col("lag"))).alias("b")
    return links.groupBy("src", "dst").agg(best).select("src", "dst", "b.mit", "b.lag")


def collapsed(links: DataFrame) -> DataFrame:
    """Per pair the strongest significant strength and its significant lags, the strongest first (the smaller lag if equal)."""
    s = links.filter(F.abs("mit") >= F.col("sig"))
    lags = F.sort_array(F.collect_list(F.struct((-F.abs("mit")).alias("k"), "lag")))
    g = s.groupBy("src", "dst").agg(F.max_by("mit", F.struct(F.abs("mit"), -F.col("lag"))).alias("mit"), lags.alias("l"))
    return g.select("src", "dst", "mit", F.transform("l", lambda x: x["lag"]).alias("lags"))


def unrolled(links: DataFrame, length: int) -> DataFrame:
    """Significant links at every time step of a window: src, from_t, dst, to_t."""
    s = links.filter(F.abs("mit") >= F.col("sig")).withColumn("to_t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return s.withColumn("from_t", F.col("to_t") - F.col("lag")).filter("from_t >= 0").select("src", "from_t", "dst", "to_t", "mit")


def flagged(links: DataFrame, from_lag: int = 0) -> DataFrame:
    return links.filter(F.col("lag") >= from_lag).withColumn("is_significant", F.abs("mit") >= F.col("sig"))


def lag_panels(links: DataFrame, contemporaneous: bool = True, correlation: bool = False, bounds: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a lag function's panel: `strength` and whether it is significant; lag 0 of a variable with itself goes, and all of lag 0 if asked.

    With `correlation`, strengths, thresholds and bounds are on the scale of correlations. `bounds` names columns of
    confidence limits, which become `lower` and `upper`.
    """
    scale = correlation_of if correlation else (lambda c: c)
    kept = links.filter(((F.col("src") != F.col("dst")) & F.lit(contemporaneous)) | (F.col("lag") > 0))
    limits = [scale(F.col(c)).alias(name) for c, name in zip(bounds or (), ("lower", "upper"), strict=False)]
    return kept.select("src", "dst", "lag", scale(F.col("mit")).alias("strength"), scale(F.col("sig")).alias("threshold"), (F.abs("mit") >= F.col("sig")).alias("is_significant"), *limits)


def masked_series(df: DataFrame, column: str, mask: Column, time: str = "t", keep: bool = False) -> DataFrame:
    """t, value and masked of one panel of a series: masked values are null, or with `keep` stay in `grey`; a null mask masks nothing."""
    hidden = F.coalesce(mask, F.lit(False))
    grey = [F.when(hidden, F.col(column)).alias("grey")] if keep else []
    return df.select(F.col(time), F.when(~hidden, F.col(column)).alias("value"), hidden.alias("masked"), *grey)


def labelled(df: DataFrame, labels: dict, columns: list[str]) -> DataFrame:
    """df with variables in `columns` replaced by their labels; those without one keep their name."""
    names = F.create_map(*[F.lit(str(x)) for pair in labels.items() for x in pair])
    return df.withColumns({c: F.coalesce(names[F.col(c).cast("string")], F.col(c).cast("string")) for c in columns})


def named_networks(candidates: DataFrame, links: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """network, dst, src, lag: `pc` (candidate edges), `mit` (significant links), `pcmit` (both) and `true`, if one is given."""
    found = parents(links)
    kinds = {"pc": candidates.select("dst", "src", "lag"), "mit": found, "pcmit": intersection(candidates, found)}
    if true is not None:
        kinds["true"] = true.select("dst", "src", "lag")
    return reduce(DataFrame.unionByName, [e.withColumn("network", F.lit(n)) for n, e in kinds.items()])


def split_ratio(history: DataFrame) -> DataFrame:
    """Ratio of immediate to distant information by lag, in two columns: from 1 on, and below."""
    ratio = F.col("cit") / F.nullif(F.col("past"), F.lit(0.0))
    return history.select("target", "tau", F.when(ratio >= 1, ratio).alias("from_one"), F.when(ratio < 1, ratio).alias("below_one"))


def history_curves(history: DataFrame) -> DataFrame:
    """tau, immediate, distant, total and the distant share of a causal history."""
    total = F.col("cit") + F.col("past")
    return history.select("target", "tau", F.col("cit").alias("immediate"), F.col("past").alias("distant"), total.alias("total"), (F.col("past") / F.nullif(total, F.lit(0.0))).alias("share"))


def correlation_of(cmi):
    """Correlation scale of an information (negative ones count as 1e-8)."""
    return F.sqrt(1 - F.exp(-2 * F.when(cmi < 0, 1e-8).otherwise(cmi)))


def information_of(correlation):
    return -0.5 * F.ln(1 - correlation * correlation)


def rounded(x, base: float = 5, mode: str = "updown"):
    return {"updown": F.rint, "down": F.floor, "up": F.ceil}[mode](x / base) * base
