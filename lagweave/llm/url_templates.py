"""URL filter by a path-template tree per host.

Fixed rules decide the urls they fit and label them. For the rest, each host's paths form a tree whose
frequent segments stay literal and whose variable ones become wildcards. At each level, branches of one
parent whose labels do not differ statistically are merged, and a template is rejected if its share of
blocked labels, smoothed towards its branches, its host and the same template elsewhere, is above one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm.common import lookup_join, pin, table

#: (host, path, verdict) of the fixed rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A segment stays literal with so many urls at its place.
MIN_SUPPORT = 10
#: From this depth on, the rest of a path whose branch has fewer urls than MIN_SUPPORT is one `**`; others go on.
PLAIN_DEPTH = 6
#: Strength of smoothing, in labels; z value up to which neighbouring branches count as alike.
SMOOTHING, SIMILAR_Z = 5.0, 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, pattern, 1), upper, lower), F.regexp_extract(found, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]

    def chosen(values: list[str]) -> Column:
        return F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))

    return chosen([h + p for h, p, _ in ordered]), chosen([v for _, _, v in ordered])


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, ...) with `template`, e.g. /en/*; the segments of the tree are chosen level by level."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pin(urls.withColumn("segments", segments).withColumn("template", F.lit("")), "urls")
    depth = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for d in range(depth):
        seg = F.get("segments", F.lit(d))
        if d >= PLAIN_DEPTH:
            deeper = rows.filter(F.size("segments") > d).groupBy("host", "template").agg(F.count("*").alias("n"))
            thin = pin(deeper.filter(F.col("n") < MIN_SUPPORT).withColumn("thin", F.lit(True)), "thin")
            ends = (F.size("segments") > d) & F.col("thin").isNotNull()
            rows = lookup_join(rows, thin, ["host", "template"], weight="n").withColumns(
                {"template": F.when(ends, F.concat("template", F.lit("/**"))).otherwise(F.col("template")), "segments": F.when(ends, F.slice("segments", 1, d)).otherwise(F.col("segments"))}
            )
            rows = pin(rows.drop("thin", "n"), "urls")
            if not rows.filter(F.size("segments") > d).limit(1).count():
                break
        counts = rows.filter(F.size("segments") > d).groupBy("host", "template", seg.alias("segment")).agg(F.count("*").alias("n"))
        literal = pin(counts.filter(F.col("n") >= MIN_SUPPORT), "literal")
        marked = lookup_join(rows.withColumn("segment", seg), literal, ["host", "template", "segment"], weight="n")
        step = F.when(F.col("segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("n").isNull(), "*").otherwise(F.col("segment"))))
        rows = pin(marked.withColumn("template", F.concat("template", step)).drop("segment", "n"), "urls")
    return rows.drop("segments")


def judged_templates(labelled: DataFrame) -> DataFrame:
    """Pinned host, template, n, branch, purity (smoothed share of blocked labels) from rows with label 1 (block), 0 or null."""
    stats = pin(labelled.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("label").alias("seen"), F.sum(F.coalesce("label", F.lit(0))).alias("bad")), "stats")
    total = stats.agg(F.sum("bad"), F.sum("seen")).first()
    prior = F.lit(((total[0] or 0) + 1.0) / ((total[1] or 0) + 2.0))

    def smooth(bad: str, seen: str, towards: Column) -> Column:
        return (F.col(bad) + SMOOTHING * towards) / (F.col(seen) + SMOOTHING)

    elsewhere = stats.groupBy("template").agg(F.sum("bad").alias("t_bad"), F.sum("seen").alias("t_seen")).withColumn("t_purity", smooth("t_bad", "t_seen", prior))
    hosts = stats.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("seen").alias("h_seen"))
    tree = stats.join(hosts, "host").join(elsewhere, "template").withColumn("group", F.lit("")).withColumn("g_seen", F.lit(-1).cast("long"))
    tree = tree.withColumn("parts", F.split("template", "/")).withColumn("towards", smooth("h_bad", "h_seen", F.col("t_purity")))
    tree = pin(tree.select("host", "template", "n", "seen", "bad", "parts", "group", "g_seen", "towards"), "tree")
    for d in range(1, max(2, tree.agg(F.max(F.size("parts"))).first()[0] or 0)):
        # Branches of a group: by their next segment, those of one share of blocked labels as one. In order of that share,
        # a branch joins the one before it unless they differ by more than chance; branches without labels stay apart.
        step = tree.withColumn("segment", F.coalesce(F.get("parts", F.lit(d)), F.lit("")))
        branches = step.groupBy("host", "group", "segment").agg(F.sum("bad").alias("b"), F.sum("seen").alias("s"))
        branches = branches.withColumn("share", F.when(F.col("s") > 0, F.col("b") / F.col("s")).otherwise(-1.0))
        alike = branches.groupBy("host", "group", "share").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
        by = Window.partitionBy("host", "group").orderBy("share")
        alike = alike.withColumns({"p_share": F.lag("share").over(by), "pb": F.lag("b").over(by), "ps": F.lag("s").over(by)})
        pooled = (F.col("b") + F.col("pb") + 1) / (F.col("s") + F.col("ps") + 2)
        z = (F.col("share") - F.col("p_share")) / F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("s", F.lit(1)) + 1 / F.greatest("ps", F.lit(1))))
        starts = F.when(F.col("pb").isNull() | (F.col("ps") == 0) | (z > SIMILAR_Z), 1).otherwise(0)
        alike = alike.withColumn("starts", starts).withColumn("branch", F.sum("starts").over(by))
        merged = Window.partitionBy("host", "group", "branch")
        alike = alike.withColumns({"m_bad": F.sum("b").over(merged), "m_seen": F.sum("s").over(merged)})
        found = branches.select("host", "group", "segment", "share").join(alike.select("host", "group", "share", "branch", "m_bad", "m_seen"), ["host", "group", "share"])
        step = step.join(found.drop("share"), ["host", "group", "segment"])
        # The same labels are not counted for two levels, nor for the deepest and the template itself.
        again = F.lit(d > 1) & ((F.col("m_seen") == F.col("g_seen")) | (F.col("m_seen") == F.col("seen")))
        towards = F.when(again, F.col("towards")).otherwise(smooth("m_bad", "m_seen", F.col("towards")))
        step = step.withColumn("towards", towards).withColumn("group", F.concat_ws("/", "group", F.col("branch").cast("string")))
        tree = pin(step.select("host", "template", "n", "seen", "bad", "parts", "group", F.col("m_seen").alias("g_seen"), "towards"), "tree")
    branch = F.split("group", "/")[1].cast("long")
    return pin(tree.select("host", "template", "n", branch.alias("branch"), smooth("bad", "seen", F.col("towards")).alias("purity")), "judged")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict, template, purity.

    Null urls and urls without :// have an empty host and path and are judged with the template of no
    segments. Repeated rows are judged and counted as often as they occur; with equal lengths of rule
    the first by host and path wins. An empty table gives an empty result. Other columns are not read.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "ruled": verdict})
    ruled = ruled.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    rows = templates(ruled)
    out = lookup_join(rows, judged_templates(rows), ["host", "template"], weight="n")
    own = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")


def op7_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
