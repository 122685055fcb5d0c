"""Exact deduplication by deterministic block naming, in DataFrame functions only.

The normalised text is cut into blocks of a fixed number of code points. Equal blocks get equal
integer names by sorting; then names of adjacent blocks are paired and the pairs named in the same
way, until each document has one name. Two documents have the same (level, name) exactly when their
normalised texts are the same: names come from sorted contents, so no hash collision can merge texts.
Hashes only deal blocks out to tasks. Blocks that very many documents share are dealt out by document
as well, named locally, and the few local names unified afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm.common import HEAVY_KEYS, WS, hashed, lookup_join, pin, table, text_or_empty, union_all, unpin

BLOCK = 4096
#: A name is bucket * 2**RANK_BITS + rank within the sorted bucket; unified hot names are negative.
BUCKET_BITS, RANK_BITS = 24, 38
HOT_ROWS, SALTS = 64, 128


def name_keys(rows: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Pinned rows of `carry` and `name`, an integer equal for two rows exactly if their keys are equal."""
    keyed = rows.withColumn("_h", hashed(*keys))
    counts = keyed.groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT_ROWS)
    top = counts.orderBy(F.col("_n").desc(), "_h").limit(HEAVY_KEYS)
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h")).cast("long")
    hot = pin(top.select("_h", nth.alias("_hot")), "hot")
    dealt = keyed.join(F.broadcast(hot), "_h", "left").select(
        *carry,
        *keys,
        "_hot",
        F.when(F.col("_hot").isNotNull(), F.col("_h")).otherwise(F.pmod("_h", F.lit(1 << BUCKET_BITS))).alias("_bucket"),
        F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*carry), F.lit(SALTS))).otherwise(F.lit(0)).alias("_salt"),
    )
    group = Window.partitionBy("_hot", "_bucket", "_salt").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.dense_rank().over(group)).withColumn("_row", F.row_number().over(group))
    first = (F.col("_row") == 1) | (F.col("_rank") != F.lag("_rank").over(group))
    local = pin(
        ranked.withColumn("_first", F.col("_hot").isNotNull() & first).select(
            *carry, "_hot", "_bucket", "_salt", "_rank", *[F.when(F.col("_first"), F.col(k)).alias(k) for k in keys], "_first"
        ),
        "local",
    )
    # At most HEAVY_KEYS * SALTS rows, save hash collisions.
    reps = local.filter("_first")
    overall = F.dense_rank().over(Window.partitionBy("_hot").orderBy(*keys))
    unified = pin(reps.select("_hot", "_salt", "_rank", (-(F.col("_hot") * (1 << RANK_BITS) + overall)).alias("_hot_name")), "unified")
    out = lookup_join(local.select(*carry, "_hot", "_bucket", "_salt", "_rank"), unified, ["_hot", "_salt", "_rank"])
    name = F.when(F.col("_hot").isNotNull(), F.col("_hot_name")).otherwise(F.col("_bucket") * (1 << RANK_BITS) + F.col("_rank"))
    result = pin(out.select(*carry, name.alias("name")), "named")
    unpin(hot, local, unified)
    return result


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, ident): rows has row, id_col, text_sha256, n_blocks; ident has row, level and name, equal exactly for equal texts."""
    norm = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col), F.regexp_replace(text_or_empty(text_col), WS, " ").alias("_norm")
    )
    blocks = norm.select(
        "row", id_col, F.sha2(F.col("_norm"), 256).alias("_sha"),
        F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_blocks"),
    )
    exploded = blocks.select("row", id_col, "_sha", F.size("_blocks").alias("n"), F.posexplode_outer("_blocks").alias("pos", "block")).select(
        "row",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.greatest("n", F.lit(1)).alias("n"),
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(F.col(id_col).alias("id"), F.col("_sha").alias("sha"))).alias("doc"),
        F.coalesce("block", F.lit("")).alias("block"),
    )
    names = name_keys(exploded, ["block"], ["row", "pos", "n", "doc"])
    rows = names.filter("pos = 0").select("row", F.col("doc.id").alias(id_col), F.col("doc.sha").alias("text_sha256"), F.col("n").alias("n_blocks"))
    most = names.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    current = names.select("row", "pos", "n", "name")
    while True:
        done.append(current.filter(F.col("n") <= (1 << level)).select("row", F.lit(level).alias("level"), "name"))
        if most <= (1 << level):
            break
        level += 1
        half = (F.col("pos") / 2).cast("int")
        pairs = (
            current.filter(F.col("n") > (1 << (level - 1)))
            .groupBy("row", "n", half.alias("half"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"))
            .withColumnRenamed("half", "pos")
        )
        current = name_keys(pairs, ["left", "right"], ["row", "pos", "n"])
    return rows, union_all(*done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after each white-space run is replaced by one space; null
    counts as empty, and empty texts are equal to each other. The row with the smallest id stays (null
    ids last); of repeated rows with one id, exactly one is kept. An empty table gives an empty result.
    Other columns of docs are not read, so their names cannot clash.
    """
    rows, ident = identities(docs, id_col, text_col, block)
    doc = pin(ident.join(rows, "row"), "ident")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("row").alias("row"))
    groups = doc.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("size")).filter("size > 1")
    groups = pin(groups.select("level", "name", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), "size"), "groups")
    out = lookup_join(doc, groups, ["level", "name"], weight="size")
    alone = F.col("size").isNull()
    return out.select(
        F.col(id_col),
        F.when(alone, F.col(id_col)).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, which may have any names.

    Null counts as empty, and empty texts are equal to each other; null ids come last. Of rows that have one id and
    equal texts the one with the smallest text stays, ties by a hash of the row. An empty table gives an empty result.
    """
    found = pin(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept"), "found")
    kept = pin(found.groupBy("id", "sha").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("kept").drop("kept"), "kept")
    unpin(found)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.regexp_replace(text_or_empty(text_col), WS, " "), 256).alias("sha"), F.struct("*").alias("row"))
    once = kept.filter("n = 1").select(F.col("id").alias("k_id"), F.col("sha").alias("k_sha"))
    out = rows.join(once, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha"))).select("row")
    several = pin(kept.filter("n > 1"), "several")
    if several.limit(1).count():
        first = F.min_by("row", F.struct(F.col("row").getField(text_col), F.xxhash64("row")))
        out = out.unionByName(lookup_join(rows, several, ["id", "sha"], weight="n", how="inner").groupBy("id", "sha").agg(first.alias("row")).select("row"))
    return out.select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
