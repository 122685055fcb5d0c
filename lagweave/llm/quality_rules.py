"""Quality rules by cross-document line frequency, in DataFrame functions only.

Every line is normalised (lower case, white space squeezed) and hashed. Per host the documents that
carry a line are counted, exact copies of a text once. A line that more than `limit` documents of its
host carry is boilerplate: it is removed everywhere but in the text that carried it first. Documents
that lose too large a part of their words that way are depleted and rejected, as are those that fail
the base rules (too few words, too many repeated word triples).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import WS, hashed, lookup_join, pin, table, text_or_empty

#: Documents of a host that may share a line.
LIMIT = 20
#: Share of a document's words in removed lines from which it is depleted.
DEPLETED = 0.7
#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def _normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WS, " ")))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed.

    Null and empty texts have 0 of each and fail.
    """
    text = text_or_empty(text_col)
    words = F.filter(F.split(text, WS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, WS, "")) > 0)
    step1 = docs.withColumns({
        "_words": words, "_lines": lines,
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    # Word triples of a text as (hash, place), sorted: equal ones are neighbours, in linear space and n log n time.
    triples = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.arrays_zip(
                F.col("_words").alias("a"),
                F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))).alias("b"),
                F.slice("_words", 3, F.greatest(F.size("_words") - 2, F.lit(0))).alias("c"),
            ),
            lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i")),
        ),
    )
    step2 = step1.withColumn("n_words", F.size("_words").cast("long")).withColumn("_n_lines", F.size("_lines")).withColumn(
        "_triples", F.sort_array(F.slice(triples, 1, F.greatest(F.size("_words") - 2, F.lit(1))))
    )
    size = F.size("_triples")
    found_twice = F.filter(
        "_triples",
        lambda z, i: ((i > 0) & (F.get("_triples", i - 1)["h"] == z["h"])) | ((i < size - 1) & (F.get("_triples", i + 1)["h"] == z["h"])),
    )
    step3 = step2.withColumn("_at", F.sort_array(F.transform(found_twice, lambda z: z["i"])))
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_at")),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.when(k < F.size("_at"), F.least(F.lit(3), F.get("_at", k) - F.get("_at", k - 1))).otherwise(3).cast("long"),
    )
    step4 = step3.withColumn("n_repeat_words", F.when(F.size("_at") > 0, covered).otherwise(F.lit(0).cast("long")))
    step5 = step4.withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return step5.withColumn("base_failed", failed).drop("_words", "_lines", "_n_lines", "_triples", "_at")


def line_table(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """Pinned id, host, text_hash, line (hash), words; a row for each line with a word."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), hashed(F.col(text_col)).alias("text_hash"),
        F.explode(F.split(text_or_empty(text_col), "\n", -1)).alias("_line"),
    ).withColumn("_line", _normal_line(F.col("_line")))
    words = F.length("_line") - F.length(F.translate(F.col("_line"), " ", "")) + 1
    return pin(lines.filter("_line <> ''").select("id", "host", "text_hash", hashed(F.col("_line")).alias("line"), words.alias("words")), "lines")


def boilerplate(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pinned host, line, documents, owner: lines in more than `limit` distinct texts of a host; owner is the text that keeps it."""
    texts = lines.groupBy("host", "line", "text_hash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    stats = texts.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min(F.struct("first", "text_hash")).alias("owner"))
    return pin(stats.filter(F.col("documents") > limit).select("host", "line", "documents", F.col("owner.text_hash").alias("owner")), "boilerplate")


def _removed(lines: DataFrame, common: DataFrame) -> DataFrame:
    """lines with `gone`, whether the line is removed from its document."""
    return lookup_join(lines, common, ["host", "line"], weight="documents").withColumn(
        "gone", F.coalesce(F.col("owner") != F.col("text_hash"), F.lit(False))
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, depleted: float = DEPLETED
) -> DataFrame:
    """One row per input row: id_col, base metrics, base_failed, removed_share, kept.

    Null hosts form one host of their own; null and empty texts have no words and fail; rows repeated
    as a whole count once and share their verdict; an empty table gives an empty result. Other columns
    of docs are not read. Line verdicts rest on the counts over all documents.
    """
    lines = line_table(docs, id_col, host_col, text_col)
    common = boilerplate(lines, limit)
    marked = _removed(lines, common).groupBy("id", "host", "text_hash").agg(
        (F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)) / F.sum("words")).alias("share")
    )
    losses = pin(marked.filter("share > 0"), "losses")
    base = base_metrics(
        docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), hashed(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("_text")),
        "_text",
    ).drop("_text")
    out = lookup_join(base, losses, ["id", "host", "text_hash"])
    share = F.coalesce("share", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        share.alias("removed_share"), (~F.col("base_failed") & (share < depleted)).alias("kept"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns, boilerplate lines removed from the text.

    n_chars, if docs has it, follows the new text. Removed lines take their line break along. Null hosts form
    one host of their own; null and empty texts fail; rows repeated as a whole share their verdict and are all
    kept or all removed; an empty table gives an empty result. Other columns may have any names.
    """
    lines = line_table(docs, id_col, host_col, text_col)
    common = boilerplate(lines, limit)
    marked = _removed(lines, common).groupBy("id", "host", "text_hash").agg(
        (F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)) / F.sum("words")).alias("_share"),
        F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("_gone"),
    )
    losses = pin(marked.filter("_share > 0"), "losses")
    # The columns of docs go through as one, so that their names cannot clash.
    own = F.col("row").getField(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), hashed(F.col(text_col)).alias("text_hash"), F.struct("*").alias("row"))
    # Pinned before anything filters by it: a filter pushed below would evaluate the metrics' arrays within their own lambdas.
    failed = pin(base_metrics(keyed.select("id", "host", "text_hash", own.alias("_text")), "_text").select("id", "host", "text_hash", "base_failed"), "failed")
    failed = failed.filter("base_failed").select("id", "host", "text_hash").distinct().withColumn("_failed", F.lit(True))
    on = [failed[c].eqNullSafe(losses[c]) for c in ("id", "host", "text_hash")]
    both = failed.join(losses, on, "full").select(
        *[F.coalesce(failed[c], losses[c]).alias(c) for c in ("id", "host", "text_hash")], "_share", "_gone",
        (F.coalesce("_failed", F.lit(False)) | (F.coalesce("_share", F.lit(0.0)) >= depleted)).alias("_drop"),
    )
    kept = lookup_join(keyed, pin(both, "verdicts"), ["id", "host", "text_hash"]).filter(~F.coalesce("_drop", F.lit(False)))
    stays = F.filter(F.split(F.coalesce(own, F.lit("")), "\n", -1), lambda x: ~F.array_contains("_gone", hashed(_normal_line(x))))
    text = F.when(F.col("_share").isNotNull(), F.array_join(stays, "\n")).otherwise(own)
    out = kept.select(F.col("row").withField(text_col, text).alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.length(own).cast(docs.schema["n_chars"].dataType)).alias("row"))
    return out.select("row.*")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ \t-\r]+', '', 'g') <> '') AS lines
  FROM documents
), tri AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3
), trik AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM tri
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM trik) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS w FROM twice) GROUP BY rid
), ln AS (
  SELECT rid, doc_id, source, text, lower(trim(regexp_replace(unnest(lines), '[ \t-\r]+', ' ', 'g'))) AS line FROM d
), common AS (
  SELECT source, line, arg_min(text, doc_id) AS owner FROM ln GROUP BY source, line HAVING count(DISTINCT text) > {LIMIT}
), loss AS (
  SELECT rid, sum(CASE WHEN owner IS NOT NULL AND owner <> text THEN len(string_split(line, ' ')) ELSE 0 END) / sum(len(string_split(line, ' '))) AS share
  FROM ln LEFT JOIN common USING (source, line) GROUP BY rid
), m AS (
  SELECT rid, doc_id, len(words) AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(share, 0.0) AS removed_share, NOT base_failed AND coalesce(share, 0.0) < {DEPLETED} AS kept
FROM f LEFT JOIN loss USING (rid)
"""
