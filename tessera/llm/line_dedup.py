"""Lines that many documents share, dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import LOWER, UPPER, ascii_lower, given, id_or_none

BLANK = " \t\n\u000b\f\r"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` (``id_col``, ``text_col``) with shared lines dropped, and ``n_lines``, ``n_dropped``.

    Lines are exploded with their positions; a line's key is the line trimmed of ASCII white space with A-Z lowered.
    A key of at least ``min_chars`` code points that occurs in at least ``min_docs`` documents keeps its lines in the
    largest id that holds it. Keys travel as 128-bit hashes; texts are moved once, to meet the positions they lose.

    NULL or empty text: one empty line. NULL id: one document, below all others. Repeated rows: the same document,
    each row returned. Empty table: no rows. Other columns are not looked at. The number of documents is counted by
    (key, document) first, so a line held by a third of all rows is spread; the join on keys is left to skew handling.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumns({
        "did": id_or_none(F.col("id")),
        "row": F.unhex(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("|"), F.col("text")))),
    })
    lines = base.select("did", "row", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("did", "row", "pos", F.btrim("line", F.lit(BLANK)).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("did", "row", "pos", F.unhex(F.md5("key")).alias("hash"))
    shared = lines.groupBy("hash").agg(F.countDistinct("did").alias("n"), F.max("did").alias("keeper"))
    shared = shared.where(F.col("n") >= min_docs).select("hash", "keeper")
    lost = lines.join(shared, "hash").where(F.col("did") != F.col("keeper"))
    lost = lost.groupBy("row").agg(F.collect_set("pos").alias("lost"))
    split = F.split("text", "\n", -1)
    out = base.join(lost, "row", "left").withColumn("lines", split)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda p: F.element_at("lines", p + 1)), "\n"))
    return out.select(F.col("id").alias(id_col), kept.alias(text_col), F.size("lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


@query("op3_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, hot.key IS NOT NULL AND hot.keeper <> k.doc_id AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
""")
def op3_line_dedup(spark, sf_dir):
    kept = line_dedup(given(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
