"""Line dedup by distinct-site spread (native): boilerplate is what many sites repeat.

Every line is hashed once. A HyperLogLog sketch of its sites grows by aggregation for each line hash, merged where
the lines lie before anything is shuffled; a line whose estimate lies near the threshold gets an exact distinct
count. A line found on ``min_sites`` sites or more is boilerplate: it stays in the document with the smallest id
that holds it and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, staged, unused

MIN_SITES = 10
#: Registers 2**LG_K; a sketch lists its sites up to some tens of them, so lines of few sites stay small.
LG_K = 10
#: Beyond this many boilerplate lines (24 bytes each) their table is shuffled instead of broadcast.
BROADCAST_LINES = 250_000


def body(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.trim(F.translate(line, "\t\r", "  "))


def line_key(line: Column) -> Column:
    """Two hashes of 96 bits together; lines count without white space at their ends."""
    return F.struct(F.xxhash64(body(line)).alias("h"), F.hash(body(line), F.lit(7)).alias("g"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id and 96 bits of the text. Rows with the same id and text are alike."""
    text = F.col(text_col)
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), F.hash(text, F.lit(3)).alias("y")]


def document_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, x, y, site, h, g): a row for each line that isn't blank; null sites are one site of their own."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    lines = docs.select(*row_key(id_col, text_col), site.alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    lines = lines.select("id", "x", "y", "site", body(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("id", "x", "y", "site", F.xxhash64("line").alias("h"), F.hash("line", F.lit(7)).alias("g"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, g, keeper) of each line on ``min_sites`` sites or more, with the smallest id that holds it; staged.

    Sketches decide where their error leaves no doubt: three standard errors and two sites. Lines between are
    counted exactly. Where all ids of a line are null the keeper is null, and no row keeps the line's other copies.
    """
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", lg_k).alias("sites"), F.min("id").alias("keeper"))
    spread = spread.select("h", "g", "keeper", F.hll_sketch_estimate("sites").alias("estimate"))
    error = 3 * 1.04 / (2 ** (lg_k / 2))
    low, high = int(min_sites * (1 - error)) - 1, int(min_sites * (1 + error)) + 2
    wide = staged(spread.where(F.col("estimate") >= low), "line-spread")
    near = wide.where(F.col("estimate") < high)
    exact = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    found = wide.where(F.col("estimate") >= high).select("h", "g", "keeper").unionByName(near.join(exact.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "keeper"))
    found = staged(found, "boilerplate")
    discard(wide)
    return found


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES,
                       lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """The rows of ``docs`` with cleaned texts, plus ``lines_col`` and ``removed_col`` (longs).

    Rows keep their order of lines. A document without boilerplate keeps its text as it is; null texts stay
    null, with no lines. A document that lost lines has the others joined by line breaks. Ties and repeated
    rows: the rows of the keeper's id all keep their lines; null ids lose theirs unless no other id holds them.
    Texts of any length are taken whole; an empty table stays empty. Other columns pass through untouched;
    ones named like the two counts are replaced.
    """
    docs = docs.drop(*[c for c in (lines_col, removed_col) if c in docs.columns])
    lines = staged(document_lines(docs, id_col, text_col, site_col), "document-lines")
    found = spread_lines(lines, min_sites)
    few = found.limit(broadcast_lines + 1).count() <= broadcast_lines
    hits = lines.join(F.broadcast(found) if few else found, ["h", "g"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    key, mine, gone = unused("key", docs), unused("mine", docs), unused("gone", docs)
    going = hits.groupBy(F.struct("id", "x", "y").alias(key)).agg(F.collect_set(F.struct("h", "g")).alias(gone))
    both = docs.withColumn(mine, F.struct(*row_key(id_col, text_col))).join(going.hint("shuffle_hash"), F.col(mine).eqNullSafe(F.col(key)), "left")
    text, lost = F.col(text_col), F.col(gone)
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda line: (body(line) == "") | ~F.array_contains(lost, line_key(line)))
    left = unused("left", docs)
    both = both.withColumn(left, F.when(lost.isNotNull(), kept))
    n = F.when(text.isNull(), 0).otherwise(F.size(parts))
    return both.select(
        *[F.when(F.col(left).isNull(), text).otherwise(F.array_join(left, "\n")).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        n.cast("long").alias(lines_col),
        F.when(F.col(left).isNull(), 0).otherwise(n - F.size(left)).cast("long").alias(removed_col),
    )


def line_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Cleaned documents with the columns of ``docs``, whatever their names; those whose every line went are dropped."""
    n, lost = unused("lines", docs), unused("removed", docs)
    out = remove_boilerplate(docs, id_col, text_col, site_col, min_sites, lines_col=n, removed_col=lost)
    return out.where((F.col(lost) == 0) | (F.trim(F.translate(F.col(text_col), "\n\r\t", "   ")) != "")).select(docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
bodies AS (
  SELECT doc_id, source, trim(translate(line, chr(9) || chr(13), '  '), ' ') AS body FROM lines),
boiler AS (
  SELECT body, min(doc_id) AS keeper FROM bodies WHERE body <> ''
  GROUP BY body HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
placed AS (
  SELECT d.doc_id, p.pos, p.line, b.keeper IS NOT NULL AND d.doc_id IS DISTINCT FROM b.keeper AS gone
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(len(parts))) AS pos, unnest(parts) AS line) p
  LEFT JOIN boiler b ON trim(translate(p.line, chr(9) || chr(13), '  '), ' ') = b.body)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean_text
FROM placed GROUP BY doc_id
"""
