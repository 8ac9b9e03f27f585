"""Line dedup by distinct-site spread.

Each line of a text, trimmed, is known by 96 bits of hash. A HyperLogLog sketch of the sites that have it merges by aggregation; lines whose
estimate is too near the threshold to be sure get an exact distinct count. A line on `min_sites` sites or more is boilerplate: it goes
wherever it stands but for its first place (smallest doc_id, then line), so no wording leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscape.llm.common import cut, named

MIN_SITES = 10
LG_BUCKETS = 12
#: Standard errors of a HyperLogLog estimate that count as near the threshold.
SURE = 4.0


def line_array(text: str = "text") -> Column:
    """The lines of a text, split at line feeds; a null or empty text has none."""
    return F.when(F.col(text).isNull() | (F.col(text) == ""), F.array().cast("array<string>")).otherwise(F.split(F.col(text), "\n"))


def hashed_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, version (a hash of the text), site, at, h1, h2 of each line that isn't blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"), line_array().alias("lines"))
    each = rows.select("doc_id", "version", "site", F.posexplode("lines").alias("at", "line")).withColumn("line", F.trim("line"))
    return each.where(F.col("line") != "").select("doc_id", "version", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (doc_id, at) of the lines on at least `min_sites` sites."""
    margin = SURE * 1.04 / 2 ** (LG_BUCKETS / 2)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_BUCKETS)).alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first"))
    judged = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites * (1 - margin) - 1).select("h1", "h2", "first", "sites")
    judged = cut(judged)
    sure = judged.where(F.col("sites") > min_sites * (1 + margin) + 1).select("h1", "h2", "first")
    near = judged.where(F.col("sites") <= min_sites * (1 + margin) + 1).select("h1", "h2", "first")
    counted = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(near.join(counted.where(F.col("sites") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first"))


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The columns of docs with `kept_text` (the text without its boilerplate lines), `n_lines` and `n_removed` added; clashing names are replaced.

    A null site is a site of its own; lines without a word are never boilerplate. Null and empty texts have no lines: a null stays null, and empty
    stays empty. Lines of a null doc_id come last in order. Rows of one doc_id each keep a line whose first place is that id and line number;
    repeated rows come out repeated. Other columns pass unread; an empty table gives an empty result.
    """
    lines = cut(hashed_lines(docs, site))
    common = boilerplate(lines, min_sites)
    again = lines.join(common, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    drops = again.groupBy("doc_id", "version").agg(F.collect_set("at").alias("_drop")).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "_drop")
    # the row as one value, so that no name of its columns can clash
    own = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    rows = own.join(drops, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_version")), "left")
    found = line_array("_row.text")
    # the outer function holds the lines, so that a text is split once; places to keep come by hash, not by a search for each line
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    join = lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n")
    kept = F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(F.get(F.transform(F.array(found), join), F.lit(0)))
    removed = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long")
    rows = rows.select("_row", kept.alias("_kept"), F.size(found).cast("long").alias("_lines"), removed.alias("_removed"))
    added = {"kept_text": "_kept", "n_lines": "_lines", "n_removed": "_removed"}
    return rows.select(F.struct("_row", *added.values()).alias("_all")).select(*[F.col("_all._row").getField(c).alias(c) for c in docs.columns if c not in added], *[F.col("_all").getField(v).alias(k) for k, v in added.items()])
