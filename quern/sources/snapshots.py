"""Files that changed since the last look: names, sizes and times are compared, and only changed files are read and hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.commits import CommitLog
from quern.tables import stored

SNAPSHOT = "path string, size long, modified timestamp, sha256 string, look long"
#: Paths in one read, so that a plan names a bounded number of files.
AT_ONCE = 10_000


def listed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, size, modified) of files; no content is read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def hashed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, sha256) of the files of a stored table (path), read AT_ONCE at a time."""
    out, last = spark.createDataFrame([], "path string, sha256 string"), ""
    while True:
        part = [r["path"] for r in files.filter(F.col("path") > last).orderBy("path").limit(AT_ONCE).collect()]
        if not part:
            return out
        read = spark.read.format("binaryFile").load(part).select("path", F.sha2("content", 256).alias("sha256"))
        out, last = out.unionByName(stored(read, "hashes")), part[-1]


def looked(log: CommitLog) -> DataFrame:
    """(path, size, modified, sha256) as the last look left them; files that were gone have no row."""
    latest = log.read().groupBy("path").agg(F.max(F.struct("look", "size", "modified", "sha256")).alias("x"))
    return latest.select("path", "x.size", "x.modified", "x.sha256").filter("sha256 is not null")


def changes(spark: SparkSession, paths: list[str] | str, folder: str) -> DataFrame:
    """(path, state, sha256, before) since the last look that the folder holds, and the new look is committed there.

    state: new, changed (other content), touched (other size or time, same content), same, gone.  Only files whose size or time differ are read.
    """
    log = CommitLog(spark, folder, SNAPSHOT)
    old = looked(log).select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("sha256").alias("before"))
    both = stored(listed(spark, paths).join(old, "path", "full_outer"), "looks")
    differs = F.col("before").isNull() | (F.col("size") != F.col("old_size")) | (F.col("modified") != F.col("old_modified"))
    again = stored(both.filter(F.col("size").isNotNull() & differs).select("path"), "again")
    rows = both.join(hashed(spark, again), "path", "left").withColumn("sha256", F.when(F.col("size").isNotNull(), F.coalesce("sha256", "before")))
    state = (
        F.when(F.col("sha256").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("sha256") != F.col("before"), "changed").when(differs, "touched").otherwise("same")
    )
    rows = stored(rows.withColumn("state", state), "changes")
    news = rows.filter("state <> 'same'").select("path", "size", "modified", "sha256", F.lit(log.commits()).cast("long").alias("look"))
    log.append(news)
    return rows.select("path", "state", "sha256", "before")


def inventory_state(documents: DataFrame, changed: DataFrame, version: int, complete: bool, known_version: int, policy_hash: str, known_policy: str) -> DataFrame:
    """(id, issue): whether an inventory of documents (id, path) may be used again: of another version or policy none may, nor of an unfinished
    crawl; else all but those whose file changed or is gone."""
    whole = "version" if version != known_version else "policy" if policy_hash != known_policy else None if complete else "incomplete"
    rows = documents.join(changed.select("path", "state"), "path", "left")
    own = F.when(F.col("state").isNull() | (F.col("state") == "gone"), "no file").when(F.col("state").isin("new", "changed"), "changed")
    return rows.select("id", (F.lit(whole) if whole else own).alias("issue"))
