"""File sources and sinks: rosters, delimited splits, score files, audit lines, recordings by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNLABELLED = "unlabelled"
AUDIT_SCHEMA = (
    "sequence long, timestamp string, actor_id string, actor_roles array<string>, action string, "
    "case_reference string, parameters map<string,string>, outcome string, entry_hash string"
)


def nonempty(text: Column, pattern: str, group: int) -> Column:
    """A pattern's group, or null where the pattern doesn't fit."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Lines "id | sex | utterances | h:m:s" to speaker_id, sex, utterances, duration_seconds; other lines are passed over."""
    rx = r"^\s*\|?\s*(\S+)\s*\|\s*(\S+)\s*\|\s*(\d+)\s*\|\s*(\d+):(\d+):(\d+)\s*\|?\s*$"
    g = [nonempty(F.col("value"), rx, i) for i in range(1, 7)]
    seconds = g[3].cast("int") * 3600 + g[4].cast("int") * 60 + g[5].cast("int")
    rows = spark.read.text(path).select(g[0].alias("speaker_id"), g[1].alias("sex"), g[2].cast("int").alias("utterances"), seconds.alias("duration_seconds"))
    return rows.where("speaker_id is not null")


def delimited(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """Named text columns of one or several splits, trimmed; rows with all of them empty are dropped."""
    rows = spark.read.csv(paths, header=True, sep=sep).select(*[F.trim(c).alias(c) for c in columns])
    return rows.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull())


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("score double, label int, speaker string").json(path)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines; those that are no JSON are passed over."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def recordings(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """path, length, speaker, session of root/speaker/session/file, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.col("path")
    rx = r"([^/]+)/([^/]+)/[^/]+$"
    return files.select("path", "length", nonempty(path, rx, 1).alias("speaker"), nonempty(path, rx, 2).alias("session"))


#: File names "speaker-yymmdd-hhmmss_...": session-first names carry no speaker and don't fit.
LABELLED = r"^([^-]+)-(\d{6}-\d{6})_"


def labelled_name(name: Column) -> Column:
    """struct<speaker, session> of a file name; null if it carries no speaker. Whether that speaker exists is the roster's call."""
    return F.when(name.rlike(LABELLED), F.struct(F.regexp_extract(name, LABELLED, 1).alias("speaker"), F.regexp_extract(name, LABELLED, 2).alias("session")))


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, length and name of the files right under a folder; their contents are not opened. Files without a byte are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.substring_index("path", "/", -1).alias("name"))


def scan_labelled(spark: SparkSession, root: str, roster: DataFrame, most: int = 2, least_sessions: int = 2, pattern: str = "*.wav") -> DataFrame:
    """path, length, speaker, session of recordings whose names give a speaker that the roster has: the first ``most`` of
    each session by name, of speakers with at least ``least_sessions`` sessions."""
    named = _listed(spark, root, pattern).withColumn("_n", labelled_name(F.col("name"))).where("_n is not null")
    named = named.select("path", "length", "name", "_n.*").join(roster.select(F.col("speaker_id").alias("speaker")).distinct(), "speaker", "left_semi")
    place = F.row_number().over(Window.partitionBy("speaker", "session").orderBy("name"))  # files of one session
    return with_sessions(named.withColumn("_k", place).where(F.col("_k") <= most).select("path", "length", "speaker", "session"), least_sessions)


def scan_unlabelled(spark: SparkSession, roots: list[str], pattern: str = "*.wav") -> DataFrame:
    """path, length, speaker (UNLABELLED), session and recording of background files of several folders."""
    rows = None
    for root in roots:
        stem = F.regexp_replace("name", r"\.[^.]*$", "")
        base = root.rstrip("/").rsplit("/", 1)[-1]
        one = _listed(spark, root, pattern).select("path", "length", F.lit(UNLABELLED).alias("speaker"), stem.alias("session"), F.concat(F.lit(f"bg-{base}-"), stem).alias("recording"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def pooled(*corpora: DataFrame) -> DataFrame:
    """Several scans as one; a speaker found in two of them raises when the plan runs."""
    marked = [c.withColumn("_root", F.lit(i)) for i, c in enumerate(corpora)]
    rows = marked[0]
    for m in marked[1:]:
        rows = rows.unionByName(m)
    roots = rows.groupBy("speaker").agg(F.count_distinct("_root").alias("_roots"))
    checked = rows.join(roots, "speaker").withColumn("_ok", F.assert_true(F.col("_roots") == 1, F.lit("a speaker occurs in two corpora")))
    return checked.where("_ok is null").drop("_root", "_roots", "_ok")


def with_sessions(rows: DataFrame, least: int) -> DataFrame:
    """Rows of speakers with at least ``least`` sessions."""
    keep = rows.groupBy("speaker").agg(F.count_distinct("session").alias("n")).where(F.col("n") >= least)
    return rows.join(keep, "speaker", "left_semi")


def reject_unlabelled(rows: DataFrame) -> DataFrame:
    if not rows.where(F.col("speaker") == UNLABELLED).isEmpty():
        raise ValueError("unlabelled recordings cannot be scored as speakers")
    return rows


def append(rows: DataFrame, path: str, key: str) -> None:
    """Insert; a key already stored is an error."""
    spark = rows.sparkSession
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
        clash = not rows.join(stored, key, "left_semi").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        clash = False
    if clash or rows.count() != rows.select(key).distinct().count():
        raise ValueError(f"duplicate {key}")
    rows.write.mode("append").parquet(path)


def committed(stored: DataFrame, staged: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What a commit leaves: stored rows, staged rows in their place, without the deleted keys."""
    kept = stored.join(staged.select(key), key, "left_anti").unionByName(staged)
    return kept.join(deleted.select(key), key, "left_anti")
