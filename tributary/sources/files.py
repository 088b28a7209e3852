"""File scans and sinks: uploads, content hashes, cached JSON, partitioned results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIB = 1 << 20

REPRESENTATION = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("codec", T.StringType()),
        T.StructField("audio_codec", T.StringType()),
        T.StructField(
            "shots",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("shot_id", T.StringType()),
                        T.StructField("start", T.DoubleType()),
                        T.StructField("end", T.DoubleType()),
                        T.StructField("transcript", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def scan_uploads(spark: SparkSession, path: str, max_bytes: int, suffix: str = ".mp4") -> DataFrame:
    """(path, length, content, reject): every file below ``path`` with the reason it is refused, if any.

    The file scan itself leaves out files of zero length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reason = F.when(~F.lower("path").endswith(suffix), "unsupported media type").when(F.col("length") > max_bytes, "upload too large")
    return files.select("path", "length", "content", reason.alias("reject"))


def content_hash(content: Column, length: Column) -> Column:
    """16 hexadecimal digits of the size, the first MiB and, above 2 MiB, the last MiB."""
    tail = F.when(length > 2 * MIB, F.substring(content, -MIB, MIB)).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, MIB), tail), 256), 1, 16)


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def read_representations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cached representations, one a file or (``lines``) one a line; a corrupt one gives a row with only _corrupt_record.

    Reads a folder of such files and what ``write_representations`` keeps.
    """
    return spark.read.schema(REPRESENTATION).option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").json(path).drop("key")


def not_cached(uploads: DataFrame, cached: DataFrame) -> DataFrame:
    """Uploads (with video_id) that have no valid cached representation."""
    valid = cached.where(F.col("video_id").isNotNull() & F.col("_corrupt_record").isNull()).select("video_id")
    return uploads.join(valid, "video_id", "left_anti")


def segment_problem(row: Column) -> Column:
    """Whether a cached transcript row (a map of its JSON fields) is no segment: an unknown field, a time or text missing or out of range."""
    known = F.array(*map(F.lit, ["start", "end", "text", "confidence"]))
    sure = row["confidence"].isNull() | F.coalesce(row["confidence"].try_cast("double").between(0, 1), F.lit(False))
    timed = F.coalesce((row["start"].try_cast("double") >= 0) & (row["end"].try_cast("double") >= 0), F.lit(False))
    return (F.size(F.array_except(F.map_keys(row), known)) > 0) | row["text"].isNull() | ~timed | ~sure


def _replace_keys(records: DataFrame, path: str, key: str) -> None:
    """Write one JSON record for each key into a folder of its own; keys that ``records`` doesn't name stay as they are.

    Only the written keys' folders are replaced, each when the whole job has
    ended, so a failed job leaves the cache as it was.
    """
    kept = records.where(F.col(key).isNotNull() & (F.col(key) != ""))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def write_transcripts(segments: DataFrame, path: str) -> None:
    """Keep transcripts in the cache at ``path``: one record for each fingerprint with its segments (fingerprint, start, end, text, confidence) in time order.

    Fingerprints of earlier writes stay, those written again are replaced;
    segments without a fingerprint, or with an empty one, have no place and are left out.
    """
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "text", "confidence")))
    _replace_keys(segments.groupBy("fingerprint").agg(parts.alias("segments")), path, "fingerprint")


def read_transcripts(spark: SparkSession, path: str, fingerprints: list[str] | None = None) -> DataFrame:
    """(fingerprint, segments) of the cache, all or nothing: ``segments`` is null, a miss, where any row of the record is invalid.

    A record holds its whole transcript, so the check needs no shuffle.  An
    empty transcript is a hit without segments; a record cut off in its writing
    is a miss.  With ``fingerprints`` only their folders are read.
    """
    raw = spark.read.schema("segments array<map<string,string>>, fingerprint string").json(path)
    if fingerprints is not None:
        raw = raw.where(F.col("fingerprint").isin(fingerprints))
    sound = F.forall("segments", lambda r: r.isNotNull() & ~segment_problem(r))
    typed = F.transform(
        "segments",
        lambda r: F.struct(r["start"].try_cast("double").alias("start"), r["end"].try_cast("double").alias("end"), r["text"].alias("text"), r["confidence"].try_cast("double").alias("confidence")),
    )
    return raw.where("fingerprint is not null").select("fingerprint", F.when(sound, typed).alias("segments"))


def write_representations(records: DataFrame, path: str) -> None:
    """Keep representations (video_id, ...) in the cache at ``path``, one record for each video; other videos' records stay."""
    _replace_keys(records.withColumn("key", F.col("video_id").cast("string")), path, "key")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as every executor can reach; a temporary one where a local master names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-tributary-"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/steps/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` once below spark.checkpoint.dir and read it back, cutting its lineage.

    Steps that several others use are computed once, and a lost executor costs
    a re-read.  Where no folder is named, a temporary one is set.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, *keys: str) -> None:
    """JSON files, one folder for each value of the keys."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).json(path)


def parse_probe(text: Column) -> Column:
    """Media metadata from a probe's JSON: first video and audio stream, average before nominal frame rate."""
    stream = "codec_type string, codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string"
    probe = F.from_json(text, f"streams array<struct<{stream.replace(' string', ':string').replace(' int', ':int')}>>, format struct<duration:string,bit_rate:string>")

    def first(kind: str) -> Column:
        return F.try_element_at(F.filter(probe["streams"], lambda s: s["codec_type"] == kind), F.lit(1))

    def rate(x: Column) -> Column:
        over, under = F.split(x, "/")[0].try_cast("double"), F.try_element_at(F.split(x, "/"), F.lit(2)).try_cast("double")
        return F.when(under.isNull(), over).when(under != 0, over / under)

    v, a = first("video"), first("audio")
    fps = F.coalesce(F.when(rate(v["avg_frame_rate"]) > 0, rate(v["avg_frame_rate"])), rate(v["r_frame_rate"]), F.lit(0.0))
    return F.struct(
        probe["format"]["duration"].try_cast("double").alias("duration_seconds"), v["width"].alias("width"), v["height"].alias("height"), fps.alias("fps"),
        v["codec_name"].alias("codec"), a.isNotNull().alias("audio_present"), a["codec_name"].alias("audio_codec"), probe["format"]["bit_rate"].try_cast("long").alias("bit_rate"),
    )
