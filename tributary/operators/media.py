"""Media rows: working-format check, segmentation, keyframes, transcripts to shots, frame features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary import config
from tributary.operators.ordered import scanned


def normalization_reason(codec: Column, width: Column, height: Column, fps: Column, audio_codec: Column) -> Column:
    """Why a video must be re-encoded, by the first rule that applies; null if it need not be."""
    return (
        F.when(~codec.isin("libx264", "h264"), "video codec")
        .when((width <= 0) | (height <= 0), "non-positive dimensions")
        .when((width % 2 != 0) | (height % 2 != 0), "odd dimensions")
        .when(fps <= 0, "non-positive fps")
        .when(audio_codec.isNotNull() & (audio_codec != "aac"), "audio codec")
    )


def segment_shots(frames: DataFrame, threshold: float = config.SCENE_THRESHOLD, durations: DataFrame | None = None) -> DataFrame:
    """Islands of frames between content jumps as (video_id, sequence_index, start, end).

    ``frames`` has video_id, ts (seconds) and delta (content change against the
    frame before).  A shot ends where the next begins, the last at the video's
    last frame; a video of no length has no shots.  With ``durations``
    (video_id, duration) the first shot starts at 0 and the last ends with the
    video, so a video without cuts is one shot (0, duration).
    """
    jump = F.when(F.col("delta") > threshold, 1).otherwise(0)
    rows = scanned(frames, ["video_id"], ["ts", "frame"], sums={"island": jump}, before={"earlier": F.lit(1)})
    # A jump at a video's first frame cuts nothing.
    first = rows.where("earlier is null").select("video_id", F.col("island").alias("opening"))
    rows = rows.join(first, "video_id").withColumn("island", F.col("island") - F.col("opening"))
    shots = rows.groupBy("video_id", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("last"))
    if durations is not None:
        shots = shots.withColumn("start", F.when(F.col("island") == 0, 0.0).otherwise(F.col("start")))
        shots = shots.join(durations.select("video_id", "duration"), "video_id").withColumn("last", F.col("duration")).drop("duration")
    after = shots.select("video_id", (F.col("island") - 1).alias("island"), F.col("start").alias("next"))
    length = shots.groupBy("video_id").agg((F.max("last") - F.min("start")).alias("length"))
    shots = shots.join(after, ["video_id", "island"], "left").join(length, "video_id").withColumn("end", F.coalesce("next", "last"))
    return shots.where("length > 0").select("video_id", F.col("island").cast("long").alias("sequence_index"), "start", "end")


def keyframes(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame at or before each shot's midpoint; none for empty shots.

    An as-of join within the video: midpoints and frames stand in one ordered
    timeline and each midpoint takes the last frame before it.  The work is one
    sort of their rows, and a long video fills several parts of it.
    """
    none = F.lit(None)
    s = shots.where(F.col("end") > F.col("start")).select("video_id", "sequence_index", ((F.col("start") + F.col("end")) / 2).alias("middle"))
    asked = s.select("video_id", F.col("middle").alias("at"), F.lit(1).alias("turn"), none.cast("long").alias("frame"), "sequence_index", "middle")
    shown = frames.select("video_id", F.col("ts").alias("at"), F.lit(0).alias("turn"), F.col("frame").cast("long").alias("frame"), none.cast("long").alias("sequence_index"), none.cast("double").alias("middle"))
    rows = scanned(asked.unionByName(shown), ["video_id"], ["at", "turn", "frame"], lasts={"shown": F.col("frame")})
    return rows.where("turn = 1 and shown is not null").select("video_id", "sequence_index", "middle", F.col("shown").alias("frame"))


def _levelled(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``level``: the power of two of seconds, a millisecond's at least, that their length doesn't pass."""
    return rows.where(F.col(end) > F.col(start)).withColumn("level", F.greatest(F.ceil(F.log2(F.col(end) - F.col(start))), F.lit(-10)).cast("int"))


def _node(time: Column, level: Column) -> Column:
    return F.floor(time / F.pow(F.lit(2.0), level))


def _on_levels(rows: DataFrame, start: str, end: str, levels: DataFrame, own: bool) -> DataFrame:
    """Each row at its own level, and at those of the other side's levels that are higher (or level with it, unless ``own``).

    A row is in two nodes of a level at most.  ``levels`` has one row for each
    power of two in use, some dozens, so it is broadcast.
    """
    other = F.broadcast(levels.select(F.col("level").alias("at")))
    up = rows.join(other, F.col("at") > F.col("level") if own else F.col("at") >= F.col("level")).withColumn("mine", F.lit(not own))
    stay = rows.withColumn("at", F.col("level")).withColumn("mine", F.lit(own))
    both = up.unionByName(stay)
    return both.withColumn("node", F.explode(F.sequence(_node(F.col(start), F.col("at")), _node(F.col(end), F.col("at"))))).drop("level")


def attach_segments(segments: DataFrame, shots: DataFrame) -> DataFrame:
    """Transcript segments on the shots they overlap most; a tie goes to every shot that shares it.

    Rank keeps ties; a segment that overlaps nothing attaches to nothing.  Time
    is cut into dyadic nodes: a pair meets at the level of the longer of the
    two, where that one stands at its own level and the shorter one is looked up
    from its own.  A row stands in two nodes a level at most, however uneven the
    lengths; a pair counts in the node where it begins to overlap.
    """
    h = _levelled(shots.select("video_id", "sequence_index", F.col("start").alias("h_start"), F.col("end").alias("h_end")), "h_start", "h_end")
    said = _levelled(segments, "start", "end")
    # A pair of equal levels is found where the shot stands at its own level.
    left = _on_levels(said, "start", "end", h.select("level").distinct(), own=False)
    right = _on_levels(h, "h_start", "h_end", said.select("level").distinct(), own=True)
    j = left.join(right, ["video_id", "mine", "at", "node"])
    j = j.where((F.col("end") > F.col("h_start")) & (F.col("start") < F.col("h_end")) & (F.col("node") == _node(F.greatest("start", "h_start"), F.col("at"))))
    overlap = F.least("end", "h_end") - F.greatest("start", "h_start")
    best = F.rank().over(W.partitionBy("video_id", "seg_no").orderBy(F.col("overlap").desc()))
    return j.drop("mine", "at", "node").withColumn("overlap", overlap).where("overlap > 0").withColumn("r", best).where("r = 1").drop("r")


def shot_transcripts(attached: DataFrame) -> DataFrame:
    """Words of each shot's segments in segment order."""
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "text")))
    return attached.groupBy("video_id", "sequence_index").agg(F.trim(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("transcript"), F.count("*").alias("n_segments"))


def process_video(frames: DataFrame, durations: DataFrame, segments: DataFrame) -> DataFrame:
    """Videos from decoded rows to shots: segmentation, the keyframe of each shot, its transcript.

    One row for each shot (video_id, shot_id, sequence_index, start, end,
    keyframe, transcript, n_segments); shots without speech have an empty text.
    """
    shots = segment_shots(frames, durations=durations)
    key = ["video_id", "sequence_index"]
    shown = keyframes(shots, frames).select(*key, F.col("frame").alias("keyframe"))
    said = shot_transcripts(attach_segments(segments, shots))
    rows = shots.join(shown, key, "left").join(said, key, "left")
    return rows.select(
        *key, F.format_string("shot_%04d", "sequence_index").alias("shot_id"), "start", "end", "keyframe", F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("n_segments", F.lit(0)).alias("n_segments")
    )


def representations(shots: DataFrame, durations: DataFrame) -> DataFrame:
    """One record for each video (video_id, duration_seconds, shots), as the representation cache keeps it."""
    parts = F.array_sort(F.collect_list(F.struct("sequence_index", "shot_id", "start", "end", "transcript")))
    nested = F.transform(parts, lambda s: F.struct(s["shot_id"].alias("shot_id"), s["start"].alias("start"), s["end"].alias("end"), s["transcript"].alias("transcript")))
    per_video = shots.groupBy("video_id").agg(nested.alias("shots"))
    return per_video.join(durations, "video_id").select(F.col("video_id").cast("string").alias("video_id"), F.col("duration").alias("duration_seconds"), "shots")


def frame_statistics(pixels: DataFrame) -> DataFrame:
    """Mean RGB in [0, 1] and a 12-bin histogram (four bins a channel, sum 1) of frames.

    ``pixels`` has frame, r, g and b (0 to 255), one row for each pixel of the
    reduced image.
    """
    bins = [F.count_if(F.floor(F.col(c) / 64) == b) / F.count("*") / 3.0 for c in "rgb" for b in range(4)]
    return pixels.groupBy("frame").agg(F.array(*[F.avg(c) / 255.0 for c in "rgb"]).alias("rgb"), F.array(*bins).alias("hist"))


def _basis(n: int = 32) -> np.ndarray:
    k = np.arange(n)
    b = np.cos(np.pi * (2 * k[:, None] + 1) * k[None, :] / (2 * n)) * np.sqrt(2 / n)
    b[0, :] *= 1 / np.sqrt(2)  # the first sample's row, as results must agree
    return b


def perceptual_hash(gray: Column, mean: Column) -> Column:
    """16 hexadecimal digits: nine bits of the mean colour, then 55 signs of low frequencies.

    ``gray`` is the 32 x 32 luminance of the frame row by row, ``mean`` its mean
    colour (0 to 255).  Null for an unreadable frame gives the zero hash.
    """
    basis = _basis()

    @F.pandas_udf("string")
    def run(pixels: pd.Series, colours: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(pixels, colours):
            if p is None or c is None or len(p) != 1024:
                out.append(config.ZERO_HASH)
                continue
            low = (basis @ np.asarray(p, float).reshape(32, 32) @ basis.T)[:8, :8].copy()
            low[0, 0] = 0.0
            bits = (low > np.median(low)).ravel()[:55]
            prefix = "".join(format(int(x) >> 5, "03b") for x in c)
            out.append(f"{int(prefix + ''.join('1' if b else '0' for b in bits), 2):016x}")
        return pd.Series(out)

    return run(gray, mean)
