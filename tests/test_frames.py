"""Frame features against plain loops, and an alignment on fingerprints of frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary import config
from tributary.operators import align, frames, media
from tributary.sources import derived


def plain_axis(line, out):
    """One line of samples resized, sample by sample."""
    n = len(line)
    if n == out:
        return list(line)
    scale = n / out
    wide, result = max(scale, 1.0), []

    def sinc(x):
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    for i in range(out):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        lobe = [sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((k - centre + 0.5) / wide for k in range(first, last))]
        total = sum(lobe)
        whole = [int(w / total * 2**22 + (0.5 if w > 0 else -0.5)) for w in lobe]
        result.append(min(255, max(0, (sum(w * int(v) for w, v in zip(whole, line[first:last])) + 2**21) >> 22)))
    return result


def plain_resize(image, width, height):
    rows = [plain_axis(r, width) for r in image]
    return np.array([plain_axis(c, height) for c in np.array(rows).T.tolist()]).T


@pytest.mark.parametrize("size", [(32, 32), (40, 24), (7, 90), (100, 32), (1, 1), (33, 31)])
def test_resize_equals_sample_by_sample(size):
    rng = np.random.default_rng(size[0])
    image = rng.integers(0, 256, (size[1], size[0], 3), dtype=np.uint8)
    for out in ((32, 32), (1, 1)):
        got = frames.resized(image, *out)
        for c in range(3):
            # The last of the 22 bits may differ where sums of sines are rounded otherwise.
            assert np.abs(got[..., c].astype(int) - plain_resize(image[..., c].tolist(), *out)).max() <= (0 if size == (32, 32) == out else 1)


def test_flat_colours_stay_flat():
    for colour in ((0, 0, 0), (255, 255, 255), (200, 40, 90)):
        image = np.full((48, 64, 3), colour, np.uint8)
        name, rgb, hist = frames.features(image)
        assert rgb == pytest.approx([c / 255 for c in colour]) and sum(hist) == pytest.approx(1)
        assert format(int(name, 16), "064b")[:9] == "".join(format(c >> 5, "03b") for c in colour)


def test_hash_equals_the_cosine_sum():
    rng = np.random.default_rng(3)
    image = np.repeat(rng.integers(0, 256, (32, 32, 1), dtype=np.uint8), 3, axis=2)
    gray = image[..., 0].astype(float)
    low = {}
    basis = media._basis(32)
    for u in range(8):
        for v in range(8):
            low[u, v] = sum(basis[u, x] * gray[x, y] * basis[v, y] for x in range(32) for y in range(32))
    low[0, 0] = 0.0
    middle = sorted(low.values())
    middle = (middle[31] + middle[32]) / 2
    bits = "".join("1" if low[k] > middle else "0" for k in sorted(low))[:55]
    assert format(int(frames.features(image)[0], 16), "064b")[9:] == bits


def test_unreadable_frames(spark):
    rows = [(1, 2, 2, b"x" * 12), (2, 2, 2, b"x"), (3, None, 2, b"x"), (4, 0, 0, b""), (5, 2, 2, None), (6, -1, -1, b"xxx")]
    got = {r.frame: r for r in frames.frame_features(spark.createDataFrame(rows, "frame long, width int, height int, pixels binary")).collect()}
    assert got[1].hash != config.ZERO_HASH and len(got[1].rgb) == 3 and len(got[1].hist) == 12
    assert all(got[k].hash == config.ZERO_HASH and got[k].rgb is None and got[k].hist is None for k in range(2, 7))


def test_chain_from_frames_to_alignment(spark):
    """Shots of one colour each: a branch that drops one and recolours another is aligned by its frames alone."""
    colours = {"black": (5, 5, 5), "white": (250, 250, 250), "red": (220, 20, 20), "green": (20, 200, 20), "blue": (20, 20, 220), "yellow": (230, 220, 20)}
    base, branch = ["black", "white", "red", "green", "blue"], ["black", "red", "yellow", "blue"]
    rng = np.random.default_rng(2)
    pixels, shown, videos = [], [], {1: base, 2: branch}
    for video, names in videos.items():
        for i, name in enumerate(names):
            for k in range(6):
                frame = video * 1000 + i * 6 + k
                width, height = (64, 48) if video == 1 else (50, 40)
                image = np.clip(np.array(colours[name]) + rng.integers(-4, 5, (height, width, 3)), 0, 255).astype(np.uint8)
                pixels.append((frame, width, height, image.tobytes()))
                shown.append((video, frame, i * 3.0 + k * 0.5, 60.0 if k == 0 else 0.0))
    stills = spark.createDataFrame(pixels, "frame long, width int, height int, pixels binary")
    seen = spark.createDataFrame(shown, "video_id long, frame long, ts double, delta double")
    ends = spark.createDataFrame([(v, len(n) * 3.0) for v, n in videos.items()], "video_id long, duration double")
    silent = spark.createDataFrame([], "video_id long, seg_no long, start double, end double, text string")
    shots = frames.with_features(media.process_video(seen, ends, silent), frames.frame_features(stills))
    assert shots.where("keyframe is null").count() == 0
    assert shots.count() == 9
    prints = shots.withColumn("text", F.col("transcript")).withColumn("duration", F.col("end") - F.col("start")).withColumn("vec", F.col("keyframe"))
    prints = derived.fingerprints(prints.drop("hash", "rgb", "hist"), prints.select("vec", "hash", "rgb", "hist"))
    b = prints.where("video_id = 1").withColumn("merge_id", F.lit(1)).withColumnRenamed("sequence_index", "base_index")
    r = prints.where("video_id = 2").withColumns({"merge_id": F.lit(1), "branch": F.lit("branch_a")}).withColumnRenamed("sequence_index", "branch_index")
    rows = align.matches(b, r, align.pair_matrix(b, r), ("branch_a",)).orderBy("step").collect()
    assert [(x.base_index, x.branch_index) for x in rows] == [(0, 0), (1, None), (2, 1), (3, 2), (4, 3)]
    assert rows[0].operation == rows[2].operation == rows[4].operation == "unchanged" and rows[1].operation == "delete" and rows[3].operation != "unchanged"
