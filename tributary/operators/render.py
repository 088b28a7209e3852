"""Text renderings: payloads for a model-backed provider, evidence, views from prose, shot-relative transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import config
from tributary.functions import text as T
from tributary.operators.merge import marker_view

RULE = "=" * 60
CONTEXT_TITLES = [
    "BASE FULL CONTENT (the original video)", "BRANCH A MECHANICAL EDITS (from Phase 3 alignment)", "BRANCH B MECHANICAL EDITS (from Phase 3 alignment)",
    "BRANCH_A FULL CONTENT (BASE after applying ONLY that branch's edit)", "BRANCH_B FULL CONTENT (BASE after applying ONLY that branch's edit)", "CANDIDATE PAIRS (cross-edit interactions to consider)",
]
CONTEXT_HEADS = [f"{'' if i == 0 else chr(10)}{RULE}\n{t}\n{RULE}" for i, t in enumerate(CONTEXT_TITLES)]


def ordered_lines(rows: DataFrame, keys: list[str], index: str, line: Column) -> DataFrame:
    """One text for each key: its lines in order of ``index``, newline-joined.  A key is one merge's shots."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), line.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("payload"))


def extraction_payload(base: DataFrame) -> DataFrame:
    """What a claim extractor reads: numbered BASE shots with their times."""
    line = F.concat(F.lit("["), F.col("base_index").cast("string"), F.lit("] "), T.clock_millis(F.col("start")), F.lit("-"), T.clock_millis(F.col("end")), F.lit(" "), T.collapse_whitespace(F.col("text")))
    return ordered_lines(base, ["merge_id"], "base_index", line)


def evaluation_payload(claims: DataFrame, base: DataFrame, views: DataFrame) -> DataFrame:
    """What a verdict provider reads for each claim and view: the claim's BASE wording and the view's lines."""
    said = views.where("view <> 'base'").where(F.trim("text") != "")
    body = ordered_lines(said, ["merge_id", "view"], "base_index", F.col("text"))
    meaning = claims.join(base.select("merge_id", "base_index", T.collapse_whitespace(F.col("text")).alias("meaning")), ["merge_id", "base_index"])
    rows = meaning.join(body, "merge_id")
    text = F.concat(F.lit("CLAIM "), "claim_id", F.lit(" ("), "claim_type", F.lit(", "), "importance", F.lit("): "), "meaning", F.lit("\nVIEW "), "view", F.lit(":\n"), "payload")
    return rows.select("merge_id", "claim_id", "view", text.alias("payload"))


#: Labels of an explanation request and the columns behind them, and its last line (fixed values).
EXPLANATION_FIELDS = {
    "claim_id": "claim_id", "claim_meaning": "meaning", "interaction": "interaction", "derivation_reason": "derivation_reason",
    "branch_a_status": "a_status", "branch_b_status": "b_status", "combined_status": "c_status",
}
EXPLANATION_REQUEST = "Write the 1-3 sentence explanation and the recommended resolution."


def explanation_payload(found: DataFrame) -> DataFrame:
    """(merge_id, claim_id, payload): what a provider reads to explain each interaction; claims that don't interact ask for none.

    ``found`` has the interactions with ``meaning`` and ``derivation_reason``; nulls are empty.
    """
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\n")) for label, column in EXPLANATION_FIELDS.items()]
    return found.where("interaction <> 'none'").select("merge_id", "claim_id", F.concat(*lines, F.lit(f"\n{EXPLANATION_REQUEST}")).alias("payload"))


def evidence(rows: DataFrame) -> DataFrame:
    """Why each step got its operation, with its scores to three decimals."""
    three = lambda c: F.format_string("%.3f", F.round(F.col(c), 3))
    op = F.col("operation")
    reason = (
        F.when(op == "insert", "no BASE shot: insert")
        .when(op == "delete", "no branch shot: delete")
        .when(op == "unchanged", F.concat(F.lit("visual "), three("visual"), F.lit(f" >= {config.UNCHANGED_MIN} and transcript agrees: unchanged")))
        .when(op == "trim", F.concat(F.lit("duration differs by "), three("rel_gap"), F.lit(f" < {config.TRIM_MAX_REL_DIFF} and transcript is related: trim")))
        .when(op == "replace", F.concat(F.lit("visual "), three("visual"), F.lit(" anchors BASE and content differs: replace")))
        .otherwise("no rule matched: uncertain")
    )
    return rows.select("merge_id", "branch", "step", "operation", reason.alias("reason"))


def reconstruct_from_prose(base_text: Column, prose: Column) -> Column:
    """BASE clock lines as an edit described in prose leaves them; BASE itself where no line parses."""

    def line(x: Column) -> Column:
        edit = T.marked_edit(x["text"], prose)
        mark = F.when(edit == "delete", "[deleted]").when(edit == "replace", "[replaced]").otherwise(F.concat(F.lit("'"), x["text"], F.lit("'")))
        clock = lambda c: F.format_string("%02d:%02d", F.floor(c / 60), F.floor(c) % 60)
        return F.concat(F.lit("["), clock(x["start"]), F.lit("–"), clock(x["end"]), F.lit("] "), mark)

    return T.let(T.parse_clock_lines(base_text), lambda s: F.when(F.size(s) == 0, base_text).otherwise(F.array_join(F.transform(s, line), "\n")))


def context_payload(base: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """What an analysis provider reads of each merge: BASE, both branches' edits and lines, and the pairs of edits to judge.

    A merge's context is one text by definition; its lines are ordered by
    section and position.
    """
    shot = lambda c: F.when(F.col(c).isNotNull(), F.format_string("shot_%04d", c))
    ts = F.concat(F.lit("["), T.clock_millis(F.col("start")), F.lit("–"), T.clock_millis(F.col("end")), F.lit("]"))
    said = T.collapse_whitespace(F.col("text"))
    shots = base.select("merge_id", F.lit(0).alias("section"), F.col("base_index").alias("pos"), F.concat(F.lit("  "), shot("base_index"), F.lit(" "), ts, F.lit("  "), F.when(said == "", "(no transcript)").otherwise(said)).alias("line"))
    two = lambda name, c: F.when(F.col(c).isNull(), f"{name}=None").otherwise(F.format_string(f"{name}=%.2f", F.round(c, 2)))
    label = F.when(F.col("branch") == "branch_a", "BRANCH A").otherwise("BRANCH B")
    second = lambda first: F.when(F.col("branch") == "branch_a", first).otherwise(first + 1)
    edit = F.format_string(
        "  %s %-9s  base=%-9s  branch=%-9s  conf=%.2f  %s  %s", label, F.col("operation"), F.coalesce(shot("base_index"), F.lit("—")), F.coalesce(shot("branch_index"), F.lit("—")), F.round("confidence", 2), two("visual", "visual"), two("transcript", "transcript"),
    )
    edits = rows.select("merge_id", second(1).alias("section"), F.col("step").alias("pos"), edit.alias("line"))
    lines = marker_view(base, rows).select("merge_id", second(3).alias("section"), F.col("base_index").alias("pos"), F.concat(F.lit("  "), "line").alias("line"))
    per_merge = rows.where("branch = 'branch_b'").groupBy("merge_id").agg(F.count("*").alias("n_b"))
    at = rows.select("merge_id", "branch", "step", F.coalesce(shot("base_index"), F.lit("?")).alias("shot"))
    side = lambda b, x: at.where(F.col("branch") == b).select("merge_id", F.col("step").alias(f"{x}_step"), F.col("shot").alias(f"{x}_shot"))
    p = pairs.join(per_merge, "merge_id").join(side("branch_a", "a"), ["merge_id", "a_step"]).join(side("branch_b", "b"), ["merge_id", "b_step"])
    number = F.col("a_step") * F.col("n_b") + F.col("b_step") + 1
    pair = F.format_string("  Pair %02d: A.%s@%s  ×  B.%s@%s", number, "a_operation", "a_shot", "b_operation", "b_shot")
    judged = p.select("merge_id", F.lit(5).alias("section"), number.alias("pos"), pair.alias("line"))
    heads = F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(t).alias("line")) for i, t in enumerate(CONTEXT_HEADS)]))
    titles = base.select("merge_id").distinct().select("merge_id", heads.alias("h")).select("merge_id", "h.section", F.lit(-1).cast("long").alias("pos"), "h.line")
    body = titles.unionByName(shots).unionByName(edits).unionByName(lines).unionByName(judged)
    parts = F.array_sort(F.collect_list(F.struct("section", "pos", "line")))
    return body.groupBy("merge_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("payload"))


def to_video_time(segments: DataFrame, shots: DataFrame) -> DataFrame:
    """Segments recognised within a shot (times from its start) on the video's time; shots without any stay, with nulls."""
    s = shots.select("video_id", "sequence_index", F.col("start").alias("shot_start"))
    joined = s.join(segments, ["video_id", "sequence_index"], "left")
    return joined.select("video_id", "sequence_index", "seg_no", (F.col("shot_start") + F.col("start")).alias("start"), (F.col("shot_start") + F.col("end")).alias("end"), "text")
