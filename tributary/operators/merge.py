"""Three-way composition: edit sets of two branches on BASE positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import text as T
from tributary.operators.ordered import scanned

SIDES = ("branch_a", "branch_b")
EDIT_KINDS = ("unchanged", "delete", "replace", "trim")


def edit_units(rows: DataFrame) -> DataFrame:
    """BASE-anchored units of each branch with kind and text; ``uncertain`` counts as unchanged with no text.

    A BASE position occurs once for each branch; the alignment guarantees it
    and ``check_unique`` proves it for tables from elsewhere.
    """
    op = F.col("operation")
    kind = F.when(op.isin(*EDIT_KINDS), op).otherwise("unchanged")
    replaced = F.when(op == "replace", F.coalesce("branch_text", F.lit(""))).otherwise("")
    retained = F.when(op.isin("trim", "unchanged"), F.coalesce("branch_text", F.lit(""))).otherwise("")
    return rows.where("base_index is not null").select("merge_id", "branch", "base_index", "branch_index", op.alias("operation"), kind.alias("kind"), replaced.alias("replacement_text"), retained.alias("retained_text"), "confidence")


def insert_units(rows: DataFrame) -> DataFrame:
    """Branch-only shots, base_index -1."""
    return rows.where("base_index is null").select("merge_id", "branch", F.lit(-1).cast("long").alias("base_index"), "branch_index", F.col("branch_text").alias("text"), F.col("branch_start").alias("start"), F.col("branch_end").alias("end"))


def check_unique(units: DataFrame) -> DataFrame:
    """The BASE positions that a branch claims more than once (none in a sound edit set)."""
    return units.groupBy("merge_id", "branch", "base_index").agg(F.count("*").alias("n")).where("n > 1")


def attach_inserts(inserts: DataFrame, base: DataFrame) -> DataFrame:
    """Inserts with their anchor: the last BASE shot of the unbroken run that ends by the insert's start, else the first.

    An as-of join within the merge: the run's end so far never falls, so BASE
    shots and inserts stand in one timeline ordered by it and each insert takes
    the last shot before it.  A long merge fills several parts of either order.
    """
    ends = scanned(base.select("merge_id", "base_index", "end"), ["merge_id"], ["base_index"], tops={"at": F.col("end")})
    shots = ends.select("merge_id", "at", F.lit(0).alias("turn"), F.col("base_index").alias("b"))
    asked = inserts.withColumn("at", F.col("start")).withColumn("turn", F.lit(1))
    rows = scanned(shots.unionByName(asked, allowMissingColumns=True), ["merge_id"], ["at", "turn", "b"], lasts={"anchor": F.col("b")})
    first = base.groupBy("merge_id").agg(F.min("base_index").alias("first"))
    rows = rows.where("turn = 1").join(first, "merge_id").withColumn("anchor", F.coalesce("anchor", "first"))
    return rows.select(*inserts.columns, "anchor")


def compose(base: DataFrame, units: DataFrame, attached: DataFrame) -> DataFrame:
    """One slice for each BASE position: verdict, combined text and reason class.

    An insert leaves the position unresolved.  One-sided edits win over
    unchanged; equal edits agree; anything else stays unresolved without text.
    """
    kept = ["kind", "replacement_text", "retained_text", "confidence", "operation"]

    def side(name: str, short: str) -> DataFrame:
        return units.where(F.col("branch") == name).select("merge_id", "base_index", *[F.col(c).alias(f"{short}_{c}") for c in kept])

    counts = attached.groupBy("merge_id", F.col("anchor").alias("base_index")).agg(F.count("*").alias("n_inserts"))
    rows = base.select("merge_id", "base_index", "text", "start", "end")
    for name, short in zip(SIDES, "ab"):
        rows = rows.join(side(name, short), ["merge_id", "base_index"], "left")
    rows = rows.join(counts, ["merge_id", "base_index"], "left").withColumn("n_inserts", F.coalesce("n_inserts", F.lit(0)))
    a, b = F.coalesce("a_kind", F.lit("unchanged")), F.coalesce("b_kind", F.lit("unchanged"))
    lone = F.when(b == "unchanged", a).when(a == "unchanged", b).when((a == "delete") & (b == "delete"), "delete")
    agreed = (
        F.when((a == "replace") & (b == "replace") & (F.col("a_replacement_text") == F.col("b_replacement_text")), "replace")
        .when((a == "trim") & (b == "trim") & (F.col("a_retained_text") == F.col("b_retained_text")), "trim")
    )
    kind = F.when(F.col("n_inserts") > 0, F.lit(None).cast("string")).otherwise(F.coalesce(lone, agreed))
    from_a = a != "unchanged"

    def pick(column: str) -> Column:
        return F.when(from_a, F.col(f"a_{column}")).otherwise(F.col(f"b_{column}"))

    verdict = F.when(kind.isNull(), "unresolved").when(kind == "unchanged", "preserved").when(kind == "delete", "deleted").when(kind == "replace", "replaced").otherwise("trimmed")
    text = F.when(kind == "unchanged", F.col("text")).when(kind == "replace", pick("replacement_text")).when(kind == "trim", pick("retained_text")).otherwise("")
    return rows.withColumn("verdict", verdict).withColumn("combined_text", F.coalesce(text, F.lit("")))


def orphan_inserts(attached: DataFrame, base: DataFrame) -> DataFrame:
    """Inserts whose anchor is no BASE position."""
    return attached.join(base.select("merge_id", F.col("base_index").alias("anchor")), ["merge_id", "anchor"], "left_anti")


def text_lines(rows: DataFrame, index: str, text: str, keys: list[str]) -> DataFrame:
    """Non-blank lines of each key, in order, joined by newlines."""
    lines = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(index).alias("i"), F.col(text).alias("t")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("lines"))


def branch_view(base: DataFrame, rows: DataFrame, branches: tuple[str, ...] = SIDES) -> DataFrame:
    """What each branch says at each BASE position; deleted positions are empty."""
    names = F.explode(F.array(*map(F.lit, branches)))
    lines = base.select("merge_id", "base_index", F.col("text").alias("base_text"), names.alias("branch"))
    own = rows.where("base_index is not null").select("merge_id", "branch", "base_index", "operation", F.coalesce("branch_text", F.lit("")).alias("aligned"), F.coalesce("branch_raw", F.lit("")).alias("raw"))
    joined = lines.join(own, ["merge_id", "branch", "base_index"], "left").withColumn("operation", F.coalesce("operation", F.lit("unchanged")))
    op = F.col("operation")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    said = F.coalesce(filled("aligned"), filled("raw"), F.col("base_text"))
    text = F.when(op == "delete", "").when(op.isin("replace", "trim"), F.coalesce("aligned", F.lit(""))).otherwise(said)
    return joined.select("merge_id", "branch", "base_index", "base_text", "operation", text.alias("text"), (op == "delete").alias("deleted"))


def combined_view(slices: DataFrame) -> DataFrame:
    """What the combination says; unresolved positions are ``uncertain`` and empty.

    Metadata prefers branch A's unit wherever it has one, whichever branch made
    the edit; a deletion takes the greater confidence.
    """
    ops = {"preserved": "unchanged", "replaced": "replace", "trimmed": "trim", "deleted": "delete"}
    op = F.lit("uncertain")
    for verdict, name in ops.items():
        op = F.when(F.col("verdict") == verdict, name).otherwise(op)
    most = F.greatest(F.coalesce("a_confidence", F.lit(0.0)), F.coalesce("b_confidence", F.lit(0.0)))
    confidence = F.when(F.col("verdict") == "deleted", most).when(F.col("verdict").isin("replaced", "trimmed"), F.coalesce("a_confidence", "b_confidence"))
    return slices.select("merge_id", "base_index", F.col("text").alias("base_text"), op.alias("operation"), F.col("combined_text").alias("text"), (F.col("verdict") == "deleted").alias("deleted"), confidence.alias("confidence"))


def four_views(base: DataFrame, branches: DataFrame, combined: DataFrame) -> DataFrame:
    """BASE, both branches and the combination as one table of lines."""
    first = base.select("merge_id", F.lit("base").alias("view"), "base_index", F.lit("unchanged").alias("operation"), "text")
    middle = branches.select("merge_id", F.col("branch").alias("view"), "base_index", "operation", "text")
    last = combined.select("merge_id", F.lit("combined").alias("view"), "base_index", "operation", "text")
    return first.unionByName(middle).unionByName(last)


def marker_view(base: DataFrame, rows: DataFrame, branches: tuple[str, ...] = SIDES) -> DataFrame:
    """Branch lines with markers instead of edited content."""
    names = F.explode(F.array(*map(F.lit, branches)))
    lines = base.select("merge_id", "base_index", "start", "end", T.collapse_whitespace(F.col("text")).alias("text"), names.alias("branch"))
    ops = rows.where("base_index is not null").groupBy("merge_id", "branch", "base_index").agg(F.max_by("operation", "step").alias("operation"))
    joined = lines.join(ops, ["merge_id", "branch", "base_index"], "left").withColumn("op", F.coalesce("operation", F.lit("unchanged")))
    head = F.concat(F.format_string("shot_%04d [", F.col("base_index")), T.clock_millis(F.col("start")), F.lit("–"), T.clock_millis(F.col("end")), F.lit("] "))
    mark = (
        F.when(F.col("op") == "delete", F.concat(F.lit("[DELETED in "), "branch", F.lit("]")))
        .when(F.col("op") == "replace", F.concat(F.lit("[REPLACED in "), "branch", F.lit(" — see edit list]")))
        .when(F.col("op") == "trim", F.concat(F.lit("[TRIMMED in "), "branch", F.lit("] "), "text"))
        .when(F.col("op") == "uncertain", F.concat(F.lit("[UNCERTAIN in "), "branch", F.lit("] "), "text"))
        .otherwise(F.col("text"))
    )
    return joined.select("merge_id", "branch", "base_index", F.concat(head, mark).alias("line"))


def edit_metadata(rows: DataFrame) -> DataFrame:
    """Edits that changed a BASE position."""
    return rows.where(F.col("base_index").isNotNull() & F.col("operation").isin("delete", "replace", "trim")).select("merge_id", "branch", "base_index", "branch_index", "operation", "confidence")


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Every edit of A with every edit of B within a merge, A first."""
    edits = rows.select("merge_id", "branch", "step", "operation")
    a = edits.where("branch = 'branch_a'").select("merge_id", F.col("step").alias("a_step"), F.col("operation").alias("a_operation"))
    b = edits.where("branch = 'branch_b'").select("merge_id", F.col("step").alias("b_step"), F.col("operation").alias("b_operation"))
    return a.join(b, "merge_id")
