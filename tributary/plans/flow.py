"""The merge pipeline as one lazy plan over all merges, with each step by name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tributary.operators import align, claims, evaluate, gate, merge
from tributary.sources import derived
from tributary.sources.steps import StepStore


class MergeFlow:
    """Steps of the analysis over the derived merge tables of one folder.

    Every step is a DataFrame built from the ones before; nothing runs until a
    result is read.  All joins are on merge_id and what identifies a row within
    the merge.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, claim_records: DataFrame | None = None, verdicts: DataFrame | bool = True, steps: str | None = None):
        """``claim_records`` are extracted claims (see ``claims.from_records``), derived ones without them.

        ``verdicts`` is a provider's table (merge_id, claim_id, view, status,
        confidence, rationale), True for the derived stand-in, False for none,
        so that every status is the surrogate's.  Steps that depend on the given
        tables alone are kept in a store that all flows of the session share;
        ``steps`` names a folder to share them between sessions.
        """
        self.spark, self.sf_dir, self.steps_root = spark, sf_dir, steps
        self.claim_records, self.given_verdicts = claim_records, verdicts

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def store(self) -> StepStore:
        return StepStore(self.spark, *[f"{self.sf_dir}/{t}.parquet" for t in ("conversations", "embeddings", "benchmark")], root=self.steps_root)

    @cached_property
    def base(self) -> DataFrame:
        return self.store.step("base", lambda: derived.base_shots(self.spark, self.sf_dir))

    @cached_property
    def script(self) -> DataFrame:
        return derived.edit_script(self.base)

    @cached_property
    def branch(self) -> DataFrame:
        return derived.branch_shots(self.spark, self.sf_dir, self.base)

    @cached_property
    def features(self) -> DataFrame:
        return derived.features(self.spark, self.sf_dir)

    @cached_property
    def base_prints(self) -> DataFrame:
        return derived.fingerprints(self.base, self.features)

    @cached_property
    def branch_prints(self) -> DataFrame:
        return derived.fingerprints(self.branch, self.features)

    @cached_property
    def pairs(self) -> DataFrame:
        return align.pair_matrix(self.base_prints, self.branch_prints)

    @cached_property
    def scored(self) -> DataFrame:
        """The pair matrix without the shots' features, written once."""
        return self.store.step("scored", lambda: self.pairs.drop(*[c for c in self.pairs.columns if c[:2] in ("b_", "r_")]))

    @cached_property
    def matches(self) -> DataFrame:
        """Aligned and classified steps, written once: every later step starts here."""
        return self.store.step("matches", lambda: align.matches(self.base_prints, self.branch_prints, self.scored, derived.BRANCHES))

    @cached_property
    def units(self) -> DataFrame:
        return merge.edit_units(self.matches)

    @cached_property
    def attached(self) -> DataFrame:
        return self.store.step("attached", lambda: merge.attach_inserts(merge.insert_units(self.matches), self.base))

    @cached_property
    def slices(self) -> DataFrame:
        return merge.compose(self.base, self.units, self.attached)

    @cached_property
    def branch_views(self) -> DataFrame:
        return merge.branch_view(self.base, self.matches)

    @cached_property
    def combined(self) -> DataFrame:
        return merge.combined_view(self.slices)

    @cached_property
    def claims(self) -> DataFrame:
        if self.claim_records is not None:
            return claims.from_records(self.claim_records)[0]
        return claims.derived_claims(self.base)

    @cached_property
    def regions(self) -> DataFrame:
        if self.claim_records is not None:
            return claims.from_records(self.claim_records)[1]
        return claims.claim_regions(self.claims, self.base)

    @cached_property
    def projected(self) -> DataFrame:
        build = lambda: claims.project(self.regions, claims.cuts(self.units, self.base))
        return build() if self.claim_records is not None else self.store.step("projected", build)

    @cached_property
    def surrogate(self) -> DataFrame:
        return claims.surrogate(self.claims, self.projected)

    @cached_property
    def verdicts(self) -> DataFrame:
        given = self.given_verdicts
        if isinstance(given, bool):
            given = claims.derived_verdicts(self.claims) if given else None
        return claims.with_verdicts(self.surrogate, given)

    @cached_property
    def interactions(self) -> DataFrame:
        return claims.interactions(self.verdicts, self.claims)

    @cached_property
    def gate_shots(self) -> DataFrame:
        return gate.judged(gate.derived_gate_shots(self.base, self.branch, self.matches))

    @cached_property
    def runs(self) -> DataFrame:
        return evaluate.derived_runs(self.base.select("merge_id").distinct())

    @cached_property
    def attempts(self) -> DataFrame:
        from pyspark.sql import functions as F

        rows = evaluate.derived_attempts(self.table("events"))
        return rows.withColumn("category", F.when(~F.col("ok"), evaluate.classify_failure(F.col("message"), F.col("error_class"))))
