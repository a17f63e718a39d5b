"""Snapshot comparison and merge: keyed full outer joins on content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.functions.canonical import digest, row_digest


def _sides(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    left = a.select(*keys, row_digest(*cols).alias("_a"))
    right = b.select(*keys, row_digest(*cols).alias("_b"))
    return left.join(right, keys, "full_outer")


def semantic_diff(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str],
                  status: str | None = None) -> DataFrame:
    """added, removed or changed per key; with ``status`` also what is newly deprecated."""
    change = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
              .when(F.col("_a") != F.col("_b"), "changed"))
    out = _sides(before, after, keys, cols).select(*keys, change.alias("change")).where(F.col("change").isNotNull())
    if status is None:
        return out
    was = before.where(F.col(status) == "deprecated").select(*keys)
    now = after.where(F.col(status) == "deprecated").select(*keys)
    fresh = now.join(was, keys, "left_anti").withColumn("change", F.lit("deprecated"))
    return out.unionByName(fresh)


def compare_inventory(found: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing from the mapping, present only there, or repeated on a side."""
    a = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("found_count"))
    b = mapped.groupBy(*keys).agg(F.count(F.lit(1)).alias("mapped_count"))
    both = a.join(b, keys, "full_outer").fillna(0, ["found_count", "mapped_count"])
    issue = F.array_compact(F.array(
        F.when(F.col("mapped_count") == 0, F.lit("missing")), F.when(F.col("found_count") == 0, F.lit("extra")),
        F.when(F.col("found_count") > 1, F.lit("duplicate-found")),
        F.when(F.col("mapped_count") > 1, F.lit("duplicate-mapped"))))
    return both.select(*keys, F.explode(issue).alias("issue"))


def verify_manifest(files: DataFrame, lock: DataFrame, key: str = "path", digest_col: str = "sha256") -> DataFrame:
    """File tree against its lock: duplicate entries, missing and extra files, digest mismatches."""
    a = files.groupBy(key).agg(F.count(F.lit(1)).alias("_files"), F.min(digest_col).alias("_actual"))
    b = lock.groupBy(key).agg(F.count(F.lit(1)).alias("_locks"), F.min(digest_col).alias("_locked"))
    both = a.join(b, key, "full_outer")
    issue = F.array_compact(F.array(
        F.when(F.col("_locks") > 1, F.lit("duplicate")), F.when(F.col("_files").isNull(), F.lit("missing")),
        F.when(F.col("_locks").isNull(), F.lit("extra")),
        F.when(F.col("_actual") != F.col("_locked"), F.lit("digest-mismatch"))))
    return both.select(key, F.explode(issue).alias("issue"))


def verify_inventory(actual: DataFrame, lock: DataFrame, key: str = "path") -> DataFrame:
    """Installed packages against the lock: missing, unexpected, other name or version, no integrity."""
    a = actual.select(key, F.col("name").alias("_an"), F.col("version").alias("_av"))
    b = lock.select(key, F.col("name").alias("_bn"), F.col("version").alias("_bv"), "integrity", F.lit(True).alias("_locked"))
    both = a.withColumn("_installed", F.lit(True)).join(b, key, "full_outer")
    issue = F.array_compact(F.array(
        F.when(F.col("_installed").isNull(), F.lit("missing")), F.when(F.col("_locked").isNull(), F.lit("unexpected")),
        F.when(F.col("_an") != F.col("_bn"), F.lit("name-mismatch")),
        F.when(F.col("_av") != F.col("_bv"), F.lit("version-mismatch")),
        F.when(F.col("_locked") & F.col("integrity").isNull(), F.lit("no-integrity"))))
    return both.select(key, F.explode(issue).alias("issue"))


def verify_steps(run: DataFrame, required: DataFrame, allowed_skips: list[str]) -> DataFrame:
    """Steps that ran but are not required, or are required, not skippable and did not pass."""
    passed = run.where(F.col("status") == "passed").select("step_id").distinct()
    missing = (required.where(~F.col("step_id").isin(allowed_skips)).join(passed, "step_id", "left_anti")
               .select("step_id", F.lit("missing").alias("issue")))
    extra = (run.select("step_id").distinct().join(required.select("step_id"), "step_id", "left_anti")
             .select("step_id", F.lit("unexpected").alias("issue")))
    return missing.unionByName(extra)


def merge_snapshot(current: DataFrame, nxt: DataFrame, keys: list[str], cols: list[str], revision: int) -> DataFrame:
    """Next state of a table with the operation per row; ``revision`` stamps what changed.

    ``current`` carries a revision column. Deleted rows are returned with op delete, so that the
    caller can write the rows it keeps and log the rest in one pass.
    """
    old = current.select(*keys, *[F.col(c).alias("_o_" + c) for c in cols],
                         F.col("revision").alias("_revision"), row_digest(*cols).alias("_od"))
    new = nxt.select(*keys, *cols, row_digest(*cols).alias("_nd"))
    op = (F.when(F.col("_od").isNull(), "insert").when(F.col("_nd").isNull(), "delete")
          .when(F.col("_od") != F.col("_nd"), "update").otherwise("keep"))
    both = old.join(new, keys, "full_outer").withColumn("op", op)
    return both.select(
        *keys, *[F.when(F.col("op") == "delete", F.col("_o_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(F.col("op") == "keep", F.col("_revision")).otherwise(F.lit(revision)).alias("revision"), "op")


def append_checked(current: DataFrame, new: DataFrame, keys: list[str], digest_col: str) -> DataFrame:
    """Append-only insert: ``append`` new keys, ``replay`` equal content, ``conflict`` other content."""
    known = current.select(*keys, F.col(digest_col).alias("_known"))
    return (new.join(known, keys, "left")
            .withColumn("outcome", F.when(F.col("_known").isNull(), "append")
                        .when(F.col("_known") == F.col(digest_col), "replay").otherwise("conflict")).drop("_known"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do both frames hold the same rows the same number of times?

    Copies are counted before the join, so repeated rows do not pile up on one task.
    """
    cols = a.columns
    ca = a.groupBy(row_digest(*cols).alias("_d")).agg(F.count(F.lit(1)).alias("_a"))
    cb = b.select(*cols).groupBy(row_digest(*cols).alias("_d")).agg(F.count(F.lit(1)).alias("_b"))
    both = ca.join(cb, "_d", "full_outer").fillna(0, ["_a", "_b"])
    return both.agg(
        F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))), F.lit(0)).alias("only_second"),
        (F.coalesce(F.sum(F.abs(F.col("_a") - F.col("_b"))), F.lit(0)) == 0).alias("equal"))


def verify_migration(expected: DataFrame, actual: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Cutover residue: rows missing, unexpected or different, and how many compare equal."""
    state = (F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing")
             .when(F.col("_a") != F.col("_b"), "different").otherwise("equal"))
    return _sides(expected, actual, keys, cols).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def flatten_state(state: DataFrame) -> DataFrame:
    """Nested tenant states to resource rows: one per space and one per participant."""
    spaces = state.select("component", "tenant_id", F.explode("spaces").alias("space_id", "space"))
    space_rows = spaces.select(
        "component", "tenant_id", F.lit("space").alias("kind"), "space_id", F.lit(None).cast("string").alias("member_id"),
        digest({"spaceId": F.col("space_id"), "state": F.col("space.state")}).alias("sha256"))
    members = spaces.select("component", "tenant_id", "space_id", F.explode("space.participants").alias("p"))
    member_rows = members.select(
        "component", "tenant_id", F.lit("participant").alias("kind"), "space_id", F.col("p.participant_id").alias("member_id"),
        digest({"participantId": F.col("p.participant_id"), "state": F.col("p.state")}).alias("sha256"))
    return space_rows.unionByName(member_rows)


def decision_matrix(cases: DataFrame, results: DataFrame, engines: int) -> DataFrame:
    """Per case: did every engine answer, agree, and give the expected decision?"""
    by_case = results.groupBy("case_id").agg(
        F.count_distinct("engine").alias("answered"), F.count_distinct("decision").alias("decisions"),
        F.min("decision").alias("_decision"))
    joined = cases.join(by_case, "case_id", "left").fillna(0, ["answered", "decisions"])
    verdict = (F.when(F.col("answered") < engines, "incomplete").when(F.col("decisions") > 1, "disagree")
               .when(F.col("_decision") != F.col("expected"), "unexpected").otherwise("agreed"))
    return joined.withColumn("verdict", verdict).drop("_decision")


def cutover_receipt(modes: DataFrame, heads: DataFrame, migrations: DataFrame) -> DataFrame:
    """One row: every component's mode row matches its audit head and the migration is recorded."""
    done = migrations.select("component", F.col("version").alias("_version"))
    joined = modes.join(heads.select("component", F.col("state_root").alias("_root")), "component", "left").join(
        done, "component", "left")
    ok = ((F.col("mode") == "scoped-authoritative") & F.col("state_root").rlike("^[a-f0-9]{64}$")
          & F.col("state_root").eqNullSafe(F.col("_root")) & F.col("_version").isNotNull())
    return joined.agg(F.count(F.lit(1)).alias("components"), F.count_if(ok).alias("consistent"),
                      F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("cutover_valid"))


def capacity_totals(registry: DataFrame) -> DataFrame:
    return registry.groupBy("component").agg(
        F.count(F.lit(1)).alias("scopes"), F.sum("state_bytes").alias("state_bytes"), F.sum("row_count").alias("row_count"))


def table_invariants(df: DataFrame, checks: dict) -> DataFrame:
    """Rows that break each named rule, counted in one pass; a NULL rule result passes, as in CHECK."""
    counts = df.agg(*[F.count_if(F.coalesce(~c, F.lit(False))).alias(n) for n, c in checks.items()],
                    F.count(F.lit(1)).alias("_rows"))
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.explode(pairs).alias("x"), "_rows").select(
        "x.rule", "x.violations", F.col("_rows").alias("row_count"))


def violating_rows(df: DataFrame, checks: dict) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("failed_rules", failed).where(F.size("failed_rules") > 0)
