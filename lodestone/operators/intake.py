"""Admission of session candidates: ownership, classes, acceptance, evaluations, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.instants import age_days
from lodestone.functions.paths import path_ancestors
from lodestone.operators.blocks import lookup

# Candidate classes in listing order (flagged is associated with an evaluation).
CLASS_ORDER = ("pending", "flagged", "associated", "out_of_scope", "ignored", "tombstoned")
RETENTION_WARNING_DAYS = 14
LOSS_RECORDS = 100


def longest_prefix_owner(paths: DataFrame, bindings: DataFrame, path: str = "opening_path") -> DataFrame:
    """Owner of each distinct path: the longest bound root that it equals or lies below, then the smaller project.

    A path lies below a root that it begins with, followed by a slash; so ``/`` owns itself alone. ``bindings`` is (project_id, path). Each path meets the roots by equality
    with one of its ancestors.
    """
    norm = lambda c: F.when(F.length(c) > 1, F.rtrim(c, F.lit("/"))).otherwise(c)
    roots = bindings.groupBy(norm(F.col("path")).alias("_root")).agg(F.min("project_id").alias("project_id"))
    wanted = paths.select(path).filter(F.col(path).isNotNull()).distinct()
    steps = wanted.select(path, F.explode(path_ancestors(F.col(path))).alias("_root"))
    steps = steps.filter((F.col("_root") != "/") | (norm(F.col(path)) == "/"))
    owned = (
        lookup(steps, roots, ["_root"], "inner")
        .groupBy(path)
        .agg(F.min(F.struct((-F.length("_root")).alias("l"), F.col("project_id").alias("p"), F.col("_root").alias("r"))).alias("o"))
        .select(path, F.col("o.p").alias("owner"), F.col("o.r").alias("owner_root"))
    )
    return wanted.join(owned, path, "left")


def classify_candidates(
    candidates: DataFrame,
    project: str,
    owners: DataFrame,
    ignored: DataFrame,
    tombstoned: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """Add ``class`` and ``mapped_project`` to (candidate_id, opening_path, resolvable) rows.

    ``owners`` is (opening_path, owner), ``decisions`` (candidate_id, project_id).
    Ignored beats tombstoned beats the owner of the path; an unresolvable path
    without a decision is pending, then the decision counts.
    """
    flag = lambda df, name: df.select("candidate_id", F.lit(True).alias(name)).distinct()
    joined = (
        lookup(candidates, owners.select("opening_path", "owner"), ["opening_path"])
        .join(flag(ignored, "_ignored"), "candidate_id", "left")
        .join(flag(tombstoned, "_gone"), "candidate_id", "left")
        .join(decisions.select("candidate_id", F.col("project_id").alias("_decided")), "candidate_id", "left")
    )
    path, decided, mine = F.col("opening_path"), F.col("_decided"), F.lit(project)
    by_owner = F.when(F.col("owner") == mine, F.lit("associated")).otherwise(F.lit("out_of_scope"))
    by_decision = F.when(decided == mine, F.lit("associated")).otherwise(F.lit("out_of_scope"))
    cls = (
        F.when(F.col("_ignored"), F.lit("ignored"))
        .when(F.col("_gone"), F.lit("tombstoned"))
        .when(path.isNotNull() & F.col("owner").isNotNull(), by_owner)
        .when(path.isNotNull() & ~F.col("resolvable") & decided.isNull(), F.lit("pending"))
        .when(decided.isNotNull(), by_decision)
        .when(path.isNull(), F.lit("pending"))
        .otherwise(F.lit("out_of_scope"))
    )
    mapped = F.when(cls.isin("associated", "out_of_scope"), F.coalesce("owner", "_decided"))
    return joined.withColumn("class", cls).withColumn("mapped_project", mapped).drop("_ignored", "_gone", "_decided")


def explicit_decisions(decisions: DataFrame) -> DataFrame:
    """Latest decision per candidate of (candidate_id, action, project_id, decided_at).

    An association replaces an ignore and the other way round; of equal times
    the association counts.
    """
    return (
        decisions.groupBy("candidate_id")
        .agg(
            F.max(
                F.struct(
                    "decided_at", (F.col("action") == "associate").alias("assoc"), "action", "project_id"
                )
            ).alias("d")
        )
        .select("candidate_id", "d.action", "d.project_id", "d.decided_at")
    )


def adopt_decisions(
    source: DataFrame, target: DataFrame, from_project: str, to_project: str
) -> DataFrame:
    """Target decisions with those the source held for ``from_project`` or ignored, the target's own winning."""
    mine = (F.col("action") == "associate") & (F.col("project_id") == from_project)
    moved = source.filter(mine | (F.col("action") == "ignore")).withColumn(
        "project_id", F.when(F.col("action") == "associate", F.lit(to_project))
    )
    return target.unionByName(moved.join(target.select("candidate_id"), "candidate_id", "left_anti").select(*target.columns))


def accept_revisions(
    candidates: DataFrame,
    store: DataFrame,
    conflicted: DataFrame,
    only: DataFrame | None = None,
    readmit: bool = False,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Import outcome of classified candidates.

    ``candidates`` is (candidate_id, class, digest, flagged, override); ``store``
    (session_id, digest). The stored digest is unchanged even where flagged;
    flagged bytes need an override. ``only`` (candidate_id) narrows the run to
    the candidates named; such a run, and no other, may ``readmit`` tombstoned
    ones, which a session frozen in a conflict does not hold back. ``errors``
    (candidate_id, message) are sources that could not be read: what would have
    been compared with the store is an ``error`` instead.
    """
    if only is not None:
        candidates = candidates.join(only.select("candidate_id").distinct(), "candidate_id", "left_semi")
    elif readmit:
        raise ValueError("only a run narrowed to named candidates readmits tombstoned ones")
    held = store.select(F.col("session_id").alias("candidate_id"), F.col("digest").alias("stored_digest"))
    frozen = conflicted.select(F.col("session_id").alias("candidate_id"), F.lit(True).alias("_c")).distinct()
    joined = candidates.join(held, "candidate_id", "left").join(frozen, "candidate_id", "left")
    if errors is None:
        joined = joined.withColumn("_e", F.lit(None).cast("boolean"))
    else:
        failed = errors.select("candidate_id", F.lit(True).alias("_e")).distinct()
        joined = joined.join(failed, "candidate_id", "left")
    skipped = ["ignored", "out_of_scope", "pending"] + ([] if readmit else ["tombstoned"])
    outcome = (
        F.when(F.col("class").isin(*skipped), F.col("class"))
        .when((F.col("class") == "associated") & F.col("_c"), F.lit("conflicted"))
        .when(F.col("_e"), F.lit("error"))
        .when(F.col("stored_digest").eqNullSafe(F.col("digest")), F.lit("unchanged"))
        .when(F.col("flagged") & ~F.col("override"), F.lit("flagged"))
        .otherwise(F.lit("accepted"))
    )
    return joined.withColumn("outcome", outcome).drop("_c", "_e")


def accepted_store(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The store after an import: accepted candidates replace or add their session."""
    fresh = outcomes.filter("outcome = 'accepted'").select(
        F.col("candidate_id").alias("session_id"), "digest"
    )
    return store.select("session_id", "digest").join(fresh, "session_id", "left_anti").unionByName(fresh)


def import_report(outcomes: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """Candidates by outcome; the losses among ``evaluations`` (of :func:`evaluation_state`) count as ``pruned_withheld``."""
    report = outcomes.groupBy("outcome").agg(F.count("*").alias("candidates"))
    if evaluations is None:
        return report
    lost = evaluations.filter("action = 'lost'").agg(F.count("*").alias("candidates"))
    return report.unionByName(lost.filter("candidates > 0").select(F.lit("pruned_withheld").alias("outcome"), "candidates"))


# ---- listings ----


def _listed_class() -> Column:
    return F.when((F.col("class") == "associated") & F.col("has_evaluation"), F.lit("flagged")).otherwise(F.col("class"))


def candidate_order() -> list[Column]:
    """Actionable first, then newest, undated last, then id."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), _listed_class())
    return [rank.asc(), F.col("session_time").desc_nulls_last(), F.col("candidate_id").asc()]


def candidate_tallies(candidates: DataFrame) -> DataFrame:
    """One row: candidates per class, and flagged as a part of associated."""
    return candidates.agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in CLASS_ORDER if c != "flagged"],
        F.count_if(_listed_class() == "flagged").alias("flagged"),
    )


def advisories(candidates: DataFrame, evaluations: DataFrame, conflicted: DataFrame, now: Column) -> DataFrame:
    """Importable, pending and withheld counts with the oldest withheld time; zero counts are absent."""
    free = candidates.join(
        conflicted.select(F.col("session_id").alias("candidate_id")).distinct(), "candidate_id", "left_anti"
    )
    no_time, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    importable = free.filter("class = 'associated'").agg(F.count("*").alias("count")).select(
        F.lit("importable").alias("kind"), "count", no_time.alias("oldest"), no_flag.alias("retention_warning")
    )
    pending = candidates.filter("class = 'pending'").agg(F.count("*").alias("count")).select(
        F.lit("pending").alias("kind"), "count", no_time.alias("oldest"), no_flag.alias("retention_warning")
    )
    return importable.unionByName(pending).unionByName(
        withheld(evaluations, now).select(F.lit("withheld").alias("kind"), "count", "oldest", "retention_warning")
    ).filter("count > 0")


def withheld(evaluations: DataFrame, now: Column) -> DataFrame:
    """Count, oldest first-flagged time and whether it nears the source's retention."""
    return evaluations.agg(
        F.count("*").alias("count"),
        F.min(F.coalesce("first_flagged_at", "evaluated_at")).alias("oldest"),
    ).withColumn("retention_warning", age_days(F.col("oldest"), now) >= RETENTION_WARNING_DAYS)


# ---- evaluations of withheld candidates ----


def evaluation_state(
    previous: DataFrame,
    current: DataFrame,
    candidates: DataFrame,
    accepted: DataFrame,
    exempt_harnesses: DataFrame | None = None,
    full_run: bool = True,
) -> DataFrame:
    """Next state of every evaluation: ``action`` is keep, cleared or lost.

    ``previous`` and ``current`` are (candidate_id, harness_id, bundle_digest,
    evaluated_at, first_flagged_at); ``candidates`` the discovered (candidate_id,
    class); ``accepted`` (session_id, digest). The first flagging survives
    re-evaluation. An accepted digest, or a candidate now ignored, out of scope
    or tombstoned, clears. A candidate no longer discovered is lost, unless its
    harness failed or the run was narrowed.
    """
    old = previous.select(
        "candidate_id",
        F.col("harness_id").alias("old_harness"),
        F.col("bundle_digest").alias("old_digest"),
        F.coalesce("first_flagged_at", "evaluated_at").alias("old_first"),
    )
    new = current.select(
        "candidate_id",
        F.col("harness_id").alias("new_harness"),
        F.col("bundle_digest").alias("new_digest"),
        F.coalesce("first_flagged_at", "evaluated_at").alias("new_first"),
    )
    found = candidates.select("candidate_id", F.col("class").alias("_class"))
    held = accepted.select(F.col("session_id").alias("candidate_id"), F.col("digest").alias("_stored"))
    joined = (
        old.join(new, "candidate_id", "full").join(found, "candidate_id", "left").join(held, "candidate_id", "left")
    )
    harness = F.coalesce("new_harness", "old_harness")
    if exempt_harnesses is not None:
        joined = joined.withColumn("_h", harness).join(
            exempt_harnesses.select(F.col("harness_id").alias("_h"), F.lit(True).alias("_exempt")), "_h", "left"
        )
    else:
        joined = joined.withColumn("_exempt", F.lit(None).cast("boolean"))
    digest = F.coalesce("new_digest", "old_digest")
    action = (
        F.when(F.col("_class").isin("ignored", "out_of_scope", "tombstoned"), F.lit("cleared"))
        .when(F.col("_stored") == digest, F.lit("cleared"))
        .when(
            F.col("_class").isNull() & F.col("new_digest").isNull() & F.col("_exempt").isNull() & F.lit(full_run),
            F.lit("lost"),
        )
        .otherwise(F.lit("keep"))
    )
    return joined.select(
        "candidate_id",
        harness.alias("harness_id"),
        digest.alias("bundle_digest"),
        F.coalesce("old_first", "new_first").alias("first_flagged_at"),
        action.alias("action"),
    )


def append_losses(records: DataFrame, additions: DataFrame, keep: int = LOSS_RECORDS) -> DataFrame:
    """The last ``keep`` loss records of (candidate_id, first_flagged_at, pruned_at), each once.

    The bound is the feature: the log holds that many records.
    """
    every = records.unionByName(additions)
    once = every.groupBy("candidate_id", "first_flagged_at").agg(F.min("pruned_at").alias("pruned_at"))
    return once.orderBy(F.desc("pruned_at"), F.desc("candidate_id"), F.desc("first_flagged_at")).limit(keep)


# ---- roll-ups ----


def bundle_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("session_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


def status_rollup(
    sessions: DataFrame, conflicts: DataFrame, ledger: DataFrame, candidates: DataFrame,
    evaluations: DataFrame, losses: DataFrame,
) -> DataFrame:
    """One row of counts over all state tables."""
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return sessions.agg(
        F.count("*").alias("sessions"), F.count_if(F.col("archive_state") == "archived").alias("archived")
    ).select(
        "sessions",
        "archived",
        conflicts.agg(F.count_distinct("session_id").alias("n")).scalar().alias("conflicts"),
        count(ledger).alias("tombstone_events"),
        count(candidates.filter("class = 'pending'")).alias("pending"),
        count(candidates.filter("class = 'associated'")).alias("importable"),
        count(candidates.filter("class = 'ignored'")).alias("ignored"),
        count(evaluations).alias("withheld"),
        count(losses).alias("lost"),
    )


def project_inventory(bindings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Roots, aliases, capture state and session count of each project.

    ``bindings`` is (project_id, path, is_root); ``sessions`` has project_id.
    """
    bound = bindings.groupBy("project_id").agg(
        F.count_if(F.col("is_root")).alias("roots"), F.count_if(~F.col("is_root")).alias("aliases")
    )
    held = sessions.groupBy("project_id").agg(F.count("*").alias("sessions"))
    return bound.join(held, "project_id", "left").select(
        "project_id",
        "roots",
        "aliases",
        F.when(F.col("roots") > 0, F.lit("capturing")).otherwise(F.lit("history_only")).alias("capture_state"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
    )


def bound_paths(bindings: DataFrame, owned: DataFrame) -> DataFrame:
    """Every bound path of every project, a root or an alias, with the sessions it owns.

    ``bindings`` is (project_id, path, is_root), ``owned`` has the ``owner`` and
    ``owner_root`` that :func:`longest_prefix_owner` gives, one row a session.
    """
    held = owned.filter("owner is not null").groupBy("owner", "owner_root").agg(F.count("*").alias("sessions"))
    held = held.select(F.col("owner").alias("project_id"), F.col("owner_root").alias("path"), "sessions")
    root = F.when(F.length("path") > 1, F.rtrim(F.col("path"), F.lit("/"))).otherwise(F.col("path"))
    # A path bound both ways is a root.
    every = bindings.groupBy("project_id", root.alias("path")).agg(F.max("is_root").alias("is_root"))
    capturing = bindings.groupBy("project_id").agg(F.max("is_root").alias("capturing"))
    return lookup(every.join(held, ["project_id", "path"], "left"), capturing, ["project_id"], "inner").select(
        "project_id",
        "path",
        F.when(F.col("is_root"), F.lit("root")).otherwise(F.lit("alias")).alias("bound_as"),
        F.when(F.col("capturing"), F.lit("capturing")).otherwise(F.lit("history_only")).alias("capture_state"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
    )
