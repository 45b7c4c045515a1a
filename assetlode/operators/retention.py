"""What retention takes away: victims by age and cap, orphans, and prefixes within a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.operators import state
from assetlode.operators.ranks import running
from assetlode.schemas import DAY_MS, KEYS, SWEEP_DELETES


def victims(rows: DataFrame, at: str, keys: Sequence[str], before: int, cap: int) -> DataFrame:
    """Keys of rows older than `before`, and of the oldest rows over the cap of each project; ties go by key."""
    newest = [F.col(at).desc(), *(F.col(k).desc() for k in keys)]
    return running(rows.select(*dict.fromkeys((*keys, "project_id", at))), ["project_id"], newest).where((F.col(at) < before) | (F.col("rank") > cap)).select(*keys)


def orphans(children: DataFrame, parents: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Children without a parent; on: pairs of child and parent columns."""
    p = parents.select(*(F.col(parent).alias(child) for child, parent in on)).distinct()
    return children.join(p, [child for child, _ in on], "left_anti")


def unsighted(sources: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sources that no sighting names; sightings without a source name none."""
    return orphans(sources, sightings.where("source_sha256 IS NOT NULL"), [("project_id", "project_id"), ("source_sha256", "source_sha256")])


def within_budget(rows: DataFrame, cost: str, order: Sequence[str], budget: int = SWEEP_DELETES) -> DataFrame:
    """The longest prefix of each project whose costs sum up to the budget at most."""
    return running(rows, ["project_id"], [F.col(c) for c in order], cost, "spent").where(F.col("spent") <= budget)


def cascade(digests: DataFrame, order: Sequence[str], budget: int = SWEEP_DELETES) -> DataFrame:
    """What a budget of deletes takes of digests and their children, in order.

    digests: project_id, sha256, n_children and the order columns. Children go first, as many
    as fit; the digest itself goes only if all of them fit, and it too.
    """
    spent = running(digests.withColumn("_cost", F.col("n_children") + 1), ["project_id"], [F.col(c) for c in order], "_cost", "_spent")
    room = F.greatest(F.lit(0), F.lit(budget) - (F.col("_spent") - F.col("_cost")))
    return spent.select(*digests.columns, F.least("n_children", room).alias("children_deleted"), (room >= F.col("_cost")).alias("digest_deleted"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("project_id", "sha256").distinct()


def one_pass(tables: dict[str, DataFrame], now: int, max_age_days: int, cap: int, audit_cap: int, budget: int = SWEEP_DELETES) -> DataFrame:
    """The deletes of one budgeted pass: stage, project_id, key, cost and spent, in the order of the stages.

    A stage sees the tables as the stages before it leave them; what the budget doesn't reach
    is met by the next pass. An artifact goes with its children, which cost a delete each.
    """
    before = now - max_age_days * DAY_MS
    pair = [("project_id", "project_id"), ("sha256", "sha256")]
    artifacts, observations, analyses = (tables[n] for n in ("artifacts", "observations", "analyses"))
    gone = victims(artifacts, "last_seen_at", KEYS["artifacts"], before, cap)
    children = observations.select("project_id", "sha256").unionAll(analyses.select("project_id", "sha256")).groupBy("project_id", "sha256").agg(F.count("*").alias("_n"))
    stages = [(1, gone.join(artifacts.select("project_id", "sha256", F.col("last_seen_at").alias("at")), ["project_id", "sha256"]).join(children, ["project_id", "sha256"], "left").select("project_id", "at", F.col("sha256").alias("key"), (F.coalesce("_n", F.lit(0)) + 1).alias("cost")))]
    left = artifacts.join(gone, ["project_id", "sha256"], "left_anti")
    for orphan_stage, trim_stage, rows, at, key in ((2, 4, observations, "observed_at", F.concat_ws("/", "sha256", "request_id")), (3, 5, analyses, "started_at", F.concat_ws("/", "sha256", "detector_set_hash"))):
        rest = rows.join(gone, ["project_id", "sha256"], "left_anti")  # children of stage 1 went with it
        lone = orphans(rest, left, pair)
        stages.append((orphan_stage, lone.select("project_id", F.col(at).alias("at"), key.alias("key"), F.lit(1).alias("cost"))))
        kept = rest.join(_pairs(left), ["project_id", "sha256"], "left_semi")
        name = "observations" if trim_stage == 4 else "analyses"
        over = victims(kept, at, KEYS[name], before, cap)
        stages.append((trim_stage, kept.join(over, list(KEYS[name]), "left_semi").select("project_id", F.col(at).alias("at"), key.alias("key"), F.lit(1).alias("cost"))))
    if "audit" in tables:
        over = victims(tables["audit"], "at", KEYS["audit"], -(2**62), audit_cap)
        stages.append((6, tables["audit"].join(over, list(KEYS["audit"]), "left_semi").select("project_id", "at", F.col("event_id").alias("key"), F.lit(1).alias("cost"))))
    found = None
    for stage, rows in stages:
        part = rows.select(F.lit(stage).alias("stage"), "project_id", "at", "key", F.col("cost").cast("long").alias("cost"))
        found = part if found is None else found.unionAll(part)
    return within_budget(found, "cost", ("stage", "at", "key"), budget).select("stage", "project_id", "key", "cost", "spent")


def probes(tables: dict[str, DataFrame], now: int, max_age_days: int, cap: int, audit_cap: int) -> DataFrame:
    """project_id and probe of every bound that still binds and every orphan that is still there; work remains where a project has a row."""
    before = now - max_age_days * DAY_MS
    found: list[DataFrame] = []

    def aged(name: str, at: str, rows: DataFrame | None = None) -> None:
        old = (tables[name] if rows is None else rows).where(F.col(at) < before)
        found.append(old.select("project_id").distinct().withColumn("probe", F.lit(f"{name}_over_age")))

    def capped(name: str, most: int) -> None:
        found.append(tables[name].groupBy("project_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("project_id", F.lit(f"{name}_over_cap").alias("probe")))

    def lone(name: str, rows: DataFrame) -> None:
        found.append(rows.select("project_id").distinct().withColumn("probe", F.lit(name)))

    pair = [("project_id", "project_id"), ("sha256", "sha256")]
    for name, at in (("artifacts", "last_seen_at"), ("observations", "observed_at"), ("analyses", "started_at"), ("source_sightings", "recovered_at")):
        aged(name, at)
        capped(name, cap)
    aged("scans", "started_at", tables["scans"].where("state <> 'suspended'"))  # a suspended scan keeps its position at any age
    capped("scans", cap)
    capped("audit", audit_cap)
    lone("orphan_observations", orphans(tables["observations"], tables["artifacts"], pair))
    lone("orphan_analyses", orphans(tables["analyses"], tables["artifacts"], pair))
    lone("orphan_sightings", orphans(tables["source_sightings"], tables["artifacts"], [("project_id", "project_id"), ("artifact_sha256", "sha256")]))
    lone("unsighted_sources", unsighted(tables["sources"], tables["source_sightings"]))
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


def sweep(tables: dict[str, DataFrame], now: int, max_age_days: int, cap: int, audit_cap: int) -> dict[str, DataFrame]:
    """The tables after a sweep that has no budget: parents go first, then what they leave without a parent."""
    before, out = now - max_age_days * DAY_MS, dict(tables)

    def trim(name: str, at: str, limit: int = cap, oldest: int = before) -> None:
        if name in out:
            out[name] = state.delete(out[name], victims(out[name], at, KEYS[name], oldest, limit), KEYS[name])

    trim("artifacts", "last_seen_at")
    pair = [("project_id", "project_id"), ("sha256", "sha256")]
    for child in ("observations", "analyses"):
        if child in out:
            out[child] = out[child].join(out["artifacts"].select(*(p for _, p in pair)), [c for c, _ in pair], "left_semi")
    trim("observations", "observed_at")
    trim("analyses", "started_at")
    trim("audit", "at", audit_cap, -(2**62))
    if "scans" in out:
        kept = out["scans"].where((F.col("state") == "suspended") | (F.col("started_at") >= before))
        out["scans"] = state.delete(kept, victims(kept, "started_at", KEYS["scans"], -(2**62), cap), KEYS["scans"])
    if "source_sightings" in out:
        out["source_sightings"] = out["source_sightings"].join(out["artifacts"].select("project_id", F.col("sha256").alias("artifact_sha256")), ["project_id", "artifact_sha256"], "left_semi")
        trim("source_sightings", "recovered_at")
        if "sources" in out:
            named = out["source_sightings"].where("source_sha256 IS NOT NULL").select("project_id", "source_sha256").distinct()
            out["sources"] = out["sources"].join(named, ["project_id", "source_sha256"], "left_semi")
    return out
