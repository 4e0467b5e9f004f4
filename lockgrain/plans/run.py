"""The whole run as one plan: lockfile pairs and artifacts in, graded findings out, for any number of pairs at once.

A package that cannot be analysed keeps the reason and costs only itself.  Nothing but totals reaches the driver; the
reports of ``sinks`` are made from one row a package.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.operators import capabilities as caps
from lockgrain.operators import extraction, findings, lockfile
from lockgrain.policy import Policy
from lockgrain.sources import archive, retrieval
from lockgrain.stages import written

ECOSYSTEM = "npm"
TUPLE = ["name", "old_version", "new_version", "old_integrity", "new_integrity", "old_resolved", "resolved_url"]
#: Of several reasons the one of the earliest step counts; the new side's manifest is looked at before any other file.
STAGES = ["old-fetch", "new-fetch", "new-extraction", "new-manifest", "old-extraction", "old-manifest", "analysis"]


@dataclass(frozen=True)
class Run:
    """Tables of a run.  ``packages`` has pair, ord, pkg, the seven fields of a change, bytes, position and status."""

    pairs: DataFrame
    packages: DataFrame
    capabilities: DataFrame
    findings: DataFrame
    signals: DataFrame
    shapes: DataFrame
    diagnostics: DataFrame
    issues: DataFrame
    lockfile_findings: DataFrame
    skipped: DataFrame
    deadline_ms: int


def _stage(side: Column, step: str) -> Column:
    return F.concat(side, F.lit(f"-{step}"))


def analyse(spark: SparkSession, lockfiles: DataFrame, artifacts: DataFrame, allow: DataFrame | None = None, policy: Policy | None = None) -> Run:
    """Compare ``lockfiles`` (pair, side, content; a null or missing old content is a first run) and grade what is gained.

    ``artifacts`` has url and content, and may have kind and detail of failed downloads; ``allow`` has package,
    capability and justification.  LockfileError if a lockfile cannot be read at all, ContractError if the steps
    contradict each other.  Packages that are not reached before the policy's deadline are unavailable.
    """
    policy = policy or Policy()
    stop_at = time.time() + policy.deadline_ms / 1000
    lockfile.validate(lockfiles)
    diff = lockfile.diff(lockfiles)
    pairs = lockfiles.groupBy("pair").agg((~F.coalesce(F.max((F.col("side") == "old") & F.col("content").isNotNull()), F.lit(False))).alias("first_run"))
    changed = written(diff.changed.withColumn("pkg", F.concat_ws("#", F.col("pair").cast("string"), F.col("ord").cast("string"))))
    side = lambda s, v, i, u: changed.select("pair", "ord", "pkg", F.lit(s).alias("side"), "name", F.col(v).alias("version"), F.col(i).alias("integrity"), F.col(u).alias("url"))
    sides = side("old", "old_version", "old_integrity", "old_resolved").where("version is not null").union(side("new", "new_version", "new_integrity", "resolved_url"))
    sides = sides.withColumn("artifact", F.sha2(F.concat_ws("\u0000", F.coalesce("url", F.lit("")), F.coalesce("integrity", F.lit(""))), 256))

    got = written(retrieval.fetched(sides, artifacts, policy.max_tarball_bytes))
    row = lambda d, stage, evidence=None: d.select("pkg", stage.alias("step"), "side", "kind", "detail", "url", (evidence if evidence is not None else F.lit(None).cast(extraction.EVIDENCE)).alias("evidence"))
    reasons = row(got.where("kind is not null"), _stage(F.col("side"), "fetch"))
    files = written(archive.files(got.where("kind is null").select("artifact", "content").dropDuplicates(["artifact"]), max_entries=policy.max_file_count, max_bytes=policy.max_expanded_bytes, ratio=policy.max_decompression_ratio))
    rejected = files.where("rejected is not null").select("artifact", F.col("rejected").alias("kind"))
    verified = got.where("kind is null").drop("kind", "detail", "content")
    failed = verified.join(rejected, "artifact").withColumns({"detail": F.concat(F.lit("archive rejected: "), "kind"), "url": F.lit(None).cast("string")})
    reasons = reasons.union(row(failed, _stage(F.col("side"), "extraction")))

    size = got.groupBy("pkg").agg(F.when(F.max(F.col("kind").isNotNull()), F.lit(None)).otherwise(F.sum(F.length("content"))).cast("long").alias("bytes"))
    ordered = written(findings.preflight_order(changed.join(size, "pkg"), diff.findings))
    good = verified.join(rejected, "artifact", "left_anti").join(ordered.select("pkg", F.col("position").alias("turn")), "pkg")
    declared = written(extraction.manifests(good, files.where("rejected is null"), policy.max_manifest_bytes, stop_at, "turn"))
    bad = declared.where("fact = 'failure'").withColumn("url", F.lit(None).cast("string"))
    late = F.col("kind") == extraction.STOPPED
    reasons = reasons.union(row(bad, F.when(late, "analysis").otherwise(_stage(F.col("side"), "manifest")), F.col("evidence")))
    sourced = written(extraction.sources(files.where("rejected is null"), policy.max_source_bytes, policy.parse_timeout_ms / 1000, stop_at))
    placed = good.select("pkg", "side", "artifact").join(sourced, "artifact")
    stopped = placed.where("fact = 'stopped'").select("pkg", "side", "kind", "detail", F.lit(None).cast("string").alias("url"))
    reasons = reasons.union(row(stopped, F.lit("analysis"))).distinct()

    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("step"))
    first = written(reasons.groupBy("pkg").agg(F.min_by(F.struct("step", "side", "kind", "detail", "url", "evidence"), F.struct(rank, "detail")).alias("reason")))
    packages = written(ordered.join(first.select("pkg", F.lit("unavailable").alias("status")), "pkg", "left").withColumn("status", F.coalesce("status", F.lit("analyzed"))))
    findings.handoff(changed, packages, ["pair", "ord", *TUPLE])
    live = lambda d: d.join(first.select("pkg"), "pkg", "left_anti")
    declared, placed = live(declared), live(placed)
    step = F.col("reason.step")
    stage = F.when(step.endswith("-fetch"), "fetch").otherwise(step)
    told = F.when(stage == "analysis", F.lit(None).cast("string")).otherwise(F.col("reason.side"))
    issues = findings.distinct_issues(first.select("pkg", stage.alias("stage"), told.alias("side"), "reason.kind", "reason.detail", "reason.url", "reason.evidence"))

    hooks = declared.where("fact = 'capability' and kind = 'INSTALL_HOOK'").select("pkg", "side", F.col("key").alias("hook"), "applicability", "command")
    scripts = placed.where("fact = 'detection'").select("pkg", "side", "file", "state", "kind", "line", "snippet")
    held = written(extraction.layers(extraction.declared(declared), extraction.scripted(scripts, hooks)))
    at = F.array(extraction.evidence(F.col("file"), F.col("line"), F.col("snippet")))
    diagnostics = declared.where("fact = 'diagnostic'").select("pkg", "side", "kind", "detail", "evidence")
    diagnostics = written(diagnostics.union(placed.where("fact = 'diagnostic'").select("pkg", "side", "kind", "detail", at)))
    seen = written(extraction.endpoint_observations(placed)), written(extraction.array_observations(placed)), written(extraction.file_observations(placed))
    subjects = live(good.select("pkg", "side", "name", "version"))
    findings.check(findings.violations(held, diagnostics, seen[2], seen[0], seen[1], subjects))
    gains = findings.capability_gains(held)
    signalled = findings.signal_gains(*seen, subjects)
    graded, signals, shapes = findings.judged(written(gains), written(signalled))
    named = packages.select("pkg", "pair", "ord", "name")
    allowed = allow if allow is not None else spark.createDataFrame([], "package string, capability string, justification string")
    allowed = allowed.select(F.col("package").alias("name"), F.col("capability").alias("kind"), "justification")
    final = lambda d: written(caps.suppress(d.join(named, "pkg"), allowed, ["name", "kind"]))
    return Run(pairs, packages, held, final(graded), final(signals), written(shapes), diagnostics, written(issues), written(diff.findings), written(diff.skipped), policy.deadline_ms)


def summary(run: Run) -> DataFrame:
    """A row a pair: changed, analyzed, unavailable and skipped packages, and what the deadline left undone."""
    stopped = run.issues.where(F.col("kind") == extraction.STOPPED).select("pkg", F.lit(True).alias("late"))
    p = run.packages.join(stopped, "pkg", "left").groupBy("pair")
    counts = p.agg(F.count("*").alias("changed"), F.count_if(F.col("status") == "analyzed").alias("analyzed"), F.count_if(F.col("status") != "analyzed").alias("unavailable"), F.count_if("late").alias("unstarted"))
    skips = run.skipped.groupBy("pair").agg(F.count("*").alias("skipped"))
    out = run.pairs.join(counts, "pair", "left").join(skips, "pair", "left")
    return out.na.fill(0, ["changed", "analyzed", "unavailable", "unstarted", "skipped"]).withColumn("partial", F.col("unstarted") > 0)


def severity_totals(run: Run) -> DataFrame:
    """A row a pair: capability and signal findings, and how many of each severity, suppressed ones included."""
    both = run.findings.select("pair", "severity", F.lit(1).alias("c"), F.lit(0).alias("s")).union(run.signals.select("pair", "severity", F.lit(0), F.lit(1)))
    by = both.groupBy("pair").agg(F.sum("c").alias("capability_findings"), F.sum("s").alias("signal_findings"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in caps.SEVERITIES])
    names = [c for c in by.columns if c != "pair"]
    return run.pairs.select("pair").join(by, "pair", "left").na.fill(0, names)


def weighted(run: Run) -> DataFrame:
    """(pair, severity, weight) of everything the gate counts: findings that nobody allowed, facts of the lockfile, and
    artifacts that were not what the lockfile says."""
    open_ = lambda d: d.select("pair", "severity", F.col("suppression").isNull().cast("int").alias("weight"))
    facts = run.lockfile_findings.select("pair", F.when(F.col("kind") == "integrity-changed-version-same", "HIGH").otherwise("INFO").alias("severity"), F.lit(1).alias("weight"))
    wrong = run.issues.where("stage = 'fetch' and kind = 'integrity-mismatch'").join(run.packages.select("pkg", "pair"), "pkg")
    return open_(run.findings).union(open_(run.signals)).union(facts).union(wrong.select("pair", F.lit("CRITICAL"), F.lit(1)))


def unanalysed(run: Run) -> DataFrame:
    """(pair, unanalysed): whether anything of a pair was unavailable, skipped, in doubt or too late."""
    some = run.packages.where("status <> 'analyzed'").select("pair").union(run.skipped.select("pair"))
    some = some.union(run.diagnostics.join(run.packages, "pkg").select("pair")).union(run.issues.join(run.packages, "pkg").select("pair")).distinct()
    return run.pairs.select("pair").join(some.withColumn("unanalysed", F.lit(True)), "pair", "left").na.fill(False, ["unanalysed"])


def records(run: Run) -> DataFrame:
    """One row a package with all that a report says of it: arrays of findings, signals, shapes, diagnostics, issues."""
    capability = F.struct("kind", "key", "location", "value", "target_name", "evidence")
    rows = lambda d, *c, name: d.groupBy("pkg").agg(F.collect_list(F.struct(*c)).alias(name))
    parts = [
        rows(run.findings, "severity", "change", "slot", capability.alias("capability"), "previous", "suppression", name="findings"),
        rows(run.signals, "kind", "severity", "change", "detail", "evidence", "suppression", name="signals"),
        rows(run.shapes, "ord", "rule", "severity", "participants", "signals", name="shapes"),
        rows(run.diagnostics, "side", "kind", "detail", "evidence", name="diagnostics"),
        rows(run.issues, "stage", "side", "kind", "detail", "url", "evidence", name="issues"),
    ]
    out = run.packages
    for p in parts:
        out = out.join(p, "pkg", "left")
    return out
