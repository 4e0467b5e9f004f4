"""What the new side of a package gains: capability and signal findings, combination rules, orders and contracts.

Every table is keyed by ``pkg``, so that one plan serves any number of packages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockgrain.operators import capabilities as caps
from lockgrain.operators import signals

#: Severities of signal findings before any rule raises them.
SIGNAL_SEVERITY = {"new-external-endpoint": "HIGH", "obfuscation-pattern-added": "MEDIUM", "unparseable-file": "MEDIUM", "entropy-jump": "MEDIUM", "unparseable-bytes-growth": "MEDIUM"}
#: How pressing a lockfile finding makes a package, and that it is new.
URGENCY = {"integrity-changed-version-same": 100, "version-downgrade": 80}
NEW_PACKAGE = 90


#: The wording of details below is fixed as well.


class ContractError(ValueError):
    """Facts that contradict each other; the first violation is named."""


def changed_value() -> Column:
    """What must differ for a capability to count as changed; null where only its addition counts."""
    kind = F.col("kind")
    return F.when(kind == "INSTALL_HOOK", F.concat_ws(" ", "location.applicability", "value")).when(kind.isin("COMMAND_ENTRYPOINT", "RUNTIME_CONSTRAINT"), F.col("value"))


def capability_gains(capabilities: DataFrame) -> DataFrame:
    """Capabilities of the new side that the old side lacks (added) or has with another value (changed), with the old one."""
    old = capabilities.where("side = 'old'").select("pkg", "slot", F.struct("kind", "key", "location", "value", "target_name", "evidence").alias("previous"), changed_value().alias("was"))
    new = capabilities.where("side = 'new'").withColumn("is", changed_value())
    joined = new.join(old, ["pkg", "slot"], "left")
    change = F.when(F.col("previous").isNull(), "added").when(~F.col("is").eqNullSafe(F.col("was")), "changed")
    return joined.withColumn("change", change).where("change is not null").drop("is", "was", "side")


def _file_evidence(file: Column) -> Column:
    return F.array(F.struct(file.alias("file"), F.lit(1).alias("line"), F.lit("").alias("snippet")))


def signal_gains(endpoints: DataFrame, arrays: DataFrame, files: DataFrame, subjects: DataFrame) -> DataFrame:
    """Signal findings (pkg, kind, change, severity, detail, evidence) of the new side against the old one.

    ``subjects`` has pkg and side; growth of unread bytes counts only for packages with an old side.  All other kinds
    take a missing old side as empty.
    """
    side = lambda d, s: d.where(F.col("side") == s).drop("side")
    row = lambda kind, change, detail, evidence: ("pkg", F.lit(kind).alias("kind"), change.alias("change"), F.lit(SIGNAL_SEVERITY[kind]).alias("severity"), detail.alias("detail"), evidence.alias("evidence"))
    new = signals.new_endpoints(side(endpoints, "old"), side(endpoints, "new"), ["pkg"])
    found = new.select(*row("new-external-endpoint", F.lit("added"), F.concat_ws(" ", F.lit("new external"), "endpoint_type", "value"), F.col("evidence")))
    grown = signals.grown_patterns(side(arrays, "old"), side(arrays, "new"), ["pkg", "file"])
    detail = F.when(F.col("change") == "added", F.format_string("%s with %d elements added", "pattern", "n")).otherwise(F.format_string("%s grew from %d to %d elements", "pattern", "n_before", "n"))
    found = found.union(grown.select(*row("obfuscation-pattern-added", F.col("change"), detail, F.col("evidence"))))
    fresh = signals.newly_unparseable(side(files, "old"), side(files, "new"), ["pkg", "file"])
    found = found.union(fresh.select(*row("unparseable-file", F.col("change"), F.format_string("%s is %s (%d bytes)", "file", "state", "bytes"), _file_evidence(F.col("file")))))
    jumps = signals.entropy_jumps(side(files, "old"), side(files, "new"), ["pkg", "file"])
    detail = F.format_string("%s entropy rose from %d to %d millibits/byte (+%d)", F.col("file"), F.col("entropy_before"), F.col("entropy"), F.col("entropy") - F.col("entropy_before"))
    found = found.union(jumps.select(*row("entropy-jump", F.lit("changed"), detail, _file_evidence(F.col("file")))))
    # a package whose old side holds no source has zero unread bytes, not none
    first = F.coalesce(F.min(F.when((F.col("side") == "new") & (F.col("state") != "parsed"), F.col("file"))), F.min(F.when(F.col("side") == "new", F.col("file"))))
    now, was = (F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("state") != "parsed"), F.col("bytes"))), F.lit(0)) for s in ("new", "old"))
    growth = files.groupBy("pkg").agg(now.alias("now"), was.alias("before"), first.alias("file")).where("now > before").join(subjects.where("side = 'old'").select("pkg").distinct(), "pkg", "left_semi")
    detail = F.format_string("unparseable/unsupported source bytes grew from %d to %d (+%d)", F.col("before"), F.col("now"), F.col("now") - F.col("before"))
    return found.union(growth.select(*row("unparseable-bytes-growth", F.lit("changed"), detail, _file_evidence(F.col("file")))))


def judged(gains: DataFrame, signal_findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, signal findings, shapes): severities after the combination rules, and the rules that hold.

    A gain has the higher of its fallback's and its rules' severities.  Shapes have participants, their slots in the
    order of the rule, and signals, the details of the signals that take part.  Signals of a rule are raised as well.
    """
    kind, at, how = F.col("kind"), F.col("location.kind"), F.col("location.applicability")
    by = Window.partitionBy("pkg")
    hidden = signal_findings.where("kind = 'obfuscation-pattern-added'").groupBy("pkg").agg(F.array_sort(F.collect_list("detail")).alias("hidden"))
    rows = gains.join(hidden, "pkg", "left")
    has = lambda *k: F.max(kind.isin(*k)).over(by)
    runs = kind.isin("PROCESS", "DYNAMIC_CODE")
    flags = {
        caps.RULES[0]: kind.isin("NET", "PROCESS", "ENV", "FS_SENSITIVE") & (at == "install-script"),
        caps.RULES[1]: kind.isin("NET", "ENV", "FS_SENSITIVE") & has("NET") & has("ENV", "FS_SENSITIVE"),
        caps.RULES[2]: runs & F.col("hidden").isNotNull(),
        caps.RULES[3]: (kind == "INSTALL_HOOK") & (how == "registry-install"),
        caps.RULES[4]: kind.isin("DYNAMIC_CODE", "NATIVE"),
    }
    rows = rows.withColumn("rules", F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(r)) for r, f in flags.items()])))
    severity = F.when(F.size("rules") > 0, caps.RULES_SEVERITY).otherwise(caps.fallback(kind, how))
    findings = rows.withColumn("severity", severity).drop("hidden")
    joint = [caps.RULES[1], caps.RULES[2]]  # rules of which a package has one row with all that take part
    each = rows.select("pkg", "slot", "kind", "hidden", F.explode("rules").alias("rule"))
    part = F.struct((kind != "NET").cast("int").alias("after"), "slot")
    whole = F.col("rule").isin(*joint)
    shapes = each.groupBy("pkg", "rule", F.when(~whole, F.col("slot")).alias("own")).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.first("hidden").alias("hidden"))
    order = F.array_position(F.array(*map(F.lit, caps.RULES)), F.col("rule")).cast("int")
    shapes = shapes.select("pkg", "rule", order.alias("ord"), F.lit(caps.RULES_SEVERITY).alias("severity"), F.transform("parts", lambda p: p["slot"]).alias("participants"), F.when(F.col("rule") == joint[1], F.col("hidden")).alias("signals"))
    raised = findings.where(F.array_contains("rules", joint[1])).select("pkg").distinct().withColumn("raised", F.lit(caps.RULES_SEVERITY))
    graded = signal_findings.join(raised, "pkg", "left").withColumn("severity", F.when((kind == "obfuscation-pattern-added") & F.col("raised").isNotNull(), F.col("raised")).otherwise(F.col("severity"))).drop("raised")
    return findings, graded, shapes


# --- orders ------------------------------------------------------------------------------------------------------


def finding_order() -> list[Column]:
    """Gravest first, then by slot."""
    return [caps.rank(F.col("severity")), F.col("slot")]


def signal_order() -> list[Column]:
    """Gravest first, then by detail, kind and evidence."""
    return [caps.rank(F.col("severity")), F.col("detail"), F.col("kind"), F.to_json("evidence")]


def diagnostic_order() -> list[Column]:
    """The old side first, then by the first evidence's file and line, and the detail."""
    return [(F.col("side") != "old").cast("int"), F.col("evidence")[0]["file"], F.col("evidence")[0]["line"], F.col("detail")]


def preflight_order(packages: DataFrame, lockfile_findings: DataFrame) -> DataFrame:
    """Add ``score`` and ``position`` (from 1 in each pair): the most pressing first, then small ones, then as listed.

    ``packages`` has pair, ord, name, old_version and bytes (null: not fetched, which comes last).
    """
    urgency = F.when(F.col("kind") == "integrity-changed-version-same", URGENCY["integrity-changed-version-same"]).otherwise(URGENCY["version-downgrade"])
    by_name = lockfile_findings.groupBy("pair", "name").agg(F.max(urgency).alias("urgency"))
    scored = packages.join(by_name, ["pair", "name"], "left")
    score = F.coalesce("urgency", F.lit(0)) + F.when(F.col("old_version").isNull(), NEW_PACKAGE).otherwise(0)
    w = Window.partitionBy("pair").orderBy(F.desc("score"), F.col("bytes").asc_nulls_last(), "ord")
    return scored.withColumn("score", score).drop("urgency").withColumn("position", F.row_number().over(w))


def work_order(packages: DataFrame) -> DataFrame:
    """Add ``position`` (from 1 in each pair): packages with any install hook first, then small ones, then as listed."""
    w = Window.partitionBy("pair").orderBy(F.desc("has_hook"), F.col("bytes").asc_nulls_last(), "ord", "name")
    return packages.withColumn("position", F.row_number().over(w))


# --- sets --------------------------------------------------------------------------------------------------------


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues that are equal in every column once."""
    return issues.dropDuplicates()


def uncovered(findings: DataFrame, shapes: DataFrame, key: str = "slot", column: str = "participants") -> DataFrame:
    """Findings that no shape of their package stands for already."""
    covered = shapes.select("pkg", F.explode(column).alias(key)).distinct()
    return findings.join(covered, ["pkg", key], "left_anti")


# --- contracts ---------------------------------------------------------------------------------------------------


def violations(capabilities: DataFrame, diagnostics: DataFrame, files: DataFrame, endpoints: DataFrame, arrays: DataFrame, subjects: DataFrame) -> DataFrame:
    """(pkg, side, detail) of whatever breaks the contract of capability sets; empty if all is well."""
    row = lambda d, detail: d.select("pkg", "side", detail.alias("detail"))
    bare = lambda d: d.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    out = row(caps.duplicate_slots(capabilities), F.concat(F.lit("duplicate semantic slot "), "slot"))
    out = out.union(row(bare(capabilities), F.concat("kind", F.lit(" has no evidence"))))
    out = out.union(row(bare(diagnostics), F.lit("diagnostic has no evidence")))
    out = out.union(row(subjects.where(empty("name") | empty("version")), F.lit("subject fields must be non-empty")))
    out = out.union(row(files.where(empty("file") | (F.col("bytes") < 0) | ~F.coalesce(F.col("entropy").between(0, 8000), F.lit(True))), F.lit("invalid signal file observation")))
    out = out.union(row(endpoints.where(empty("value") | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)), F.lit("invalid signal endpoint observation")))
    return out.union(row(arrays.where(empty("file") | (F.col("n") <= 0) | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)), F.lit("invalid obfuscation signal observation")))


def check(broken: DataFrame) -> None:
    """ContractError for the first of the violations; one row at most reaches the driver."""
    first = broken.orderBy(*broken.columns).limit(1).collect()
    if first:
        raise ContractError(", ".join(f"{k} {v}" for k, v in first[0].asDict().items()))


def handoff(changed: DataFrame, fetched: DataFrame, keys: list[str]) -> None:
    """ContractError unless ``fetched`` has exactly the rows of ``changed`` in ``keys`` (nulls equal nulls)."""
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    a, b = count(changed, "wanted"), count(fetched, "got").select(*[F.col(k).alias(f"_{k}") for k in keys], "got")
    on = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    odd = a.join(b, on, "full_outer").where(~F.col("wanted").eqNullSafe(F.col("got"))).limit(1).collect()
    if odd:
        raise ContractError(f"stage results do not match their input: {odd[0].asDict()}")
