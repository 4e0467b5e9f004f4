"""What a package gained: slot differences, severities, combination rules, suppressions, counts and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockgrain.functions import text

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
#: Severity of a gained capability when no combination rule applies.
FALLBACK = {
    "DYNAMIC_CODE": "CRITICAL",
    "NATIVE": "CRITICAL",
    "NET": "HIGH",
    "PROCESS": "HIGH",
    "FS_SENSITIVE": "HIGH",
    "ENV": "MEDIUM",
    "FS_WRITE": "MEDIUM",
    "FS_READ": "LOW",
    "UNKNOWN": "LOW",
    "COMMAND_ENTRYPOINT": "LOW",
    "DEPENDENCY": "LOW",
    "RUNTIME_CONSTRAINT": "INFO",
}


def rank(severity: Column) -> Column:
    """0 for the highest severity."""
    out = F.when(severity == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, i)
    return out


def severity_of(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank_ + 1)


def fallback(kind: Column, applicability: Column) -> Column:
    out = F.when(kind == "INSTALL_HOOK", F.when(applicability == "registry-install", "CRITICAL").otherwise("INFO"))
    for k, s in FALLBACK.items():
        out = out.when(kind == k, s)
    return out


def slot(kind: Column, key: Column, location: Column) -> Column:
    """What makes two capabilities the same one: the kind with its hook, command, dependency or runtime, else its place."""
    return F.to_json(F.array(kind, F.when(kind.isin("INSTALL_HOOK", "COMMAND_ENTRYPOINT", "DEPENDENCY", "RUNTIME_CONSTRAINT"), key).otherwise(location)))


def duplicate_slots(capabilities: DataFrame) -> DataFrame:
    """Contract violations: (pkg, side, slot) that occurs more than once."""
    return capabilities.groupBy("pkg", "side", "slot").count().where("count > 1")


def gains(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks (added) or has with another value (changed); what only ``old`` has is ignored."""
    before = old.select(*keys, F.col(value).alias("previous"), F.lit(True).alias("had"))
    joined = new.join(before, keys, "left")
    change = F.when(F.col("had").isNull(), "added").when(~F.col(value).eqNullSafe(F.col("previous")), "changed")
    return joined.withColumn("change", change).where("change is not null").drop("had")


#: Rules over a package's gains, each CRITICAL, in the order in which they are reported.
RULES = ["install-code-execution", "secret-exfiltration", "obfuscated-execution", "install-hook-change", "dynamic-or-native-code"]
RULES_SEVERITY = "CRITICAL"


def shapes(findings: DataFrame, pkg: str = "pkg") -> DataFrame:
    """(pkg, rule, participants): rules that a package's gains fulfil.

    ``findings`` has pkg, kind, location and applicability; obfuscation signals have kind OBFUSCATION.  A package's
    flags are made in one aggregation; rules of single gains give a row each.
    """
    kind, at = F.col("kind"), F.col("location")
    has = lambda *k: F.max(kind.isin(*k))
    flags = findings.groupBy(pkg).agg(
        has("NET").alias("net"),
        has("ENV", "FS_SENSITIVE").alias("secret"),
        has("OBFUSCATION").alias("obfuscated"),
        has("PROCESS", "DYNAMIC_CODE").alias("runs"),
        F.count_if(kind.isin("NET", "ENV", "FS_SENSITIVE")).alias("n_exfiltration"),
        F.count_if(kind.isin("OBFUSCATION", "PROCESS", "DYNAMIC_CODE")).alias("n_obfuscated"),
    )
    single = lambda rule, when: findings.where(when).select(pkg, F.lit(rule).alias("rule"), F.lit(1).cast("long").alias("participants"))
    return (
        single(RULES[0], kind.isin("NET", "PROCESS", "ENV", "FS_SENSITIVE") & (at == "install-script"))
        .union(flags.where("net and secret").select(pkg, F.lit(RULES[1]), "n_exfiltration"))
        .union(flags.where("obfuscated and runs").select(pkg, F.lit(RULES[2]), "n_obfuscated"))
        .union(single(RULES[3], (kind == "INSTALL_HOOK") & (F.col("applicability") == "registry-install")))
        .union(single(RULES[4], kind.isin("DYNAMIC_CODE", "NATIVE")))
    )


def classified(findings: DataFrame, pkg: str = "pkg") -> DataFrame:
    """The gains with the higher severity of their fallback and of the rules they take part in (all CRITICAL).

    ``findings`` is that of ``shapes``.  Obfuscation signals count for the rules and are no gains, so they are not in
    the result.
    """
    kind, w = F.col("kind"), Window.partitionBy(pkg)
    has = lambda *k: F.max(kind.isin(*k)).over(w)
    single = (kind.isin("NET", "PROCESS", "ENV", "FS_SENSITIVE") & (F.col("location") == "install-script")) | ((kind == "INSTALL_HOOK") & (F.col("applicability") == "registry-install")) | kind.isin("DYNAMIC_CODE", "NATIVE")
    sent = kind.isin("NET", "ENV", "FS_SENSITIVE") & has("NET") & has("ENV", "FS_SENSITIVE")
    hidden = kind.isin("PROCESS", "DYNAMIC_CODE") & has("OBFUSCATION")
    severity = F.when(single | sent | hidden, RULES_SEVERITY).otherwise(fallback(kind, F.col("applicability")))
    return findings.withColumn("severity", severity).where(kind != "OBFUSCATION")


def attributed(detections: DataFrame, hooks: DataFrame) -> DataFrame:
    """The detections (pkg, file and more) with location and hook: one row a hook of the package that runs the file.

    ``hooks`` has pkg, hook and command.  Files that no hook runs by a literal ``node FILE`` have the location runtime.
    """
    run = hooks.select("pkg", "hook", text.node_entrypoint(F.col("command")).alias("file")).where("file is not null")
    location = F.when(F.col("hook").isNull(), "runtime").otherwise("install-script")
    return detections.join(run, ["pkg", "file"], "left").withColumn("location", location)


def suppress(findings: DataFrame, allow: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the justification of an allowance; nothing is removed.  Of several allowances of one key the first text counts."""
    one = allow.groupBy(*keys).agg(F.min("justification").alias("suppression"))
    return findings.join(one, keys, "left")


def severity_counts(findings: DataFrame, by: str, severity: str = "severity") -> DataFrame:
    return findings.groupBy(by).agg(*[F.count_if(F.col(severity) == s).alias(f"n_{s.lower()}") for s in SEVERITIES])


def gate(weighted: DataFrame, threshold: str) -> DataFrame:
    """One row: matches at or above the threshold, the highest severity present, and whether the gate fails.

    ``weighted`` has severity and weight; a suppressed finding weighs nothing.
    """
    r = rank(F.col("severity"))
    limit = SEVERITIES.index(threshold)
    counts = weighted.groupBy("severity").agg(F.sum("weight").cast("long").alias("n"))
    matches = F.coalesce(F.sum(F.when(r <= limit, F.col("n"))), F.lit(0)).cast("long")
    top = F.min(F.when(F.col("n") > 0, r))
    return counts.agg(matches.alias("matches"), severity_of(top).alias("highest"), (matches > 0).alias("failed"))


#: Reports whose ids are sent to every task at once; the ids of more are joined by sorting.
BROADCAST_IDS = 2_000_000


def cross_links(dependencies: DataFrame, reports: DataFrame, separator: str | None = None) -> DataFrame:
    """For each dependency finding (id, target) the sorted ids of all reports about that package, or their text if a
    ``separator`` joins them.

    The result grows with the square of a package's rows, so the links of a target are made once, and rows are dealt in
    the order of the target: each task repeats few values, which a columnar file holds once, and none has a whole target.
    """
    links = F.array_sort(F.collect_list("report_id"))
    empty = F.array().cast("array<string>") if separator is None else F.lit("")
    ids = reports.groupBy(F.col("package").alias("target")).agg((links if separator is None else F.array_join(links, separator)).alias("links"))
    if reports.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
        tasks = 4 * dependencies.sparkSession.sparkContext.defaultParallelism
        dependencies = dependencies.repartitionByRange(tasks, "target", "id").sortWithinPartitions("target", "id")
    return dependencies.join(ids, "target", "left").withColumn("links", F.coalesce("links", empty))


def scheduled(packages: DataFrame, has_hook: str, size: str, tie: str) -> DataFrame:
    """Order of work: install hooks first, then small ones; ``position`` from 1 within each ``lane`` of the table."""
    w = Window.partitionBy("lane").orderBy(F.col(has_hook).desc(), F.col(size), F.col(tie))
    return packages.withColumn("position", F.row_number().over(w).cast("long"))


def corpus_totals(bumps: DataFrame) -> DataFrame:
    """One row over a corpus of version bumps (status, findings, diagnostics): how many there are, were analysed or not,
    and have findings, and the sums of findings and diagnostics of the analysed ones.  No bump gives zeros.
    """
    done = F.col("status") == "analyzed"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c)
    return bumps.agg(F.count("*").alias("bumps"), F.count_if(done).alias("analyzed"), F.count_if(~done).alias("unavailable"), F.count_if(done & (F.col("findings") > 0)).alias("with_findings"), total("findings"), total("diagnostics"))
