"""Reports of a run: bounded JSON for each package and run, text, SARIF, a Markdown summary, and the gate.

A report is built from one record a package (a row of ``plans.run.records``), so packages can be rendered in parallel;
a pair's report joins those of its packages on the driver, or in one task a pair by ``run_reports``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.operators.capabilities import SEVERITIES
from lockgrain.plans.run import ECOSYSTEM, Run
from lockgrain.plans.run import records as run_records
from lockgrain.plans.run import summary as run_summary
from lockgrain.policy import parse_fail_on

#: The layout's version, and most code points of each kind of text.
SCHEMA_VERSION = 4
IDENTITY, VALUE, FILE, SNIPPET, DIGEST = 160, 240, 200, 240, 128
#: Code points and rows of the Markdown summary, and of its cells.
MAX_SUMMARY, MAX_ROWS, CELL_IDENTITY, CELL_DETAIL = 60_000, 10, 120, 200
NAME = "lockgrain"
MARK = f"<!-- {NAME}:capability-report:v2 -->"
OLD_MARKS = [f"<!-- {NAME} report -->"]


class ReportError(ValueError):
    """A record that contradicts itself."""


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def report_id(name: str, version: str) -> str:
    return f"{NAME}-" + hashlib.sha256(f"{ECOSYSTEM}\0{name}\0{version}".encode("utf-8", "surrogatepass")).hexdigest()[:20]


def _rank(severity: str) -> int:
    return SEVERITIES.index(severity)


def _need(ok: bool, detail: str) -> None:
    if not ok:
        raise ReportError(detail)


# --- one package -------------------------------------------------------------------------------------------------


def _evidence(items: list[dict] | None) -> list[dict]:
    _need(bool(items), "report item has no evidence")
    _need(all(type(e["line"]) is int and e["line"] > 0 for e in items), "evidence line must be a positive integer")
    return [{"file": cut(e["file"], FILE), "line": e["line"], "snippet": cut(e["snippet"], SNIPPET)} for e in items]


def capability(c: dict) -> dict:
    """A capability as reports show it."""
    kind, evidence = c["kind"], _evidence(c["evidence"])
    if kind == "INSTALL_HOOK":
        own = {"hook": c["key"], "applicability": c["location"]["applicability"], "contentDigest": {"algorithm": "sha256", "value": cut(c["value"], DIGEST)}}
    elif kind == "COMMAND_ENTRYPOINT":
        own = {"command": cut(c["key"], IDENTITY), "target": cut(c["value"], VALUE)}
    elif kind == "DEPENDENCY":
        own = {"name": cut(c["key"], IDENTITY), "requirement": cut(c["value"], VALUE)}
        if c["target_name"] is not None:
            own["targetName"] = cut(c["target_name"], IDENTITY)
    elif kind == "RUNTIME_CONSTRAINT":
        own = {"runtime": cut(c["key"], IDENTITY), "requirement": cut(c["value"], VALUE)}
    else:
        own = {"location": {k: v for k, v in c["location"].items() if v is not None}}
    return {"kind": kind, **own, "evidence": evidence}


def _suppressed(reason: str | None) -> dict:
    return {} if reason is None else {"suppression": {"reason": cut(reason, VALUE)}}


def _signal(s: dict) -> dict:
    return {"kind": s["kind"], "severity": s["severity"], "change": s["change"], "detail": cut(s["detail"], VALUE), "evidence": _evidence(s["evidence"]), **_suppressed(s["suppression"])}


def _issue(i: dict) -> dict:
    some = i["evidence"]
    return {"stage": i["stage"], "side": i["side"], "kind": i["kind"], "detail": cut(i["detail"], VALUE), "url": None if i["url"] is None else cut(i["url"], VALUE), "evidence": _evidence(some)[0] if some else None}


def _list(record: dict, name: str) -> list[dict]:
    return record.get(name) or []


def ordered(record: dict) -> dict:
    """The record with its lists in the order of reports."""
    text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return record | {
        "findings": sorted(_list(record, "findings"), key=lambda f: (_rank(f["severity"]), f["slot"])),
        "signals": sorted(_list(record, "signals"), key=lambda s: (_rank(s["severity"]), s["detail"], s["kind"], text(s["evidence"]))),
        "shapes": sorted(_list(record, "shapes"), key=lambda s: (s["ord"], s["participants"])),
        "diagnostics": sorted(_list(record, "diagnostics"), key=lambda d: (d["side"] != "old", d["evidence"][0]["file"], d["evidence"][0]["line"], d["detail"])),
        "issues": sorted(_list(record, "issues"), key=text),
    }


def _identity(record: dict) -> dict:
    old = record["old_version"]
    return {"ecosystem": ECOSYSTEM, "name": cut(record["name"], IDENTITY), "oldVersion": None if old is None else cut(old, IDENTITY), "newVersion": cut(record["new_version"], IDENTITY), "newPackage": old is None}


def check_change(record: dict) -> None:
    """The contract of a changed package: a whole new side, and an old side that is whole or missing."""
    _need(all(record[f] for f in ("name", "new_version", "new_integrity", "resolved_url")), "changed package requires non-empty new-side fields")
    none = [record[f] is None for f in ("old_version", "old_integrity", "old_resolved")]
    _need(all(none) or not any(none), "changed package old-side fields must be null as a unit")


def package_report(record: dict) -> dict:
    """The report of an analysed package; ReportError if the record contradicts itself."""
    record = ordered(record)
    for f in record["findings"]:
        _need((f["change"] == "added") == (f["previous"] is None), f"{f['change']} finding has inconsistent previous capability")
    findings = [{"severity": f["severity"], "change": f["change"], "capability": capability(f["capability"]), "previous": None if f["previous"] is None else capability(f["previous"]), **_suppressed(f["suppression"])} for f in record["findings"]]
    signals = [_signal(s) for s in record["signals"]]
    by_slot = {f["slot"]: capability(f["capability"]) for f in record["findings"]}
    hidden = [s for s in signals if s["kind"] == "obfuscation-pattern-added"]
    shapes = []
    for s in record["shapes"]:
        _need(bool(s["participants"]) and all(p in by_slot for p in s["participants"]), "shape finding has no capabilities")
        shapes.append({"ruleId": s["rule"], "severity": s["severity"], "capabilities": [by_slot[p] for p in s["participants"]], **({"signals": hidden} if s["signals"] is not None else {})})
    diagnostics = [{"side": d["side"], "kind": d["kind"], "detail": cut(d["detail"], VALUE), "evidence": _evidence(d["evidence"])} for d in record["diagnostics"]]
    counts = {s: sum(x["severity"] == s for x in [*findings, *signals]) for s in SEVERITIES}
    return {
        "schemaVersion": SCHEMA_VERSION,
        "package": _identity(record),
        "reportId": report_id(record["name"], record["new_version"]),
        "summary": {"findings": len(findings) + len(signals), "capabilityFindings": len(findings), "signalFindings": len(signals), "diagnostics": len(diagnostics), "bySeverity": counts},
        "findings": findings,
        "signalFindings": signals,
        "shapes": shapes,
        "diagnostics": diagnostics,
    }


def package_entry(record: dict) -> dict:
    """A package in a run's report: analysed with its report, or unavailable with its failures."""
    check_change(record)
    issues = [_issue(i) for i in ordered(record)["issues"]]
    if record["status"] == "analyzed":
        return {"status": "analyzed", "report": package_report(record), "issues": issues}
    _need(bool(issues), "unavailable package has no failure")
    return {"status": "unavailable", "package": _identity(record), "failures": issues}


# --- a run -------------------------------------------------------------------------------------------------------


def run_report(entries: list[dict], lockfile_findings: list[dict], skipped: list[dict], totals: dict) -> dict:
    """The report of one pair; ``totals`` is its row of ``plans.run.summary``."""
    done = [e["report"] for e in entries if e["status"] == "analyzed"]
    _need((totals["changed"], totals["analyzed"], totals["unavailable"], totals["skipped"]) == (len(entries), len(done), len(entries) - len(done), len(skipped)), "analysis-run summary does not match its package and skip records")
    ids: dict[str, list[str]] = {}
    for r in done:
        ids.setdefault(r["package"]["name"], []).append(r["reportId"])
    for f in (f for r in done for f in r["findings"] if f["capability"]["kind"] == "DEPENDENCY"):
        if related := ids.get(f["capability"].get("targetName", f["capability"]["name"])):
            f["relatedReportIds"] = sorted(related)
    total = lambda name: sum(r["summary"][name] for r in done)
    issues = sum(len(e.get("issues", e.get("failures", []))) for e in entries)
    short = lambda v: None if v is None else cut(v, IDENTITY)
    out = {
        "schemaVersion": SCHEMA_VERSION,
        "firstRun": totals["first_run"],
        "summary": {
            "changedPackages": len(entries),
            "analyzedPackages": len(done),
            "unavailablePackages": len(entries) - len(done),
            "skippedLockfileEntries": len(skipped),
            "capabilityFindings": total("capabilityFindings"),
            "signalFindings": total("signalFindings"),
            "analysisDiagnostics": total("diagnostics"),
            "analysisIssues": issues,
            "lockfileFindings": len(lockfile_findings),
            "bySeverity": {s: sum(r["summary"]["bySeverity"][s] for r in done) for s in SEVERITIES},
        },
        "packages": entries,
        "lockfileFindings": [{"kind": f["kind"], "name": cut(f["name"], IDENTITY), "path": cut(f["path"], FILE), "oldVersion": short(f["old_version"]), "newVersion": short(f["new_version"])} for f in lockfile_findings],
        "skipped": [{"name": cut(s["name"], IDENTITY), "path": cut(s["path"], FILE), "reason": s["reason"], "detail": cut(s["detail"], VALUE)} for s in skipped],
    }
    if "deadline_ms" in totals:
        late = totals["unstarted"]
        out["budget"] = {"deadlineMs": totals["deadline_ms"], "prioritization": "install-script-first", "startedPackages": len(entries) - late, "completedPackages": len(entries), "unstartedPackages": late, "deadlineExceeded": late > 0, "partial": late > 0}
    return out


def _records(run: Run) -> DataFrame:
    return run_records(run).select("pair", "ord", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def package_entries(run: Run) -> DataFrame:
    """(pair, ord, entry): each package's part of the report as JSON, rendered where its row is."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(package_entry(json.loads(r)), ensure_ascii=False) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int64()), pa.array(out, pa.string())], names=["pair", "ord", "entry"])

    df = _records(run)
    return df.select(F.col("pair").cast("string"), F.col("ord").cast("long"), "record").mapInArrow(render, "pair string, ord long, entry string")


def run_reports(run: Run) -> DataFrame:
    """(pair, report): the JSON report of every pair, one task a pair.

    A pair's packages are those of one lockfile, so a task holds what one report holds.
    """
    facts = run.lockfile_findings.groupBy("pair").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "kind", "name", "old_version", "new_version"))), {"ignoreNullFields": "false"}).alias("facts"))
    skips = run.skipped.groupBy("pair").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "name", "reason", "detail"))), {"ignoreNullFields": "false"}).alias("skips"))
    packages = package_entries(run).groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda p: p["entry"]).alias("entries"))
    totals = run_summary(run)
    totals = totals.select(F.col("pair").cast("string").alias("pair"), F.to_json(F.struct("*", F.lit(run.deadline_ms).alias("deadline_ms"))).alias("totals"))
    rows = totals.join(packages, "pair", "left").join(facts.withColumn("pair", F.col("pair").cast("string")), "pair", "left").join(skips.withColumn("pair", F.col("pair").cast("string")), "pair", "left")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for totals, entries, facts, skips in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                out.append(json.dumps(run_report([json.loads(e) for e in entries or []], json.loads(facts or "[]"), json.loads(skips or "[]"), json.loads(totals)), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["pair", "report"])

    return rows.select("pair", "totals", "entries", "facts", "skips").mapInArrow(render, "pair string, report string")


def report_of(run: Run, pair: str) -> dict:
    """The report of one pair, brought to the driver."""
    return json.loads(run_reports(run).where(F.col("pair") == pair).first()["report"])


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


#: The wording of text, SARIF and Markdown below is that of fixed formats.

# --- text --------------------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _count(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def _severities(counts: dict[str, int]) -> str:
    return ", ".join(f"{s}: {counts[s]}" for s in SEVERITIES if counts[s])


def _where(e: dict) -> str:
    return f"{_quoted(e['file'])}:{e['line']} — {_quoted(e['snippet'])}"


def _evidence_lines(items: list[dict]) -> Iterator[str]:
    return (f"  Evidence: {_where(e)}" for e in items)


def _bump(p: dict) -> str:
    old = "<new package>" if p["oldVersion"] is None else _quoted(p["oldVersion"])
    return f"{_quoted(p['name'])} ({_quoted(p['ecosystem'])}) {old} -> {_quoted(p['newVersion'])}"


def _allowed(item: dict, form: str = " (suppressed ({}))", show=_quoted) -> str:
    return form.format(show(item["suppression"]["reason"])) if "suppression" in item else ""


def _described(f: dict) -> str:
    c, change = f["capability"], f["change"]
    match c["kind"]:
        case "INSTALL_HOOK":
            return f"{_quoted(c['hook'])} {'registry install' if c['applicability'] == 'registry-install' else 'git-only'} hook {change}"
        case "COMMAND_ENTRYPOINT":
            return f"command {_quoted(c['command'])} entrypoint {change}: {_quoted(c['target'])}"
        case "DEPENDENCY":
            see = ", ".join(map(_quoted, f.get("relatedReportIds", [])))
            return f"dependency {_quoted(c['name'])} {change}: {_quoted(c['requirement'])}" + (f" -> see {see}" if see else "")
        case "RUNTIME_CONSTRAINT":
            return f"runtime {_quoted(c['runtime'])} constraint {change}: {_quoted(c['requirement'])}"
    return f"{_quoted(c['kind'])} capability {change} in {_quoted(c['location']['kind'])} code"


def package_text(report: dict) -> list[str]:
    """A package's report in lines; outside text is quoted as JSON, so that control signs stay inert."""
    s = report["summary"]
    gained = f"{_count(s['findings'], 'finding')} ({_severities(s['bySeverity'])})" if s["findings"] else "no capability or signal additions"
    out = [f"{NAME} manifest capability report", f"Package: {_bump(report['package'])}", f"Review this change: {gained}; {_count(len(report['diagnostics']), 'diagnostic')}."]
    if report["shapes"]:
        out += ["", "Capability shapes:", *(f"- [{x['severity']}] {_quoted(x['ruleId'])} ({len(x['capabilities'])} {'capability' if len(x['capabilities']) == 1 else 'capabilitys'})" for x in report["shapes"])]
    for title, items, line in (
        ("Findings:", report["findings"], lambda f: (f"- [{f['severity']}] {_described(f)}{_allowed(f)}", f["capability"]["evidence"])),
        ("Signals:", report["signalFindings"], lambda f: (f"- [{f['severity']}] {_quoted(f['detail'])}{_allowed(f)}", f["evidence"])),
        ("Unanalyzed data:", report["diagnostics"], lambda d: (f"- [{d['side']}] {_quoted(d['detail'])}", d["evidence"])),
    ):
        if items:
            out += ["", title]
        for item in items:
            head, evidence = line(item)
            out += [head, *_evidence_lines(evidence)]
    return out


def _issue_text(i: dict) -> str:
    more = [f"URL {_quoted(i['url'])}"] * (i["url"] is not None) + ([f"Evidence {_where(i['evidence'])}"] if i["evidence"] else [])
    return f"- [{i['stage']}/{i['kind']}] {_quoted(i['detail'])}" + (f"; {'; '.join(more)}" if more else "")


def to_text(report: dict) -> str:
    """A run's report for terminals.  A first run shows totals alone; its JSON has everything."""
    s, budget = report["summary"], report.get("budget")
    severities = _severities(s["bySeverity"])
    out = [
        f"{NAME} capability analysis report",
        "Mode: first run (aggregate text; full details are in JSON)" if report["firstRun"] else "Mode: comparison",
        f"Packages: {s['changedPackages']} changed; {s['analyzedPackages']} analyzed; {s['unavailablePackages']} unavailable; {_count(s['skippedLockfileEntries'], 'lockfile skip')}.",
        f"Signals: {_count(s['capabilityFindings'] + s['signalFindings'], 'finding')}{f' ({severities})' if severities else ''}; {_count(s['lockfileFindings'], 'lockfile finding')}; {_count(s['analysisIssues'], 'analysis issue')}; {_count(s['analysisDiagnostics'], 'analysis diagnostic')}.",
    ]
    if budget and budget["partial"]:
        why = f"{budget['deadlineMs']}ms wall-clock budget ended" if budget["deadlineExceeded"] else "caller cancellation stopped the run"
        out.append(f"Analysis budget: partial; {budget['unstartedPackages']} package(s) were not started before {why}.")
    if report["firstRun"]:
        return "\n".join(out) + "\n"
    for e in report["packages"]:
        if e["status"] == "analyzed":
            out += ["", *package_text(e["report"])]
            if e["issues"]:
                out += ["Analysis issues:", *map(_issue_text, e["issues"])]
        else:
            out += ["", f"Unavailable package: {_bump(e['package'])}", *map(_issue_text, e["failures"])]
    old = lambda f: "<new package>" if f["oldVersion"] is None else _quoted(f["oldVersion"])
    if report["lockfileFindings"]:
        out += ["", "Lockfile findings:", *(f"- [{f['kind']}] {_quoted(f['name'])} at {_quoted(f['path'])}: {old(f)} -> {_quoted(f['newVersion'])}" for f in report["lockfileFindings"])]
    if report["skipped"]:
        out += ["", "Skipped lockfile entries:", *(f"- [{x['reason']}] {_quoted(x['name'])} at {_quoted(x['path'])}: {_quoted(x['detail'])}" for x in report["skipped"])]
    return "\n".join(out) + "\n"


# --- SARIF -------------------------------------------------------------------------------------------------------

LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
_HELP = "Review the static capability delta and its bounded evidence. This result does not assert malware."
_ABOUT = {"SHAPE": "Capability shape gained", "SIGNAL": "Behavioral signal gained", "CAPABILITY": "Capability gained"}


def _uri(name: str, version: str, file: str) -> str:
    part = lambda p: quote(p, safe="!*'()")
    return f"{ECOSYSTEM}/{part(name)}/{part(version)}/" + "/".join(map(part, file.split("/")))


def _result(record: dict, sort: str, rule: str, severity: str, what: str, evidence: list[dict], reason: str | None, properties: dict) -> dict:
    name, version = record["name"], record["new_version"]
    evidence = [{k: e[k] for k in ("file", "line", "snippet")} for e in evidence]
    places = [{"physicalLocation": {"artifactLocation": {"uri": _uri(name, version, e["file"]), "uriBaseId": f"{NAME.upper()}_PACKAGE_ROOT"}, "region": {"startLine": e["line"], "snippet": {"text": e["snippet"]}}}} for e in evidence[:1]]
    more = {} if reason is None else {"suppression": reason}
    text = f"Review this change: {what} in {name}@{version}." + ("" if reason is None else f" Suppressed ({reason})")
    return {"ruleId": f"{NAME.upper()}-{sort}-{rule.upper() if sort != 'CAPABILITY' else rule}", "level": LEVELS[severity], "message": {"text": text}, "locations": places, "properties": {"kind": sort.lower(), **properties, **more, "severity": severity, "package": name, "version": version, "evidence": evidence}}


def sarif_results(record: dict) -> list[dict]:
    """Results of one analysed package: its shapes, then the findings and signals that no shape stands for already."""
    record = ordered(record)
    by_slot = {f["slot"]: f["capability"] for f in record["findings"]}
    out, covered, shown = [], set(), set()
    for s in record["shapes"]:
        parts = [by_slot[p] for p in s["participants"]]
        hidden = [x for x in record["signals"] if s["signals"] is not None and x["kind"] == "obfuscation-pattern-added"]
        covered.update(s["participants"])
        shown.update((x["kind"], x["detail"]) for x in hidden)
        evidence = [e for x in [*parts, *hidden] for e in x["evidence"]]
        out.append(_result(record, "SHAPE", s["rule"], s["severity"], f"{s['rule']} capability shape", evidence, None, {"capabilities": [c["kind"] for c in parts], "signals": [x["kind"] for x in hidden]}))
    for f in record["findings"]:
        if f["slot"] not in covered:
            c = f["capability"]
            out.append(_result(record, "CAPABILITY", c["kind"], f["severity"], f"{c['kind']} capability {f['change']}", c["evidence"], f["suppression"], {"capability": c["kind"], "change": f["change"]}))
    for x in record["signals"]:
        if (x["kind"], x["detail"]) not in shown:
            out.append(_result(record, "SIGNAL", x["kind"], x["severity"], x["detail"], x["evidence"], x["suppression"], {"signal": x["kind"], "change": x["change"]}))
    return out


def to_sarif(records: Iterable[dict]) -> str:
    """SARIF 2.1.0 of the analysed packages among ``records``; places are in package artifacts, never in a checkout."""
    results = [r for record in records if record["status"] == "analyzed" for r in sarif_results(record)]
    results.sort(key=lambda r: json.dumps([r["ruleId"], r["message"]["text"], r["locations"]], ensure_ascii=False, separators=(",", ":")))
    rules = [{"id": i, "shortDescription": {"text": _ABOUT[i.split("-")[1]]}, "help": {"text": _HELP}} for i in sorted({r["ruleId"] for r in results})]
    driver = {"name": NAME, "rules": rules}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False) + "\n"


def records_of(run: Run, pair: str) -> list[dict]:
    """The records of one pair in the order of its lockfile, brought to the driver."""
    rows = _records(run).where(F.col("pair").cast("string") == pair).orderBy("ord").collect()
    return [json.loads(r["record"]) for r in rows]


# --- gate --------------------------------------------------------------------------------------------------------


def assess(report: dict) -> dict[str, int]:
    """Findings of each severity that count: without allowed ones, with lockfile facts and forged artifacts."""
    out = dict(report["summary"]["bySeverity"])
    for e in report["packages"]:
        if e["status"] == "analyzed":
            for f in [*e["report"]["findings"], *e["report"]["signalFindings"]]:
                out[f["severity"]] -= "suppression" in f
        for i in e.get("issues", e.get("failures", [])):
            out["CRITICAL"] += i["stage"] == "fetch" and i["kind"] == "integrity-mismatch"
    for f in report["lockfileFindings"]:
        out["HIGH" if f["kind"] == "integrity-changed-version-same" else "INFO"] += 1
    return out


def gate(report: dict, fail_on: str = "CRITICAL") -> dict:
    """Whether a severity at or above the threshold occurs; ``none`` never fails."""
    threshold, counts = parse_fail_on(fail_on), assess(report)
    n = 0 if threshold == "none" else sum(counts[s] for s in SEVERITIES[: _rank(threshold) + 1])
    return {"threshold": threshold, "counts": counts, "highest": next((s for s in SEVERITIES if counts[s] > 0), None), "matches": n, "failed": n > 0, "exit_code": int(n > 0)}


# --- Markdown ----------------------------------------------------------------------------------------------------


def _hidden(code: int) -> bool:
    return code < 0x20 or 0x7F <= code <= 0x9F or code in (0x200B, 0x200C, 0x200D, 0x2060) or 0x202A <= code <= 0x202E or 0x2066 <= code <= 0x2069


def inert(text: str, most: int = CELL_DETAIL) -> str:
    """At most ``most`` code points; ASCII punctuation as entities, and signs that cannot be seen written out."""
    shown = "".join(f"\\u{ord(c):04x}" if _hidden(ord(c)) else c for c in cut(text, most))
    return "".join(f"&#{ord(c)};" if c.isascii() and not c.isalnum() and c > " " else c for c in shown)


def _row(name: str, f: dict) -> tuple[str, str, str, str]:
    if "capability" in f:
        c = f["capability"]
        said = {"INSTALL_HOOK": lambda: f"{c['hook']} install hook", "COMMAND_ENTRYPOINT": lambda: f"command {c['command']}", "DEPENDENCY": lambda: f"dependency {c['name']}", "RUNTIME_CONSTRAINT": lambda: f"{c['runtime']} constraint"}
        what, e = f"{f['change']} " + said.get(c["kind"], lambda: f"{c['kind']} capability")(), c["evidence"][0]
    else:
        what, e = f"{f['change']} signal: {f['detail']}", f["evidence"][0]
    return f["severity"], name, what + _allowed(f, show=str), f"{e['file']}:{e['line']} {e['snippet']}"


def _body(report: dict, artifact: str, most: int) -> str:
    s, counts, budget = report["summary"], assess(report), report.get("budget")
    right = lambda n: "|" + " ---: |" * n
    out = [MARK, f"## {NAME} dependency review", ""]
    out.append("**First run:** no base lockfile was found. Review this aggregate capability inventory." if report["firstRun"] else f"Review this change: {NAME} reports newly gained capabilities.")
    out += ["", "| Packages | Analyzed | Unavailable | Lockfile skips |", right(4), f"| {s['changedPackages']} | {s['analyzedPackages']} | {s['unavailablePackages']} | {s['skippedLockfileEntries']} |"]
    out += ["", "| Critical | High | Medium | Low | Info |", right(5), "| " + " | ".join(str(counts[x]) for x in SEVERITIES) + " |"]
    if budget and budget["partial"]:
        before = f"{budget['deadlineMs']}ms wall-clock budget" if budget["deadlineExceeded"] else "caller cancellation"
        out += ["", f"**Partial analysis:** {budget['completedPackages']} of {s['changedPackages']} packages reached a result; {budget['unstartedPackages']} were not started before {before}."]
    done = [e["report"] for e in report["packages"] if e["status"] == "analyzed"]
    rows = sorted((_row(r["package"]["name"], f) for r in done for f in [*r["findings"], *r["signalFindings"]]), key=lambda x: (_rank(x[0]), *x[1:]))[:most]
    if rows:
        out += ["", "### Findings to review", "", "| Package | Severity | Change | Evidence |", "| --- | --- | --- | --- |"]
        out += [f"| {inert(name, CELL_IDENTITY)} | {severity} | {inert(what)} | {inert(where)} |" for severity, name, what, where in rows]
    gaps = [(e["report"]["package"]["name"] if e["status"] == "analyzed" else e["package"]["name"], i) for e in report["packages"] for i in e.get("issues", e.get("failures", []))][:most]
    if gaps:
        out += ["", "### Analysis gaps", "", "| Package | Stage | Detail | Source |", "| --- | --- | --- | --- |"]
        out += [f"| {inert(name, CELL_IDENTITY)} | {inert(i['stage'], CELL_IDENTITY)} | {inert(i['detail'])} | {inert(i['url'] or 'not available')} |" for name, i in gaps]
    out += ["", f"Showing {len(rows)} of {s['capabilityFindings'] + s['signalFindings']} findings and {len(gaps)} of {s['analysisIssues']} analysis gaps.", f"Full escaped details are available in the workflow artifact {inert(artifact, CELL_IDENTITY)}."]
    return "\n".join(out) + "\n"


def to_markdown(report: dict, artifact: str = f"{NAME}-report.json", most: int = MAX_SUMMARY, rows: int = MAX_ROWS) -> str:
    """A summary with the gravest rows; rows are left out until the text is short enough, and never cut in the middle."""
    if most <= 0 or rows < 0:
        raise ReportError("a summary needs room")
    for n in range(rows, -1, -1):
        if len(body := _body(report, artifact, n)) <= most:
            return body
    raise ReportError("the fixed summary exceeds the size cap")

