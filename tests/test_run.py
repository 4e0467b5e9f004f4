"""The whole run: the known package pair, every way a package can fail, limits, reports, gate and command line."""

import base64
import gzip
import hashlib
import io
import json
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from lockgrain import action, cli
from lockgrain.operators import extraction, findings
from lockgrain.plans import run as runs
from lockgrain.policy import ConfigError, Policy, PolicyError, allowances, parse_config, parse_fail_on
from lockgrain.sinks import delivery, report
from lockgrain.sources import retrieval


def packed(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body in files.items():
            info = tarfile.TarInfo(f"package/{name}")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def sri(data):
    return "sha512-" + base64.b64encode(hashlib.sha512(data).digest()).decode()


def package(name, version, more="", **files):
    manifest = f'{{\n  "name": "{name}",\n  "version": "{version}"{more}\n}}\n'
    return packed({"package.json": manifest.encode(), **{k.replace("__", "/"): v.encode() for k, v in files.items()}})


def url(name, version):
    return f"https://registry.npmjs.org/{name}-{version}.tgz"


def lock(*entries):
    return json.dumps({"lockfileVersion": 3, "packages": {f"node_modules/{n}": {"version": v, "resolved": url(n, v), "integrity": i} for n, v, i in entries}})


HOOK = ',\n  "scripts": {\n    "postinstall": "echo test"\n  }'
CALL = "// Inert signal fixture: this file is parsed, never executed.\nexport const telemetryEndpoint = \"https://example.test/telemetry\";\n"


def golden(spark, pair="p"):
    old, new = package("golden-fixture", "1.0.0"), package("golden-fixture", "2.0.0", HOOK, **{"index.js": CALL})
    locks = [(pair, "old", lock(("golden-fixture", "1.0.0", sri(old)))), (pair, "new", lock(("golden-fixture", "2.0.0", sri(new))))]
    stored = [(url("golden-fixture", "1.0.0"), old), (url("golden-fixture", "2.0.0"), new)]
    return spark.createDataFrame(locks, "pair string, side string, content string"), spark.createDataFrame(stored, "url string, content binary")


@pytest.fixture(scope="module")
def known(spark):
    run = runs.analyse(spark, *golden(spark))
    return run, report.report_of(run, "p")


def test_known_pair(known):
    _, got = known
    [entry] = got["packages"]
    r = entry["report"]
    assert got["summary"]["bySeverity"] == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert r["reportId"] == "lockgrain-d6161b9536688ca5e0b7" and r["package"] == {"ecosystem": "npm", "name": "golden-fixture", "oldVersion": "1.0.0", "newVersion": "2.0.0", "newPackage": False}
    hook = {"kind": "INSTALL_HOOK", "hook": "postinstall", "applicability": "registry-install", "contentDigest": {"algorithm": "sha256", "value": "d960c2eba2b5400c91a09fdec42dabef3cfd2c19a92591a5b2e5437a99a5a91d"}, "evidence": [{"file": "package.json", "line": 5, "snippet": '"postinstall": "echo test"'}]}
    assert r["findings"] == [{"severity": "CRITICAL", "change": "added", "capability": hook, "previous": None}]
    assert r["shapes"] == [{"ruleId": "install-hook-change", "severity": "CRITICAL", "capabilities": [hook]}]
    assert r["signalFindings"] == [{"kind": "new-external-endpoint", "severity": "HIGH", "change": "added", "detail": "new external domain example.test", "evidence": [{"file": "index.js", "line": 2, "snippet": 'export const telemetryEndpoint = "https://example.test/telemetry";'}]}]
    assert (r["diagnostics"], entry["issues"], got["firstRun"], got["budget"]["partial"]) == ([], [], False, False)


def test_known_text(known):
    run, got = known
    assert report.package_text(got["packages"][0]["report"]) == [
        "lockgrain manifest capability report",
        'Package: "golden-fixture" ("npm") "1.0.0" -> "2.0.0"',
        "Review this change: 2 findings (CRITICAL: 1, HIGH: 1); 0 diagnostics.",
        "",
        "Capability shapes:",
        '- [CRITICAL] "install-hook-change" (1 capability)',
        "",
        "Findings:",
        '- [CRITICAL] "postinstall" registry install hook added',
        '  Evidence: "package.json":5 — "\\"postinstall\\": \\"echo test\\""',
        "",
        "Signals:",
        '- [HIGH] "new external domain example.test"',
        '  Evidence: "index.js":2 — "export const telemetryEndpoint = \\"https://example.test/telemetry\\";"',
    ]
    assert report.to_text(got).startswith("lockgrain capability analysis report\nMode: comparison\nPackages: 1 changed; 1 analyzed; 0 unavailable; 0 lockfile skips.\nSignals: 2 findings (CRITICAL: 1, HIGH: 1); 0 lockfile findings;")
    sarif = json.loads(report.to_sarif(report.records_of(run, "p")))["runs"][0]
    assert [(r["ruleId"], r["level"]) for r in sarif["results"]] == [("LOCKGRAIN-SHAPE-INSTALL-HOOK-CHANGE", "error"), ("LOCKGRAIN-SIGNAL-NEW-EXTERNAL-ENDPOINT", "error")]
    assert sarif["results"][1]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "npm/golden-fixture/2.0.0/index.js"
    assert runs.weighted(run).groupBy("severity").agg(F.sum("weight")).count() == 2
    assert runs.severity_totals(run).first()["n_critical"] == 1 and not runs.unanalysed(run).first()["unanalysed"]


def test_markdown_and_gate(known):
    _, got = known
    body = report.to_markdown(got)
    assert "| 1 | 1 | 0 | 0 | 0 |" in body and "added postinstall install hook" in body and "Showing 2 of 2 findings" in body
    assert len(report.to_markdown(got, most=720)) <= 720 and "Showing 1 of 2" in report.to_markdown(got, most=720) and "Showing 0 of 2" in report.to_markdown(got, most=600)
    with pytest.raises(report.ReportError):
        report.to_markdown(got, most=10)
    assert report.inert("a<b>\u202e*`\n", 200) == "a&#60;b&#62;&#92;u202e&#42;&#96;&#92;u000a"
    assert [report.gate(got, s)["matches"] for s in ("critical", "HIGH", "none")] == [1, 2, 0] and report.gate(got)["exit_code"] == 1


def test_failures_stay_with_their_package(spark):
    fine = package("fine", "1.0.0", ',\n  "dependencies": {"late": "npm:fine@^1"}')
    other, evil = package("other", "1.0.0"), packed({"package.json": b'{"name": "evil", "version": "1.0.0",}'})
    bad_tar, wrong = b"no archive", package("wrong", "1.0.0")
    script = package("script", "2.0.0", ',\n  "scripts": {"install": "node ./a.js"}', **{"a.js": "const cp = require('child_process');\nfetch(process.env.T);\n", "b.js": "const =", "c.js": "var d = [" + ",".join("0x%02x" % i for i in range(9)) + "];"})
    script_old = package("script", "1.0.0", "", **{"b.js": "const =", "c.js": "var d = 1;"})
    new = [("fine", "1.0.0", sri(fine)), ("ident", "1.0.0", sri(other)), ("evil", "1.0.0", sri(evil)), ("tar", "1.0.0", sri(bad_tar)), ("wrong", "1.0.0", sri(b"else")), ("lost", "1.0.0", sri(b"lost")), ("odd", "1.0.0", "sha1-x"), ("script", "2.0.0", sri(script))]
    locks = [("p", "old", lock(("script", "1.0.0", sri(script_old)))), ("p", "new", lock(*new)), ("q", "new", lock(new[0]))]
    stored = [(url("fine", "1.0.0"), fine), (url("ident", "1.0.0"), other), (url("evil", "1.0.0"), evil), (url("tar", "1.0.0"), bad_tar), (url("wrong", "1.0.0"), wrong), (url("odd", "1.0.0"), wrong), (url("script", "1.0.0"), script_old), (url("script", "2.0.0"), script)]
    allow = allowances(spark, [{"package": "script", "capability": "NET", "justification": "reviewed"}])
    run = runs.analyse(spark, spark.createDataFrame(locks, "pair string, side string, content string"), spark.createDataFrame(stored, "url string, content binary"), allow)
    got = report.report_of(run, "p")
    by = {(e["report"] if "report" in e else e)["package"]["name"]: e for e in got["packages"]}
    assert list(by) == ["fine", "ident", "evil", "tar", "wrong", "lost", "odd", "script"]
    reasons = {n: (e["failures"][0]["stage"], e["failures"][0]["kind"]) for n, e in by.items() if e["status"] == "unavailable"}
    assert reasons == {"ident": ("new-manifest", "identity-mismatch"), "evil": ("new-manifest", "manifest-invalid-json"), "tar": ("new-extraction", "invalid-archive"), "wrong": ("fetch", "integrity-mismatch"), "lost": ("fetch", "network-error"), "odd": ("fetch", "unsupported-integrity")}
    assert by["evil"]["failures"][0]["evidence"]["line"] == 1
    dep = by["fine"]["report"]["findings"][0]
    assert dep["capability"]["targetName"] == "fine" and dep["relatedReportIds"] == [by["fine"]["report"]["reportId"]]
    r = by["script"]["report"]
    assert [(f["capability"]["kind"], f["severity"], f["capability"].get("location", {}).get("kind")) for f in r["findings"]] == [("ENV", "CRITICAL", "install-script"), ("INSTALL_HOOK", "CRITICAL", None), ("NET", "CRITICAL", "install-script"), ("PROCESS", "CRITICAL", "install-script")]
    assert [s["ruleId"] for s in r["shapes"]] == ["install-code-execution"] * 3 + ["secret-exfiltration", "obfuscated-execution", "install-hook-change"]
    assert [c["kind"] for c in r["shapes"][3]["capabilities"]] == ["NET", "ENV"] and r["shapes"][4]["signals"][0]["severity"] == "CRITICAL"
    assert [(s["kind"], s["severity"]) for s in r["signalFindings"]] == [("obfuscation-pattern-added", "CRITICAL")]
    assert [d["side"] for d in r["diagnostics"]] == ["old", "new"] and r["findings"][2]["suppression"] == {"reason": "reviewed"}
    counts = report.assess(got)
    assert counts["CRITICAL"] == 4 + 1 - 1 + 1  # four findings and a signal, one allowed, one forged artifact
    assert report.report_of(run, "q")["firstRun"] and "Mode: first run" in report.to_text(report.report_of(run, "q"))
    assert {r.pair: (r.changed, r.analyzed, r.unavailable) for r in runs.summary(run).collect()} == {"p": (8, 2, 6), "q": (1, 1, 0)}
    assert {r.pair: r.unanalysed for r in runs.unanalysed(run).collect()} == {"p": True, "q": False}


def test_deadline(spark):
    run = runs.analyse(spark, *golden(spark), policy=Policy(deadline_ms=1))
    got = report.report_of(run, "p")
    assert got["budget"] == {"deadlineMs": 1, "prioritization": "install-script-first", "startedPackages": 0, "completedPackages": 1, "unstartedPackages": 1, "deadlineExceeded": True, "partial": True}
    assert got["packages"][0]["failures"][0]["kind"] == "deadline-exceeded" and "Analysis budget: partial" in report.to_text(got) and "**Partial analysis:**" in report.to_markdown(got)


def test_empty_run(spark):
    locks = spark.createDataFrame([("p", "old", lock()), ("p", "new", lock())], "pair string, side string, content string")
    run = runs.analyse(spark, locks, spark.createDataFrame([], "url string, content binary"))
    got = report.report_of(run, "p")
    assert got["packages"] == [] and got["summary"]["changedPackages"] == 0 and not report.gate(got)["failed"]


def test_contracts(spark):
    with pytest.raises(findings.ContractError):
        findings.check(spark.createDataFrame([("p", "new", "x")], "pkg string, side string, detail string"))
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    findings.handoff(a, a, ["k", "v"])
    with pytest.raises(findings.ContractError):
        findings.handoff(a, a.where("k = 1"), ["k", "v"])
    whole = {"name": "a", "new_version": "1", "new_integrity": "i", "resolved_url": "u", "old_version": None, "old_integrity": None, "old_resolved": None}
    report.check_change(whole)
    for odd in ({"name": ""}, {"old_version": "0"}):
        with pytest.raises(report.ReportError):
            report.check_change(whole | odd)
    with pytest.raises(report.ReportError):
        report.run_report([], [], [], {"changed": 1, "analyzed": 0, "unavailable": 0, "skipped": 0, "first_run": False})


def test_evidence_order(spark):
    rows = [(i,) for i in (9, 10, 9)]
    df = spark.createDataFrame(rows, "line int").agg(F.collect_list(extraction.evidence(F.lit("f"), F.col("line"), F.lit("s"))).alias("e"))
    assert [e.line for e in df.select(extraction.sorted_evidence(F.col("e")).alias("e")).first().e] == [10, 9]


# --- configuration -----------------------------------------------------------------------------------------------

ENTRY = "allowlist:\n  - package: a\n    capability: NET\n    justification: seen # by us\n"


def test_config():
    assert parse_config(ENTRY) == [{"package": "a", "capability": "NET", "justification": "seen"}]
    assert parse_config("") == parse_config("# c\n") == parse_config("allowlist: []\r\n") == []
    assert parse_config(ENTRY.replace("seen", '"a \\" # b"').replace(" # by us", ""))[0]["justification"] == 'a " # b'


@pytest.mark.parametrize("text", ["other:\n", "\tallowlist:\n", "  - package: a\n", ENTRY + "allowlist:\n", "allowlist: []\n  - package: a\n", ENTRY.replace("NET", "net"), ENTRY.replace("    justification: seen # by us\n", ""), ENTRY.replace("a\n", "'a'\n", 1), ENTRY + ENTRY.split("\n", 1)[1], ENTRY.replace("package: a", "package:"), ENTRY.replace("capability: NET", "package: b"), ENTRY.replace("    cap", "   cap"), ENTRY.replace("seen # by us", '"x')])
def test_config_errors(text):
    with pytest.raises(ConfigError):
        parse_config(text)


def test_policy():
    assert Policy().deadline_ms == 300_000 and Policy.of({"deadline_ms": 5}, {"max_file_count": 7}).max_file_count == 7
    for wrong in ({"deadline_ms": 0}, {"deadline_ms": 1.5}, {"nothing": 1}):
        with pytest.raises(PolicyError):
            Policy.of(wrong)
    with pytest.raises(PolicyError):
        Policy.of({"deadline_ms": 5}, {"deadline_ms": 6})
    assert parse_fail_on(" High ") == "HIGH" and parse_fail_on("none") == "none"
    with pytest.raises(PolicyError):
        parse_fail_on("severe")


# --- retrieval ---------------------------------------------------------------------------------------------------


def git(folder, *arguments):
    return subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.test", *arguments], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def checkout(tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "README").write_text("x")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "first")
    return tmp_path


def test_git(checkout):
    first = retrieval.base_commit(checkout, "HEAD")
    assert not retrieval.lockfile_changed(checkout, first) and retrieval.base_lockfile(checkout, first) is None
    (checkout / retrieval.LOCKFILE).write_text("{}")
    assert retrieval.lockfile_changed(checkout, first) and retrieval.head_lockfile(checkout) == "{}"
    git(checkout, "add", ".")
    git(checkout, "commit", "-qm", "second")
    second = retrieval.base_commit(checkout, "HEAD")
    assert retrieval.base_lockfile(checkout, second) == "{}" and not retrieval.lockfile_changed(checkout, second)
    for call in (lambda: retrieval.base_commit(checkout, "nothing"), lambda: retrieval.base_lockfile(checkout, second, most=1), lambda: retrieval.head_lockfile(checkout, most=1)):
        with pytest.raises(retrieval.RetrievalError):
            call()
    (checkout / "link").symlink_to(checkout / "README")
    with pytest.raises(retrieval.RetrievalError, match="symlink"):
        retrieval.read_regular(checkout / "link", 10, "it")


def test_capped_commands(tmp_path):
    assert retrieval.run_capped(["sh", "-c", "printf a; printf b >&2; exit 3"], tmp_path, 10) == (3, b"a", b"b")
    with pytest.raises(retrieval.RetrievalError, match="limit"):
        retrieval.run_capped(["sh", "-c", "yes"], tmp_path, 1000)
    with pytest.raises(retrieval.RetrievalError, match="timed out"):
        retrieval.run_capped(["sh", "-c", "trap '' TERM; sleep 30"], tmp_path, 10, seconds=0.2, grace=0.2)
    with pytest.raises(retrieval.RetrievalError, match="cannot start"):
        retrieval.run_capped(["no-such-command"], tmp_path, 10)


class Service:
    def __init__(self, **answers):
        self.answers = answers

    def get(self, path, commit, form):
        return self.answers.get(form, (404, None))


def test_contents_service():
    commit = "a" * 40
    ask = lambda **answers: retrieval.contents_lockfile(Service(**answers), "x/package-lock.json", commit, 100)
    assert ask() is None
    assert ask(object=(200, {"type": "file", "size": 2, "encoding": "base64", "content": "e30=\n"})) == "{}"
    assert ask(object=(200, {"type": "file", "size": 2, "encoding": "none", "content": ""}), raw=(200, b"{}")) == "{}"
    for wrong in ((500, None), (200, {"type": "dir"}), (200, {"type": "file", "size": 200}), (200, {"type": "file", "size": 1, "encoding": "base64", "content": "*"}), (200, {"type": "file", "size": 1, "encoding": "none"}), (200, {"type": "file", "size": 1, "encoding": "base64", "content": "/w=="})):
        with pytest.raises(retrieval.RetrievalError):
            ask(object=wrong)
    for path in ("", "/x", "a//b", "../x", "a\\b", "a\0"):
        with pytest.raises(retrieval.RetrievalError):
            retrieval.check_lockfile_path(path)


def test_downloads(spark, tmp_path):
    def fetch(address, seconds, most):
        if address.endswith("slow"):
            raise TimeoutError
        if address.endswith("gone"):
            return "http-status", "tarball request returned HTTP 404"
        if address.endswith("large"):
            return bytes(most + 1)
        if address.endswith("broken"):
            raise OSError("x")
        return b"ok"

    urls = spark.createDataFrame([(f"https://h/{x}",) for x in ("fine", "fine", "slow", "gone", "large", "broken")], "url string")
    got = {r.url[10:]: (r.content and bytes(r.content), r.kind) for r in retrieval.downloads(urls, fetch, most=5, tasks=2).collect()}
    assert got == {"fine": (b"ok", None), "slow": (None, "timeout"), "gone": (None, "http-status"), "large": (None, "size-limit-exceeded"), "broken": (None, "network-error")}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tgz").write_bytes(b"x")
    assert [r.url for r in retrieval.artifact_folder(spark, str(tmp_path), "https://h/").collect()] == ["https://h/a/x.tgz"]
    (tmp_path / "bad.json").write_bytes(b"\xff")
    assert {r.path.rsplit("/", 1)[1]: r.fault for r in retrieval.lockfiles(spark, str(tmp_path / "*.json")).collect()} == {"bad.json": "is not valid UTF-8"}


# --- delivery, action, command line ------------------------------------------------------------------------------


class Board:
    def __init__(self, *comments):
        self.all, self.done = list(comments), []

    def page(self, number, size):
        return self.all[(number - 1) * size : number * size]

    def create(self, body):
        self.done.append(("create", None))
        return 77

    def update(self, id_, body):
        self.done.append(("update", id_))


def test_sticky_comment():
    body = report.MARK + "\nx"
    assert delivery.publish(body, Board(), "bot") == delivery.Published("created", 77)
    many = [(i, "someone", report.MARK) for i in range(150)] + [(200, "bot", "plain"), (201, "bot", report.MARK), (190, "bot", report.OLD_MARKS[0])]
    said = []
    assert delivery.publish(body, board := Board(*many), "bot", warn=said.append).comment == 201 and board.done == [("update", 201)] and len(said) == 1
    kept = []
    assert delivery.publish(body, Board(), "bot", "fork", kept.append).status == "summary-only" and kept == [body]
    with pytest.raises(delivery.DeliveryError):
        delivery.publish("no mark", Board(), "bot")
    assert gzip.decompress(base64.b64decode(delivery.packed_sarif("{}"))) == b"{}"


class Review:
    def __init__(self, spark, base, head):
        self.spark, self.base, self.head, self.said, self.sent = spark, base, head, {}, []
        self.contents = Service(object=(200, {"type": "file", "size": len(base), "encoding": "base64", "content": base64.b64encode(base.encode()).decode()})) if base else Service()
        self.comments, self.uploads = Board(), self

    changed_files = lambda self: ["package-lock.json"]
    resolve = lambda self, ref: "c" * 40
    head_lockfile = lambda self, path: self.head
    config = lambda self, path: ENTRY
    add_summary = lambda self, body: self.sent.append("summary")
    warn = lambda self, text: self.sent.append("warning")

    def artifact(self, name, content):
        self.sent.append(name)
        return 5

    def sarif(self, packed_, commit, ref):
        self.sent.append(ref)

    def artifacts(self, urls):
        return golden(self.spark)[1].join(urls, "url")

    def output(self, name, value):
        self.said[name] = value


def test_action(spark):
    locks = {r.side: r.content for r in golden(spark)[0].collect()}
    place = action.Context("o", "r", 3, "a" * 40, "b" * 40, "branch", "o/r", "o/r", "someone")
    review = Review(spark, locks["old"], locks["new"])
    got = action.review(spark, action.Inputs(config="x", strict=True), place, review)
    assert got["gate"]["failed"] and got["comment"].status == "created" and got["sarif_uploaded"] and not got["strict_failed"]
    assert review.said == {"status": "failed", "artifact-id": "5", "highest-severity": "CRITICAL", "strict-failed": "false"} and review.sent == ["lockgrain-report", "refs/pull/3/head"]
    review = Review(spark, locks["old"], locks["new"])
    fork = action.Context("o", "r", 3, "a" * 40, "b" * 40, "branch", "o/r", "other/r", "someone")
    assert action.review(spark, action.Inputs(fail_on="none"), fork, review)["comment"].status == "summary-only" and review.sent == ["lockgrain-report", "warning", "summary"]
    assert action.review(spark, action.Inputs(lockfile="x.json"), place, review) == {"status": "no-op"}
    with pytest.raises(action.ActionError):
        action.review(spark, action.Inputs(), action.Context("o", "r", 0, "a" * 40, "b" * 40, "h", "o/r", "o/r", "s"), review)


def test_command_line(spark, checkout):
    locks, stored = golden(spark)
    mirror = checkout / "mirror"
    mirror.mkdir()
    for r in stored.collect():
        (mirror / r.url.rsplit("/", 1)[1]).write_bytes(bytes(r.content))
    texts = {r.side: r.content for r in locks.collect()}
    (checkout / retrieval.LOCKFILE).write_text(texts["old"])
    git(checkout, "add", retrieval.LOCKFILE)
    git(checkout, "commit", "-qm", "old")
    out, err = [], []
    call = lambda *a: cli.main(list(a), str(checkout), lambda: spark, out.append, err.append)
    assert call("--base", "HEAD") == 0 and not out
    (checkout / retrieval.LOCKFILE).write_text(texts["new"])
    assert call("--base", "HEAD", "--format", "json", "--artifacts", str(mirror), "--strict") == 0
    assert json.loads(out.pop())["summary"]["bySeverity"]["CRITICAL"] == 1
    (mirror / "golden-fixture-2.0.0.tgz").unlink()
    assert call("--base", "HEAD", "--artifacts", str(mirror), "--strict") == cli.STRICT and "Unavailable package" in out.pop()
    assert call("--base", "nothing") == cli.FAILED and "RetrievalError: cannot resolve base revision" in err[-1]
    for wrong in ([], ["--base"], ["--base", "a", "--base", "b"], ["--format", "xml"], ["--what"], ["--strict", "--strict"]):
        assert call(*wrong) == cli.USAGE
    assert call("--help") == 0 and out.pop() == cli.HELP


def test_error_text():
    try:
        try:
            raise ValueError("in\u001bner")
        except ValueError as e:
            raise RuntimeError("outer") from e
    except RuntimeError as e:
        assert cli.error_text(e) == "RuntimeError: outer; caused by ValueError: in\\u001bner"
    assert len(cli.error_text(ValueError("x" * 900))) == 500
