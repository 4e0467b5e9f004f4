import base64
import gzip
import hashlib
import io
import os
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lockgrain.operators import capabilities as caps
from lockgrain.sources import archive, jsscan, manifest


def packed(*members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body, kind in members:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(body)
            info.linkname = "x" if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE) else ""
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


FILE = tarfile.REGTYPE


@pytest.mark.parametrize("name,kind,why", [("package/../x", FILE, "unsafe-path"), ("/etc/x", FILE, "unsafe-path"), ("C:/x", FILE, "unsafe-path"), ("other/x", FILE, "invalid-layout"), ("package/l", tarfile.SYMTYPE, "link-entry"), ("package/l", tarfile.LNKTYPE, "link-entry"), ("package/f", tarfile.FIFOTYPE, "entry-type")])
def test_archives_that_are_not_allowed(name, kind, why):
    with pytest.raises(ValueError, match=why):
        archive.entries(packed((name, b"", kind), ("package/pad", os.urandom(500), FILE)))


def test_archive_caps():
    with pytest.raises(ValueError, match="expansion-ratio"):
        archive.entries(gzip.compress(bytes(1 << 20)))
    with pytest.raises(ValueError, match="entry-count"):
        archive.entries(packed(*[(f"package/{i}", b"", FILE) for i in range(4)]), max_entries=3)


def test_files_and_integrity(spark):
    good, bad = packed(("package/index.js", b"x", FILE), ("package/package.json", b"{}", FILE)), b"nothing"
    token = "sha512-" + base64.b64encode(hashlib.sha512(good).digest()).decode()
    rows = [("a", good, "sha512-" + "A" * 86 + "== " + token), ("b", bad, token), ("c", good, "sha1-x"), ("d", None, token)]
    df = spark.createDataFrame(rows, "artifact string, content binary, integrity string")
    assert {r.artifact: r.issue for r in archive.verified(df).collect()} == {"a": None, "b": "integrity-mismatch", "c": "malformed-integrity", "d": None}
    got = archive.files(df).collect()
    assert [(r.artifact, r.path, r.rejected) for r in got if r.artifact != "c"] == [("a", "index.js", None), ("a", "package.json", None), ("b", None, "invalid-archive")]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_are_rejected_or_read(data):
    try:
        archive.entries(data)
    except ValueError:
        pass


def test_manifest():
    line = '"scripts": {"postinstall": "echo test", "test": "x", "prepare": 3},'
    text = '{\n "name": "@s/p", "version": "1.0.0",\n ' + line + '\n "bin": "cli.js",\n "dependencies": {"a": "npm:@x/b@1", "c": "^1"},\n "engines": {"node": ">=18"}\n}'
    found, faults = manifest.capabilities(text.encode(), "@s/p", "1.0.0")
    # in the order of the JSON text of kind and key, with the whole line as evidence
    assert [(c["kind"], c["key"]) for c in found] == [("COMMAND_ENTRYPOINT", "p"), ("DEPENDENCY", "a"), ("DEPENDENCY", "c"), ("INSTALL_HOOK", "postinstall"), ("RUNTIME_CONSTRAINT", "node")]
    assert found[3]["value"] == hashlib.sha256(b"echo test").hexdigest()
    assert found[3]["evidence"] == {"file": "package.json", "line": 3, "snippet": line}
    assert found[1]["target"] == "@x/b" and [f["field"] for f in faults] == ["scripts.prepare"]


def test_evidence_window():
    for at in (0, 50, 150, 480):
        line = "  " + "a" * at + "TARGET" + "b" * (500 - at)
        got = manifest.window(line, at + 2)
        assert len(got) in (239, 240) and "TARGET" in got and got.startswith("…") == (at > 119) and got.endswith("…") == (at < 381)


@pytest.mark.parametrize("bad", ['{"name": "p", "version": "1", "x": {"a": 1, "a": 2}}', '{"name": "p", "version": "1",}', '{"name": "p", /* */ "version": "1"}', '{"name": "q", "version": "1"}', "[]", "", '{"name": "p", "version": "1"} x'])
def test_manifest_errors(bad):
    with pytest.raises(manifest.ManifestError):
        manifest.capabilities(bad.encode(), "p", "1")


@pytest.mark.parametrize(
    "source,kinds",
    [
        ("const cp = require('child' + '_process');\n", ["UNKNOWN"]),
        ("const cp = require('node:child_process')", ["PROCESS"]),
        ("import https from 'https'; import('net')", ["NET", "NET"]),
        ("fetch('x'); new WebSocket(u)", ["NET", "NET"]),
        ("function f(fetch) { fetch('x') }", []),
        ("eval('1'); new Function('x')", ["DYNAMIC_CODE", "DYNAMIC_CODE"]),
        ("const a = process.env.X; process['env']", ["ENV", "ENV"]),
        ("const fs = require('fs'); fs.readFileSync('/home/u/.ssh/id')", ["FS_READ", "FS_SENSITIVE"]),
        ("import { writeFile as w } from 'node:fs'; w('x')", ["FS_WRITE"]),
        ("const fs = require('fs'); const g = fs; g.unlink(x)", ["FS_WRITE"]),
        ("require('./x.node'); WebAssembly.compile(b); process.dlopen(m)", ["NATIVE", "NATIVE", "NATIVE"]),
        ("// eval('x')\nconst s = \"eval('x')\"; /eval(1)/.test(s)", []),
        ("o.fetch('x'); o.eval('y')", []),
    ],
)
def test_script_capabilities(source, kinds):
    assert sorted(k for k, *_ in _every(source)) == sorted(kinds)


def _every(source):
    # detections are distinct by kind and line: count them by giving each statement a line of its own
    return [d for part in [jsscan.detect(source.replace("; ", ";\n"))] for d in part]


def test_script_states():
    assert jsscan.scan("a.js", b"function (")[0] == "unparseable"
    assert jsscan.scan("a.js", b"\xff\xfe")[0] == "unreadable"
    assert jsscan.scan("a.node", b"")[1] == [("NATIVE", 1, "<native binary: a.node>")]
    assert jsscan.scan("a.d.ts", b"")[0] == "ignored" and jsscan.scan("a.ts", b"")[0] == "unsupported"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_any_text_is_scanned_or_reported(text):
    assert jsscan.scan("x.js", text.encode("utf-8", "replace"))[0] in ("parsed", "unparseable")


def test_gate_counts(spark):
    rows = [("CRITICAL", 1), ("CRITICAL", 1), ("HIGH", 1), ("HIGH", 0), ("MEDIUM", 1), ("INFO", 1)]
    df = spark.createDataFrame(rows, "severity string, weight int")
    assert [caps.gate(df, s).first()["matches"] for s in caps.SEVERITIES] == [2, 3, 4, 4, 5]


def test_feed(spark, tmp_path):
    import json

    from lockgrain.streaming import feed

    (tmp_path / "in").mkdir()
    content = json.dumps({"lockfileVersion": 3, "packages": {"node_modules/a": {"version": "1.0.0", "resolved": "https://registry.npmjs.org/a.tgz", "integrity": "sha512-x"}}})
    (tmp_path / "in/1.json").write_text(json.dumps({"pair": "p", "side": "new", "content": content}) + "\n")
    feed.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out/changed")).collect()] == ["a"]
