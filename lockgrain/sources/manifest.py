"""Package manifests: a strict JSON reader that knows where every field stands, and the capabilities it declares."""

from __future__ import annotations

import hashlib
import json
import re

#: Bytes of a manifest, code points of a snippet, and the install-time scripts with their effect.
MAX_BYTES, SNIPPET = 1 << 20, 240
HOOKS = {"preinstall": "registry-install", "install": "registry-install", "postinstall": "registry-install", "prepare": "git-only"}

_token = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


#: The kinds and the wording of failures and diagnostics below are fixed values.


class ManifestError(ValueError):
    """A manifest that cannot be used; ``kind`` classifies why, ``at`` is the offset of the fault if it has one."""

    def __init__(self, detail: str, kind: str = "manifest-invalid-json", at: int | None = None):
        super().__init__(detail)
        self.kind, self.at = kind, at


def parse(text: str) -> dict:
    """Nested dicts of (value, key offset, end offset); duplicate keys anywhere, comments and trailing commas are errors."""
    at = 0

    def take() -> tuple[str, int, int]:
        nonlocal at
        m = _token.match(text, at)
        if not m:
            raise ManifestError("package.json is invalid JSON: unexpected text" if text.strip() else "package.json is empty", at=at if text.strip() else None)
        at = m.end()
        return m.group(m.lastindex), m.start(m.lastindex), m.end()

    def value(depth: int = 0) -> object:
        nonlocal at
        if depth > 200:
            raise ManifestError("package.json is invalid JSON: nested too deeply", at=at)
        t, _, _ = take()
        if t == "{":
            out: dict = {}
            t, start, _ = take()
            while t != "}":
                if t[0] != '"':
                    raise ManifestError("package.json is invalid JSON: a key is expected", at=start)
                key = json.loads(t)
                if key in out:
                    raise ManifestError(f"package.json contains duplicate key {json.dumps(key, ensure_ascii=False)}", at=start)
                if take()[0] != ":":
                    raise ManifestError("package.json is invalid JSON: a colon is expected", at=at)
                out[key] = (value(depth + 1), start, at)
                t, _, _ = take()
                if t == ",":
                    t, start, _ = take()
                    if t == "}":
                        raise ManifestError("package.json is invalid JSON: trailing comma", at=start)
                elif t != "}":
                    raise ManifestError("package.json is invalid JSON: a comma is expected", at=at)
            return out
        if t == "[":
            items: list = []
            mark = at
            if take()[0] == "]":
                return items
            at = mark
            while True:
                items.append(value(depth + 1))
                t, _, _ = take()
                if t == "]":
                    return items
                if t != ",":
                    raise ManifestError("package.json is invalid JSON: a comma is expected", at=at)
        if t in "}],:":
            raise ManifestError("package.json is invalid JSON: a value is expected", at=at)
        return json.loads(t)

    root = value()
    if text[at:].strip(" \t\r\n"):
        raise ManifestError("package.json is invalid JSON: text after the end", at=at)
    if not isinstance(root, dict):
        raise ManifestError("package.json root must be an object", "manifest-invalid-root", len(text) - len(text.lstrip()))
    return root


def window(line: str, target: int, size: int = SNIPPET) -> str:
    """A line without the space around it; of a longer one, ``size`` characters about ``target`` with ellipses where cut."""
    body = line.strip()
    if len(body) <= size:
        return body
    target = max(0, target - (len(line) - len(line.lstrip())))
    room = size - 2
    begin = min(max(0, target - room // 2), len(body) - room)
    end = begin + size - (begin > 0)
    cut = end < len(body)
    return "…" * (begin > 0) + body[begin : end - cut] + "…" * cut


def evidence_at(text: str, at: int) -> dict:
    """Where an offset stands: file, line, and the window of that line."""
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", start)
    line = text[start : len(text) if end < 0 else end].removesuffix("\r")
    return {"file": "package.json", "line": text.count("\n", 0, at) + 1, "snippet": window(line, at - start)}


def capabilities(data: bytes | None, name: str, version: str, max_bytes: int = MAX_BYTES) -> tuple[list[dict], list[dict]]:
    """(capabilities, diagnostics) of a manifest's bytes; a field of a wrong type is a diagnostic and costs only itself.

    ManifestError: missing, too large, no UTF-8, no strict JSON, or another package's manifest.
    """
    if data is None:
        raise ManifestError("package.json is missing", "manifest-missing")
    if len(data) > max_bytes:
        raise ManifestError(f"package.json exceeds {max_bytes} bytes", "manifest-too-large")
    try:
        text = data.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError as e:
        raise ManifestError("package.json is not valid UTF-8") from e
    try:
        root = parse(text)
    except RecursionError:
        raise ManifestError("package.json is invalid JSON: nested too deeply") from None
    for field, want in (("name", name), ("version", version)):
        got, start, _ = root.get(field, (None, 0, 0))
        if not isinstance(got, str):
            raise ManifestError(f"package.json {field} must equal {json.dumps(want, ensure_ascii=False)}", "identity-mismatch", start)
        if got != want:
            raise ManifestError(f"package.json {field} {json.dumps(got, ensure_ascii=False)} does not match {json.dumps(want, ensure_ascii=False)}", "identity-mismatch", start)
    found, faults = [], []

    def fault(field: str, detail: str, at: int) -> None:
        faults.append({"kind": "malformed-manifest-field", "field": field, "detail": detail, "evidence": evidence_at(text, at)})

    def strings(field: str, only: dict | None = None, shape: str = "an object"):
        """(key, text, evidence) of the entries of an object of strings, in the order of ``only`` or of the file."""
        if field not in root:
            return
        got, start, _ = root[field]
        if not isinstance(got, dict):
            fault(field, f"{field} must be {shape}", start)
            return
        for key in only or got:
            if key in got:
                v, a, _ = got[key]
                if isinstance(v, str):
                    yield key, v, evidence_at(text, a)
                else:
                    fault(f"{field}.{key}", f"{field}.{key} must be a string", a)

    for key, v, e in strings("scripts", HOOKS):
        found.append({"kind": "INSTALL_HOOK", "key": key, "applicability": HOOKS[key], "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "command": v, "evidence": e})
    if isinstance(root.get("bin", (None,))[0], str):
        v, a, _ = root["bin"]
        found.append({"kind": "COMMAND_ENTRYPOINT", "key": name.rpartition("/")[2], "value": v, "evidence": evidence_at(text, a)})
    else:
        found += [{"kind": "COMMAND_ENTRYPOINT", "key": k, "value": v, "evidence": e} for k, v, e in strings("bin", shape="a string or object")]
    for key, v, e in strings("dependencies"):
        target = re.match(r"npm:(@[^/@]+/[^/@]+|[^/@]+)@", v)
        found.append({"kind": "DEPENDENCY", "key": key, "value": v, "target": target[1] if target else None, "evidence": e})
    found += [{"kind": "RUNTIME_CONSTRAINT", "key": k, "value": v, "evidence": e} for k, v, e in strings("engines")]
    found.sort(key=lambda c: json.dumps([c["kind"], c["key"]], ensure_ascii=False, separators=(",", ":")))
    faults.sort(key=lambda f: (f["evidence"]["file"], f["evidence"]["line"], json.dumps([f["kind"], f["detail"]], ensure_ascii=False)))
    return found, faults
