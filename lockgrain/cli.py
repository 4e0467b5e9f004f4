"""Command line: compare a checkout's lockfile with a git revision and report what its packages gained."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.plans import run as runs
from lockgrain.policy import MAX_CONFIG_BYTES, ConfigError, Policy, allowances, parse_config
from lockgrain.sinks import report
from lockgrain.sources import retrieval

#: Exit codes beside 0, and the configuration that need not exist.
FAILED, STRICT, USAGE = 1, 2, 64
CONFIG = f".{report.NAME}.yml"
MAX_ERROR, MAX_CAUSES = 500, 3
HELP = f"""Usage: {report.NAME} --base <ref> [--format text|json] [--config path] [--artifacts folder] [--strict]

Compare the checkout's {retrieval.LOCKFILE} with a Git base revision.

Options:
  --base <ref>          Git revision used as the baseline (required)
  --format text|json    Report format (default: text)
  --config <path>       Allowlist config (default: {CONFIG})
  --artifacts <folder>  Mirror of the registry to read instead of the network
  --strict              Exit {STRICT} when any content is unanalyzed
  --help                Show this help
"""


class UsageError(ValueError):
    """Arguments that cannot be understood."""


@dataclass
class Arguments:
    base: str | None = None
    format: str = "text"
    config: str | None = None
    artifacts: str | None = None
    strict: bool = False
    help: bool = False


def parse(arguments: list[str]) -> Arguments:
    out, seen, rest = Arguments(), set(), iter(arguments)
    for a in rest:
        name = a.removeprefix("--")
        if not a.startswith("--") or name not in Arguments.__dataclass_fields__:
            raise UsageError(f"unknown argument {json.dumps(a)}")
        if a in seen and name != "help":
            raise UsageError(f"{a} may only be provided once")
        seen.add(a)
        if name in ("strict", "help"):
            setattr(out, name, True)
            continue
        value = next(rest, "")
        if name == "format" and value not in ("text", "json"):
            raise UsageError("--format must be text or json")
        if not value or value.startswith("--"):
            raise UsageError(f"{a} requires " + {"base": "a Git revision", "config": "a path", "artifacts": "a folder"}[name])
        setattr(out, name, value)
    if not out.help and out.base is None:
        raise UsageError("--base <ref> is required")
    return out


def error_text(error: BaseException) -> str:
    """An error and its causes in one line, bounded and escaped for terminals."""
    parts, seen, now = [], set(), error
    while now is not None and len(parts) < MAX_CAUSES:
        if id(now) in seen:
            parts.append("caused by [cycle]")
            break
        seen.add(id(now))
        parts.append(("caused by " if parts else "") + f"{type(now).__name__}: {now}")
        now = now.__cause__
    return json.dumps(report.cut("; ".join(parts), MAX_ERROR), ensure_ascii=False)[1:-1]


def read_config(folder: str, path: str | None) -> list[dict[str, str]]:
    where = Path(folder) / (path or CONFIG)
    if path is None and not os.path.lexists(where):
        return []
    try:
        return parse_config(retrieval.read_regular(where, MAX_CONFIG_BYTES, f"config {path or CONFIG}"))
    except ConfigError as e:
        raise retrieval.RetrievalError(f"config {path or CONFIG} is invalid") from e


def https_fetch(url: str, seconds: float, most: int) -> bytes | tuple[str, str]:
    """One address by the standard library; no redirect leaves HTTPS, and no answer beyond ``most`` bytes is held."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=seconds) as answer:
            if not answer.geturl().startswith("https://"):
                return "invalid-url", "tarball URL must be HTTPS"
            if (declared := answer.headers.get("content-length", "")).isdigit() and int(declared) > most:
                return "size-limit-exceeded", f"declared tarball size exceeds {most} bytes"
            data = answer.read(most + 1)
            return data if len(data) <= most else ("size-limit-exceeded", f"tarball exceeds {most} bytes while streaming")
    except urllib.error.HTTPError as e:
        return "http-status", f"tarball request returned HTTP {e.code}"


def analyse(spark: SparkSession, folder: str, arguments: Arguments, fetch: retrieval.Fetch | None = None, policy: Policy | None = None) -> tuple[str, bool] | None:
    """(report, whether anything stayed unanalysed) of a checkout; None if its lockfile did not change."""
    policy = policy or Policy()
    commit = retrieval.base_commit(folder, arguments.base)
    if not retrieval.lockfile_changed(folder, commit):
        return None
    old, new = retrieval.base_lockfile(folder, commit), retrieval.head_lockfile(folder)
    lockfiles = spark.createDataFrame([("head", "old", old), ("head", "new", new)], "pair string, side string, content string")
    allow = allowances(spark, read_config(folder, arguments.config))
    if arguments.artifacts:
        artifacts: DataFrame = retrieval.artifact_folder(spark, arguments.artifacts, f"https://{runs.lockfile.REGISTRY_HOST}/")
    else:
        changed = runs.lockfile.diff(lockfiles).changed
        urls = changed.select(F.explode(F.array_compact(F.array("old_resolved", "resolved_url"))).alias("url"))
        artifacts = retrieval.downloads(urls, fetch or https_fetch, policy.fetch_timeout_ms / 1000, policy.max_tarball_bytes, policy.fetch_concurrency)
    run = runs.analyse(spark, lockfiles, artifacts, allow, policy)
    done = report.report_of(run, "head")
    text = report.to_json(done) if arguments.format == "json" else report.to_text(done)
    return text, bool(runs.unanalysed(run).first()["unanalysed"])


def main(arguments: list[str], folder: str = ".", spark: Callable[[], SparkSession] | None = None, out: Callable[[str], object] = sys.stdout.write, err: Callable[[str], object] = sys.stderr.write) -> int:
    """The exit code: 0, 1 for a failure, 2 for unanalysed content in strict mode, 64 for wrong arguments."""
    try:
        asked = parse(arguments)
        if asked.help:
            out(HELP)
            return 0
        session = spark() if spark else SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
        done = analyse(session, folder, asked)
        if done:
            out(done[0])
        if asked.strict and done and done[1]:
            err(f"{report.NAME}: strict mode found unanalyzed content\n")
            return STRICT
        return 0
    except UsageError as e:
        err(f"{report.NAME}: {error_text(e)}\n\n{HELP}")
        return USAGE
    except Exception as e:
        err(f"{report.NAME}: {error_text(e)}\n")
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
