"""Limits of a run, and the reviewed exceptions of its configuration file."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from lockgrain.operators.capabilities import FALLBACK, SEVERITIES
from lockgrain.operators.findings import SIGNAL_SEVERITY


class PolicyError(ValueError):
    """Limits that make no sense, or that are given twice."""


class ConfigError(ValueError):
    """A configuration file that cannot be followed to the letter."""


@dataclass(frozen=True)
class Policy:
    """Limits of a run.  Fixed values: the defaults."""

    deadline_ms: int = 300_000
    fetch_concurrency: int = 8
    fetch_timeout_ms: int = 30_000
    max_tarball_bytes: int = 50 << 20
    extraction_concurrency: int = 4
    max_file_count: int = 10_000
    max_expanded_bytes: int = 250 << 20
    max_decompression_ratio: int = 100
    max_manifest_bytes: int = 1 << 20
    max_source_bytes: int = 2 << 20
    parse_timeout_ms: int = 60_000

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if type(v) is not int or not 0 < v < 1 << 53:
                raise PolicyError(f"{f.name} must be a positive safe integer")

    @classmethod
    def of(cls, policy: Mapping[str, int] | None = None, options: Mapping[str, int] | None = None) -> Policy:
        """Limits from a policy and from single options; the same limit in both, or an unknown one, is an error."""
        known = {f.name for f in fields(cls)}
        given = {"policy": dict(policy or {}), "options": dict(options or {})}
        for name in sorted(set(given["policy"]) | set(given["options"])):
            if name not in known:
                raise PolicyError(f"unknown limit {name}")
            if name in given["policy"] and name in given["options"]:
                raise PolicyError(f"{name} is configured in both the policy and the options")
        return replace(cls(), **given["policy"], **given["options"])

    def partitions(self, rows: int) -> int:
        """Tasks for ``rows`` packages: a task runs its packages one after the other."""
        return max(1, min(rows, self.extraction_concurrency))


#: The names of fields, their values and the wording of errors below are fixed.

# --- configuration file ------------------------------------------------------------------------------------------

MAX_CONFIG_BYTES = 256 << 10
ALLOWABLE = ["INSTALL_HOOK", *FALLBACK, *SIGNAL_SEVERITY]
_FIELDS = ("package", "capability", "justification")
_field = re.compile(r"([^:]*):(.*)")


def _scalar(value: str, line: int) -> str:
    if value.startswith('"'):
        try:
            out = json.loads(value)
        except ValueError as e:
            raise ConfigError(f"line {line} has an invalid quoted value") from e
        if not isinstance(out, str) or not out:
            raise ConfigError(f"line {line} has an invalid quoted value")
        return out
    if value.startswith("'"):
        raise ConfigError(f"line {line}: only JSON double-quoted or plain scalar values are supported")
    out = value.split(" #", 1)[0].strip()
    if not out:
        raise ConfigError(f"line {line}: value must not be empty")
    return out


def parse_config(text: str) -> list[dict[str, str]]:
    """The entries of ``allowlist:``, each with package, capability and justification.

    The file is a small part of YAML: one top-level key, list items indented by two spaces, their other fields by four,
    values plain or in JSON quotes, whole-line and trailing comments.  Anything else is an error, as an exception that is
    read otherwise than it was reviewed is worse than none.
    """
    entries: list[dict[str, str]] = []
    state = "start"  # then "list", or "closed" after an inline empty list
    for n, raw in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        if "\t" in raw:
            raise ConfigError(f"line {n}: tabs are not supported")
        body = raw.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        if indent == 0:
            if body not in ("allowlist:", "allowlist: []"):
                raise ConfigError(f'line {n}: expected the top-level key "allowlist:"')
            if state != "start":
                raise ConfigError(f"line {n}: duplicate allowlist key")
            state = "list" if body == "allowlist:" else "closed"
            continue
        if state != "list":
            raise ConfigError(f"line {n}: " + ("content must follow allowlist:" if state == "start" else "inline empty allowlist cannot contain entries"))
        if indent == 2 and body.startswith("- "):
            entries.append({})
            body = body[2:]
        elif indent != 4 or not entries:
            raise ConfigError(f"line {n}: expected a two-space list item or four-space field")
        m = _field.fullmatch(body)
        key = m[1].strip() if m else ""
        if not key:
            raise ConfigError(f"line {n}: expected field: value")
        if key not in _FIELDS:
            raise ConfigError(f"line {n}: unknown allowlist field {json.dumps(key)}")
        if key in entries[-1]:
            raise ConfigError(f"line {n}: duplicate field {json.dumps(key)}")
        value = m[2].strip()
        if not value:
            raise ConfigError(f"line {n}: {key} requires a value")
        entries[-1][key] = _scalar(value, n)
    seen = set()
    for k, e in enumerate(entries, 1):
        if "package" not in e:
            raise ConfigError(f"allowlist entry {k} requires package")
        if e.get("capability") not in ALLOWABLE:
            raise ConfigError(f"allowlist entry {k} has unsupported capability {json.dumps(e.get('capability', ''))}")
        if "justification" not in e:
            raise ConfigError(f"allowlist entry {k} requires a non-empty justification")
        if (what := (e["package"], e["capability"])) in seen:
            raise ConfigError(f"duplicate allowlist entry for {json.dumps(what[0])} / {what[1]}")
        seen.add(what)
    return entries


def allowances(spark: SparkSession, entries: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(e["package"], e["capability"], e["justification"]) for e in entries], "package string, capability string, justification string")


def parse_fail_on(value: str) -> str:
    """A severity in capitals, or ``none``; anything else is an error."""
    name = value.strip().upper()
    if name == "NONE":
        return "none"
    if name in SEVERITIES:
        return name
    raise PolicyError("fail-on must be CRITICAL, HIGH, MEDIUM, LOW, INFO, or none")
