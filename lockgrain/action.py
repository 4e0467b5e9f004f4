"""A review of a change request from end to end, through adapters: lockfiles in, report, comment and gate out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.plans import run as runs
from lockgrain.policy import ConfigError, Policy, allowances, parse_config, parse_fail_on
from lockgrain.sinks import delivery, report
from lockgrain.sources import retrieval

PAIR = "head"
BOT = "github-actions[bot]"


class ActionError(RuntimeError):
    """A review that cannot start or go on."""


@dataclass(frozen=True)
class Inputs:
    lockfile: str = retrieval.LOCKFILE
    fail_on: str = "CRITICAL"
    config: str = ""
    base: str = ""
    strict: bool = False


@dataclass(frozen=True)
class Context:
    """The change request: its repositories, number, commits, branch and author."""

    owner: str
    repo: str
    number: int
    base_commit: str
    head_commit: str
    head_branch: str
    base_repository: str
    head_repository: str
    actor: str

    def check(self) -> None:
        """ActionError unless every name is there and both commits are full ids."""
        names = (self.owner, self.repo, self.head_branch, self.base_repository, self.head_repository)
        commits = all(re.fullmatch(r"[0-9a-fA-F]{40,64}", c) for c in (self.base_commit, self.head_commit))
        if not all(names) or type(self.number) is not int or self.number <= 0 or not commits:
            raise ActionError("a review needs a change request with immutable commits")

    def read_only(self) -> str | None:
        """Why nothing can be written to the request, if so."""
        if self.actor == "dependabot[bot]":
            return "dependabot"
        return "fork" if self.head_repository != self.base_repository else None


class Adapters(Protocol):
    contents: retrieval.Contents
    comments: delivery.Comments
    uploads: delivery.Uploads

    def changed_files(self) -> list[str]: ...

    def resolve(self, ref: str) -> str: ...

    def head_lockfile(self, path: str) -> str: ...

    def config(self, path: str) -> str: ...

    def artifacts(self, urls: DataFrame) -> DataFrame: ...

    def add_summary(self, body: str) -> None: ...

    def warn(self, text: str) -> None: ...

    def output(self, name: str, value: str) -> None: ...


def _doing[T](what: str, call: Callable[..., T], *arguments: object) -> T:
    try:
        return call(*arguments)
    except Exception as e:
        raise ActionError(f"cannot {what}") from e


def wanted(lockfiles: DataFrame) -> DataFrame:
    """(url) of every artifact that a run over ``lockfiles`` will ask for."""
    changed = runs.lockfile.diff(lockfiles).changed
    return changed.select(F.explode(F.array_compact(F.array("old_resolved", "resolved_url"))).alias("url")).distinct()


def review(spark: SparkSession, inputs: Inputs, context: Context, adapters: Adapters, policy: Policy | None = None) -> dict:
    """Review one request and set the outputs; a request that leaves the lockfile alone is not looked at any further."""
    retrieval.check_lockfile_path(inputs.lockfile)
    context.check()
    parse_fail_on(inputs.fail_on)
    if inputs.lockfile not in _doing("list changed files", adapters.changed_files):
        adapters.output("status", "no-op")
        return {"status": "no-op"}
    try:
        entries = parse_config(_doing("read the configuration", adapters.config, inputs.config)) if inputs.config else []
    except ConfigError as e:
        raise ActionError("the configuration is invalid") from e
    commit = _doing("resolve the base", adapters.resolve, inputs.base) if inputs.base else context.base_commit
    old = _doing("read the base lockfile", retrieval.contents_lockfile, adapters.contents, inputs.lockfile, commit)
    new = _doing("read the head lockfile", adapters.head_lockfile, inputs.lockfile)
    lockfiles = spark.createDataFrame([(PAIR, "old", old), (PAIR, "new", new)], "pair string, side string, content string")
    artifacts = _doing("fetch artifacts", adapters.artifacts, wanted(lockfiles))
    run = _doing("analyse changed packages", runs.analyse, spark, lockfiles, artifacts, allowances(spark, entries), policy)
    done = report.report_of(run, PAIR)
    name = f"{report.NAME}-report"
    artifact = delivery.upload_json(adapters.uploads, name, report.to_json(done))
    why = context.read_only()
    if why:
        adapters.warn(f"{why}: SARIF cannot be uploaded with a read-only token; the JSON artifact and the job summary remain")
    else:
        delivery.upload_sarif(adapters.uploads, report.to_sarif(report.records_of(run, PAIR)), context.head_commit, context.number)
    comment = delivery.publish(report.to_markdown(done, f"{name}.json"), adapters.comments, BOT, why, adapters.add_summary, adapters.warn)
    gate = report.gate(done, inputs.fail_on)
    strict = inputs.strict and bool(runs.unanalysed(run).where(F.col("pair") == PAIR).first()["unanalysed"])
    for k, v in (("status", "failed" if gate["failed"] else "passed"), ("artifact-id", str(artifact)), ("highest-severity", gate["highest"] or "none"), ("strict-failed", str(strict).lower())):
        adapters.output(k, v)
    return {"status": "analyzed", "first_run": done["firstRun"], "artifact": artifact, "comment": comment, "gate": gate, "sarif_uploaded": not why, "strict_failed": strict}
