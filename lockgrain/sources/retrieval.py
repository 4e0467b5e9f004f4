"""Lockfiles and artifacts from where they are kept: files, a git history, a contents service, an artifact table.

Nothing here opens a network connection by itself: services are adapters that the caller passes in.
"""

from __future__ import annotations

import base64
import binascii
import json
import os
import re
import selectors
import stat
import subprocess
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockgrain.sources import archive

#: Bytes of a lockfile, of git's answers, and of an artifact; seconds for a git command and for its end.
MAX_LOCKFILE, MAX_GIT, MAX_TARBALL = 50 << 20, 1 << 20, 50 << 20
GIT_SECONDS, GRACE_SECONDS = 60.0, 1.0
LOCKFILE = "package-lock.json"
_commit = re.compile(r"[0-9a-fA-F]{40,64}")


class RetrievalError(RuntimeError):
    """Something could not be retrieved, for a reason the message names."""


# --- files -------------------------------------------------------------------------------------------------------


def read_regular(path: str | Path, most: int, what: str) -> str:
    """Text of a regular file of ``most`` bytes at most; no link is followed, and the size is checked before and after."""
    try:
        info = os.lstat(path)
    except OSError as e:
        raise RetrievalError(f"cannot inspect {what}") from e
    if not stat.S_ISREG(info.st_mode):
        raise RetrievalError(f"{what} must be a regular file, not a symlink")
    if info.st_size > most:
        raise RetrievalError(f"{what} exceeds the {most} byte limit")
    try:
        with open(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
            data = f.read(most + 1)
    except OSError as e:
        raise RetrievalError(f"cannot read {what}") from e
    if len(data) > most:
        raise RetrievalError(f"{what} exceeds the {most} byte limit")
    return decoded(data, what)


def decoded(data: bytes, what: str) -> str:
    try:
        return data.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError as e:
        raise RetrievalError(f"{what} is not valid UTF-8") from e


def head_lockfile(folder: str | Path, most: int = MAX_LOCKFILE) -> str:
    return read_regular(Path(folder) / LOCKFILE, most, f"head {LOCKFILE}")


def lockfiles(spark: SparkSession, path: str, most: int = MAX_LOCKFILE) -> DataFrame:
    """(path, bytes, content, fault) of all files below ``path``: the scale form of ``head_lockfile``.

    A file that is too large or no UTF-8 has a fault and no content; contents that are too large are never decoded.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), "content")
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    fault = F.when(F.col("bytes") > most, F.lit(f"exceeds the {most} byte limit")).when(~valid, "is not valid UTF-8")
    return files.withColumn("fault", fault).withColumn("content", F.when(F.col("fault").isNull(), text))


def lockfile_path(path: Column) -> Column:
    """True for a normalised relative POSIX path."""
    parts = F.exists(F.split(path, "/"), lambda p: p.isin("", ".."))
    return F.coalesce(~parts & ~path.contains("\\") & ~path.contains("\0"), F.lit(False))


def check_lockfile_path(path: str) -> None:
    """The same for one path; RetrievalError otherwise."""
    if "\\" in path or "\0" in path or any(p in ("", "..") for p in path.split("/")):
        raise RetrievalError("lockfile path must be a normalized relative POSIX path")


# --- git ---------------------------------------------------------------------------------------------------------


def run_capped(command: list[str], folder: str | Path, most: int, seconds: float = GIT_SECONDS, grace: float = GRACE_SECONDS) -> tuple[int, bytes, bytes]:
    """(exit code, output, errors) of a command without a shell, whose output and time are bounded.

    Beyond a bound the process is asked to end, killed after ``grace`` seconds, and left alone after as many more.
    """
    if seconds <= 0 or grace <= 0:
        raise RetrievalError("command timeouts must be positive")
    try:
        child = subprocess.Popen(command, cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise RetrievalError(f"cannot start {command[0]}") from e
    out = {child.stdout: bytearray(), child.stderr: bytearray()}
    end, fault = time.monotonic() + seconds, None
    with selectors.DefaultSelector() as ready:
        for pipe in out:
            ready.register(pipe, selectors.EVENT_READ)
        while ready.get_map() and not fault:
            left = end - time.monotonic()
            if left <= 0:
                fault = f"{command[0]} timed out after {seconds:g} s"
                break
            for key, _ in ready.select(left):
                chunk = os.read(key.fd, 1 << 16)
                if not chunk:
                    ready.unregister(key.fileobj)
                out[key.fileobj] += chunk
                if sum(map(len, out.values())) > most:
                    fault = f"{command[0]} output exceeds the {most} byte limit"
    try:
        if not fault:
            child.wait(max(grace, end - time.monotonic()))
    except subprocess.TimeoutExpired:
        fault = f"{command[0]} timed out after {seconds:g} s"
    if fault:
        for stop in (child.terminate, child.kill):
            stop()
            try:
                child.wait(grace)
                break
            except subprocess.TimeoutExpired:
                continue
    for pipe in out:
        pipe.close()
    if fault:
        raise RetrievalError(fault)
    return child.returncode, bytes(out[child.stdout]), bytes(out[child.stderr])


def _git(folder: str | Path, *arguments: str, most: int = MAX_GIT, expect: tuple[int, ...] = (0,), doing: str) -> tuple[int, bytes]:
    code, out, errors = run_capped(["git", *arguments], folder, most)
    if code not in expect:
        raise RetrievalError(f"cannot {doing}: {decoded(errors, 'git error output').strip()[:500] or f'git exited {code}'}")
    return code, out


def base_commit(folder: str | Path, revision: str) -> str:
    """The full id of the commit that a revision names."""
    _, out = _git(folder, "rev-parse", "--verify", "--end-of-options", revision + "^{commit}", doing=f"resolve base revision {json.dumps(revision)}")
    commit = decoded(out, "git commit output").strip()
    if not _commit.fullmatch(commit):
        raise RetrievalError("git returned an invalid base commit id")
    return commit


def lockfile_changed(folder: str | Path, commit: str) -> bool:
    """Whether the lockfile of the checkout differs from the commit's, or is new: if not, nothing has to be read."""
    code, _ = _git(folder, "diff", "--quiet", "--no-ext-diff", commit, "--", LOCKFILE, expect=(0, 1), doing=f"compare {LOCKFILE} with the base revision")
    if code:
        return True
    return bool(_git(folder, "ls-files", "--others", "--exclude-standard", "--", LOCKFILE, doing=f"inspect untracked {LOCKFILE}")[1])


def base_lockfile(folder: str | Path, commit: str, most: int = MAX_LOCKFILE) -> str | None:
    """The lockfile's text at a commit, read by the id of its blob; None if the commit has none (a first run)."""
    _, out = _git(folder, "ls-tree", "-z", commit, "--", LOCKFILE, doing=f"inspect base {LOCKFILE}")
    if not out:
        return None
    entry = re.fullmatch(rf"100[0-7]{{3}} blob ([0-9a-fA-F]{{40,64}})\t{re.escape(LOCKFILE)}\0", decoded(out, "git tree output"))
    if not entry:
        raise RetrievalError(f"base {LOCKFILE} is not a regular git blob")
    return decoded(_git(folder, "cat-file", "blob", entry[1], most=most, doing=f"read base {LOCKFILE}")[1], f"base {LOCKFILE}")


# --- contents service --------------------------------------------------------------------------------------------


class Contents(Protocol):
    """Answers (status, data) for a file at a commit: its description (``object``) or its bytes (``raw``)."""

    def get(self, path: str, commit: str, form: str) -> tuple[int, object]: ...


def contents_lockfile(service: Contents, path: str, commit: str, most: int = MAX_LOCKFILE) -> str | None:
    """The lockfile at a full commit id, by its description and, if that holds no content, its bytes.

    None only if the service says that there is none (404).
    """
    check_lockfile_path(path)
    if not _commit.fullmatch(commit):
        raise RetrievalError("ref must be an immutable full commit ID")

    def ask(form: str, doing: str) -> tuple[int, object]:
        status, data = service.get(path, commit, form)
        if status != 404 and not 200 <= status < 300:
            raise RetrievalError(f"the contents service returned {status} while attempting to {doing} {json.dumps(path)}")
        return status, data

    status, data = ask("object", "inspect")
    if status == 404:
        return None
    if not isinstance(data, dict) or data.get("type") != "file":
        raise RetrievalError("the contents service's answer is not a regular file")
    size, encoding, content = data.get("size"), data.get("encoding"), data.get("content")
    if type(size) is not int or size < 0:
        raise RetrievalError("the contents service's answer has an invalid file size")
    if size > most:
        raise RetrievalError(f"base lockfile exceeds the {most} byte limit")
    if encoding == "base64" and isinstance(content, str):
        try:
            raw = base64.b64decode(content.replace("\n", ""), validate=True)
        except binascii.Error as e:
            raise RetrievalError("the contents service returned invalid base64 content") from e
    elif encoding in ("none", "") and not content:
        status, answer = ask("raw", "read")
        if status == 404 or not isinstance(answer, (str, bytes)):
            raise RetrievalError("the contents service returned an invalid raw response")
        raw = answer.encode() if isinstance(answer, str) else answer
    else:
        raise RetrievalError("the contents service's answer has an unsupported content encoding")
    if len(raw) > most:
        raise RetrievalError(f"base lockfile exceeds the {most} byte limit")
    return decoded(raw, "base lockfile")


# --- artifacts ---------------------------------------------------------------------------------------------------

#: The kinds of failures, and the wording of their details below, are fixed values.
#: What a fetching callable gives for an address: its bytes, or (kind, detail) of a failure.
Fetch = Callable[[str, float, int], "bytes | tuple[str, str]"]
FETCHED = "url string, content binary, kind string, detail string"
FAILURES = ["invalid-url", "unsupported-integrity", "http-status", "timeout", "aborted", "network-error", "size-limit-exceeded", "invalid-response", "integrity-mismatch"]


def artifact_folder(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """(url, content) of a mirror on disk: each file's address is ``base_url`` and its path below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^file:/+", "/", folder.rstrip("/")) + "/"
    below = F.substring_index(F.regexp_replace("path", r"^[a-z]+:/+", "/"), root, -1)
    return files.select(F.concat(F.lit(base_url), below).alias("url"), "content")


def downloads(urls: DataFrame, fetch: Fetch, seconds: float = 30.0, most: int = MAX_TARBALL, tasks: int = 8) -> DataFrame:
    """(url, content, kind, detail): each distinct address asked for once, in ``tasks`` tasks; failures are rows.

    ``fetch`` gets the address, the seconds and the bytes it may take; what it raises, and bytes beyond the bound, are
    failures too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                try:
                    got = fetch(url, seconds, most)
                except TimeoutError:
                    got = ("timeout", "tarball request timed out")
                except Exception as e:  # a failure of one address must not end the others
                    got = ("network-error", f"tarball request failed: {type(e).__name__}")
                if isinstance(got, bytes) and len(got) > most:
                    got = ("size-limit-exceeded", f"tarball exceeds {most} bytes while streaming")
                content, (kind, detail) = (got, (None, None)) if isinstance(got, bytes) else (None, got)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([content], pa.binary()), pa.array([kind], pa.string()), pa.array([detail], pa.string())], names=["url", "content", "kind", "detail"])

    return urls.select("url").distinct().repartition(tasks, "url").mapInArrow(run, FETCHED)


def fetched(wanted: DataFrame, artifacts: DataFrame, most: int = MAX_TARBALL) -> DataFrame:
    """``wanted`` (with url and integrity) with content, or the kind and detail of a failure.

    ``artifacts`` has url and content, and may have kind and detail of downloads that failed.  An artifact is verified
    once for each distinct (url, integrity), whoever wants it; bytes that do not fit are never handed on.  An address
    without an artifact is a network error; of several artifacts of one address the one of the least digest counts.
    """
    spec = wanted.select("url", "integrity").distinct()
    tokens = archive.integrity_tokens(F.col("integrity"))
    spec = spec.withColumn(
        "refused",
        F.when(~F.coalesce(F.col("url").rlike(r"(?i)^https://[^/?#\s]+"), F.lit(False)), "invalid-url").when(F.col("integrity").isNull() | tokens.isNull(), "unsupported-integrity"),
    )
    for c in ("kind", "detail"):
        if c not in artifacts.columns:
            artifacts = artifacts.withColumn(c, F.lit(None).cast("string"))
    known = artifacts.groupBy("url").agg(F.min_by(F.struct("content", "kind", "detail"), F.coalesce(F.sha2(F.col("content"), 256), F.lit("~"))).alias("a"))
    joined = spec.join(known, "url", "left")
    content, fits = F.col("a.content"), F.array_contains(tokens, F.sha2(F.col("a.content"), 512))
    kind = F.coalesce("refused", F.col("a.kind"), F.when(F.col("a").isNull(), "network-error"), F.when(F.length(content) > most, "size-limit-exceeded"), F.when(~F.coalesce(fits, F.lit(False)), "integrity-mismatch"))
    said = {
        "invalid-url": "tarball URL must be HTTPS",
        "unsupported-integrity": "integrity must contain canonical sha512 SRI token(s)",
        "network-error": "tarball request failed",
        "size-limit-exceeded": f"declared tarball size exceeds {most} bytes",
        "integrity-mismatch": "downloaded bytes do not match lockfile sha512 integrity",
    }
    none = F.when((F.col("kind") == "unsupported-integrity") & F.col("integrity").isNull(), "tarball has no sha512 integrity")
    detail = F.coalesce(none, F.col("a.detail"), F.element_at(F.create_map(*[F.lit(x) for p in said.items() for x in p]), F.col("kind")))
    ready = joined.withColumn("kind", kind).withColumn("detail", F.when(F.col("kind").isNotNull(), detail)).withColumn("content", F.when(F.col("kind").isNull(), content))
    ready = ready.select(F.col("url").alias("_url"), F.col("integrity").alias("_integrity"), "content", "kind", "detail")
    return wanted.join(ready, wanted.url.eqNullSafe(F.col("_url")) & wanted.integrity.eqNullSafe(F.col("_integrity")), "left").drop("_url", "_integrity")


# --- registry metadata -------------------------------------------------------------------------------------------


def recent_versions(metadata: DataFrame, count: int) -> DataFrame:
    """(name, version, tarball, integrity, position) of each package's last ``count`` usable versions, oldest first.

    ``metadata`` has name and content, the registry's JSON.  Usable are releases that are not deprecated and have a
    tarball with a sha512 integrity.  Metadata of another shape has no rows.
    """
    parsed = F.from_json("content", "versions MAP<STRING, VARIANT>")["versions"]
    rows = metadata.select("name", F.explode(F.map_entries(parsed)).alias("e")).select("name", F.col("e.key").alias("version"), F.col("e.value").alias("v"))
    get = lambda p: F.when(F.schema_of_variant(F.try_variant_get("v", p, "variant")) == "STRING", F.try_variant_get("v", p, "string"))
    rows = rows.select("name", "version", F.try_variant_get("v", "$.deprecated", "variant").isNull().alias("live"), get("$.dist.tarball").alias("tarball"), get("$.dist.integrity").alias("integrity"))
    rows = rows.where(F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$") & F.col("live") & F.col("tarball").isNotNull() & F.col("integrity").startswith("sha512-")).drop("live").dropDuplicates(["name", "version"])
    number = [F.split("version", r"\.")[k].cast("decimal(38,0)") for k in range(3)]
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy("name").orderBy(*[n.desc() for n in number]))).where(F.col("back") <= count)
    total = F.count("*").over(Window.partitionBy("name"))
    return last.withColumn("position", (total - F.col("back") + 1).cast("int")).drop("back")


def adjacent(versions: DataFrame) -> DataFrame:
    """(name, old_version, new_version): each version with the one before it."""
    w = Window.partitionBy("name").orderBy("position")
    pairs = versions.withColumn("old_version", F.lag("version").over(w)).where("old_version is not null")
    return pairs.select("name", "old_version", F.col("version").alias("new_version"))
