"""Facts of package files as tables: declared and scripted capabilities, what was not read, and lexical signals.

Files come as (artifact, path, content); each is read once, in Arrow batches, by the readers of ``sources``.  What a
package's side gains from an artifact is joined afterwards, so an artifact that several packages share is read once.
"""

from __future__ import annotations

import re
import sys
import time
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lockgrain import workers
from lockgrain.functions import address, text
from lockgrain.operators import capabilities as caps
from lockgrain.operators import signals
from lockgrain.sources import jsscan, manifest

EVIDENCE = "array<struct<file:string,line:int,snippet:string>>"
MANIFEST = f"pkg string, side string, fact string, kind string, key string, applicability string, value string, target_name string, command string, detail string, evidence {EVIDENCE}"
SOURCE = "artifact string, file string, fact string, state string, bytes long, entropy int, kind string, value string, n int, line int, snippet string, detail string"
LOCATION = "struct<kind:string,hook:string,applicability:string>"

_array = re.compile(r"\[([^\[\]]{1,4096})\]")
_hex = re.compile(r"0[xX][0-9A-Fa-f]{1,2}")
_small = re.compile(r"[0-9]{1,3}")


def _tables(df: DataFrame, schema: str, read) -> DataFrame:
    """Rows of ``schema`` from ``read``, which gives a list of them for each row of ``df`` (as a tuple)."""
    workers.prepare(df.sparkSession, workers.BATCH_ROWS, workers.BATCH_BYTES)
    wanted = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(wanted)
    names = [f.name for f in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [found for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for found in read(*row)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=target)

    return df.mapInArrow(run, schema)


# --- manifests ---------------------------------------------------------------------------------------------------


#: What a fact says that could not be found any more in the time of a run.
STOPPED, STOP_DETAIL = "deadline-exceeded", "analysis wall-clock deadline exceeded"


def _late(stop_at: float | None) -> bool:
    return stop_at is not None and time.time() > stop_at


def _manifest_facts(pkg: str, side: str, name: str, version: str, content: bytes | None, max_bytes: int, stop_at: float | None) -> list[dict]:
    own = {"pkg": pkg, "side": side}
    if _late(stop_at):
        return [own | {"fact": "failure", "kind": STOPPED, "detail": STOP_DETAIL}]
    try:
        found, faults = manifest.capabilities(content, name, version, max_bytes)
    except manifest.ManifestError as e:
        evidence = [manifest.evidence_at(content.decode("utf-8", "replace"), e.at)] if e.at is not None and content else None
        return [own | {"fact": "failure", "kind": e.kind, "detail": str(e), "evidence": evidence}]
    rows = [own | {"fact": "capability", "kind": c["kind"], "key": c["key"], "applicability": c.get("applicability"), "value": c["value"], "target_name": c.get("target"), "command": c.get("command"), "evidence": [c["evidence"]]} for c in found]
    return rows + [own | {"fact": "diagnostic", "kind": f["kind"], "detail": f["detail"], "evidence": [f["evidence"]]} for f in faults]


def manifests(subjects: DataFrame, files: DataFrame, max_bytes: int = manifest.MAX_BYTES, stop_at: float | None = None, order: str | None = None) -> DataFrame:
    """Facts of the manifests of ``subjects`` (pkg, side, name, version, artifact): capability, diagnostic or failure.

    A subject whose artifact has no package.json, or one that is no strict JSON or another package's, has one failure,
    and so has one that is not reached before ``stop_at`` (seconds of the epoch); tasks go by the column ``order``.
    Null names or versions equal nothing; an empty table gives an empty table.
    """
    own = files.where("path = 'package.json'").select("artifact", "content")
    rows = subjects.join(own, "artifact", "left")
    rows = rows.sortWithinPartitions(order) if order else rows
    return _tables(rows.select("pkg", "side", "name", "version", "content"), MANIFEST, partial(_manifest_facts, max_bytes=max_bytes, stop_at=stop_at))


def declared(facts: DataFrame) -> DataFrame:
    """The capabilities among manifest facts, with location and slot."""
    kind = F.col("kind")
    place = F.when(kind == "INSTALL_HOOK", "install-script").when(kind == "COMMAND_ENTRYPOINT", "runtime").otherwise("manifest")
    location = F.struct(place.alias("kind"), F.when(kind == "INSTALL_HOOK", F.col("key")).alias("hook"), F.col("applicability").alias("applicability"))
    found = facts.where("fact = 'capability'")
    return found.select("pkg", "side", "kind", caps.slot(kind, F.col("key"), F.lit(None).cast("string")).alias("slot"), "key", location.alias("location"), "value", "target_name", "evidence")


# --- scripts and signals -----------------------------------------------------------------------------------------


def byte_arrays(source: str) -> Iterator[tuple[int, str, int]]:
    """(offset, notation, elements) of lists that may hide code: eight or more bytes in hexadecimal, or numbers to 255."""
    for m in _array.finditer(source):
        items = [x for x in (e.strip() for e in m[1].split(",")) if x]
        if len(items) < signals.LEAST_ELEMENTS:
            continue
        if all(map(_hex.fullmatch, items)):
            yield m.start(), signals.HEX_ARRAY, len(items)
        elif all(_small.fullmatch(x) and int(x) <= 255 for x in items):
            yield m.start(), signals.NUMBER_ARRAY, len(items)


#: What a worker remembers of files that many artifacts hold alike: so many, of so many bytes, with so many facts at most.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_FACTS = 256, 32 << 10, 64
_remembered: dict[tuple[str, bytes, int, float], list[dict]] = {}


def _source_facts(artifact: str, file: str, content: bytes | None, max_bytes: int, seconds: float, stop_at: float | None) -> list[dict]:
    own, data = {"artifact": artifact}, content or b""
    if _late(stop_at):
        return [own | {"file": file, "fact": "stopped", "kind": STOPPED, "detail": STOP_DETAIL}]
    key = (file, data, max_bytes, seconds)
    facts = _remembered.pop(key, None) if len(data) <= REMEMBERED_BYTES else None
    if facts is None:
        facts = _facts_of(file, data, max_bytes, seconds)
    if len(data) <= REMEMBERED_BYTES and len(facts) <= REMEMBERED_FACTS:
        _remembered[key] = facts  # the latest stand last
        if len(_remembered) > REMEMBERED:
            del _remembered[next(iter(_remembered))]
    return [own | f for f in facts]


def _facts_of(file: str, data: bytes, max_bytes: int, seconds: float) -> list[dict]:
    own = {"file": file}
    state, found, fault = jsscan.scan(file, data, max_bytes, seconds)
    rows = [own | {"fact": "detection", "state": state, "kind": k, "line": line, "snippet": s} for k, line, s in found]
    if fault:
        kind, detail, line, snippet = fault
        rows.append(own | {"fact": "diagnostic", "kind": kind, "detail": detail, "line": line, "snippet": snippet})
    if state in ("native", "ignored"):
        return rows
    rows.append(own | {"fact": "file", "state": state, "bytes": len(data), "entropy": signals.entropy(data)})
    source = data.decode("utf-8", "replace").removeprefix("﻿")
    starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def at(offset: int) -> dict:
        k = bisect_right(starts, offset)
        line = source[starts[k - 1] : starts[k] if k < len(starts) else len(source)]
        return {"line": k, "snippet": line.strip()[: jsscan.SNIPPET]}

    rows += [own | {"fact": "endpoint", "state": state, "kind": kind, "value": value} | at(offset) for offset, kind, value in address.endpoints(source)]
    rows += [own | {"fact": "array", "state": state, "kind": kind, "n": n} | at(offset) for offset, kind, n in byte_arrays(source)]
    return rows


def sources(files: DataFrame, max_bytes: int = jsscan.MAX_BYTES, seconds: float = jsscan.SECONDS, stop_at: float | None = None) -> DataFrame:
    """Facts of source files, in rows of a ``fact``.

    detection: a capability at a line.  diagnostic: a file that was not read as source.  file: its state, bytes and
    entropy.  endpoint and array: external addresses and hidden bytes, in files that no parser could read as well.
    stopped: a file that was not reached before ``stop_at``.  Null contents count as empty files; files that are no
    source have no rows.
    """
    routed = files.where(F.lower("path").rlike(r"\.(js|mjs|cjs|ts|node)$|(^|/)binding\.gyp$"))
    return _tables(routed.select("artifact", "path", "content"), SOURCE, partial(_source_facts, max_bytes=max_bytes, seconds=seconds, stop_at=stop_at))


def sorted_evidence(evidence: Column) -> Column:
    """Distinct evidence in the order of its JSON text, in which line 10 stands before line 9."""
    keyed = F.transform(evidence, lambda e: F.struct(F.to_json(e).alias("text"), e.alias("e")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda k: k["e"])


def evidence(file: Column, line: Column, snippet: Column) -> Column:
    return F.struct(file.alias("file"), line.cast("int").alias("line"), snippet.alias("snippet"))


def scripted(detections: DataFrame, hooks: DataFrame) -> DataFrame:
    """Code capabilities of (pkg, side): detections grouped by kind and location, with their evidence.

    ``detections`` has pkg, side, file, state, kind, line and snippet, ``hooks`` pkg, side, hook, applicability and the
    command.  A file that a hook runs gives a capability for each such hook; native artifacts and all other files run
    at runtime.
    """
    run = hooks.select("pkg", "side", "hook", "applicability", text.node_entrypoint(F.col("command")).alias("file")).where("file is not null").distinct()
    placed = detections.join(run.withColumn("state", F.lit("parsed")), ["pkg", "side", "file", "state"], "left")
    location = F.when(F.col("hook").isNull(), F.struct(F.lit("runtime").alias("kind"), F.lit(None).cast("string").alias("hook"), F.lit(None).cast("string").alias("applicability")))
    location = location.otherwise(F.struct(F.lit("install-script").alias("kind"), F.col("hook").alias("hook"), F.col("applicability").alias("applicability")))
    seen = evidence(F.col("file"), F.col("line"), F.col("snippet"))
    grouped = placed.withColumn("location", location).groupBy("pkg", "side", "kind", "location").agg(F.collect_set(seen).alias("evidence"))
    slot = F.concat(F.lit('["'), F.col("kind"), F.lit('",'), F.to_json("location"), F.lit("]"))
    null = F.lit(None).cast("string")
    return grouped.select("pkg", "side", "kind", slot.alias("slot"), null.alias("key"), "location", null.alias("value"), null.alias("target_name"), sorted_evidence(F.col("evidence")).alias("evidence"))


def layers(declared_: DataFrame, scripted_: DataFrame) -> DataFrame:
    """Both layers of capabilities as one table."""
    return declared_.unionByName(scripted_)


def endpoint_observations(facts: DataFrame) -> DataFrame:
    """(pkg, side, endpoint_type, value, confidence, evidence): an address once, literal if any parsed file holds it."""
    found = facts.where("fact = 'endpoint'")
    sure = F.max(F.col("state") == "parsed")
    seen = F.collect_set(evidence(F.col("file"), F.col("line"), F.col("snippet")))
    grouped = found.groupBy("pkg", "side", F.col("kind").alias("endpoint_type"), "value").agg(sure.alias("sure"), seen.alias("evidence"))
    return grouped.select("pkg", "side", "endpoint_type", "value", F.when(F.col("sure"), "literal").otherwise("byte-scan-candidate").alias("confidence"), sorted_evidence(F.col("evidence")).alias("evidence"))


def array_observations(facts: DataFrame) -> DataFrame:
    """(pkg, side, file, pattern, n, evidence): the longest list of each notation in a file, with all places."""
    seen = F.collect_set(evidence(F.col("file"), F.col("line"), F.col("snippet")))
    grouped = facts.where("fact = 'array'").groupBy("pkg", "side", "file", F.col("kind").alias("pattern")).agg(F.max("n").alias("n"), seen.alias("evidence"))
    return grouped.withColumn("evidence", sorted_evidence(F.col("evidence")))


def file_observations(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'file'").select("pkg", "side", "file", "bytes", "entropy", "state")


if sys.getrecursionlimit() < 20_000:  # syntax trees are walked by recursion where they are read
    sys.setrecursionlimit(20_000)
