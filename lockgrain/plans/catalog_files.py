"""Queries of the operators over lockfiles, artifacts and package files, which are made up from the driver's tables.

Each table row is written out as the file, entry or fact that its key says, read by the operators, and held against SQL
that says the result by the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockgrain.operators import capabilities as caps
from lockgrain.operators import extraction, findings, lockfile, signals
from lockgrain.plans.catalog import dealt, query, read
from lockgrain.sources import retrieval

#: Parts of one made-up lockfile or package.
PER_FILE = 13
#: A canonical integrity of no particular bytes.
INTEGRITY = "sha512-" + "A" * 86 + "=="


def choose(k: Column, options: list[str | Column | None]) -> Column:
    """The option whose number ``k`` is."""
    out = F.when(k == 0, options[0])
    for n, o in enumerate(options[1:], 1):
        out = out.when(k == n, o)
    return out


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One content a file (a lockfile of a few parts) from its entries."""
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda e: e["entry"]), ",")
    return rows.groupBy(*keys).agg(F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"name":"root"},'), entries, F.lit("}}")).alias("content"))


_ENTRIES = [
    '{"version":"1.0.0","resolved":"https://registry.npmjs.org/a.tgz","integrity":"sha512-x"}',
    '{"version":7}',
    '{"link":true,"resolved":"../w"}',
    '{"name":"@s/other","version":"2.0.0"}',
    '{"version":"1.0.0","link":"yes"}',
    '{"resolved":5,"integrity":6}',
    '"text"',
    '{"name":null,"version":"3.0.0"}',
]


@query("""
SELECT p_partkey // 13 AS pair, 'a/node_modules/p' || p_partkey AS path, CASE WHEN p_partkey % 8 = 3 THEN '@s/other' ELSE 'p' || p_partkey END AS name,
CASE p_partkey % 8 WHEN 0 THEN '1.0.0' WHEN 3 THEN '2.0.0' WHEN 4 THEN '1.0.0' WHEN 7 THEN '3.0.0' END AS version, p_partkey % 8 = 2 AS link,
CASE p_partkey % 8 WHEN 1 THEN '"version" is not a string' WHEN 4 THEN '"link" is not a boolean' WHEN 5 THEN '"resolved" is not a string' WHEN 6 THEN 'entry is not an object' WHEN 7 THEN '"name" is not a string' END AS fault
FROM part WHERE p_partkey % 5 > 0""")
def lockfile_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of lockfiles with fields of right and wrong types; paths of no dependency are left out."""
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "src/p").otherwise("a/node_modules/p")
    rows = read(spark, sf_dir, "part").select(F.floor(k / PER_FILE).alias("pair"), F.lit("new").alias("side"), k.alias("k"), F.concat(F.lit('"'), folder, k.cast("string"), F.lit('":'), choose(k % 8, list(map(F.lit, _ENTRIES)))).alias("entry"))
    return lockfile.positions(_joined(rows, ["pair", "side"])).select("pair", "path", "name", "version", "link", "fault")


def _entry(version: str | None, resolved: str | None = "https://registry.npmjs.org/a.tgz", integrity: str | None = "sha512-x", link: bool = False) -> str:
    fields = [f'"{n}":"{v}"' for n, v in (("version", version), ("resolved", resolved), ("integrity", integrity)) if v is not None]
    return "{" + ",".join(fields + ['"link":true'] * link) + "}"


#: (old entry, new entry) of each kind of part.
_SIDES: list[tuple[str | None, str | None]] = [
    (_entry("1.0.0"), _entry("1.0.0")),
    (_entry("1.0.0"), _entry("1.1.0")),
    (None, _entry("1.0.0")),
    (_entry("1.0.0"), None),
    (_entry("1.0.0"), _entry("1.0.0", integrity="sha512-y")),
    (_entry("2.0.0"), _entry("1.9.0")),
    (_entry("1.0.0"), _entry("1.0.0", link=True, integrity=None)),
    (_entry("1.0.0"), _entry("1.1.0", resolved=None)),
    (_entry("1.0.0"), _entry("1.1.0", resolved="git+ssh://git@host/x.git")),
    (_entry("1.0.0"), _entry("1.1.0", resolved="https://npm.corp.example:8443/x.tgz")),
    (_entry("1.0.0"), _entry("1.1.0", integrity=None)),
    (_entry("1.0.0"), _entry("1.1.0", resolved="no address")),
    (_entry("1.0.0"), _entry(None)),
    (_entry("1.0.0", resolved="https://npm.corp.example/x.tgz"), _entry("1.1.0")),
]


@query("""
WITH p AS (SELECT p_partkey // 13 AS pair, 'p' || p_partkey AS name, p_partkey % 14 AS k FROM part)
SELECT pair, name, 'changed' AS sort, CASE k WHEN 2 THEN 'new' WHEN 13 THEN 'new' WHEN 5 THEN '2.0.0' ELSE '1.0.0' END AS a, CASE k WHEN 2 THEN '1.0.0' WHEN 4 THEN '1.0.0' WHEN 5 THEN '1.9.0' ELSE '1.1.0' END AS b FROM p WHERE k IN (1, 2, 4, 5, 13)
UNION ALL SELECT pair, name, 'finding', CASE k WHEN 5 THEN 'version-downgrade' ELSE 'integrity-changed-version-same' END, 'node_modules/' || name FROM p WHERE k IN (4, 5, 6)
UNION ALL SELECT pair, name, 'skipped', CASE k WHEN 6 THEN 'unanalyzable-source' WHEN 7 THEN 'missing-resolved' WHEN 8 THEN 'unanalyzable-source' WHEN 9 THEN 'private-registry' WHEN 10 THEN 'missing-integrity' ELSE 'malformed-entry' END,
CASE k WHEN 6 THEN 'workspace link entry' WHEN 7 THEN 'entry has no resolved URL' WHEN 8 THEN 'non-registry source: git+ssh://git@host/x.git' WHEN 9 THEN 'registry host: npm.corp.example:8443' WHEN 10 THEN 'registry entry has no integrity hash' WHEN 11 THEN 'resolved is not a valid URL' ELSE 'entry has no version' END FROM p WHERE k BETWEEN 6 AND 12""")
def lockfile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed packages, facts and skipped positions of pairs of lockfiles, with every reason to skip."""
    k = F.col("p_partkey")
    part = dealt(read(spark, sf_dir, "part").select(F.floor(k / PER_FILE).alias("pair"), k.alias("k")), "k")
    side = lambda n, name: part.select("pair", F.lit(name).alias("side"), "k", F.concat(F.lit('"node_modules/p'), F.col("k").cast("string"), F.lit('":'), choose(F.col("k") % 14, [F.lit(s[n]) for s in _SIDES])).alias("entry")).where("entry is not null")
    d = lockfile.diff(_joined(side(0, "old").union(side(1, "new")), ["pair", "side"]))
    row = lambda df, sort, a, b: df.select("pair", "name", F.lit(sort).alias("sort"), a.alias("a"), b.alias("b"))
    out = row(d.changed, "changed", F.coalesce("old_version", F.lit("new")), F.col("new_version"))
    return out.union(row(d.findings, "finding", F.col("kind"), F.col("path"))).union(row(d.skipped, "skipped", F.col("reason"), F.col("detail")))


@query("""
WITH v AS (SELECT p_partkey // 13 AS name, p_size AS minor, p_partkey AS patch, p_partkey % 4 = 1 AS dead, p_partkey % 4 = 2 AS weak FROM part), g AS (SELECT name, minor, patch FROM v WHERE NOT dead AND NOT weak),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY minor DESC, patch DESC) AS back FROM g), l AS (SELECT *, lag('1.' || minor || '.' || patch) OVER (PARTITION BY name ORDER BY minor, patch) AS old_version FROM r WHERE back <= 4)
SELECT 'n' || name AS name, old_version, '1.' || minor || '.' || patch AS new_version FROM l WHERE old_version IS NOT NULL""")
def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring ones of each package's last four usable versions, from registry metadata."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"), k.cast("string"))
    dist = F.concat(F.lit('"dist":{"tarball":"https://registry.npmjs.org/a.tgz","integrity":"'), F.when(k % 4 == 2, "sha1-").otherwise("sha512-"), F.lit('x"}'))
    entry = F.concat(F.lit('"'), version, F.lit('":{'), F.when(k % 4 == 1, '"deprecated":"old",').otherwise(""), dist, F.lit("}"))
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("n"), F.floor(k / PER_FILE).cast("string")).alias("name"), entry.alias("entry"))
    meta = rows.groupBy("name").agg(F.concat(F.lit('{"versions":{"2.0.0-beta":{},'), F.array_join(F.sort_array(F.collect_list("entry")), ","), F.lit("}}")).alias("content"))
    return retrieval.adjacent(retrieval.recent_versions(meta, 4))


@query("""
SELECT c_custkey AS custkey, CASE c_custkey % 7 WHEN 1 THEN 'invalid-url' WHEN 2 THEN 'unsupported-integrity' WHEN 3 THEN 'unsupported-integrity' WHEN 4 THEN 'integrity-mismatch' WHEN 5 THEN 'network-error' END AS kind,
CASE c_custkey % 7 WHEN 1 THEN 'tarball URL must be HTTPS' WHEN 2 THEN 'tarball has no sha512 integrity' WHEN 3 THEN 'integrity must contain canonical sha512 SRI token(s)' WHEN 4 THEN 'downloaded bytes do not match lockfile sha512 integrity' WHEN 5 THEN 'tarball request failed' END AS detail,
CASE WHEN c_custkey % 7 IN (0, 6) THEN c_name END AS content FROM customer""")
def verified_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts against the integrity that a lockfile states; what does not fit is never handed on."""
    k, body = F.col("c_custkey"), F.col("c_name").cast("binary")
    own = F.concat(F.lit("sha512-"), F.regexp_replace(F.base64(F.unhex(F.sha2(body, 512))), r"\s", ""))
    integrity = choose(k % 7, [own, own, F.lit(None).cast("string"), F.lit("sha512-short"), F.lit(INTEGRITY), own, F.concat_ws(" ", F.lit(INTEGRITY), own)])
    url = F.concat(F.when(k % 7 == 1, "http").otherwise("https"), F.lit("://registry.npmjs.org/"), k.cast("string"))
    rows = read(spark, sf_dir, "customer").select(k.alias("custkey"), url.alias("url"), integrity.alias("integrity"), body.alias("body"))
    got = retrieval.fetched(rows.drop("body"), rows.where("custkey % 7 <> 5").select("url", F.col("body").alias("content")))
    return got.select("custkey", "kind", "detail", F.col("content").cast("string").alias("content"))


@query("SELECT page_id, path, NOT regexp_matches(path, '(^|/)(\\.\\.)?(/|$)') AND NOT contains(path, chr(92)) AS valid FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '//', '/') WHEN 1 THEN '/' || url WHEN 2 THEN replace(replace(url, '//', '/'), '/en/', '/../') ELSE replace(replace(url, '//', '/'), '/de/', chr(92)) END AS path FROM pages)")
def lockfile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are normalised and relative."""
    k, one = F.col("page_id") % 4, F.replace(F.col("url"), F.lit("//"), F.lit("/"))
    path = choose(k, [one, F.concat(F.lit("/"), "url"), F.replace(one, F.lit("/en/"), F.lit("/../")), F.replace(one, F.lit("/de/"), F.lit("\\"))])
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), retrieval.lockfile_path(path).alias("valid"))


# --- manifests and scripts ---------------------------------------------------------------------------------------

#: What stands in each kind of manifest after its name and version.
_MANIFESTS = [
    '"scripts": {"postinstall": "node ./a.js", "test": "t"}',
    '"scripts": {"prepare": "build", "install": 3}',
    '"bin": "cli.js"',
    '"bin": {"one": "1.js", "two": 2}',
    '"dependencies": {"dep": "npm:@s/real@^2"}',
    '"engines": {"node": ">=18"}',
    '"engines": {"node": 1}, "engines": 2',
    '"engines": [],',
]


@query("""
WITH p AS (SELECT p_partkey AS pkg, p_partkey % 9 AS k FROM part),
c(k, fact, kind, key, value, detail, line) AS (VALUES
(0, 'capability', 'INSTALL_HOOK', 'postinstall', sha256('node ./a.js'), NULL, 4), (1, 'capability', 'INSTALL_HOOK', 'prepare', sha256('build'), NULL, 4), (1, 'diagnostic', 'malformed-manifest-field', NULL, NULL, 'scripts.install must be a string', 4),
(2, 'capability', 'COMMAND_ENTRYPOINT', 'name', 'cli.js', NULL, 4), (3, 'capability', 'COMMAND_ENTRYPOINT', 'one', '1.js', NULL, 4), (3, 'diagnostic', 'malformed-manifest-field', NULL, NULL, 'bin.two must be a string', 4),
(4, 'capability', 'DEPENDENCY', 'dep', 'npm:@s/real@^2', NULL, 4), (5, 'capability', 'RUNTIME_CONSTRAINT', 'node', '>=18', NULL, 4), (6, 'failure', 'manifest-invalid-json', NULL, NULL, 'package.json contains duplicate key "engines"', 4),
(7, 'failure', 'manifest-invalid-json', NULL, NULL, 'package.json is invalid JSON: trailing comma', 5), (8, 'failure', 'manifest-missing', NULL, NULL, 'package.json is missing', NULL))
SELECT CAST(pkg AS VARCHAR) AS pkg, fact, kind, key, value, detail, line FROM p JOIN c ON c.k = p.k""")
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What manifests declare, what of them is malformed, and which cannot be read."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("pkg"), (F.col("p_partkey") % 9).alias("k"))
    subjects = part.select("pkg", F.lit("new").alias("side"), F.lit("@s/name").alias("name"), F.concat(F.lit("1.0."), "pkg").alias("version"), F.col("pkg").alias("artifact"))
    content = F.concat(F.lit('{\n  "name": "@s/name",\n  "version": "1.0.'), "pkg", F.lit('",\n  '), choose(F.col("k"), list(map(F.lit, _MANIFESTS))), F.lit("\n}\n"))
    files = part.where("k < 8").select(F.col("pkg").alias("artifact"), F.lit("package.json").alias("path"), content.cast("binary").alias("content"))
    facts = extraction.manifests(subjects, files)
    return facts.select("pkg", "fact", "kind", "key", "value", "detail", F.get("evidence", F.lit(0))["line"].alias("line"))


#: (file, source, and what is found there) of each kind of script.
SCRIPTS: list[tuple[str, str, list[tuple[str, str, int]]]] = [
    ("a.js", "const cp = require('node:child_process');\n", [("detection", "PROCESS", 1)]),
    ("b.mjs", "import https from 'https';\nawait fetch('https://example.test/x');\n", [("detection", "NET", 1), ("detection", "NET", 2), ("endpoint", "domain", 2)]),
    ("c.js", "function run(fetch) { fetch('x'); }\n", []),
    ("d.cjs", "const fs = require('fs');\nfs.readFileSync('.ssh/id');\n", [("detection", "FS_READ", 2), ("detection", "FS_SENSITIVE", 2)]),
    ("e.cjs", "const read = fs.readFile;\nconst fs = require('fs');\nconst again = read;\nagain('x');\n", [("detection", "UNKNOWN", 4)]),
    ("f.js", "import { unlink as remove } from 'fs';\n\nremove('x');\n", [("detection", "FS_WRITE", 3)]),
    ("g.js", "const t = process['env'].T;\n", [("detection", "ENV", 1)]),
    ("h.js", "eval('1');\nnew Function('x');\nrequire('vm');\n", [("detection", "DYNAMIC_CODE", 1), ("detection", "DYNAMIC_CODE", 2), ("detection", "DYNAMIC_CODE", 3)]),
    ("i.js", "WebAssembly.compile(b);\nrequire('./x.node');\nprocess.dlopen(m);\n", [("detection", "NATIVE", 1), ("detection", "NATIVE", 2), ("detection", "NATIVE", 3)]),
    ("j.js", "require(name);\nimport(other);\n", [("detection", "UNKNOWN", 1), ("detection", "UNKNOWN", 2)]),
    ("k.js", "const x =\n'8.8.8.8', y = ;\n", [("diagnostic", "unparseable-source", 2), ("endpoint", "ipv4", 2)]),
    ("l.ts", "const a: number = 1;\n", [("diagnostic", "unsupported-source", 1)]),
    ("m.d.ts", "declare const a: string;\n", []),
    ("n.node", "binary", [("detection", "NATIVE", 1)]),
    ("lib/binding.gyp", "{}", [("detection", "NATIVE", 1)]),
    ("o.js", "// eval('x')\nconst s = \"eval('x')\", r = /eval(1)/g;\n", []),
    ("p.js", "const data = [\n0x01,0x02,0x03,0x04,\n0x05,0x06,0x07,0x08];\n", [("array", "hex-byte-array", 1)]),
]

_FOUND = ", ".join(f"({k}, '{fact}', '{kind}', {line})" for k, (_, _, found) in enumerate(SCRIPTS) for fact, kind, line in found)


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % len(SCRIPTS)
    return dealt(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("artifact"), choose(k, [F.lit(s[0]) for s in SCRIPTS]).alias("path"), choose(k, [F.lit(s[1]) for s in SCRIPTS]).cast("binary").alias("content"))


@query(f"""
WITH c(k, fact, kind, line) AS (VALUES {_FOUND}) SELECT CAST(p_partkey AS VARCHAR) AS artifact, fact, kind, line FROM part JOIN c ON c.k = p_partkey % {len(SCRIPTS)}""")
def script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities, addresses, hidden bytes and unread files among scripts."""
    return extraction.sources(_scripts(spark, sf_dir)).where("fact <> 'file'").select("artifact", "fact", "kind", "line")


_STATES = {"l.ts": "unsupported", "k.js": "unparseable"}


@query("""
WITH f(k, file, state, bytes) AS (VALUES """ + ", ".join(f"({k}, '{name}', '{_STATES.get(name, 'parsed')}', {len(text.encode())})" for k, (name, text, _) in enumerate(SCRIPTS) if not name.endswith((".d.ts", ".node", ".gyp"))) + f""")
SELECT CAST(p_partkey AS VARCHAR) AS artifact, file, state, bytes FROM part JOIN f ON f.k = p_partkey % {len(SCRIPTS)}""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source file was read, and its size."""
    return extraction.sources(_scripts(spark, sf_dir)).where("fact = 'file'").select("artifact", "file", "state", "bytes")


@query(f"""
WITH c(k, fact, kind, line) AS (VALUES {_FOUND}), d AS (SELECT p_partkey // 40 AS pkg, p_partkey, k, kind, line FROM part JOIN c ON c.k = p_partkey % {len(SCRIPTS)} WHERE fact = 'detection'),
h AS (SELECT pkg, kind, CASE WHEN k = 0 AND pkg % 2 = 0 THEN 'postinstall' WHEN k = 0 THEN 'install' END AS hook, k, line FROM d)
SELECT CAST(pkg AS VARCHAR) AS pkg, kind, CASE WHEN hook IS NULL THEN 'runtime' ELSE 'install-script' END AS location, hook, count(DISTINCT (k, line)) AS n FROM h GROUP BY ALL""")
def code_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code capabilities by kind and location, where install hooks run one of the files."""
    part = dealt(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("artifact"), F.floor(F.col("p_partkey") / 40).alias("n"))
    side = part.select("artifact", F.col("n").cast("string").alias("pkg"), F.lit("new").alias("side"))
    found = side.join(extraction.sources(_scripts(spark, sf_dir)).where("fact = 'detection'"), "artifact")
    hook = F.when(F.col("n") % 2 == 0, "postinstall").otherwise("install")
    hooks = part.select(F.col("n").cast("string").alias("pkg"), F.lit("new").alias("side"), hook.alias("hook"), F.lit("registry-install").alias("applicability"), F.lit("node --no-warnings './a.js' --x").alias("command")).distinct()
    return extraction.scripted(found, hooks).select("pkg", "kind", F.col("location.kind").alias("location"), "location.hook", F.size("evidence").cast("long").alias("n"))


@query("""
WITH e AS (SELECT user_id, event_type, CAST(floor(value) AS INTEGER) AS v, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS pkg, CASE WHEN event_type = 'view' THEN 'ipv4' ELSE 'domain' END AS endpoint_type, event_type AS value, CASE WHEN bool_or(v % 2 = 0) THEN 'literal' ELSE 'byte-scan-candidate' END AS confidence, count(DISTINCT v) AS n FROM e GROUP BY user_id, event_type""")
def endpoint_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses once a package, sure if any parsed file holds them, with their distinct places."""
    v = F.floor("value").cast("int")
    facts = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pkg"), F.lit("new").alias("side"), F.lit("endpoint").alias("fact"), F.when(F.col("event_type") == "view", "ipv4").otherwise("domain").alias("kind"), F.col("event_type").alias("value"), F.when(v % 2 == 0, "parsed").otherwise("unparseable").alias("state"), F.lit("f").alias("file"), v.alias("line"), F.lit("").alias("snippet"))
    return extraction.endpoint_observations(facts).select("pkg", "endpoint_type", "value", "confidence", F.size("evidence").cast("long").alias("n"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS pkg, event_type AS file, 'charcode-array' AS pattern, CAST(max(floor(value)) AS INTEGER) AS n, count(DISTINCT event_id) AS places FROM events GROUP BY user_id, event_type""")
def array_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest hidden array of a file and notation, with all its places."""
    facts = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pkg"), F.lit("new").alias("side"), F.lit("array").alias("fact"), F.lit("charcode-array").alias("kind"), F.col("event_type").alias("file"), F.floor("value").cast("int").alias("n"), F.col("event_id").cast("int").alias("line"), F.lit("").alias("snippet"))
    return extraction.array_observations(facts).select("pkg", "file", "pattern", "n", F.size("evidence").cast("long").alias("places"))


# --- findings ----------------------------------------------------------------------------------------------------

_FILES = """
WITH f AS (SELECT doc_id // 40 AS pkg, doc_id // 2 % 20 AS file, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, n_chars AS bytes, CASE doc_id % 3 WHEN 0 THEN 'parsed' WHEN 1 THEN 'unparseable' ELSE 'unsupported' END AS state, CAST(5000 + n_chars * 7 % 2500 AS INTEGER) AS entropy FROM documents),
n AS (SELECT * FROM f WHERE side = 'new'), o AS (SELECT * FROM f WHERE side = 'old')"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(F.floor(d / 40).alias("pkg"), (F.floor(d / 2) % 20).cast("string").alias("file"), F.when(d % 2 == 0, "old").otherwise("new").alias("side"), F.col("n_chars").alias("bytes"), choose(d % 3, ["parsed", "unparseable", "unsupported"]).alias("state"), (F.lit(5000) + F.col("n_chars") * 7 % 2500).cast("int").alias("entropy"))


@query(_FILES + """, m AS (SELECT pkg, sum(bytes) FILTER (side = 'new' AND state <> 'parsed') AS now, coalesce(sum(bytes) FILTER (side = 'old' AND state <> 'parsed'), 0) AS was FROM f GROUP BY 1)
SELECT n.pkg, 'unparseable-file' AS kind, CASE WHEN o.pkg IS NULL THEN 'added' ELSE 'changed' END AS change, 'MEDIUM' AS severity, n.file || ' is ' || n.state || ' (' || n.bytes || ' bytes)' AS detail FROM n LEFT JOIN o USING (pkg, file) WHERE n.state <> 'parsed' AND (o.pkg IS NULL OR o.state <> n.state OR o.bytes <> n.bytes)
UNION ALL SELECT n.pkg, 'entropy-jump', 'changed', 'MEDIUM', n.file || ' entropy rose from ' || o.entropy || ' to ' || n.entropy || ' millibits/byte (+' || (n.entropy - o.entropy) || ')' FROM n JOIN o USING (pkg, file) WHERE n.bytes >= 256 AND n.entropy >= 6500 AND n.entropy - o.entropy >= 1000
UNION ALL SELECT pkg, 'unparseable-bytes-growth', 'changed', 'MEDIUM', 'unparseable/unsupported source bytes grew from ' || was || ' to ' || now || ' (+' || (now - was) || ')' FROM m WHERE now > was AND pkg IN (SELECT pkg FROM o)
UNION ALL SELECT e.user_id, 'new-external-endpoint', 'added', 'HIGH', 'new external domain ' || e.event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_id % 2 = 0 AND p.user_id = e.user_id AND p.event_type = e.event_type)
UNION ALL SELECT a.user_id, 'obfuscation-pattern-added', CASE WHEN b.n IS NULL THEN 'added' ELSE 'changed' END, 'MEDIUM', CASE WHEN b.n IS NULL THEN 'hex-byte-array with ' || a.n || ' elements added' ELSE 'hex-byte-array grew from ' || b.n || ' to ' || a.n || ' elements' END
FROM (SELECT user_id, event_type, CAST(max(floor(value)) AS INTEGER) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) a LEFT JOIN (SELECT user_id, event_type, CAST(max(floor(value)) AS INTEGER) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) b USING (user_id, event_type) WHERE b.n IS NULL OR b.n < a.n""")
def signal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of signal findings at production thresholds; odd rows are the new side."""
    e = read(spark, sf_dir, "events")
    side = F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("side")
    place = F.array(extraction.evidence(F.lit("f"), F.lit(1), F.lit("")))
    endpoints = e.select(F.col("user_id").alias("pkg"), side, F.lit("domain").alias("endpoint_type"), F.col("event_type").alias("value")).distinct().withColumn("evidence", place)
    arrays = e.groupBy(F.col("user_id").alias("pkg"), side, F.col("event_type").alias("file")).agg(F.max(F.floor("value")).cast("int").alias("n")).withColumns({"pattern": F.lit("hex-byte-array"), "evidence": place})
    files = _files(spark, sf_dir)
    found = findings.signal_gains(endpoints, arrays, files, files.select("pkg", "side").distinct())
    return found.select("pkg", "kind", "change", "severity", "detail")


_KIND = "CASE l_linenumber % 7 WHEN 0 THEN 'NET' WHEN 1 THEN 'ENV' WHEN 2 THEN 'PROCESS' WHEN 3 THEN 'INSTALL_HOOK' WHEN 4 THEN 'FS_WRITE' WHEN 5 THEN 'NATIVE' ELSE 'DEPENDENCY' END"
_GRADED = f"""
WITH g AS (SELECT DISTINCT l_orderkey AS pkg, {_KIND} AS kind, l_returnflag AS flag FROM lineitem), s AS (SELECT *, flag = 'A' AS hooked, 'k' || kind || flag AS slot FROM g),
hidden AS (SELECT DISTINCT o_orderkey AS pkg FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT pkg, bool_or(kind = 'NET') AND bool_or(kind = 'ENV') AS leak, bool_or(kind = 'PROCESS') AND pkg IN (SELECT pkg FROM hidden) AS obscure FROM s GROUP BY pkg),
r AS (SELECT s.*, f.leak, f.obscure, (kind IN ('NET', 'PROCESS', 'ENV') AND hooked) AS r0, (kind IN ('NET', 'ENV') AND leak) AS r1, (kind = 'PROCESS' AND obscure) AS r2, (kind = 'INSTALL_HOOK' AND hooked) AS r3, kind = 'NATIVE' AS r4 FROM s JOIN f USING (pkg))"""


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as gains of their orders, orders as signals."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.expr(_KIND).alias("kind"), F.col("l_returnflag").alias("flag")).distinct()
    hooked = F.col("flag") == "A"
    place = F.when(hooked, "install-script").otherwise("runtime")
    location = F.struct(place.alias("kind"), F.when(hooked, "install").alias("hook"), F.when(hooked, "registry-install").otherwise("git-only").alias("applicability"))
    gains = rows.select("pkg", "kind", F.concat(F.lit("k"), "kind", "flag").alias("slot"), location.alias("location"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pkg"), F.when(F.col("o_orderstatus") == "F", "obfuscation-pattern-added").otherwise("entropy-jump").alias("kind"), F.lit("MEDIUM").alias("severity"), F.lit("d").alias("detail"))
    return findings.judged(gains, orders)


@query(_GRADED + """
SELECT pkg, slot, CASE WHEN r0 OR r1 OR r2 OR r3 OR r4 THEN 'CRITICAL' WHEN kind IN ('NET', 'PROCESS') THEN 'HIGH' WHEN kind IN ('ENV', 'FS_WRITE') THEN 'MEDIUM' WHEN kind = 'DEPENDENCY' THEN 'LOW' ELSE 'INFO' END AS severity FROM r""")
def graded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains with the higher severity of their fallback and of the rules they take part in."""
    return _graded(spark, sf_dir)[0].select("pkg", "slot", "severity")


@query(_GRADED + """
SELECT pkg, 'install-code-execution' AS rule, 1 AS participants, slot AS first FROM r WHERE r0 UNION ALL SELECT pkg, 'install-hook-change', 1, slot FROM r WHERE r3 UNION ALL SELECT pkg, 'dynamic-or-native-code', 1, slot FROM r WHERE r4
UNION ALL SELECT pkg, 'secret-exfiltration', count(*), min(slot) FILTER (kind = 'NET') FROM r WHERE r1 GROUP BY pkg UNION ALL SELECT pkg, 'obfuscated-execution', count(*), min(slot) FROM r WHERE r2 GROUP BY pkg""")
def shape_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that hold, with those that take part; network gains stand before secrets."""
    return _graded(spark, sf_dir)[2].select("pkg", "rule", F.size("participants").cast("long").alias("participants"), F.get("participants", F.lit(0)).alias("first"))


@query(_GRADED + " SELECT o_orderkey AS pkg, CASE WHEN o_orderstatus = 'F' AND o_orderkey IN (SELECT pkg FROM f WHERE obscure) THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM orders")
def raised_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that a rule raises with the code they hide."""
    return _graded(spark, sf_dir)[1].select("pkg", "severity")


@query(_GRADED + " SELECT pkg, slot FROM r WHERE NOT (r0 OR r1 OR r2 OR r3 OR r4)")
def uncovered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no shape stands for already."""
    graded, _, shapes = _graded(spark, sf_dir)
    return findings.uncovered(graded, shapes).select("pkg", "slot")


@query("""
WITH u AS (SELECT o_custkey AS pair, o_orderpriority AS name, max(CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 80 END) AS urgency FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
p AS (SELECT o_custkey AS pair, o_orderkey AS ord, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS bytes, o_orderstatus = 'O' AS fresh FROM orders)
SELECT p.pair, p.ord, coalesce(u.urgency, 0) + CASE WHEN fresh THEN 90 ELSE 0 END AS score, row_number() OVER (PARTITION BY p.pair ORDER BY coalesce(u.urgency, 0) + CASE WHEN fresh THEN 90 ELSE 0 END DESC, bytes ASC NULLS LAST, ord) AS position FROM p LEFT JOIN u ON u.pair = p.pair AND u.name = p.name""")
def preflight_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the first look at packages: pressing lockfile facts and new packages first, then small ones."""
    o = read(spark, sf_dir, "orders")
    packages = o.select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") != "O", "1.0.0").alias("old_version"), F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice").cast("long")).alias("bytes"))
    facts = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("pair"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "integrity-changed-version-same").otherwise("version-downgrade").alias("kind"))
    return findings.preflight_order(packages, facts).select("pair", "ord", "score", F.col("position").cast("long").alias("position"))


@query("SELECT DISTINCT o_custkey AS pkg, o_orderstatus AS stage, o_orderpriority AS detail FROM orders")
def distinct_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are equal in every field once."""
    return findings.distinct_issues(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pkg"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("detail")))


@query("""
SELECT user_id AS pkg, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, 'duplicate semantic slot ' || event_type AS detail FROM events GROUP BY 1, 2, event_type HAVING count(*) > 1
UNION ALL SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END, 'NET has no evidence' FROM events WHERE event_id % 10 = 0
UNION ALL SELECT doc_id // 40, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END, 'invalid signal file observation' FROM documents WHERE 5000 + n_chars * 7 % 2500 + 600 > 8000""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that no capability set may hold: slots twice, no evidence, numbers out of range."""
    place = extraction.evidence(F.lit("f"), F.lit(1), F.lit(""))
    some = F.when(F.col("event_id") % 10 != 0, F.array(place)).otherwise(F.array().cast(extraction.EVIDENCE))
    held = read(spark, sf_dir, "events").select(F.col("user_id").alias("pkg"), F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("side"), F.lit("NET").alias("kind"), F.col("event_type").alias("slot"), some.alias("evidence"))
    files = _files(spark, sf_dir).withColumn("entropy", F.col("entropy") + 600)
    empty = lambda c: spark.createDataFrame([], f"pkg long, side string, {c}, evidence {extraction.EVIDENCE}")
    return findings.violations(held, empty("detail string"), files, empty("value string"), empty("file string, n int"), empty("name string, version string"))


@query("""
SELECT o_custkey AS pkg, count(*) FILTER (o_orderstatus = 'F') AS n_critical, count(*) FILTER (o_orderstatus = 'O') AS n_high, min(CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'O' THEN 'HIGH' ELSE 'MEDIUM' END) AS worst FROM orders GROUP BY 1""")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the gravest severity of each package."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pkg"), choose(F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1, ["CRITICAL", "HIGH", "MEDIUM"]).alias("severity"))
    by = caps.severity_counts(rows, "pkg").select("pkg", "n_critical", "n_high")
    worst = rows.groupBy("pkg").agg(caps.severity_of(F.min(caps.rank(F.col("severity")))).alias("worst"))
    return by.join(worst, "pkg")


@query("SELECT doc_id, line, snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS snippet, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL) WHERE contains(snippet, '@')")
def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole texts that hold a sign, with their numbers."""
    rows = signals.lines(read(spark, sf_dir, "documents").where("text is not null"), ["doc_id"], "text")
    return rows.where(F.col("line_text").contains("@")).select("doc_id", "line", F.col("line_text").alias("snippet"))


@query("""
WITH p AS (SELECT p_partkey // 13 AS pair, count(*) AS n, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 > 0) AS runtime FROM part GROUP BY 1)
SELECT pair, pair % 12 AS direct, runtime, pair % 12 >= 10 AS exceeded FROM p""")
def dependency_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct dependencies and installed runtime packages of lockfiles."""
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "src/p").otherwise("node_modules/p")
    rows = read(spark, sf_dir, "part").select(F.floor(k / PER_FILE).alias("pair"), F.concat(F.lit('"'), folder, k.cast("string"), F.when(k % 3 == 0, '":{"dev":true}').otherwise('":{}')).alias("entry"))
    names = F.transform(F.sequence(F.lit(0), (F.col("pair") % 12).cast("int")), lambda i: F.concat(F.lit('"d'), i.cast("string"), F.lit('":"1"')))
    root = F.concat(F.lit('{"packages":{"":{"dependencies":{'), F.array_join(F.slice(names, 1, (F.col("pair") % 12).cast("int")), ","), F.lit("}},"))
    files = rows.groupBy("pair").agg(F.array_join(F.sort_array(F.collect_list("entry")), ",").alias("entries"))
    return lockfile.dependency_budget(files.select("pair", F.lit("new").alias("side"), F.concat(root, "entries", F.lit("}}")).alias("content"))).drop("side")


@query("""
SELECT count(*) AS bumps, count(*) FILTER (o_orderstatus <> 'P') AS analyzed, count(*) FILTER (o_orderstatus = 'P') AS unavailable, count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 4 > 0) AS with_findings,
CAST(coalesce(sum(o_orderkey % 4) FILTER (o_orderstatus <> 'P'), 0) AS BIGINT) AS findings, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (o_orderstatus <> 'P'), 0) AS BIGINT) AS diagnostics FROM orders""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over a corpus of version bumps."""
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "unavailable").otherwise("analyzed").alias("status"), (F.col("o_orderkey") % 4).alias("findings"), F.floor("o_totalprice").cast("long").alias("diagnostics"))
    return caps.corpus_totals(rows)
