"""Queries over the driver's tables, one for each operator, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockgrain.functions import semver, text
from lockgrain.operators import capabilities as caps
from lockgrain.operators import lockfile, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Snapshots are cut at this time.
CUT = "1997-01-01"
#: Events are cut at this time: both added and changed slots remain.
EVENT_CUT = "2024-01-04"
#: Kinds that stand for event types, in the order of their sorted names.
KIND_SQL = "CASE event_type WHEN 'purchase' THEN 'NET' WHEN 'login' THEN 'ENV' WHEN 'logout' THEN 'OBFUSCATION' WHEN 'click' THEN 'INSTALL_HOOK' WHEN 'view' THEN 'PROCESS' ELSE 'DYNAMIC_CODE' END"
SEVERITY_SQL = "CASE kind WHEN 'INSTALL_HOOK' THEN 'CRITICAL' WHEN 'DYNAMIC_CODE' THEN 'CRITICAL' WHEN 'NET' THEN 'HIGH' WHEN 'PROCESS' THEN 'HIGH' WHEN 'ENV' THEN 'MEDIUM' ELSE 'MEDIUM' END"


def query(sql: str | None):
    """Register a query with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core over which the rows of a small file are dealt before costly work.
CORE_TASKS = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores: a table of many short rows is one or two tasks as it is read."""
    return rows.repartition(CORE_TASKS * rows.sparkSession.sparkContext.defaultParallelism, *keys)


@query(f"""
WITH old AS (SELECT o_custkey, arg_max(struct_pack(k := o_orderkey, s := o_orderstatus, p := o_orderpriority), (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1),
new AS (SELECT o_custkey, arg_max(struct_pack(k := o_orderkey, s := o_orderstatus, p := o_orderpriority), (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1)
SELECT n.o_custkey AS custkey, o.v.k AS old_key, n.v.k AS new_key, n.v.s AS new_status, n.v.p AS new_priority, CASE WHEN o.v IS NULL THEN 'added' ELSE 'changed' END AS change
FROM new n LEFT JOIN old o USING (o_custkey) WHERE o.v IS DISTINCT FROM n.v""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed, additions-only difference of two snapshots (latest order of each customer)."""
    orders = read(spark, sf_dir, "orders")
    latest = lambda d: d.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max_by(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")), F.struct("o_orderdate", "o_orderkey")).alias("v"))
    found = caps.gains(latest(orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))), latest(orders), ["custkey"], "v")
    return found.select("custkey", F.col("previous.k").alias("old_key"), F.col("v.k").alias("new_key"), F.col("v.s").alias("new_status"), F.col("v.p").alias("new_priority"), "change")


@query(f"""
WITH p AS (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_shipdate < TIMESTAMP '{CUT}' AS was FROM lineitem),
o AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_returnflag FROM p WHERE was),
b AS (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS s FROM o GROUP BY 1)
SELECT p.l_partkey AS partkey, p.l_orderkey AS orderkey, p.l_linenumber AS linenumber, p.l_suppkey AS suppkey, CASE WHEN b.n = 1 THEN b.s END AS old_suppkey
FROM p LEFT JOIN b USING (l_partkey)
WHERE NOT was AND NOT EXISTS (SELECT 1 FROM o WHERE o.l_partkey = p.l_partkey AND o.l_suppkey = p.l_suppkey AND o.l_quantity = p.l_quantity AND o.l_returnflag = p.l_returnflag)""")
def moved_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved-artifact matching: an identical old artifact drops the position, a single distinct one is the baseline."""
    p = read(spark, sf_dir, "lineitem").select(F.lit(1).alias("pair"), F.col("l_partkey").alias("name"), "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("version"), F.col("l_quantity").alias("integrity"), F.col("l_returnflag").alias("resolved"), (F.col("l_shipdate") < F.lit(CUT).cast("timestamp")).alias("was"), F.lit(False).alias("link")).distinct()
    found = lockfile.match_moved(p.where("not was").drop("was"), p.where("was").drop("was", "l_orderkey", "l_linenumber").distinct())
    return found.select(F.col("name").alias("partkey"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("version").alias("suppkey"), F.col("old_version").alias("old_suppkey"))


@query("""
SELECT l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag AS returnflag, l_linestatus AS linestatus, CASE WHEN l_tax > 0.04 THEN l_linenumber END AS linenumber, min(l_orderkey) AS ord
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6""")
def change_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct full tuples, nulls equal, first occurrence's order."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.when(F.col("l_tax") > 0.04, F.col("l_linenumber")).alias("linenumber"), F.col("l_orderkey").alias("ord"))
    return lockfile.dedup_changes(rows)


@query("""
WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 20 AS b, p_partkey % 7 AS c, p_partkey % 3 AS pre, p_partkey % 13 AS n, (p_size + 1) % 51 AS a2, p_partkey % 19 AS b2 FROM part)
SELECT p_partkey AS partkey, CAST(CASE WHEN (a, b, c) < (a2, b2, 3) THEN -1 WHEN (a, b, c) > (a2, b2, 3) THEN 1 WHEN pre = 0 THEN CASE WHEN n = 5 THEN 0 WHEN n < 5 THEN -1 ELSE 1 END WHEN pre = 1 THEN 1 ELSE -1 END AS INTEGER) AS cmp FROM v""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic-version comparison: numbers, releases above pre-releases, numeric below textual identifiers."""
    k = F.col("p_partkey")
    s = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    pre = F.when(k % 3 == 0, s("-alpha.", (k % 13).cast("string"))).when(k % 3 == 1, F.lit("+build.7")).otherwise(F.lit("-1.x"))
    a = s(F.col("p_size").cast("string"), ".", (k % 20).cast("string"), ".", (k % 7).cast("string"), pre)
    b = s(((F.col("p_size") + 1) % 51).cast("string"), ".", (k % 19).cast("string"), ".3-alpha.5")
    return read(spark, sf_dir, "part").select(k.alias("partkey"), semver.compare(a, b).cast("int").alias("cmp"))


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(f"""
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'unanalyzable-source' WHEN page_id % 13 = 0 THEN 'malformed-entry' WHEN {_HOST_SQL} = '' THEN 'malformed-entry' WHEN {_HOST_SQL} <> 'registry.npmjs.org' THEN 'private-registry' END AS reason, {_HOST_SQL} AS host FROM pages""")
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered classification rules of an installed position."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("resolved"), (F.col("page_id") % 11 == 0).alias("link"), F.when(F.col("page_id") % 13 != 0, "1.0.0").alias("version"), F.lit("sha512-x").alias("integrity"))
    return rows.select("page_id", lockfile.classify()[0].alias("reason"), text.url_host(F.col("resolved")).alias("host"))


@query("""
WITH p AS (SELECT page_id, url, replace(url, '/en/', '/node_modules/@en/') AS path FROM pages)
SELECT page_id, list_last(string_split(path, 'node_modules/')) AS name, list_last(string_split(url, '/')) AS unscoped FROM p WHERE contains(path, 'node_modules/')""")
def path_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package names from installed paths, and names without their scope; other paths are left out."""
    path = F.replace(F.col("url"), F.lit("/en/"), F.lit("/node_modules/@en/"))
    return read(spark, sf_dir, "pages").where(text.is_dependency_path(path)).select("page_id", text.name_from_path(path).alias("name"), text.unscoped(F.col("url")).alias("unscoped"))


@query("""
SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' ELSE 'other' END AS kind, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, json_type(props, '$.missing') IS NULL AS absent FROM events""")
def json_field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reading of fields of parsed JSON: kind of the whole, a number, and absence."""
    v = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("other")
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.try_variant_get(v, "$.k", "bigint"))
    return read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), number.alias("k"), F.try_variant_get(v, "$.missing", "variant").isNull().alias("absent"))


_ENDPOINTS = r"""
WITH line AS (SELECT page_id, unnest(string_split(url || chr(10) || html, chr(10))) AS t, generate_subscripts(string_split(url || chr(10) || html, chr(10)), 1) AS line FROM pages),
raw AS (SELECT page_id, line, unnest(regexp_extract_all(t, '\b(?:https?|wss?)://[^\s"''`<>\\]+')) AS u FROM line),
host AS (SELECT page_id, line, rtrim(regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)), '^.*@|:[0-9]+$', ''), '.') AS value FROM raw),
four AS (SELECT page_id, line, unnest(regexp_extract_all(t, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) AS value FROM line),
q AS (SELECT *, list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER)) AS q FROM four),
every AS (SELECT page_id, line, 'domain' AS endpoint_type, value FROM host WHERE value <> '' AND value <> 'localhost' AND value NOT LIKE '%.localhost'
UNION ALL SELECT page_id, line, 'ipv4', value FROM q WHERE list_max(q) <= 255 AND NOT regexp_matches(value, '(^|\.)0[0-9]') AND NOT (q[1] IN (0, 10, 127) OR (q[1] = 100 AND q[2] BETWEEN 64 AND 127) OR (q[1] = 169 AND q[2] = 254) OR (q[1] = 172 AND q[2] BETWEEN 16 AND 31) OR (q[1] = 192 AND q[2] = 168) OR (q[1] = 198 AND q[2] IN (18, 19)) OR q[1] >= 224)),
found AS (SELECT page_id, endpoint_type, value, CAST(min(line) AS INTEGER) AS first_line, count(DISTINCT line) AS n_lines FROM every GROUP BY 1, 2, 3)"""


@query(_ENDPOINTS + " SELECT * FROM found")
def endpoint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External addresses in whole pages with their first line, once each."""
    files = read(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", "url", "html").alias("content"))
    return signals.endpoints(files, ["page_id"])


@query(_ENDPOINTS + r""", side AS (SELECT page_id % 20 AS pkg, page_id % 2 AS s, endpoint_type, value FROM found GROUP BY ALL)
SELECT pkg, endpoint_type, value FROM side n WHERE s = 1 AND NOT EXISTS (SELECT 1 FROM side o WHERE o.s = 0 AND o.pkg = n.pkg - 1 AND o.value = n.value)""")
def new_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that only the new side has (odd pages against the even ones before them)."""
    files = read(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", "url", "html").alias("content"))
    found = signals.endpoints(files, ["page_id"])
    side = lambda s, shift: found.where(F.col("page_id") % 2 == s).select((F.col("page_id") % 20 + shift).alias("pkg"), "endpoint_type", "value").distinct()
    return signals.new_endpoints(side(0, 1), side(1, 0), ["pkg"])


@query(r"""
WITH hit AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) AS value FROM documents), o AS (SELECT doc_id, value, list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER)) AS q FROM hit)
SELECT doc_id, value, count(*) AS n FROM o WHERE list_max(q) <= 255 AND NOT regexp_matches(value, '(^|\.)0[0-9]')
AND NOT (q[1] IN (0, 10, 127) OR (q[1] = 100 AND q[2] BETWEEN 64 AND 127) OR (q[1] = 169 AND q[2] = 254) OR (q[1] = 172 AND q[2] BETWEEN 16 AND 31) OR (q[1] = 192 AND q[2] = 168) OR (q[1] = 198 AND q[2] IN (18, 19)) OR q[1] >= 224) GROUP BY 1, 2""")
def external_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid IPv4 literals outside private and reserved ranges."""
    hit = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(signals.IPV4), 0)).alias("value"))
    return hit.where(text.valid_ipv4(F.col("value")) & text.external_ipv4(F.col("value"))).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


_ENTROPY = """
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), n AS (SELECT doc_id, b, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS t FROM n),
h AS (SELECT doc_id, CAST(max(t) AS BIGINT) AS bytes, CAST(round(sum(-n / t * log2(n / t)) * 1000) AS INTEGER) AS entropy FROM t GROUP BY 1)"""


@query(_ENTROPY + " SELECT * FROM h")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte entropy of whole documents in thousandths of a bit."""
    return signals.text_entropy(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(_ENTROPY + """
SELECT n.doc_id, n.bytes, n.entropy, o.entropy AS entropy_before FROM h n JOIN h o ON o.doc_id = n.doc_id - 1
WHERE n.bytes >= 256 AND n.entropy >= 4000 AND n.entropy - o.entropy >= 150""")
def entropy_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose entropy rose against their previous version (here the document before)."""
    h = entropy(spark, sf_dir)
    return signals.entropy_jumps(h.withColumn("doc_id", F.col("doc_id") + 1), h, ["doc_id"], 256, 4000, 150)


@query("""
WITH f AS (SELECT doc_id % 50 AS pkg, doc_id % 2 AS s, CASE WHEN doc_id % 3 = 0 THEN 'parsed' ELSE 'unparseable' END AS state, n_chars FROM documents),
t AS (SELECT pkg, CAST(coalesce(sum(CASE WHEN s = 1 AND state <> 'parsed' THEN n_chars END), 0) AS BIGINT) AS now, CAST(coalesce(sum(CASE WHEN s = 0 AND state <> 'parsed' THEN n_chars END), 0) AS BIGINT) AS before, count(*) FILTER (s = 0) AS olds, count(*) FILTER (s = 1) AS news FROM (SELECT pkg // 2 AS pkg, s, state, n_chars FROM f) GROUP BY 1)
SELECT pkg, now, before FROM t WHERE olds > 0 AND news > 0 AND now > before""")
def unparseable_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the bytes that no parser read, by package."""
    f = read(spark, sf_dir, "documents").select(F.floor((F.col("doc_id") % 50) / 2).cast("long").alias("pkg"), (F.col("doc_id") % 2).alias("s"), F.when(F.col("doc_id") % 3 == 0, "parsed").otherwise("unparseable").alias("state"), F.col("n_chars").alias("bytes"))
    return signals.unparseable_growth(f.where("s = 0"), f.where("s = 1"), "pkg")


_PATTERNS = """
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 800) AS BIGINT)) AS q FROM embeddings), f AS (SELECT vec_id, q, len(q) AS n FROM a WHERE list_max(q) <= 255 AND len(q) >= 8)"""


@query(_PATTERNS + " SELECT vec_id, 'charcode-array' AS pattern, CAST(n AS INTEGER) AS n FROM f")
def obfuscation_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long arrays of byte values in rendered text."""
    return _arrays(spark, sf_dir)


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 800).cast("string"))
    rendered = F.concat(F.lit("var data = ["), F.array_join(values, ", "), F.lit("];"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.explode(signals.numeric_arrays(rendered)).alias("a")).select("vec_id", "a.pattern", "a.n")


@query(_PATTERNS + """, g AS (SELECT vec_id % 40 AS file, vec_id % 2 AS s, n FROM f), t AS (SELECT file // 2 AS file, s, CAST(count(*) AS INTEGER) AS n FROM g GROUP BY 1, 2)
SELECT n.file, 'charcode-array' AS pattern, n.n, o.n AS n_before, CASE WHEN o.n IS NULL THEN 'added' ELSE 'changed' END AS change FROM t n LEFT JOIN t o ON o.file = n.file AND o.s = 0 WHERE n.s = 1 AND (o.n IS NULL OR o.n < n.n)""")
def pattern_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a file that are new or grew."""
    t = _arrays(spark, sf_dir).groupBy(F.floor((F.col("vec_id") % 40) / 2).cast("long").alias("file"), (F.col("vec_id") % 2).alias("s"), "pattern").agg(F.count("*").cast("int").alias("n"))
    return signals.grown_patterns(t.where("s = 0"), t.where("s = 1").drop("s"), ["file"])


_GAINS = f"""
WITH e AS (SELECT user_id, event_type, {KIND_SQL} AS kind, ts < TIMESTAMP '{EVENT_CUT}' AS was, CAST(floor(value) AS BIGINT) AS v, event_id FROM events),
o AS (SELECT user_id, kind, arg_max(v, event_id) AS v FROM e WHERE was GROUP BY 1, 2), n AS (SELECT user_id, kind, arg_max(v, event_id) AS v FROM e WHERE NOT was GROUP BY 1, 2),
g AS (SELECT n.user_id, n.kind, n.v, o.v AS previous, CASE WHEN o.user_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM n LEFT JOIN o ON o.user_id = n.user_id AND o.kind = n.kind WHERE o.user_id IS NULL OR o.v IS DISTINCT FROM n.v),
s AS (SELECT *, {SEVERITY_SQL} AS severity FROM g)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.expr(KIND_SQL).alias("kind"), (F.col("ts") < F.lit(EVENT_CUT).cast("timestamp")).alias("was"), F.floor("value").cast("long").alias("v"), "event_id")
    last = lambda d: d.groupBy("user_id", "kind").agg(F.max_by("v", "event_id").alias("v"))
    found = caps.gains(last(e.where("was")), last(e.where("not was")), ["user_id", "kind"], "v")
    severity = F.when(F.col("kind") == "OBFUSCATION", "MEDIUM").otherwise(caps.fallback(F.col("kind"), F.lit("registry-install")))
    return found.withColumn("severity", severity)


@query(_GAINS + " SELECT user_id, kind, v, previous, change, severity FROM s")
def slot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capability slots that were added or changed, with their fallback severity."""
    return _gains(spark, sf_dir)


@query(_GAINS + """, f AS (SELECT user_id AS pkg, bool_or(kind = 'NET') AND bool_or(kind = 'ENV') AS exfil, bool_or(kind = 'OBFUSCATION') AND bool_or(kind IN ('PROCESS', 'DYNAMIC_CODE')) AS obf, count(*) FILTER (kind IN ('NET', 'ENV')) AS ne, count(*) FILTER (kind IN ('OBFUSCATION', 'PROCESS', 'DYNAMIC_CODE')) AS no FROM s GROUP BY 1)
SELECT user_id AS pkg, 'install-code-execution' AS rule, 1 AS participants FROM s WHERE kind IN ('NET', 'PROCESS', 'ENV') AND v % 2 = 0
UNION ALL SELECT pkg, 'secret-exfiltration', ne FROM f WHERE exfil UNION ALL SELECT pkg, 'obfuscated-execution', no FROM f WHERE obf
UNION ALL SELECT user_id, 'install-hook-change', 1 FROM s WHERE kind = 'INSTALL_HOOK' AND v % 3 > 0 UNION ALL SELECT user_id, 'dynamic-or-native-code', 1 FROM s WHERE kind = 'DYNAMIC_CODE'""")
def shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combination rules over a package's gains."""
    g = _gains(spark, sf_dir).select(F.col("user_id").alias("pkg"), "kind", F.when(F.col("v") % 2 == 0, "install-script").otherwise("runtime").alias("location"), F.when(F.col("v") % 3 > 0, "registry-install").otherwise("git-only").alias("applicability"))
    return caps.shapes(g)


_COUNT_SQL = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in caps.SEVERITIES)


@query(_GAINS + f" SELECT user_id, {_COUNT_SQL} FROM s GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each severity by package."""
    return caps.severity_counts(_gains(spark, sf_dir), "user_id")


@query(_GAINS + f" SELECT count(DISTINCT user_id) AS packages, count(*) AS findings, {_COUNT_SQL} FROM s")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run over its packages' counts."""
    by = severity_counts(spark, sf_dir)
    names = [f"n_{s.lower()}" for s in caps.SEVERITIES]
    every = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return by.agg(F.count("*").alias("packages"), F.sum(every).alias("findings"), *[F.sum(n).alias(n) for n in names])


_WEIGHED = _GAINS + ", w AS (SELECT severity, CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 END AS weight FROM s UNION ALL SELECT CASE WHEN quality = 0 THEN 'HIGH' ELSE 'INFO' END, 1 FROM labels)"


@query(_WEIGHED + """ SELECT CAST(coalesce(sum(weight) FILTER (severity IN ('CRITICAL', 'HIGH')), 0) AS BIGINT) AS matches,
CASE WHEN sum(weight) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN sum(weight) FILTER (severity = 'HIGH') > 0 THEN 'HIGH' WHEN sum(weight) FILTER (severity = 'MEDIUM') > 0 THEN 'MEDIUM' ELSE 'INFO' END AS highest,
coalesce(sum(weight) FILTER (severity IN ('CRITICAL', 'HIGH')), 0) > 0 AS failed FROM w""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive count down to a threshold; suppressed findings weigh nothing, lockfile facts count as well."""
    w = _gains(spark, sf_dir).select("severity", F.when(F.col("user_id") % 7 == 0, 0).otherwise(1).alias("weight"))
    facts = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "HIGH").otherwise("INFO").alias("severity"), F.lit(1).alias("weight"))
    return caps.gate(w.union(facts), "HIGH")


@query("""
WITH a AS (SELECT doc_id, min('reviewed, quality ' || quality) AS j FROM labels GROUP BY 1)
SELECT d.doc_id, d.source, a.j AS suppression FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowances (all labels) attach a justification to findings (all documents) and remove none."""
    allow = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("reviewed, quality "), F.col("quality").cast("string")).alias("justification"))
    return caps.suppress(read(spark, sf_dir, "documents").select("doc_id", "source"), allow, ["doc_id"]).select("doc_id", "source", "suppression")


@query("""
WITH r AS (SELECT p_brand AS target, list_sort(list(CAST(p_partkey AS VARCHAR))) AS l FROM part GROUP BY 1)
SELECT p.p_partkey AS id, p.p_brand AS target, coalesce(array_to_string(r.l, ','), '') AS links FROM part p LEFT JOIN r ON r.target = p.p_brand""")
def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency findings with the sorted ids of the reports about their target."""
    part = read(spark, sf_dir, "part")
    found = caps.cross_links(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("target")), part.select(F.col("p_brand").alias("package"), F.col("p_partkey").cast("string").alias("report_id")), ",")
    return found.select("id", "target", "links")


@query(_GAINS + """ SELECT user_id, kind, severity FROM s ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, user_id, kind LIMIT 10""")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten gravest findings in their total order (a top-k report)."""
    return _gains(spark, sf_dir).select("user_id", "kind", "severity").orderBy(caps.rank(F.col("severity")), "user_id", "kind").limit(10)


@query("""
SELECT o_custkey AS lane, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS position FROM orders""")
def schedule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of work in each lane: hooks first, then small ones."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lane"), F.col("o_orderkey").alias("orderkey"), (F.col("o_orderstatus") == "F").alias("hook"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return caps.scheduled(rows, "hook", "bytes", "orderkey").select("lane", "orderkey", "position")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders), p AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old FROM r WHERE rn <= 4)
SELECT o_custkey AS custkey, old AS old_key, o_orderkey AS new_key FROM p WHERE old IS NOT NULL""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the last three versions with the one before it."""
    w = Window.partitionBy("custkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("new_key"))
    last = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("new_key")))).where("rn <= 4")
    return last.withColumn("old_key", F.lag("new_key").over(w.orderBy("new_key"))).where("old_key is not null").select("custkey", "old_key", "new_key")


@query("""
SELECT 'old' AS side, source AS file, lang AS detail FROM documents GROUP BY ALL UNION ALL SELECT 'new', split_part(url, '/', 3), split_part(url, '/', 4) FROM pages GROUP BY ALL""")
def diagnostics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of both sides, tagged, equal ones once."""
    old = read(spark, sf_dir, "documents").select(F.lit("old").alias("side"), F.col("source").alias("file"), F.col("lang").alias("detail"))
    part = F.split("url", "/")
    new = read(spark, sf_dir, "pages").select(F.lit("new").alias("side"), part[2].alias("file"), F.coalesce(F.get(part, 3), F.lit("")).alias("detail"))
    return old.unionByName(new).dropDuplicates()


@query("""
SELECT c_custkey AS custkey, 'report-' || substr(sha256('npm' || chr(0) || c_name || chr(0) || CAST(c_nationkey AS VARCHAR)), 1, 20) AS report_id, sha256(c_mktsegment) AS digest FROM customer""")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable report ids and content digests."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), text.report_id(F.lit("npm"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("report_id"), text.digest(F.col("c_mktsegment")).alias("digest"))


@query(r"""
SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END AS snippet, CASE WHEN text = '' THEN '' ELSE list_aggregate(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE
WHEN regexp_matches(c, '^[\x00-\x1F\x7F-\x{9F}\x{200B}-\x{200D}\x{2060}\x{202A}-\x{202E}\x{2066}-\x{2069}]$') THEN '&#92;u' || lower(lpad(hex(unicode(c)), 4, '0'))
WHEN regexp_matches(c, '^[!-/:-@\[-`{-~]$') THEN '&#' || unicode(c) || ';' ELSE c END), 'string_agg', '') END AS escaped FROM documents""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets cut at a number of code points, and the whole text made inert for Markdown."""
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 240).alias("snippet"), text.escape_markdown(F.col("text")).alias("escaped"))


@query("""
WITH p AS (SELECT page_id, lower(replace(url, '/en/', '/.SSH/')) || CASE WHEN page_id % 9 = 0 THEN '/.env.local' WHEN page_id % 9 = 1 THEN '/.env.sample' ELSE '' END AS path FROM pages)
SELECT page_id, len(list_filter(string_split(path, '/'), lambda s: s IN ('.ssh', '.npmrc', '.env') OR (s LIKE '.env.%' AND s <> '.env.sample'))) > 0 AS sensitive FROM p""")
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that name credentials."""
    k = F.col("page_id") % 9
    path = F.concat(F.replace(F.col("url"), F.lit("/en/"), F.lit("\\.SSH/")), F.when(k == 0, "/.env.local").when(k == 1, "/.env.sample").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", text.sensitive_path(path).alias("sensitive"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), h AS (SELECT doc_id, CASE WHEN contains(t, '@') THEN 'NET' ELSE 'ENV' END AS kind, line FROM l WHERE contains(t, '@') OR contains(t, 'password'))
SELECT doc_id, kind, count(DISTINCT line) AS n, CAST(min(line) AS INTEGER) AS first_line FROM h GROUP BY 1, 2""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections grouped by kind with their distinct evidence lines."""
    rows = signals.lines(read(spark, sf_dir, "documents").where("text is not null"), ["doc_id"], "text")
    at = F.col("line_text").contains("@")
    hit = rows.where(at | F.col("line_text").contains("password")).select("doc_id", F.when(at, "NET").otherwise("ENV").alias("kind"), "line")
    return hit.groupBy("doc_id", "kind").agg(F.countDistinct("line").alias("n"), F.min("line").alias("first_line"))


@query("SELECT EXISTS (SELECT 1 FROM documents WHERE n_chars < 10) OR EXISTS (SELECT 1 FROM labels WHERE toxic = 1) OR EXISTS (SELECT 1 FROM pages WHERE url IS NULL) AS unanalyzed")
def strict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether anything stayed unanalysed in any of several tables."""
    parts = [read(spark, sf_dir, "documents").agg(F.max(F.col("n_chars") < 10).alias("x")), read(spark, sf_dir, "labels").agg(F.max(F.col("toxic") == 1).alias("x")), read(spark, sf_dir, "pages").agg(F.max(F.col("url").isNull()).alias("x"))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.coalesce(F.max("x"), F.lit(False)).alias("unanalyzed"))


@query("""
SELECT count(*) AS bumps, count(*) FILTER (o_orderstatus = 'F') AS with_findings, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS size, count(DISTINCT o_custkey) AS packages, count(*) FILTER (o_orderpriority LIKE '1%') AS direct FROM orders""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over a corpus of version bumps, and conditional counts of direct dependencies."""
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("bumps"), F.count_if(F.col("o_orderstatus") == "F").alias("with_findings"), F.sum(F.floor("o_totalprice").cast("long")).alias("size"), F.countDistinct("o_custkey").alias("packages"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("direct"))
