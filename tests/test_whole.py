"""The queries see the whole of their inputs."""

from datetime import datetime

import pytest
from compare import same
from pyspark.sql import functions as F

from lockgrain.plans import catalog, catalog_files

assert catalog_files.SCRIPTS


def run(spark, tmp_path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return catalog.QUERIES[name](spark, str(tmp_path)).collect()


def test_whole_vectors(spark, tmp_path):
    rows = [(1, [0.2] * 64), (2, [0.2] * 16 + [0.9] * 48), (3, [0.2] * 63 + [0.5])]
    got = run(spark, tmp_path, "obfuscation_arrays", embeddings=(rows, "vec_id long, embedding array<float>"))
    assert [(r.vec_id, r.n) for r in got] == [(1, 64)]


def test_whole_text_is_escaped(spark, tmp_path):
    rows = [(1, "a" * 3000 + "<b>​\r\n😀*"), (2, ""), (3, None)]
    got = {r.doc_id: r.escaped for r in run(spark, tmp_path, "truncate_text", documents=(rows, "doc_id long, text string"))}
    assert got == {1: "a" * 3000 + "&#60;b&#62;&#92;u200b&#92;u000d&#92;u000a😀&#42;", 2: "", 3: None}


def test_all_old_events_count(spark, tmp_path):
    old, new = datetime(2024, 1, 2), datetime(2024, 1, 20)
    rows = [(1, 1, "view", old, 5.0), (2, 1, "view", new, 5.0), (3, 2, "view", old, 7.0), (4, 2, "view", old, 8.0), (5, 2, "view", new, 9.0), (6, 3, "view", new, 1.0)]
    got = run(spark, tmp_path, "slot_diff", events=(rows, "event_id long, user_id long, event_type string, ts timestamp, value double"))
    assert sorted((r.user_id, r.v, r.previous, r.change) for r in got) == [(2, 9, 8, "changed"), (3, 1, None, "added")]


def test_all_documents_and_labels_join(spark, tmp_path):
    docs = [(1, "src0", "en", 100), (2, "src0", "en", 900), (3, "src1", "de", 900)]
    got = run(spark, tmp_path, "suppression", documents=(docs, "doc_id long, source string, lang string, n_chars long"), labels=([(1, 0), (3, 1)], "doc_id long, quality int"))
    assert sorted((r.doc_id, r.suppression or "") for r in got) == [(1, "reviewed, quality 0"), (2, ""), (3, "reviewed, quality 1")]


def test_all_parts_are_links(spark, tmp_path):
    rows = [(1, "A", 50), (2, "A", 3), (3, "B", 40)]
    got = run(spark, tmp_path, "cross_links", part=(rows, "p_partkey long, p_brand string, p_size int"))
    assert sorted((r.id, r.links) for r in got) == [(1, "1,2"), (2, "1,2"), (3, "3")]


def test_hook_files_and_raised_severities(spark):
    from lockgrain.operators import capabilities as caps

    hooks = [("p", "preinstall", "node ./a.js"), ("p", "postinstall", "node --no-warnings 'a.js' && echo"), ("p", "install", "node $X.js"), ("q", "install", "sh b.js; node b.js")]
    found = [("p", "a.js", "PROCESS"), ("p", "b.js", "FS_READ"), ("q", "b.js", "ENV"), ("r", "c.js", "ENV"), ("r", "c.js", "NET"), ("s", "d.js", "PROCESS"), ("s", "d.js", "OBFUSCATION")]
    rows = caps.attributed(spark.createDataFrame(found, "pkg string, file string, kind string"), spark.createDataFrame(hooks, "pkg string, hook string, command string")).selectExpr("*", "'registry-install' as applicability")
    got = sorted((r.pkg, r.kind, r.location, r.hook or "", r.severity) for r in caps.classified(rows).collect())
    assert got == [
        ("p", "FS_READ", "runtime", "", "LOW"),
        ("p", "PROCESS", "install-script", "postinstall", "CRITICAL"),
        ("p", "PROCESS", "install-script", "preinstall", "CRITICAL"),
        ("q", "ENV", "runtime", "", "MEDIUM"),
        ("r", "ENV", "runtime", "", "CRITICAL"),
        ("r", "NET", "runtime", "", "CRITICAL"),
        ("s", "PROCESS", "runtime", "", "CRITICAL"),
    ]
    assert ("p", "install-code-execution", 1) in [tuple(r) for r in caps.shapes(rows).collect()]


def test_links_of_one_package_are_dealt_over_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(k, "AB"[k % 2], 1) for k in range(2000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["cross_links"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    by = [(r.task, r.target) for r in got.select("task", "target").distinct().collect()]
    assert len({t for t, _ in by}) >= 8 and len(by) <= len({t for t, _ in by}) + 1  # tasks share a target, and hold few


def _documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    made = next(tmp_path.glob("made/*.parquet"))
    (tmp_path / "in").mkdir()
    made.rename(tmp_path / "in" / "documents.parquet")
    return str(tmp_path / "in")


@pytest.mark.parametrize("name", ["entropy", "entropy_jump"])
@pytest.mark.parametrize("again", [[], [(1, "xyz" * 90), (4, "äöü" * 99), (None, "n"), (None, "m")]], ids=["keys once", "keys again"])
def test_entropy_of_odd_rows_equals_sql(spark, tmp_path, name, again):
    varied = "".join(map(chr, range(32, 127))) * 4
    rows = [(1, "a" * 300), (2, varied), (3, ""), (4, varied), (5, None), (6, varied), (7, "é"), (8, varied[:300]), (9, "aabcdefghijklmnopqrstuvwxyz01234")]
    folder = _documents(spark, tmp_path, rows + again)
    same(catalog.QUERIES[name](spark, folder), catalog.ORACLE_SQL[name], folder)


def test_entropy_hands_few_bytes_to_a_worker(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(1 << 30))
    catalog.QUERIES["entropy"](spark, _documents(spark, tmp_path, [(1, "a")])).collect()
    assert int(spark.conf.get(key)) <= 8 << 20


@pytest.mark.parametrize("name", ["script_facts", "source_states"])
def test_scripts_are_read_by_all_cores(spark, tmp_path, name):
    spark.range(400).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= 8


def test_equal_files_are_read_once_by_a_worker(monkeypatch):
    from lockgrain.operators import extraction

    read, scan = [], extraction.jsscan.scan
    monkeypatch.setattr(extraction.jsscan, "scan", lambda *a: read.append(a[:2]) or scan(*a))
    facts = lambda artifact, file, data, bound=2 << 20: extraction._source_facts(artifact, file, data, bound, 60.0, None)
    one, two = facts("p", "x.js", b"eval('1'); // once"), facts("q", "x.js", b"eval('1'); // once")
    assert [f | {"artifact": "q"} for f in one] == two and {f["artifact"] for f in one} == {"p"} and len(read) == 1
    assert facts("p", "y.js", b"eval('1'); // once")[0]["file"] == "y.js" and facts("p", "x.js", b"eval('1'); // once", 3)[0]["fact"] == "diagnostic"
    large = b"eval('1');" + b" " * extraction.REMEMBERED_BYTES
    assert facts("p", "x.js", large) == facts("p", "x.js", large) and len(read) == 5
    for k in range(extraction.REMEMBERED + 9):
        facts("p", f"{k}.js", b"1")
    assert len(extraction._remembered) == extraction.REMEMBERED


def test_lockfile_entries_are_dealt_over_all_cores(spark):
    rows = spark.range(100, numPartitions=1)
    assert catalog.dealt(rows, "id").rdd.getNumPartitions() == catalog.CORE_TASKS * spark.sparkContext.defaultParallelism
    made = catalog.QUERIES["lockfile_diff"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().sparkPlan().toString() or "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()
