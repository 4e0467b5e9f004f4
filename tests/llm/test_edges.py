"""Empty tables, nulls, repeated rows, ties, very long texts and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from lockgrain.llm import bpe, fertility, langid, line_dedup, minhash, packing, pii, pivot_join, queries, toxicity, url_filter

LONG = "many words of one very long text " * 20_000
ROWS = [(1, None, None), (2, "", "en"), (3, " \n\t\r", "xx"), (4, LONG, "en"), (4, LONG, "en"), (5, "one", "en"), (None, "null id with some words", "de"), (6, "tie", "en"), (7, "tie", "en"), (8, "a\0b 日本 \U0001f600 é", "de")]
#: Columns that the operators use themselves, or give out.
CLASH = ["kept", "n_words", "token_ids", "severity", "toxic", "score", "lang_pred", "spans", "base_spans", "n_lines", "n_dropped", "_id", "_text", "_gone", "_hash", "_h", "id", "key", "size", "h", "digest", "component", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def models(spark):
    base = spark.createDataFrame([(i, f"good words {i} " * 3 if i % 2 else f"vile words {i} " * 3, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    labels = base.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("grade"))
    return toxicity.fit(base, labels), langid.fit(base)


def each(models):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    return {
        "quality": lambda d: fertility.measure(d, queries.vocabulary("piece_bpe_32k.model")),
        "bpe": lambda d: bpe.decode(bpe.encode(d, path, queries.pattern()), path, queries.pattern()),
        "toxicity": lambda d: toxicity.grade(d, models[0]),
        "language": lambda d: langid.identify(d, models[1]),
        "pii": lambda d: pii.find(d),
        "masked": lambda d: pii.find(d, mask=True),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "near": lambda d: minhash.near_duplicates(d, 4),
    }


@pytest.mark.parametrize("name", ["quality", "bpe", "toxicity", "language", "pii", "masked", "lines", "near"])
def test_rows_stay(docs, models, name):
    call = each(models)[name]
    out = call(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and len(set(out.columns)) == len(out.columns)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(tuple(v for k, v in r.asDict().items() if k != "text"))
    assert by[4][0] == by[4][1] or name == "lines"
    assert out.limit(0).count() == 0 and call(docs.limit(0)).count() == 0


def test_defined_results(docs, models):
    ops = each(models)
    got = {n: {r.doc_id: r for r in ops[n](docs).collect()} for n in ops}
    assert not got["quality"][1].kept and got["quality"][4].n_words == 7 * 20_000
    assert [got["language"][i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got["language"][6].lang_pred == got["language"][7].lang_pred
    assert got["toxicity"][1].severity == got["toxicity"][2].severity == 0 and got["toxicity"][6].severity == got["toxicity"][7].severity
    assert bytes(got["bpe"][4].decoded).decode() == LONG and got["bpe"][1].token_ids == []
    assert got["masked"][1].text is None and got["pii"][2].spans == []
    assert (got["near"][6].component_id, got["near"][7].component_id, got["near"][1].component_id, got["near"][None].component_id) == (6, 6, 1, None)
    assert got["lines"][1].text is None and got["lines"][2].text == ""


def test_packing_edges(spark, docs):
    rows = queries.packed(docs).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and queries.packed(docs.limit(0)).count() == 0
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    clash = packing.pieces(docs.select("doc_id", "text").withColumn("sequence_id", F.lit("x")), queries.vocabulary("byte_bpe_50k.json")).withColumns({"_rank": F.lit("x"), "offset": F.lit("y")})
    assert packing.pack(clash).select("sequence_id", "offset").dtypes == [("sequence_id", "bigint"), ("offset", "bigint")]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 2000)], "doc_id long, start long, length long")).count()


def test_url_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "https://www.example.com/en/" + "x" * 100_000), (3, "https://www.example.com/en/" + "x" * 100_000), (None, "https://b.com/"), (4, "http://u.org/" + "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score", "_listed", "id", "address")})
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows) and all(r.verdict == "allow" for r in got) and [r.score for r in got] == [None] * len(rows)  # nothing is known to be rejected
    assert url_filter.judge(df.limit(0)).count() == 0


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0], 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (7, [1e300, 1e300], 1), (8, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("n_links", "component_id", "kept", "id", "vec", "cell", "border", "far", "_key", "_label")})
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivot_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (0, 0, None, False), (7, 1, 7, True), (8, 1, 7, False)], key=str)
    assert pivot_join.near_duplicates(df.limit(0)).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    words = " ".join(f"word{i} of a longer text" for i in range(40))
    odd = [(1, None, None, None, None, "c"), (2, "", "en", "s", 0, "c"), (3, words, "en", "s", None, "c"), (3, words, "en", "s", None, "c"), (None, words, None, None, 1, None)]
    for rows in ([], odd):
        df = spark.createDataFrame(rows, schema)
        for name, stage in p.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), schema)
            assert df.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        assert p.STAGES[-1][1](spark, df, str(tmp_path)).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    keep = p.STAGES[2][1](spark, spark.createDataFrame(odd, schema), "").collect()
    assert sum(r.doc_id == 3 for r in keep) == 1 and len(keep) == 4


def test_stages_against_a_second_computation(spark):
    """Quality, line and near-duplicate decisions of the stages, each on its own input."""
    import re

    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in fertility.measure(docs, queries.vocabulary("piece_bpe_32k.model")).where("kept").collect()}
    one = docs.sparkSession.createDataFrame((first := p.STAGES[0][1](spark, docs, "")).collect(), first.schema)
    assert {r.doc_id for r in one.collect()} == kept
    gone = {r.doc_id: set(r.dropped_lines) for r in line_dedup.dedup_lines(one).collect()}
    two = {r.doc_id: r for r in p.STAGES[1][1](spark, one, "").collect()}
    for r in one.collect():
        assert two[r.doc_id].text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id]) and two[r.doc_id].n_chars == len(two[r.doc_id].text)
    three = {r.doc_id for r in p.STAGES[2][1](spark, spark.createDataFrame(list(two.values()), docs.schema), "").collect()}
    sets = {}
    for i, r in two.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert three == {i for i in root if root[i] == i}
