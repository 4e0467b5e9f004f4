"""Each operator's method against a naive computation of the same, and its growth against its input."""

import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockgrain.llm import bpe, buckets, common, fertility, langid, line_dedup, minhash, packing, pii, pivot_join, queries, toxicity, url_filter


def test_fertility_figures():
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        text = "x" * rng.randint(1, 99)
        p = [ids.count(i) / len(ids) for i in set(ids)]
        entropy = -sum(v * math.log2(v) for v in p)
        got = fertility.fertility(text, ids, frozenset([3, 4]))
        most = math.log2(min(len(ids), 4096)) if len(ids) > 1 else None
        want = (len(text) / len(ids), sum(i in (3, 4) for i in ids) / len(ids), entropy, entropy / most if most else 1.0)
        assert np.allclose(got, want)


def test_quality_rejects_what_is_planted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 1500 and n_chars < 6000")
    clean = [r.text for r in docs.join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1"), "doc_id").select("text").collect()]
    rng = random.Random(2)
    broken = [t.encode().hex(" ", 3) for t in clean]
    noise = ["".join(rng.choice("qxzjkvwbpgyfmculdrhsnioate ") for _ in range(2000)) for _ in range(20)]
    other = [" ".join("".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(200)) for _ in range(20)]  # claims to be English
    rows = [(k, t) for k, group in enumerate((clean, broken, noise, other)) for t in group]
    got = fertility.measure(spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string"), queries.vocabulary("piece_bpe_32k.model")).where("not base_failed").groupBy("doc_id").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()
    share = {r.doc_id: r.s for r in got}
    assert share[0] > 0.9 and all(share.get(k, 0) == 0 for k in (1, 2, 3)), share


def test_url_model_against_naive_counts():
    texts = ["a.com/x", "a.com/y1", "b.de/", "a.com/x"]
    model = url_filter.Markov(texts, 3)

    def naive(context, char):
        p = 1 / 0x110000
        for k in range(4):
            c = context[3 - k :]
            after = [t[i + len(c)] for t in ("\x02\x02\x02" + x + "\x03" for x in texts) for i in range(3 - len(c), len(t) - len(c)) if t[i : i + len(c)] == c and i + len(c) >= 3]
            if not after:
                break
            p = (after.count(char) + len(set(after)) * p) / (len(after) + len(set(after)))
        return p

    for context in ("\x02\x02\x02", "com", ".co", "zzz", "m/x", "\x02\x02a"):
        for char in "acm./xyz\x03é":
            assert math.isclose(model.chance(context, char), naive(context, char))
    ratio = url_filter.Ratio(["good.com/a", "good.com/b"] * 10, ["bad.net/q"] * 10, 3)
    t = "\x02\x02\x02" + "bad.com" + "\x03"
    direct = sum(math.log(ratio.no.chance(t[i - 3 : i], t[i])) - math.log(ratio.yes.chance(t[i - 3 : i], t[i])) for i in range(3, len(t))) / (len(t) - 3)
    assert math.isclose(ratio.score("bad.com"), direct) and ratio.rejects("bad.net/q") and not ratio.rejects("good.com/a")


def test_url_models_count_all_known_addresses(spark):
    urls = [f"https://h{i % 7}.com/{i % 97}/a{i}" for i in range(23_000)] + [f"http://a{i % 3}.net/es/{i * 7919 % 100_003}" for i in range(22_000)]
    asked = ["http://x.org/es/77", "http://x.org/97/a5", "ftp://é.io/\U0001f600", "nothing", None, "http://y.org/" + "z" * 3000, "http://a1.org/es/12"]
    df = spark.createDataFrame(list(enumerate([*urls, *asked])), "page_id long, url string").repartition(6)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls) + len(asked)
    known = df.where(F.col("page_id") < len(urls)).select("page_id", F.substring_index("url", "://", -1).alias("address"))
    known = known.select("page_id", "address", url_filter.held_out(F.col("address")).alias("held")).collect()
    used, held = [r.address for r in known if not r.held and r.page_id < 23_000], [r.address for r in known if r.held and r.page_id < 23_000]
    no, yes = url_filter.Markov([r.address for r in known if r.page_id >= 23_000]), url_filter.Markov(used)
    assert 4000 < len(held) < 5200

    def score(text):
        t = "\x02" * 5 + text + "\x03"
        return sum(math.log(no.chance(t[i - 5 : i], t[i])) - math.log(yes.chance(t[i - 5 : i], t[i])) for i in range(5, len(t))) / (len(t) - 5)

    edge = max(0.0, sorted(map(score, held))[math.ceil(len(held) * 0.99)])
    for k, url in enumerate(asked):
        r, want = got[len(urls) + k], score((url or "").partition("://")[2])
        assert math.isclose(r.score, want, abs_tol=1e-8) and r.verdict == ("block" if want > edge else "allow"), (url, r, want)
    assert {got[len(urls) + k].verdict for k in range(len(asked))} == {"allow", "block"}


def test_language_decoding_by_enumeration():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(60, langid.BUCKETS))).astype(np.float32)
    langs = [f"l{i % 6}" for i in range(60)]
    for i in range(60):
        x[i, (i % 6) * 20 : (i % 6) * 20 + 20] += 9
    model = langid.OutputCode(np.sqrt(x / x.sum(axis=1, keepdims=True)), langs)
    f = np.clip(np.sqrt(x / x.sum(axis=1, keepdims=True)) @ model.w + model.b, -30, 30)
    loss = [[sum(t * math.log1p(math.exp(-c * v)) for t, c, v in zip(model.trust, word, row, strict=True)) for word in model.code] for row in f.tolist()]
    assert np.allclose(loss, model.losses(np.sqrt(x / x.sum(axis=1, keepdims=True))), rtol=1e-4)
    assert [model.langs[int(np.argmin(r))] for r in loss] == langs


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 40, f"x{i}") for i in range(150)] + [(1000, "the one " * 50, "x0")] * 300
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_total=300)
    assert len(model.langs) == 150  # no cap on languages; the repeated row counts once


def test_ordinal_gradient_by_differences():
    rows = [(0, [0]), (1, [0, 1]), (2, [1, 2]), (2, [2]), (0, []), (1, [1])]

    def objective(w, edges):
        total = -0.25 * sum(v * v for v in w)
        for g, f in rows:
            over = [1.0, *(1 / (1 + math.exp(e - sum(w[k] for k in f))) for e in edges), 0.0]
            total += math.log(over[g] - over[g + 1])
        return total

    model = toxicity.Ordinal(["a", "b", "c"], rows, rounds=4000, rate=0.02, decay=0.5)
    best = objective(model.w, model.edges)
    for k in range(3):  # at the maximum, no weight and no threshold can be moved to gain
        for step in (1e-2, -1e-2):
            assert objective(model.w + step * np.eye(3)[k], model.edges) < best
    for k in range(2):
        for step in (1e-2, -1e-2):
            assert objective(model.w, model.edges + step * np.eye(2)[k]) < best
    over = model.chances(["a b", ""])
    s = model.w[0] + model.w[1]
    assert np.allclose(over[0], [1 / (1 + math.exp(e - s)) for e in model.edges])


def test_severity_is_the_expected_grade(spark):
    model = toxicity.Ordinal(["vile"], [(0, []), (2, [0]), (1, [0])])
    row = toxicity.grade(spark.createDataFrame([(1, "vile x")], "doc_id long, text string"), model).first()
    over = model.chances(["vile"])[0]
    p = [1 - over[0], over[0] - over[1], over[1]]
    assert math.isclose(row.severity, p[1] + 2 * p[2]) and row.severity_grade == int(np.argmax(p)) and row.toxic == (row.severity >= 0.5)


def test_viterbi_by_enumeration():
    model = pii.Field(pii.training_table(4, 5), rounds=15)
    t, n = model.t + model.bar, len(pii.LABELS)
    for words in (["call", "+1", "(469)"], ["x@y.org"], ["a", "4111", "1111"]):
        shapes = [pii.shape_of(w) for w in words]
        e = model._emit(shapes)
        best = max(itertools.product(range(n), repeat=len(words)), key=lambda y: t[n, y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(model.decode([shapes])[0]) == best


def test_field_sees_other_scripts_and_letter_keys():
    model = pii.field()
    assert model.safe and pii.shape_of("Позвоните!") == "Aaaaaaaaa!" and pii.shape_of("日本1") == "aa0"
    text = "Позвоните мне 12 раз, Иван. key QwErTyUiOpAsDfGhJkLzXcVbNm is it"
    assert [(text[a:b], k) for a, b, k in pii.field_spans([text], model)[0]] == [("QwErTyUiOpAsDfGhJkLzXcVbNm", "secret")]
    assert pii.field_spans(["Donaudampfschifffahrtsgesellschaft ist lang. " + "-" * 40], model) == [[]]


@pytest.mark.parametrize("unit", ["ab", "日本", "é ", "0a"])
def test_encoding_takes_linear_time(unit):
    codec = bpe.load(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    took = []
    for n in (40_000, 80_000, 160_000):
        piece = (unit.strip() * n)[:n].encode()
        took.append(min(_seconds(lambda p=piece: codec.encode_piece(p)) for _ in range(3)))
    assert took[1] < 2.5 * took[0] + 0.02 and took[2] < 2.5 * took[1] + 0.02, took


def _seconds(call):
    start = time.perf_counter()
    call()
    return time.perf_counter() - start


def test_fast_route_equals_the_library_on_its_characters():
    path = queries.vocabulary("byte_bpe_50k.json")
    tok = packing.tokenizer(path, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    rng = random.Random(9)
    letters = [c for c in map(chr, range(0x2030)) if tok.plain(c)]
    for _ in range(1500):
        t = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice("aeinrst  \n'0") for _ in range(rng.randint(0, 60)))
        assert tok.fast(t) == tok.full.encode(t, add_special_tokens=False).ids, repr(t)


def test_samples_do_not_depend_on_the_partitioning(spark):
    rows = [(i, f"t{i}") for i in range(3000)] + [(7, "t7")] * 500 + [(None, "x")] * 9
    df = spark.createDataFrame(rows, "id int, text string")
    got = [sorted(map(tuple, common.hash_sample(df.repartition(n), 50, "id", "text").collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and 20 <= len(got[0]) <= 50 and None not in [r[0] for r in got[0]]


# --- near duplicates ---------------------------------------------------------------------------------------------


@pytest.fixture
def written(monkeypatch):
    """The most rows that were written under each name."""
    counts = {}

    def counted(df, tag, *more):
        out = common.staged(df, tag, *more)
        counts[tag] = max(counts.get(tag, 0), out.count())
        return out

    for module in (buckets, minhash, line_dedup, pivot_join):
        monkeypatch.setattr(module, "staged", counted)
    return counts


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]


def test_texts_just_short_of_linking(spark, written):
    rng = random.Random(4)
    base = _words(rng, 400)

    def variant():
        w = list(base)
        for at in rng.sample(range(400), 5):
            w[at] = _words(rng, 1)[0]
        return " ".join(w)

    rows = [(i, variant()) for i in range(700)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, b in itertools.combinations(ids, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in ids}
    assert max(written.get(t, 0) for t in ("pairs", "similar", "hopeful", "sided")) < 10_000, written


def test_keep_one_loses_no_text_and_keeps_no_repeat(spark):
    a, b = "a b c d e f", "something else that nobody else has written"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, "entirely different words stand in this one"), (8, None), (9, ""), (None, a), (None, a), (3, "u v w x y z"), (3, "u  v w x y z")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _hash int")
    kept = sorted((r.doc_id or 0, r.text or "") for r in minhash.keep_one(df, shingle_words=4).collect())
    assert [t for i, t in kept if i == 3] in (["u v w x y z"], ["u  v w x y z"])
    assert [(i, t) for i, t in kept if i != 3] == [(0, a), (0, a), (1, a), (5, b), (7, "entirely different words stand in this one"), (8, ""), (9, "")]
    same = spark.createDataFrame([(5, a)] * 3, "doc_id long, text string")
    assert minhash.keep_one(same).count() == 1


def test_one_id_with_several_texts(spark):
    rng = random.Random(6)
    x, y = (" ".join(_words(rng, 60)) for _ in range(2))
    rows = [(5, x), (5, y), (7, x + " more"), (9, y + " more"), (2, y + " other")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 56): 5, (7, 57): 5, (9, 57): 2, (2, 57): 2} or got[(7, 57)] == 5 and got[(9, 57)] == got[(2, 57)] == 2


def test_long_text_is_hashed_in_windows(monkeypatch):
    rng = random.Random(7)
    text = " ".join(_words(rng, 3000)) + " " + "x" * 5000 + "\t" + " ".join(_words(rng, 100))
    whole = minhash.shingle_sets([text, "a b", ""], 4)
    monkeypatch.setattr(minhash, "WINDOW", 100)
    assert all((a == b).all() for a, b in zip(whole, minhash.shingle_sets([text, "a b", ""], 4), strict=True))


def test_lines_just_short_of_linking(spark, written):
    rng = random.Random(8)
    base = _words(rng, 30)

    def variant():
        w = list(base)
        w[rng.randrange(30)] = _words(rng, 1)[0]
        return " ".join(w)

    lines = list(dict.fromkeys(variant() for _ in range(900)))
    lines += [t[:90] + "X" + t[91:] for t in lines[:40]]
    rows = [(i, t) for i, t in enumerate(lines)]
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0").collect()}
    assert got >= set(range(len(lines) - 40, len(lines))) and len(got) < 120
    assert max(written.get(t, 0) for t in ("pairs", "open")) < 10_000, written


def test_few_files_of_lines_to_compare(spark, monkeypatch):
    files = {}

    def counted(df, tag, *more):
        out = common.staged(df, tag, *more)
        names = [n for _, _, found in os.walk(out.staged_path.removeprefix("file://")) for n in found]
        files.setdefault(tag, []).append(sum(n.endswith(".parquet") for n in names))
        assert not any(n.endswith(".crc") for n in names), tag
        return out

    for module in (buckets, line_dedup):
        monkeypatch.setattr(module, "staged", counted)
    rows = [(i, f"{'abcdefghijklmnopqrst'[i % 20] * 9} the same line but for two signs {i % 20:03d}") for i in range(40)]
    rows += [(100 + i, rows[i][1][:-1] + "x") for i in range(20)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).where("n_dropped > 0")
    assert {r.doc_id for r in got.collect()} == {*range(20, 40), *range(100, 120)}
    assert files["lines"][0] > 4 and set(files["texts"]) == {1}, files


def test_small_tables_have_few_writers(spark):
    def files(df):
        return sum(n.endswith(".parquet") for n in os.listdir(common.staged(df, "few").staged_path.removeprefix("file://")))

    few = common.CORE_TASKS * spark.sparkContext.defaultParallelism
    assert files(spark.range(0, 10_000, 1, 5 * few)) == few
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:  # as if it were large
        assert files(spark.range(0, 10_000, 1, 5 * few)) == 5 * few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_line_hashes_that_collide(spark, monkeypatch):
    kept = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: kept(*c) if len(c) != 1 else kept(F.length(c[0])))
    rows = [(1, "the first line that is long enough"), (2, "another one that is quite as long!"), (3, "the first line that is long enough")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_lines_of_repeated_rows(spark):
    line = "a line that is long enough to be compared"
    rows = [(None, line), (None, line), (1, line), (1, line), (1, "other\n" + line), (2, line + "\n" + line)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 2)]


# --- vectors -----------------------------------------------------------------------------------------------------


def _clusters(n, dims, seed, centres=36):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(centres, dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, dims))).tolist()


def _links(vectors, least):
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("dims", [3, 16])
def test_splits_of_splits(spark, monkeypatch, dims):
    monkeypatch.setattr(pivot_join, "CELL_ROWS", 40)
    monkeypatch.setattr(pivot_join, "PIVOTS", 4)
    monkeypatch.setattr(pivot_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(pivot_join, "COPIES", 50.0)
    vectors = _clusters(900, dims, 11)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    levels = pivot_join.cells(df.selectExpr("vec_id as id", "'1' as label", "embedding as vec", "1L as times", f"{dims} as dim"), float(np.sqrt(2 - 1.86))).agg(F.max("cell")).first()[0]
    assert levels > 5  # more than one level
    got = {r.vec_id: r.n_links for r in pivot_join.near_duplicates(df).collect()}
    assert got == dict(enumerate(_links(vectors, 0.93).sum(axis=1).tolist()))


def test_copies_grow_with_the_rows(spark):
    made = []
    for n in (6_000, 24_000):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(_clusters(n, 32, 12, 300))], "id long, vec array<double>").selectExpr("id", "'a' as label", "vec", "1L as times", "32 as dim")
        radius = float(np.sqrt(2 - 1.86))
        made.append(pivot_join.meetings(pivot_join.cells(df, radius), radius).count() / n)
    assert made[1] < 2 * made[0], made
