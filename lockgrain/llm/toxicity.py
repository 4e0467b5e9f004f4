"""Severity of toxic text by cumulative-link ordinal regression.

Grades are ordered.  One weight vector over sparse word features is shared by all thresholds: the chance that the
severity exceeds grade k is the logistic function of (score - threshold k).  The output is the expected severity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.llm.common import arrow_schema, hash_sample, prepare, staged, without

#: Labelled rows in the fit, at most; the bound of this operator's sample.
FIT_ROWS = 20_000
#: Words in the model, at most: those whose log-odds between toxic and clean texts are most significant.
VOCABULARY = 2000
#: Least significance (in standard errors) of a word's log-odds.
LEAST_Z = 3.0
#: Expected severity from which a text counts as toxic: more than half a grade.
EDGE = 0.5

_strip = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA1, 0xAB, 0xBB, 0xBF, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2026]))


def words(text: str | None) -> set[str]:
    """Distinct words of a whole text, lower-cased and without punctuation around them."""
    return {w.strip(_strip) for w in set(text.lower().split())} - {""} if text else set()


class Ordinal:
    """Weights by word and increasing thresholds; grades are 0..len(edges)."""

    def __init__(self, vocabulary: list[str], rows: list[tuple[int, list[int]]], rounds: int = 500, rate: float = 0.1, decay: float = 0.5):
        self.index = {w: i for i, w in enumerate(vocabulary)}
        y = np.array([g for g, _ in rows], int)
        grades = int(y.max()) if len(y) else 0
        at = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
        feat = np.array([k for _, f in rows for k in f], int)
        self.w = np.zeros(len(vocabulary))
        share = np.array([(y > k).mean() for k in range(grades)]) if grades else np.zeros(0)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        self.edges = np.log((1 - share) / share)
        # gaps between thresholds are exponentials, so that the thresholds stay in order
        p = np.concatenate(([self.edges[0]], np.log(np.maximum(np.diff(self.edges), 1e-3)))) if grades else np.zeros(0)
        m, v = np.zeros(len(self.w) + len(p)), np.zeros(len(self.w) + len(p))
        for step in range(1, rounds + 1 if grades else 1):
            self.edges = p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))
            s = np.bincount(at, self.w[feat], len(rows)) if len(feat) else np.zeros(len(rows))
            over = self._over(s)  # chance of more than k, with 1 before and 0 after
            full = np.hstack([np.ones((len(y), 1)), over, np.zeros((len(y), 1))])
            n = np.arange(len(y))
            p_y = np.maximum(full[n, y] - full[n, y + 1], 1e-12)
            slope = np.hstack([np.zeros((len(y), 1)), over * (1 - over), np.zeros((len(y), 1))])
            ds = (slope[n, y] - slope[n, y + 1]) / p_y
            de = np.zeros((len(y), grades + 2))
            de[n, y] -= slope[n, y] / p_y
            de[n, y + 1] += slope[n, y + 1] / p_y
            de = de[:, 1:-1].sum(axis=0)
            gw = (np.bincount(feat, ds[at], len(self.w)) if len(feat) else 0) - decay * self.w
            gp = np.array([de.sum(), *[np.exp(p[j]) * de[j:].sum() for j in range(1, grades)]])
            g = np.concatenate((gw * np.ones(len(self.w)), gp))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.w, p = self.w + move[: len(self.w)], p + move[len(self.w) :]
        self.edges = p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:])))) if grades else np.zeros(0)

    def _over(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - self.edges[None], -50, 50)))

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """Chance of exceeding each grade but the last, a row a text."""
        score = [sum(self.w[self.index[x]] for x in sorted(words(t) & self.index.keys())) for t in texts]
        return self._over(np.array(score, float))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """Learn from at most ``fit_rows`` labelled ids (by hash; ids labelled twice take the highest grade).

    Null grades, null ids and null texts are left out; of several texts of an id the least one counts.  Without any
    labelled row, or with one grade only, every text has severity 0.
    """
    prepare(docs.sparkSession)
    graded = labels.where(F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
    chosen = F.broadcast(staged(hash_sample(graded, fit_rows, "id", "grade"), "chosen"))  # ``fit_rows`` ids at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(chosen, "id")
    rows = rows.groupBy("id").agg(F.max("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")
    schema = T.StructType([T.StructField("grade", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(words(t)) for t in b.column(1).to_pylist()], target.field("words").type)], schema=target)

    sample = staged(rows.mapInArrow(run, schema), "toxicity")
    total = dict.fromkeys((False, True), 0) | {bool(r[0]): r[1] for r in sample.groupBy(F.col("grade") > 0).count().collect()}
    if not all(total.values()):
        return Ordinal([], [])
    n1, n0 = float(total[True]), float(total[False])
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    seen = sample.select((F.col("grade") > 0).alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    z = odds / F.sqrt(1 / a + 1 / b)
    vocabulary = [r[0] for r in seen.select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(VOCABULARY).collect()]
    index = {w: i for i, w in enumerate(vocabulary)}
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    got = sample.select("grade", F.array_intersect("words", known).alias("words")).collect()  # a row an id
    return Ordinal(vocabulary, sorted((g, sorted(index[w] for w in ws)) for g, ws in got))


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text", keep_text: bool = True, edge: float = EDGE) -> DataFrame:
    """Append severity (expected grade), severity_grade (most likely one) and toxic (severity of ``edge`` or more).

    Null and empty texts have severity 0 and are not toxic.  Equal texts get equal results; at a tie between grades the
    lower one is most likely.  Whole texts count, however long, and an empty table gives an empty table.  Input columns
    with an output's name are replaced.
    """
    prepare(docs.sparkSession)
    docs = without(docs, "severity", "severity_grade", "toxic")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("severity", T.DoubleType(), False), T.StructField("severity_grade", T.LongType(), False), T.StructField("toxic", T.BooleanType(), False)])
    target = arrow_schema(schema)
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            over = fitted.chances(texts) * np.array([bool(t) for t in texts])[:, None]
            each = np.hstack([np.ones((len(texts), 1)), over]) - np.hstack([over, np.zeros((len(texts), 1))])
            severity = over.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(severity), pa.array(each.argmax(axis=1).astype(np.int64)), pa.array(severity >= edge)], schema=target)

    return docs.mapInArrow(run, schema)
