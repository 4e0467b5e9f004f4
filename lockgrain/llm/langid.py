"""Language identification with error-correcting output codes.

Every language has a binary codeword.  One linear classifier over byte n-grams a bit predicts that bit; the codeword
with the least loss over all bits, weighted by how well each bit was learned, is the language.  A small gap between
the best two codewords flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.llm.common import BATCH_ROWS, arrow_schema, if_small, prepare, staged, without

#: Labelled texts a language in the fit, and of all languages together, at most, though one of each language at least:
#: the bounds of this operator's sample.  Every language is learned.
FIT_ROWS, FIT_TOTAL = 400, 16_000
#: Buckets of hashed byte 2-grams and 3-grams.
BUCKETS = 4096
#: Languages closer than this in weighted loss are ambiguous.
AMBIGUOUS = 0.05

_letter = regex.compile(r"\p{L}")
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_lower[[9, 10, 11, 12, 13]] = 32


def features(texts: list[str]) -> np.ndarray:
    """Square roots of relative n-gram counts, a row a whole text; rows of texts under two bytes may be zero."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(raw), 1 << 16):  # long texts in windows that overlap by two bytes
            b = _lower[raw[at : at + (1 << 16) + 2]].astype(np.uint32)
            if len(b) < 2:
                continue
            two = b[:-1] * np.uint32(251) + b[1:]
            n = min(len(two), 1 << 16)
            out[i] += np.bincount(two[:n] % (BUCKETS // 4), minlength=BUCKETS)
            three = (two[:-1] * np.uint32(2654435) + b[2:] * np.uint32(40503)) >> np.uint32(7)
            n = min(len(three), 1 << 16)
            out[i] += np.bincount(three[:n] % (BUCKETS // 4 * 3) + BUCKETS // 4, minlength=BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 and -1: all splits for up to 5 classes, else random rows that keep their distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (s >> i) & 1 else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)])
    bits, rng, best, far = max(15, int(8 * np.ceil(np.log2(n)))), np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        near = min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) if n <= 32 else ((bits - (m @ m.T)) / 2 + bits * np.eye(n)).min()
        splits = (np.abs(m.sum(axis=0)) < n).all()
        if splits and near > far:
            best, far = m, near
    return best


class OutputCode:
    """Languages, codewords, and a logistic classifier a bit."""

    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 300, rate: float = 8.0, decay: float = 1e-5):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        y = self.code[[self.langs.index(v) for v in langs]].astype(np.float32)
        _, of, n = np.unique(langs, return_inverse=True, return_counts=True)
        weight = (1 / n[of] / len(n)).astype(np.float32)[:, None]
        self.w, self.b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        speed, kick = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(rounds):
            g = -y * weight / (1 + np.exp(y * (x @ self.w + self.b)))
            speed = 0.9 * speed - rate * (x.T @ g + decay * self.w)
            kick = 0.9 * kick - rate * g.sum(axis=0)
            self.w += speed
            self.b += kick
        margin = y * (x @ self.w + self.b)
        # a bit that was learned badly counts less
        self.trust = np.maximum(1e-3, 2 * ((margin > 0) * weight).sum(axis=0) - 1)
        self.trust = self.trust / self.trust.sum()

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Logistic losses of each text against each codeword, weighted by the bits' trust."""
        f = np.clip(x @ self.w + self.b, -30, 30)
        yes, no = np.log1p(np.exp(-f)) * self.trust, np.log1p(np.exp(f)) * self.trust
        return yes @ (self.code.T > 0) + no @ (self.code.T < 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (share of the best codeword in the softened losses) and the ambiguity flag."""
        loss = self.losses(features(texts))
        best = loss.argmin(axis=1)
        order = np.sort(loss, axis=1)
        soft = np.exp(-4 * (loss - order[:, :1]))
        gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.ones(len(loss))
        return [self.langs[i] for i in best], 1 / soft.sum(axis=1), gap < AMBIGUOUS


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_total: int = FIT_TOTAL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> OutputCode | None:
    """Learn from the rows of ``labelled`` with a language and a text; None if there are none.

    The sample: of each language the ``fit_rows`` rows of smallest hash of (id, text), fewer if ``fit_total`` would be
    exceeded, but one at least; rows that repeat both count once.  N-gram counts are made by the executors; the driver
    gets ``BUCKETS`` half-precision numbers for each sampled row.
    """
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(5)).alias("h"))
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "languages")
    languages = sizes.count()
    if not languages:
        return None
    each = max(1, min(fit_rows, fit_total // languages))
    # of a large language only the share that holds about four times as many rows is ranked
    edge = F.when(F.col("n") > 8 * each, -(2.0**63) + 2.0**64 * 4 * each / F.col("n")).otherwise(2.0**63)
    near = rows.join(if_small(sizes.select("lang", "least", edge.alias("edge"))), "lang").where((F.col("h").cast("double") <= F.col("edge")) | (F.col("h") == F.col("least")))
    one = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = one.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= each).select("lang", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], schema=arrow_schema(schema))

    got = sorted(((r[0], bytes(r[1])) for r in sample.mapInArrow(run, schema).collect()))
    x = np.empty((len(got), BUCKETS), np.float32)
    for k, (_, raw) in enumerate(got):
        x[k] = np.frombuffer(raw, np.float16)
    return OutputCode(x, [lang for lang, _ in got])


def identify(docs: DataFrame, model: OutputCode | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append lang_pred, score (0 to 1) and ambiguous.

    Null texts, texts without a letter, and all texts if there is no model are ``und`` with score 0.  Equal texts get
    equal results; of languages with equal loss the alphabetically first is given, and flagged.  Whole texts count,
    however long, and an empty table gives an empty table.  Input columns with an output's name are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = without(docs, "lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)])
    target = arrow_schema(schema)
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in kept]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for big in batches:
            for start in range(0, big.num_rows, BATCH_ROWS):
                batch = big.slice(start, BATCH_ROWS)
                texts = batch.column(at).to_pylist()
                lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                some = [i for i, t in enumerate(texts) if code and t and _letter.search(t)]
                if some:
                    names, score[some], unsure[some] = code.predict([texts[i] for i in some])
                    for i, v in zip(some, names, strict=True):
                        lang[i] = v
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(lang, target.field("lang_pred").type), pa.array(score), pa.array(unsure)], schema=target)

    return docs.mapInArrow(run, schema)
