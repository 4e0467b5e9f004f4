"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is run over the whole text.  Characters per token fall when a text is not the
language it claims (or is noise), the byte-fallback share rises with broken encodings and rare signs, and the entropy
of the token distribution, relative to the most that so many tokens can have, falls when a text repeats itself.
Each is held against a band for the text's language, or for its main script where the language has no band.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lockgrain.llm.common import SPACES, arrow_schema, model, prepare, without

#: (least and most characters a token, most byte-fallback share, least relative entropy).  Languages: measured by
#: piece_bpe_32k on the documents of sf0.1 that `labels` calls clean (quality 1) and the base rule keeps (1,973 en, 475
#: de, 307 es, 488 fr).  Least characters is their 1 % quantile and least entropy their 0.5 % quantile, rounded down;
#: most byte share is twice their highest.  Low-quality text is not above clean text in characters, so that side is only
#: a guard.  Latin is the loosest of the four.  The other scripts occur in no sample; their bands are assumed.
BANDS = {
    "en": (2.46, 9.0, 0.08, 0.58),
    "de": (2.46, 9.0, 0.06, 0.56),
    "es": (2.15, 9.0, 0.05, 0.56),
    "fr": (2.17, 9.0, 0.09, 0.55),
    "Latin": (2.15, 9.0, 0.09, 0.55),
    "Cyrillic": (0.9, 8.0, 0.40, 0.40),
    "Greek": (0.7, 8.0, 0.60, 0.40),
    "Arabic": (0.6, 8.0, 0.80, 0.35),
    "Hebrew": (0.6, 8.0, 0.80, 0.35),
    "Devanagari": (0.4, 8.0, 0.90, 0.35),
    "Thai": (0.4, 8.0, 0.95, 0.35),
    "Hangul": (0.3, 6.0, 0.95, 0.35),
    "Hiragana": (0.3, 6.0, 0.80, 0.35),
    "Han": (0.3, 6.0, 0.80, 0.35),
}
#: Where no letter of the scripts above occurs, or another script prevails.
OTHER = (0.25, 9.0, 1.0, 0.35)
SYMBOLS = "#*$%&|<>"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_scripts = {s: regex.compile(rf"\p{{{s}}}+") for s in BANDS if len(s) > 2}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines with a word, words in repeated windows of three."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, windows = 0, list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def main_script(text: str) -> str | None:
    """The listed script with most characters in the whole text; at a tie the one listed first; None without any."""
    n = {s: sum(map(len, p.findall(text))) for s, p in _scripts.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def fertility(text: str, ids: list[int], is_byte: frozenset[int]) -> tuple[float, float, float, float]:
    """Characters per token, byte-fallback share, token entropy in bits, and entropy relative to its maximum."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 1.0
    often = Counter(ids)
    entropy = math.log2(n) - sum(c * math.log2(c) for c in often.values() if c > 1) / n
    fallback = sum(c for i, c in often.items() if i in is_byte)
    # beyond some thousand tokens natural text no longer gains entropy, so the maximum is that of the first 4,096
    return len(text) / n, fallback / n, entropy, entropy / math.log2(min(n, 4096)) if n > 1 else 1.0


def verdict(text: str, lang: str | None, figures: tuple[float, float, float, float]) -> bool:
    low, high, share, least = BANDS.get(lang) or BANDS.get(main_script(text), OTHER)
    chars, fallback, _, relative = figures
    return low <= chars <= high and fallback <= share and relative >= least


def _model(path: str) -> tuple[object, frozenset[int]]:
    def make() -> tuple[object, frozenset[int]]:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return m, frozenset(i for i in range(m.get_piece_size()) if m.is_byte(i))

    return model(("fertility", path), make)


def measure(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str | None = "lang", keep_text: bool = True) -> DataFrame:
    """Append the five base counts, base_failed, chars_per_token, byte_share, token_entropy and kept.

    Whole texts are measured.  Null, empty and blank texts have no words: they fail the base rule and are not kept.
    A null or unlisted language is judged by its main script, at a tie by the one listed first.  Repeated rows get equal
    results, and an empty table gives an empty table.  Input columns with an output's name are replaced.
    """
    prepare(docs.sparkSession)
    own = [*[(c, T.LongType()) for c in FIELDS], ("base_failed", T.BooleanType()), ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType()), ("kept", T.BooleanType())]
    docs = without(docs, *[n for n, _ in own])
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t, False) for n, t in own])
    target = arrow_schema(schema)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None
    keep = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, is_byte = _model(vocabulary)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
            rows = []
            for text, lang in zip(texts, langs, strict=True):
                base = base_counts(text)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                figures = fertility(text or "", pieces.encode(text) if text else [], is_byte)
                rows.append((*base, failed, *figures[:3], not failed and verdict(text, lang, figures)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in own]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(c, target.field(n).type) for (n, _), c in zip(own, columns, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)
