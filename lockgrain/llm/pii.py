"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans.  The field is trained from a small labelled table that is written by rule below,
labels each word by its shape and its neighbours' shapes, and is decoded by Viterbi in numpy batches of segments.
Its spans are added where no base span lies; base spans always stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockgrain.llm.common import arrow_schema, prepare, without

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base kinds in their contract's order; ``secret`` (keys, tokens, passwords) is found by the field alone.
BASE = KINDS[:4]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Sentences of the training table for each kind.
EXAMPLES = 60

_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local_tail = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_mark = re.compile(r"[0-9@]")
#: Characters from which a word without a digit or @ is looked at by the field too: it may be a key of letters alone.
LONG = 20
_long = re.compile(rf"[^ \t-\r]{{{LONG}}}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        nxt = at + 1
        if start < at and (m := _domain.match(text, nxt)):
            out.append((start, m.end()))
            last = nxt = m.end()
        else:
            last = nxt  # no later match can begin before this sign
        at = text.find("@", nxt)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start and the order of kinds."""
    if not text or not _mark.search(text):
        return []
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _card.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    found.sort(key=lambda s: (s[0], BASE.index(s[2])))
    return found


# --- word shapes -------------------------------------------------------------------------------------------------

_class = np.full(256, ord("x"), np.uint8)
for _c in range(256):
    _class[_c] = _c if _c < 128 else ord("a")
_class[ord("A") : ord("Z") + 1] = ord("A")
_class[ord("a") : ord("z") + 1] = ord("a")
_class[ord("0") : ord("9") + 1] = ord("0")
_table = _class.tobytes()


class _Wide(dict):
    """The class sign of each character above U+00FF: letters by their case, anything else a sign of its own."""

    def __missing__(self, code: int) -> int:
        if code < 256:
            return code
        kind = unicodedata.category(chr(code))
        self[code] = out = ord("A" if kind == "Lu" else "a" if kind[0] in "LM" else "~")
        return out


_wide = _Wide()


def classes_of(text: str) -> bytes:
    """A sign for each code point."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = text.translate(_wide).encode("latin-1")
    return raw.translate(_table)


_runs = re.compile(r"(.)\1*", re.S)


def shape_features(shape: str) -> tuple[str, ...]:
    """Features of one word from its shape alone: classes of characters and the lengths of their runs."""
    core = shape.strip(".,;:!?\"'()[]")
    runs = [(m.group(1), m.end() - m.start()) for m in _runs.finditer(core)]
    digits, letters = core.count("0"), core.count("a") + core.count("A")
    size = lambda n: str(n) if n <= 4 else "5-7" if n <= 7 else "8-13" if n <= 13 else "14-19" if n <= 19 else "20+"
    # words of letters alone are told apart by whether they are long enough to be keys
    plain = "short:" if not digits and "@" not in core and len(core) < LONG else ""
    out = ["skeleton=" + plain + "".join(c for c, _ in runs[:12]), "digits=" + size(digits), "length=" + size(len(core))]
    out.append("start=" + shape[:1] + (core[:1] or "-"))
    mixed = digits >= 3 and letters >= 3 and not set(core) - set("Aa0=:\"'_-")
    out.append("mixed=" + (size(len(core)) + ("A" if "a" not in core else "a") if mixed else "no"))
    if "@" in core[1:-1]:
        out.append("at-inside" + ("-dot" if "." in core[core.index("@") :] else ""))
    if digits and not letters:
        groups = [n for c, n in runs if c == "0"]
        out.append("groups=" + ",".join(size(n) for n in groups[:6]))
        out.append("number=" + ("dots" if "." in core else "dash" if "-" in core[1:] else "plain") + str(len(groups)))
    if not digits and "@" not in core:
        out.append("wordlike")
    return tuple(out)


def coarse(shape: str) -> str:
    """What a neighbour sees of a word."""
    core = shape.strip(".,;:!?\"'")
    digits = core.count("0")
    if "@" in core:
        return "at"
    if not digits:
        return "plus" if core.startswith("+") else "equals" if core in ("=", ":") else "word"
    if set(core) <= set("+0"):
        return "plus-number" if core[0] == "+" else f"number{min(digits, 5)}"
    return "brackets" if "(" in core or ")" in core else "dashes" if set(core) <= set("0-") else "dots" if set(core) <= set("0.") else "mixed"


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Classes of a text's code points, and where its words start and end."""
    raw = classes_of(text)
    b = np.frombuffer(raw, np.uint8)
    solid = np.concatenate(([False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]))
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    return raw, turn[::2], turn[1::2]


# --- the training table ------------------------------------------------------------------------------------------


def training_table(n: int = EXAMPLES, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences: written numbers, keys and addresses of each kind between words, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *v: v[int(rng.integers(len(v)))]
    d = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick(*"abcdefghilmnoprstuvé") for _ in range(int(rng.integers(1, 10))))
    hexed = lambda k: d(1) + "".join(pick(*"0123456789abcdef") for _ in range(k - 2)) + d(1)
    letters = lambda k: "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    key = lambda k: "".join(pick(*"ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(k - 1)) + d(1)
    some = {
        "email": lambda: pick(f"{word()}.{d(2)}@mail{d(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}+{d(3)}@{word()}.co", f"<{word()}@{word()}.net>"),
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "card": lambda: pick(d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(6)} {d(5)}"),
        "phone": lambda: pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)}{d(9)}"),
        "secret": lambda: pick(letters(int(rng.integers(24, 44))), f"password={hexed(18)}", f'"{hexed(40)}"', f"AKIA{key(16)}", hexed(32), f"key-{hexed(24)}"),
    }
    plain = lambda: pick(word(), word(), word(), word().capitalize(), word() + ",", word() + ".", word() + "-" + word(), word().upper(), *long_words())
    long_words = lambda: [] if rng.integers(0, 12) else ["".join(word() for _ in range(5)).ljust(LONG, "s"), f"https://www.{word()}-{word()}.org/{word()}/{word()}", "-" * 24]
    harmless = lambda: pick(d(1), d(2), d(3), str(int(rng.integers(1900, 2060))), f"{d(1)}.{d(1)}", f"{d(1)},{d(3)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}%", f"${d(3)}", f"({d(4)})", f"v{d(1)}.{d(2)}", f"{word()}{d(1)}", d(5), f"{d(1)} {word()} {d(2)}", f"{d(2)}/{d(2)}/{d(4)}", "=", "@", f"{d(6)}", f"{word()}={d(1)}", f"{d(3)} {d(3)}")
    table = []
    for k in range(n * (len(KINDS) + 3)):
        words, labels = [], []
        for _ in range(int(rng.integers(2, 8))):
            words.append(plain())
            labels.append("O")
        for kind in [KINDS[k % (len(KINDS) + 3)]] if k % (len(KINDS) + 3) < len(KINDS) else [None] * int(rng.integers(0, 3)):
            parts = (some[kind]() if kind else harmless()).split()
            end = pick("", "", ",", ".")
            words += [*parts[:-1], parts[-1] + end]
            labels += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(parts))]
            for _ in range(int(rng.integers(0, 4))):
                words.append(plain())
                labels.append("O")
        table.append((words, labels))
    return table


class Field:
    """A linear-chain conditional random field: weights of (feature, label) pairs and of label transitions."""

    def __init__(self, table: list[tuple[list[str], list[str]]] | None = None, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3):
        self.names: dict[str, int] = {}
        self.emission: dict[str, np.ndarray] = {}
        self.fit(training_table() if table is None else table, rounds, rate, decay)

    def _features(self, shapes: list[str], grow: bool) -> list[list[int]]:
        look = (lambda f: self.names.setdefault(f, len(self.names))) if grow else self.names.get
        around = ["^", *map(coarse, shapes), "$"]
        rows = [[*shape_features(s), "before=" + around[i], "after=" + around[i + 2]] for i, s in enumerate(shapes)]
        return [[k for k in map(look, r) if k is not None] for r in rows]

    def fit(self, table, rounds, rate, decay) -> None:
        """Adaptive gradient ascent on the penalised log-likelihood; sentences are padded into one batch."""
        n, m = len(LABELS), max((len(w) for w, _ in table), default=1)
        xs = [self._features([shape_of(w) for w in words], True) for words, _ in table]
        size = np.array([len(x) for x in xs])
        y = np.zeros((len(xs), m), int)
        row, place, feat = [], [], []
        for i, (x, (_, labels)) in enumerate(zip(xs, table, strict=True)):
            y[i, : len(labels)] = [LABELS.index(v) for v in labels]
            for t, fs in enumerate(x):
                row += [i] * len(fs)
                place += [t] * len(fs)
                feat += fs
        row, place, feat = map(np.array, (row, place, feat))
        live = np.arange(m)[None] < size[:, None]
        self.w, self.t = np.zeros((len(self.names), n)), np.zeros((n + 1, n))  # the last row of t: from the start
        allowed = np.array([[b == "O" or b[0] == "B" or (a != "^" and a[2:] == b[2:]) for b in LABELS] for a in [*LABELS, "^"]])
        self.bar = np.where(allowed, 0.0, -1e4)  # an inside label follows its own kind only
        sw, st, i = np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8), np.arange(len(xs))
        for _ in range(rounds):
            t = self.t + self.bar
            e = np.zeros((len(xs), m, n))
            np.add.at(e, (row, place), self.w[feat])
            a, b = np.zeros((m, len(xs), n)), np.zeros((m, len(xs), n))
            a[0] = e[:, 0] + t[n]
            for k in range(1, m):
                a[k] = np.where(live[:, k, None], np.logaddexp.reduce(a[k - 1][:, :, None] + t[None, :n], axis=1) + e[:, k], a[k - 1])
            z = np.logaddexp.reduce(a[m - 1], axis=1)
            for k in range(m - 2, -1, -1):
                b[k] = np.where(live[:, k + 1, None], np.logaddexp.reduce(t[None, :n] + (e[:, k + 1] + b[k + 1])[:, None, :], axis=2), 0.0)
            p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
            gt = np.zeros_like(self.t)
            np.add.at(gt, (n, y[:, 0]), 1)
            gt[n] -= p[:, 0].sum(axis=0)
            for k in range(1, m):
                on = live[:, k]
                np.add.at(gt, (y[on, k - 1], y[on, k]), 1)
                gt[:n] -= np.exp(a[k - 1][on][:, :, None] + t[None, :n] + (e[on, k] + b[k][on])[:, None, :] - z[on, None, None]).sum(axis=0)
            d = -p
            d[i[:, None], np.arange(m)[None], y] += live
            gw = np.zeros_like(self.w)
            np.add.at(gw, feat, d[row, place])
            for w, g, s in ((self.w, gw, sw), (self.t, gt, st)):
                g -= decay * len(xs) * w
                s += g * g
                w += rate * g / np.sqrt(s)
        self._plain()

    def _plain(self) -> None:
        """Check that words under ``LONG`` characters without a digit or @ are always outside, whatever stands beside them.

        Then a segment of such words needs no decoding: its best path is known.
        """
        # in skeletons and starts 0 stands for a digit, elsewhere it is part of a number
        free = [f for f in self.names if not f.startswith("skeleton=") or f.startswith("skeleton=short:")]
        free = [f for f in free if not f.startswith("start=") or not set("0@") & set(f.partition("=")[2])]
        family: dict[str, np.ndarray] = {}
        for f in [*free, "digits=0"]:
            head, _, tail = f.partition("=")
            if (head == "digits" and tail != "0") or (head == "length" and tail == f"{LONG}+") or (head in ("before", "after") and tail not in ("^", "$", "word", "plus", "equals")) or head in ("groups", "number", "at-inside", "at-inside-dot") or (head == "mixed" and tail != "no"):
                continue
            d = self.w[self.names[f]] - self.w[self.names[f], 0]
            certain = head in ("digits", "mixed", "wordlike")  # such a word has just this one of the family
            family[head] = d if certain else np.maximum(family.get(head, 0.0), d)
        word = sum(family.values())[1:]
        t, n = self.t + self.bar, len(LABELS)
        run = np.maximum(t[0, 1:] - t[0, 0], t[n, 1:] - t[n, 0]) + word  # the best that a stretch of labels gains
        best = -np.inf
        for _ in range(2 * n):
            best = max(best, (run + np.maximum(0.0, t[1:n, 0] - t[0, 0])).max())
            run = (run[:, None] + t[1:n, 1:] - t[0, 0]).max(axis=0) + word
        self.safe, self.slack = bool(best < 0 and run.max() < best), float(best)

    def _emit(self, shapes: list[str]) -> np.ndarray:
        """Label scores of each word: cached for what depends on the word, plus its neighbours' parts."""
        own = []
        for s in shapes:
            v = self.emission.get(s)
            if v is None:
                if len(self.emission) > 50_000:
                    self.emission.clear()
                v = self.emission[s] = self.w[[k for k in map(self.names.get, shape_features(s)) if k is not None]].sum(axis=0)
            own.append(v)
        out = np.array(own)
        around = ["^", *map(coarse, shapes), "$"]
        for i in range(len(shapes)):
            for f in ("before=" + around[i], "after=" + around[i + 2]):
                if (k := self.names.get(f)) is not None:
                    out[i] += self.w[k]
        return out

    def decode(self, segments: list[list[str]]) -> list[np.ndarray]:
        """Best labels of segments of word shapes: Viterbi over all of them at once, longest first."""
        segments = [s for s in segments]
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(segments)
        order = [i for i in order if segments[i]]
        if not order:
            return out
        n, t = len(LABELS), self.t + self.bar
        size = np.array([len(segments[i]) for i in order])
        first = np.concatenate(([0], np.cumsum(size)))
        e = np.concatenate([self._emit(segments[i]) for i in order])
        back = np.zeros((len(e), n), np.int8)
        score = e[first[:-1]] + t[n]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # segments with more than k words
        for k in range(1, size[0]):
            c = active[k]
            step = score[:c, :, None] + t[None, :n]
            at = first[:c] + k
            back[at] = step.argmax(axis=1)
            score[:c] = step.max(axis=1) + e[at]
        for j, i in enumerate(order):
            y = np.zeros(size[j], int)
            y[-1] = score[j].argmax()
            for k in range(size[j] - 1, 0, -1):
                y[k - 1] = back[first[j] + k, y[k]]
            out[i] = y
        return out


def shape_of(word: str) -> str:
    return classes_of(word).decode("latin-1")


@lru_cache(1)
def field() -> Field:
    """The field trained from the table; training is deterministic."""
    return Field()


_ends = frozenset(b".!?")
_trim_left, _trim_right = "\"'([<{", "\"'.,;:!?)]}>"


def field_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, str]]]:
    """Spans that the field finds in each whole text, by start."""
    segments, origin = [], []
    for k, text in enumerate(texts):
        if not text or (model.safe and not _mark.search(text) and not _long.search(text)):
            continue
        raw, starts, ends = words_of(text)
        if not len(starts):
            continue
        b = np.frombuffer(raw, np.uint8)
        # a segment ends after a word that closes a sentence, and at line ends
        lines = np.concatenate(([0], np.cumsum(b == 10)))[starts]
        close = np.isin(b[ends - 1], (46, 33, 63)) | np.append(lines[1:] != lines[:-1], True)
        close[-1] = True
        seg = np.concatenate(([0], np.cumsum(close)[:-1]))
        if model.safe:
            marked = np.searchsorted(starts, np.flatnonzero((b == 48) | (b == 64)), "right") - 1
            wanted = np.unique(seg[np.concatenate((marked, np.flatnonzero(ends - starts >= LONG)))])
        else:
            wanted = np.unique(seg)
        lo, hi = np.searchsorted(seg, wanted), np.searchsorted(seg, wanted, "right")
        for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
            segments.append([raw[s:t].decode("latin-1") for s, t in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)])
            origin.append((k, starts[a:z], ends[a:z]))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (k, starts, ends), labels in zip(origin, model.decode(segments), strict=True):
        i = 0
        while i < len(labels):
            if labels[i] == 0:
                i += 1
                continue
            kind, j = KINDS[(labels[i] - 1) // 2], i + 1
            while j < len(labels) and labels[j] == labels[i] + labels[i] % 2:
                j += 1
            a, z = int(starts[i]), int(ends[j - 1])
            while a < z and texts[k][a] in _trim_left and not (kind == "phone" and texts[k][a] == "("):
                a += 1
            while z > a and texts[k][z - 1] in _trim_right:
                z -= 1
            if z > a:
                out[k].append((a, z, kind))
            i = j
    return out


def merged(base: list[tuple[int, int, str]], added: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and those added ones that touch none of them, by start and the order of kinds."""
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    reach, far = [], 0
    for _, b in taken:
        far = max(far, b)
        reach.append(far)
    free = []
    for a, b, kind in added:
        i = int(np.searchsorted(starts, b, "left"))
        if not i or reach[i - 1] <= a:
            free.append((a, b, kind))
    return sorted([*base, *free], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True, mask: bool = False) -> DataFrame:
    """Append base_spans and spans, arrays of (start, end, kind) in code points, end exclusive.

    With ``mask`` the text itself is returned with every span replaced by its kind in angle brackets.  Null and empty
    texts have no spans; equal texts get equal spans; input columns with an output's name are replaced.
    """
    prepare(docs.sparkSession)
    docs = without(docs, "base_spans", "spans")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("kind", T.StringType(), False)]), False)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("base_spans", span, False), T.StructField("spans", span, False)])
    target = arrow_schema(schema)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field())
    keep = [(docs.columns.index(c), c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            base = [base_spans(t) for t in texts]
            every = [merged(b, f) for b, f in zip(base, field_spans(texts, model), strict=True)]
            as_rows = lambda found: [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]
            columns = [pa.array([masked(t, s) for t, s in zip(texts, every, strict=True)], target.field(c).type) if mask and i == at else batch.column(i) for i, c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(as_rows(base), target.field("base_spans").type), pa.array(as_rows(every), target.field("spans").type)], schema=target)

    return docs.mapInArrow(run, schema)


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced; of spans that overlap, the union is replaced once, by the first one's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
