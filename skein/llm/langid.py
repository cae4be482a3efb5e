"""Language identification by interpolated Kneser-Ney character models.

One model per language, over letters (lower-cased) and a single mark for any run of
other characters.  The models are fitted on a bounded sample of labelled documents and
stored in sorted hash arrays with one column of log probabilities per language, a
bounded number of languages to a set; every label is learned, in as many sets as it
takes.  A text goes to the language of lowest cross-entropy per character, and is
rejected where that entropy lies above what documents of the language that were held
out of a first fit have, by a margin that is wider for short texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches
from . import _bytes as B

#: The sample: documents of a language and of all languages together (one a language at least); longer ones (in characters) are
#: taken only where a language has no others.
FIT_DOCS, FIT_ALL, FIT_CHARS = 400, 25_600, 100_000
#: Languages of one set of models.
LANGUAGES = 64
#: Rejection: entropies may lie MARGIN above the median of held-out documents, as a share of it, and SPREAD times the
#: dispersion per symbol (the median of deviations times the root of the length) over the root of the text's length.
#: Medians, as a few wrong labels must not lift the limit.
MARGIN, SPREAD, HELD_OUT = 0.4, 9.0, 4
#: Bytes of a text that are scored at once; longer texts are scored in pieces.
PIECE = 1 << 20
ORDER = 4
UNDETERMINED = "und"
DISCOUNT = 0.75
#: Characters outside the alphabet of the sample.
_SPACE, _OTHER = 0, 1


def _alphabet_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code point, and whether it is a letter, for the basic plane."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return lower, np.array([c.isalpha() for c in chars])


class Symbols:
    """Texts as symbols: 0 for a run of non-letters, 1 for letters not in the sample, then the letters."""

    def __init__(self, letters: np.ndarray):
        lower, alpha = _alphabet_tables()
        number = np.full(1 << 16, _OTHER, np.uint16)
        number[letters] = np.arange(2, len(letters) + 2)
        self.table = np.where(alpha, number[np.minimum(lower, 0xFFFF)], _SPACE).astype(np.uint16)

    @staticmethod
    def letters_of(text: str) -> np.ndarray:
        return np.unique([ord(c) for c in set(text.lower()) if c.isalpha() and ord(c) < 1 << 16]).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, start of each text, letters of each text); a text starts and ends with 0."""
        counts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        s = np.zeros(len(points) + len(offsets), np.uint16)
        starts = counts + np.arange(len(offsets))
        text = np.ones(len(s), bool)
        text[starts] = False
        low = self.table[np.minimum(points, 0xFFFF)]
        astral = np.flatnonzero(points > 0xFFFF)
        for i in astral:
            low[i] = _OTHER if chr(points[i]).isalpha() else _SPACE
        s[text] = low
        keep = s != _SPACE
        again = np.ones(len(s), bool)
        again[1:] = keep[:-1]
        again[starts] = True
        keep |= again
        place = np.concatenate([[0], np.cumsum(keep)])
        letters = np.concatenate([[0], np.cumsum(s != _SPACE)])
        return s[keep], place[starts], letters[starts[1:]] - letters[starts[:-1]]


class SortedHash:
    """Sorted keys with a row of values each; a first-level index by the hash's top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = B.mixed(keys * B.STEP)
        order = np.argsort(h)
        self.hash, self.values = h[order], np.ascontiguousarray(values[order])
        self.bits = max(4, int(len(h)).bit_length() + 1)
        tops = (self.hash >> B.U64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(h) else 0

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not held."""
        h = B.mixed(keys * B.STEP)
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        top = (h >> B.U64(64 - self.bits)).astype(np.int64)
        at = self.first[top]
        last = len(self.hash) - 1
        found = np.minimum(at, last)
        open_ = np.flatnonzero(self.hash[found] < h)
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] += 1
            found[open_] = np.minimum(at[open_], last)
            open_ = open_[(self.hash[found[open_]] < h[open_]) & (at[open_] <= last)]
        return np.where(self.hash[found] == h, found, -1)


class Models:
    """Interpolated Kneser-Ney models of all languages over shared keys."""

    def __init__(self, texts: dict[str, list[str]], symbols: Symbols | None = None):
        self.languages = sorted(texts)
        self.symbols = symbols or Symbols(Symbols.letters_of("".join(t for ts in texts.values() for t in ts)))
        self.size = int(self.symbols.table.max()) + 2
        counts = []
        for language in self.languages:
            raw = [t.encode("utf-8", "replace") for t in texts[language]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            s, starts, _ = self.symbols.encode(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
            counts.append(np.unique(self._keys(s, ORDER), return_counts=True))
        self._fit(counts)

    @staticmethod
    def _keys(s: np.ndarray, n: int) -> np.ndarray:
        """n-grams as numbers of 16 bits a symbol, each ending at its position; the front is padded with 0."""
        wide = s.astype(B.U64)
        out = np.zeros(len(s), B.U64)
        for back in range(n):
            out[back:] |= wide[: len(wide) - back] << B.U64(16 * back)
        return out

    def _fit(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """P(c | abc) = max(n - D, 0) / N + D * types / N * P(c | bc); lower orders count contexts, not tokens."""
        per_order = []
        for keys, n in counts:
            levels = [(keys, n.astype(np.float64))]
            for order in range(ORDER - 1, 0, -1):
                longer = levels[-1][0]
                short, types = np.unique(longer & B.U64((1 << (16 * order)) - 1), return_counts=True)
                levels.append((short, types.astype(np.float64)))
            per_order.append(levels[::-1])
        width = len(self.languages)
        self.grams, self.backs = [], []
        lower: list[np.ndarray] = []
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([levels[order - 1][0] for levels in per_order]))
            context = keys >> B.U64(16)
            contexts, of = np.unique(context, return_inverse=True)
            p = np.zeros((len(keys), width))
            back = np.ones((len(contexts), width))
            for j, levels in enumerate(per_order):
                own, n = levels[order - 1]
                at = np.searchsorted(keys, own)
                total = np.bincount(of[at], n, len(contexts))
                types = np.bincount(of[at], minlength=len(contexts))
                some = total > 0
                p[at, j] = np.maximum(n - DISCOUNT, 0) / total[of[at]]
                back[some, j] = DISCOUNT * types[some] / total[some]
            if order == 1:
                below = np.full((len(keys), width), 1.0 / (self.size + 1))
            else:
                below = lower[-1][np.searchsorted(self._last, keys & B.U64((1 << (16 * (order - 1))) - 1))]
            p += back[of] * below
            lower.append(p)
            self._last = keys
            self.grams.append(SortedHash(keys, np.log(p).astype(np.float32)))
            self.backs.append(SortedHash(contexts, np.log(back).astype(np.float32)))
        del self._last

    def log_probabilities(self, s: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol given those before it, one column a language."""
        wide = self._keys(s, ORDER)
        out = np.zeros((len(s), len(self.languages)), np.float32)
        open_ = np.arange(len(s))
        for order in range(ORDER, 0, -1):
            key = wide[open_] if order == ORDER else wide[open_] & B.U64((1 << (16 * order)) - 1)
            row = self.grams[order - 1].rows(key)
            hit = row >= 0
            out[open_[hit]] += self.grams[order - 1].values[row[hit]]
            open_, key = open_[~hit], key[~hit]
            if not len(open_):
                return out
            back = self.backs[order - 1].rows(key >> B.U64(16))
            known = back >= 0
            out[open_[known]] += self.backs[order - 1].values[back[known]]
        out[open_] -= np.float32(np.log(self.size + 1))
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per symbol of each text and language, letters of each text, symbols of each text)."""
        s, starts, letters = self.symbols.encode(data, offsets)
        score = self.log_probabilities(s)
        score[starts] = 0  # the mark that opens a text says nothing
        sums = np.add.reduceat(score.astype(np.float64), starts[:-1], axis=0)
        n = np.diff(starts) - 1
        return -sums / np.maximum(n, 1)[:, None], letters, n

    def entropies_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        return self.entropies(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Sharpness of the score and the rejection limits, by documents held out of a first fit.

        A language of which nothing can be held out takes the limits of all the others
        together; where no language has any, the sample's own entropies serve.
        """
        held = {k: t[::HELD_OUT] for k, t in texts.items() if len(t) >= HELD_OUT}
        first = Models({k: [x for i, x in enumerate(t) if k not in held or i % HELD_OUT] for k, t in texts.items()}, self.symbols) if held else self
        rows, truth, sizes = [], [], []
        for j, language in enumerate(self.languages):
            own = (held if held else texts).get(language, [])
            if own:
                h, letters, n = first.entropies_of(own)
                rows.append(h[letters > 0])
                sizes.append(n[letters > 0])
                truth.append(np.full(len(rows[-1]), j))
        h, truth, n = np.concatenate(rows), np.concatenate(truth), np.concatenate(sizes)
        self.sharpness, loss = 1.0, np.inf
        for sharp in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            p = _softmax(h, sharp)[np.arange(len(h)), truth]
            if len(h) and (now := -np.log(np.maximum(p, 1e-12)).mean()) < loss:
                self.sharpness, loss = sharp, now
        own = h[np.arange(len(h)), truth]
        self.level, self.spread = np.empty(len(self.languages)), np.empty(len(self.languages))
        middles = np.array([np.median(own[truth == j]) if (truth == j).any() else 0.0 for j in range(len(self.languages))])
        pooled = np.median(np.abs(own - middles[truth]) * np.sqrt(n)) if len(own) else 0.0
        for j in range(len(self.languages)):
            at = truth == j if (truth == j).any() else np.ones(len(truth), bool)
            middle = np.median(own[at]) if at.any() else np.inf
            deviation = np.abs(own[at] - middle) * np.sqrt(n[at])
            self.level[j] = middle * (1 + MARGIN)
            self.spread[j] = SPREAD * max(pooled, np.median(deviation) if at.any() else 0.0)

    def limits(self, language: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.level[language] + self.spread[language] / np.sqrt(np.maximum(symbols, 1))


def _softmax(h: np.ndarray, sharp: float) -> np.ndarray:
    e = np.exp(-sharp * (h - h.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, fit_docs: int = FIT_DOCS, languages: int = LANGUAGES) -> list[Models]:
    """Sets of models of all labels, from a bounded sample of distinct texts of each (empty: none is labelled)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    pool = slim.where((F.lit(True) if train is None else train) & F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = pool.select("lang", F.xxhash64("text").alias("h"), (F.length("text") > FIT_CHARS).alias("long"))
    labels = max(1, hashed.agg(F.count_distinct("lang")).first()[0])
    most = max(1, min(fit_docs, FIT_ALL // labels))
    order = [F.col("long"), F.col("h")]
    # the least hashes of each of 16 shares of a language, so that no task holds a language; then of their least
    shares = Window.partitionBy("lang", "share").orderBy(*order)
    least = hashed.withColumn("share", F.pmod("h", F.lit(16))).groupBy("lang", "share", "long", "h").agg(F.lit(1)).withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= most)
    chosen = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).select("lang", "h")
    # at most FIT_ALL rows, or one a language
    found = pool.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: (r.lang, r.h)):
        texts.setdefault(row.lang, []).append(row.text)
    if not texts:
        return []
    symbols = Symbols(Symbols.letters_of("".join(set().union(*(set(t) for ts in texts.values() for t in ts)))))
    names, out = sorted(texts), []
    for lo in range(0, len(names), languages):
        own = {k: texts[k] for k in names[lo : lo + languages]}
        models = Models(own, symbols)
        models.calibrate(own)
        out.append(models)
    for models in out:
        models.sharpness = out[0].sharpness
    return out


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, bounds of pieces): rows of at most PIECE bytes together, or one in pieces cut between characters."""
    for lo, hi in B.row_chunks(off, PIECE):
        part = data[off[lo] : off[hi]]
        bounds = off[lo : hi + 1] - off[lo]
        if hi == lo + 1 and len(part) > PIECE:
            cuts = [0]
            while len(part) - cuts[-1] > PIECE:
                at = cuts[-1] + PIECE
                while at > cuts[-1] + PIECE - 4 and part[at] & 0xC0 == 0x80:
                    at -= 1
                cuts.append(at)
            bounds = np.array([*cuts, len(part)], np.int64)
        yield lo, hi, part, bounds


def _entropies(models: Models, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, nats per symbol, letters, symbols) of whole texts, chunk by chunk."""
    for lo, hi, part, bounds in _pieces(data, off):
        if len(bounds) - 1 == hi - lo:
            yield lo, *models.entropies(part, bounds)
            continue
        sums, letters, n = np.zeros((1, len(models.languages))), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            h, more, size = models.entropies(part[a:b], np.array([0, b - a], np.int64))
            sums, letters, n = sums + h * size, letters + more, n + size
        yield lo, sums / np.maximum(n, 1), letters, n


def _predictions(sets: list[Models], column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, language, score, entropy, rejected) chunk by chunk; language -1 is undetermined.

    The sets score a chunk one after another; only the best of each goes on.
    """
    data, off = B.buffer_of(column)
    sharp = sets[0].sharpness
    first = np.cumsum([0, *[len(m.languages) for m in sets]])
    for rows in zip(*(_entropies(m, data, off) for m in sets), strict=True):
        best = own = rest = limit = None
        for k, (m, (lo, h, letters, n)) in enumerate(zip(sets, rows, strict=True)):
            at = h.argmin(axis=1)
            low = h[np.arange(len(h)), at]
            weight = np.log(np.exp(-sharp * (h - low[:, None])).sum(axis=1)) - sharp * low
            if best is None:
                best, own, rest, limit = at, low, weight, m.limits(at, n)
            else:
                less = low < own
                best, own, limit = np.where(less, first[k] + at, best), np.where(less, low, own), np.where(less, m.limits(at, n), limit)
                rest = np.logaddexp(rest, weight)
        none = letters == 0
        score = np.minimum(1.0, np.exp(-sharp * own - rest))
        yield lo, np.where(none, -1, best), np.where(none, 0.0, score), own, none | (own > limit)


def identify(docs: DataFrame, models: list[Models], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language, score, cross-entropy and rejection of every document.

    `und` with score 0 (and rejected) if the text is null, empty or has no letters, or
    if there are no models; of equal languages the first by name; repeated rows each
    give a row.  A text above PIECE bytes is scored piece by piece, each as if it began
    a text.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if not models:
        return slim.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        names = np.array([*(x for m in own for x in m.languages), UNDETERMINED], object)
        for batch in batches:
            for lo, best, score, entropy, rejected in _predictions(own, batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, len(best)), pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def drop_rejected(docs: DataFrame, models: list[Models], *, text: str = "text") -> DataFrame:
    """docs, whole and unchanged, without those whose language is rejected."""
    if not models:
        return docs.where(F.lit(False))
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))
    at = docs.columns.index(text)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in batches:
            parts = [~rejected for *_, rejected in _predictions(own, batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(keep, docs.schema)
