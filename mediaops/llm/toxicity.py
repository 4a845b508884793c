"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Only whole documents are labelled, so tokens get their labels first: a feature (a word, or its first letters)
that marks many toxic and hardly any clean documents labels its tokens in toxic documents. The field has two
states and hashed word features; forward-backward marginals give the offending words with their offsets, and
two sums over a document's marginals, calibrated on the labels, its score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import release, slices, whole

# Labelled documents the model is fitted on, at most this many of each label.
FIT_TOXIC, FIT_CLEAN = 1000, 2000
# A feature labels tokens if it is this many times likelier in toxic documents and explains this share of them.
RATIO, SHARE = 30.0, 0.01
THRESHOLD = 0.7
SPACE = 1 << 18
_MARKS = 1 << 22
_CHAIN = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_KNOWN = 200_000
# So many features of words are summed at a time, and so many documents calibrated on.
_PIECE, _DOCUMENTS = 1 << 18, 128


def features(word: str) -> list[int]:
    """Hashed: the word, its first three to six letters, its last three."""
    found = ["=" + word, *(word[:k] for k in range(3, 7) if len(word) >= k), "$" + word[-3:]]
    return [zlib.crc32(f.encode()) % SPACE for f in found]


def _marks(word: str) -> list[int]:
    """Hashed, in a space of their own: the word and its first three to six letters."""
    return [zlib.crc32(f.encode()) % _MARKS for f in ("=" + word, *(word[:k] for k in range(3, 7) if len(word) >= k))]


@dataclass
class Field:
    """States 0 (clean) and 1 (toxic). ``weights`` and ``bias`` are the score of state 1 over 0; moves[i, j]: i to j."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SPACE, np.float32))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def score(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        if len(known) > _KNOWN:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            found = [features(w) for w in new]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = self.weights[np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))]
            sums = np.add.reduceat(flat, np.cumsum(sizes) - sizes) + self.bias
            known.update(zip(new, sums.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, unary: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all chains at once, longest first: log odds of state 1, and both ratios they are made of.

        ``bounds`` are the chains' starts and the end. The forward ratio at a token is that of state 1 to state 0
        over all labellings of what stands before it, the backward ratio over what stands behind.
        """
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        m = np.exp(self.moves)
        odds = np.exp(np.clip(unary, -30, 30))
        before, behind = np.ones(len(unary)), np.ones(len(unary))
        for step in range(1, len(live)):
            at = start[: live[step]] + step
            r = before[at - 1] * odds[at - 1]
            before[at] = (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        for step in range(1, len(live)):
            at = start[: live[step]] + size[: live[step]] - 1 - step
            r = behind[at + 1] * odds[at + 1]
            behind[at] = (m[1, 0] + r * m[1, 1]) / (m[0, 0] + r * m[0, 1])
        return np.log(before) + np.clip(unary, -30, 30) + np.log(behind), before, behind


def _tokens(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words, and the number of words of each chain (sentence)."""
    words: list[str] = []
    sizes = []
    for sentence in _CHAIN.findall(_lower(text)):
        own = _WORD.findall(sentence)
        if own:
            words += own
            sizes.append(len(own))
    return words, sizes


def _sums(odds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the largest log odds, and the logarithm of one plus the expected number of toxic words."""
    start = np.r_[0, ends[:-1]]
    most, many = np.full(len(ends), -12.0), np.zeros(len(ends))
    full = ends > start
    if full.any():
        most[full] = np.maximum.reduceat(odds, start[full])
        many[full] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-odds)), start[full]))
    return np.clip(most, -12, 12), many


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return w


def label_tokens(texts: list[str], toxic: np.ndarray) -> set[int]:
    """The marks whose tokens in toxic documents count as toxic.

    All that are likely enough in toxic documents and common among them; then rarer ones, by odds, as long as they
    explain documents that the others don't.
    """
    each = [np.unique([f for w in set(_WORD.findall(_lower(t))) for f in _marks(w)]).astype(np.int32) for t in texts]
    n = np.bincount(toxic, minlength=2)

    def count(label: int) -> np.ndarray:
        return np.bincount(np.concatenate([e for e, k in zip(each, toxic, strict=True) if k == label]), minlength=_MARKS)

    bad = count(1)
    often = np.flatnonzero(bad >= max(2, SHARE * n[1]))
    bad = bad[often]
    odds = (bad + 0.5) / (n[1] + 1) * (n[0] + 1) / (count(0)[often] + 0.5)
    common = often[(odds >= RATIO) & (bad >= max(4, 2 * SHARE * n[1]))]
    chosen: set[int] = set(common.tolist())
    left = [e for e, y in zip(each, toxic, strict=True) if y and not np.isin(e, common, assume_unique=True).any()]
    for f in often[np.lexsort((often, -odds))][: int((odds >= RATIO).sum())].tolist():
        rest = [e for e in left if (k := np.searchsorted(e, f)) == len(e) or e[k] != f]
        if len(left) - len(rest) >= max(2, SHARE * n[1]):
            chosen.add(f)
            left = rest
    return chosen


def _added(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """At each place in ``to``: the sum of its ``values[of]``, added in their order, some at a time as the driver's memory is small."""
    out = np.zeros(size)
    for at in range(0, len(to), _PIECE):
        np.add.at(out, to[at : at + _PIECE], values[of[at : at + _PIECE]].astype(np.float64))
    return out


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 40) -> Field:
    """A field fitted by gradient steps on the chains' likelihood, then the calibration. One label alone: its rate."""
    model = Field()
    n = np.bincount(toxic, minlength=2)
    if not n.all():
        model.calibration = (float(np.log((n[1] + 0.5) / (n[0] + 0.5))), 0.0, 0.0)
        return model
    chosen = label_tokens(texts, toxic)
    words, sizes, ends, n_chains, keep_sizes, keep_words, keep_tags = [], [], [], [], [], [], []
    pool: dict[str, str] = {}  # one object for each distinct word
    for number, (text, y) in enumerate(zip(texts, toxic, strict=True)):
        own, own_sizes = _tokens(text)
        own = [pool.setdefault(w, w) for w in own]
        marked = [int(bool(y) and not chosen.isdisjoint(_marks(w))) for w in own]
        words += own
        sizes += own_sizes
        ends.append(len(words))
        n_chains.append(len(own_sizes))
        at = 0
        for k, size in enumerate(own_sizes):  # all chains with a toxic word, and some of the others
            if any(marked[at : at + size]) or (k + number) % 6 == 0:
                keep_words += own[at : at + size]
                keep_tags += marked[at : at + size]
                keep_sizes.append(size)
            at += size
    y = np.array(keep_tags, np.float64)
    bounds = np.r_[0, np.cumsum(keep_sizes)].astype(np.int64)
    shared = {w: features(w) for w in set(keep_words)}
    count = np.fromiter((len(shared[w]) for w in keep_words), np.int64, len(keep_words))
    rows = np.repeat(np.arange(len(keep_words), dtype=np.int32), count)
    cols = np.fromiter((i for w in keep_words for i in shared[w]), np.int32, len(rows))
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False  # not the first of its chain
    after = np.flatnonzero(inner)
    square, move_square, bias_square = np.full(SPACE, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(epochs):
        unary = _added(rows, cols, model.weights, len(y)) + model.bias
        odds, before, behind = model.marginals(unary, bounds)
        p = _sigmoid(odds)
        slope = _added(cols, rows, y - p, SPACE) - 1e-3 * model.weights
        square += slope**2
        model.weights += (0.5 * slope / np.sqrt(square)).astype(np.float32)
        bias_slope = float((y - p).sum())
        bias_square += bias_slope**2
        model.bias += 0.5 * bias_slope / bias_square**0.5
        left = before[after - 1] * np.exp(np.clip(unary[after - 1], -30, 30))
        right = behind[after] * np.exp(np.clip(unary[after], -30, 30))
        m = np.exp(model.moves)
        pair = np.stack([m[0, 0] + 0 * left, m[0, 1] * right, m[1, 0] * left, m[1, 1] * left * right])
        pair /= pair.sum(axis=0)
        a, b = y[after - 1], y[after]
        gold = np.array([((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])
        move_slope = (gold - pair.sum(axis=1)).reshape(2, 2)
        move_square += move_slope**2
        model.moves += 0.1 * move_slope / np.sqrt(move_square)
    del rows, cols, shared, count, keep_words, keep_tags
    known: dict[str, float] = {}
    found = []
    at = chain = 0
    for k in range(0, len(ends), _DOCUMENTS):
        part = np.array(ends[k : k + _DOCUMENTS], np.int64)
        chains = np.r_[0, np.cumsum(sizes[chain : chain + sum(n_chains[k : k + _DOCUMENTS])])].astype(np.int64)
        odds, _, _ = model.marginals(model.score(words[at : part[-1]], known), chains)
        found.append(np.c_[_sums(odds, part - at)])
        at, chain = part[-1], chain + len(chains) - 1
    w = _logistic(np.concatenate(found), toxic.astype(np.float64))
    model.calibration = tuple(map(float, w))
    return model


def held_out(doc_id="doc_id"):
    """Every third document, by the CRC-32 of its id as text, is kept from fitting; a null id isn't."""
    text = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a sample of documents with a label that aren't held out: at most FIT_TOXIC and FIT_CLEAN, by hash of their ids."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out())
    parts = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    rows = rows.join(F.broadcast(parts[0].union(parts[1])), "doc_id").toLocalIterator()
    sample: dict[str, int] = {}
    for r in rows:  # one of equal texts, toxic if any is
        if len(r.text) <= _LONGEST:
            sample[r.text] = max(r.toxic, sample.get(r.text, 0))
    texts = sorted(sample)
    model = fit(texts, np.array([sample[t] for t in texts], np.int64).reshape(-1))
    del rows, sample, texts
    release()
    return model


# Longer documents aren't used for fitting; they are scored like any other.
_LONGEST = 20_000


def judge(model: Field, texts: list[str], known: dict[str, float]) -> tuple[np.ndarray, ...]:
    """Scores of the texts; log odds of all their words; where each text's words begin and end."""
    words, sizes, ends = [], [], []
    for text in texts:
        own, own_sizes = _tokens(text)
        words += own
        sizes += own_sizes
        ends.append(len(words))
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    odds, _, _ = model.marginals(model.score(words, known), bounds)
    cut = np.array(ends, np.int64)
    base, most, many = model.calibration
    sums = _sums(odds, cut)
    return _sigmoid(base + most * sums[0] + many * sums[1]), odds, np.r_[0, cut[:-1]], cut


def score(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, predicted, n_toxic, spans) of every row of ``docs`` (doc_id, text).

    ``spans`` lists start:end, in code points, of the words likelier toxic than not. A null text is empty; an empty
    text has the score of the calibration alone; null and repeated ids stay rows; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            out, odds, first, cut = judge(model, texts, known)
            bad = np.flatnonzero(odds > 0)
            spans = [""] * len(texts)
            count = np.searchsorted(bad, cut) - np.searchsorted(bad, first)
            for doc in np.flatnonzero(count):
                own = set((bad[np.searchsorted(bad, first[doc]) :][: count[doc]] - first[doc]).tolist())
                places = (m for s in _CHAIN.finditer(_lower(texts[doc])) for m in _WORD.finditer(s.string, *s.span()))
                spans[doc] = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(places) if k in own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(out),
                    pa.array((out >= THRESHOLD).astype(np.int32)),
                    pa.array(count),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", "score", "predicted", "n_toxic", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_toxic long, spans string")


def _lower(text: str) -> str:
    """Lower case with as many code points: the few letters that grow stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def keep_clean(docs: DataFrame, model: Field) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores THRESHOLD or more."""
    rows = docs.withColumn("_llm_text", whole())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in slices(batches, "_llm_text"):
            texts = batch.column(batch.schema.get_field_index("_llm_text")).to_pylist()
            out, _, _, _ = judge(model, texts, known)
            yield batch.filter(pa.array(out < THRESHOLD))

    return rows.mapInArrow(run, rows.schema).drop("_llm_text")
