"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds to them.

Text around digits and at signs is cut into regions of neighbouring tokens. Every stretch of at most ``LONGEST``
tokens is a candidate segment, scored as a whole (its shape, digit groups, checksums, the word before), and
dynamic programming over the region chooses boundaries and kinds together. The field is fitted to the spans of the
patterns in a sample, and to the same spans written in ways the patterns don't know.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import slices, whole

KINDS = ("email", "ip", "card", "phone")
# Patterns of the base spans: fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same matches in time proportional to the text: no run of letters or digits is tried from each of its places.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

# Documents the field is fitted on, at most, and tokens of a segment, at most.
FIT_DOCS = 1500
LONGEST = 6
SPACE = 1 << 16
_HIT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _bare(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of EMAIL's matches: the name is what stands before an at sign, back to the match before."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches that hold, in this order."""
    found = []
    found += [(start, 0, end) for start, end in emails(text)]
    if _HIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _FOUR.finditer(text) if octets(m[0])]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _bare(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_bare(m[0])) <= 15]
    return sorted(found)


def regions(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(word before, tokens) of the runs of tokens with a digit or at sign, one white space apart, within a line."""
    found = []
    start = 0
    hit = _HIT.search(text)
    while hit:
        start = text.rfind("\n", 0, hit.start()) + 1
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        before, run = "", []
        for m in _TOKEN.finditer(text, start, end):
            if _HIT.search(text, *m.span()):
                if run and m.start() - run[-1][1] > 1:
                    found.append((before, run))
                    before, run = "", []
                run.append(m.span())
            else:
                if run:
                    found.append((before, run))
                before, run = m[0].lower().strip(".,;:()"), []
        if run:
            found.append((before, run))
        hit = _HIT.search(text, end)
    return found


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch without the marks that only surround it."""
    lone = text.find(")", start, end) < 0
    while start < end and (text[start] in "\"'<[{,;:=" or text[start] == "(" and lone):
        start += 1
    lone = text.find("(", start, end) < 0
    while end > start and (text[end - 1] in ".,;:!?\"'>]}" or text[end - 1] == ")" and lone):
        end -= 1
    return start, end


def possible(text: str) -> list[int]:
    """The kinds a candidate may be: what no weights can make it."""
    digits, letters = len(_bare(text)), re.search(r"[^\W\d_]", text)
    allowed = ("@" in text and letters, not letters and len(_DIGITS.findall(text)) == 4, 12 <= digits <= 19, 7 <= digits <= 15)
    return [k for k, ok in enumerate(allowed) if ok and (k < 2 or not letters and "@" not in text)]


def segment_features(text: str, before: str, tokens: int) -> list[str]:
    """Of a whole candidate, for any kind."""
    groups = _DIGITS.findall(text)
    digits = "".join(groups)
    n = len(digits)
    shape = re.sub(r"[^\W\d_]+", "a", _DIGITS.sub("9", text))[:24]
    sizes = "|".join(str(min(len(g), 9)) for g in groups[-6:])
    card = 12 <= n <= 19
    return [
        "bias",
        "shape " + shape,
        "sizes " + sizes,
        "last " + "|".join(sizes.split("|")[-3:]),
        f"digits {min(n, 24)}",
        f"tokens {tokens}",
        f"at {text.count('@')} {bool(re.search('[a-zA-Z]', text))}",
        f"dotted {EMAIL.fullmatch(text) is not None} {IP.fullmatch(text) is not None and octets(text)}",
        f"sum {card and luhn(digits)} {card}",
        f"plus {text[:1] == '+'} {9 <= n <= 15} {'(' in text}",
        "marks " + "".join(sorted(set(re.sub(r"[\w]", "", text))))[:12],
        "before " + before[:12],
    ]


def _hashed(found: list[str], kind: int) -> list[int]:
    return [zlib.crc32(f"{kind} {f}".encode()) % SPACE for f in found]


def candidate(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[int, int] | None:
    """The span of tokens i to j - 1, if its first and last token still stand in it."""
    start, end = trimmed(text, tokens[i][0], tokens[j - 1][1])
    return (start, end) if start < min(end, tokens[i][1]) and end > tokens[j - 1][0] else None


def decode(text: str, before: str, tokens: list[tuple[int, int]], weights: list[float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation of a region; tokens outside of segments score nothing."""
    top, back = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        best, chosen = top[j - 1], None
        for i in range(max(0, j - LONGEST), j):
            span = candidate(text, tokens, i, j)
            if span and (kinds := possible(text[span[0] : span[1]])):
                own = segment_features(text[span[0] : span[1]], before if i == 0 else "", j - i)
                for kind in kinds:
                    score = top[i] + sum(weights[f] for f in _hashed(own, kind))
                    if score > best:
                        best, chosen = score, (i, span, kind)
        top.append(best)
        back.append(chosen)
    found, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            j, span, kind = back[j]
            found.append((span[0], kind, span[1]))
    return found[::-1]


class Region:
    """Candidates of one region: (first token, past the last, features by kind)."""

    def __init__(self, text: str, before: str, tokens: list[tuple[int, int]]):
        self.n, self.spans, self.cells = len(tokens), [], []
        for i in range(self.n):
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                span = candidate(text, tokens, i, j)
                if span and (kinds := possible(text[span[0] : span[1]])):
                    own = segment_features(text[span[0] : span[1]], before if i == 0 else "", j - i)
                    self.spans.append(span)
                    self.cells.append((i, j, {k: _hashed(own, k) for k in kinds}))

    def scores(self, weights) -> list[tuple[int, int, dict[int, float]]]:
        return [(i, j, {k: sum(weights[f] for f in own) for k, own in kinds.items()}) for i, j, kinds in self.cells]

    def slope(self, weights, gold: set[tuple[int, int]]) -> dict[int, float]:
        """Of the likelihood of ``gold`` (candidate, kind): counts in it less those expected."""
        scored = self.scores(weights)
        ahead, behind = [0.0] + [-1e30] * self.n, [-1e30] * self.n + [0.0]
        for j in range(1, self.n + 1):
            own = [ahead[j - 1], *(ahead[i] + s for i, k, x in scored if k == j for s in x.values())]
            ahead[j] = _logsum(own)
        for i in range(self.n - 1, -1, -1):
            own = [behind[i + 1], *(behind[j] + s for k, j, x in scored if k == i for s in x.values())]
            behind[i] = _logsum(own)
        out: dict[int, float] = {}
        for c, (i, j, x) in enumerate(scored):
            for kind, s in x.items():
                d = ((c, kind) in gold) - float(np.exp(ahead[i] + s + behind[j] - ahead[self.n]))
                if abs(d) > 1e-4:
                    for f in self.cells[c][2][kind]:
                        out[f] = out.get(f, 0.0) + d
        return out


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + float(np.log(sum(np.exp(v - top) for v in x)))


def _otherwise(text: str, kind: int) -> str:
    """The same datum written as the patterns don't know it."""
    if kind == 3:
        return re.sub(r"^\+[0-9]{1,3}[ .-]*", "", text)
    if kind == 2:
        digits = _bare(text)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return text


def _golden(text: str, before: str, tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]):
    """The region and its gold segments, or nothing where a base span is no candidate."""
    own = Region(text, before, tokens)
    want = [(s, k, e) for s, k, e in base if s >= tokens[0][0] and e <= tokens[-1][1]]
    gold = {(c, k) for s, k, e in want if (s, e) in own.spans for c in [own.spans.index((s, e))] if k in own.cells[c][2]}
    return (own, gold) if len(gold) == len(want) else None


def fit(texts: list[str], epochs: int = 6) -> np.ndarray:
    """Weights by gradient steps, region by region. No text with a region: no span is ever added."""
    rng, examples = random.Random(42), []
    for text in texts:
        base = base_spans(text)
        for before, tokens in regions(text):
            tokens = tokens[:40]
            if found := _golden(text, before, tokens, base):
                examples.append(found)
            start, end = tokens[0][0], tokens[-1][1]
            for s, k, e in base:
                if start <= s and e <= end and (other := _otherwise(text[s:e], k)) != text[s:e]:
                    line = before + " " + other
                    at = len(before) + 1
                    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(line, at)]
                    if found := _golden(line, before, spans, [(at, k, len(line))]):
                        examples.append(found)
    weights, square = np.zeros(SPACE), np.full(SPACE, 1e-8)
    weights[_hashed(["bias"], 0) + _hashed(["bias"], 1) + _hashed(["bias"], 2) + _hashed(["bias"], 3)] = -2.0
    for _ in range(epochs if any(gold for _, gold in examples) else 0):
        rng.shuffle(examples)
        for own, gold in examples:
            for f, d in own.slope(weights, gold).items():
                square[f] += d * d
                weights[f] += 0.3 * d / square[f] ** 0.5
    return weights


def train(docs: DataFrame) -> np.ndarray:
    """Fit on at most FIT_DOCS texts with a digit or at sign, shorter than 20,000 characters, by hash of the text."""
    rows = docs.select(whole().alias("text")).where("text rlike '[0-9@]' and length(text) < 20000")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # the texts' hashes alone are ordered; only the chosen texts move, each once however often it occurs
    last = rows.select("h").distinct().orderBy("h").limit(FIT_DOCS).agg(F.max("h")).first()[0]
    return fit(sorted({r.text for r in rows.where(F.col("h") <= last).select("text").distinct().toLocalIterator()}) if last is not None else [])


def _apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that overlap no base span; both are in order of their starts."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out = []
    for x in more:
        k = bisect_left(starts, x[2])
        if not k or reach[k - 1] <= x[0]:
            out.append(x)
    return out


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Personal data in every row of ``docs`` (doc_id, text).

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the patterns' spans; all
    spans, the field's that don't touch a base span included, as kind:start:end in code points, by start and
    then kind. A null text is empty; null and repeated ids stay rows; no rows give none; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.tolist()
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base, more = base_spans(text), []
                for before, tokens in regions(text):
                    more += decode(text, before, tokens, weights)
                taken = _apart(more, base)
                count = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                digest = hashlib.sha256(line(base).encode()).hexdigest()
                out.append((*count, digest, line(sorted(base + taken))))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)
