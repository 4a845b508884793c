"""SentencePiece ids of texts and texts of ids, by a Viterbi search that words with a common prefix share.

A text becomes words marked by the space before them. The distinct words of a batch, sorted, are the paths of a
trie; going from one to the next keeps the search's states for the letters they share and computes the rest. The
state of a prefix is its best segmentation's last piece. For unigram models best is the largest sum of scores.
A merge model allows one segmentation of every prefix: the one in which no two neighbours would have been merged
otherwise, so there the last piece is the one that may follow the state where it starts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import release, slices, whole

SPACE = "▁"
# Words a task keeps, twice, and pairs: memory against time, results are the same.
KNOWN, _PAIRS = 350_000, 500_000


class Pieces:
    """A model's pieces with their scores, and the search over them."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, merges: bool):
        """``scores``: id and score of the ordinary pieces; ``byte_ids``: of the 256 bytes, or none."""
        self.ids = {p: i for p, (i, _) in scores.items()}
        self.rank = {p: s for p, (_, s) in scores.items()}
        self.bytes, self.unknown, self.merges = byte_ids, unknown, merges
        # What each id stands for; other ids for the sign of the unknown.
        self.names = [" ⁇ ".encode()] * (1 + max([unknown, *byte_ids, *self.ids.values()], default=0))
        for p, i in self.ids.items():
            self.names[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.names[i] = bytes([b])
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-2:], {1}).add(len(p))
            if len(p) == 1:
                lengths.setdefault(p, {1})
        # By a piece's last two letters: the lengths there are, longest first.
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in lengths.items()}
        self.least = min((s for s in self.rank.values()), default=0.0) - 10
        self.whole = {p for p in scores if not merges or self.merged(p) == [p]}
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.keep, self.pairs = KNOWN, _PAIRS
        # Words end where no piece goes on: before a mark, around line ends, and between a letter and a sign.
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        after = {m[1] for p in scores for m in re.finditer(r"(?<=[^\W\d_])([^\w\s])", p)}
        signs = "".join(re.escape(c) for c in ".,;:!?)\"'-" if c not in after)
        no = f"[^{SPACE}\n{signs}]*"
        rest = f"{no}(?:(?<![^\\W\\d_])[{signs}]{no})*" if signs else no
        lines = any("\n" in p for p in scores)
        pattern = ".+" if inside or lines else f"\n|{SPACE}+{rest}|[^{SPACE}\n]{rest}"
        self.words = re.compile(pattern, re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """Pairs merged by score, the leftmost of the best first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(self.rank.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            pairs = [p for p in pairs if p[0] is not None]
            if not pairs:
                break
            at = -max(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        found = self.follows.get((left, right))
        if found is None:
            if len(self.follows) > self.pairs:
                self.follows.clear()
            found = self.follows[left, right] = self.merged(left + right) == [left, right]
        return found

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the sorted distinct ``words`` with its pieces; states of common prefixes are kept."""
        last: list[str] = [""]  # by prefix length: the best segmentation's last piece
        score: list[float] = [0.0]
        before = ""
        lengths, fit, follows, may_follow, merges = self.lengths, self.whole, self.follows, self.may_follow, self.merges
        for word in words:
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            letters = len(word)
            for end in range(shared + 1, letters + 1):
                best, chosen = -1e300, None
                for size in lengths.get(word[end - 2 if end > 1 else 0 : end], (1,)):
                    if size > end:
                        continue
                    start = end - size
                    piece = word[start:end]
                    if merges:
                        if (size == 1 or piece in fit) and (not start or follows.get((last[start], piece)) or may_follow(last[start], piece)):
                            best, chosen = 0.0, piece
                            break
                    else:
                        own = self.rank.get(piece, self.least if size == 1 else None)
                        if own is not None and score[start] + own > best:
                            best, chosen = score[start] + own, piece
                if chosen is None:
                    raise ValueError(f"no segmentation of {word[:end]!r}")
                last.append(chosen)
                if not merges:
                    score.append(best)
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(parts[-1])
            yield word, parts[::-1]
            before = word

    def _numbers(self, parts: list[str]) -> bytes:
        out = array("i")
        for p in parts:
            own = self.ids.get(p)
            if own is not None:
                out.append(own)
            elif self.bytes:
                out.extend([self.bytes[b] for b in p.encode()])
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty one has none."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {w for words in split for w in words}.difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        known.update((word, self._numbers(parts)) for word, parts in self.segment(sorted(new - again)))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def forget(self) -> None:
        self.known, self.older, self.follows = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        """The text: pieces put together, marks turned to spaces, the first one dropped; bytes as UTF-8."""
        text = b"".join(map(self.names.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def load(path: str, merges: bool = True) -> Pieces:
    """The model file's pieces. Only models that leave the text as it is but for a space before it are right here."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    probe = model.decode(model.encode("a  ﬁ b "))
    if probe != "a  ﬁ b ":
        raise ValueError("a model that changes texts before it encodes them isn't supported")
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
    return Pieces(scores, [i for i in range(n) if model.is_byte(i)], model.unk_id(), merges)


def encode(docs: DataFrame, path: str, merges: bool = True, keep: int = KNOWN, lasting: bool = True) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids, ids_crc32, same) of every row of ``docs`` (doc_id, text).

    ``same``: the ids decode to the text. ids_crc32 is that of the ids as little-endian unsigned 32-bit integers.
    A text that starts with the mark itself, or holds it, decodes to a space there. Null texts are empty and have
    no ids; null and repeated ids stay rows; no rows give none; other columns are not read.
    A worker keeps ``keep`` words at a time, twice, and up to twice as many pairs; from task to task if ``lasting``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, merges)
        model.keep, model.pairs = keep, min(_PAIRS, 2 * keep)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = model.encode(texts)
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            same = [model.decode(ids.tolist()) == t for ids, t in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat)),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                    pa.array(same),
                ],
                ["doc_id", "n_chars", "n_pieces", "ids", "ids_crc32", "same"],
            )
        if not lasting:
            model.forget()
            release()

    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    schema = "doc_id long, n_chars long, n_pieces long, ids array<int>, ids_crc32 long, same boolean"
    return rows.mapInArrow(run, schema)
