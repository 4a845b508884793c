"""Token ids as canonical, length-limited Huffman code, and back.

A stored table has one row for each run of documents: the code bits, the bit offset of every ``BLOCK``-th id
(checkpoints, so blocks decode independently), and the documents' ids and lengths. The code book is a second
small table of (id, code length); canonical codes follow from the lengths.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise, repeat
from operator import is_, is_not

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from mediaops.llm.common import Stages, slices, whole

LIMIT = 18
BLOCK = 512
RUN = 1 << 20
# Bytes of text whose words are numbered together.
SLICE = 8 << 20
END = 0
# Words a worker keeps, twice: memory against time, results are the same. Longer words aren't kept.
KNOWN, LONG_WORD = 600_000, 64
_IS_WHITE, _IS_SIGN, _IS_LETTER, _IS_DOUBT = 1, 2, 3, 4


# --- ids of a text -------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker, so that its words last from task to task."""
    return Encoder(path)


def _letters() -> np.ndarray:
    """The UTF-16 letter that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    out = np.zeros(256, "<u2")
    out[own] = own
    out[sorted(set(range(256)).difference(own))] = 256 + np.arange(256 - len(own))
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer, on one thread: Spark runs as many tasks as there are cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts; for byte-level vocabularies each distinct word is given to the library once.

    Texts are cut into words by their bytes, and Arrow numbers the distinct ones, so Python sees each once a slice.

    Words begin where the library's own split always begins a piece: with the white space after something else, and
    with a sign after a Latin letter. A white space that not all versions of Unicode call one is no such place.
    Latin letters after one white space are one piece by that split (with the white space, if it is a space), so such
    words go to the library's merges without it.
    """

    _WHITE, _SIGNS = " \t\n\r", ".,;:!?)*#%&$"
    _PLAIN = re.compile("[ \n][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f]+")
    _DOUBT = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"

    def __init__(self, path: str, keep: int = KNOWN):
        self.library, self.keep = tokenizer(path), keep
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splits = self._splits()
        self.letters = _letters()
        self.merges = Tokenizer.from_file(path)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[list(self._WHITE.encode())], self.kinds[list(self._SIGNS.encode())] = _IS_WHITE, _IS_SIGN
        self.kinds[list(string.ascii_letters.encode())] = _IS_LETTER
        doubt = re.findall(f"[{self._DOUBT}]", "".join(map(chr, range(1 << 16))).encode("utf-8", "ignore").decode())
        self.kinds[[ord(x) for x in doubt if x < "\x80"]] = _IS_DOUBT
        self.doubt = np.array([int.from_bytes(x.encode(), "big") for x in doubt if x >= "\x80"], np.int64)
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for piece, i in vocabulary.items():  # a byte-level piece has a letter for each byte
            self.bytes[i] = len(piece)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())

    def _splits(self) -> bool:
        """Whether the library splits texts by its byte-level rule, and no added token holds a place to cut."""
        made = json.loads(self.library.to_str())
        before = made["pre_tokenizer"] or {}
        rule = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        marks = set(self._WHITE + self._SIGNS)
        plain = all(
            not (marks.intersection(t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in made["added_tokens"]
        )
        return bool(rule and plain and made["normalizer"] is None)

    def _pieces(self, plain: list[str]) -> str:
        """The pieces of plain words, a letter for each byte, with spaces between them (no byte has that letter)."""
        text = self.letters[np.frombuffer("".join(plain).encode(), np.uint8)].tobytes().decode("utf-16-le")
        space, line = (chr(self.letters[ord(x)]) for x in " \n")
        return text.replace(space, f" {space}").replace(line, f" {line} ")

    def _learn(self, new: list[str]) -> None:
        # Words that may stand one after the other in one text, as the next one's white space parts them.
        white = tuple(self._WHITE)
        plain = list(filter(self._PLAIN.fullmatch, new)) if self.splits else []
        rest = list(set(new).difference(plain))
        chain = [w for w in rest if w.startswith(white) and ("!" <= w[-1] <= "~" or w[-1].isalnum())] if self.splits else []
        alone = list(set(rest).difference(chain))
        found = self.library.encode_batch_fast([*alone, "".join(chain)], add_special_tokens=False)
        self.known.update((w, array("I", x.ids).tobytes()) for w, x in zip(alone, found, strict=False))
        self._share(chain, found[-1].ids)
        self._share(plain, self.merges.encode_batch_fast([self._pieces(plain)], add_special_tokens=False)[0].ids)

    def _share(self, words: list[str], ids: list[int]) -> None:
        """Know the words by the ids of the text they make."""
        ids = np.array(ids, np.uint32)
        word_ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(), dtype=np.int64)
        cuts = 4 * (np.searchsorted(np.cumsum(self.bytes[ids]), word_ends) + 1)
        data = ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in pairwise([0, *cuts.tolist()])], strict=True))

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Which of the UTF-8 bytes begin a word, by those before them."""
        cut = np.zeros(len(data), bool)
        if not self.splits:
            return cut
        kind = self.kinds[data]
        white = kind == _IS_WHITE
        cut[1:] = white[1:] & ~white[:-1] & (kind[:-1] != _IS_DOUBT) | (kind[1:] == _IS_SIGN) & (kind[:-1] == _IS_LETTER)
        sign = np.flatnonzero((kind[1:] == _IS_SIGN) & (data[:-1] >= 0x80)) + 1
        first, second = data[np.maximum(sign - 2, 0)], data[sign - 1]
        # Letters of two bytes, U+00C0 to U+027F without the signs of times and division.
        cut[sign[(first >= 0xC3) & (first <= 0xC9) & ((first != 0xC3) | (second != 0x97) & (second != 0xB7))]] = True
        far = np.flatnonzero(white[1:] & cut[1:] & (data[:-1] >= 0x80)) + 1
        last = [data[np.maximum(far - k, 0)].astype(np.int64) << 8 * (k - 1) for k in (1, 2, 3)]
        cut[far[np.isin(last[0] | last[1], self.doubt) | np.isin(last[0] | last[1] | last[2], self.doubt)]] = False
        return cut

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Of each text, as unsigned 32-bit integers. Arrow numbers the distinct words of all texts together."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = self._starts(data)
        cut[bounds[bounds < len(data)]] = True
        at = np.flatnonzero(cut)
        edges = np.r_[at, len(data)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        distinct, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        each = list(map(known.get, distinct))
        missing = list(compress(range(len(each)), map(is_, each, repeat(None))))
        absent = [distinct[i] for i in missing]
        before = list(map(older.get, absent))
        known.update(compress(zip(absent, before, strict=True), map(is_not, before, repeat(None))))
        new = list(compress(absent, map(is_, before, repeat(None))))
        if new:
            self._learn(new)
        for i, x in zip(missing, map(known.get, absent), strict=True):
            each[i] = x
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        flat = np.frombuffer(b"".join(each), np.uint32)
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        first, n = (np.cumsum(size) - size)[place], size[place]
        ends = np.r_[0, np.cumsum(n)]
        take = np.repeat(first - ends[:-1], n)
        take += np.arange(ends[-1])
        ids = flat[take]
        ends = ends[np.searchsorted(at, bounds)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(ids: np.ndarray) -> bytes:
    """Ids by byte planes, two where that is enough, compressed; their number comes first."""
    width = 4 if len(ids) and ids.max() >> 16 else 2
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return bytes([width]) + _zstd()[0].compress(np.ascontiguousarray(planes.T))


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    if data[0] == 2:
        return planes[0] | planes[1].astype(np.uint32) << np.uint32(8)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def token_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, n, ids) of every row: its ids with ``end`` appended, packed; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], np.uint32)
        for batch in slices(batches, size=SLICE):
            found = [np.concatenate([x, last]) for x in encoder(path).ids(batch.column("text"))]
            packed = [_pack(x) for x in found]
            count = pa.array(map(len, found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), count, pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary")


# --- the code ------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; one symbol alone gets one bit."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} symbols don't fit codes of {limit} bits")
    order = sorted(counts, key=lambda s: (counts[s], s))
    if len(order) < 2:
        return dict.fromkeys(order, 1)
    lengths = _huffman(order, counts)
    if max(lengths.values()) <= limit:
        return lengths
    leaves = [counts[s] for s in order]
    level, marks = leaves, []
    for _ in range(limit - 1):
        pairs = [level[i] + level[i + 1] for i in range(0, len(level) - 1, 2)]
        both = list(heapq.merge(((w, 0) for w in leaves), ((w, 1) for w in pairs)))
        level, _ = [w for w, _ in both], marks.append([kind for _, kind in both])
    out, take = [0] * len(order), 2 * len(order) - 2
    for kinds in reversed(marks):
        packed = sum(kinds[:take])
        for i in range(take - packed):
            out[i] += 1
        take = 2 * packed
    for i in range(take):
        out[i] += 1
    return dict(zip(order, out, strict=True))


def _huffman(order: list[int], counts: dict[int, int]) -> dict[int, int]:
    heap = [(counts[s], i) for i, s in enumerate(order)]
    heapq.heapify(heap)
    up: dict[int, int] = {}
    made = len(order)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = made
        heapq.heappush(heap, (a + b, made))
        made += 1
    depth = [0] * made
    for i in range(made - 2, -1, -1):
        depth[i] = depth[up[i]] + 1
    return {s: depth[i] for i, s in enumerate(order)}


class Book:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: dict[int, int]):
        ids = np.array(sorted(lengths), np.int64)
        size = np.array([lengths[s] for s in ids.tolist()], np.int64)
        order = np.argsort(size, kind="stable")
        ids, size = ids[order], size[order]
        self.widest = int(size.max(initial=1))
        # Each code's share of the table; what stands before it is its number.
        share = 1 << (self.widest - size)
        self.code, self.length = np.zeros(ids.max(initial=0) + 1, np.uint64), np.zeros(ids.max(initial=0) + 1, np.int64)
        self.code[ids], self.length[ids] = (np.cumsum(share) - share) >> (self.widest - size), size
        self.table = np.zeros(1 << self.widest, np.uint32)
        self.table[: int(share.sum())] = np.repeat(ids << 5 | size, share)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bits in 32-bit words, highest first, and the bit offset of every ``block``-th id."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        size = self.length[ids]
        end = np.cumsum(size)
        at = end - size
        word, shift = at >> 5, 64 - (at & 31) - size
        bits = self.code[ids] << shift.astype(np.uint64)
        out = np.zeros(int(end[-1] + 31 >> 5) + 2, np.uint64)
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.add.reduceat(bits, new)
        out[word[new]] = sums >> np.uint64(32)
        out[word[new] + 1] += sums & np.uint64(0xFFFFFFFF)
        return out[:-1].astype(">u4").tobytes(), at[::block].copy()

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The ids: all blocks step forward together, each from its checkpoint, a table look-up an id."""
        words = np.r_[np.frombuffer(data, ">u4").astype(np.uint64), np.zeros(2, np.uint64)]
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((block, len(at)), np.uint32)
        tail = n - (len(at) - 1) * block if len(at) else 0
        top, mask = 64 - self.widest, np.uint64((1 << self.widest) - 1)
        for step in range(block if len(at) > 1 else tail):
            if step == tail:
                at = at[:-1]
            look = pairs[at >> 5] >> (top - (at & 31)).astype(np.uint64)
            hit = self.table[(look & mask).astype(np.int64)]
            out[step, : len(at)] = hit >> np.uint32(5)
            at = at + (hit & np.uint32(31)).astype(np.int64)
        return out.T.ravel()[:n]


# --- tables --------------------------------------------------------------------------------------------

FILE = (
    "part int, seq int, start long, n long, bits binary, checkpoints array<long>, doc_ids array<long>, lengths array<long>"
)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in slices(batches, "ids"):
        found = np.bincount(np.concatenate([_unpack(data) for data in batch.column(0).to_pylist()]))
        if len(found) > len(total):
            total = np.r_[total, np.zeros(len(found) - len(total), np.int64)]
        total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def write_ids(tokens: DataFrame, stages: Stages, limit: int = LIMIT) -> None:
    """Write ``tokens`` (doc_id, n, ids) in ascending doc_id order (nulls first, ties by their ids).

    Tables ``ids`` (rows of ``FILE``) and ``book``. The vocabulary bounds what comes to the driver.
    """
    counts = tokens.select("ids").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r.id: r.n for r in counts.collect()}, limit)
    book = stages.spark.createDataFrame(sorted(lengths.items()), "id int, length int")
    stages.keep(book.coalesce(1), "book")
    sent = stages.spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seq, start = Book(sent.value), 0, 0
        part = TaskContext.get().partitionId()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start
            ids = np.concatenate([x[2] for x in held])
            bits, checkpoints = code.encode(ids)
            out = [
                [part],
                [seq],
                [start],
                [len(ids)],
                [bits],
                [checkpoints.tolist()],
                [[x[0] for x in held]],
                [[x[1] for x in held]],
            ]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
            names = ["part", "seq", "start", "n", "bits", "checkpoints", "doc_ids", "lengths"]
            seq, start = seq + 1, start + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            for doc, n, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.append((doc.as_py(), n.as_py(), _unpack(data.as_py())))
                if sum(x[1] for x in held[-1:]) >= RUN or len(held) % 64 == 0 and sum(x[1] for x in held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    stages.keep(ordered.mapInArrow(run, FILE), "ids")


def read_ids(stages: Stages, texts: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the stored tables."""
    spark = stages.spark
    files = spark.read.schema(FILE).parquet(f"{stages.folder}/ids")
    lengths = {r.id: r.length for r in spark.read.schema("id int, length int").parquet(f"{stages.folder}/book").collect()}
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        base[r.part], total = total, total + r.n
    sent = spark.sparkContext.broadcast((lengths, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, base = sent.value
        book = Book(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                part, _, start, n, bits, checkpoints, docs, sizes = (batch.column(i)[row] for i in range(8))
                ids = book.decode(bits.as_py(), np.array(checkpoints.as_py(), np.int64), n.as_py()).astype("<u4")
                size = np.array(sizes.as_py(), np.int64)
                end = np.cumsum(size)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(end - size, end, strict=True)]
                cols = [
                    pa.array(docs.as_py(), pa.int64()),
                    pa.array(base[part.as_py()] + start.as_py() + end - size),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if texts:
                    offsets = pa.array(np.r_[0, end].astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * texts
    return files.mapInArrow(run, schema)


def round_trip(docs: DataFrame, stages: Stages, path: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the code, and read it back: (doc_id, start, n_tokens, ids_crc32).

    Null text: empty, so its end id alone. Null ids come first; repeated rows stay; no rows: no rows. Other columns
    are not read. Adjacent partitions hold adjacent ranges of doc_id, so ``start`` needs their totals only.
    """
    tokens = stages.keep(token_ids(docs, path), "tokens")
    write_ids(tokens, stages)
    return read_ids(stages)
