"""The text operators against brute force, the tokenizers' own libraries, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mediaops.llm import huffman, licenses, lines, pieces, prints, private, simhash, suffixes, templates, toxicity
from mediaops.llm.common import Stages, classes

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
# Nulls in each column, an empty text, one long word, repeated rows and ids, columns with names the operators use.
ODD = [
    (None, "one two three four five"),
    (2007, None),
    (2008, ""),
    (2008, "other text of the same id"),
    (2009, "x" * 3000),
    (2010, "a\n\na b\n a b \nc"),
    (2010, "a\n\na b\n a b \nc"),
    (None, None),
]


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.selectExpr("*", "'z' as fp", "1 as k1", "2 as k2", "3 as at", "4 as h", "5 as n", "'q' as g", "6 as start", "7 as item")


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in found] + ODD


def stages(spark):
    return Stages(spark, "test")


# --- SimHash near-duplicates ---------------------------------------------------------------------------


def plain_simhash(text, words=3):
    found = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text)) if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, values, radius=3):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)].append(x)
    return [min(least[top(i)], default=None) for i in range(len(ids))]


def test_simhash_classes(spark, docs):
    rows = docs + [(1000 + i, t[:-4] + " xx") for i, t in docs if t and i is not None and len(t) > 3000][:40]
    found = simhash.near_duplicates(frame(spark, rows), stages(spark)).collect()
    values = [plain_simhash(t or "") for _, t in rows]
    want = Counter(zip((i for i, _ in rows), values, plain_components([i for i, _ in rows], values), strict=True))
    assert Counter((r.doc_id, int(r.fp.hex(), 16), r.component_id) for r in found) == want
    assert simhash.near_duplicates(frame(spark, []), stages(spark)).count() == 0


def test_sharded_trees_lose_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << rng.randrange(24, 64) for _ in range(rng.randrange(4))) for b in base for _ in range(12)})
    rows = [(int(np.uint64(v).astype(np.int64)), bytearray(v.to_bytes(8, "big"))) for v in values]
    df = spark.createDataFrame(rows, "node long, fp binary")
    for tree in (3, 4096):
        roots = classes(simhash.links(df, 3, tree=tree), stages(spark)).collect()
        got = {r.node & (2**64 - 1): r.root for r in roots}
        want = plain_components(values, values)
        groups = defaultdict(set)
        for v, w in zip(values, want, strict=True):
            groups[w].add(got.get(v, ("alone", v)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_first(spark, docs):
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(frame(spark, docs), stages(spark)).collect()]
    values = {(i, t): plain_simhash(t or "") for i, t in docs}
    want = plain_components([i for i, _ in docs], [values[d] for d in docs])
    groups = len(set(want))
    assert len(kept) == groups and len(set(kept)) == groups


def test_near_copies_by_similarity(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    rows, similar = [], 0
    for group in range(60):
        own = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((10 * group, " ".join(own)))
        other = list(own)
        for _ in range(max(1, len(own) // 60)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        rows.append((10 * group + 1, " ".join(other)))
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (own, other))
        similar += len(a & b) / len(a | b) >= 0.8
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, rows), stages(spark), **simhash.SIMILAR).collect()}
    assert similar >= 45 and {10 * g for g in range(60)} <= kept
    assert sum(10 * g + 1 not in kept for g in range(60)) >= 0.9 * similar


@pytest.mark.parametrize("hubs", [1, 4])
def test_similar_copies_are_those_counted(spark, monkeypatch, hubs):
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]
    rows = [(9000, None), (9001, " \n"), (9002, "One  two"), (9003, "one two"), (9004, "one two three")]
    for group in range(40):
        own = rng.choices(vocabulary, k=rng.randint(8, 200))
        for copy in range(12 if group < 3 else 2):
            other = list(own)
            for _ in range(copy and round(len(own) * rng.uniform(0.01, 0.04))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            # a passage at the end of all that makes no copies
            rows.append((100 * group + copy, " ".join(other + vocabulary[: 10 if group % 2 else 0])))
    # repeated shingles count once: much of one, but little of the set
    rows += [(9100 + i, "again " * 100 + " ".join(rng.choices(vocabulary, k=30))) for i in range(3)]
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    up = list(range(len(rows)))
    close = 0
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            close += 0.75 <= shared / len(sets[i] | sets[j]) < 0.85
            if 10 * shared >= 8 * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    want = {min(i for (i, _), u in zip(rows, up, strict=True) if u == v) for v in set(up)}
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, rows), stages(spark), **simhash.SIMILAR).collect()}
    assert close >= 20 and kept == want


def test_sets_cost_the_same_however_many_shingles_are_common():
    """A corpus of some GB has ``COMMON`` common shingles: a text must not pay for each of them."""
    rng = random.Random(13)
    texts = ["", "one", *(" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(3, 300))) for _ in range(150))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    own = np.unique(np.concatenate([simhash.shingle_set(t, 5) for t in texts]))
    found = own[::3]
    others = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, simhash.COMMON - len(found))
    for some in (np.empty(0, np.int64), found, own[-1:], own[:1] - 1, own[-1:] + 1, np.sort(np.concatenate([found, others]))):
        common, known = SimpleNamespace(value=some), set(some.tolist())
        began = time.process_time()
        (out,) = simhash._sets(5, 0.8, common)(iter([batch]))
        took = time.process_time() - began
        for text, rare, part in zip(texts, out.column("rare").to_pylist(), out.column("set").to_pylist(), strict=True):
            whole = simhash.shingle_set(text, 5).tolist()
            last = known.intersection(whole)
            order = [x for x in whole if x not in last] + [x for x in whole if x in last]
            assert part == order[: len(whole) - simhash._least_shared(len(whole), 0.8) + 1 if whole else 0]
            assert rare == (round(100 - 100 * len(last) / len(whole)) if whole else 0)
    assert took < 3


def test_marks_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    sets, pairs = [], []
    for n in (1, 2, 7, 40, 300, 2000, 60_000):
        own = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        for part in (0.0, 0.05, 0.11, 0.12, 0.3, 1.0):
            other = np.unique(np.r_[own[int(part * n) :], rng.integers(-(1 << 63), (1 << 63) - 1, int(part * n))])
            pairs.append((len(sets), len(sets) + 1, len(own), len(other)))
            sets += [own, other]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])
    found = [m for out in simhash._marked(iter([rows.slice(0, 5), rows.slice(5)])) for m in out.column("mark").to_pylist()]
    a, b = ([found[p[i]] for p in pairs] for i in (0, 1))
    cols = [*(pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    batch = pa.RecordBatch.from_arrays(cols, ["a", "b", "na", "nb", "mark_a", "mark_b"])
    (out,) = simhash._likely(0.8)(iter([batch]))
    kept = set(out.column("a").to_pylist())
    shared = {x: len(np.intersect1d(sets[x], sets[y])) for x, y, _, _ in pairs}
    similar = {x for x, _, na, nb in pairs if shared[x] >= 0.8 * (na + nb - shared[x])}
    assert len(similar) >= 20 and similar <= kept
    assert not kept & {x for x, _, na, _ in pairs if not shared[x] and 40 <= na <= 2000}


def test_sets_of_strangers_with_a_common_phrase_do_not_move(spark, monkeypatch):
    """All pairs of texts that share a phrase meet, but only those that can be alike are joined with their sets."""
    monkeypatch.setattr(simhash, "SAMPLE", 1 << 40)
    rng = random.Random(19)
    phrase = [f"said{i}" for i in range(40)]
    texts = [" ".join([*phrase, *(f"w{rng.randrange(10**6)}" for _ in range(400))]) for _ in range(40)]
    texts += [t + " and more" for t in texts[:5]]
    st, kept, keep = stages(spark), {}, Stages.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(Stages, "keep", counted)
    found = simhash.similar_copies(frame(spark, list(enumerate(texts))), st, **simhash.SIMILAR).collect()
    roots = {r.doc_id: r.root for r in found}
    assert len(set(roots.values())) == 40 and all(roots[i] == roots[40 + i] for i in range(5))
    met = sum(n for name, n in kept.items() if name.startswith("pairs-"))
    likely = sum(n for name, n in kept.items() if name.startswith("likely-"))
    assert met > 300 and 5 <= likely <= 20


# --- Huffman -------------------------------------------------------------------------------------------


def test_round_trip_of_ids(spark, docs):
    st = stages(spark)
    found = huffman.round_trip(frame(spark, docs), st, BYTE_BPE).collect()
    own = Tokenizer.from_file(BYTE_BPE)
    ids = [(i, own.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in docs]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    place = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)
    assert all(len(r.checkpoints) == -(-r.n // huffman.BLOCK) for r in spark.read.parquet(f"{st.folder}/ids").collect())
    assert huffman.round_trip(frame(spark, []), stages(spark), BYTE_BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_code(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.6, n) * 3).astype(np.int64).clip(0, 3000).astype(np.uint32)
    counts = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True))
    for limit in (12, 18):
        lengths = huffman.code_lengths(counts, limit)
        assert max(lengths.values(), default=1) <= limit
        assert len(counts) < 2 or sum(2.0**-x for x in lengths.values()) == 1
        book = huffman.Book(lengths)
        assert (book.decode(*book.encode(ids), len(ids)) == ids).all()


def test_words_encoded_once_give_the_librarys_ids():
    rng = random.Random(7)
    letters = [*" \t\n\r aZé'.,;:!?)(\x00\x0b\x1c\x85\xa0\u180e\u200b\u2003\u3000\ufeff٣9½漢😀\u0301_", "<|endoftext|>", " the", "'ve", "  "]
    texts = ["", *("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(20_000)), "x" * 1000 + " y"]
    own, library = huffman.Encoder(BYTE_BPE, keep=2000), huffman.tokenizer(BYTE_BPE)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        found = [np.frombuffer(x, np.uint32).tolist() for x in own.ids(part)]
        assert found == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def test_signs_after_words_make_no_new_words(monkeypatch):
    own, library = huffman.Encoder(BYTE_BPE), huffman.tokenizer(BYTE_BPE)
    learnt = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: learnt.extend(new) or learn(new))
    texts = ["one alpha### alpha*** alpha%% alpha", "", "one alpha$5 alpha&b alpha.", "caf\u00e9\u3000 x caf\u00e9 x\x85 y"]
    for part in (pa.array([None, "skipped", *texts, None]).slice(2), texts, []):
        found = [x.tolist() for x in own.ids(part)]
        want = ["" if t is None else t for t in (part.to_pylist() if isinstance(part, pa.Array) else part)]
        assert found == [x.ids for x in library.encode_batch(want, add_special_tokens=False)]
    assert learnt.count(" alpha") == 1 and len(learnt) == len(set(learnt)) and not any(x.startswith(" alpha") and x != " alpha" for x in learnt)


def test_latin_words_skip_the_librarys_split(monkeypatch):
    own, library = huffman.Encoder(BYTE_BPE), huffman.tokenizer(BYTE_BPE)
    learnt, split = [], []

    class Spy:
        def encode_batch_fast(self, texts, **how):
            split.extend(texts)
            return library.encode_batch_fast(texts, **how)

    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: learnt.extend(new) or learn(new))
    monkeypatch.setattr(own, "library", Spy())
    marks = [f"x {c}. a{c}{s}b \u4e00{c}{s} {c}'s\n{c}y" for c in map(chr, range(0xA0, 0x2C0)) for s in ".,;:!?)*#%&$"]
    for part in (["un \u00e9t\u00e9. l' \u00e9t\u00e9, \u00e9t\u00e9;\n\u00e9t\u00e9 \u00e9t\u00e9"], marks):
        found = [x.tolist() for x in own.ids(part)]
        assert found == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
    words = [x for x in learnt if x.startswith((" \u00e9t\u00e9", "\n\u00e9t\u00e9"))]
    assert sorted(words) == ["\n\u00e9t\u00e9", " \u00e9t\u00e9"] and not any("\u00e9t\u00e9" in x for x in split)


def test_packed_ids():
    for ids in ([], [0], [65535, 1], [65536, 3], [2**32 - 1, 0]):
        packed = huffman._pack(np.array(ids, np.uint32))
        assert huffman._unpack(packed).tolist() == ids and huffman._unpack(packed).dtype == np.uint32
        assert packed[0] == (4 if max(ids, default=0) >> 16 else 2)


def test_limited_lengths_are_optimal():
    # Fibonacci counts make the deepest tree; compared with all ways to give six symbols lengths up to four.
    counts = {i: c for i, c in enumerate((1, 1, 2, 3, 5, 8))}
    best = min(
        sum(c * x for c, x in zip(counts.values(), own, strict=True))
        for own in np.ndindex(*[4] * 6)
        for own in [[x + 1 for x in own]]
        if sum(2.0**-x for x in own) <= 1
    )
    lengths = huffman.code_lengths(counts, 4)
    assert sum(counts[s] * x for s, x in lengths.items()) == best


# --- SentencePiece -------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, docs):
    rng = random.Random(5)
    parts = [" ", "  ", "a", "the", "ing", "\n", "é", "梦", "🤔", "ﬁ", ".", "   ", "x1", "\t", "\x00", "<s>"]
    texts = [t or "" for _, t in docs] + ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    own = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    model = pieces.load(PIECE_BPE)
    got = [x.tolist() for x in model.encode(texts)]
    assert got == own.encode(texts)
    assert [model.decode(x) for x in got] == texts
    rows = pieces.encode(frame(spark, docs), PIECE_BPE).collect()
    want = Counter((i, tuple(own.encode(t or ""))) for i, t in docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want and all(r.same for r in rows)
    assert pieces.encode(frame(spark, []), PIECE_BPE).count() == 0


def test_unigram_search_is_best():
    rng = random.Random(2)
    scores = {"a": -3.0, "b": -4.0, "ab": -5.0, "ba": -2.5, "aba": -6.25, "▁": -2.0, "▁a": -3.5, "bb": -9.0}
    model = pieces.Pieces({p: (i + 1, s) for i, (p, s) in enumerate(scores.items())}, [], 0, merges=False)
    words = sorted({"▁" + "".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)})

    def best(word):
        top = [0.0]
        for end in range(1, len(word) + 1):
            top.append(max(top[s] + scores.get(word[s:end], model.least if end - s == 1 else -1e9) for s in range(end)))
        return top[-1]

    for word, parts in model.segment(words):
        assert "".join(parts) == word
        assert sum(scores.get(p, model.least) for p in parts) == pytest.approx(best(word))


# --- toxicity ------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    toxic, clean = ([r.score for r in found if r.toxic == y] for y in (1, 0))
    above = np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic])
    assert above > 0.85  # eighteen held-out toxic documents
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    model = toxicity.Field(moves=rng.normal(size=(2, 2)))
    unary, bounds = rng.normal(size=9), np.array([0, 4, 5, 9])
    odds, _, _ = model.marginals(unary, bounds)
    for a, b in zip(bounds, bounds[1:], strict=False):
        total = np.zeros((b - a, 2))
        for tags in np.ndindex(*[2] * (b - a)):
            weight = sum(unary[a + i] * t for i, t in enumerate(tags))
            weight += sum(model.moves[s, t] for s, t in zip(tags, tags[1:], strict=False))
            for i, t in enumerate(tags):
                total[i, t] += np.exp(weight)
        assert odds[a:b] == pytest.approx(np.log(total[:, 1] / total[:, 0]))


def test_toxicity_odd_rows(spark, docs):
    texts = [f"you see the day was fine, go {i}" for i in range(40)] + [f"you idiot {i} go" for i in range(40)]
    model = toxicity.fit(texts, np.array([0] * 40 + [1] * 40))
    rows = [(1, "A fine day. You IDIOT!"), (2, "a fine day"), *ODD]
    found = toxicity.score(frame(spark, rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    first = next(r for r in found if r.doc_id == 1)
    assert first.predicted == 1 and "16:21" in first.spans.split(",")
    kept = toxicity.keep_clean(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id = 1").count() == 0
    assert kept.count() == len(rows) - sum(r.predicted for r in found)
    assert toxicity.score(frame(spark, []), model).count() == 0
    none = toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.score(frame(spark, rows), none).collect()} == {0}


# --- repeated bytes ------------------------------------------------------------------------------------


def plain_repeats(texts, depth):
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raw for i in range(len(r) - depth + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = 1
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("depth", [400, 24])
def test_repeated_bytes(spark, docs, depth, monkeypatch):
    rng = random.Random(depth)
    rows = docs if depth == 400 else ODD + [(20 + i, "".join(rng.choices("abé", k=90)) * rng.randint(1, 2)) for i in range(30)]
    rows = rows + [(500, rows[-1][1]), (501, "y" * 1200 + rows[12][1] + "y" * 500)]
    monkeypatch.setattr(suffixes, "_PIECE", 1000)
    monkeypatch.setattr(suffixes, "_SPREAD", 300)
    found = suffixes.remove_repeats(frame(spark, rows), stages(spark), depth).collect()
    want = plain_repeats([t or "" for _, t in rows], depth)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert suffixes.remove_repeats(frame(spark, []), stages(spark)).count() == 0


# --- benchmark templates -------------------------------------------------------------------------------


def plain_template(text):
    out = re.sub(r"[0-9]+(?:[.,:/][0-9]+)*", " \x02 ", text)
    out = re.sub(r"(?<=\x02 )( ?)(?:km|kg|hours?)(?![^\W\d_])", r"\1" + "\x03", out)
    out = re.sub(r"(?<=[a-z,;] )[A-Z][^\W\d_]*", "\x04", out)
    return [w for w in re.split(r"[^a-zà-ÿ\x02-\x04]+", out.lower()) if w]


def test_templates(spark, docs):
    question = "A train from Paris to Rome runs 1200 km in 8 hours, how fast does Paris see it go?"
    items = [(1, question), (2, "too short"), (3, None), (None, "nothing of this is anywhere to be found in the texts")]
    other = question.replace("Paris", "Oslo").replace("Rome", "Bergen").replace("1200", "500")
    torn = question.replace("Paris", "Oslo", 1).replace("Rome", "Oslo").replace("see", "see Oslo and")
    rows = [(900, "Before. " + question + " After."), (901, other), (902, torn.replace("does Paris", "does Kiel")), *docs]
    bench = spark.createDataFrame(items, "item_id long, text string")
    both = bench.union(spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id") + 100, "text"))
    found = templates.leaks(frame(spark, rows), both, stages(spark)).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert (got[900, 1].n_changed, got[901, 1].n_changed) == (0, 4) and (902, 1) not in got
    assert got[901, 1].n_slots == 7
    # by sets of windows, for the items without slots
    def grams(text):
        own = plain_template(text or "")
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}

    plain = [(r.item_id, grams(r.text)) for r in both.collect() if r.item_id != 1]
    want = {(i, k) for i, t in rows for k, g in plain if g and len(g & grams(t)) >= 0.8 * len(g)}
    assert {k for k in got if k[1] != 1} == want and len(want) >= 3
    clean = templates.decontaminate(frame(spark, rows), both, stages(spark))
    leaked = {i for i, _ in got}
    assert clean.count() == sum(i not in leaked for i, _ in rows) and clean.columns == frame(spark, rows).columns
    empty = frame(spark, [])
    assert templates.leaks(empty, both, stages(spark)).count() == 0
    assert templates.decontaminate(frame(spark, rows), bench.limit(0), stages(spark)).count() == len(rows)


# --- personal data -------------------------------------------------------------------------------------


def test_personal_data(spark):
    rng = random.Random(4)

    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    def card():
        head = "4" + number(14)
        return next(head + d for d in "0123456789" if private.luhn(head + d))

    def text():
        return f"call +1 ({number(3)}) 555-{number(4)} or mail ab.{number(2)}@mail.example.com from 10.0.0.{number(2)} pay {card()} now, room {number(3)}"

    weights = private.fit([text() for _ in range(150)])
    rows = [
        (1, "write to joe@x.org. Or +49 (30) 1234-5678, 10.2.3.4 and 300.1.2.3"),
        (2, "call (988) 555-2485 now"),
        (3, "in 2020 there were 12 of 34 on page 555"),
        *ODD,
    ]
    found = private.find(frame(spark, rows), weights).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    want = "email:9:18,phone:23:41,ip:43:51"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert set(want.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "phone:5:19" and got[2].n_phone == 0 and got[3].spans == ""
    assert private.find(frame(spark, []), private.fit([])).count() == 0


def test_segments_by_enumeration():
    text = "+1 (988) 555-2485 4111111111111111 10.0.0.1 a@b.cd 77"
    _, tokens = private.regions(text)[0]
    weights = np.random.default_rng(1).normal(size=private.SPACE).tolist()
    own = private.Region(text, "", tokens)
    scored = own.scores(weights)

    def ways(at):
        if at == own.n:
            yield 0.0, ()
            return
        for rest, spans in ways(at + 1):
            yield rest, spans
        for c, (i, j, scores) in enumerate(scored):
            if i == at:
                for rest, spans in ways(j):
                    for k, s in scores.items():
                        yield rest + s, ((own.spans[c][0], k, own.spans[c][1]), *spans)

    every = list(ways(0))
    assert private.decode(text, "", tokens, weights) == list(max(every)[1])
    # the slope is that of the likelihood
    gold, step = {(0, 3)}, 1e-5
    slope = own.slope(np.array(weights), gold)

    def likelihood(w):
        total = [s for s, _ in private_ways(own, w)]
        top = max(total)
        want = next(s for s, spans in private_ways(own, w) if spans == tuple(sorted(gold)))
        return want - top - np.log(sum(np.exp(x - top) for x in total))

    def private_ways(region, w):
        found = region.scores(w)

        def rec(at):
            if at == region.n:
                yield 0.0, ()
                return
            yield from rec(at + 1)
            for c, (i, j, scores) in enumerate(found):
                if i == at:
                    for rest, spans in rec(j):
                        for k, s in scores.items():
                            yield rest + s, ((c, k), *spans)

        return list(rec(0))

    for f in sorted(slope)[:3]:
        up, down = list(weights), list(weights)
        up[f] += step
        down[f] -= step
        assert slope[f] == pytest.approx((likelihood(up) - likelihood(down)) / (2 * step), abs=1e-3)


def test_base_spans_by_hand():
    for text, want in {
        "256.1.1.1 1.2.3.4.5": [(10, 1, 17)],
        "4111 1111-1111 1111x": [(0, 2, 19)],
        "+123 45": [],
        "+1 2345 67.89()0": [(0, 3, 16)],
        "a@b a@b.c.": [(4, 0, 9)],
        "9" * 5000 + ".1.1.1": [],
    }.items():
        assert private.base_spans(text) == want


# --- licences ------------------------------------------------------------------------------------------


def test_licences(spark, docs):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    rows = [
        (3001, "Apache License; the Apache license. Licensed under CC BY-NC 4.0"),
        (3002, "x " + notice.replace("hereby", "herby").replace("person", "persn") + " y"),
        (3003, "licence of apache"),
        *docs,
    ]
    found = licenses.scan(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in found if r.doc_id in (3001, 3002, 3003)}
    assert len(found) == len(rows)
    assert (got[3001].n_base, got[3001].first_word, got[3001].last_word, got[3001].base_labels) == (3, 0, 7, "apache,cc-by")
    assert got[3001].n_words == 12 and got[3001].score == 1
    assert (got[3002].n_base, got[3002].labels, got[3002].spans.split(":")[:2]) == (0, "mit", ["2", "74"])
    assert got[3002].first_word is None and 0.95 < got[3002].score < 1
    assert (got[3003].labels, got[3003].score) == ("", 0)
    by_hand = [
        sum(w[i : i + len(p)] == p for p in (k.split() for k in licenses.BASE) for i in range(len(w)))
        for _, t in rows
        for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    ]
    assert Counter((r.doc_id, r.n_base) for r in found) == Counter((i, n) for (i, _), n in zip(rows, by_hand, strict=True))
    assert licenses.scan(frame(spark, [])).count() == 0


def test_every_near_notice_is_found():
    rng = random.Random(6)
    search = licenses.Search(licenses.NOTICES)
    for notice in licenses.NOTICES:
        for _ in range(20):
            text = list(notice)
            for _ in range(licenses.errors(notice)):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice(["", "q", text[at] + "z"])
            line = "lorem ipsum " + "".join(text) + " dolor"
            assert any(n == notice for _, _, n, _ in search.spans(line)), (notice, line)


# --- repeated lines ------------------------------------------------------------------------------------


def plain_lines(rows, window, long, often):
    seen, alone, count, out = {}, {}, Counter(), {}
    keyed = sorted(rows, key=lambda r: (r[0] or 0, r[2]))
    for key in (False, True):
        for i, text, k2 in keyed:
            own = text.split("\n")
            numbers = [n for n, x in enumerate(own) if x.strip()]
            words = [own[n].strip() for n in numbers]
            dead = set()
            for at in range(len(words)):
                here, line = (i or 0, k2, at), words[at]
                run = tuple(words[at : at + window])
                if not key:
                    seen.setdefault(run, here)
                    alone.setdefault(line, here)
                    count[line] += 1
                    continue
                if len(run) == window and seen[run] < here:
                    dead |= {numbers[at + j] for j in range(window)}
                if alone[line] < here and (len(line.split()) >= long or count[line] >= often):
                    dead.add(numbers[at])
            out[i, text] = "\n".join(x for n, x in enumerate(own) if n not in dead)
    return out


def with_hash(df):
    text = F.coalesce("text", F.lit(""))
    return [tuple(r) for r in df.select("doc_id", text.alias("t"), F.xxhash64(F.col("doc_id").isNull(), text)).collect()]


@pytest.mark.parametrize("window,long,often", [(lines.WINDOW, lines.LONG, lines.OFTEN), (3, 999, 9999), (2, 4, 9999), (4, 999, 5), (1, 1, 1)])
def test_repeated_lines(spark, docs, window, long, often):
    rng = random.Random(window)
    letters = ["p", "q ", "r", "", "s", "t", "u v w x", " ".join("abcdefghijklmnopqrstuvwxyz")]
    more = [(300 + i, "\n".join(rng.choices(letters, k=rng.randint(1, 9)))) for i in range(60)]
    more += [(370 + i, f"x{i // 2}\ny{i}") for i in range(20)]
    rows = docs + more + [(400, "\n".join(t for _, t in docs[:6]))]
    df = frame(spark, rows)
    found = lines.remove_later_runs(df, stages(spark), window, long, often)
    assert found.columns[: len(df.columns)] == df.columns
    want = plain_lines(with_hash(df), window, long, often)
    found = found.collect()
    for r in found:
        assert r._llm_kept == want[r.doc_id, r.text or ""]
    assert len(found) == len(rows) and any(r._llm_gone for r in found)
    assert lines.remove_later_runs(frame(spark, []), stages(spark)).count() == 0


def test_single_lines(spark):
    """A long line is a run of its own, a short one where it is frequent; twice by chance it stays."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n {long}\nd"), (3, long), (4, "e\n\nb"), (5, "one line"), (6, "one line "), (7, "f\nf"), (8, "one line")]
    found = {r.doc_id: (r._llm_kept, r._llm_gone) for r in lines.remove_later_runs(frame(spark, rows), stages(spark)).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("c\nd", 1), 3: ("", 1), 4: ("e\n\nb", 0), 5: ("one line", 0), 6: ("", 1), 7: ("f\nf", 0), 8: ("", 1)}


# --- fingerprints --------------------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    rows = [*docs, (200, docs[5][1])]
    found = prints.compare_with_edits(frame(spark, rows), stages(spark)).collect()
    assert len(found) == len(rows)
    once = [(i, t) for i, t in rows if i is not None and i not in (2008, 2010)]
    by_id = {r.doc_id: r for r in found}
    for k, (i, t) in enumerate(sorted(once, key=lambda r: -r[0])[:-1]):
        t, nxt = t or "", sorted({x for x, _ in rows if x is not None}, reverse=True)
        after = nxt[nxt.index(i) + 1]
        if after in (2008, 2010):
            continue
        other = dict(once)[after] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert by_id[i].n_chars == len(t)
        assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), (i, k)
    last, first = min(i for i, _ in once), max(i for i, _ in once)
    assert by_id[200].fingerprint == by_id[docs[5][0]].fingerprint
    text, other = dict(once)[last], dict(once)[first]
    # after the smallest id comes the null one, after that the largest
    half = len(text) // 2
    empties = {hashlib.sha256((text[: len(text) - half] + x[:half]).encode()).hexdigest() for x in ("", ODD[0][1])}
    assert by_id[last].edited_sha256 in empties and other
    near = [r.near_edited - r.near_next for r in found if r.n_chars > 200]
    assert np.mean([x > 0 for x in near]) > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    values = {int(r.fingerprint, 16) for r in found}
    for r in found:
        if r.doc_id is not None and r.doc_id % 100 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ v).bit_count() <= 3 for v in values)
        else:
            assert r.n_near is None
    assert prints.compare_with_edits(frame(spark, []), stages(spark)).count() == 0


def test_search_finds_all(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(8)} | {0, 2**64 - 1}
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = {(r.q & (2**64 - 1), r.fp & (2**64 - 1), r.bits) for r in prints.search(df, df).collect()}
    want = {(a, b, (a ^ b).bit_count()) for a in values for b in values if (a ^ b).bit_count() <= 3}
    assert got == want


# --- pipeline ------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    st, at = stages(spark), docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, at = at, st.keep(stage(spark, at, SF), f"s{number}")
        assert at.count() <= before.count()
        if number < 4:
            assert at.columns == docs.columns, name
            assert at.join(before, ["doc_id"], "left_anti").count() == 0
    assert at.where("not same").count() == 0
    again = corpus_pipeline.run(spark, SF)
    assert again.exceptAll(at).count() == 0 and again.count() == at.count() > 100


def test_pipeline_odd_rows(spark):
    rows = frame(spark, ODD).withColumn("n_chars", F.length("text").cast("long"))
    at = rows
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF)
        assert at.count() > 0, number
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_linear_patterns_equal_the_fixed_ones():
    """E-mail addresses and four numbers found from at signs and from starts of numbers, not from every place."""
    rnd = random.Random(11)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab1 9.-_@@..+é1") for _ in range(rnd.randrange(24)))
        assert private.emails(text) == [m.span() for m in private.EMAIL.finditer(text)]
        assert [m.span() for m in private._FOUR.finditer(text)] == [m.span() for m in private.IP.finditer(text)]


def test_long_words_and_rows_of_notices():
    """Texts of a megabyte take seconds: the spans are those that the parts alone would give."""
    start = time.perf_counter()
    long = "a" * 500_000 + "@b.cc " + "1" * 500_000 + " 1.2.3.4 " + "a.b" * 100_000 + " " + "(" * 100_000 + "7"
    found = private.base_spans(long)
    assert (0, 0, 500_005) in found and [long[s:e] for s, k, e in found if k == 1] == ["1.2.3.4"]
    assert private.trimmed("(" * 200_000, 0, 200_000) == (200_000, 200_000)
    search = licenses.Search(licenses.NOTICES)
    row = "licensd under cc by "
    spans = search.spans(row * 20_000)
    assert [s[0] for s in spans if s[2] == "licensed under cc by"] == list(range(0, len(row) * 20_000, len(row)))
    assert [n for n, _ in licenses._places("cc by " * 100_000, ["cc by"])] == list(range(0, 200_000, 2))
    assert time.perf_counter() - start < 60


def test_a_worse_notice_before_a_better_one():
    search = licenses.Search({"licensed under cc by": "cc-by"})
    text = "licensd under cc by licensed under cc by"
    assert [(text[a:b], e) for a, b, _, e in search.spans(text)] == [("licensd under cc by", 1), ("licensed under cc by", 0)]


def test_notices_equal_search_at_every_place():
    """Every stretch with at most the allowed edits overlaps a span that is no worse, and spans don't overlap."""
    rnd = random.Random(12)
    notice = "cc by licence"
    k = licenses.errors(notice)
    search = licenses.Search({notice: "x"})
    for _ in range(60):
        text = "".join(notice if rnd.random() < 0.15 else rnd.choice("cby lien") for _ in range(24))
        cut = rnd.randrange(len(text))
        text = text[:cut] + text[cut + 1 :]
        spans = search.spans(text)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for a in range(len(text)):
            for b in range(a + len(notice) - k, min(len(text), a + len(notice) + k) + 1):
                row = list(range(len(notice) + 1))
                for i, c in enumerate(text[a:b], 1):
                    last, row[0] = row[0], i
                    for j, d in enumerate(notice, 1):
                        last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
                if row[-1] <= k:
                    assert any(s < b and a < e and edits <= row[-1] for s, e, _, edits in spans)


def test_pipeline_near_copies_are_those_of_simhash_too(spark):
    """Equal fingerprints, as one phrase outvotes the rest, but few shingles in common: linked by the bits alone."""
    import corpus_pipeline

    phrase = "alpha beta gamma delta epsilon " * 100
    texts = [phrase + " ".join(f"{side}{n}" for n in range(9)) for side in "xy"] + ["another text that is like none of the others"]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert (simhash.simhash(texts[0]) ^ simhash.simhash(texts[1])).bit_count() <= 3
    docs = spark.createDataFrame([(n, t, len(t)) for n, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2]


def test_links_within_classes_are_not_contracted_again(spark, monkeypatch):
    """Rounds of meetings go on, but the driver plans a contraction only for links between classes, none for stars."""
    st = stages(spark)
    kept = []
    keep = st.keep
    monkeypatch.setattr(st, "keep", lambda df, name: kept.append(name) or keep(df, name))
    rng = random.Random(13)
    # a passage shared without likeness, the first of its texts' shingles, keeps its key open for rounds
    phrases = [[f"p{k}x{j}" for j in range(5)] for k in range(2000)]
    shared = min(phrases, key=lambda p: int(simhash.shingle_set(" ".join(p), 5)[0]))
    monkeypatch.setattr(simhash, "SAMPLE", 1 << 40)
    rows = [(100 + k, " ".join([*shared, *(f"v{k}x{j}" for j in range(20))])) for k in range(40)]
    words = [f"w{k}" for k in range(390)]
    rows += [(k, " ".join([*words, *rng.choices(words, k=2)])) for k in range(10)]
    docs = frame(spark, rows)
    known = simhash.near_duplicates(docs, stages(spark))
    found = simhash.similar_copies(docs, st, **simhash.SIMILAR, known=known).collect()
    assert len({r.root for r in found if r.doc_id < 100}) == 1 and len({r.root for r in found if r.doc_id >= 100}) == 40
    rounds = {x.split("-")[1] for x in kept if x.startswith("met-")}
    contracted = {x.split("-")[1] for x in kept if x.startswith("stars-")}
    assert len(rounds) >= 3 and len(contracted - {"known"}) <= 1
    star = spark.createDataFrame([(5, k) for k in range(9, 20)] + [(2, 3)], "a long, b long")
    kept.clear()
    assert {(r.node, r.root) for r in classes(star, st, "alone").collect()} == {(k, 5) for k in (5, *range(9, 20))} | {(2, 2), (3, 2)}
    assert kept == ["alone-0"]


def test_toxicity_fit_sums_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    to, of = rng.integers(0, 50, 10_000).astype(np.int32), rng.integers(0, 300, 10_000).astype(np.int32)
    values = rng.normal(size=300)
    monkeypatch.setattr(toxicity, "_PIECE", 777)
    assert np.array_equal(toxicity._added(to, of, values, 60), np.bincount(to, values[of], 60))
    texts = [f"some plain words here. number {k} of them" + (" awful slur" if k % 3 == 0 else "") for k in range(60)]
    toxic = np.array([k % 3 == 0 for k in range(60)], np.int64)
    whole = toxicity.fit(texts, toxic)
    monkeypatch.setattr(toxicity, "_DOCUMENTS", 7)
    parts = toxicity.fit(texts, toxic)
    assert np.array_equal(whole.weights, parts.weights) and whole.calibration == parts.calibration


def test_pipeline_stages_hand_texts_over_in_small_batches(spark, monkeypatch):
    """What a worker gets at once has a bound in bytes, however long the texts: its memory isn't given back in full."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(docs, *_, **__):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["doc_id", "n_chars"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long")
        return found.selectExpr("*", "0 as n_pieces", "0 as ids", "0 as same")

    monkeypatch.setattr(pieces, "encode", sizes)
    docs = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat('x', 20000) as text")
    found = dict(corpus_pipeline.STAGES)["SentencePiece"](spark, docs, SF).collect()
    assert sum(r.doc_id for r in found) == 1500
    assert max(r.n_chars for r in found) <= 2 * (4 << 20)


def test_planted_passages_are_seen_in_n_removed_not_in_n_bytes(spark):
    """Passages of over 50 words in two documents each: those of 400 bytes or more go, clean documents stay whole."""
    rng = random.Random(17)

    def words(n, side, letters):
        return " ".join(f"{side}{rng.randrange(10**letters):0{letters}d}" for _ in range(n))

    rows, long, short = [], set(), set()
    for k in range(24):
        passage = words(60, "p", 7) if k % 2 else words(55, "q", 4)
        (long if k % 2 else short).update((2 * k, 2 * k + 1))
        rows += [(2 * k + side, f"{words(40, 'a', 9)} {passage} {words(40, 'b', 9)}") for side in (0, 1)]
    rows += [(100 + k, words(150, "c", 9)) for k in range(20)]
    found = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, rows), stages(spark)).collect()}
    assert all(found[k].n_bytes == len(t.encode()) for k, t in rows)
    assert {k for k, r in found.items() if r.n_removed} == long
    assert all(found[k].n_removed >= 60 * 9 - 1 for k in long)
    # 55 words of five letters are 329 bytes: shorter than the strings that the contract removes
    assert all(found[k].n_removed == 0 for k in short)
