"""Quality rules, the Merkle manifest and ranked search against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from mediaops.llm import manifest, quality, ranked
from mediaops.llm.common import Stages

SF = "/root/testdata/sf0.001"
LINE = "one two three four five six seven eight nine"
# Nulls in each column, empty and blank texts, one long word, repeated rows, ids, lines and runs of words.
ODD = [
    (None, "one two three four five", None, "en", 23),
    (2007, None, "a", None, None),
    (2008, "", "", "", 0),
    (2008, "other text of the same id", "a", "en", 25),
    (2009, "x" * 3000 + " ¡éß𝔘 %|<", "a", "é", 3010),
    (2010, f"{LINE}\n\n{LINE}\n {LINE}\n\x0b\t\n" + " ".join(f"w{i}" for i in range(60)), "b", "en", 1),
    (2010, f"{LINE}\n\n{LINE}\n {LINE}\n\x0b\t\n" + " ".join(f"w{i}" for i in range(60)), "b", "en", 1),
    (2011, "again " * 40, "b", "zz", 240),
    (2012, "a b c d e f g h i a b c d e f g h j " + " ".join(f"v{i}" for i in range(40)), "b", None, 5),
    (None, None, None, None, None),
]


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return out.selectExpr(
        "*", "1 as at", "2 as n", "3 as part", "'q' as digest", "4 as item", "5 as bucket", "6 as target", "7 as n_words", "'z' as none"
    )


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars").collect()
    return [tuple(r) for r in found] + ODD


def stages(spark):
    return Stages(spark, "test")


# --- quality rules -------------------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    repeated = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def plain_hash(values, seed=42):
    for x in values:
        data = x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_grams(text, buckets):
    tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")  # enough for the texts of this test
    hashes = [plain_hash([t]) for t in tokens]
    return [h % buckets for h in hashes] + [plain_hash(p) % buckets for p in zip(hashes, hashes[1:], strict=False)]


def test_rules_and_ratio(spark, rows):
    buckets = 1 << 9
    rows = [r for r in rows if not r[1] or re.fullmatch(r"[\w \n\x0b\t.,!?%|<*$&#¡:;@+()'\"=/-]*", r[1]) and "_" not in r[1]]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    labels = [(r.doc_id, r.quality) for r in labels] + [(2010, 1), (2010, 1), (2011, None), (2008, 1), (2008, 0), (None, 1)]
    found = quality.judge(frame(spark, rows).drop("n_words"), spark.createDataFrame(labels, "doc_id long, quality int"), stages(spark), buckets=buckets)
    assert set(frame(spark, rows).columns) - set(found.columns) == set()
    found = found.collect()
    by_id = defaultdict(list)
    for i, q in labels:
        by_id[i].append(q or 0)
    trusted = {i for i, qs in by_id.items() if i is not None and min(qs) == 1 and zlib.crc32(str(i).encode()) % 3 != 1}
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        own = Counter(plain_grams(text, buckets))
        raw += own
        target += own if i in trusted else {}
    share = sum(target.values()) / sum(raw.values())
    assert 0 < share < 1
    table = [math.log(target[b] + quality.PRIOR) - math.log(raw[b] * share + quality.PRIOR) for b in range(buckets)]
    want = Counter()
    for i, text, *_ in rows:
        own = plain_grams(text, buckets)
        llr = sum(table[b] for b in own) / len(own) if own else 0.0
        base = plain_rules(text)
        want[i, *base, len(own), round(llr, 9), not base[-1] and llr >= quality.THRESHOLD] += 1
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_grams, round(r.llr, 9), r.kept)
        for r in found
    )
    assert got == want
    assert sum(x[-1] for x in want) > 20


def test_repeated_words_by_every_length(spark):
    texts = ["a " * n for n in range(25)] + [f"{LINE} x {LINE} y{'' if i % 2 else ' ' + LINE} {'z ' * i}" for i in range(25)]
    found = quality.rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert Counter((r.text, r.n_repeat_words) for r in found) == Counter((t, plain_rules(t)[4]) for t in texts)


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    found = quality.judge(docs, labels, stages(spark)).join(labels, "doc_id")
    found = found.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in found}
    assert n.get((1, False, True), 0) >= 0.98 * sum(v for k, v in n.items() if k[:2] == (1, False))
    assert n.get((0, False, True), 0) + n.get((0, True, True), 0) == 0 < n.get((0, False, False), 0)


def test_quality_without_rows_or_labels(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(frame(spark, []).drop("n_words"), none, stages(spark)).count() == 0
    found = quality.judge(frame(spark, rows).select("doc_id", "text"), none, stages(spark)).collect()
    assert len(found) == len(rows) and all(r.llr == 0 and r.kept == (not r.base_failed) for r in found)


def test_target_is_bounded(spark):
    labels = spark.range(300).selectExpr("id as doc_id", "1 as quality")
    some, more = (quality.trusted_ids(labels, n).collect() for n in (10, 100))
    assert len(some) == 10 and len(more) == 100 and set(some) < set(more)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in more)


# --- Merkle manifest -----------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, source, lang, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, at):
    return [(lv[o], o < at >> i) if (o := (at >> i) ^ 1) < len(lv) else None for i, lv in enumerate(levels[:-1])]


def plain_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, _, leaf, _ in sorted(langs[x], key=lambda y: y[:3])]) for x in order}
    top = plain_tree([trees[x][-1][0] for x in order])
    out = []
    for t, x in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(langs[x], key=lambda y: y[:3])):
            path = plain_path(trees[x], at) + plain_path(top, t)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = plain_leaf(*r[:4], r[4] + 1 if tampered and r[4] is not None else r[4])
            for p in path:
                now = h(now) if p is None else h(p[0], now) if p[1] else h(now, p[0])
            proof = h(*(p[0] for p in path if p))
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], proof, now, now == top[-1][0], len(path) if tampered else None))
    return out


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest(spark, rows, bits):
    own = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    if bits == 1:
        own = own[::6] + ODD
    found = manifest.manifest(frame(spark, own), stages(spark), bits).collect()
    got = [tuple(r)[:7] + (None if r.version is None else len(r.version),) for r in found]
    assert Counter(got) == Counter(plain_manifest(own))
    for r in found:
        assert r.version is None or not r.version or r.version[-1].hex() == r.folded_root


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9])
def test_manifest_of_few(spark, n):
    own = [(7 * i, f"t{i}", "s", "en" if i < 6 else None, None if i == 2 else i) for i in range(n)]
    found = manifest.manifest(frame(spark, own), stages(spark), 1)
    assert Counter(tuple(r)[:7] for r in found.collect()) == Counter(x[:7] for x in plain_manifest(own))


# --- ranked search -------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def plain_search(docs, items, top):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in Counter(plain_terms(text)).items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,top,asked", [(5, 3, 100), (1 << 16, 10, 500_000)])
def test_ranked(spark, rows, monkeypatch, shard, top, asked):
    docs = [(r[0], r[1]) for r in rows]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, None), (901, ""), (None, "one two ÀB"), (902, docs[0][1]), (902, "other Text"), items[0], (903, "nowhere2")]
    monkeypatch.setattr(ranked, "DOCUMENTS", shard)
    asked_rows = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as term", "3 as doc_id")
    found = ranked.search(frame(spark, docs_frame(docs)).repartition(3), asked_rows, stages(spark), top, asked)
    assert Counter(tuple(r) for r in found.collect()) == plain_search(docs, items, top)


def docs_frame(docs):
    return [(i, t, None, None, None) for i, t in docs]


def test_accumulators_stop_without_loss():
    import numpy as np

    rng = np.random.default_rng(5)
    made = 0
    for _ in range(200):
        ids, lists, query = np.arange(200), {}, []
        for t in range(8):
            where = np.flatnonzero(rng.random(200) < 0.02 * 2**t)
            share = rng.integers(1, 4, len(where))
            if len(where):
                lists[t] = (where, share, int(share.max()))
                query.append((t, int(40 / 2**t) + 1))
        score = np.zeros(200, int)
        for t, w in query:
            score[lists[t][0]] += w * lists[t][1]
        order = np.lexsort((ids, -score))[:5]
        order = order[score[order] > 0]
        where, got = ranked.best(query, lists, ids, 5)
        assert where.tolist() == order.tolist() and got.tolist() == score[order].tolist()
        made += len(where)
    assert made > 900


def test_terms_across_pieces(monkeypatch):
    monkeypatch.setattr(ranked, "_CHUNK", 3)
    text = "Ab cde_fgh ÀÉ9 x" * 9
    assert [t.decode() for some in ranked.terms(text) for t in some] == plain_terms(text)


def test_search_of_nothing(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, items, stages(spark)).count() == 0
    some = frame(spark, [(1, "a b", None, None, None)])
    assert ranked.search(some, items.limit(0), stages(spark)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(some, items.limit(0), stages(spark)).count() == 0


def test_rules_without_work_for_each_character(spark):
    """Characters are counted by words and by one search for signs: a dictionary look-up for each cost a third of the rules."""
    texts = [
        "a b c d x1 a b c d x2 y z",  # four words twice, never eight
        "a b c d e f g h i a b c d e f g h j",
        "one two three four " * 2 + "z",
        "\x0b#\x0c\n\n \n é😀\r\né😀\r\n\x85 \n\x85 \n　 <|&>%$*",
        " \n\t ",
        None,
    ]
    found = quality.rules(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect()}
    for at, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))
        assert got[at] == want, text
    assert got[1][4] == 16 and got[0][4] == 0
