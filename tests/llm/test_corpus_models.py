"""Importance resampling, quality classifier, prefix trie: brute force, held-out accuracy, awkward rows, empty tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from planshift.llm import prefix_trie as trie_module  # noqa: E402
from planshift.llm.labelled import bounded_sample  # noqa: E402
from planshift.llm.prefix_trie import ends_sha256, prefix_trie  # noqa: E402
from planshift.llm.resampling import Head, continued, feature_buckets, frequent, moved_over, resampled  # noqa: E402
from planshift.llm.subwords import BUCKETS, END, fit_quality, quality_scored, word_features  # noqa: E402

NO_HEAD = Head({}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_resampled(rows, target):
    found = [brute_features(r[1]) for r in rows]
    raw = Counter(b for _, f in found for b in f)
    goal = Counter(b for t in target for b in brute_features(t)[1])
    n, m = sum(raw.values()), sum(goal.values())
    out = []
    for r, (words, features) in zip(rows, found, strict=True):
        gain = sum(math.floor(1000 * math.log((goal[b] + 1) * (n + 10_000) / ((raw[b] + 1) * (m + 10_000)))) for b in features)
        name = "null" if r[0] is None else r[0]
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(features), gain, gain + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def test_crc_states_are_continued():
    draw = random.Random(3)
    a = [draw.randbytes(draw.randrange(0, 40)) for _ in range(300)]
    b = [draw.randbytes(draw.choice([0, 1, 2, 7, 63, 64, 5000])) for _ in range(300)]
    crc = lambda xs: np.asarray([zlib.crc32(x) for x in xs], dtype=np.uint32)
    got = continued(crc(a), np.asarray([len(x) for x in b]), crc(b))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
    assert moved_over(0).shape == (4, 256)


def test_resampling_equals_brute_force(spark):
    data = corpus.rows() + [(None, corpus.prose(90, 50), "en", "s", 0, *["x"] * 6), (None, None, None, None, None, *["x"] * 6)]
    data += [(200 + i, "ÄB c\x85d—e " + corpus.prose(i, 25).upper(), "en", "s", 0, *["x"] * 6) for i in range(60)]
    goal = [corpus.prose(1, 200), None, "", "One one ONE"]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(goal)], "item_id long, text string, rank string")
    got = resampled(corpus.frame(spark, data), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resampled(data, goal)
    alone = resampled(corpus.frame(spark), target.limit(0)).collect()
    assert Counter(tuple(r) for r in alone) == brute_resampled(corpus.rows(), [])
    assert resampled(corpus.empty(spark), target).count() == 0


def test_the_head_saves_work_only(spark):
    head = frequent(corpus.frame(spark), "text")
    assert head.words and len(head.pairs)
    assert all(head.crc[i] == zlib.crc32(w.encode()) for w, i in head.words.items())
    texts = pa.array([r[1] for r in corpus.rows()])
    for one, other in zip(feature_buckets(texts, head), feature_buckets(texts, NO_HEAD), strict=True):
        assert one.tolist() == other.tolist()


def test_word_features_by_hand():
    words = ["ab", "é", "word", "x" * 30, "a\x03b"]
    _, found, bounds = word_features(words)
    grams = lambda w: sum(max(0, len(w) + 2 - n + 1) for n in (3, 4))
    assert np.diff(bounds).tolist()[:4] == [1 + grams(w) for w in words[:4]]
    _, alone, _ = word_features(["word"])
    assert sorted(found[bounds[2]:bounds[3]].tolist()) == sorted(alone.tolist())
    assert word_features([])[1].tolist() == [] and found.max() < BUCKETS and 0 <= END < BUCKETS


def held(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_scored(docs, fit_quality(docs, labels, held()), held())
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_of_awkward_tables(spark):
    labels = spark.createDataFrame(
        [(i, int(i % 2 == 0) if i < 90 else None, "x") for i in range(100)] + [(None, 1, "x"), (0, 7, "x"), (9999, 0, "x")],
        "doc_id long, quality int, score string",
    )
    docs = corpus.frame(spark)
    model = fit_quality(docs, labels, held())
    again = fit_quality(docs.repartition(5), labels, held())
    assert np.array_equal(model.vectors, again.vectors)  # the order of rows does not matter
    got = quality_scored(docs, model, held()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in corpus.rows())
    assert all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    ones = fit_quality(docs, labels.filter("quality = 1"), held())
    assert {r["predicted"] for r in quality_scored(docs, ones, held()).collect()} == {1}
    none = fit_quality(docs, labels.limit(0), held())
    assert {r["score"] for r in quality_scored(docs, none, held()).collect()} == {0.5}
    assert quality_scored(corpus.empty(spark), none, held()).count() == 0


def test_the_sample_bound_holds_for_rows_of_one_key(spark):
    docs = spark.createDataFrame([(1, f"text {i % 30}", "x") for i in range(200)] + [(2, "b", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    got = Counter(r["__label"] for r in bounded_sample(docs, labels, "doc_id", "text", "toxic", F.lit(False), 5).collect())
    assert got == {0: 5, 1: 5}
    assert bounded_sample(docs, labels, "doc_id", "text", "toxic", F.lit(False), 40).filter("__label = 1").count() == 30


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            who, body = role or "", text or ""
            key = hashlib.md5(f"{len(who)}:{who}{body}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (who, body)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(found), len(p), parent, len(found), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("ids", T.StringType()),
])


def digested(trie):
    rows = trie.nodes.join(ends_sha256(trie.ends), ["conv_id", "depth"], "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    return {(*tuple(r)[:7], r["ends_sha256"] or none) for r in rows}


@pytest.mark.parametrize(("block", "end_ids"), [(1024, 4096), (3, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, block, end_ids):
    monkeypatch.setattr(trie_module, "BLOCK", block)
    monkeypatch.setattr(trie_module, "END_IDS", end_ids)
    draw = random.Random(11)
    data = []
    for c in [*range(-120, 330, 7), 0, 100, 200, *range(1000, 1100)]:
        for turn in range(draw.randrange(1, 9)):
            data.append((c, turn if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "é 𝄞", "", None])))
    data += [(500, 0, "user", "same"), (501, 0, "user", "same")] + [(c, t, "user", f"hot {t}") for c in range(600, 660) for t in range(4)]
    data += [(700, t // 2, "user", f"long {t}") for t in range(40)] + data[:20] + [(None, 1, "user", "lost"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", "x") for r in data], TURNS).repartition(5)
    trie = prefix_trie(frame)
    assert digested(trie) == brute_trie(data)
    assert all(len(r["ids"]) <= end_ids for r in trie.ends.select("ids").collect())
    empty = prefix_trie(frame.limit(0))
    assert empty.nodes.count() == 0 and empty.ends.count() == 0
