"""Sharding, quality rules, line dedup, mixing: awkward rows, empty tables, brute force."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402
from plans import plan_text  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from planshift.llm.lines import drop_boilerplate  # noqa: E402
from planshift.llm.mixing import budgets, mixed  # noqa: E402
from planshift.llm.queries import mixture  # noqa: E402
from planshift.llm.quality import RULES, fit_votes, judged, text_counts  # noqa: E402
from planshift.llm.shared import copy_numbers, running_total  # noqa: E402
from planshift.llm.sharding import interleaved_shards  # noqa: E402


def test_shards_hold_the_mixture_and_equal_counts(spark):
    data = corpus.rows()
    got = interleaved_shards(corpus.frame(spark), 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data
    )
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert sorted(by) == [0, 1, 2, 3] and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    for name in ("big", "s1", None):
        shares = [sum(r["stratum"] == name for r in v) for v in by.values()]
        assert max(shares) - min(shares) <= 2
    assert interleaved_shards(corpus.empty(spark), 4).count() == 0


def test_running_total_over_many_buckets(spark):
    df = spark.range(2000).select(
        F.lit("g").alias("g"), F.col("id"), (F.col("id") * 7 % 2000).alias("v"),
        F.floor(F.col("id") / 80).cast("int").alias("__d1"), (F.floor(F.col("id") / 20) % 4).cast("int").alias("__d2"),
    )
    seen = 0
    for r in running_total(df, ["g"], ["id"], "v", "b", "t").orderBy("id").collect():
        assert r["b"] == seen and r["t"] == 2000 * 1999 // 2
        seen += r["v"]


def brute_counts(text):
    text = text or ""
    flat = text
    for c in "\t\n\v\f\r":
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r["doc_id"], *(r[c] for c in names)) for r in text_counts(corpus.frame(spark)).collect())
    assert got == Counter((d[0], *brute_counts(d[1])) for d in corpus.rows())


def test_votes_learn_which_rules_to_trust(spark):
    import random

    draw = random.Random(3)
    data = []
    for _ in range(3000):
        good = draw.random() < 0.7
        vote = lambda a: (1 if good else -1) * (1 if draw.random() < a else -1) if draw.random() < 0.8 else 0  # noqa: B023, E731
        data.append((vote(0.95), vote(0.9), vote(0.9), vote(0.6)))
    model = fit_votes(spark.createDataFrame(data, "a int, b int, c int, d int"), list("abcd"), rounds=40)
    assert model.good == pytest.approx(0.7, abs=0.04)
    for name, accuracy in zip("abcd", (0.95, 0.9, 0.9, 0.6), strict=True):
        assert model.accuracy[name] == pytest.approx(accuracy, abs=0.04)


def test_judged_keeps_prose_and_drops_junk(spark):
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judged(corpus.frame(spark)).collect()}
    assert all(kept[100 + i] == (False, True) for i in range(40))
    assert kept[3] == kept[4] == kept[5] == kept[15] == (True, False) and not kept[16][1]
    assert judged(corpus.empty(spark)).count() == 0
    assert "Python" not in plan_text(judged(corpus.frame(spark))) and set(RULES) == {
        "length", "word_length", "symbols", "marks", "repeats", "lines"}


def test_boilerplate_lines_go_on_their_host_only(spark):
    got = {r["doc_id"]: r for r in drop_boilerplate(corpus.frame(spark), ratio=0.1, least_pages=2, removed="n_removed").collect()}
    assert got[10]["n_removed"] == got[11]["n_removed"] == 1 and not got[10]["text"].startswith("same")
    assert got[11]["text"].startswith("\n")  # the empty line stays
    assert got[13]["text"] == "same line here"  # another host, one page
    assert got[3]["text"] is None and got[4]["text"] == "" and got[10]["shard"] == "x"
    assert got[0]["text"] == ""  # two copies and a repeated row make its only line boilerplate
    assert drop_boilerplate(corpus.empty(spark)).count() == 0


def test_boilerplate_beyond_the_broadcast_bound(spark, monkeypatch):
    want = sorted(map(repr, drop_boilerplate(corpus.frame(spark), ratio=0.1, least_pages=2).collect()))
    monkeypatch.setattr("planshift.llm.lines.BROADCAST_BYTES", 0)
    assert sorted(map(repr, drop_boilerplate(corpus.frame(spark), ratio=0.1, least_pages=2).collect())) == want


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "z", 100)], "p string, q string, __cap long")
    weights = spark.createDataFrame([("a", None, 1.0), ("b", None, 1.0), ("a", "x", 1.0), ("a", "y", 1.0)], "p string, q string, weight double")
    got = {r["q"]: r["__budget"] for r in budgets(leaves, ["p", "q"], weights, 100).collect()}
    assert got == {"x": 10, "y": 40, "z": 50}
    got = {r["q"]: r["__budget"] for r in budgets(leaves, ["p", "q"], weights, 180).collect()}
    assert got == {"x": 10, "y": 80, "z": 90}
    weights = weights.replace(1.0, 9.0).filter("p = 'a'").union(spark.createDataFrame([("b", None, 1.0)], "p string, q string, weight double"))
    got = {r["q"]: r["__budget"] for r in budgets(leaves, ["p", "q"], weights, 150).collect()}
    assert got == {"x": 10, "y": 100, "z": 40}  # a is full: the rest leaves it


def poured(given, children):
    """Budgets of ``{name: (cap, weight)}`` in whole tokens: fractions poured by weight, largest remainders."""
    exact, open_ones, left = {}, dict(children), Fraction(given)
    while open_ones:
        level = left / sum(Fraction(w) for _, w in open_ones.values())
        full = {n for n, (cap, w) in open_ones.items() if cap <= level * Fraction(w)}
        if not full:
            exact |= {n: level * Fraction(w) for n, (_, w) in open_ones.items()}
            break
        for n in full:
            exact[n] = Fraction(open_ones.pop(n)[0])
            left -= exact[n]
    whole = {n: int(x) for n, x in exact.items()}
    more = min(given, sum(cap for cap, _ in children.values())) - sum(whole.values())
    for n in sorted((n for n in whole if whole[n] < children[n][0]), key=lambda n: (whole[n] - exact[n], n))[:more]:
        whole[n] += 1
    return whole


def brute_mixture(rows, weights, share, epochs):
    """``rows`` are (key, text, group, part); ``weights`` has one for every group and every (group, part)."""
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[2], r[3]].append(r)
    size = lambda r: max(len((r[1] or "").split()), 1)
    has = {leaf: sum(map(size, found)) for leaf, found in leaves.items()}
    groups = {g for g, _ in leaves}
    given = poured(int(Fraction(str(share)) * sum(has.values())), {
        g: (epochs * sum(n for leaf, n in has.items() if leaf[0] == g), weights[g,]) for g in groups})
    out = Counter()
    for g in groups:
        own = poured(given[g], {leaf: (epochs * has[leaf], weights[leaf]) for leaf in leaves if leaf[0] == g})
        for leaf, budget in own.items():
            times, rest = divmod(budget, has[leaf])
            order = sorted(leaves[leaf], key=lambda r: hashlib.md5(
                f"29|{'null' if r[0] is None else r[0]}|{zlib.crc32((r[1] or '').encode())}".encode()).hexdigest())
            for r in order:
                rest -= size(r)
                for epoch in range(times + (rest >= 0)):
                    out[r[0], r[1], epoch] += 1
                if rest < 0:
                    rest = -10**9
    return out


MIX_SCHEMA = "doc_id long, text string, domain string, part string, epoch string"


@pytest.mark.parametrize(("share", "epochs"), [(0.8, 2), (0.3, 1), (1.7, 2)])
def test_mixture_equals_brute_force(spark, share, epochs):
    data = [(i, corpus.prose(i, 1 + i % 37), "a" if i % 4 else "b", f"p{i % 3}") for i in range(120)]
    data += [(None, f"null key {i}", "a", "p0") for i in range(30)] + [(7, f"same key {i} word", "b", "p1") for i in range(30)]
    data += [(8, "copies of a row", "a", "p1")] * 25 + [(None, None, "b", "p2")] * 5 + [(900, "alone", "b", "p9")]
    weights = {("a",): 3, ("b",): 1} | {(g, f"p{k}"): w for g in "ab" for k, w in ((0, 1), (1, 2), (2, 4), (9, 1))}
    table = spark.createDataFrame([(w[0], w[1] if len(w) > 1 else None, float(x)) for w, x in weights.items()], "domain string, part string, weight double")
    frame = spark.createDataFrame([(*r, "x") for r in data], MIX_SCHEMA).repartition(4)
    got = mixed(frame, ["domain", "part"], share, epochs, table)
    assert set(got.columns) == {"doc_id", "text", "domain", "part", "epoch"}
    assert Counter((r["doc_id"], r["text"], r["epoch"]) for r in got.collect()) == brute_mixture(data, weights, share, epochs)


def test_mixture_cuts_rows_that_repeat_a_key(spark):
    """A hundred rows without a key, two keys of fifty rows, copies of one row, and budgets that fit exactly."""
    for rows in ([(None, f"w{i}") for i in range(100)], [(i % 2, f"w{i}") for i in range(100)], [(1, "w")] * 100):
        frame = spark.createDataFrame([(*r, "a", "p", "x") for r in rows], MIX_SCHEMA)
        assert mixed(frame, ["domain"], 0.8, 2).count() == 80
    frame = spark.createDataFrame([(i, "w", f"d{i % 3 if i < 32 else 3}", "p", "x") for i in range(40)], MIX_SCHEMA)
    assert mixed(frame, ["domain"], 0.8, 1).count() == 32
    assert mixed(frame, ["domain", "part"], 0.7, 1).count() == 28


def test_mixture_takes_prefixes_of_whole_epochs(spark):
    docs = corpus.frame(spark)
    tokens = {d[0]: max(len((d[1] or "").split()), 1) for d in corpus.rows()}
    got = mixed(docs, ["source"], share=0.5, epochs=2).collect()
    total = sum(tokens[d[0]] for d in corpus.rows())
    taken = sum(tokens[r["doc_id"]] for r in got)
    assert total * 0.5 - 6000 < taken <= total * 0.5 and got[0]["shard"] == "x" and {r["epoch"] for r in got} <= {0, 1}
    everything = mixed(docs, ["source"], share=9, epochs=2)
    assert Counter(r["doc_id"] for r in everything.collect()) == Counter({k: 2 * n for k, n in Counter(d[0] for d in corpus.rows()).items()})
    assert mixed(corpus.empty(spark), ["source"]).count() == 0
    named = docs.withColumn("domain", F.lit("own"))  # the stand-in level of the queries leaves a column of that name alone
    assert mixture(named).select(*named.columns).filter("domain = 'own'").count() > 0


def test_copies_are_numbered_over_parts(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("part"), F.lit("x").alias("v"))
    got = defaultdict(list)
    for r in copy_numbers(df, ["k"], "part").collect():
        got[r["k"]].append(r["__copy"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500


@pytest.mark.parametrize("kind", ["one key", "copies", "sources of one row"])
def test_shard_buckets_stay_small(spark, monkeypatch, kind):
    """The rows that one window of a running total sorts, when a key, a row or one-row sources make up the table."""
    n, largest = 3000, []

    def watched(df, groups, order, value, before, total, digits=("__d1", "__d2")):
        largest.append(df.groupBy(*groups, *digits).count().agg(F.max("count")).first()[0])
        return running_total(df, groups, order, value, before, total, digits)

    monkeypatch.setattr("planshift.llm.sharding.running_total", watched)
    rows = {
        "one key": [(None, f"text {i}", "s") for i in range(n)], "copies": [(5, "same", "s")] * n,
        "sources of one row": [(i, f"text {i}", f"s{i}") for i in range(n)],
    }[kind]
    got = interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4).collect()
    assert Counter(r["shard"] for r in got) == dict.fromkeys(range(4), n // 4)
    assert len({(r["shard"], r["slot"]) for r in got}) == n
    assert max(largest) < 60
