"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text gets the set of its five-word shingles (64-bit hashes), 128 MinHash values and 32 band keys of four
   values each. Equal texts become one node with a count.
2. Texts that share a band key are compared inside their bucket on one byte per MinHash value, 16 values more at a
   time. After each step the pair is dropped if the posterior probability that its similarity reaches the threshold is
   below the tolerance. A block of a bucket sends a spanning forest of its surviving pairs, two blocks only what
   links their forests.
3. Texts linked by surviving pairs form loose groups. Only their texts are shingled again; inside a group every pair
   is pruned in the same way and the survivors are verified on the whole shingle sets, first inside blocks and then
   between them. Again only counts per text, the forest of a block and links between forests leave the tasks.
4. Components of the verified links are the classes.

Buckets and groups of any size are cut into blocks of rows by hash, and each pair of blocks is a task's unit of work,
so a hot bucket is spread and no task holds more than two blocks. A pair at exactly 0.8 shares no band with probability
(1 - 0.8^4)^32 = 5e-8 and is pruned wrongly with about the tolerance; closer pairs are safer still.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.llm.components import components, forest_components
from planshift.llm.shared import Words, row_slices, small_side, stored

SHINGLE = 5
PERMUTATIONS = 128
BAND_ROWS = 4
STEP = 16
# Shingle bytes that a block is meant to hold where texts are verified.
BLOCK_BYTES = 8 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


# Fixed multipliers and shifts of the permutations, from a seeded generator.
_draw = np.random.default_rng(5)
MULTIPLY = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of one to four words is one shingle, one without none."""
    words = Words(texts)
    hashes = _word_hashes(words.distinct)[words.codes] if len(words.codes) else np.zeros(0, dtype=np.uint64)
    n = len(hashes) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled = _mixed(rolled + hashes[k:k + max(n, 0)] + np.uint64(k + 1)) if n > 0 else rolled
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a:b - SHINGLE + 1])
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                short = _mixed(short + hashes[k] + np.uint64(b - a + 77))
            yield short
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of every permutation, 32 bits each; long sets are worked off in pieces."""
    least = np.full(PERMUTATIONS, MASK, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        least = np.minimum(least, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.zeros(PERMUTATIONS // BAND_ROWS, dtype=np.uint64)
    for column in values.reshape(-1, BAND_ROWS).T.astype(np.uint64):
        keys = _mixed(keys + column + np.uint64(1))
    return keys.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After n compared bytes, the fewest matches at which the pair may still reach the threshold.

    Under a uniform prior the match rate is Beta(m + 1, n - m + 1) after m of n matches. A byte also matches by chance
    in one of 256 cases, so the rate at the threshold is a little above it. The upper tail of the beta distribution
    is a binomial sum.
    """
    rate = threshold + (1 - threshold) / 256
    steps = []
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)  # P(rate reached | m of n)
            if below >= tolerance:
                break
            m += 1
        steps.append((n, m))
    return steps


def surviving(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows of ``b`` that may reach the threshold with the signature ``a``; compared step by step."""
    alive = np.arange(len(b))
    matches = np.zeros(len(b), dtype=np.int32)
    for n, least in steps:
        matches = matches + (b[alive, n - STEP:n] == a[n - STEP:n]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def spanning(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For every row of a block the first row of its component; ``near(i, others)`` gives the others linked to row i.

    A row that has been reached is expanded against the rows not reached so far only.
    """
    root = np.full(size, -1)
    left = np.arange(size)
    while len(left):
        head, left = left[0], left[1:]
        root[head] = head
        queue = [head]
        while queue and len(left):
            found = near(queue.pop(), left)
            if len(found):
                root[left[found]] = head
                queue.extend(left[found].tolist())
                left = np.delete(left, found)
    return root


def bridges(heads: np.ndarray, first: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of heads that join the forests of two blocks; ``first`` marks the rows of one of them.

    A row is compared with the rows of the other block whose forest is not joined to its own yet.
    """
    top = heads.copy()
    found = []
    others = np.flatnonzero(~first)
    for i in np.flatnonzero(first).tolist():
        left = others[top[others] != top[i]]
        if not len(left):
            continue
        for head in np.unique(top[near(i, left)]).tolist():
            found.append((top[i], head))
            top[top == head] = top[i]
    return found


def blocks(rows: DataFrame, count: str, node: str, spread: int, size: str = "0") -> DataFrame:
    """Adds ``__b`` (own block) and ``__x``, ``__y`` (pair of blocks): one row for every pair that holds the own block.

    Groups of up to 64 are whole; larger ones have up to ``spread`` blocks. There are more only where a block would go
    beyond 1,024 rows or, with the bytes of the group in ``size``, beyond ``BLOCK_BYTES``.
    """
    by_bytes = f"least({count}, ceil({size} / {BLOCK_BYTES}D))"
    n = F.expr(f"cast(greatest(1, ceil({count} / 1024D), {by_bytes}, least({spread}, ceil({count} / 64D))) as int)")
    own = rows.withColumn("__nb", n).withColumn("__b", F.pmod(F.xxhash64(node, F.lit(3)), F.col("__nb")).cast("int"))
    other = own.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return other.withColumns(
        {"__x": F.least("__b", "__o").cast("int"), "__y": F.greatest("__b", "__o").cast("int")}
    ).drop("__o", "__nb")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys, cut from sorted batches, and the bounds of the runs."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        change = np.zeros(held.num_rows, dtype=bool)
        for k in keys:
            column = held.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change).tolist()
        if cuts:
            yield held.slice(0, cuts[-1]), [0, *cuts]
            held = held.slice(cuts[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def fixed_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _fingerprints(docs: DataFrame, key: str, text: str, row: str | None) -> DataFrame:
    """Stored, with ``__row``: the numbers in ``row``, which must be distinct and fixed, or fresh ones."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", 4 << 20):
                texts = rows.column(1)
                same, sizes, marks, bands = [], [], [], []
                for text, shingles in zip(texts, shingle_sets(texts), strict=True):
                    value = minhash(shingles)
                    digest = xxhash.xxh3_128_digest(text.as_py() or "")
                    same.append(digest)
                    sizes.append(len(shingles))
                    marks.append((value & np.uint32(255)).astype(np.uint8).tobytes())
                    bands.append(band_keys(value) if len(shingles) else np.zeros(0, dtype=np.int64))
                lengths = np.asarray([len(b) for b in bands])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))
                yield pa.record_batch(
                    [rows.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists, rows.column(2)],
                    names=["__key", "__same", "__n", "__marks", "__bands", "__row"],
                )

    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), number.alias("__row"))
    kind = rows.schema["__key"].dataType.simpleString()
    made = rows.mapInArrow(work, f"__key {kind}, __same binary, __n long, __marks binary, __bands array<long>, __row long")
    return stored(made, "fingerprints")


def _bucket_edges(rows: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, bounds in whole_runs(batches, ["__band", "__value", "__x", "__y"]):
            marks = fixed_matrix(runs.column("__marks"), PERMUTATIONS)
            node = runs.column("__row").to_numpy()
            starts, sizes = np.asarray(bounds[:-1]), np.diff(bounds)
            # buckets of two, the most common, all at once
            pairs = starts[sizes == 2]
            matches = np.zeros(len(pairs), dtype=np.int64)
            for n, least in steps:
                matches += (marks[pairs, n - STEP:n] == marks[pairs + 1, n - STEP:n]).sum(axis=1)
                pairs, matches = pairs[matches >= least], matches[matches >= least]
            heads, tails = [node[pairs]], [node[pairs + 1]]
            side, x, y = (runs.column(c).to_numpy() for c in ("__b", "__x", "__y"))
            for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own, first = marks[a:a + size], side[a:a + size] == x[a]
                near = lambda i, left, m=own: left[surviving(m[i], m[left], steps)]
                root = np.arange(size)
                for part in (first, ~first):
                    at = np.flatnonzero(part)
                    root[at] = at[spanning(len(at), lambda i, left, n=near, p=at: np.searchsorted(p[left], n(p[i], p[left])))]
                if x[a] == y[a]:
                    linked = np.flatnonzero(root != np.arange(size))
                    pair = np.stack([root[linked], linked])
                else:
                    pair = np.sort(np.asarray(bridges(root, first, near), dtype=np.int64).reshape(-1, 2), axis=1).T
                heads.append(node[a + pair[0]])
                tails.append(node[a + pair[1]])
            ends = np.sort(np.stack([np.concatenate(heads), np.concatenate(tails)]), axis=0)
            yield pa.record_batch({"u": ends[0], "v": ends[1]})

    keys = ["__band", "__value", "__x", "__y"]
    return (
        rows.repartition(*keys).sortWithinPartitions(*keys, "__row")
        .mapInArrow(work, "u long, v long")
    )


def overlaps(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """``f(i, others)``: how many shingles row i shares with each of the others; by postings over the block."""
    lengths = np.asarray([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, code = np.unique(values, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(code))])
    begin = np.concatenate([[0], np.cumsum(lengths)])

    def shared(i: int, others: np.ndarray) -> np.ndarray:
        own = code[begin[i]:begin[i + 1]]
        counts = bounds[own + 1] - bounds[own]
        at = np.repeat(bounds[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(posted[at], minlength=len(sets))[others]

    return shared


def _verified(rows: DataFrame, threshold: float, steps: list[tuple[int, int]], across: bool) -> DataFrame:
    """Per row and pair of blocks the linked texts and documents, and edges (``__row``, ``__root``).

    Inside a block every row comes with the head of its verified component there. ``across`` two blocks rows carry that
    ``__head``; the edges are those that join components of the two, as rows without counts.
    """
    # similarity >= threshold as whole numbers: shared * (100 + t) >= t * (sizes), t in hundredths of a percent
    scale = 10_000
    t = round(threshold * scale)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (
            runs.slice(a, b - a) for runs, bounds in whole_runs(batches, ["__label", "__x", "__y"])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        )
        for group in tables:
            node = group.column("__row").to_numpy()
            if len(node) < 2 and across:
                continue
            x, y = group.column("__x")[0].as_py(), group.column("__y")[0].as_py()
            block, copies = group.column("__b").to_numpy(), group.column("__copies").to_numpy()
            marks = fixed_matrix(group.column("__marks"), PERMUTATIONS)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("__set").to_pylist()]
            sizes = np.asarray([len(s) for s in sets])
            shared = overlaps(sets)
            texts, docs = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            head = group.column("__head").to_numpy() if across else node
            top = dict(zip(head.tolist(), head.tolist(), strict=True))

            def topmost(h: int) -> int:
                while top[h] != h:
                    top[h] = h = top[top[h]]
                return h

            for i in range(len(node)):
                # each pair once: within a block the later rows, across blocks the rows of the other one
                others = np.arange(i + 1, len(node)) if x == y else (np.flatnonzero(block == y) if block[i] == x else [])
                if not len(others):
                    continue
                found = others[surviving(marks[i], marks[others], steps)]
                if len(found):
                    both = shared(i, found)
                    found = found[both * (scale + t) >= t * (sizes[i] + sizes[found])]
                texts[i] += len(found)
                docs[i] += copies[found].sum()
                texts[found] += 1
                docs[found] += copies[i]
                for h in np.unique(head[found]).tolist():
                    low, high = sorted((topmost(h), topmost(int(head[i]))))
                    top[high] = low
            if across:
                ends = [(h, topmost(h)) for h in top if topmost(h) != h]
                node = np.append(node, [h for h, _ in ends]).astype(np.int64)
                root = np.append(node[:len(texts)], [r for _, r in ends]).astype(np.int64)
                texts, docs = (np.append(c, np.zeros(len(ends), np.int64)) for c in (texts, docs))
            else:
                root = np.asarray([topmost(h) for h in node.tolist()], dtype=np.int64)
            yield pa.record_batch({"__row": node, "__texts": texts, "__docs": docs, "__root": root})

    keys = ["__label", "__x", "__y"]
    return (
        rows.repartition(*keys).sortWithinPartitions(*keys, "__row")
        .mapInArrow(work, "__row long, __texts long, __docs long, __root long")
    )


def _shingled(docs: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """Shingle sets of the texts in ``wanted(__row, __same, __first_key)``, which are told apart by their digests."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", 4 << 20):
                texts = rows.column(0)
                same = [xxhash.xxh3_128_digest(t.as_py() or "") for t in texts]
                sets = [s.tobytes() for s in shingle_sets(texts)]
                yield pa.record_batch([pa.array(same, pa.binary()), pa.array(sets, pa.binary())], names=["__same", "__set"])

    keys = small_side(wanted.select(F.col("__first_key").alias("__wanted")).distinct(), count, 64)
    texts = docs.join(keys, docs["__key"].eqNullSafe(keys["__wanted"]), "left_semi").select("__text")
    sets = texts.mapInArrow(work, "__same binary, __set binary").dropDuplicates(["__same"])
    return sets.join(wanted.select("__row", "__same"), "__same").select("__row", "__set")


def jaccard_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-9
) -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the smallest key of its class) and ``n_links``.

    ``n_links`` counts the other documents whose shingle sets have a Jaccard similarity of ``threshold`` or more with
    its own; copies count each. Words are the runs between ASCII white space, as they are. Texts of one to four words
    are one shingle. Null, empty and blank texts have no shingles, hence no links, and are classes of their own.
    Rows that repeat a key are documents of their own; a null key is the smallest. An empty table gives no rows. Other
    columns are not read.
    """
    rows = _row_classes(docs, key, text, None, threshold, tolerance)
    return rows.select(F.col("__key").alias(key), F.col("__class_key").alias("class_id"), F.col("__links").alias("n_links"))


def _row_classes(
    docs: DataFrame, key: str, text: str, row: str | None, threshold: float = 0.8, tolerance: float = 1e-9
) -> DataFrame:
    """``__key``, ``__row``, ``__class_key``, ``__class_row`` and ``__links`` of every document.

    The class is named by its row of the smallest key; of several rows with that key by the smallest digest of the text,
    then by the smallest row number.
    """
    steps = least_matches(threshold, tolerance)
    prints = _fingerprints(docs, key, text, row)
    full = prints.filter(F.col("__n") > 0)
    # equal texts: one node, named by the row of the smallest key
    same = full.groupBy("__same").agg(F.min(F.struct("__key", "__row")).alias("__first"), F.count(F.lit(1)).alias("__copies"))
    same = stored(same.select("__same", "__copies", F.col("__first.__key").alias("__first_key"), F.col("__first.__row").alias("__row")), "texts")
    nodes = same.select("__row", "__copies").join(full.select("__row", "__n", "__marks", "__bands"), "__row")
    nodes = stored(nodes, "text-nodes")
    bands = nodes.select("__row", F.posexplode("__bands").alias("__band", "__value"))
    sizes = bands.groupBy("__band", "__value").agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > 1)
    meeting = bands.join(sizes, ["__band", "__value"]).join(nodes.select("__row", "__marks"), "__row")
    loose = forest_components(_bucket_edges(blocks(meeting, "__size", "__row", 4), steps))
    loose = stored(
        loose.select(F.col("node").alias("__row"), F.col("label").alias("__label")).join(nodes.select("__row", "__n"), "__row"),
        "loose-groups",
    )
    loose_sizes = loose.groupBy("__label").agg(F.count(F.lit(1)).alias("__size"), F.sum(8 * F.col("__n")).alias("__bytes"))
    members = stored(loose.drop("__n").join(loose_sizes, "__label"), "groups")
    # the texts of the members alone, found by their digests
    wanted = stored(members.join(same, "__row").select("__row", "__same", "__first_key"), "member-texts")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    sets = stored(_shingled(texts, wanted, wanted.count()), "shingle-sets")
    inside = (
        members.join(nodes.select("__row", "__copies", "__marks"), "__row").join(sets, "__row")
    )
    pairs = blocks(stored(inside, "group-rows"), "__size", "__row", 16, "__bytes")
    within = stored(_verified(pairs.filter("__x = __y"), threshold, steps, False), "links-inside")
    heads = within.select("__row", F.col("__root").alias("__head"))
    between = pairs.filter("__x < __y").join(heads, "__row")
    between = stored(_verified(between, threshold, steps, True), "links-between")
    links = within.unionByName(between).groupBy("__row").agg(F.sum("__docs").alias("__docs"))
    tops = components(between.filter("__root <> __row").select(F.col("__root").alias("u"), F.col("__row").alias("v")))
    tight = heads.join(tops.select(F.col("node").alias("__head"), F.col("label").alias("__top")), "__head", "left")
    named = (
        same.join(tight.select("__row", F.coalesce("__top", "__head").alias("label")), "__row", "left")
        .join(links, "__row", "left")
        .withColumn("__class", F.coalesce("label", "__row"))
    )
    firsts = named.groupBy("__class").agg(F.min(F.struct("__first_key", "__same", "__row")).alias("__least"))
    firsts = firsts.select("__class", F.col("__least.__first_key").alias("__class_key"), F.col("__least.__row").alias("__class_row"))
    named = named.join(firsts, "__class").select(
        "__same", "__class_key", "__class_row", (F.col("__copies") - 1 + F.coalesce("__docs", F.lit(0))).alias("__links")
    )
    named = stored(named, "text-classes")
    columns = ["__key", "__row", "__class_key", "__class_row", F.col("__links").cast("long").alias("__links")]
    found = prints.filter(F.col("__n") > 0).join(named, "__same").select(columns)
    alone = prints.filter(F.col("__n") == 0).withColumns(
        {"__class_key": F.col("__key"), "__class_row": F.col("__row"), "__links": F.lit(0)}
    )
    return found.union(alone.select(columns))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row per class: the one of the smallest key, a null key being the smallest.

    Rows that repeat a key are documents of their own: of copies one stays, and a different text under the same key is
    judged by itself. Rows without words stay. ``docs`` is stored once, with row numbers.
    """
    rows = stored(docs.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    classes = _row_classes(rows, key, text, "__at", **settings)
    dropped = stored(classes.filter("__row <> __class_row").select(F.col("__row").alias("__at")), "near-copies")
    return rows.join(small_side(dropped, dropped.count(), 64), "__at", "left_anti").select(docs.columns)
