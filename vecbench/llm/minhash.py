"""MinHash near-duplicate detection with b-bit signatures (operator 10).

1. One scan sketches every text: class digest (equal word sequences are one class), size of the
   shingle set, 32 band keys of four minima, and the packed low four bits of 128 minima.
2. Star pass: in every band bucket each class meets the bucket's smallest class. A group of copies of
   any size gives one candidate a member, never all its pairs.
3. Pivot turns: in buckets that still hold several components, the classes outside the largest one meet
   members of it (one a bucket, of the four largest components), drawn anew each turn, as long as comparing them with all would be much work and turns help.
4. Rest pass: the classes still outside meet all others of their bucket. With that every colliding pair
   of different components was seen, so no link that the bands find is lost. Large buckets are compared in blocks, by
   products of 0/1 matrices over the shingles that two blocks share; a link of each two components leaves a block.
5. Candidates are sifted by the collision-corrected b-bit estimate (five standard deviations below the
   threshold) and confirmed on full shingle sets.

A class has one row from the first step on, however often its text is repeated; it is known by the number of its
first row in the written sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import WordHashes, binary, discard, hash_family, mixed, semi_by_key, settle, shingles, skew_join, unused

PERMUTATIONS, ROWS, BITS = 128, 4, 4
PER_LONG = 64 // BITS
LONGS = PERMUTATIONS // PER_LONG
#: Fixed bit mask: the lowest bit of every four.
LOW_BITS = 0x1111111111111111
#: Turns of new pivots at most, before the rest is compared in full, and pivots that a class meets in a turn.
PIVOT_TURNS = 3
PIVOTS = 4
#: Comparisons a class and bucket that the rest pass may take on without further turns (a block makes millions a second).
COMPARISONS = 512
#: Classes of a bucket whose pairs are listed; larger ones are compared in blocks of so many classes and shingles, about.
SMALL_BUCKET = 32
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 2_000_000
COLUMNS = 4096
SKETCH = "row long, doc_id long, digest binary, n_shingles long, bands array<long>, signature array<long>"
_A, _B = hash_family(PERMUTATIONS, 20_011)
_HASHES = WordHashes()


def words(text: bytes) -> list[bytes]:
    """Words between space and the characters 9 to 13, A-Z lower-cased."""
    return text.lower().split()


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingles(_HASHES.of(words(text)), width)) if text else np.empty(0, np.uint64)


def minima(values: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Minimum of every hash function over ``values``, in slices of bounded size."""
    best = np.full(len(a), np.iinfo(np.uint64).max)
    for k in range(0, len(values), 512):
        np.minimum(best, (a[:, None] * values[None, k : k + 512] + b[:, None]).min(axis=1), out=best)
    return best


def digest_of(text: bytes) -> bytes:
    """The same for equal word sequences."""
    return xxhash.xxh3_128_digest(b" ".join(words(text)))


def _sketch(width: int):
    powers = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    bands = np.arange(PERMUTATIONS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)

    def one(text: bytes | None):
        values = shingle_set(text, width)
        if not len(values):
            return None, 0, None, None
        low = minima(values)
        keys = mixed((low.reshape(-1, ROWS) * powers).sum(axis=1, dtype=np.uint64) + bands)
        packed = ((mixed(low) & np.uint64(2**BITS - 1)).reshape(LONGS, PER_LONG) << shifts).sum(axis=1, dtype=np.uint64)
        return digest_of(text), len(values), keys.view(np.int64), packed.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                seen: dict = {}
                rows = []
                for text in binary(part.column(2)):
                    if text not in seen:
                        seen[text] = one(text)
                    rows.append(seen[text])
                digest, n, keys, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                    ["row", "doc_id", "digest", "n_shingles", "bands", "signature"])
    return run


def sketch(rows: DataFrame, width: int = 5) -> DataFrame:
    """row, doc_id, digest, n_shingles, bands, signature of every row (row, doc_id, text); null digest: no words."""
    return rows.select("row", "doc_id", "text").mapInArrow(_sketch(width), SKETCH)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                texts = binary(batch.column(0).slice(k, 1024))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest_of(t or b"") for t in texts], pa.binary()),
                     pa.array([shingle_set(t, width).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["digest", "shingles"])
    return run


def estimate(x: str, y: str) -> Column:
    """Similarity from two packed signatures: the share of equal b-bit minima, less the share
    2**-b of the rest that is equal by chance."""
    apart = None
    for k in range(LONGS):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(
            F.shiftrightunsigned(d, 2).bitwiseOR(F.shiftrightunsigned(d, 3)))
        d = F.bit_count(d.bitwiseAND(F.lit(LOW_BITS)))
        apart = d if apart is None else apart + d
    chance = 2.0**-BITS
    return (1 - apart / F.lit(PERMUTATIONS) - F.lit(chance)) / F.lit(1 - chance)


def estimate_floor(threshold: float) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - 5 * math.sqrt(equal * (1 - equal) / PERMUTATIONS) / (1 - chance)


def similar(x: str, y: str, percent: int) -> Column:
    """100 * intersection >= percent * union, of two columns of full sets."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def _linked(percent: int):
    """Links between two blocks of classes (a bucket's outsiders, and all of it): one of each two components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.combine_chunks(), right.combine_chunks()
        if not a.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sides = []
        for t in (a, b):
            lists = t.column("shingles").chunk(0)
            sides.append((lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())))
        common = np.intersect1d(*[np.unique(v) for v, _ in sides], assume_unique=True)
        both = np.zeros((a.num_rows, b.num_rows), np.float32)
        places = []
        for values, size in sides:
            at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
            hit = common[at] == values if len(common) else np.zeros(len(values), bool)
            row, at = np.repeat(np.arange(len(size)), size)[hit], at[hit]
            order = np.argsort(at, kind="stable")
            places.append((row[order], at[order]))
        for k in range(0, len(common), COLUMNS):
            marks = []
            for (row, at), (_, size) in zip(places, sides, strict=True):
                lo, hi = np.searchsorted(at, (k, k + COLUMNS))
                m = np.zeros((len(size), min(COLUMNS, len(common) - k)), np.float32)
                m[row[lo:hi], at[lo:hi] - k] = 1
                marks.append(m)
            both += marks[0] @ marks[1].T
        union = sides[0][1][:, None] + sides[1][1][None, :] - both
        x, cx, y, cy = (t.column(c).to_numpy() for t in (a, b) for c in ("id", "comp"))
        big = b.column("big").to_numpy()
        r, c = np.nonzero((100.0 * both >= percent * union) & (cx[:, None] != cy[None, :]) & (big[None, :] | (x[:, None] < y[None, :])))
        _, first = np.unique(np.stack([cx[r], cy[c]]), axis=1, return_index=True)
        r, c = r[first], c[first]
        return pa.table({"a": np.maximum(x[r], y[c]), "b": np.minimum(x[r], y[c])})
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on the full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").filter(similar("sa", "sb", percent)).select("a", "b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): smallest node reachable over ``links`` (a, b), for all nodes of a link.

    Every round takes the smallest label among neighbours and then that label's own label, so chains
    halve; a round's table is written to the shared folder. Fails rather than return unfinished labels.
    """
    edges = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    held = labels
    for _ in range(rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("comp").alias("up"))
        new = settle(step.join(up, "c", "left").select("node", "old", F.least("c", F.coalesce("up", "c")).alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        discard(held)
        held, labels = new, new.select("node", "comp")
        if not changed:
            discard(edges)
            return labels
    raise RuntimeError(f"components: labels still change after {rounds} rounds")


def grouped(rows: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: row, doc_id, digest, n_shingles of every row of ``rows`` (row, doc_id, text), and (digest, id, comp) of
    every class, comp being the smallest id of its component. Rows without ``row`` belong to no class.

    A ``row`` need not be unique, but then all its texts are hashed where one of them is asked for.
    """
    whole = settle(sketch(rows, width).withColumn("number", F.monotonically_increasing_id()), "sketch")
    named = whole.filter("row is not null and digest is not null")
    heads = settle(named.groupBy("digest").agg(F.min(F.struct("number", "row")).alias("first"), F.first("n_shingles").alias("n_shingles"),
                                               F.first("bands").alias("bands"), F.first("signature").alias("signature"))
                   .select(F.col("first.number").alias("id"), "digest", F.col("first.row").alias("row"), "n_shingles", "bands", "signature"), "classes")
    keys = heads.select(F.explode("bands").alias("key"), "id")
    first = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot <> last").select("key", "pivot")
    met = settle(keys.join(first, "key"), "buckets")
    one = heads.select("id", F.struct("n_shingles", "signature").alias("s"))
    floor = estimate_floor(percent / 100)

    def likely(x: str, y: str) -> Column:
        """Sizes allow the similarity, and so does the estimate."""
        small, large = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
        return (100 * small >= percent * large) & (estimate(f"{x}.signature", f"{y}.signature") >= floor)

    def sifted(pairs: DataFrame) -> DataFrame:
        a = one.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        b = one.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        return settle(pairs.distinct().join(a, "a").join(b, "b").filter(likely("sa", "sb")).select("a", "b"), "pairs")

    members = settle(met.select("id").distinct().join(heads.select("id", "digest", "row"), "id"), "members")
    sets = semi_by_key(rows.select("row", "text"), members, "row").select("text").mapInArrow(_sets(width), "digest binary, shingles array<long>")
    sets = settle(sets.dropDuplicates(["digest"]).join(members.select("digest", "id"), "digest").select("id", "shingles"), "sets")

    tested = sifted(met.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    links = settle(confirmed(tested, sets, percent), "links")
    comp = components(links)
    done = [heads, met, members, sets, tested, links]
    budget, last, open_rows = COMPARISONS * met.count(), math.inf, met.select("key", "id")
    for turn in range(PIVOT_TURNS + 1):
        # buckets that still hold several components, with the largest one and members of it
        held = settle(open_rows.join(comp.withColumnRenamed("node", "id"), "id", "left")
                      .select("key", "id", F.coalesce("comp", "id").alias("comp")), "held")
        counts = held.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("pivot"))
        main = settle(counts.groupBy("key").agg(F.max_by(F.struct("comp", "pivot", "n"), F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"),
                                                F.count("*").alias("parts")).filter("parts > 1"), "main")
        done += [held, main]
        work = main.agg(F.sum((F.col("all") - F.col("main.n")) * F.col("all"))).first()[0] or 0
        if turn == PIVOT_TURNS or work <= budget or work > 0.7 * last:  # few comparisons, or turns no longer help
            break
        last, open_rows = work, held.join(main.select("key"), "key", "left_semi").select("key", "id")
        outside = held.join(main.select("key", "main"), "key").filter(F.col("comp") != F.col("main.comp")) \
            .groupBy("id").agg(F.sort_array(F.collect_set(F.struct("main.n", "main.pivot")), asc=False).alias("met")) \
            .select("id", F.explode(F.slice("met.pivot", 1, PIVOTS)).alias("pivot"))  # one a band at most, of the largest components
        pairs = outside.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"))
        pairs = sifted(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        new = settle(confirmed(pairs, sets, percent), "links")
        done += [pairs, new]
        tested = tested.union(pairs)
        if new.limit(1).count():
            links = links.union(new)
            comp = components(links)

    # what is left: classes outside the largest component of a bucket meet all others of it
    left = settle(held.join(main.select("key", "all", F.col("main.comp").alias("main")), "key").join(one, "id"), "left")

    # small buckets give a bounded number of pairs a class
    small = left.filter(F.col("all") <= SMALL_BUCKET)
    x = small.filter("comp <> main").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("s").alias("sx"))
    y = small.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("s").alias("sy"), (F.col("comp") == F.col("main")).alias("big"))
    few = x.join(y, "key").filter((F.col("cx") != F.col("cy")) & (F.col("big") | (F.col("x") < F.col("y"))) & likely("sx", "sy"))
    few = settle(few.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs")
    # large ones bring the sets along, in blocks of bounded size: every block of outsiders meets every block
    large = left.filter(F.col("all") > SMALL_BUCKET).select("key", "id", "comp", "main", F.col("s.n_shingles").alias("n"))
    blocks = large.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    large = settle(large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sets, "id"), "large")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = large.filter("comp <> main").select("key", F.col("own").alias("i"), each.alias("j"), "id", "comp", "shingles")
    y = large.select("key", each.alias("i"), F.col("own").alias("j"), "id", "comp", "shingles", (F.col("comp") == F.col("main")).alias("big"))
    linked = x.groupBy("key", "i", "j").cogroup(y.groupBy("key", "i", "j")).applyInArrow(_linked(percent), "a long, b long")
    more = settle(confirmed(few, sets, percent).union(linked), "links")
    if more.limit(1).count():
        comp = components(links.union(more))
    found = settle(heads.select("digest", "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
                   .select("digest", "id", F.coalesce("comp", "id").alias("comp")), "components")
    discard(*done, left, few, large, more)
    return whole, found


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``width``-word shingles have 100 * |intersection| >=
    percent * |union|. component_id is the smallest doc_id that links reach; rows are judged by their own text, so
    repeated rows get the same answer each, and a row that repeats a doc_id with another text gets the component of
    its own text (which says nothing of the other text's). Null or wordless text: n_shingles 0, linked with nothing. Null
    doc_id: component_id null, kept true, linked with nothing. Any further columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.col("doc_id"))
    whole, comp = grouped(rows, percent, width)
    least = whole.filter("row is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least")).join(comp, "digest")
    found = settle(least.select("digest", "comp").join(least.groupBy("comp").agg(F.min("least").alias("component")), "comp")
                   .select("digest", "component"), "components")
    out = skew_join(whole.select("doc_id", "digest", "n_shingles"), found, ["digest"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: that with the smallest doc_id (null ones last),
    of several with it the first in the table that this writes.

    Every row is judged by itself and its own text, whatever its doc_id: of fully repeated rows and of copies with null doc_ids one
    stays, and a row that shares its doc_id with a copy of another text stays if its own text has no smaller one. Null or
    wordless texts are near-duplicates of nothing and all stay. An empty table gives an empty result.
    """
    row = unused(docs, "row")
    docs = settle(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    text = docs.select(F.col(f"`{row}`").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole, comp = grouped(text, percent, width)
    classes = whole.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    one = classes.join(comp, "digest").groupBy("comp").agg(F.min("head").alias("head"))
    gone = whole.filter("digest is not null").select("row").join(one.select(F.col("head.row").alias("row")), "row", "left_anti")
    gone = gone.withColumnRenamed("row", row)
    return semi_by_key(docs, gone, row, "left_anti").drop(row)
