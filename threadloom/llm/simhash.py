"""SimHash near-duplicates: fingerprints, keys from a Golay code, verified links and their components."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, join_small, prepare, stored

#: Generator polynomial of the perfect binary Golay code of 23 bits, of which 12 are the word's index.
GOLAY = 0xC75
SEGMENT, CHECKS = 23, 11
#: Bytes of a text whose words are counted at a time.
TEXT_AT_ONCE = 1 << 18
#: Times that the groups' texts are held against the first of them.
STARS = 2
#: Texts of a group that are held against its head in one task, about.
GROUP_PART = 256
#: Fingerprints that share a key and are compared pair by pair; more are linked by the words around them.
CROWD = 4096
#: Rows of buckets that are compared in one task, about.
BUCKET_ROWS = 100_000
BLANK = re.compile(rb"[ \t-\r]")


@cache
def golay_errors() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; for each syndrome its errors of at most 4 bits, and how many.

    A syndrome has one error of at most 3 bits. If that has 3, five more have 4 bits, and the six share no bit and
    cover all 23: so two words that differ in at most 2 bits always share a code word at a distance of at most 4.
    """

    def syndrome(word: int) -> int:
        for bit in range(SEGMENT - 1, CHECKS - 1, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - CHECKS)
        return word

    of_bit = [syndrome(1 << b) for b in range(SEGMENT)]
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(SEGMENT), weight):
            s = 0
            for b in bits:
                s ^= of_bit[b]
            found[s].append(sum(1 << b for b in bits))
    errors = np.array([x + x[:1] * (6 - len(x)) for x in found], dtype=np.int64)

    def table(first: int, size: int) -> np.ndarray:
        out = np.zeros(1 << size, dtype=np.int64)
        for b in range(size):
            out[1 << b : 2 << b] = out[: 1 << b] ^ of_bit[first + b]
        return out

    return table(0, 12), table(12, 11), errors, np.array([len(x) for x in found])


def code_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words within 4 bits of each 23-bit segment, in 6 columns, and how many columns count."""
    low, high, errors, counts = golay_errors()
    s = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment[:, None] ^ errors[s]) >> CHECKS, counts[s]


def word_slices(text: bytes, size: int = TEXT_AT_ONCE) -> Iterator[list[bytes]]:
    """Words of a text between ASCII white space, in slices of about so many bytes; ASCII letters in lower case."""
    at = 0
    while at < len(text):
        gap = BLANK.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of the text's shingles of so many words, ASCII letters lower-cased; 0 if it has no word."""
    total, n, tail = np.zeros(64, dtype=np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        nonlocal n, total
        h = hashes(shingles)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(shingles)

    for w in word_slices(text or b""):
        w = tail + w
        if len(w) >= words:
            count(list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))))
        tail = w[len(w) - words + 1 :] if len(w) >= words else w
    if not n and tail:
        count([b" ".join(tail)])
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, more: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp) of every row, then the long columns `more`; fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64()), *b.columns[2:]], ["doc_id", "fp", *names])

    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"), *more)
    names = rows.columns[2:]
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}, fp bigint", *[f"{n} bigint" for n in names]]))


def link_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two fingerprints that differ in at most 3 bits share a key.

    Of four blocks of 16 bits, one is without error (pigeonhole). The other 48 bits hold two segments of 23: either
    both have at most 2 errors, and share a code word each, or one has 3 and the other none. A key is the block
    and both code words' indices (40 bits), or the block and one whole segment (39 bits).
    """
    x = fps.view(np.uint64)
    rows, keys = [], []
    for i in range(4):
        block = (x >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64)
        below = x & np.uint64((1 << 16 * i) - 1)
        rest = below | ((x >> np.uint64(16 * i)) >> np.uint64(16)) << np.uint64(16 * i)
        a, b = ((rest >> np.uint64(s) & np.uint64(0x7FFFFF)).astype(np.int64) for s in (0, SEGMENT))
        (ca, na), (cb, nb) = code_indices(a), code_indices(b)
        pair = ((i << 44) | (block << 24))[:, None, None] | ca[:, :, None] << 12 | cb[:, None, :]
        counts = (np.arange(6)[None, :, None] < na[:, None, None]) & (np.arange(6)[None, None, :] < nb[:, None, None])
        rows.append(np.nonzero(counts)[0])
        keys.append(pair[counts])
        for kind, segment in ((4 + i, a), (8 + i, b)):
            rows.append(np.arange(len(x)))
            keys.append((kind << 44) | (block << 23) | segment)
    return np.concatenate(rows), np.concatenate(keys)


def forest(table: pa.Table) -> pa.Table:
    """(a, b): links that join the same roots as all pairs of at most 3 differing bits in each bucket of (key, fp, root).

    At most one link less than there are roots, however many pairs are that near.
    """
    key, fp, root = (table.column(c).to_numpy() for c in ("key", "fp", "root"))
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    roots, code = np.unique(root[order], return_inverse=True)
    parent, links = np.arange(len(roots)), []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[(code[at] != code[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= 3)]
        for x, y in zip(code[near].tolist(), code[near + step].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((min(x, y), max(x, y)))
        if len(near):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            code = parent[code]
        step += 1
    ends = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": roots[ends[:, 0]], "b": roots[ends[:, 1]]})


def ball_links(crowd: DataFrame) -> DataFrame:
    """(a, b) of roots: links that join the same roots of `crowd` (fp, root) as all pairs of at most 3 differing bits.

    Two words are that near if and only if a third differs from one in at most 1 bit and from the other in at most
    2. So all within 2 bits of a word are linked if one is within 1 bit of it: rows grow with the fingerprints alone.
    """
    flips = [0, *(1 << i for i in range(64)), *((1 << i) + (1 << j) for i, j in combinations(range(64), 2))]

    def around(masks: list[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.array(masks, dtype=np.uint64).view(np.int64)
            for b in batches:
                fp, root = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ words).ravel()), pa.array(np.repeat(root, len(words)))], ["word", "root"])

        return crowd.select("fp", "root").mapInArrow(run, "word bigint, root bigint")

    heads = around(flips[:65]).groupBy("word").agg(F.min("root").alias("a"))
    return around(flips).join(heads, "word").filter("root <> a").select("a", F.col("root").alias("b")).distinct()


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(node, root) of each of the distinct fingerprints `fp` that differs from another in at most 3 bits.

    Root is the smallest fingerprint that can be reached. Exact, but the pairs aren't made, as n fingerprints near to
    each other have n * n of them. First each links to one smallest fingerprint of its buckets that is near. Buckets
    which then still hold several roots are compared pair by pair within a task, that returns a forest; in those of more
    than CROWD fingerprints words around them stand for the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                rows, keys = link_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    by = W.partitionBy("key")
    keyed = distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")
    bucket = keyed.select("key", "fp", F.min("fp").over(by).alias("head"), F.max("fp").over(by).alias("last"), F.count("*").over(by).alias("n"))
    met = stored(bucket.filter("n > 2 OR n = 2 AND bit_count(head ^ last) <= 3").drop("last"))
    stars = met.filter("fp <> head AND bit_count(fp ^ head) <= 3").groupBy("fp").agg(F.min("head").alias("head"))
    first = components(stars, "head", "fp")
    named = met.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    mixed = named.select("*", F.min("root").over(by).alias("lo"), F.max("root").over(by).alias("hi")).filter("lo <> hi")
    open_ = stored(mixed.select("key", "fp", "n", "root"))
    few = open_.filter(F.col("n") <= CROWD)
    parts = few.count() // BUCKET_ROWS + 1
    links = few.select("key", "fp", "root", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(forest, "a bigint, b bigint")
    crowd = open_.filter(F.col("n") > CROWD)
    if crowd.limit(1).count():
        links = links.unionByName(ball_links(stored(crowd.select("fp", "root").distinct())))
    links = stored(links)
    if not links.limit(1).count():
        return first
    second = components(links)
    alone = second.join(first, "node", "left_anti")
    moved = join_small(first, second.select(F.col("node").alias("root"), F.col("root").alias("to")), ["root"])
    return moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(alone.select("node", "root"))


def classed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row; root: the component's smallest fingerprint, which tells components apart."""
    prints = stored(fingerprints(docs, words))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = stored(distinct.join(fingerprint_components(distinct).withColumnRenamed("node", "fp"), "fp"))
    ids = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    named = join_small(linked, ids, ["root"], "inner").select("fp", "component_id", "root")
    # Stored, so that both sides of the last join come from a shuffle of their own, which Spark can split at a hot key.
    classes = stored(distinct.join(named, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text).

    Rows whose fingerprints differ in at most 3 bits are linked; component_id is the smallest id that can be reached.
    Copies share a fingerprint, and only distinct fingerprints are compared. A null or blank text has fingerprint 0
    and is linked like any other. Null ids never become a component's id, unless all of its ids are null. An empty
    table gives an empty result. Other columns of `docs` are not read.
    """
    return classed(docs, words).drop("root")


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of a text's distinct shingles of so many words, as `fingerprint` has them."""
    tail, found = [], [np.zeros(0, np.int64)]
    some = False
    for w in word_slices(text or b""):
        w = tail + w
        if len(w) >= words:
            found.append(np.unique(hashes(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))))
            some = True
        tail = w[len(w) - words + 1 :] if len(w) >= words else w
    if not some and tail:
        found.append(hashes([b" ".join(tail)]))
    return np.unique(np.concatenate(found))


def hashes(shingles) -> np.ndarray:  # noqa: ANN001
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8").view("<i8")


TEXT = ["t1", "t2"]


def text_hashes(text: str) -> list:
    """Two hashes that tell texts apart."""
    t = F.col(text).cast("string")
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t, F.length(t)).alias("t2")]


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, print_words: int = 2) -> DataFrame:
    """The documents without those that have a near-duplicate among the kept ones. Columns stay as they are.

    Texts are grouped by linked fingerprints of `print_words` words (3 bits). In each group the text with the smallest
    id stays, and all go whose Jaccard similarity to it, over sets of shingles of `words` words, is at least
    `similarity`; what is left of the group is gone through so STARS times. Of what is then left, links are verified one
    by one, and of each component of verified links the text with the smallest id stays. So nothing goes without a
    verified link, and the number of passes doesn't grow with the input. Of equal texts the row with the smallest id stays.

    Null ids come after all others, and of rows with one id and text one stays. Null, empty and blank texts have no
    shingle and are alike. An empty table gives an empty result. A column named t1 or t2 is none of the operator's.
    """
    prints = stored(fingerprints(docs, print_words, text_hashes("text")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    texts = stored(prints.groupBy(*TEXT, "fp").agg(F.min(order).alias("least")))
    distinct = stored(texts.select("fp").distinct())
    roots = distinct.join(fingerprint_components(distinct).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # A fingerprint may be that of many texts: the join's sides are stored, so that Spark can split it there.
    grouped = stored(texts.join(stored(roots), "fp").select(*TEXT, "fp", "root", "least"))
    sizes = stored(grouped.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1"))
    open_ = stored(with_sets(docs, stored(grouped.join(sizes, "root")), words))
    alone = grouped.join(sizes.select("root"), "root", "left_anti").select(*TEXT, "least")
    kept = [alone]
    for _ in range(STARS):
        heads = stored(open_.groupBy("root").agg(F.min_by(F.struct(*TEXT, "least", "s"), F.struct("least", *TEXT)).alias("head")))
        kept.append(heads.select("head.t1", "head.t2", "head.least"))
        # A group of many texts meets its head in parts.
        parts = F.ceil(F.col("size") / GROUP_PART).cast("int")
        dealt = heads.join(sizes, "root").select("root", "head", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        met = open_.withColumn("part", F.pmod("t1", parts)).join(dealt, ["root", "part"]).filter(alike("s", "head.s", similarity))
        # Left out rather than joined on: the size that Spark expects of the rows then doesn't grow with the rounds.
        open_ = stored(open_.join(met.select(*TEXT), TEXT, "left_anti"))
    kept.append(least_of_linked(open_, similarity))
    stays = kept[0]
    for more in kept[1:]:
        stays = stays.unionByName(more)
    ids = ["doc_id", *TEXT]
    stays = stays.select(F.col("least.doc_id").alias("doc_id"), *TEXT)
    goes = stored(prints.select(*ids).join(stays, matches(prints, stays, ids), "left_anti").distinct())
    marked = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", *text_hashes("text"))
    # What goes grows with the input, so it is never broadcast.
    left = marked.join(goes.hint("merge"), matches(marked, goes, ids), "left_anti")
    if prints.groupBy(*ids).count().filter("count > 1").limit(1).count():
        own = W.partitionBy(*ids).orderBy(F.to_json("__row"))
        left = left.withColumn("__n", F.row_number().over(own)).filter("__n = 1")
    return left.select("__row.*")


def alike(a: str, b: str, similarity: float) -> Column:
    """Whether two sets' Jaccard similarity is at least so much; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return (whole == 0) | (shared >= F.lit(similarity) * whole)


def least_of_linked(texts: DataFrame, similarity: float) -> DataFrame:
    """(t1, t2, least) of the first text of each component of verified links among `texts` (t1, t2, fp, root, least, s).

    Two texts are linked whose fingerprints differ in at most 3 bits and whose sets are alike. Sets that are share one
    of the rarest shingles of each: of n shingles, rarest in their group first, those that `similarity` lets differ and
    one more. Each text is first held against one head of such a bucket; then pairs across what that linked are made.
    """
    own = stored(texts.select(F.struct("least", *TEXT).alias("node"), "root", "fp", "s"))
    size, by = F.size("s"), W.partitionBy("root", "h")
    # Empty sets are alike, so they share a shingle of their own; 1e-9 more, as the product is rounded.
    rarest = size - F.ceil(size * F.lit(similarity) - 1e-9) + 1
    shingles = own.select("node", "root", "fp", size.alias("size"), rarest.alias("rarest"), F.explode(F.when(size == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("s"))).alias("h"))
    ranked = shingles.withColumn("n", F.count("*").over(by)).withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy("n", "h")))
    met = stored(
        ranked.filter("n > 1 AND rank <= rarest")
        .select("node", "root", "fp", "size", "rank", "h", F.min(F.struct("node", "fp", "size", "rank")).over(by).alias("head"), F.count("*").over(by).alias("n"))
        .filter("n > 1")
    )

    def may(a: str, b: str) -> Column:
        sizes = F.col(f"{a}size"), F.col(f"{b}size")
        # What both can share if this is the first shingle that they share, as one of their buckets is.
        shared = F.least(*(F.col(f"{x}size") - F.col(f"{x}rank") + 1 for x in (a, b)))
        enough = shared * F.lit(1 + similarity) >= (sizes[0] + sizes[1]) * F.lit(similarity) - 1e-6
        return (F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= 3) & (F.least(*sizes) >= F.greatest(*sizes) * F.lit(similarity) - 1e-9) & enough

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = own.select(F.col("node").alias("a"), F.col("s").alias("sa")), own.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        return stored(pairs.join(x, "a").join(y, "b").filter(alike("sa", "sb", similarity)).select("a", "b"))

    heads = met.filter("node <> head.node").filter(may("", "head.")).groupBy("node", F.col("head.node").alias("head")).count()
    stars = verified(heads.groupBy(F.col("node").alias("b")).agg(F.max_by("head", F.struct("count", "head")).alias("a")))
    found = components(stars)
    named = met.join(found.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_ = stored(named.select("node", "root", "fp", "size", "rank", "h", "part", F.min("part").over(by).alias("lo"), F.max("part").over(by).alias("hi")).filter("lo <> hi"))
    pairs = open_.alias("x").join(open_.alias("y"), F.expr("x.root = y.root AND x.h = y.h AND x.node < y.node AND x.part <> y.part") & may("x.", "y."))
    across = verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    if across.limit(1).count():
        found = components(stars.unionByName(across))
    gone = found.filter("node <> root").select("node")
    return own.select("node").join(gone, "node", "left_anti").select("node.t1", "node.t2", "node.least")


def matches(a: DataFrame, b: DataFrame, columns: list[str]):  # noqa: ANN201
    """Equality of columns in which nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def with_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """classes (t1, t2, fp, root, least, size) with `s`: the hashes of the shingles of each class's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(2).cast(pa.binary())]
            ends = np.append(0, np.cumsum([len(x) for x in sets], dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["t1", "t2", "s"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *text_hashes("text"))
    wanted = classes.select(F.col("least.doc_id").alias("doc_id"), *TEXT)
    # One row for each class: its text's row with the smallest id, of repeated rows any, as their texts are equal.
    own = rows.join(wanted.hint("merge"), matches(rows, wanted, ["doc_id", *TEXT]), "left_semi").select(*TEXT, "text")
    sets = own.mapInArrow(run, "t1 bigint, t2 bigint, s array<bigint>").dropDuplicates(TEXT)
    return classes.join(sets, TEXT)
