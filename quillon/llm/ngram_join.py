"""N-gram Jaccard join: a size-aware heavy-light self-join of word-shingle sets, exact at the threshold of 3/4.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets are one node (a 128-bit digest). Pairs:

* Small sets (at most x shingles; x minimises an estimate of both costs) enumerate the subsets of each fixed size that a link
  needs, and meet in equal subsets.
* Large sets meet in inverted lists over a prefix: with all tokens in one global order, two linked sets share a token within the first
  n - ceil(3n/4) + 1 of each. Any order is right; rare tokens first keeps lists short. Order: a level from document counts over
  the whole corpus, then the hash. Counts are exact per 40-bit hash, are made by a packed shuffle, and reach the tasks as a
  bitmap of fixed size (tokens in two documents or more) and a level table of fixed size. A crowded bitmap only worsens the
  order. Tokens in one document make no list entry at all, so most documents of a corpus without copies emit nothing.

The boundary x is at most MOST_SMALL, a bound of cost alone: larger small sets would have more subsets than any list has entries. Sets above it
go by lists, so no link is lost to it.

Long lists are never paired up as a whole: each list's set with the fewest rare tokens is its pivot and is compared with the others; what that links
is one component. Only lists with sets of several components are joined further, across components, behind the length and
position bounds (PPJoin), which rule out most. That join is cut into cells: a list's sets fall into blocks of about BLOCK sets by hash and into bands of length (a
set can only link with those of its own and the next bands), and two blocks meet in one cell, so that no task gets more than BLOCK * BLOCK pairs
however long the list. Every candidate is verified on the whole sets. Components come from label
propagation. Nothing is collected but the two fixed-size tables and a histogram of 17 counts.

Null and empty texts have no set and link with nothing; equal or repeated rows link through their common node; a null id
keeps a null component if nothing links it. Ids are of any type with an order. Columns beside id and text don't enter.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Scratch, blocks, hash_spans, lean, mix, plain_names, read, words
from .graph import components

N = 5  # words in a shingle
COUNT_BITS = 40  # of the hash, for counting
SEEN_BITS = 27  # bits of the bitmap of tokens in two or more documents: 16 MB
LEVEL_BITS = 20  # entries of the level table: 1 MB
HEAVY = 16  # documents beyond which a token gets a level by its count
MOST_SMALL = 8  # no boundary above this: subsets would outnumber any list
BLOCK = 512  # sets of a list in one block

_U = np.uint64
_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def needed(s: int, t: int) -> int:
    """The least intersection of linked sets of these sizes: 100 i >= 75 (s + t - i)."""
    return -(-3 * (s + t) // 7)


def prefix(n: int) -> int:
    return n + (-3 * n // 4) + 1


def subset_sizes(n: int, x: int) -> list[int]:
    return sorted({needed(n, k) for k in range(-(-3 * n // 4), 4 * n // 3 + 1) if min(n, k) <= x})


def sets(data: np.ndarray, off: np.ndarray):
    """The sorted distinct shingle hashes of each row; empty without words."""
    data = LOWER[data]
    starts, ends, rows = words(data, off)
    h = hash_spans(data, starts, ends)
    n = len(off) - 1
    cuts = np.searchsorted(rows, np.arange(n + 1))
    full = np.zeros(0, _U)
    if len(h) >= N:
        full = h[: len(h) - N + 1] * _STEP[0]
        for k in range(1, N):
            full = mix(full) + h[k : len(h) - N + 1 + k] * _STEP[k]
        full = mix(full)
    for i in range(n):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if b - a >= N:
            yield np.unique(full[a : b - N + 1])
        elif b > a:
            one = np.array([b - a], _U)
            for k in range(a, b):
                one = mix(one + h[k : k + 1] * _STEP[k - a])
            yield one
        else:
            yield full[:0]


# --- counts ------------------------------------------------------------------------------------------------------


def _encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, in byte planes that the shuffle's codec can compress; counts stop at 65535."""
    d = np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    c = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
    return np.ascontiguousarray(np.concatenate([d, c], 1).T).tobytes()


def _decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(7, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :5] = planes[:5].T
    return np.cumsum(wide.view("<u8").ravel()), np.ascontiguousarray(planes[5:].T).view("<u2").ravel().astype(np.int64)


def _counter(range_bits: int):
    def run(batches):
        held, n, small = [], 0, np.zeros(18, np.int64)

        def flush():
            keys = np.concatenate(held)
            held.clear()
            keys >>= _U(64 - COUNT_BITS)
            keys.sort()
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts, keys = np.diff(at, append=len(keys)), keys[at]
            span = keys >> _U(COUNT_BITS - range_bits)
            first = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
            last = np.append(first[1:], len(keys))
            packed = [_encode(keys[a:b], counts[a:b]) for a, b in zip(first, last, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(span[first].astype(np.int32)), pa.array(packed, pa.binary())], ["span", "packed"])

        for b in batches:
            for _, _, data, off in blocks(b.column("text")):
                for s in sets(data, off):
                    if len(s):
                        held.append(s)
                        n += len(s)
                        small[min(len(s), 17)] += 1
                if n >= 1 << 21:
                    yield flush()
                    n = 0
        if n:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([small.astype("<i8").tobytes()], pa.binary())], ["span", "packed"])

    return run


def _merger(range_bits: int):
    def run(table: pa.Table) -> pa.Table:
        span, packed = table.column("span")[0].as_py(), table.column("packed").to_pylist()
        if span < 0:
            total = np.sum([np.frombuffer(x, "<i8") for x in packed], 0).astype("<i8").tobytes()
            return pa.table({"span": pa.array([span], pa.int32()), "seen": pa.array([total], pa.binary()), "level": pa.array([b""], pa.binary()), "many": [0], "entries": [0]})
        parts = [_decode(x) for x in packed]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df, keys = np.add.reduceat(counts, first), keys[first]
        many = df >= 2
        seen = np.zeros(1 << (SEEN_BITS - range_bits), bool)
        seen[(keys[many] >> _U(COUNT_BITS - SEEN_BITS)).astype(np.int64) & (len(seen) - 1)] = True
        level = np.zeros(1 << (LEVEL_BITS - range_bits), np.uint8)
        heavy = df > HEAVY
        np.maximum.at(level, (keys[heavy] >> _U(COUNT_BITS - LEVEL_BITS)).astype(np.int64) & (len(level) - 1), np.log2(df[heavy]).astype(np.uint8))
        return pa.table({"span": pa.array([span], pa.int32()), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary()), "many": [int(many.sum())], "entries": [int(df[many].sum())]})

    return run


class Order:
    """The global order of tokens: level, then hash; and the boundary between small and large sets."""

    def __init__(self, seen: np.ndarray, level: np.ndarray, small: int):
        self.seen, self.level, self.small = seen, level, small

    def levels(self, h: np.ndarray) -> np.ndarray:
        """0: in one document only; 1: in a few; else log2 of the count."""
        at = h >> _U(64 - SEEN_BITS)
        bit = (self.seen[(at >> _U(3)).astype(np.int64)] >> (7 - (at & _U(7))).astype(np.uint8)) & 1
        return np.where(bit > 0, np.maximum(self.level[(h >> _U(64 - LEVEL_BITS)).astype(np.int64)], 1), 0).astype(np.uint8)


def boundary(sizes: np.ndarray, list_length: float) -> int:
    """The x of the least cost: subsets of all sets that may meet a small one, and list entries times their list's length of the others."""
    def cost(x: int) -> float:
        subsets = sum(sizes[n] * comb(n, c) for n in range(1, 4 * x // 3 + 1) for c in subset_sizes(n, x))
        return subsets + sum(sizes[n] * prefix(n) * list_length for n in range(x + 1, 17))

    return min(range(MOST_SMALL + 1), key=cost)


def token_order(docs: DataFrame) -> Order:
    """docs: (id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(max(8, (4 * parts - 1).bit_length()), LEVEL_BITS)
    counted = docs.select("text").mapInArrow(lean(_counter(range_bits)), "span int, packed binary")
    merged = counted.groupBy("span").applyInArrow(_merger(range_bits), "span int, seen binary, level binary, many long, entries long")
    seen, level = np.zeros(1 << (SEEN_BITS - 3), np.uint8), np.zeros(1 << LEVEL_BITS, np.uint8)
    sizes, many, entries = np.zeros(18, np.int64), 0, 0
    table = merged.toArrow()  # in all, the fixed bytes of both tables and one row for each hash range
    for span, s, l, m, e in zip(*(table.column(c).to_pylist() for c in ("span", "seen", "level", "many", "entries")), strict=True):
        if span < 0:
            sizes = np.frombuffer(s, "<i8")
            continue
        seen[span * len(s) : (span + 1) * len(s)] = np.frombuffer(s, np.uint8)
        level[span * len(l) : (span + 1) * len(l)] = np.frombuffer(l, np.uint8)
        many, entries = many + m, entries + e
    return Order(seen, level, boundary(sizes, entries / max(many, 1)))


# --- list entries ------------------------------------------------------------------------------------------------


def entries(s: np.ndarray, order: Order, level: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(key, place) of one set: subsets at place 0, prefix tokens at their place in the order."""
    n, out = len(s), []
    level = order.levels(s) if level is None else level
    if n <= 4 * order.small // 3:
        for size in subset_sizes(n, order.small):
            if int((level > 0).sum()) >= size:  # a subset with a token of this document alone meets nothing
                out += [(int(mix(np.array([sum(map(int, c)) & 0xFFFFFFFFFFFFFFFF], _U) * _STEP[1] + _U(size))[0].astype(np.int64)), 0) for c in combinations(mix(s[level > 0]), size)]
    if n > order.small:
        at = np.argsort(level, kind="stable")[: prefix(n)]
        out += [(int(k), int(i)) for i, k in enumerate(s[at].astype(np.int64)) if level[at[i]]]
    return out


_DOC = {"n": "int", "node": "binary", "entries": "array<struct<key:bigint,place:int>>", "shingles": "binary"}


def _emitter(handle):
    kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())]))

    def run(batches):
        order, done = handle.value, set()
        for b in batches:
            sizes, nodes, lists, shingles = [], [], [], []
            for _, _, data, off in blocks(b.column("text")):
                block = list(sets(data, off))
                levels = order.levels(np.concatenate(block))
                at = 0
                for s in block:
                    n = len(s)
                    level, at = levels[at : at + n], at + n
                    node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
                    found = []
                    # A copy of a set that this task has seen has the same entries; most sets have too many tokens of their own for any.
                    if n and node not in done and (n <= order.small or int((level == 0).sum()) < prefix(n)):
                        found = entries(s, order, level)
                        if len(done) < 1 << 17:
                            done.add(node)
                    sizes.append(n)
                    nodes.append(node)
                    lists.append([{"key": k, "place": i} for k, i in found] if found else None)
                    shingles.append(s.tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(sizes, pa.int32()), pa.array(nodes, pa.binary()), pa.array(lists, kind), pa.array(shingles, pa.binary())], ["id", "mark", "n", "node", "entries", "shingles"])

    return run


# --- join --------------------------------------------------------------------------------------------------------


def _may_link(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and position bounds for sets of n and m tokens that meet first at places i and j."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - i, m - j) >= 3 * (n + m))


def _verify(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    a = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist(), strict=True):
                s, t = np.frombuffer(s, _U), np.frombuffer(t, _U)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                keep.append(7 * int((both[1:] == both[:-1]).sum()) >= 3 * len(both))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a binary, b binary")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _across(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (node, node2) of a list's rows (key, node, n, place, label) with different labels that the bounds allow, cell by cell."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")  # sets that link are at most one band apart
    cut = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("band", band)
    one = cut.select("*", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("to"))
    one = one.select("key", F.col("block").alias("x"), F.col("to").alias("y"), "band", "node", "n", "place", "label")
    two = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("from")).select("*", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2)).alias("near"))
    two = two.select("key", F.col("from").alias("x"), F.col("block").alias("y"), F.col("near").alias("band"), *(F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "label")))
    other = (F.col("label") != F.col("label2")) & ((F.col("x") < F.col("y")) | (F.col("label") < F.col("label2")))
    return one.join(two, ["key", "x", "y", "band"]).where(other & _may_link(F.col("n"), F.col("place"), F.col("n2"), F.col("place2")))


def links(posted: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all sets that link with another. posted: (key, node, n, place), each key and node once."""
    lists = posted.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("place", "n", "node")).alias("p"), F.min("n").alias("least"))
    lists = scratch.table(lists.where("c > 1").drop("c"), "lists")
    met = posted.join(lists, "key")
    star = met.where((F.col("node") != F.col("p.node")) & _may_link(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place")))
    star = scratch.table(star.select(*_pair("node", "p.node")).distinct(), "star")
    first = scratch.table(_verify(star, shingles), "links-1")
    label = components(first, scratch, "cc1")

    # What may still link with a set of another component of its list: by the bounds alone, with the list's shortest set.
    near = F.greatest(F.col("least"), F.ceil(F.col("n") * 3 / 4))
    rest = met.where(7 * (F.col("n") - F.col("place")) >= 3 * (F.col("n") + near)).select("key", "node", "n", "place")
    rest = rest.join(label, "node", "left").select("key", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    rest = scratch.table(rest, "rest")
    split = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = scratch.table(rest.join(split, "key"), "open")
    across = scratch.table(_across(open_).select(*_pair("node", "node2")).distinct().join(star, ["a", "b"], "left_anti"), "across")
    second = scratch.table(_verify(across, shingles), "links-2")
    out = components(first.unionByName(second), scratch, "cc2")
    scratch.drop("lists", "star", "rest", "open", "across", "links-1", "links-2")
    return out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n, node, label, component_id), a row for each row of docs; mark: a hash of the text; label: the class's least node."""
    scratch = Scratch(docs.sparkSession, "ngram")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(token_order(texts))
    marked = texts.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    schema = marked.select("id", "mark", *(F.lit(None).cast(t).alias(c) for c, t in _DOC.items())).schema
    found = scratch.table(marked.mapInArrow(lean(_emitter(handle)), schema), "docs")
    # Written, so that joins on a hot pivot have nothing but exchanges below them, which can be split.
    listed = scratch.table(found.where(F.col("entries").isNotNull()).select("node", "n", "entries", "shingles").dropDuplicates(["node"]), "listed")
    posted = scratch.table(listed.select("node", "n", F.inline("entries")).dropDuplicates(["key", "node"]), "posted")
    label = links(posted, listed.select("node", "shingles"), scratch)
    scratch.drop("listed", "posted")

    nodes = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    nodes = nodes.join(label, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    nodes = scratch.table(nodes, "nodes")
    least = scratch.table(nodes.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    place = scratch.table(nodes.join(least, "label").select("node", "label", "component_id"), "place")
    scratch.drop("nodes", "least")
    return found.select("id", "mark", "n", "node").join(place, "node", "left").select("id", "mark", "n", "node", "label", F.coalesce("component_id", "id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs."""
    return classify(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the input's columns: that of the least id (none last), and of rows with that id the one of the least hash of the text.

    A row goes only if its own text is in a class with an earlier row, so rows that share an id with other texts are judged apart; of equal
    rows one stays. Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    own = F.xxhash64("id").alias("own")  # with the mark, a key of 128 bits that is never null
    each = scratch.table(classify(docs, id_col, text_col).where("n > 0").select("id", own, "mark", "label").distinct(), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "own"))
    stay = each.groupBy("label").agg(first.alias("f")).select("f.own", "f.mark", F.lit(True).alias("stays"))
    judged = each.select("own", "mark").join(stay, ["own", "mark"], "left").select("own", "mark", F.coalesce("stays", F.lit(False)).alias("stays"))
    judged = scratch.table(judged, "judged")
    scratch.drop("classes")

    plain, back = plain_names(docs)
    at = {c: plain.columns[docs.columns.index(c)] for c in (id_col, text_col)}
    rows = plain.withColumns({"own": F.xxhash64(at[id_col]), "mark": F.xxhash64(F.coalesce(at[text_col], F.lit("")))})
    rows = rows.join(judged, ["own", "mark"], "left").where(F.coalesce("stays", F.lit(True)))
    # Equal rows are in one task after the join, and the first stays. Rows without words, which all stay, get keys of their own.
    rows = rows.withColumn("apart", F.when(F.col("stays").isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("own", "mark", "apart").orderBy("mark")))
    return rows.where("turn = 1").select(*back)
