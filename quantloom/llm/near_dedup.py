"""Near-duplicate documents by SimHash fingerprints, linked exactly with vantage-point trees.

Fingerprints within 3 of 64 bits agree in one of their four quarters, so each quarter's value names a
shard in which all partners of that kind meet.  A shard that is too large for a task is dealt out again
in the same way, by quarters of the other 48 bits.  Inside a shard a vantage-point tree, built by the
task that holds it, parts the fingerprints by their Hamming distance from a vantage point at the
median.  Beyond the median no partner lies further than the triangle bound allows, so a fingerprint
goes to the far branch too only if it is within 3 of the boundary; leaves are compared.  Nothing of the
fingerprints but counts reaches the driver, and there are four copies of each, sixteen in large shards.

Equal fingerprints are one node from the start, a shard gives the links of a spanning forest only,
and components are found over tables, so no step grows with the square of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialise
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of a group that a task takes at once, on average; it holds some shards, or one.
SHARD = 1 << 9
#: Rows of a group that one task compares; what is larger is dealt out again, and then compared block by block.
BLOCK = 1 << 18
#: Parts of a fingerprint, one more than the bits in which partners differ, and the bits of each.
PARTS, PART_BITS, REST_BITS = MAX_BITS + 1, 16, 12


def fingerprint(text: bytes) -> int:
    """SimHash of a text over its shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of documents (columns doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in byte_texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class VantageTree:
    """A vantage-point tree under Hamming distance, as arrays over its nodes; leaves hold no points."""

    def __init__(self, points: np.ndarray, radius: int, leaf: float, seed: int = 0):
        """points: a sample, one for each expected point times a share; leaf: points of a leaf."""
        self.radius = radius
        self.vantage, self.bound, self.inner, self.outer = [], [], [], []
        random = np.random.default_rng(seed)
        todo = [(points, self.node())]
        while todo:
            part, at = todo.pop()
            if len(part) <= max(leaf, 1):
                continue
            for _ in range(3):  # a vantage point that parts nothing is replaced
                v = part[random.integers(len(part))]
                d = np.bitwise_count(part ^ v)
                bound = int(np.median(d))
                if (d > bound).any():
                    break
                bound -= 1
                if bound >= 0 and (d <= bound).any():
                    break
            else:
                continue
            near, far = part[d <= bound], part[d + self.radius > bound]
            if len(near) >= 0.95 * len(part) or len(far) >= 0.95 * len(part):
                continue  # the boundary holds nearly all
            self.vantage[at], self.bound[at] = v, bound
            self.inner[at], self.outer[at] = self.node(), self.node()
            todo += [(near, self.inner[at]), (far, self.outer[at])]
        self.vantage = np.array(self.vantage, dtype=np.uint64)
        self.bound, self.inner, self.outer = (np.array(x, dtype=np.int64) for x in (self.bound, self.inner, self.outer))

    def node(self) -> int:
        for values, x in ((self.vantage, 0), (self.bound, 0), (self.inner, -1), (self.outer, -1)):
            values.append(x)
        return len(self.bound) - 1

    def shards(self, points: np.ndarray, radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of a point, leaf): every leaf that a point lies in or within the radius of (the tree's own, or another)."""
        radius = self.radius if radius is None else radius
        which, at = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        done = [(which[:0], at[:0])]
        while len(which):
            leaf = self.inner[at] < 0
            done.append((which[leaf], at[leaf]))
            which, at = which[~leaf], at[~leaf]
            d = np.bitwise_count(points[which] ^ self.vantage[at])
            near, far = d <= self.bound[at], d + radius > self.bound[at]
            which, at = np.concatenate([which[near], which[far]]), np.concatenate([self.inner[at[near]], self.outer[at[far]]])
        return np.concatenate([w for w, _ in done]), np.concatenate([a for _, a in done])


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the points within max_bits of each other, by search over those not yet reached."""
    left = fps
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = [seed]
        while frontier and len(left):
            x = frontier.pop()
            hit = np.bitwise_count(left ^ x) <= max_bits
            if hit.any():
                found, left = left[hit], left[~hit]
                yield np.full(len(found), x), found
                frontier.extend(found)


def parted(fps: np.ndarray, radius: int, size: int) -> Iterator[np.ndarray]:
    """The fingerprints in parts by a tree: any two within the radius share one."""
    which, leaf = VantageTree(fps, radius, size / 2).shards(fps)
    order = np.argsort(leaf, kind="stable")
    for part in np.split(which[order], np.flatnonzero(np.diff(leaf[order])) + 1):
        yield fps[part]


def links_in_shard(fps: np.ndarray, max_bits: int, size: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between a shard's points; a large shard is parted by a tree first."""
    for part in parted(fps, max_bits, size) if len(fps) > size else [fps]:
        yield from forest(part, max_bits)


def quarter(k: int) -> Column:
    """The k-th 16 bits of a fingerprint."""
    return F.shiftrightunsigned("fp", PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1))


def rest_part(k: Column, j: int) -> Column:
    """The j-th 12 bits of what is left of a fingerprint without its k-th quarter."""
    low = F.expr("fp & (shiftleft(1L, CAST(16 * k AS INT)) - 1)")
    high = F.expr("shiftleft(shiftrightunsigned(fp, CAST(16 * k + 16 AS INT)), CAST(16 * k AS INT))")
    rest = low.bitwiseOR(F.when(k < PARTS - 1, high).otherwise(0))  # Java takes a shift by 64 for none
    return F.shiftrightunsigned(rest, REST_BITS * j).bitwiseAND(F.lit((1 << REST_BITS) - 1))


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within max_bits (3 at most) of each other."""
    if max_bits >= PARTS:
        raise ValueError(f"partners differ in {MAX_BITS} bits at most")
    groups = max(1, min(nodes.count() // shard, 1 << PART_BITS))
    quarters = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), quarter(k).alias("q")) for k in range(PARTS)))).alias("e")
    # small shards go to a task in groups
    rows = materialise(nodes.select("fp", quarters).select("fp", "e.k", "e.q", (F.col("e.q") % groups).alias("g")))

    def over(some: DataFrame, *keys: str) -> DataFrame:
        return some.groupBy(*keys).count().filter(F.col("count") > block)

    zero = F.lit(0).cast("long")
    large = materialise(over(rows, "k", "g").select(F.col("k").alias("lk"), F.col("g").alias("lg")))
    if large.isEmpty():
        placed = rows.select("k", "g", zero.alias("sub"), zero.alias("b1"), zero.alias("b2"), "fp")
    else:
        of_large = (rows["k"] == large["lk"]) & (rows["g"] == large["lg"])
        whole = rows.join(large, of_large, "left_anti").select("k", "g", zero.alias("sub"), "fp")
        again = F.explode(F.array(*(F.lit(1 + (j << REST_BITS)) + rest_part(F.col("k"), j) for j in range(PARTS))))
        # groups of a large one are its quarters' values, behind the numbers of groups
        split = rows.join(large, of_large, "left_semi").select("k", (F.col("q") + groups).alias("g"), again.alias("sub"), "fp")
        dealt = materialise(whole.unionByName(split))
        left = materialise(over(dealt, "k", "g", "sub").select(F.col("k").alias("lk"), F.col("g").alias("lg"), F.col("sub").alias("ls"), F.ceil(F.col("count") / block).alias("n")))
        joined = dealt.join(left, (dealt["k"] == left["lk"]) & (dealt["g"] == left["lg"]) & (dealt["sub"] == left["ls"]), "left").withColumn("n", F.coalesce("n", F.lit(1)))
        # every pair of blocks of what is large still meets once
        joined = joined.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("n"))).withColumn("o", F.explode(F.sequence(zero, F.col("n") - 1)))
        placed = joined.select("k", "g", "sub", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "fp")

    def link(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fps = part["fp"].to_numpy().view(np.uint64)
        value = fps >> np.uint64(PART_BITS * int(key[0])) & np.uint64((1 << PART_BITS) - 1)
        order = np.argsort(value, kind="stable")
        shards = np.split(fps[order], np.flatnonzero(np.diff(value[order])) + 1)
        found = [f for one in shards if len(one) > 1 for f in links_in_shard(one, max_bits)]
        u, v = (np.concatenate([f[i] for f in found]).view(np.int64) if found else np.empty(0, np.int64) for i in (0, 1))
        return pd.DataFrame({"u": u, "v": v})

    return placed.groupBy("k", "g", "sub", "b1", "b2").applyInPandas(link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable) of every document.

    A null text is an empty one: fingerprint zero, linked like any other.  A null id keeps its row
    and links others, but names a component only where no other id does (component_id null then);
    repeated rows stay.  Other columns are ignored; an empty table gives an empty table.
    """
    found = grouped(docs, id_col, text_col, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint of the component), component_id of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialise(fingerprints(rows))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = components(near_links(nodes, max_bits))
    reached = nodes.join(links, nodes["fp"] == links["node"]).select("fp", "root", "first")
    # what joins a hot key (the root of a large component, the fingerprint of many copies) is a table, so that the join can be split
    smallest = materialise(reached.groupBy("root").agg(F.min("first").alias("smallest")))
    linked = materialise(reached.join(smallest, "root").select("fp", "root", "smallest"))
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "first").alias("component_id"))
    return fps.join(materialise(named), "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, with all their columns, that name their component: one row of each component.

    An id goes if none of its rows names a component.  Those ids are far fewer than the ones that
    stay, so texts are seldom shuffled to drop them.  Rows of a repeated id are judged one by one by
    their fingerprints.  Rows without an id always stay.
    """
    found = grouped(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, max_bits)
    ids = materialise(found.groupBy(F.col("doc_id").alias("__gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"), F.count(F.lit(1)).alias("n")))
    gone = materialise(ids.filter("not names").select("__gone"))  # as a table of known size, so that Spark can broadcast a small one
    out = docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    if ids.filter("n > 1").isEmpty():
        return out
    many = materialise(ids.filter("names and n > 1").select("__gone"))
    naming = found.filter("doc_id = component_id").join(many, F.col("doc_id") == F.col("__gone"), "left_semi")
    keepers = materialise(naming.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("fp").alias("__keeper")).drop("root"))

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint((t or "").encode()) for t in texts], dtype=np.uint64).view(np.int64))

    repeated = docs.join(many, docs[id_col] == many["__gone"], "left_semi").withColumn("__fp", fp_of(F.col(text_col)))
    kept = repeated.join(keepers, [repeated[id_col] == keepers["__id"], repeated["__fp"] == keepers["__keeper"]], "left_semi")
    return out.join(many, out[id_col] == many["__gone"], "left_anti").unionByName(kept.dropDuplicates([id_col, "__fp"]).drop("__fp"))
