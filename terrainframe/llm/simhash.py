"""SimHash near-duplicates through vantage-point trees.

Fingerprint: bit k is set if over half of the XXH64 values (seed 42) of a text's 3-word shingles, repeats counted, have it.
Equal fingerprints are one point. A tree over a sample of at most ``SAMPLE`` points splits the space by Hamming distance to vantage points, into leaves of about ``LEAF`` points:
each point's home is one leaf. A point whose home is the outer side of a split and that lies within ``radius`` of the border also
visits the inner side, and there follows both sides wherever the triangle bound allows a neighbour; so each pair within the
radius meets in the home leaf of one of them. In a leaf, points are put into rings around two more vantage points, ring
pairs further apart than the radius are pruned by the triangle bound, and the rest is compared exactly. A leaf
returns a spanning forest of its links, not all pairs; distributed union-find joins the forests.

Plan: one Arrow UDF over the texts, written as (id, fingerprint); points are distinct fingerprints with their least id; one
shuffle of 8-byte points by leaf; components over the links; one join back by fingerprint, whose hot keys Spark splits.
Random 64-bit fingerprints lie near distance 32 from anything, so a split prunes little (README): work grows faster
than the input, with a power that falls as leaves get smaller.

Edge cases: a text without words, or null, has fingerprint zero, linked like any other; fewer than three words are one
shingle; repeated rows share all they have; a null id is left out of the minimum, and is given when a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import materialise
from terrainframe.llm.components import Forest, components

SAMPLE, LEAF, RADIUS, SEED, BLOCK = 1 << 18, 4096, 3, 42, 512
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned 64-bit majority of the shingles' hashes; bytes.split() breaks at the same six blanks."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (a long of the same bits)."""

    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(t, size) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.array(values.view(np.int64))

    return docs.drop("fingerprint").withColumn("fingerprint", F.arrow_udf(marks, "long")(F.col(text_col).cast("string")))


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """Vantage points and borders, leaves numbered from 0. ``depth`` splits at most, each at the sample's median distance."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves = 0
        self.root = self.build(np.unique(sample), depth, np.random.default_rng(SEED))

    def build(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        """A node's number, or minus one less a leaf's."""
        best = None
        if depth and len(points) > 1:
            for v in rng.choice(points, min(8, len(points)), replace=False):
                d = distance(points, v)
                border = int(np.median(d))
                inner = d <= border
                if 0 < inner.sum() < len(points):
                    near = ((d > border - RADIUS) & (d <= border + RADIUS)).sum()
                    cost = (near, abs(2 * int(inner.sum()) - len(points)))
                    if best is None or cost < best[0]:
                        best = (cost, v, border, inner)
        if best is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        _, v, border, inner = best
        self.nodes.append((v, border, 0, 0))
        self.nodes[at] = (v, border, self.build(points[inner], depth - 1, rng), self.build(points[~inner], depth - 1, rng))
        return at

    def place(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, positions, at home): homes first split, visitors follow the triangle bound."""
        todo = [(self.root, np.arange(len(points)), np.arange(0))]
        while todo:
            node, home, visit = todo.pop()
            if node < 0:
                yield -node - 1, home, True
                yield -node - 1, visit, False
                continue
            v, border, inner, outer = self.nodes[node]
            d, e = distance(points[home], v), distance(points[visit], v)
            crossing = home[(d > border) & (d <= border + radius)]
            todo.append((inner, home[d <= border], np.concatenate((crossing, visit[e <= border + radius]))))
            todo.append((outer, home[d > border], visit[e > border - radius]))


def rings(points: np.ndarray, vantage: np.uint64) -> list[tuple[int, np.ndarray]]:
    d = distance(points, vantage)
    order = np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[order])) + 1
    return [(int(d[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def links(points: np.ndarray, homes: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of pairs within the radius, of which one at least is among the first ``homes`` points."""
    forest, out = Forest(len(points)), []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), BLOCK):
            x = a[i : i + BLOCK]
            p, q = np.nonzero(distance(points[x][:, None], points[b][None, :]) <= radius)
            for s, t in zip(x[p].tolist(), b[q].tolist(), strict=True):
                if s != t and (s < homes or t < homes) and forest.join(s, t):
                    out.append((s, t))

    if len(points) < 2 or not homes:
        return out
    first, second = points[0], points[len(points) // 2] ^ np.uint64(0x5555555555555555)
    inner = [(d, [(e, ring[part]) for e, part in rings(points[ring], second)]) for d, ring in rings(points, first)]
    for i, (d, mine) in enumerate(inner):
        for d2, others in inner[i:]:
            if d2 - d > radius:
                break
            for k, (e, a) in enumerate(mine):
                for e2, b in others[k:] if d2 == d else others:
                    if abs(e2 - e) <= radius and not (a.min() >= homes and b.min() >= homes):
                        compare(a, b)
    return out


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between fingerprints, enough to connect all that are within the radius. ``points`` has distinct ``fingerprint``."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    share = min(1.0, 64 * 2.0**depth / max(1, n), SAMPLE / max(1, n))
    sample = points.where(F.shiftrightunsigned(F.xxhash64("fingerprint"), 32) <= int(share * 0xFFFFFFFF)).select("fingerprint").toArrow()
    tree = spark.sparkContext.broadcast(Tree(sample.column("fingerprint").to_numpy().view(np.uint64), depth))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for leaf, at, home in tree.value.place(own.view(np.uint64), radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(np.full(len(at), home)), pa.array(own[at])], names=["leaf", "home", "point"])

    def meet(_: tuple, group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy().astype(bool)
        own = group.column("point").to_numpy()
        own = np.concatenate((own[home], own[~home]))
        found = links(own.view(np.uint64), int(home.sum()), radius)
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": own[a], "b": own[b]})

    placed = points.select("fingerprint").mapInArrow(visit, "leaf int, home boolean, point long")
    return placed.groupBy("leaf").applyInArrow(meet, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: the id, fingerprint (a long) and component_id, the least id that links reach."""
    marked = materialise(fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text").drop("_text"), "fingerprints")
    points = materialise(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "points")
    found = components(near_links(points, radius)).withColumnRenamed("node", "fingerprint")
    linked = found.join(points, "fingerprint")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("first")), "component").select("fingerprint", "first")
    owner = points.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("first", "least").alias("component_id"))
    owner = materialise(owner, "owners")  # a table of its own: both sides are then exchanged, and Spark can split a hot fingerprint
    return marked.join(owner, "fingerprint").select(id_col, "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group, columns as they were: the one of least id, rows without an id last. Of equal rows one stays."""
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), mark.alias("mark"))
    told = lambda x: F.concat_ws(":", x["id"].cast("string"), x["mark"].cast("string"))
    found = groups(docs.select(order.alias("_order"), F.col(text_col).alias("_body")), "_order", "_body", radius)
    kept = found.select(told(F.col("component_id")).alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told(order).alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("row.*")
