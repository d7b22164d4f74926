"""Links between texts that share a bucket: buckets of any size, bounded memory, no pair lost.

``member_links`` takes buckets of texts (key, h, size, sketch), texts by their hash h, and gives links that connect all pairs of a bucket which are
alike. Buckets travel once, as hashes with a parity sketch, and are read as a sorted stream. What sketches leave open is joined over all buckets
by union-find, so that a text travels once, to the one group it is left in (or to the parts of its buckets, where such a chain is too large).
Verification takes groups of about ``MEMBERS`` members and ``WEIGHT`` shingles in all.

A bucket is large if it has over ``BUCKET`` texts or ``WEIGHT`` shingles: a thousand long documents are as much as a million lines. Large ones
are dealt into blocks of that size, and about ``PIVOTS`` random members (fewer, if they are heavy) are sent to every block. A text alike to a pivot is at home there, which connects most of a
family in one pass over it. By the triangle inequality of the Jaccard distance, a text can only be alike to one at home with a pivot if
the pivot is no further than twice the allowed distance; such a visitor is compared with that home, block by block, unless both are connected already.
Texts without a home go through ``ROUNDS`` rounds with other pivots, then as a normal bucket, or block by block if still large.
That last step takes time with the square of their number; sketches decide nearly all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.bands import Reach, alike, likeness, sketches
from terrainframe.llm.common import materialise
from terrainframe.llm.components import Forest, components

BUCKET, PIVOTS, ROUNDS, WEIGHT = 1000, 24, 2, 2_000_000
MAP_BITS, GROUPS_A_PARTITION, MEMBERS = 27, 16, 50_000
#: Bytes of rows that a task gathers before it compares them: each distance within buckets is a step over all of them.
GATHERED = 32_000_000


def stars(forest: Forest, nodes: set[int]) -> list[tuple[int, int]]:
    """The same components as pairs of a root and a node, which union-find over all buckets needs fewer rounds for."""
    return [(root, x) for x in sorted(nodes) if (root := forest.root(x)) != x]


def bucket_links(sets: list[np.ndarray], buckets: Iterator[list[int]], threshold: float, like: Callable = alike) -> list[tuple[int, int]]:
    """What the alike pairs that share a bucket connect, as stars. Pairs already connected aren't compared."""
    forest, out = Forest(len(sets)), []
    for members in buckets:
        trees: dict[int, list[int]] = {}
        for x in members:
            joined = {forest.root(x): trees.pop(forest.root(x), [])}
            for root in list(trees):
                y = next((y for y in trees[root] if like(sets[x], sets[y], threshold)), None)
                if y is not None:
                    joined[root] = trees.pop(root)
                    forest.join(x, y)
                    out.append((x, y))
            trees[forest.root(x)] = [x, *(y for ys in joined.values() for y in ys)]
    return stars(forest, {x for pair in out for x in pair})


def bit_map(slots: DataFrame):
    """One bit a value of the column ``slot``, 0 to ``2 ** MAP_BITS``, as 64-bit words that are broadcast: a fixed 16 MB."""
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("1L").alias("one"), F.col("slot").bitwiseAND(63).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return slots.sparkSession.sparkContext.broadcast(bits)


def maybe_in(values: DataFrame, column: str):
    """A filter that passes every value of ``column`` and few others."""
    shared = bit_map(values.select(F.shiftrightunsigned(F.xxhash64(column), 64 - MAP_BITS).alias("slot")))

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = batch.to_numpy(zero_copy_only=False)
            yield pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: F.arrow_udf(test, "boolean")(F.shiftrightunsigned(F.xxhash64(c), 64 - MAP_BITS))


def texts_of(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(h, line), once a text: those of ``members`` and few others."""
    return lines.where(maybe_in(members, "h")("h")).groupBy("h").agg(F.first("line").alias("line"))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The keys that hold two texts."""
    live = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key")
    return materialise(live, "shared-bands")


def reach_links(key: np.ndarray, h: np.ndarray, reach: Reach) -> tuple[np.ndarray, ...]:
    """(tree, a, b, a_size, b_size): what each bucket's pairs that may be alike connect, as stars. Rows are sorted by key.

    A bucket's texts are compared by rising size, so a text meets no more of them once they are too large for it."""
    order = np.lexsort((reach.sizes, key))
    held, size = key[order], reach.sizes[order]
    most = reach.threshold * size - reach.slack[order] - 3  # slack rises by 3 in steps, else slower than this
    forest, i, nodes = Forest(len(h)), np.arange(len(h)), set()
    for d in count(1):
        i = i[i + d < len(h)]
        i = i[(held[i] == held[i + d]) & (most[i + d] <= size[i])]
        if not len(i):
            break
        x, y = order[i], order[i + d]
        near = reach.near(x, y)
        for x, y in zip(x[near].tolist(), y[near].tolist(), strict=True):
            if forest.join(x, y):
                nodes.update((x, y))
    a, b = (np.array(k, np.int64) for k in zip(*stars(forest, nodes), strict=True)) if nodes else (np.zeros(0, np.int64),) * 2
    return key[a] ^ (h[a] * np.int64(0x9E3779B97F4A7C15 - (1 << 64))), h[a], h[b], reach.sizes[a], reach.sizes[b]


def within_reach(threshold: float):
    """(key, a, b, a_size, b_size) from rows sorted by key and h: links within reach of buckets that aren't large; of large ones each text, as a."""

    def rows(key: np.ndarray, a: np.ndarray, b: np.ndarray | None, a_size: np.ndarray, b_size: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), none if b is None else pa.array(b), pa.array(a_size), none if b is None else pa.array(b_size)], names=["key", "a", "b", "a_size", "b_size"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, large, held, weight = None, None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                weight += batch.nbytes
                if weight < GATHERED:
                    continue
            if held:
                left = pa.concat_tables([*([left] if left is not None else []), pa.Table.from_batches(held)])
                held, weight = [], 0
            if left is None or not len(left):
                continue
            key, h = (left.column(c).to_numpy() for c in ("key", "h"))
            left = left.filter(pa.array(np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))))
            key, h = (left.column(c).to_numpy() for c in ("key", "h"))
            end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if end:
                size = left.column("size").to_numpy()[:end]
                first = np.flatnonzero(np.append(True, key[1:end] != key[: end - 1]))
                runs = np.diff(np.append(first, end))
                many = np.repeat(runs, runs)
                big = (many > BUCKET) | (np.repeat(np.add.reduceat(size, first), runs) > WEIGHT) & (many > 2) | ((key[:end] == large) if large is not None else np.zeros(end, bool))
                if big.any():
                    yield rows(key[:end][big], h[:end][big], None, size[big], None)
                some = left.slice(0, end).filter(pa.array(~big & (many > 1))).combine_chunks()
                if len(some):
                    words = some.column("sketch").combine_chunks()
                    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
                    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
                    reach = Reach(some.column("size").to_numpy(), words.flatten().to_numpy().view(np.uint64), lengths, threshold)
                    tree, x, y, x_size, y_size = reach_links(some.column("key").to_numpy(), some.column("h").to_numpy(), reach)
                    yield rows(tree, x, y, x_size, y_size)
            left, key, h = left.slice(end), key[end:], h[end:]
            if len(key) and (len(key) > BUCKET or key[0] == large):  # a bucket goes on: pass it through, never hold it whole
                large = int(key[0])
                yield rows(key, h, None, left.column("size").to_numpy(), None)
                left = None

    return links


def unlike_buckets(members: DataFrame) -> DataFrame:
    """``members`` (key, h and more) without the buckets that hold the same texts as another."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.min("h").alias("m"))
    return members.join(sizes.groupBy("n", "x", "m").agg(F.min("key").alias("key")).select("key"), "key")


def own_sets(group: pa.Table, cut: Callable) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct h of a group, their sorted sets of shingles, and each row's place among them."""
    distinct, first, at = np.unique(group.column("h").to_numpy(), return_index=True, return_inverse=True)
    hashes, starts = cut(group.column("line").take(pa.array(first)).to_pylist(), wide=True)
    return distinct, [np.unique(x) for x in np.split(hashes, starts[1:])], at


def verified(threshold: float, cut: Callable, like: Callable = alike):
    def links(_: tuple, group: pa.Table) -> pa.Table:
        distinct, sets, at = own_sets(group, cut)
        key = group.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        found = bucket_links(sets, (sorted(set(at[p].tolist())) for p in np.split(order, cuts)), threshold, like)
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": distinct[a], "b": distinct[b]})

    return links


HOME, LINK, VISIT, LOOSE = 0, 1, 2, 3


def dealt(threshold: float, cut: Callable):
    """(key, point, h, kind, size): a block's texts against the pivots of their bucket."""

    def deal(_: tuple, group: pa.Table) -> pa.Table:
        distinct, sets, at = own_sets(group, cut)
        pivot = group.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
        points, own = np.unique(at[pivot]), np.unique(at[~pivot])
        key = group.column("key")[0].as_py()
        if not len(own):
            return pa.table({c: pa.array([], pa.int32() if c == "kind" else pa.int64()) for c in ("key", "point", "h", "kind", "size")})
        like = likeness([sets[i] for i in own], [sets[i] for i in points]) if len(points) else np.zeros((len(own), 0))
        near = like >= threshold - 1e-9
        kinds = np.where(near, LINK, np.where(like >= 2 * threshold - 1 - 1e-9, VISIT, LOOSE))
        housed = np.flatnonzero(near.any(1))
        if len(housed):
            kinds[housed, near[housed].argmax(1)] = HOME
        joined = Forest(len(points))  # a text links its other pivots to its home only where that joins them anew
        for r in housed.tolist():
            home, *others = np.flatnonzero(near[r]).tolist()
            for c in others:
                if not joined.join(home, c):
                    kinds[r, c] = LOOSE
        x, y = np.nonzero(kinds != LOOSE)
        loose = np.flatnonzero(~near.any(1))
        of = own[np.concatenate((x, loose))]
        h, size = distinct[of], np.fromiter((len(sets[i]) for i in of.tolist()), np.int64, len(of))
        point = np.concatenate((distinct[points[y]], np.zeros(len(loose), np.int64)))
        kind = np.concatenate((kinds[x, y], np.full(len(loose), LOOSE))).astype(np.int32)
        return pa.table({"key": np.full(len(h), key), "point": point, "h": h, "kind": kind, "size": size})

    return deal


def crossed(threshold: float, cut: Callable, like: Callable = alike):
    """(a, b): links between the two sides of a group, or within it if it has one (side 2). Sketches first, then exact."""

    def cross(_: tuple, group: pa.Table) -> pa.Table:
        distinct, sets, at = own_sets(group, cut)
        side = group.column("side").to_numpy()
        left, right = np.unique(at[side != 1]), np.unique(at[side != 0])
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        reach = Reach(*sketches(np.concatenate(sets).astype(np.uint32), np.cumsum(counts) - counts), threshold)
        forest, out = Forest(len(sets)), []
        for x in left.tolist():
            for y in right[reach.near(np.full(len(right), x), right)].tolist():
                if forest.root(x) != forest.root(y) and like(sets[x], sets[y], threshold):
                    forest.join(x, y)
                    out.append((x, y))
        a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
        return pa.table({"a": distinct[a], "b": distinct[b]})

    return cross


def blocks_of(n: Column, weight: Column) -> Column:
    """Blocks of about ``BUCKET`` texts or ``WEIGHT`` shingles, whichever are more."""
    return F.greatest(F.ceil(n / BUCKET), F.ceil(weight / WEIGHT)).cast("int")


def sized(members: DataFrame) -> DataFrame:
    """``members`` (key, h, size) with the number n of their bucket's texts, its weight and its blocks."""
    n, weight = F.count("*"), F.sum("size")
    return members.join(members.groupBy("key").agg(n.alias("n"), weight.alias("weight"), blocks_of(n, weight).alias("blocks")), "key")


def is_large(n: Column, weight: Column) -> Column:
    return (n > BUCKET) | (weight > WEIGHT) & (n > 2)


def visit_links(told: DataFrame, linked: DataFrame, texts: DataFrame, threshold: float, cut: Callable, like: Callable = alike) -> DataFrame:
    """Links between visitors and those at home with the pivots they visit, but for visitors that are connected to the pivot already."""
    in_block = lambda column, n: F.pmod(F.xxhash64("h", F.lit(column)), F.col(n)).cast("int")
    named = materialise(components(linked), "pivot-components")
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))  # noqa: B023, E731
    visits = told.where(F.col("kind") == VISIT).join(of("h"), "h", "left").join(of("point"), "point")
    apart = F.coalesce("h_component", "h") != F.col("point_component")
    part = F.xxhash64("key", "point").alias("part")
    visits = materialise(visits.where(apart).select(part, "h", "size"), "visits")
    homes = told.where(F.col("kind") == HOME).select(part, "h", "size").join(visits.select("part").distinct(), "part", "left_semi")
    count_of = lambda df, c: df.groupBy("part").agg(blocks_of(F.count("*"), F.sum("size")).alias(c))
    both = count_of(visits, "vb").join(count_of(homes, "hb"), "part")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(both, "part").select("part", "h", in_block("v", "vb").alias("i"), everywhere("hb").alias("j"), F.lit(0).alias("side"))
    right = homes.join(both, "part").select("part", "h", everywhere("vb").alias("i"), in_block("v", "hb").alias("j"), F.lit(1).alias("side"))
    met = left.unionByName(right).join(texts, "h").groupBy("part", "i", "j").applyInArrow(crossed(threshold, cut, like), "a long, b long")
    return materialise(met, "visit-links")


def large_links(members: DataFrame, lines: DataFrame, threshold: float, cut: Callable, like: Callable = alike) -> tuple[list[DataFrame], DataFrame]:
    """For large buckets (key, h, size): tables of links, and what is left as normal buckets."""
    links, small = [], []
    texts = materialise(texts_of(lines, members), "large-texts")
    in_block = lambda column, n: F.pmod(F.xxhash64("h", F.lit(column)), F.col(n)).cast("int")
    n, weight = F.col("n"), F.col("weight")
    for turn in range(ROUNDS):
        whole = sized(members)
        own = whole.select("key", "h", in_block("block", "blocks").alias("block"), F.lit(False).alias("pivot"))
        share = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(n * WEIGHT / weight)))
        pivots = whole.where(F.pmod(F.xxhash64("key", "h", F.lit(turn)), n) < share)
        pivots = pivots.select("key", "h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("pivot"))
        told = own.unionByName(pivots).join(texts, "h").groupBy("key", "block").applyInArrow(dealt(threshold, cut), "key long, point long, h long, kind int, size long")
        told = materialise(told, "dealt")
        linked = told.where(F.col("kind").isin(HOME, LINK)).select(F.col("point").alias("a"), F.col("h").alias("b"))
        links.append(linked)
        if not told.where(F.col("kind") == VISIT).isEmpty():
            links.append(visit_links(told, linked, texts, threshold, cut, like))
        loose = materialise(told.where(F.col("kind") == LOOSE).select(F.xxhash64("key", F.lit(turn)).alias("key"), "h", "size"), "loose")
        counts = loose.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
        small.append(loose.join(counts.where((n > 1) & ~is_large(n, weight)).select("key"), "key"))
        members = materialise(loose.join(counts.where(is_large(n, weight)).select("key"), "key"), "still-large")
        if members.isEmpty():
            break
    else:
        placed = sized(members).select("key", "h", in_block("v", "blocks").alias("k"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        i, j = F.least("k", "other"), F.greatest("k", "other")
        sided = placed.select("key", "h", i.alias("i"), j.alias("j"), F.when(i == j, 2).when(F.col("k") == i, 0).otherwise(1).alias("side"))
        links.append(materialise(sided.join(texts, "h").groupBy("key", "i", "j").applyInArrow(crossed(threshold, cut, like), "a long, b long"), "block-links"))
    return links, reduce(DataFrame.unionByName, small)


def member_links(members: DataFrame, lines: DataFrame, threshold: float, cut: Callable, like: Callable = alike) -> DataFrame:
    """(a, b): links that connect all alike pairs of the buckets ``members`` (key, h, size, sketch). ``lines`` has (h, line), with repeats."""
    sorted_ = members.select("key", "h", "size", "sketch").repartition("key").sortWithinPartitions("key", "h")
    met = materialise(sorted_.mapInArrow(within_reach(threshold), "key long, a long, b long, a_size long, b_size long"), "reach")
    large, reach = met.where("b IS NULL").select("key", F.col("a").alias("h"), F.col("a_size").alias("size")), met.where("b IS NOT NULL")
    links, small = [], []
    if not large.isEmpty():
        found, rest = large_links(materialise(unlike_buckets(large.distinct()), "large-buckets"), lines, threshold, cut, like)
        links += found
        small.append(rest)
    ends = F.inline(F.array(*[F.struct(F.col(c).alias("h"), F.col(f"{c}_size").alias("size")) for c in "ab"]))
    sizes = reach.select(ends).groupBy("h").agg(F.max("size").alias("size"))
    near = materialise(components(reach).select(F.col("component").alias("key"), F.col("node").alias("h")).join(sizes, "h").select("key", "h", "size"), "reach-components")
    long = materialise(near.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where(is_large(F.col("n"), F.col("weight"))).select("key"), "long-chains")
    buckets = near.join(long, "key", "left_anti")
    if not long.isEmpty():
        chained = reach.join(near.join(long, "key", "left_semi").select(F.col("h").alias("a")), "a", "left_semi")
        buckets = buckets.unionByName(unlike_buckets(materialise(chained.select("key", ends).distinct(), "chain-buckets")))
    buckets = materialise(reduce(DataFrame.unionByName, small, buckets), "buckets")
    held = buckets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    texts = texts_of(lines, buckets).join(buckets, "h").select("h", "line", "key")
    width = max(GROUPS_A_PARTITION * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held[0] // MEMBERS), -(-held[1] // WEIGHT))
    found = texts.groupBy(F.pmod(F.xxhash64("key"), F.lit(width)).alias("g")).applyInArrow(verified(threshold, cut, like), "a long, b long")
    return reduce(DataFrame.unionByName, links, found)
