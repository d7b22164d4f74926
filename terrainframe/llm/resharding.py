"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

Old shard i is new shard i where both exist, so bytes that stay cost nothing and every other byte one. Successive shortest
paths over the (old shard, new shard) graph give the bytes of each transfer; a transfer is a block, an interval of its old
shard's byte range in the order of hash buckets. All rows go where their block goes. A block's end may fall into a row: around
each end, the rows of some ``ZONE`` mean row sizes to both sides are dealt anew to the blocks there, longest first to the shard that still
lacks most, so that shards differ by little more than a short row, or by one row that exceeds a capacity. This rounding is the only
departure from the flow; ``Plan.moved`` and ``Plan.least`` hold the bytes moved and the flow's least.

Groups of equal texts stay in order of the keys, not together: bytes that stay cost nothing, so gathering copies from several old shards
would move more than the least (README has figures), and one group may exceed a shard.

Plan: the driver sees sums and counts by (old shard, bucket), one for some ``BUCKET_ROWS`` rows and ``LEAST_BUCKETS`` at least a shard, and the rows of
zones, a bounded number for each block. A window over (old shard, bucket) gives byte offsets on narrow rows, and in the last pass, over
whole rows, gapless slots as well: one exchange of the rows, no window holds a shard. ``rewrite`` writes the shards that lose or gain rows,
and only those. The input is read several times and must give the same rows each time.

Edge cases: a null size is 0; equal rows are told apart by number; a null old shard is shard 0; an empty table moves nothing. Input columns
shard and slot are replaced, other names may be any.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrainframe.llm.common import materialise, shared_dir

BUCKET_ROWS, LEAST_BUCKETS, ZONE = 500_000, 256, 1000


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Units from each supply to each demand at least total cost; sums must agree. Shortest augmenting paths with potentials."""
    m, n = len(supply), len(demand)
    source, sink = m + n, m + n + 1
    price = [0] * (m + n + 2)
    supply, demand = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    while any(supply):
        far, came, seen = [1 << 62] * (m + n + 2), [-1] * (m + n + 2), set()
        far[source], heap = 0, [(0, source)]
        while heap:
            d, u = heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            if u == source:
                out = [(i, 0) for i in range(m) if supply[i]]
            elif u < m:
                out = [(m + j, cost(u, j)) for j in range(n)]
            elif u < m + n:
                out = [(i, -cost(i, u - m)) for i in range(m) if flow.get((i, u - m))] + [(sink, 0)] * (demand[u - m] > 0)
            else:
                out = []
            for v, c in out:
                d_v = d + c + price[u] - price[v]
                if d_v < far[v]:
                    far[v], came[v] = d_v, u
                    heappush(heap, (d_v, v))
        for v in range(m + n + 2):
            if far[v] < 1 << 62:
                price[v] += far[v]
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        path.reverse()
        i, j = path[0][1], path[-1][0] - m
        amount = min([supply[i], demand[j], *[flow[(v, u - m)] for u, v in path[1:-1] if u >= m]])
        for u, v in path[1:-1]:
            if u < m:
                flow[(u, v - m)] = flow.get((u, v - m), 0) + amount
            else:
                flow[(v, u - m)] -= amount
        supply[i] -= amount
        demand[j] -= amount
    return {k: x for k, x in flow.items() if x}


@dataclass
class Plan:
    """Blocks (old, new, from byte, to byte); rows placed one by one (old, begin, size, new); the least bytes that any plan moves, and those moved."""

    blocks: list[tuple[int, int, int, int]]
    placed: list[tuple[int, int, int, int]]
    least: int
    moved: int = 0


def transfers(sizes: dict[int, int], shards: int) -> Plan:
    olds = sorted(sizes)
    flow = min_cost_flow([sizes[i] for i in olds], capacities(sum(sizes.values()), shards), lambda i, j: int(olds[i] != j))
    blocks = []
    for a, old in enumerate(olds):
        at = 0
        for j in sorted((j for i, j in flow if i == a), key=lambda j: (j != old, j)):
            blocks.append((old, j, at, at + flow[(a, j)]))
            at += flow[(a, j)]
    return Plan(blocks, [], sum(x for (i, j), x in flow.items() if olds[i] != j))


def zones(plan: Plan, means: dict[int, float]) -> list[tuple[int, int, int]]:
    """(old, from byte, to byte) around the inner ends of blocks, joined where they overlap."""
    last = {old: end for old, _, _, end in plan.blocks}
    out: list[tuple[int, int, int]] = []
    for old, _, _, end in plan.blocks:
        if end < last[old]:
            reach = int(ZONE * means[old]) + 1
            if out and out[-1][0] == old and end - reach <= out[-1][2]:
                out[-1] = (old, out[-1][1], end + reach)
            else:
                out.append((old, end - reach, end + reach))
    return out


def settle(plan: Plan, rows: list[tuple[int, int, int]], borders: list[tuple[int, int, int]]) -> None:
    """Place the zones' rows (old, begin, size). What a shard has too much or too little of in one zone is made up for in the next."""
    over: dict[int, int] = {}
    done: set[tuple[int, int, int]] = set()
    for old, low, high in borders:
        own = [(begin, size) for o, begin, size in rows if o == old and low <= begin + size and begin < high and (o, begin, size) not in done]
        done.update((old, *r) for r in own)
        if not own:
            continue
        first, last = min(b for b, _ in own), max(b + n for b, n in own)
        lacks = {new: min(end, last) - max(begin, first) for o, new, begin, end in plan.blocks if o == old and begin < last and end > first}
        for new in lacks:
            lacks[new] -= over.pop(new, 0)
        for begin, size in sorted(own, key=lambda r: (-r[1], r[0])):
            new = max(lacks, key=lambda j: (lacks[j], j == old, -j))
            lacks[new] -= size
            plan.placed.append((old, begin, size, new))
        for new, n in lacks.items():
            over[new] = over.get(new, 0) - n


def sized(docs: DataFrame, size_col: str, old_col: str, key_cols: list[str], whole: bool) -> DataFrame:
    size, old = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.coalesce(F.col(f"`{old_col}`").cast("int"), F.lit(0))
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key_cols)])
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("row")] * whole
    return docs.select(size.alias("size"), old.alias("old"), key.alias("key"), *row)


def reshard(docs: DataFrame, size_col: str, old_col: str, key_cols: list[str], shards: int) -> tuple[DataFrame, Plan, set[int]]:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard), the plan, and the shards that lose or gain rows.

    ``key_cols`` order rows within a bucket and should tell them apart.
    """
    spark = docs.sparkSession
    narrow = materialise(sized(docs, size_col, old_col, key_cols, False), "sized-rows")
    olds = {r.old: r for r in narrow.groupBy("old").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    if not olds:
        return docs.drop("shard", "slot").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), Plan([], [], 0), set()
    plan = transfers({o: r["size"] for o, r in olds.items()}, shards)
    counts = spark.createDataFrame([(o, max(LEAST_BUCKETS, -(-r.n // BUCKET_ROWS))) for o, r in olds.items()], "old int, buckets int")
    in_bucket = lambda df: df.join(F.broadcast(counts), "old").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets")).cast("int")).drop("buckets")
    sums = in_bucket(narrow).groupBy("old", "bucket").agg(F.sum("size").alias("size")).orderBy("old", "bucket").collect()
    at: dict[int, int] = {}
    bases = []
    for r in sums:
        bases.append((r.old, r.bucket, at.get(r.old, 0)))
        at[r.old] = at.get(r.old, 0) + r["size"]
    bases = spark.createDataFrame(bases, "old int, bucket int, base long")
    order = Window.partitionBy("old", "bucket").orderBy("key", "size")

    def offset(df: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return in_bucket(df).join(F.broadcast(bases), ["old", "bucket"]).withColumn("begin", F.col("base") + before).drop("base")

    borders = zones(plan, {o: r["size"] / r.n for o, r in olds.items()})
    if borders:
        ends = [(o, x, y, end) for o, x, y in borders for q, _, _, end in plan.blocks if q == o and x < end < y]
        around = spark.createDataFrame(ends, "old int, low long, high long, cut long")
        crosses = (F.col("begin") < F.col("cut")) & (F.col("begin") + F.col("size") > F.col("cut"))
        near = F.col("begin").between(F.col("low"), F.col("high") - 1) | crosses
        found = offset(narrow).where("size > 0").join(F.broadcast(around), "old").where(near).select("old", "begin", "size").distinct().collect()
        settle(plan, [(r.old, r.begin, r["size"]) for r in found], borders)
    blocks: dict[int, list] = {}
    for old, new, _, end in plan.blocks:
        blocks.setdefault(old, []).append((new, end))
    for old in olds:
        blocks.setdefault(old, [(old % shards, 0)])  # a shard of rows of no size
    cuts = spark.createDataFrame(sorted(blocks.items()), "old int, ends array<struct<new:int,end:long>>")
    fixed = spark.createDataFrame(plan.placed, "old int, begin long, size long, fixed int")

    def placed(df: DataFrame) -> DataFrame:
        by_block = F.coalesce(F.filter("ends", lambda e: e.end > F.col("begin"))[0]["new"], F.element_at("ends", -1)["new"])
        held = offset(df).join(F.broadcast(cuts), "old").join(F.broadcast(fixed), ["old", "begin", "size"], "left")
        return held.withColumn("shard", F.coalesce("fixed", by_block)).drop("ends", "fixed", "begin")

    runs = placed(narrow).groupBy("shard", "old", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("shard", "old", "bucket").collect()
    firsts, seen = [], {}
    for r in runs:
        firsts.append((r.shard, r.old, r.bucket, seen.get(r.shard, 0)))
        seen[r.shard] = seen.get(r.shard, 0) + r.n
    plan.moved = sum(r["size"] for r in runs if r.old != r.shard)
    changed = {x for r in runs if r.old != r.shard for x in (r.old, r.shard)}
    bases_of_slots = spark.createDataFrame(firsts, "shard int, old int, bucket int, first long")
    run = Window.partitionBy("old", "bucket", "shard").orderBy("key", "size")
    whole = placed(sized(docs, size_col, old_col, key_cols, True)).withColumn("number", F.row_number().over(run))
    out = whole.join(F.broadcast(bases_of_slots), ["shard", "old", "bucket"]).select("row.*", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))
    return out, plan, changed


def rewritten(docs: DataFrame, size_col: str, old_col: str, key_cols: list[str], shards: int) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, its files rewritten: rows of shards that lose or gain some are written by shard and read back."""
    placed, _, changed = reshard(docs, size_col, old_col, key_cols, shards)
    if not changed:
        return placed
    path = f"{shared_dir(docs.sparkSession)}/resharded-{uuid.uuid4().hex}"
    touched: Column = F.col("shard").isin(sorted(changed))
    placed.where(touched).write.partitionBy("shard").parquet(path)
    own = docs.sparkSession.read.schema(placed.schema).parquet(path).select(placed.columns)
    return own if set(range(shards)) <= changed else own.unionByName(placed.where(~touched))


def rewrite(spark: SparkSession, folders: dict[int, str], shards: int, size_col: str, key_cols: list[str], out: str | None = None) -> dict[int, str]:
    """Reshard Parquet folders {old shard: path}; returns {new shard: path}. A shard that keeps all its rows and gains none keeps its files."""
    out = out or f"{shared_dir(spark)}/resharded-{uuid.uuid4().hex}"
    rows = None
    for shard, path in sorted(folders.items()):
        part = spark.read.parquet(path)
        part = part.select(F.struct(*[F.col(f"`{c}`") for c in part.columns]).alias("row"), F.lit(shard).alias("old"), F.col(f"`{size_col}`").alias("size"), *[F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(key_cols)])
        rows = part if rows is None else rows.unionByName(part)
    placed, _, changed = reshard(rows, "size", "old", [f"key{i}" for i in range(len(key_cols))], shards)
    changed = (changed | (set(range(shards)) - set(folders))) & set(range(shards))
    moved = materialise(placed.where(F.col("shard").isin(sorted(changed))), "moved")
    for shard in sorted(changed):
        moved.where(F.col("shard") == shard).select("row.*").write.parquet(f"{out}/shard-{shard}")
    return {j: f"{out}/shard-{j}" if j in changed else folders[j] for j in range(shards)}
