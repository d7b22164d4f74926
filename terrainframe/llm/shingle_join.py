"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document's tokens are the 64-bit hashes of its distinct 3-word shingles. Of two sets of similarity t each holds at least ceil(t * n) tokens of the other, so under ANY
total order of tokens their first n - ceil(t * n) + 1 tokens have one in common, and with l more of them each, l + 1. A pair is verified only if it passes under four orders:

1. by hash, rising, with l = n / 10 more tokens: a document goes on only if enough of its prefix is held by another set. No pairs are made for it;
2. by document frequency among those (ties by hash): buckets of the prefix's tokens, the rarest first, so hot passages head no bucket;
3. and 4. by hash, rising and falling: of a pair that meets in a bucket, both prefixes must share a token.

Sizes and parity sketches bound what is left, the exact comparison decides, and distributed union-find names components. Equal sets are one class from the start.

Plan: one pass over the texts writes ids, set hashes and order 1's prefixes (a fifth of the tokens, which are shuffled once as hashes and summed); documents that go on
send their text once. Frequencies are counted over their tokens; tokens held once never travel again. Buckets are linked as in ``buckets``: a
large group of near copies is joined through pivots, block by block, never as all its pairs, and no pair is lost. Hot classes are split as skewed joins.

Edge cases: fewer than three words are one shingle; a null text, or one without words, is linked with nothing and is its own component; repeated rows are one class; a null id is
left out of the least and is given when a component has no other. A bit map of a fixed 16 MB keeps most tokens that one set holds from travelling; it never drops another.
Sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.bands import alike, sketches
from terrainframe.llm.buckets import MAP_BITS, bit_map, member_links, shared_keys, texts_of
from terrainframe.llm.common import discard, materialise
from terrainframe.llm.components import components
from terrainframe.llm.simhash import LOWER

WORDS, THRESHOLD = 3, 0.9
_LOW = (1 << MAP_BITS) - 1


def tokens(text: str) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1 if words else 0
    out = hashes[:n].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def shingled(texts: list[str], wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts laid end to end, and where each text's begin."""
    sets = [tokens(t) for t in texts]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat if wide else flat.astype(np.uint32), np.cumsum(counts) - counts


def least_overlap(n, threshold: float):
    """ceil(threshold * n), in whole thousandths."""
    return -((-round(1000 * threshold) * n) // 1000)


def more_tokens(n, threshold: float):
    """How many tokens beyond the first order 1 asks two prefixes to share."""
    return (1000 - round(1000 * threshold)) * n // 1000


def in_all_orders(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """The exact comparison, for sets whose prefixes share a token by rising and by falling hash."""
    p, q = (len(x) - least_overlap(len(x), threshold) + 1 for x in (a, b))
    for x, y in ((a[:p], b[:q]), (a[-p:], b[-q:])):
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
    return alike(a, b, threshold)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def marks(threshold: float):
    """set_hash (null without words), n and order 1's prefix of each text."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, sizes, heads = [], [], []
            for text in batch.to_pylist():
                own = tokens(text or "")
                n = len(own)
                names.append(int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes())))) if n else None)
                sizes.append(n)
                heads.append(own[: n - least_overlap(n, threshold) + 1 + more_tokens(n, threshold)].view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists(heads)], names=["set_hash", "n", "head"])

    return F.arrow_udf(kernel, "set_hash long, n long, head array<long>")


def held_by_others(shared, threshold: float):
    """Whether enough of a prefix may be held by another set."""

    def kernel(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for n, head in batches:
            sizes, flat = n.to_numpy(zero_copy_only=False), head.flatten().to_numpy(zero_copy_only=False)
            hit = (shared.value[(flat & _LOW) >> 6] >> (flat & 63)) & 1
            ends = np.cumsum(head.value_lengths().to_numpy(zero_copy_only=False))
            before = np.append(0, np.cumsum(hit))
            found = before[ends] - before[np.append(0, ends[:-1])] if len(ends) else np.zeros(0)
            yield pa.array(found >= np.maximum(1, more_tokens(least_overlap(sizes, threshold), threshold)))

    return F.arrow_udf(kernel, "boolean")


def known(shared):
    """Of each list the tokens that are in the bit map."""

    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, counts = batch.flatten().to_numpy(zero_copy_only=False), batch.value_lengths().to_numpy(zero_copy_only=False)
            hit = (shared.value[(flat & _LOW) >> 6] >> (flat & 63)) & 1 == 1
            before = np.append(0, np.cumsum(hit))
            yield pa.ListArray.from_arrays(pa.array(before[np.append(0, np.cumsum(counts))].astype(np.int32)), pa.array(flat[hit]))

    return F.arrow_udf(kernel, "array<long>")


def sets_and_sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        flat, starts = shingled(batch.to_pylist(), wide=True)
        _, words, lengths = sketches(flat.astype(np.uint32), starts)
        own = np.append(starts, len(flat)).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(words.view(np.int64)))
        size = pa.array(np.diff(own).astype(np.int64))
        yield pa.StructArray.from_arrays([size, pa.ListArray.from_arrays(pa.array(own), pa.array(flat.view(np.int64))), sketch], names=["size", "tokens", "sketch"])


def slot(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(_LOW)).alias("slot")


def rarest_first(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, h): the prefixes of the sets (h, size, tokens) by document frequency, of tokens that two sets hold."""
    counts = materialise(sets.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "token-frequencies")
    held = sets.select("h", "size", F.explode(known(bit_map(counts.select(slot("key"))))("tokens")).alias("key")).join(counts, "key")
    own = held.groupBy("h", "size").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))
    alone = F.col("size") - F.size("held")  # tokens of no other set come first in this order
    reach = F.col("size") - F.ceil(F.col("size") * round(1000 * threshold) / 1000) + 1 - alone
    head = own.select("h", F.explode(F.slice("held", F.lit(1), F.greatest(reach, F.lit(0)).cast("int"))).alias("t")).select(F.col("t.key").alias("key"), "h")
    return materialise(head, "rare-prefixes")


def linked(sets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between texts (h, line), whose sets are given."""
    heads = rarest_first(sets, threshold)
    members = heads.join(shared_keys(heads), "key").join(sets.select("h", "size", "sketch"), "h")
    return member_links(members, texts, threshold, shingled, in_all_orders)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the id, n_shingles and component_id, the least id that links reach."""
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("line"))
    marked = materialise(given.select("id", F.xxhash64("line").alias("h"), marks(threshold)("line").alias("m")).select("id", "h", "m.*"), "set-marks")
    worded = marked.where("set_hash IS NOT NULL")
    shared = shared_keys(worded.select(F.explode("head").alias("key"), F.col("set_hash").alias("h")))
    going = worded.where(held_by_others(bit_map(shared.select(slot("key"))), threshold)("n", "head"))
    live = materialise(going.groupBy("set_hash").agg(F.min("h").alias("h")), "live-sets")
    lines = given.where("line IS NOT NULL").select(F.xxhash64("line").alias("h"), "line")
    texts = materialise(texts_of(lines, live).join(live.select("h"), "h"), "live-texts")
    sets = materialise(texts.select("h", F.arrow_udf(sets_and_sketches, "size long, tokens array<long>, sketch array<long>")("line").alias("s")).select("h", "s.*"), "live-tokens")
    found = components(linked(sets, texts, threshold)).withColumnRenamed("node", "h")
    least = materialise(worded.groupBy("set_hash").agg(F.min("id").alias("least")), "least-ids")
    of = found.join(live, "h").join(least, "set_hash").select("set_hash", "component", "least")
    named = of.join(of.groupBy("component").agg(F.min("least").alias("first")), "component").select("set_hash", "first")
    owner = materialise(least.join(named, "set_hash", "left").select("set_hash", F.coalesce("first", "least").alias("component_id")), "set-owners")
    for used in (sets, texts, shared):
        discard(used)
    out = worded.join(owner, "set_hash").select("id", "n", "component_id").unionByName(marked.where("set_hash IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
