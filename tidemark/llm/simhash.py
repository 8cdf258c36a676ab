"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit in one of
their two 32-bit segments.  So every distinct fingerprint looks up the Hamming ball of radius
one around each of its segments in a table of segments, and the matches are verified on the
whole fingerprint.  Of a pair whose segments differ in one bit exactly one has a 0 there:
only that one probes, which halves the probes.  Copies share a fingerprint and are one node.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import staged, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK = 0xFFFFFFFF
_BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit set where more than half of the shingles' XXH64 (seed 42) have it; no words: zero."""
    from xxhash import xxh64_intdigest

    w = utf8(text).lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = w[at : at + _BLOCK + width - 1]
        count = min(_BLOCK, n - at)
        hashes = np.array([xxh64_intdigest(b" ".join(part[k : k + width]), 42) for k in range(count)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.int64))


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that differ in at most ``distance`` <= 3 bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one cover distances up to 3")
    low, high = F.col("fp").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("fp", 32)
    halves = F.array(low, high.bitwiseOR(F.lit(1 << 32)))
    entries = nodes.select(F.col("fp").alias("b"), F.explode(halves).alias("segment"))
    ball = F.explode(
        F.flatten(
            F.transform(
                halves,
                lambda s: F.concat(
                    F.array(s),
                    F.transform(
                        F.filter(
                            F.array(*[F.lit(1 << k).cast("bigint") for k in range(32)]),
                            lambda bit: s.bitwiseAND(bit) == 0,
                        ),
                        lambda bit: s.bitwiseOR(bit),
                    ),
                ),
            )
        )
    )
    probes = nodes.select(F.col("fp").alias("a"), ball.alias("segment"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = probes.join(entries, "segment").where((F.col("a") != F.col("b")) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): every node of ``pairs`` with the smallest node of its component.

    Large-star and small-star steps, each a grouped minimum and a join, so no task holds the
    links of a node; each round is written to the shared folder.  The driver sees two numbers
    a round.
    """
    edges = staged(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = staged(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(documents: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as bigint), component_id: smallest doc_id linked directly or over others.

    Null and empty texts have fingerprint zero and are linked like any other.  Ids that are
    null take no part in the minimum; a component of null ids only has a null component_id.
    Repeated rows stay.  An empty table gives an empty result.
    """
    docs = staged(documents.select("doc_id", fingerprints("text").alias("fp")))
    nodes = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


# Wide fingerprints of near_copies: LANES words of 64 bits, cut into SEGMENTS parts of 24 bits.
LANES, SEGMENTS = 6, 16
# Of their first 64 bits near copies at similarity 0.8 differ in 9.7, with a standard deviation of 2.9.
HEAD_BITS = 20
# Nodes that probe a bucket of more entries are compared by their rarest shingles instead.
CROWD = 16
_SLACK = 1e-6  # of bounds computed in floating point
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(64)], dtype=np.uint64)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct 64-bit hashes of ``words``' shingles, sorted; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n, size = max(1, len(words) - width + 1), min(width, len(words))
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += _scrambled(each[k : k + n] * _MIX[k])
    return np.unique(_scrambled(total))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SEGMENTS numbers of 24 bits: a bit is set if more than half of the shingles' mixed hashes have it."""
    ones = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(shingles), _BLOCK // 16):
        part = shingles[at : at + _BLOCK // 16]
        mixed = np.stack([_scrambled(part ^ _MIX[16 + k]) for k in range(LANES)], axis=1)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        # sums of up to 255 rows fit into a byte
        bits = np.concatenate([bits, np.zeros((-len(bits) % 255, bits.shape[1]), dtype=np.uint8)])
        ones += bits.reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(shingles), bitorder="little").reshape(SEGMENTS, 3).astype(np.int64)
    return packed @ np.array([1, 1 << 8, 1 << 16])


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, held) have a Jaccard similarity of ``similarity`` or more."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("held").alias("h_a")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("held").alias("h_b")), "b")
    shared, total = F.size(F.array_intersect("h_a", "h_b")), F.size("h_a") + F.size("h_b")
    linked = both.select("a", "b", shared.alias("shared"), total.alias("total"))
    return linked.where(F.col("shared") >= F.lit(similarity) * (F.col("total") - F.col("shared"))).select("a", "b")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """token, id, n and at: the rarest shingles of each of ``sets`` (id, held), one of which every similar set has among its own.

    Sets list their shingles in one order: by the number of sets that hold them, then by value; ``at``
    is a shingle's place there.  If the first shingle that two sets share is at places i and j, they share
    min(n - i, m - j) at most, so those too far down are left out, and those that no other set holds.
    A row's n - at must also be enough for the smallest set that has the shingle in this part.
    """
    long = sets.select("id", F.size("held").alias("n"), F.explode("held").alias("token"))
    counts = long.groupBy("token").agg(F.count("*").alias("held_by"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("held_by", "token")) - 1
    ranked = long.join(counts, "token").withColumn("at", place).where("held_by > 1")
    some = staged(ranked.where(F.col("n") - F.col("at") >= F.lit(similarity) * F.col("n") - _SLACK).select("token", "id", "n", "at"))
    smallest = some.groupBy("token").agg(F.min("n").alias("m"))
    enough = F.col("n") - F.col("at") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - _SLACK
    return some.join(smallest, "token").where(enough).drop("m")


def crowd_links(sets: DataFrame, similarity: float, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of ``sets`` (id, held) that are similar, but for those together already; and (node, root).

    ``links`` are the pairs known before.  First every set is compared with the one of each of its
    ``prefixes`` that has the fewest rarer shingles, the least edited of a group of near copies; then those
    that share a shingle and still have different roots.
    """
    tokens = staged(prefixes(sets, similarity))

    def mixed(roots: DataFrame) -> DataFrame:
        rows = tokens.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        lead = rows.groupBy("token").agg(
            F.min(F.struct("at", "id", "root")).alias("lead"), (F.min("root") != F.max("root")).alias("apart")
        )
        return rows.join(lead.where("apart"), "token")

    stars = mixed(components(links)).where("root <> lead.root").select(F.col("id").alias("a"), F.col("lead.id").alias("b"))
    hubs = staged(compared(staged(stars.distinct()), sets, similarity))
    roots = staged(components(links.union(hubs)))
    rows = staged(mixed(roots).select("token", "id", "n", "at", "root"))
    one, two = (rows.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "at", "root")]) for k in "ab")
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - _SLACK
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed
    met = one.join(two, "token").where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & enough)
    met = staged(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    return hubs.union(compared(met, sets, similarity)), roots


def near_copies(
    documents: DataFrame, similarity: float = 0.8, width: int = 5, distance: int = 84, crowd: int = CROWD
) -> DataFrame:
    """doc_id, digest (MD5 of the text) and root of every row with an id; rows of one root are near copies.

    Two texts are linked if the sets of their shingles of ``width`` words (A-Z lower-cased, ASCII
    white space) have a Jaccard similarity of ``similarity`` or more; roots follow chains of links.
    Texts of equal words are one node.  Pairs come from the Hamming balls of radius one around
    the segments of 384-bit fingerprints, are verified on its first 64 bits, on the whole fingerprint (at most
    ``distance`` bits: four standard deviations above the mean at similarity 0.8) and then on
    the shingle sets of their whole texts; of texts that are already together no more pairs are made.
    Nodes whose balls touch a bucket of more than ``crowd`` entries get all their links among each other
    from ``crowd_links``, and no pairs.  Null, empty and blank texts are one node.
    """

    @F.pandas_udf("words binary, n bigint, segments array<int>")
    def described(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = utf8(text).lower().split()
            sets = shingle_set(words, width)
            out.append((hashlib.md5(b" ".join(words)).digest(), len(sets), wide_fingerprint(sets).tolist()))
        return pd.DataFrame(out, columns=["words", "n", "segments"])

    @F.pandas_udf("array<bigint>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(utf8(t).lower().split(), width).view(np.int64) for t in texts], dtype=object)

    texts = documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.md5("text"))
    rows = staged(texts.select("doc_id", "digest", described("text").alias("d")).select("doc_id", "digest", "d.*"))
    nodes = rows.groupBy("words").agg(
        F.min(F.struct("doc_id", "digest")).alias("lead"), F.first("n").alias("n"), F.first("segments").alias("segments")
    )
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()))

    def shingled(ids: DataFrame) -> DataFrame:
        """id and held, the shingles of the nodes ``ids``."""
        asked = ids.join(nodes, "id").select("id", "lead.*")
        sets = texts.join(asked, ["doc_id", "digest"]).dropDuplicates(["id"])
        return staged(sets.select("id", shingles("text").alias("held")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose whole texts are similar enough."""
        print_a = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("segments").alias("s_a"))
        print_b = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("segments").alias("s_b"))
        differ = reduce(add, [F.bit_count(F.col("s_a")[k].bitwiseXOR(F.col("s_b")[k])) for k in range(SEGMENTS)])
        # the larger set is no more than 1 / similarity times the smaller one
        sizes = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
        near = pairs.join(print_a, "a").join(print_b, "b").where(sizes & (differ <= distance))
        near = staged(near.select("a", "b"))
        asked = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        return compared(near, shingled(asked), similarity)

    # First each node with the smallest one of each of its buckets: large groups grow together by
    # a few links a node.  Then the crowds, and then the balls, where only nodes that are not together yet make a pair.
    part = F.col("k") * (1 << 24)
    keyed = nodes.where("n > 0").select("id", F.posexplode("segments").alias("k", "bits"))
    keyed = keyed.withColumn("key", part + F.col("bits"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("entries"))
    stars = keyed.join(buckets, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    first = staged(verified(stars))

    flips = F.filter(F.array(F.lit(0), *[F.lit(1 << k) for k in range(24)]), lambda bit: F.col("bits").bitwiseAND(bit) == 0)
    ball = F.explode(F.transform(flips, lambda bit: part + F.col("bits") + bit))
    crowded = staged(buckets.where(F.col("entries") > crowd).select("key"))
    dense = staged(keyed.select("id", ball.alias("key")).join(crowded, "key").select("id").distinct())
    if dense.isEmpty():
        links, roots = first, components(first)
    else:
        found, roots = crowd_links(shingled(dense), similarity, first)
        links = staged(first.union(found))

    s = F.col("segments")
    head = F.shiftleft(s[0].cast("bigint"), 40).bitwiseOR(F.shiftleft(s[1].cast("bigint"), 16)).bitwiseOR(s[2].cast("bigint").bitwiseAND(0xFFFF))
    placed = nodes.where("n > 0").join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.join(dense.withColumn("dense", F.lit(True)), "id", "left")
    placed = staged(placed.select("id", F.coalesce("root", "id").alias("root"), head.alias("head"), F.coalesce("dense", F.lit(False)).alias("dense"), "segments"))
    long = placed.select("id", "root", "head", "dense", F.posexplode("segments").alias("k", "bits"))
    entries = long.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "root", "head", "dense")], (part + F.col("bits")).alias("key"))
    probes = long.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "root", "head", "dense")], ball.alias("key")).alias("p")
    apart = (F.col("root_a") != F.col("root_b")) & (F.bit_count(F.col("head_a").bitwiseXOR(F.col("head_b"))) <= HEAD_BITS)
    apart &= ~(F.col("dense_a") & F.col("dense_b"))
    met = probes.join(entries.alias("e"), (F.col("p.key") == F.col("e.key")) & apart)
    met = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    roots = components(links.union(verified(met)))
    named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("words", F.coalesce("root", "id").alias("root"))
    return rows.join(named, "words").select("doc_id", "digest", "root")


def deduplicated(documents: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each group of ``near_copies``: the one with the smallest id, then the smallest digest of its text.

    Rows that share an id are told apart by their texts; a repeated row stays once.  Rows without
    id can't be told apart and all stay.  Very long texts are compared whole.  An empty table gives
    an empty result; all given columns stay, whatever their names.
    """
    found = near_copies(documents, similarity, width)
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("lead")).select("lead.*")
    whole = documents.select(F.struct("*").alias("row"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    lead = whole.where("doc_id is not null").join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return lead.select("row.*").unionByName(documents.where("doc_id is null"))
