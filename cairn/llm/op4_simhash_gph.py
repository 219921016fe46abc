"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

Two fingerprints that differ in at most `tau` bits differ, in some one of m groups of bits, in at most that group's threshold,
if the thresholds (-1 or more) add up to tau - m + 1. Bits that agree with one another over all fingerprints share a group, so
groups say as much as they can independently. Dynamic programming gives each group its threshold: it weighs the signatures
that a threshold asks each fingerprint to probe with against the candidate pairs that it is estimated to let through.

A fingerprint's bits of a group, as they are, are its key; it probes with its key and every variant within the threshold.
Probes meet keys in an equi-join that keeps what verification keeps. Where more than `HOT` fingerprints have one key,
pairs would grow with the square of the group, so those meet at points instead: a fingerprint goes to every point within a
small radius of its other bits, and those that share a point are linked to one of them. Radii are such that all links are
found and none is made up, and a point has a bounded number of members. Components are found by star contraction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh128_digest

from cairn.llm.common import batches, documents, kept, only, slices, texts

BITS, TAU, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one key beyond which they meet at points instead of in pairs. Comparing a pair takes some 50 ns, a member
#: goes to some thousand points for 3 us each, so pairs are cheaper for long; what they let through stays small, as no more
#: than 128 different fingerprints can all be within 3 bits of one another.
HOT = 2048
#: Fingerprints that estimates of candidate counts look at, beside the statistics of all.
SAMPLE = 2048
#: Shingles hashed at a time.
AT_ONCE = 1 << 17
#: For repeats(): words of a shingle, the Jaccard similarity (a fraction) from which documents repeat one another, and bands of
#: so many least hashes each. A pair of similarity s shares a band with a chance of 1 - (1 - s^4)^16: 0.9998 at 0.8.
RUN, LEAST_ALIKE, BANDS, ROWS = 5, (4, 5), 16, 4
#: Documents that share a band's key or a fingerprint up to which they meet as pairs of rows; more are dealt into blocks of
#: so many, and every two blocks are compared by bits that stand for their sets, LANES words of 64.
PAIRED, BLOCK, LANES = 64, 2048, 32
#: Bits, a power of two, of the filter that keeps texts which no pair needs from being hashed and exchanged.
SIEVE = 1 << 24
#: What exchanging a signature to probe with costs, against comparing a pair; and fingerprints under one key beyond which their
#: roots are looked at before they are compared.
PROBE_COST, LARGE = 16, 256
#: What sets the mixes for the least hashes apart.
STEPS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the XXH64 of all word shingles of a whole text, with A-Z as a-z; 0 where there is no word."""
    return several(text, 1, shingle, seed)[0]


def several(text: str, count: int, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """`count` fingerprints: the first as fingerprint() says, the others of the same hashes, each mixed anew.

    bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * count
    total, n = np.zeros((count, BITS), np.int64), max(1, len(words) - shingle + 1)
    for first in range(0, n, AT_ONCE):
        part = words[first : first + AT_ONCE + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.frombuffer(b"".join([xxh64_digest(s, seed) for s in shingles]), ">u8")
        for i in range(count):
            total[i] += np.unpackbits(remixed(hashes, i).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(x.tobytes(), "big") for x in np.packbits(2 * total > n, axis=1)]


def remixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th independent hash from each hash, the 0th being itself (the finaliser of SplitMix64 after a step for i)."""
    if not i:
        return hashes
    h = hashes.astype(np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, count: int = 1) -> DataFrame:
    """doc_id, fps (`count` fingerprints of 64 bits, as longs) for each row; a null text has no word."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                got = [[signed(x) for x in several(t, count, shingle)] for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "fps"])

    return batches(texts(docs), rows, "doc_id long, fps array<long>")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits i and j, for all i and j, over all of them (64 x 64; summed on the executors)."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in it:
            values = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.record_batch([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.reshape(-1).astype(np.int64))], names=["at", "n"])

    out = np.zeros(BITS * BITS)
    for at, n in batches(prints.select("fp"), rows, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, total: int, m: int) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size; each takes the free bit that is most correlated with those it has."""
    p = both.diagonal() / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(sorted(free), key=lambda b: related[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: related[b, group].sum()))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def near_share(both: np.ndarray, total: int, sample: np.ndarray, group: list[int], tau: int) -> np.ndarray:
    """The estimated share of pairs that differ in at most t bits of the group, for t = 0 to tau: the larger of what bits
    that are independent, each as frequent as it is, would give, and of what the sample's pairs show."""
    p = both.diagonal()[group] / max(total, 1)
    chance = np.array([1.0])
    for differ in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - differ, differ])
    model = np.cumsum(chance)[: tau + 1]
    if len(sample) < 2:
        return model
    mask = np.uint64(sum(1 << b for b in group))
    distance = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)[np.triu_indices(len(sample), 1)]
    return np.maximum(model, np.cumsum(np.bincount(distance, minlength=tau + 1)[: tau + 1]) / len(distance))


def thresholds(widths: list[int], share: list[np.ndarray], total: int, tau: int, weight: float = 1) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum tau - m + 1: candidate pairs count one each, signatures to probe with `weight`."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, s in zip(widths, share, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, tau + 1):
                more = 0.0 if t < 0 else weight * total * (1 + sum(comb(width, k) for k in range(t + 1))) + total * total / 2 * float(s[t])
                if spent + t not in after or cost + more < after[spent + t][0]:
                    after[spent + t] = (cost + more, [*chosen, t])
        best = after
    return best[tau - len(widths) + 1]


def design(prints: DataFrame, total: int, tau: int, weight: float = 1) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, its bits) of each group in use, the cheapest over several numbers of groups."""
    both = bit_counts(prints)
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)  # those of least hash
    plans = []
    for m in range(2, min(tau + 2, 6)):
        groups = group_bits(both, total, m)
        cost, chosen = thresholds([len(g) for g in groups], [near_share(both, total, sample, g, tau) for g in groups], total, tau, weight)
        plans.append((cost, m, [(sum(1 << b for b in g), t, g) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def flips(bits: list[int], distance: int) -> list[int]:
    return [signed(sum(1 << b for b in chosen)) for chosen in combinations(bits, distance)]


def constant(values: list, kind: str) -> Column:
    """One constant, however long, of a Spark type."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, groups: list[tuple[int, int, list[int]]], tau: int = TAU, hot: int = HOT, every: bool = False) -> DataFrame:
    """(seed, a, b): links between different fingerprints of one seed, enough of them to connect all that differ in at most
    tau bits, and none between others. `prints`: seed, fp, each pair once; with `root` (each seed, fp and root once), links
    between those of one root, which are connected already, may be missing; with `every` too, no other link is."""
    fp, rooted, place = F.col("fp"), "root" in prints.columns, ["seed", "part", "key"]
    own = ["seed", "fp", *(["root"] if rooted else [])]
    signatures = [{"part": i, "k": k, "mask": signed(mask), "flip": x} for i, (mask, t, bits) in enumerate(groups) for k in range(t + 1) for x in flips(bits, k)]

    def keyed(these: list[dict]) -> DataFrame:
        every = F.explode(constant(these, "array<struct<part: int, k: int, mask: bigint, flip: bigint>>")).alias("s")
        return prints.select(*own, every).select(*own, "s.part", fp.bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), "s.k")

    near, exact = keyed(signatures), keyed([x for x in signatures if not x["k"]]).drop("k")
    crowded = kept(exact.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (min(LARGE, hot) if rooted else hot)).select(*place), "crowded")
    any_crowded = not crowded.isEmpty()

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b, same = a.alias("a"), b.alias("b"), F.lit(True)
        for c in on:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        once = F.when(F.col("b.k") == 0, F.col("a.fp") < F.col("b.fp")).otherwise(F.col("a.fp") != F.col("b.fp"))
        apart = F.col("a.root") != F.col("b.root") if rooted else F.lit(True)
        return a.join(b, same & once & apart & (differ(F.col("a.fp"), F.col("b.fp")) <= tau)).select("a.seed", F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    found = met(exact.join(crowded, place, "left_anti") if any_crowded else exact, near, place)
    if not any_crowded:
        return found
    members = kept(near.join(crowded, place, "left_semi"), "members")
    if rooted:
        # of a crowded key, pairs that would be of the root that has most there are passed over; the others meet in pairs while
        # no member has too many of them
        each = members.groupBy(*place, "root").agg(F.count(F.lit(1)).alias("n"))
        most = each.groupBy(*place).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("m")).filter("n > m.n")
        members = kept(members.join(most.select(*place, F.col("m.root").alias("most"), (F.col("n") - F.col("m.n")).alias("rest")), place), "rooted")
        cold, is_most = members if every else members.filter(F.col("rest") <= hot), F.col("root") == F.col("most")
        ways = F.greatest(F.lit(1), F.ceil(F.col("rest") / hot))  # a key of many is met in so many parts
        a = cold.filter("k = 0").withColumn("side", F.when(is_most, 1).otherwise(0)).withColumn("salt", F.pmod(F.xxhash64("fp"), ways))
        b = cold.withColumn("side", F.explode(F.when(is_most, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)))
        found, members = found.unionByName(met(a, b, [*place, "side", "salt"])), members.filter(F.col("rest") > hot)
        if every or members.isEmpty():
            return found
    return found.unionByName(meeting_points(members.select("seed", "fp", "part", "key", "k"), groups, tau))


def meeting_points(members: DataFrame, groups: list[tuple[int, int, list[int]]], tau: int) -> DataFrame:
    """links() for crowded keys. `members`: seed, fp, part, key, k (bits in which its own key differs from the key that it probes).

    A member with k = 0 and one with k are linked if their other bits differ in at most tau - k. The first goes to the points
    within a = 1 of its other bits (0 if tau - k is 0), the second to those within tau - k - a, so they share a point just if
    they are linked; any two members of the first kind at a point differ in at most 2a bits and are linked too."""
    ways = []
    for i, (mask, t, bits) in enumerate(groups):
        rest = [b for b in range(BITS) if b not in bits]
        for k in range(t + 1):
            reach = tau - k
            near = min(1, reach, tau // 2)
            for first, radius in ((True, near), (False, reach - near)):
                ways.append({"part": i, "k": k, "first": first, "rest": signed(((1 << BITS) - 1) ^ mask), "flips": [x for d in range(radius + 1) for x in flips(rest, d)]})
    way = F.explode(constant(ways, "array<struct<part: int, k: int, first: boolean, rest: bigint, flips: array<bigint>>>")).alias("w")
    own = members.select("seed", "fp", "part", "key", "k", way).filter("part = w.part AND k = IF(w.first, 0, w.k)")
    each = own.select("seed", "fp", "part", "key", "w.k", "w.first", "w.rest", F.explode("w.flips").alias("flip"))
    everyone = each.withColumn("point", F.col("fp").bitwiseAND(F.col("rest")).bitwiseXOR(F.col("flip")))
    # the members of a point are bounded by the number of ways to be that near to it, whatever the number of rows
    at = everyone.groupBy("seed", "part", "key", "k", "point").agg(F.min(F.when(F.col("first"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all")).filter(F.col("a").isNotNull() & (F.size("all") > 1))
    return at.select("seed", "a", F.explode("all").alias("b")).filter("a <> b").distinct()


def with_least(edges: DataFrame, salts: int) -> DataFrame:
    """(a, b, m) for each of `edges` (a, b): m is the smallest b of its a. The edges of a node are dealt out by a salt, for
    a node may hold a large share of them all: what one key meets is a `salts`-th of those, or a row for each salt."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return salted.join(parts.select("a", "salt").join(least, "a"), ["a", "salt"]).select("a", "b", "m")


def each_edge(*edges: tuple[Column | str, Column | str]) -> Column:
    """A row (a, b) for each of `edges`; a union would plan all that stands before it once for each."""
    return F.inline(F.array(*(F.struct((F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b")) for a, b in edges)))


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node that can be reached. Alternates large stars
    (each node's larger neighbours go to its smallest one) and small stars (so do the smaller ones) until nothing moves.
    Both are written: the driver holds a step's plan many times over, and that of the two together is several times as long."""
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    salts = max(16, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = None
    while True:
        both = edges.select(each_edge(("a", "b"), ("b", "a")))
        large = with_least(both, salts).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(kept(large, name), salts).select(each_edge((F.greatest("b", "m"), F.least("b", "m")), ("a", "m"))).filter("a <> b").distinct()
        edges = kept(small, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, tau: int = TAU, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of `docs`.

    component_id is the smallest doc_id that links of at most tau differing bits reach, the row's own included. Rows whose
    text is null or has no word have fingerprint zero and are linked as any others; a null doc_id counts as larger than all,
    so component_id is null only where no doc_id is reached; repeated rows each have a row; an empty table gives none."""
    own = kept(fingerprints(docs, shingle).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints")
    prints = kept(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    total = prints.count()
    if total > 1:
        found = components(links(prints.select(F.lit(0).alias("seed"), "fp"), design(prints, total, tau), tau, hot))
        rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        reached = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        prints = rooted.join(reached, "root").select("fp", "component_id")
    else:
        prints = prints.select("fp", F.col("first").alias("component_id"))
    return own.join(prints, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The different 64-bit hashes, in order, of all runs of RUN words (of the words, if they are fewer)."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(b"".join([xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    n, size = max(1, len(words) - RUN + 1), min(RUN, len(words))
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = remixed(total + hashes[i : i + n], i + 1)
    return np.unique(total)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each of BANDS bands: a hash of the least of each of its ROWS mixes of the set's hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for first in range(0, len(hashes), AT_ONCE // len(least)):
        part = hashes[first : first + AT_ONCE // len(least)]
        least = np.minimum(least, remixed(part[None, :] + STEPS[:, None], 1).min(axis=1))
    return [signed(int.from_bytes(xxh64_digest(x.tobytes(), SEED), "big")) for x in least.reshape(BANDS, ROWS)]


def marks(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """doc_id, same (a digest of the row's set of shingles), fps (`count` fingerprints), bands (its band keys) for each row."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                got = batch.column(1).to_pylist()
                sets = [shingle_set(t.encode("utf-8", "replace").lower().split()) for t in got]
                prints = [[signed(x) for x in several(t, count, shingle)] for t in got]
                longs = pa.list_(pa.int64())
                yield pa.record_batch([batch.column(0), pa.array([xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(prints, longs), pa.array(list(map(band_keys, sets)), longs)], names=["doc_id", "same", "fps", "bands"])

    return batches(texts(docs), rows, "doc_id long, same binary, fps array<long>, bands array<long>")


def sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of all rows whose doc_id is one of `wanted` (doc_id), and of some others: the ids' hashes are bits of
    a table of bounded size, which goes to where the texts are, as these are more than can be exchanged."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    words = wanted.select(at("doc_id").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    rows = texts(docs).withColumn("at", at("doc_id")).withColumn("word", F.shiftright("at", 6))
    return rows.join(F.broadcast(words), "word").filter(F.expr("bit_get(bits, int(at & 63)) = 1")).select("doc_id", "text")


def alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b: doc_ids) whose sets of shingles have a Jaccard similarity of LEAST_ALIKE or more, once each."""
    pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                sets = [shingle_set(t.encode("utf-8", "replace").lower().split()).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    sets = kept(batches(sieved(docs, wanted), rows, "doc_id long, hashes array<long>"), "sets")
    own = lambda name: sets.select(F.col("doc_id").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    both, (up, down) = F.size(F.array_intersect("a_hashes", "b_hashes")), LEAST_ALIKE
    enough = both * (up + down) >= (F.size("a_hashes") + F.size("b_hashes")) * up  # both / (a + b - both) >= up / down
    return kept(pairs.join(own("b"), "b").join(own("a"), "a").filter(enough).select("a", "b").distinct(), "alike")


def set_bits(hashes: np.ndarray) -> bytes:
    """LANES words: a bit is set if a hash of the set falls on it."""
    out = np.zeros(64 * LANES, np.uint8)
    out[hashes % np.uint64(64 * LANES)] = 1
    return np.packbits(out).tobytes()


def may_be_alike(sizes: np.ndarray, bits: np.ndarray, size: int, own: np.ndarray) -> np.ndarray:
    """Which of several sets, by their sizes and bits, can be as similar as LEAST_ALIKE to the one of `size` and bits `own`.
    A bit that one has and the other lacks is an element that they do not share, so none that is so similar is left out."""
    up, down = LEAST_ALIKE
    both = np.bitwise_count(bits & own).sum(axis=1, dtype=np.int64)
    shared = np.minimum(sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), size - int(np.bitwise_count(own).sum())) + both
    return shared * (up + down) >= (sizes + size) * up


def in_blocks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of one place and different roots: all that can be alike. `members`: place, first, root, n (how
    many the place has). They are dealt into blocks, and each two blocks of a place are compared in a group of their own,
    so what a task holds is bounded; work grows with the square of a place, at some 50 ns a pair."""
    block = BLOCK

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                sets = [shingle_set(t.encode("utf-8", "replace").lower().split()) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(set_bits, sets), pa.binary())], names=["doc_id", "size", "bits"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("own")  # the block that meets the other, if there are two, comes last
        first, root, size, own = (group[c].to_numpy() for c in ("first", "root", "size", "own"))
        bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint64).reshape(-1, LANES)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = int(np.count_nonzero(own != own[0]))
        for i in range(len(first) - two if two else len(first)):
            at = len(first) - two if two else i + 1
            near = np.flatnonzero(may_be_alike(size[at:], bits[at:], int(size[i]), bits[i]) & (root[at:] != root[i]) & (first[at:] != first[i])) + at
            left.append(np.full(len(near), first[i]))
            right.append(first[near])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    sizes = batches(sieved(docs, members.select(F.col("first").alias("doc_id"))), rows, "doc_id long, size long, bits binary")
    ways = F.ceil(F.col("n") / block)
    dealt = members.join(sizes, F.col("first") == F.col("doc_id")).drop("doc_id").withColumn("ways", ways).withColumn("own", F.pmod(F.xxhash64("first"), F.col("ways")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    met = met.select("place", "first", "root", "size", "bits", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return met.groupBy("place", "low", "high").applyInArrow(compare, "a long, b long")


def unconnected(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of `members` (place, first, root, n) of one place and different roots, but for some that are not alike."""
    few, many = members.filter(F.col("n") <= PAIRED), members.filter(F.col("n") > PAIRED)
    a, b = few.alias("a"), few.alias("b")
    apart = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.first") < F.col("b.first"))).select(F.col("a.first").alias("a"), F.col("b.first").alias("b"))
    return apart if many.isEmpty() else apart.unionByName(in_blocks(docs, many))


def repeats(docs: DataFrame, count: int, tau: int = TAU, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """What found_repeats() finds; all else that it wrote is gone."""
    return only(lambda: found_repeats(docs, count, tau, shingle, hot), "repeats")


def found_repeats(docs: DataFrame, count: int, tau: int, shingle: int, hot: int) -> DataFrame:
    """doc_id of the documents that one with a smaller doc_id nearly repeats, once each.

    Documents are linked if their sets of RUN-word shingles are equal, or have a Jaccard similarity of LEAST_ALIKE or more;
    that is verified for each pair that shares a band of least hashes, or that any of `count` fingerprints links, but for those
    that are connected already or whose sets' bits show that they are not alike. What links reach belongs together. Null
    doc_ids are never among them; rows of one doc_id are one document; an empty table gives none."""
    docs = docs.filter(F.col("doc_id").isNotNull())
    own = kept(marks(docs, shingle, count), "marks")
    firsts = own.groupBy("same").agg(F.min("doc_id").alias("first"))
    copies = own.join(firsts, "same").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).filter("a <> b")
    texts_once = kept(own.join(firsts, "same").filter("doc_id = first").dropDuplicates(["same"]).select("first", "fps", "bands"), "once")

    # bands link each member to one, so what they connect grows with the number of documents only
    banded = texts_once.select("first", F.posexplode("bands").alias("band", "key"))
    centres = banded.groupBy("band", "key").agg(F.min("first").alias("a"), F.max("first").alias("most")).filter("a < most").drop("most")
    banded = kept(banded.join(centres, ["band", "key"]), "banded")  # bands that nothing else shares go no further
    near = alike(docs, banded.select("a", F.col("first").alias("b")))

    # in keys that hold what is not connected by that, all others are held against one another
    connected = kept(components(near), "connected")
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("x"), F.col(y).alias("y")).alias("place")
    rooted = banded.join(connected, F.col("first") == F.col("node"), "left").select("band", "key", "first", F.coalesce("root", "first").alias("root"))
    mixed = rooted.groupBy("band", "key").agg(F.min("first").alias("known"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high AND n > 2").drop("low", "high")
    others = rooted.join(mixed, ["band", "key"]).filter("first <> known").select(place("band", "band", "key"), "first", "root", "n")

    # so are those of one fingerprint; fingerprints need not link what is connected
    prints = texts_once.select("first", F.posexplode("fps").alias("seed", "fp")).join(connected, F.col("first") == F.col("node"), "left").select("seed", "fp", "first", F.coalesce("root", "first").alias("root"))
    prints = kept(prints, "prints")
    classes = kept(prints.select("seed", "fp", "root").distinct(), "classes")
    shared = kept(classes.groupBy("seed", "fp").agg(F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("seed", "fp"), "shared")
    equal = prints.join(shared, ["seed", "fp"])
    equal = equal.join(equal.groupBy("seed", "fp").agg(F.count(F.lit(1)).alias("n")), ["seed", "fp"]).select(place("print", "seed", "fp"), "first", "root", "n")
    apart = unconnected(docs, kept(others.unionByName(equal), "others"))

    one = classes.filter("seed = 0").select("fp").distinct()  # all seeds' bits are alike in kind, so one plan serves
    total = one.count()
    groups = design(one, total, tau, PROBE_COST) if total else [((1 << 32) - 1, 1, list(range(32))), (((1 << 32) - 1) << 32, 1, list(range(32, 64)))]
    member = lambda name: prints.select("seed", F.col("fp").alias(name), F.col("first").alias(f"{name}_first"), F.col("root").alias(f"{name}_root"))
    found = links(classes, groups, tau, hot, every=True).distinct()
    linked = found.join(member("a"), ["seed", "a"]).join(member("b"), ["seed", "b"]).filter("a_root <> b_root").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    more = alike(docs, linked.unionByName(apart))
    return components(near.unionByName(more).unionByName(copies)).filter("node <> root").select(F.col("node").alias("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's fingerprint and component."""
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op4_simhash_gph": query}
