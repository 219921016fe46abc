"""Packing documents into sequences by column generation for the cutting-stock problem.

A document's ids are cut where a sequence is full; what is left over, less than a sequence, is a piece as well, or is cut
into pieces of at most a half, a quarter or an eighth of a sequence, the longest with which little padding remains. Pieces are counted by
length class (lengths rounded up to a multiple of `STEP`). The linear program over patterns (how many pieces of each class
share a sequence) starts from patterns of one class each; a knapsack over the duals gives the pattern that would lower the
number of sequences most, until none does. Each pattern is used as often as its value rounded down says; the few pieces left
after that are packed first-fit decreasing, class by class. The driver sees the histogram of lengths and the patterns, whose
sizes depend on the sequence length alone. Pieces are ranked within their class, and a piece's rank gives its pattern, copy
and slot by arithmetic; a class with many pieces is ranked in salted parts, so it never meets in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import batches, documents, kept, release, scratch, slices, texts
from cairn.llm.tokens import encoder

SEQUENCE, STEP = 2048, 8
#: The share of sequences that should be ids, for pieces to be left as long as they are.
FULL = 0.99
#: Pieces of a class that are ranked together, about, and such parts that are summed up together: a class is never one group.
RANKED, SUMMED = 250, 1_000
#: How many pieces of at most sequence / 2 ** level a rest may be cut into: levels 0 to 3.
LEVELS = 4
#: Bytes of texts that are encoded together, as what a worker holds for them meanwhile is many times as much, and after how
#: many such lots it gives back what is free: doing so each time, or keeping nothing back at all, costs some 7 % of the time.
ENCODED, LOTS = 2 << 20, 4
DOCS = "doc long, doc_id long, n long, whole array<long>, rests array<array<long>>, ids binary"


def best_pattern(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable choice of classes (class k takes k + 1 units) within `units`."""
    most, chosen = np.zeros(units + 1), np.full(units + 1, -1)
    for room in range(1, units + 1):
        with_class = most[room - 1 :: -1][: len(value)] + value[: min(len(value), room)]
        k = int(with_class.argmax())
        if with_class[k] > most[room - 1] + 1e-12:
            most[room], chosen[room] = with_class[k], k
        else:
            most[room] = most[room - 1]
    pattern, room = np.zeros(len(value), np.int64), units
    while room > 0:
        if (k := chosen[room]) < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= k + 1
    return float(most[units]), pattern


def plan(demand: np.ndarray, units: int, tolerance: float = 5e-4, rounds: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(copies, pieces of each class) of patterns that together hold demand[k] pieces of class k (k + 1 units) each.

    Revised simplex, a column a round. It ends when no pattern improves, when the program is within `tolerance` of the
    best bound that prices have given, or after `rounds`; every basis on the way is a valid, if less tight, plan."""
    rows = np.flatnonzero(demand)
    out: list[tuple[int, np.ndarray]] = []
    left = demand.astype(np.int64).copy()
    if len(rows):
        columns = np.zeros((len(rows), len(rows)))
        np.fill_diagonal(columns, units // (rows + 1))
        inverse, amount = np.diag(1 / columns.diagonal()), demand[rows] / columns.diagonal()
        centre, bound = (rows + 1) / units, 0.0  # duals near the best ones; pricing between them and the basis's own ones takes far fewer rounds
        for _ in range(rounds):
            duals = inverse.sum(axis=0)
            for weight in (0.85, 0.0):
                prices = np.maximum(weight * centre + (1 - weight) * duals, 0)
                value = np.zeros(len(demand))
                value[rows] = prices
                worth, pattern = best_pattern(value, units)
                if (proven := float(demand[rows] @ prices) / max(worth, 1e-9)) > bound:
                    bound, centre = proven, prices
                if pattern[rows] @ duals > 1 + 1e-9:
                    break
            if pattern[rows] @ duals <= 1 + 1e-9 or amount.sum() <= bound * (1 + tolerance):
                break
            entering = pattern[rows].astype(float)
            step = inverse @ entering
            ratio = np.full(len(rows), np.inf)
            np.divide(amount, step, out=ratio, where=step > 1e-9)
            out_row = int(ratio.argmin())
            if not np.isfinite(ratio[out_row]):
                break
            moved = max(ratio[out_row], 0.0)
            amount = np.maximum(amount - moved * step, 0)
            amount[out_row] = moved
            inverse[out_row] /= step[out_row]
            others = step.copy()
            others[out_row] = 0
            inverse -= np.outer(others, inverse[out_row])
            columns[:, out_row] = entering
        for at in np.argsort(-amount, kind="stable"):
            pattern = np.zeros(len(demand), np.int64)
            pattern[rows] = columns[:, at].round().astype(np.int64)
            used = np.flatnonzero(pattern)
            copies = min(int(amount[at] + 1e-6), int((left[used] // pattern[used]).min()))
            if copies > 0:
                out.append((copies, pattern))
                left -= copies * pattern
    while left.any():  # what rounding left: fill a sequence with the largest classes that fit, as often as that can be done
        room, pattern = units, np.zeros(len(demand), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            if fit := min(room // (k + 1), int(left[k])):
                pattern[k] = fit
                room -= fit * (k + 1)
        used = np.flatnonzero(pattern)
        copies = int((left[used] // pattern[used]).min())
        out.append((copies, pattern))
        left -= copies * pattern
    return out


class Slots:
    """Where the piece of a rank in its class goes: patterns take ranks in turn, `pattern[k]` for each copy."""

    def __init__(self, patterns: list[tuple[int, np.ndarray]]):
        first, self.by_class = 0, {}
        for copies, pattern in patterns:
            for k in np.flatnonzero(pattern):
                ends, per, base = self.by_class.setdefault(int(k), ([0], [], []))
                ends.append(ends[-1] + copies * int(pattern[k]))
                per.append(int(pattern[k]))
                base.append(first)
            first += copies
        self.by_class = {k: tuple(map(np.array, x)) for k, x in self.by_class.items()}

    def sequences(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes), np.int64)
        for k in np.unique(classes):
            at = classes == k
            ends, per, base = self.by_class[int(k)]
            p = np.searchsorted(ends, ranks[at], "right") - 1
            out[at] = base[p] + (ranks[at] - ends[p]) // per[p]
        return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, sequence: int) -> None:
    """Encodes `docs`, ends each document with end_id and writes the ids, with the crc32 of each whole sequence of them and,
    for each level, of each piece of the rest."""
    end = struct.pack("<I", end_id)

    def sums(ids: bytes) -> tuple[list[int], list[list[int]]]:
        data, rest = memoryview(ids), len(ids) - len(ids) % (4 * sequence)
        each = lambda a, b, step: [zlib.crc32(data[i : min(b, i + step)]) for i in range(a, b, step)]
        return each(0, rest, 4 * sequence), [each(rest, len(ids), 4 * sequence >> level) for level in range(LEVELS)]

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, lots = TaskContext.get().partitionId() << 33, 0
        for full in it:
            for batch in slices(full, ENCODED):
                ids = [x + end for x in encoder(tokenizer).encode(batch.column(1))]
                crcs = list(map(sums, ids))
                longs = pa.list_(pa.int64())
                yield pa.record_batch([pa.array(range(number, number + len(ids)), pa.int64()), batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([w for w, _ in crcs], longs), pa.array([r for _, r in crcs], pa.list_(longs)), pa.array(ids, pa.binary())], names=["doc", "doc_id", "n", "whole", "rests", "ids"])
                number += len(ids)
                del ids, crcs
                lots += 1
                if lots % LOTS == 0:
                    release()

    batches(texts(docs), encode, DOCS, 1000).write.parquet(path)


def pieces_of(encoded: DataFrame, sequence: int, level: int, step: int) -> DataFrame:
    """A row for each piece, without its ids: doc, doc_id, start, length, doc_tokens, class, ids_crc32."""
    largest = sequence >> level
    every = encoded.select("doc", "doc_id", F.col("n").alias("doc_tokens"), F.size("whole").cast("long").alias("full"), F.posexplode(F.concat("whole", F.col("rests")[level])).alias("i", "ids_crc32"))
    start = F.when(F.col("i") < F.col("full"), F.col("i") * sequence).otherwise(F.col("full") * sequence + (F.col("i") - F.col("full")) * largest)
    length = F.when(F.col("i") < F.col("full"), F.lit(sequence)).otherwise(F.least(F.lit(largest), F.col("doc_tokens") - F.col("start")))
    return every.withColumn("start", start.cast("long")).withColumn("length", length.cast("long")).withColumn("class", (F.ceil(F.col("length") / step) - 1).cast("int")).drop("i", "full")


def cuts(n: int, sequence: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, then `largest` at a time, then the rest."""
    out = [(at, sequence) for at in range(0, n - n % sequence, sequence)]
    out += [(at, min(largest, n - at)) for at in range(n - n % sequence, n, largest)]
    return out


def choose(lengths: list[tuple[int, int, int]], sequence: int, step: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """The level that rests are cut at, and the plan, from (rest, documents with it, their whole sequences)."""
    units, best = sequence // step, (-1.0, 0, [])
    total = sum(r * n + sequence * whole for r, n, whole in lengths)
    for level in range(LEVELS):
        demand = np.zeros(units, np.int64)
        for rest, n, whole in lengths:
            demand[units - 1] += whole
            for _, length in cuts(rest, sequence, sequence >> level):
                demand[-(-length // step) - 1] += n
        made = plan(demand, units)
        share = total / sequence / max(1, sum(copies for copies, _ in made))
        if share > best[0] + 1e-9:
            best = (share, level, made)
        if share >= FULL:
            break
    return best[1], best[2]


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, step: int = STEP, ranked: int = RANKED, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and ids (binary) if wanted.

    A null text is empty and has the end id alone; rows of equal or null doc_id are documents of their own; an empty table
    has no pieces; columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    path = scratch(spark, "ids")
    write_ids(docs, path, tokenizer, end_id, sequence)
    encoded = spark.read.schema(DOCS).parquet(path)
    lengths = encoded.groupBy((F.col("n") % sequence).alias("rest")).agg(F.count(F.lit(1)), F.sum(F.floor(F.col("n") / sequence))).collect()  # at most `sequence` rows
    level, made = choose(sorted(map(tuple, lengths)), sequence, step)
    slots = Slots(made)
    pieces = kept(pieces_of(encoded, sequence, level, step), "pieces")
    counts = dict(pieces.groupBy("class").count().collect())  # at most sequence / step rows
    salts = {k: -(-n // ranked) for k, n in counts.items()}
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(salts.items()) for x in (k, n)]), F.col("class"))) if salts else F.lit(0))
    # how many pieces of its class come in salted parts before a part, in two steps: in blocks of parts before its own, and in its own
    parts = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("salt") / SUMMED))
    earlier = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n")
    blocks = parts.groupBy("class", "block").agg(F.sum("n").alias("n")).select("class", "block", earlier(["class"], "block").alias("in_blocks"))
    before = parts.withColumn("in_parts", earlier(["class", "block"], "salt")).join(blocks, ["class", "block"]).select("class", "salt", (F.col("in_blocks") + F.col("in_parts")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc", "start")) - 1
    placed = salted.withColumn("rank", rank).join(before, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    names = ["doc", "doc_id", "start", "length", "doc_tokens", "ids_crc32"]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = slots.sequences(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.record_batch([*batch.columns[2:], pa.array(ids, pa.int64())], names=[*names, "sequence_id"])

    sequenced = batches(placed.select("class", "rank", *names), place, "doc long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long")
    so_far = Window.partitionBy("sequence_id").orderBy("doc", "start").rowsBetween(Window.unboundedPreceding, -1)
    sequenced = sequenced.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)))
    if with_ids:
        own = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
        sequenced = sequenced.join(encoded.select("doc", "ids"), "doc").withColumn("ids", own)
    return sequenced.drop("doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document in pieces, and where each piece lies."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False)


QUERIES = {"op9_cutting_stock": query}
