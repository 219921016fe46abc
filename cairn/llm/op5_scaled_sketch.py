"""Threshold-scaled sketches of documents, in DataFrame functions alone.

A sketch holds every hash of a text's word shingles that is below a fixed share of the hash range (one in `SCALE`), so it
grows with the text, and two sketches of very unequal texts still show which share of the smaller one the larger contains.
Where no hash is below, the smallest is held. Sketches merge: the union, and while a hash below the threshold is in it none
above. Windows over the whole table's order run in parts: ranges of doc_id, each also given the first rows of the next one.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import documents, texts

SHINGLE, SCALE = 5, 8
#: The largest hash that is held, as signed 64-bit hashes go.
BELOW = -(1 << 63) + (1 << 64) // SCALE
WHITE = r"[ \t\n\x0B\f\r]+"
#: Parts that a whole-table order is cut into at most; their bounds are all that the driver sees.
PARTS = 1 << 16
#: Bounds by text, of all doc_ids that are cut so; first bytes of a text that these look at; what comes before all numbers.
WITHIN, PREFIX, LOWEST = 1 << 20, 7, -(1 << 63)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the sketch of the column `text`: an ordered array of longs, empty where there is no word. Texts of fewer
    words than a shingle has are one shingle."""
    w, n = f"__{name}_words", f"__{name}_n"
    # a word is hashed once; a shingle's hash is that of its words' hashes
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x))).withColumn(n, F.size(w))
    last = F.greatest(F.col(n) - SHINGLE, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(SHINGLE)]))
    # in one pass: F.get gives null past the end, which the hash skips, so a short text is one shingle of what it has
    df = df.withColumn(f"{w}_all", F.when(F.col(n) > 0, every).otherwise(F.array().cast("array<long>")))
    low = F.filter(F.col(f"{w}_all"), lambda h: h < BELOW)
    df = df.withColumn(f"{w}_low", low).withColumn(name, F.when((F.size(f"{w}_low") > 0) | (F.col(n) == 0), F.sort_array(F.array_distinct(f"{w}_low"))).otherwise(F.array(F.array_min(f"{w}_all"))))
    return df.drop(w, n, f"{w}_all", f"{w}_low")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, from theirs (shingles across the border apart)."""
    both = F.sort_array(F.array_union(a, b))
    return F.when(F.exists(both, lambda h: h < BELOW), F.filter(both, lambda h: h < BELOW)).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of shingles that two texts have in common, of those that either has; 1 where both have no word."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common  # a sketch has no hash twice
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too; 1 where a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def printed(sketch: Column) -> Column:
    """Sixteen hex digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def bounds_of(keyed: DataFrame, n: int) -> list[tuple[int, int]]:
    """Bounds (doc_id, place of the text) that cut the order into about n parts of like sizes, the smallest first. A doc_id that
    quantiles name several times has several parts' worth of rows, and is cut by its texts, as quantiles of their first bytes say."""
    at = [i / n for i in range(1, n)]
    found = Counter(keyed.agg(F.percentile_approx("__k", at, 20 * n)).first()[0] or [])
    heavy = {k: times for k, times in found.items() if times > 1}
    bounds = {(k, LOWEST) for k in found}
    if heavy:
        pieces = max(2, min(max(heavy.values()), WITHIN // len(heavy)))
        wanted = F.array_contains(literal(sorted(heavy)), F.col("__k"))
        cut = keyed.filter(wanted).groupBy("__k").agg(F.percentile_approx("__t", [i / pieces for i in range(1, pieces)], 20 * pieces))
        bounds |= {(k, t) for k, ts in cut.collect() for t in ts}
    return sorted(bounds)


def literal(values: list, kind: str = "array<long>") -> Column:
    """One constant, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with next_<column>: that of the row after it by descending doc_id (equal ones by text; null last; after the last
    the first). The table's order is cut into parts of like sizes; each part is also given the first rows of the part below
    it, which follow its own last row. Rows of one doc_id are parted by their texts' first bytes, so that those alone whose
    texts begin alike must be in one part."""
    spark = df.sparkSession
    first_bytes = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), F.lit(1), F.lit(PREFIX))), 2 * PREFIX, "0"), 16, 10).cast("long")
    keyed = df.withColumn("__k", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("__t", -first_bytes)  # the order is that of (__k, __t), the largest first
    bounds = [{"k": k, "t": t} for k, t in bounds_of(keyed, min(PARTS, max(16, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))]
    # the number of bounds up to a key, in two steps: blocks of bounds by their first ones, then within the last such block
    step, kind = max(1, round(len(bounds) ** 0.5)), "struct<k: long, t: long>"
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda b: (b["k"] < F.col("__k")) | ((b["k"] == F.col("__k")) & (b["t"] <= F.col("__t")))))
    keyed = keyed.withColumn("__block", upto(literal([b[0] for b in blocks], f"array<{kind}>")))
    within = upto(F.get(literal(blocks, f"array<array<{kind}>>"), F.col("__block") - 1))
    keyed = keyed.withColumn("__part", F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * step + within)).drop("__block")
    heads = {part: {"k": m.k, "t": m.t} for part, m in keyed.groupBy("__part").agg(F.max(F.struct(F.col("__k").alias("k"), F.col("__t").alias("t")))).collect()}
    order = sorted(heads)
    if not order:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}  # the lowest part's last row is followed by the top part's first
    head, to = (F.get(literal([of.get(p) for p in range(order[-1] + 1)], kind), F.col("__part")) for of, kind in ((heads, f"array<{kind}>"), (above, "array<long>")))
    is_head = (F.col("__k") == head["k"]) & (F.col("__t") == head["t"])
    places = F.array(F.struct(F.lit(0).alias("copy"), F.col("__part").alias("part")))
    dealt = keyed.withColumn("__at", F.explode(F.when(is_head, F.concat(places, F.array(F.struct(F.lit(1).alias("copy"), to.cast("int").alias("part"))))).otherwise(places)))
    dealt = dealt.select(*df.columns, "__k", F.col("__at.copy").alias("__copy"), F.col("__at.part").alias("__to"))
    # copies come after the part's own rows; where the part is its own neighbour, its first row's copy closes the circle
    following = F.lead(F.struct(*columns)).over(Window.partitionBy("__to").orderBy("__copy", F.desc("__k"), "text"))
    dealt = dealt.withColumn("__next", following).filter(F.col("__copy") == 0)
    return dealt.select(*df.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited for each row.

    Null texts are empty; rows with equal doc_ids are ordered by text, null doc_ids come last; repeated rows have a row each;
    one row alone is its own next; an empty table gives none; other columns are ignored."""
    df = with_next(with_sketch(texts(docs), "text", "sketch"), ["text", "sketch"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    df = with_sketch(df.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sketch", "next_sketch"), "edited", "edited_sketch")
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), containment(F.col("edited_sketch"), F.col("sketch")).alias("contained_edited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: sketches of every document and of its edited text, and how alike they are."""
    return edited(documents(spark, sf_dir))


QUERIES = {"op5_scaled_sketch": query}
