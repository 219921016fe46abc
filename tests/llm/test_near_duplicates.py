"""op4, op5 and op10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import common, op4_simhash_gph, op5_scaled_sketch, op10_substring_lsm

WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, n=3):
    words = WORDS.findall((text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints):
    """Of different fingerprints: frozensets that links of at most 3 bits connect."""
    prints = sorted(set(prints))
    a = np.array(prints, np.uint64)
    root = list(range(len(a)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(a):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ x) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(find(i), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def expected_op4(values):
    prints = [simhash(t) for _, t in values]
    least = {}
    for g in brute_components(prints):
        ids = [i for (i, _), p in zip(values, prints, strict=True) if p in g and i is not None]
        least.update(dict.fromkeys(g, min(ids) if ids else None))
    return sorted([(i, f"{p:016x}", least[p]) for (i, _), p in zip(values, prints, strict=True)], key=repr)


def test_fingerprint_in_parts(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    monkeypatch.setattr(op4_simhash_gph, "AT_ONCE", 64)
    assert op4_simhash_gph.fingerprint(text) == simhash(text)


def test_op4(spark, sf, rows):
    got = sorted(map(tuple, op4_simhash_gph.query(spark, sf).collect()), key=repr)
    assert got == expected_op4([(i, t) for i, t, _ in rows])


def test_op4_odd_rows(documents, odd):
    got = sorted(map(tuple, op4_simhash_gph.near_duplicates(documents(odd)).collect()), key=repr)
    assert got == expected_op4([(i, t) for i, t, _ in odd])
    assert op4_simhash_gph.near_duplicates(documents([])).collect() == []
    assert [tuple(r) for r in op4_simhash_gph.near_duplicates(documents([(7, None, None)])).collect()] == [(7, "0" * 16, 7)]


def test_repeats_over_several_fingerprints(documents):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(600)]
    near = [" ".join("x" if k % 150 == i else w for k, w in enumerate(words)) for i in range(1, 8)]
    values = [(10 + i, t, "en") for i, t in enumerate([" ".join(words), *near])] + [(3, "alone and short", "en"), (None, " ".join(words), "en"), (4, "alone and short", "fr"), (4, "alone and short", "fr")]
    got = [x.doc_id for x in op4_simhash_gph.repeats(documents(values), 8).collect()]
    assert len(got) == len(set(got)) and set(got) <= {4, *range(11, 18)} and {4} < set(got) and len(got) >= 5
    assert op4_simhash_gph.repeats(documents([]), 2).collect() == []


def test_repeats_are_those_of_exact_similarity(documents, rows):
    def shingles(text):
        words = WORDS.findall((text or "").translate(FOLD))
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = {i for i in root if root[i] != i}
    assert any(sets[i] != sets[root[i]] for i in want)
    assert sorted(x.doc_id for x in op4_simhash_gph.repeats(documents(rows), 8).collect()) == sorted(want)


@pytest.mark.parametrize("paired", [1, 64])
def test_repeats_among_documents_of_one_template(documents, monkeypatch, paired):
    """Documents that share two thirds of their words share bands without repeating one another; pairs among them still do."""
    monkeypatch.setattr(op4_simhash_gph, "PAIRED", paired)
    r = random.Random(4)
    template, values = [f"t{i}" for i in range(200)], []
    for i in range(30):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        near = own[:]
        near[5] = "changed"
        values += [(i, " ".join(template + own), "en"), (100 + i, " ".join(template + near), "en")]
    got = {x.doc_id for x in op4_simhash_gph.repeats(documents(values), 8).collect()}
    assert got == set(range(100, 130)) if paired > 1 else got <= set(range(100, 130)) and len(got) > 25


@pytest.mark.parametrize("block", [3, 2048])
@pytest.mark.parametrize("shape", ["one band", "one print", "two prints", "crowded prints"])
def test_repeats_in_crowded_places(documents, monkeypatch, shape, block):
    """All documents share a place, and none of the two smallest repeats another: pairs among the others are found all the same."""
    m, r = op4_simhash_gph, random.Random(7)
    monkeypatch.setattr(m, "PAIRED", 1)
    monkeypatch.setattr(m, "BLOCK", block)
    bands, prints = {
        "one band": ("array_repeat(5L, 16)", "cast(array() AS array<bigint>)"),
        "one print": ("cast(array() AS array<bigint>)", "array(7L)"),
        "two prints": ("cast(array() AS array<bigint>)", "array(IF(doc_id < 100, 7L, 6L))"),
        "crowded prints": ("cast(array() AS array<bigint>)", "array(shiftleft(1L, int(doc_id % 100 + IF(doc_id < 100, 0, 20))))"),
    }[shape]
    marks = m.marks
    monkeypatch.setattr(m, "marks", lambda *a: marks(*a).withColumns({"bands": F.expr(bands), "fps": F.expr(prints)}))
    template, values = [f"t{i}" for i in range(100)], [(0, "none like this one", "en"), (1, "nor like that one", "en")]
    for i in range(2, 14):
        own = [f"w{r.randrange(10**6)}" for _ in range(100)]
        values += [(i, " ".join(template + own), "en"), (100 + i, " ".join([*template, *own[:-1], "x"]), "en")]
    assert sorted(x.doc_id for x in m.repeats(documents(values), 1, hot=1).collect()) == list(range(102, 114))


def test_sets_that_are_alike_pass_by_their_bits():
    m, r = op4_simhash_gph, np.random.default_rng(1)
    for size in (1, 4, 5, 60, 400, 9000):
        own = np.unique(r.integers(0, 1 << 64, size, np.uint64))
        sets = [np.unique(np.concatenate([own[int(k * size / 20) :], r.integers(0, 1 << 64, int(n * size / 20), np.uint64)])) for k in range(6) for n in range(7)]
        bits = np.frombuffer(b"".join(map(m.set_bits, sets)), np.uint64).reshape(-1, m.LANES)
        got = m.may_be_alike(np.array([len(x) for x in sets]), bits, size, np.frombuffer(m.set_bits(own), np.uint64))
        alike = np.array([5 * len(np.intersect1d(x, own)) >= 4 * len(np.union1d(x, own)) for x in sets])
        assert alike.any() and got[alike].all()
        assert not m.may_be_alike(np.array([400]), np.frombuffer(m.set_bits(r.integers(0, 1 << 64, 400, np.uint64)), np.uint64).reshape(1, -1), 400, np.frombuffer(m.set_bits(r.integers(0, 1 << 64, 400, np.uint64)), np.uint64)).any()


@pytest.mark.parametrize("sieve", [64, 1 << 24])
def test_verifying_pairs_exchanges_no_texts(spark, documents, rows, monkeypatch, sieve):
    """Texts go straight to where their sets are made, whatever the ids' filter lets through."""
    m, seen = op4_simhash_gph, []
    monkeypatch.setattr(m, "SIEVE", sieve)
    batches = m.batches
    monkeypatch.setattr(m, "batches", lambda df, *a: seen.append(df) or batches(df, *a))
    texts = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (3, "other words than those", "en"), *[(i + 10, t, "en") for i, t, _ in rows[:50]]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = m.alike(documents(texts), spark.createDataFrame([(1, 2), (3, 1)], "a long, b long")).collect()
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [tuple(x) for x in got] == [(1, 2)] and {1, 2, 3} <= {x.doc_id for x in seen[0].collect()}
    assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\(doc_id", plan)


@pytest.fixture(scope="module")
def cloud():
    """Fingerprints around three centres, each in reach of many, and others alone."""
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(3)]
    out = {r.getrandbits(64) for _ in range(40)}
    for _ in range(300):
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 5, 64])
@pytest.mark.parametrize("shape", ["own", "halves", "thirds", "quarters"])
def test_links_connect_all_and_only_near_ones(spark, cloud, hot, shape):
    m = op4_simhash_gph
    df = spark.createDataFrame([(s, m.signed(x)) for x in cloud for s in (0, 1)], "seed int, fp long")
    cuts = {"halves": ([32, 32], [1, 1]), "thirds": ([21, 21, 22], [0, 1, 0]), "quarters": ([16] * 4, [0] * 4)}
    if shape == "own":
        groups = m.design(df.filter("seed = 0"), len(cloud), 3)
    else:
        (widths, limits), at, groups = cuts[shape], 0, []
        for w, t in zip(widths, limits, strict=True):
            bits = list(range(at, at + w))
            groups.append((sum(1 << b for b in bits), t, bits))
            at += w
    made = m.links(df, groups, 3, hot)
    assert made.filter("a = b").isEmpty()
    for seed in (0, 1):
        found = {}
        for r in m.components(made.filter(f"seed = {seed}")).collect():
            found.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
        assert {frozenset(g) for g in found.values()} == {g for g in brute_components(cloud) if len(g) > 1}


@pytest.mark.parametrize("hot", [1, 40, 5000])
def test_links_between_roots(spark, cloud, hot):
    """With roots that connect parts of components already, links and roots together connect what links alone do."""
    m, r = op4_simhash_gph, random.Random(hot)
    groups = [((1 << 32) - 1, 1, list(range(32))), (((1 << 32) - 1) << 32, 1, list(range(32, 64)))]
    root = {x: x for x in cloud}
    for g in brute_components(cloud):
        g = sorted(g)
        for x in r.sample(g, len(g) * 3 // 4):
            root[x] = g[0]
    df = spark.createDataFrame([(0, m.signed(x), m.signed(root[x])) for x in cloud], "seed int, fp long, root long")
    made = m.links(df, groups, 3, hot)
    assert hot == 1 or made.filter("a = b").isEmpty()
    known = spark.createDataFrame([(m.signed(x), m.signed(y)) for x, y in root.items() if x != y], "a long, b long")
    found = {}
    for x in m.components(made.select("a", "b").unionByName(known)).collect():
        found.setdefault(x.root, set()).add(x.node & (1 << 64) - 1)
    assert {frozenset(g) for g in found.values()} == {g for g in brute_components(cloud) if len(g) > 1}


def test_thresholds_are_the_cheapest():
    share = [np.array([0.1, 0.2, 0.4, 0.8]), np.array([0.001, 0.01, 0.1, 0.5])]
    cost, chosen = op4_simhash_gph.thresholds([32, 32], share, 1000, 3)
    assert sum(chosen) == 2
    one = lambda s, t: 0 if t < 0 else 1000 * (1 + sum(op4_simhash_gph.comb(32, k) for k in range(t + 1))) + 1000 * 1000 / 2 * s[t]
    assert cost == min(one(share[0], a) + one(share[1], 2 - a) for a in range(-1, 4))


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = bits[:, 3]
    both = (bits.T @ bits).astype(float)
    groups = op4_simhash_gph.group_bits(both, 4000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40, 50} <= set(g) for g in groups)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i % 7, 107) for i in range(7)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in op4_simhash_gph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 108), 100), 200: 200, 201: 200}


def test_steps_to_components_have_short_plans(spark, monkeypatch):
    """The driver holds each step's plan many times over, so no step plans what stands before it again and again."""
    plans = []

    def kept(df, *a):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return common.kept(df, *a)

    monkeypatch.setattr(op4_simhash_gph, "kept", kept)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in op4_simhash_gph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)}
    assert len(plans) > 3 and 1 <= max(plans) <= 3


def test_components_of_a_hub(spark):
    """A node with most of the edges: no key of the star steps meets more than a salt's share of them."""
    edges = [(5000 + i, 7) for i in range(3000)] + [(i, 9000) for i in range(10, 40)] + [(7000, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in op4_simhash_gph.components(df).collect()}
    assert got == {7: 7, 8: 7, **dict.fromkeys(range(5000, 8000), 7), **dict.fromkeys([*range(10, 40), 9000], 10)}
    both = df.unionByName(df.selectExpr("b AS a", "a AS b"))
    with_least = {(r.a, r.b): r.m for r in op4_simhash_gph.with_least(both, 64).collect()}
    assert len(with_least) == 2 * len(edges) and with_least[7, 7999] == 5000 and with_least[9000, 39] == 10


def test_the_plan_is_drawn_from_all_fingerprints(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(op4_simhash_gph.signed(r.getrandbits(64)),) for _ in range(6000)], "fp long")
    seen = []
    keep, op4_simhash_gph.near_share = op4_simhash_gph.near_share, lambda both, total, sample, group, tau: seen.append(sample) or keep(both, total, sample, group, tau)
    try:
        plans = [op4_simhash_gph.design(x, 6000, 3) for x in (df, df.repartition(7))]
    finally:
        op4_simhash_gph.near_share = keep
    assert plans[0] == plans[1] and len(seen[0]) == op4_simhash_gph.SAMPLE
    share = np.array([[x >> b & 1 for b in range(64)] for x in seen[0].tolist()]).mean(axis=0)
    assert (abs(share - 0.5) < 0.06).all()


def test_links_at_the_shipped_limit_of_a_key(spark):
    """More fingerprints than HOT under one key, with links across it."""
    m, r = op4_simhash_gph, random.Random(6)
    low, cloud = r.getrandbits(32), set()
    while len(cloud) < m.HOT + 300:
        cloud.add(low | r.getrandbits(12) << 40 | (1 << 33 if r.random() < 0.5 else 0))
    cloud = sorted(cloud)
    df = spark.createDataFrame([(0, m.signed(x)) for x in cloud], "seed int, fp long")
    groups = [((1 << 32) - 1, 1, list(range(32))), (((1 << 32) - 1) << 32, 1, list(range(32, 64)))]
    found = {}
    for x in m.components(m.links(df, groups)).collect():
        found.setdefault(x.root, set()).add(x.node & (1 << 64) - 1)
    assert {frozenset(g) for g in found.values()} == {g for g in brute_components(cloud) if len(g) > 1}


# op5


def sketch(text):
    hash64 = lambda parts: signed(chain(parts))

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    signed = op4_simhash_gph.signed
    words = [hash64([w.encode()]) for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return []
    hashes = [hash64([struct.pack("<q", h) for h in words[i : i + 5]]) for i in range(max(1, len(words) - 4))]
    return sorted({h for h in hashes if h < op5_scaled_sketch.BELOW}) or [min(hashes)]


def expected_op5(values):
    printed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    order = sorted(((i, t or "") for i, t in values), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), alike(a, b), alike(a, c)))
    return sorted(out)


def of_op5(df):
    return sorted((str(r.doc_id), *r[1:7]) for r in df.collect())


def test_op5(spark, sf, rows):
    assert of_op5(op5_scaled_sketch.query(spark, sf)) == expected_op5([(i, t) for i, t, _ in rows])


def test_op5_odd_rows(documents, odd):
    assert of_op5(op5_scaled_sketch.edited(documents(odd))) == expected_op5([(i, t) for i, t, _ in odd])
    assert of_op5(op5_scaled_sketch.edited(documents(odd[1:2]))) == expected_op5([(0, None)])
    assert op5_scaled_sketch.edited(documents([])).collect() == []


def test_op5_sparse_ids(documents):
    values = [(i, f"text number {i} of some with more words than five", "en") for i in (-(1 << 62), -5, 0, 1, 2, 3, 1 << 40, (1 << 63) - 1)]
    assert of_op5(op5_scaled_sketch.edited(documents(values))) == expected_op5([(i, t) for i, t, _ in values])


def test_op5_many_rows_of_one_id(spark, documents):
    """Null and equal ids with different and equal texts: they are parted by text, and the order holds."""
    r = random.Random(2)
    texts = ["", "\0", "a", "a\0", "ab", "é x", *(" ".join(r.choices("abcdé", k=r.randint(1, 9))) for _ in range(120))]
    values = [(r.choice([None, None, 7, 7, 8, -3]), r.choice(texts), "en") for _ in range(500)] + [(i, "once", "en") for i in range(9, 20)]
    df = documents(values)
    assert of_op5(op5_scaled_sketch.edited(df)) == expected_op5([(i, t) for i, t, _ in values])
    sizes = [x["count"] for x in op5_scaled_sketch.with_next(common.texts(df), ["text"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 400
    keyed = df.selectExpr("coalesce(doc_id, -9223372036854775808) AS __k", "-cast(ascii(text) AS long) AS __t")
    assert len([b for b in op5_scaled_sketch.bounds_of(keyed, 32) if b[1] != op5_scaled_sketch.LOWEST]) > 8


def test_op5_runs_no_python(spark, sf):
    assert not re.search("Python|Pandas|Arrow", op5_scaled_sketch.query(spark, sf)._jdf.queryExecution().toString())


def test_sketches_merge_and_estimate(spark):

    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join(words), " ".join(words[:400]), " ".join(words[2000:]), "a b", ""]
    df = op5_scaled_sketch.with_sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "s")
    s = {x.i: x.s for x in df.collect()}
    pairs = spark.createDataFrame([(s[0], s[1], s[2], s[3], s[4])], "a array<long>, b array<long>, c array<long>, d array<long>, e array<long>")
    c = F.col
    got = pairs.select(op5_scaled_sketch.containment(c("b"), c("a")), op5_scaled_sketch.likeness(c("a"), c("c")), op5_scaled_sketch.merged(c("a"), c("d")), op5_scaled_sketch.merged(c("d"), c("e")), op5_scaled_sketch.merged(c("b"), c("c"))).first()
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 0.12
    below = lambda *xs: sorted({h for x in xs for h in x if h < op5_scaled_sketch.BELOW})
    assert got[2] == below(s[0], s[3]) and got[3] == s[3] and got[4] == below(s[1], s[2])


# op10


def expected_op10(values):
    firsts, out = {}, []
    order = sorted(((1 << 63) - 1 if i is None else i, k, WORDS.findall(t or "")) for k, (i, t) in enumerate(values))
    for i, _, words in order:
        for k in range(len(words) - 12):
            firsts.setdefault(tuple(words[k : k + 13]), i)
    for i, _, words in order:
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if firsts[tuple(words[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out)


def of_op10(df):
    return sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect())


def test_op10(spark, sf, rows):
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in expected_op10([(i, t) for i, t, _ in rows])]
    assert sorted(map(tuple, op10_substring_lsm.query(spark, sf).collect())) == want
    assert sum(w[2] for w in want) > 1000


def test_op10_odd_rows(documents, odd):
    passage = " ".join(f"p{i}" for i in range(30))
    values = [*odd, (20, f"a {passage} b", "en"), (21, f"c {passage}", "en"), (21, f"{passage} d", "en"), (None, passage, "en"), (22, f"{passage[:60]} x {passage}", "en"), (19, " ".join(f"p{i}" for i in range(12)), "en")]
    got = op10_substring_lsm.dedup(documents(values), buckets=4, segment_bytes=2000)
    assert of_op10(op10_substring_lsm.dedup(documents(values), parts=1)) == of_op10(got)
    assert of_op10(got) == expected_op10([(i, t) for i, t, _ in values])
    assert {"lang", "ids", "fp"} <= set(got.columns)
    assert op10_substring_lsm.dedup(documents([])).collect() == []


def test_op10_batches_compaction_and_reopening(spark, documents, rows):
    """Seven batches in an order of no kind, each by an index opened anew; runs are merged level by level."""
    path, got = common.scratch(spark, "lsm"), []
    for k in sorted(range(0, len(rows), 30), key=lambda k: k * 7 % 11):
        index = op10_substring_lsm.Index(spark, path, buckets=8, segment_bytes=40_000, fan=2)
        got += of_op10(index.add(documents(rows[k : k + 30])))
    firsts, words = {}, {i: WORDS.findall(t) for i, t, _ in rows}
    seen = {}
    for k in sorted(range(0, len(rows), 30), key=lambda k: k * 7 % 11):  # a batch is held against itself and earlier ones
        for i, _, _ in rows[k : k + 30]:
            for at in range(len(words[i]) - 12):
                w = tuple(words[i][at : at + 13])
                firsts[w] = min(firsts.get(w, i), i)
        for i, _, _ in rows[k : k + 30]:
            gone = [False] * len(words[i])
            for at in range(len(words[i]) - 12):
                if firsts[tuple(words[i][at : at + 13])] < i:
                    gone[at : at + 13] = [True] * 13
            seen[i] = (i, len(words[i]), sum(gone), " ".join(w for w, g in zip(words[i], gone, strict=True) if not g))
    assert sorted(got) == sorted(seen.values())
    assert len(index.state["batches"]) == 7 and sorted(r["level"] for r in index.state["runs"]) == [0, 1, 2]
    again = of_op10(op10_substring_lsm.Index(spark, path).add(documents([(1000, rows[0][1], "en")])))
    assert again[0][3] == "" and again[0][2] == len(WORDS.findall(rows[0][1]))


def test_op10_reads_only_files_that_match(spark, documents, monkeypatch):
    """The n-th batch reads its own files and, of earlier texts, those that share a passage with it, however many there are."""
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**7)}" for _ in range(200))
    index = op10_substring_lsm.Index(spark, common.scratch(spark, "lsm"), buckets=8, segment_bytes=4000)
    first = [(i, text(), "en") for i in range(60)]
    for k in range(4):
        index.add(documents(first if not k else [(100 * k + i, text(), "en") for i in range(60)], parts=6)).count()
    read, files = [], op10_substring_lsm.Index._files
    monkeypatch.setattr(op10_substring_lsm.Index, "_files", lambda self, parts: read.append(files(self, parts)) or read[-1])
    assert of_op10(index.add(documents([(900, text(), "en")])))[0][2] == 0 and read == []
    assert of_op10(index.add(documents([(901, first[7][1] + " " + text(), "en")])))[0][2] == 200
    assert len(read) == 1 and len(read[0]) == 1 and "segments-000000" in read[0][0]


def test_op10_a_batch_that_died_leaves_no_trace(spark, documents, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    path = common.scratch(spark, "lsm")
    index = op10_substring_lsm.Index(spark, path, buckets=4)
    assert of_op10(index.add(documents([(5, passage, "en")])))[0][2] == 0
    monkeypatch.setattr(op10_substring_lsm.Index, "_resolve", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(documents([(1, passage, "en")]))
    monkeypatch.undo()
    assert [x[2] for x in of_op10(index.add(documents([(4, passage, "en")])))] == [0]
    assert [x[2] for x in of_op10(op10_substring_lsm.Index(spark, path).add(documents([(6, passage, "en")])))] == [30]
    with pytest.raises(RuntimeError):  # the other session has added meanwhile
        index.add(documents([(7, passage, "en")]))


def test_op10_buckets_grow_with_the_index(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(op10_substring_lsm, "BUCKET_BYTES", 200)
    index = op10_substring_lsm.Index(spark, common.scratch(spark, "lsm"), buckets=2, segment_bytes=40_000)
    got = of_op10(index.add(documents(rows[:100]))) + of_op10(index.add(documents(rows[100:])))
    assert sorted(got) == expected_op10([(i, t) for i, t, _ in rows]) and index.state["buckets"] > 64


def test_sliding_min_and_narrow_numbers():
    r = np.random.default_rng(1)
    x = r.integers(0, 100, 50)
    for n in (1, 2, 3, 7, 9, 50):
        assert op10_substring_lsm.sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(50 - n + 1)]
    for values in ([], [5], [-3, 252], [0, 70_000], [-(1 << 62), 1 << 62]):
        v = np.array(values, np.int64)
        assert op10_substring_lsm.widen(op10_substring_lsm.narrow(v), len(v)).tolist() == values


def test_op10_segments_hold_no_words():
    """What a segment takes while it is made, and then holds, beside its texts' bytes: hashes, but no Python object for each word."""
    import tracemalloc

    texts = [" ".join(f"word{i * 7919 % 5003}" for i in range(k, k + 500)) for k in range(0, 100_000, 500)]
    tracemalloc.start()
    try:
        segment = op10_substring_lsm.Segment(list(range(len(texts))), texts)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert int(segment.ends[-1]) == 100_000 and held < 7 * sum(map(len, texts)) and peak < 15 * sum(map(len, texts))
