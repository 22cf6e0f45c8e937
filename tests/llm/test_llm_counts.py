"""Problems 1 to 4 against brute force, with skew, nulls, ties, repeated rows and clashing columns."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiweave.llm.cooccurrence import association_pairs, pairs_together
from lexiweave.llm.format_dedup import copies, records_with_copies
from lexiweave.llm.term_counts import association_counts, marked_terms
from lexiweave.llm.top_n import top_associations, top_n_per_group

SCHEMA = "row_id long, run_file string, cue_word string, assoc_pos int, association string, cue string, r1 string"


def rows(n=3000, seed=5):
    """A third of the rows has one cue, a third one association; texts are written in several ways."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cue = "Hot" if rng.random() < 0.33 else rng.choice(["dog", "cat ", "b-ird", "éa", None, "nan", " "])
        word = "Same" if rng.random() < 0.33 else rng.choice([None, "NA", "--", *(f"w{k}" for k in range(30))])
        if word:
            word = rng.choice([word, word.upper(), f" {word}.", f'"{word}"'])
        out.append((i, None if rng.random() < 0.02 else f"run{rng.randrange(60)}", cue, rng.randrange(1, 6), word, "clash", "clash"))
    return out


def fold(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def kept(data):
    return [(i, r, fold(c), p, fold(a)) for i, r, c, p, a, *_ in data if fold(c) not in ("", "na", "nan") and fold(a) not in ("", "na", "nan")]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_hot_group_is_cut_in_every_range(spark, monkeypatch):
    import lexiweave.llm.top_n as tn

    kept_tables = []
    monkeypatch.setattr(tn, "stored", lambda d, label: kept_tables.append(d.persist()) or kept_tables[-1])
    items = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 5000)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("s"), "id")
    got = top_n_per_group(items, ["g"], [F.col("s").desc(), F.col("id").asc()], 5000, range_rows=2000)
    w = "row_number() over (partition by g order by s desc, id)"
    want = items.selectExpr("*", f"{w} as place").where("place <= 5000")
    assert want.exceptAll(got.select(*want.columns)).count() == 0 and got.count() == want.count() and got.where("g = 'hot'").count() == 5000
    plan = got._jdf.queryExecution().toString()
    assert "Union" in plan and "rangepartitioning" in kept_tables[0]._jdf.queryExecution().toString()
    sizes = sorted(r["count"] for r in kept_tables[0].groupBy("_range").count().collect())
    assert len(sizes) >= 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_top_associations(df, data):
    runs = defaultdict(set)
    for _, r, c, _, a in kept(data):
        runs[c, a].add(r)
    by = defaultdict(list)
    for (c, a), s in runs.items():
        by[c].append((-len(s), a))
    want = {(c, k + 1, a) for c, l in by.items() for k, (_, a) in enumerate(sorted(l)[:3])}
    assert {tuple(r) for r in top_associations(df).collect()} == want
    assert top_associations(df.limit(0)).count() == 0


def test_hot_groups_take_the_sorted_ranges(spark):
    data = [(("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 40}"), i * 7919 % 1000, f"t{i % 50}") for i in range(6000)]
    items = spark.createDataFrame(data, "g string, s int, t string")
    got = top_n_per_group(items, ["g"], [F.col("s").desc(), F.col("t").asc()], 5, heavy_times=2, range_rows=100)
    by = defaultdict(list)
    for g, s, t in data:
        by[g].append((-s, t))
    want = Counter((g, -s, t, k + 1) for g, l in by.items() for k, (s, t) in enumerate(sorted(l)[:5]))
    assert Counter(tuple(r) for r in got.select("g", "s", "t", "place").collect()) == want
    assert "Union" in got._jdf.queryExecution().toString() and top_n_per_group(items, ["g"], [F.col("s").asc()], 0).count() == 0


@pytest.mark.parametrize("range_rows", [17, 100_000])
def test_term_counts(df, data, range_rows):
    n, recs = Counter(), defaultdict(set)
    for _, r, c, _, a in kept(data):
        n[a] += 1
        recs[a].add((r, c))
    counts, trials = association_counts(df, range_rows=range_rows)
    assert {r.term: (r.n_rows, r.n_records) for r in counts.collect()} == {a: (n[a], len(recs[a])) for a in n}
    assert trials == len({(r, c) for _, r, c, _, _ in kept(data)})


def test_marks(spark):
    data = [(i, f"r{i}", "cue", 1, "common" if i < 400 else "odd" if i < 402 else f"w{i % 100}", "", "") for i in range(1000)]
    got = {r.term: r.mark for r in marked_terms(spark.createDataFrame(data, SCHEMA)).where("mark <> 'useful'").collect()}
    assert got == {"common": "common", "odd": "rare"}
    assert marked_terms(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_pairs(post, least, lift):
    trials = defaultdict(set)
    for item, *rec in post:
        if item is not None:
            trials[tuple(rec)].add(item)
    na, n = Counter(), Counter()
    for items in trials.values():
        na.update(items)
        n.update(itertools.combinations(sorted(items), 2))
    return {(a, b, k, na[a], na[b]) for (a, b), k in n.items() if k >= least and k * len(trials) >= lift * na[a] * na[b]}


@pytest.mark.parametrize(("heavy", "wide", "broadcast"), [(4, 256, 10), (40, 256, 10_000), (3, 5, 10_000), (3, 5, 0), (1, 2, 10)])
def test_pairs(spark, heavy, wide, broadcast):
    rng = random.Random(heavy)
    items = [f"i{k}" for k in range(26)]
    post = {(items[min(25, int(rng.expovariate(0.15)))], r % 3, r) for r in range(300) for _ in range(rng.choice([1, 3, 9]))} | {("pa", 0, r) for r in range(12)} | {("pb", 0, r) for r in range(12)} | {(None, 0, 1)}
    df = spark.createDataFrame([(i, a, b, "x") for i, a, b in post], "item string, r1 long, r2 long, na string")
    got = pairs_together(df, least=4, lift=1.1, heavy_items=heavy, wide=wide, block_items=3, broadcast_bytes=broadcast)
    want = brute_pairs(post, 4, 1.1)
    assert ("pa", "pb") in {w[:2] for w in want} and len(want) > 5
    assert {(r.assoc_a, r.assoc_b, r.n, r.na, r.nb) for r in got.collect()} == want


def test_items_of_a_hundred_thousand_wide_records(spark):
    """Twelve items share 100,000 records of nine and more items; some rare pairs stand in narrow ones, too."""
    wide = spark.range(100_000).select(F.col("id").alias("r1"), F.explode(F.expr("filter(sequence(0, 11), k -> pmod(xxhash64(id, k), 12) <> 0 and pmod(xxhash64(id, k + 50), 100) < 95)")).alias("k")).select(F.concat(F.lit("i"), "k").alias("item"), "r1", F.lit(0).cast("long").alias("r2"))
    narrow = spark.range(2_000).select(F.explode(F.array(*[F.concat(F.lit("i"), F.pmod(F.col("id") * m, F.lit(12))) for m in (1, 5)])).alias("item"), (F.col("id") + 10**6).alias("r1"), F.lit(0).cast("long").alias("r2")).distinct()
    post = wide.unionByName(narrow).persist()
    got = {(r.assoc_a, r.assoc_b): r.n for r in pairs_together(post, least=5, lift=0.5, heavy_items=2, wide=8, block_items=5).collect()}
    a, b = post.selectExpr("item a", "r1"), post.selectExpr("item b", "r1")
    want = {(r.a, r.b): r["count"] for r in a.join(b, "r1").where("a < b").groupBy("a", "b").count().collect()}
    assert len(want) == 66 and got == want


def test_association_pairs(df, data):
    post = {(a, r, c) for _, r, c, _, a in kept(data)}
    assert {(r.assoc_a, r.assoc_b, r.n, r.na, r.nb) for r in association_pairs(df, least=2, lift=1.2).collect()} == brute_pairs(post, 2, 1.2)
    assert association_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_copies(spark, data, broadcast, monkeypatch):
    import lexiweave.llm.format_dedup as fd

    more = [(10_000 + i, "r", "x", 1, "Y" if i % 2 else "y!", "", "") for i in range(1500)] + [(20_000, "r", "Y", 1, "x", "", ""), (20_001, None, "a", None, "b", "", ""), (20_002, None, "b", None, "a", "", "")]
    if not broadcast:
        monkeypatch.setitem(fd.grouped_copies.__kwdefaults__, "broadcast_bytes", 0)
    groups = defaultdict(list)
    for i, r, c, p, a in kept(data + more):
        groups[r, p, *sorted((c, a))].append(i)
    df = spark.createDataFrame(data + more, SCHEMA)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in copies(df).collect()} == want
    assert {tuple(r) for r in records_with_copies(df).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert copies(df.limit(0)).count() == 0


def test_equal_fingerprints_are_told_apart(spark, data, monkeypatch):
    """With a fingerprint of a few values only, the field by field comparison must part the groups."""
    import lexiweave.llm.format_dedup as fd

    real = fd.multiset_fingerprint
    monkeypatch.setattr(fd, "multiset_fingerprint", lambda fields: [F.pmod(real(fields)[0], F.lit(7)), F.lit(0)])
    groups = defaultdict(list)
    for i, r, c, p, a in kept(data[:600]):
        groups[r, p, *sorted((c, a))].append(i)
    got = {tuple(r) for r in fd.copies(spark.createDataFrame(data[:600], SCHEMA)).collect()}
    assert got == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
