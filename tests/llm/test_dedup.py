"""Exact and near duplicates against brute force."""

import random
import re

import pytest

from impactloom.llm import components, exact_dedup, near_dup
from impactloom.llm.queries import oracle_sql, queries
from tests.oracle import assert_same, connection

from .messy import LONG, PROSE, documents

SMALL = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    names = list(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in names}


def corpus(seed, groups, copies, edits):
    """Groups of texts that differ by some words, so that links form chains."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4_000)}"
    out, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(30, 90))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(edits + 1)):
                text[r.randrange(len(text))] = word()
            out.append((n, " ".join(text)))
            n += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("groups", "copies", "edits"), [(30, 4, 3), (3, 60, 4)])
def test_near_duplicates_equal_brute_force(spark, groups, copies, edits):
    docs = corpus(groups, groups, copies, edits)
    want = brute_components(docs, 3, 85)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, k=3, percent=85).collect()}
    assert got == want


def family(r, copies, edits, base):
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(edits):
            text[r.randrange(len(text))] = f"w{r.randrange(5_000)}"
        out.append(" ".join(text))
    return out


def candidates(spark, monkeypatch, docs, k, percent):
    """The components, and how many pairs were verified for them."""
    seen, verified = [], near_dup._Linker.verified
    with monkeypatch.context() as m:
        m.setattr(near_dup._Linker, "verified", lambda self, pairs, classes: (seen.append(pairs.count()), verified(self, pairs, classes))[1])
        rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, sum(seen)


def test_forms_with_other_contents_do_not_make_all_pairs(spark, monkeypatch):
    """One form, four edits in each copy: hardly a pair is linked, nearly all share a band."""
    base, verified = [f"w{i}" for i in range(100)], {}
    for n in (200, 400):
        docs = list(enumerate(family(random.Random(1), n, 4, base)))
        got, verified[n] = candidates(spark, monkeypatch, docs, 5, 80)
        assert got == brute_components(docs, 5, 80)
    assert verified[400] < 3 * verified[200] and verified[400] < 400 * 399 / 2 / 8


def test_groups_of_copies_and_variants_lose_no_link(spark, monkeypatch):
    """Copies of a text, of a variant of it, and looser ones, so that templates are taken in more than one round."""
    r, base = random.Random(2), [f"w{i}" for i in range(120)]
    texts = family(r, 60, 1, base) + family(r, 60, 1, [*base[:90], *(f"v{i}" for i in range(30))]) + family(r, 40, 3, base)
    docs = list(enumerate(texts))
    for k, percent in ((3, 85), (5, 80)):
        got, verified = candidates(spark, monkeypatch, docs, k, percent)
        assert got == brute_components(docs, k, percent)
        assert verified < len(docs) * 20


def test_variants_that_share_edits_are_linked_by_way_of_the_centre(spark, monkeypatch):
    """Three of a few edits in each copy: few are close to the form alone, all are by way of it, and they share differences."""
    from itertools import combinations

    base, met, across = [f"w{i}" for i in range(150)], [], near_dup._Linker.across
    monkeypatch.setattr(near_dup._Linker, "across", lambda self, told, often: (met.append(across(self, told, often).count()), across(self, told, often))[1])
    edits = combinations(range(6, 126, 12), 3)
    docs = list(enumerate([" ".join(base), *(" ".join(f"x{i}" if i in e else w for i, w in enumerate(base)) for e in edits)]))
    got, _ = candidates(spark, monkeypatch, docs, 5, 80)
    assert got == brute_components(docs, 5, 80)
    assert met and sum(met) < len(docs)


def test_near_distinct_rows_tell_rows_apart_by_identifier_and_text(spark):
    near, other = PROSE + " today", "completely different words stand here so that nothing is alike at all in this one text"
    rows = [(1, PROSE), (None, near), (None, other), (7, PROSE + " now"), (7, other + " x"), (8, ""), (8, ""), (9, None), (3, LONG), (3, LONG)]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    once = near_dup.distinct_rows(df)
    assert once.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in once.collect()) == sorted([("1", PROSE), ("7", other + " x"), ("8", ""), ("8", ""), ("9", ""), ("3", LONG)])
    assert near_dup.distinct_rows(documents(spark, [])).collect() == []


def test_near_duplicates_of_messy_rows(spark):
    rows = near_dup.near_duplicates(documents(spark), k=5, percent=80).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 9)] == [1, 1, 1, 1]
    assert (by_id[4]["n_shingles"], by_id[4]["kept"], by_id[7]["n_shingles"]) == (0, True, 0)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, None}
    assert near_dup.near_duplicates(documents(spark, [])).collect() == []


def test_sketches_estimate(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 1 << 63, 150, dtype=np.uint64)])
    ra, rb = near_dup.registers(np.concatenate([a, b]), np.array([0, 1000]))
    n = np.array([1000.0])
    got = near_dup.estimate(n, n, np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
    assert abs(got - 850 / 1150) < 0.12
    assert (near_dup.registers(np.concatenate([a, b]), np.array([0]))[0] == np.maximum(ra, rb)).all()  # sketches merge by maximum


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 500}
    assert components.components(df.where("a = b")).collect() == []


def test_exact_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["Same", "sAME", "other " + str(r.randrange(40)), "hot", None, "", "É", "é"])) for i in range(3_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    groups = {}
    for d, t in docs:
        groups.setdefault((t or "").translate(FOLD), []).append(d)
    want = {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
    for parts in (1, 7):
        got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.mark(df, keep="largest", partitions=parts).collect()}
        assert got == want


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_exact_runs_go_on_over_batches_and_partitions(spark, batch):
    """One text with a third of all rows, texts with one long beginning, more partitions than texts, null identifiers."""
    r, names = random.Random(5), "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = ["hot"] * 20 + ["x" * 100 + t for t in "abcA"] + ["x" * 100, "", None, *map(str, range(30))]
    docs = [(None if i % 50 == 0 else i, r.choice(texts)) for i in range(900)]
    df, groups = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), {}
    for d, t in docs:
        groups.setdefault((t or "").translate(FOLD), []).append(d)
    best = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
    before = spark.conf.get(names)
    spark.conf.set(names, batch)
    try:
        for parts in (1, 3, 60):
            rows = exact_dedup.mark(df, partitions=parts).collect()
            assert sorted((str(x["doc_id"]), x["keep_id"], x["group_size"]) for x in rows) == sorted((str(d), best[t], len(g)) for t, g in groups.items() for d in g)
            assert sorted(x["doc_id"] for x in rows if x["kept"]) == sorted(best.values())
            once = exact_dedup.distinct_rows(df, partitions=parts).collect()
            assert sorted(x["doc_id"] for x in once) == sorted(best.values())
    finally:
        spark.conf.set(names, before)


def test_exact_duplicates_of_messy_rows(spark):
    rows = exact_dedup.mark(documents(spark), keep="smallest").collect()
    assert len(rows) == 12
    same = [r for r in rows if r["keep_id"] == 1]
    assert sorted(str(r["doc_id"]) for r in same) == ["1", "2", "9", "None"] and sum(r["kept"] for r in same) == 1
    twice = [r for r in rows if r["doc_id"] == 3]
    assert [r["group_size"] for r in twice] == [2, 2] and sum(r["kept"] for r in twice) == 1  # repeated rows: one stays
    once = exact_dedup.distinct_rows(documents(spark))
    assert once.columns == documents(spark).columns
    assert once.count() == len({(t or "").translate(FOLD) for t in (PROSE, PROSE + " today", "", LONG, " \t\n ", "Ünïcödé ÄÖ bob@x.org 😀")})
    assert exact_dedup.mark(documents(spark, [])).collect() == [] and exact_dedup.distinct_rows(documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(name, spark):
    assert_same(spark, connection(SMALL), queries()[name], oracle_sql()[name], SMALL)
