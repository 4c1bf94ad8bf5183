"""The Merkle manifest, importance resampling and fingerprints against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from impactloom.llm import blocks, fingerprints, merkle, resample
from impactloom.llm.queries import oracle_sql, queries
from tests.oracle import assert_same, connection

from .messy import LONG, PROSE, documents
from .test_dedup import FOLD, shingles

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle", "op12_resample"])
def test_queries_equal_their_sql(name, spark):
    assert_same(spark, connection(SMALL), queries()[name], oracle_sql()[name], SMALL)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(digests):
    """Levels of nodes, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_path(levels, i):
    steps = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        steps.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        i //= 16
    return steps


def brute_manifest(rows, fields):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"], brute_leaf([r[f] for f in fields])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([leaf for _, leaf in groups[g]])
    whole = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (key, leaf) in enumerate(groups[g]):
            out.append((key, leaf, trees[g][-1][0], whole[-1][0], brute_path(trees[g], i) + brute_path(whole, j)))
    return out


def found(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


FIELDS = ["doc_id", "source", "lang", "text"]


def test_manifest_equals_brute_force_across_partitions(spark):
    """One source holds two thirds of all rows; sizes around the fan-out's powers, and many rows that are equal."""
    rng = random.Random(5)
    sizes = {None: 17, "": 1, "a": 16, "b": 15, "c": 257, "d": 256, "hot": 1500, "ß": 33, "one": 1, "two": 2}
    rows = [(rng.randrange(10**6), f"t{rng.random()}", "en", g) for g, n in sizes.items() for _ in range(n)]
    rows += [(7, "same", None, "c")] * 120
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    plain = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
        for partitions in ("1", "13", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert ordered(found(merkle.manifest(df, FIELDS))) == ordered(brute_manifest(plain, FIELDS))
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"), before, strict=True):
            spark.conf.set(name, value)


def test_manifest_of_odd_rows(spark):
    df = documents(spark)
    plain = [r.asDict() for r in df.collect()]
    assert ordered(found(merkle.manifest(df, FIELDS))) == ordered(brute_manifest(plain, FIELDS))
    assert found(merkle.manifest(documents(spark, []), FIELDS)) == []
    one = merkle.manifest(documents(spark, [(1, "x", None, None)]), FIELDS).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_proofs_hold_and_changes_break_them(spark):
    df = documents(spark, [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)])
    told = merkle.manifest(df, FIELDS, carry={"other": merkle.leaf_of([F.lit("x")])})
    row = told.select("leaf", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("good"), merkle.fold(F.col("other"), F.col("path")).alias("bad"), "path", merkle.proof(F.col("path")).alias("proof")).collect()
    assert len(row) == 100
    for r in row:
        assert r["good"] == r["root"] != r["bad"]
        assert r["proof"] == sha(*(s["before"] + s["after"] for s in r["path"]))


def test_a_stack_keeps_one_run_a_level():
    """Pieces of a group that begin and end anywhere give whole runs once, and pieces that join to the others."""
    digests = [sha(str(i)) for i in range(700)]
    levels = brute_tree(digests)
    for cuts in ([0, 700], [0, 1, 2, 700], [0, 16, 256, 512, 700], [0, 5, 250, 251, 600, 699, 700]):
        got = defaultdict(list)
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = merkle._Range(a, None if len(cuts) == 2 else 700, lambda _, level, run, first, nodes, whole: got[level, run].append((first, nodes, whole)))
            for i in range(a, b, 7):
                r.leaves(digests[i : min(i + 7, b)])
                assert all(len(x[2]) < 16 for x in r.open if x)
            r.end()
        for (level, run), pieces in got.items():
            nodes = [d for _, part, _ in sorted(pieces) for d in part]
            assert levels[level][run * 16 : run * 16 + 16][: len(nodes)] == nodes or len(cuts) > 2
            assert (len(pieces) == 1) or not any(w for _, _, w in pieces)
        assert all(levels[0][run * 16 : run * 16 + 16] == [d for _, part, _ in sorted(got[0, run]) for d in part] for run in range(44))


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_draw(docs, target, percent, least, seed):
    def features(text):
        w = WORDS.findall((text or "").translate(FOLD))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def bucket(x):
        return zlib.crc32(x.encode()) % 10000

    s, t = (Counter(bucket(x) for text in texts for x in features(text)[1]) for texts in ([d for _, d in docs], target))
    all_s, all_t = s.total(), t.total()
    out = []
    for key, text in docs:
        w, f = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, f))
        weight = total // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if key is None else key}")[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_drawing_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["straße", "Zebra", "cat", "ÉTÉ", "x1", "é", "東京", "a" * 3000, *(f"w{i}" for i in range(60))]
    texts = ["-; ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) + "\0end" for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "no\nmore"), (None, texts[0]), (905, LONG)]
    target = [texts[3], "Zebra cat", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert ordered(tuple(r) for r in resample.draw(df, goal, percent=25, least=20, seed=7).collect()) == ordered(brute_draw(docs, target, 25, 20, 7))
    odd = documents(spark)
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ordered(tuple(r)[:4] for r in resample.draw(odd, odd.limit(0), percent=50, least=5).collect())
    assert got == ordered(r[:4] for r in brute_draw(plain, [], 50, 5, 7))
    assert resample.draw(documents(spark, []), odd).collect() == []


def test_tries_hold_counts_and_states():
    texts = pa.array(["a b a b", "", "b", None, "ab" * 500 + " a"], pa.string())
    for at, block in blocks.blocks(texts):
        w = blocks.words(block, blocks.LETTERS)
        trie = resample.Trie(w)
        assert at == 0 and w.counts.tolist() == [4, 0, 1, 0, 2]
        assert sorted(zip(trie.state.tolist(), trie.count.tolist(), strict=True)) == sorted((zlib.crc32(x), n) for x, n in ((b"a", 3), (b"b", 3), (b"ab" * 500, 1)))
        assert sorted(zip(trie.pair_state.tolist(), trie.pair_count.tolist(), strict=True)) == sorted((zlib.crc32(x), n) for x, n in ((b"a b", 2), (b"b a", 1), (b"ab" * 500 + b" a", 1)))


def test_words_of_blocks():
    texts = ["Ab\tc", "", " \n", "d é", "x" * 50, "e"]
    w = blocks.words(pa.array(texts, pa.large_string()).slice(0), blocks.NOT_BLANK)
    assert [x.decode() for x in blocks.strings(w).to_pylist()] == ["ab", "c", "d", "é", "x" * 50, "e"]
    assert w.counts.tolist() == [2, 0, 0, 2, 1, 1]
    assert len(set(blocks.hashes(w).tolist())) == 6
    text, h = blocks.shingle_hashes(w, 2)
    assert text.tolist() == [0, 3, 4, 5] and len(set(h.tolist())) == 4


def brute_sketch(text, k=5):
    """Bins, least values and donors one by one, from the hashes of the operator."""
    bins = {}
    _, hashes = blocks.shingle_hashes(blocks.words(pa.array([text or ""], pa.large_string()), blocks.NOT_BLANK), k)
    for h in hashes.tolist():
        b = h >> 56
        bins[b] = min(bins.get(b, 1 << 64), h & ((1 << 56) - 1))
    if not bins:
        return ""

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    out = ""
    for b in range(256):
        attempt, donor = 0, b
        while donor not in bins:
            donor = mix((b + 256 * attempt + 0x9E3779B97F4A7C15) % (1 << 64)) % 256
            attempt += 1
        out += f"{bins[donor] & 15:x}"
    return out


def brute_edited(docs):
    prints = {}

    def sketch(t):
        if t not in prints:
            prints[t] = brute_sketch(t)
        return prints[t]

    def like(a, b):
        if not a or not b:
            return float(a == b)
        return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 1 / 16) / (15 / 16))

    out = []
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for (key, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        text, after = text or "", after or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        out.append((key, len(text), sha(changed), sketch(text), sketch(changed), round(like(sketch(text), sketch(changed)), 9), round(like(sketch(text), sketch(after)), 9)))
    return out


def fingerprinted(df):
    return ordered((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_edited_fingerprints_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i * 3, " ".join(rng.choices(["ä", "Wort", "wort", "x\n", "😀", "stone"], k=rng.randrange(0, 40)))) for i in range(40)]
    docs += [(-5, PROSE), (1000, LONG[:60_000]), (1001, None), (1002, ""), (None, PROSE.upper()), (1003, "abc"), (1004, "a b c d e f g h")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
            assert fingerprinted(fingerprints.edited(df)) == ordered(brute_edited(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = [(4, PROSE)]
    assert fingerprinted(fingerprints.edited(documents(spark, [(4, PROSE, "en", "a")]))) == brute_edited(one)
    assert fingerprints.edited(documents(spark, [])).collect() == []
    assert fingerprints.edited(documents(spark)).count() == 12


def test_fingerprints_of_the_tables(spark):
    docs = connection(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()
    assert fingerprinted(queries()["op13_fingerprints"](spark, SMALL)) == ordered(brute_edited(docs))


def test_equal_texts_have_equal_fingerprints(spark):
    rows = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprints(documents(spark)).collect()}
    by = dict(rows)
    assert by[1] == by[2] == by[9] and by[4] == by[5] == by[7] == "" and len(by[6]) == 256


def test_likeness_is_close_to_the_share_of_shingles(spark):
    rng = random.Random(1)
    worst = mean = 0.0
    texts, shares = [], []
    for i in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 900))]
        other = [w if rng.random() > i / 1500 else "changed" for w in words]
        texts += [" ".join(words), " ".join(other)]
        a, b = shingles(texts[-2], 5), shingles(texts[-1], 5)
        shares.append(len(a & b) / len(a | b))
    codes, known = fingerprints.sketches(pa.array(texts, pa.large_string()))
    got = fingerprints.likeness((codes[::2], known[::2]), (codes[1::2], known[1::2]))
    errors = [abs(x - y) for x, y in zip(got, shares, strict=True)]
    worst, mean = max(errors), sum(errors) / len(errors)
    assert worst < 0.16 and mean < 0.04 and abs(sum(got) - sum(shares)) / len(shares) < 0.01, (worst, mean)
    prints = fingerprints.packed(codes, known)
    again = fingerprints.unpacked(prints)
    assert (again[0] == codes).all()
    for bits in (1, 2, 8):
        some = fingerprints.sketches(pa.array(texts[:4], pa.large_string()), bits=bits)
        assert (fingerprints.unpacked(fingerprints.packed(*some, bits=bits), bits=bits)[0] == some[0]).all()
    df = spark.createDataFrame([(a, b, float(x)) for a, b, x in zip(prints[::2], prints[1::2], got, strict=True)] + [("", "", 1.0), ("", prints[0], 0.0)], "a string, b string, x double")
    assert df.where(F.abs(fingerprints.likeness_of(F.col("a"), F.col("b")) - F.col("x")) > 1e-9).count() == 0
