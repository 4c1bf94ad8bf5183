"""Near-duplicate documents by SetSketch registers.

1. A document's set of word shingles gets a SetSketch: ``REGISTERS`` truncated minima on an
   exponential scale, K = floor(1 - log_b(min h)), h exponential of rate ``RATE``.  Sketches of sets
   merge by maximum, and equal registers are as likely as the sets are similar.  Documents whose
   sorted full sets have one SHA-256 (its first 16 bytes) form a class; from here on classes are compared.
2. Bands of ``ROWS`` registers are keys.  A pair of Jaccard similarity 0.85 misses all ``BANDS``
   keys with a probability of 8e-7, one of 0.8 with 8e-5.  In keys with at most ``CROWD`` classes all
   pairs are candidates, at most ``CROWD`` / 2 for each class and band.
3. A key with more classes goes to a group of keys whose classes mostly have the same largest key, so
   a pair that shares a crowded key shares a group.  A group's template is what more than half of its
   classes have.  A class A differs from the template in D(A), found on its full set, and the pair
   A, B is linked exactly if 2 (100 + percent) |D(A) & D(B)| >= e(A) + e(B), where
   e(A) = (100 + percent) |D(A)| - (100 - percent) |A|.  So the class of least e is linked with
   all those that e allows without a common difference, one link each; all others need a common
   difference with their partner, and one among their first ones in the order from rare to frequent,
   so many that the rest would not do.  Only such pairs are candidates: neither a large group of
   copies nor copies of one form with other contents make all their pairs.  Classes that are left over
   when a template took a part of the group get a template of their own.
4. Candidates are estimated jointly: registers that are greater, smaller and equal give the
   likelihood of each Jaccard value, the set sizes being known.  A pair goes only if the likelihood
   at the threshold is under exp(-``DOUBT``) of the greatest.
5. The rest is verified on the full sets, and links give connected components.

Null and empty texts have an empty set and link with nothing.  Repeated rows form one class.  Rows
with equal identifiers and other texts count as documents of their own; null identifiers never
name a component unless there is no other.  Of ties the smaller hash of the text, then any one row of
rows with the same identifier and text, is kept by ``distinct_rows``.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal, join_small, known_rows, without_rows
from .components import components
from .text import shingles

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
CROWD = 16
#: Templates with at most so many shingles together are broadcast, 8 bytes each.
TEMPLATE_TOKENS = 1_000_000
DOUBT = 12.5
_CHUNK = 250_000  # shingles that are hashed together

_rng = np.random.default_rng(20_240_229)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS) of non-empty sets that lie one after another in ``hashes``."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for j in range(REGISTERS):
        least = np.minimum.reduceat(hashes * _MUL[j] + _ADD[j], starts)
        h = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64 * (1 - 1e-15)) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, shingles) to (id, text_hash, n, set_id, regs); empty sets have no set_id and regs."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
            to = min(to, len(sizes))
            full = np.flatnonzero(sizes[at:to]) + at
            set_ids, regs = [None] * (to - at), [None] * (to - at)
            if len(full):
                hashes = values[offsets[at] : offsets[to]]
                starts = offsets[full] - offsets[at]
                sketch = registers(hashes, starts).astype(">u2").tobytes()
                w = 2 * REGISTERS
                for i, k in enumerate(full):
                    own = np.sort(values[offsets[k] : offsets[k + 1]])
                    set_ids[k - at] = hashlib.sha256(own.tobytes()).digest()[:16]
                    regs[k - at] = sketch[w * i : w * i + w]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, to - at),
                    batch.column(1).slice(at, to - at),
                    pa.array(sizes[at:to].astype(np.int64)),
                    pa.array(set_ids, pa.binary()),
                    pa.array(regs, pa.binary()),
                ],
                names=["id", "text_hash", "n", "set_id", "regs"],
            )
            at = to


def _log_p(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12))


def log_likelihood(jaccard: np.ndarray, na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of a Jaccard value, if ``more`` registers of a are greater than b's, and ``less`` are smaller."""
    u, v = na / (na + nb), nb / (na + nb)
    gain, loss = u - v * jaccard, v - u * jaccard
    pg, pl = np.exp(_log_p(gain)), np.exp(_log_p(loss))
    same = np.maximum(1 - pg - pl, 1e-12)
    return more * _log_p(gain) + less * _log_p(loss) + (REGISTERS - more - less) * np.log(same)


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, steps: int = 40) -> np.ndarray:
    """The Jaccard value of greatest likelihood, by golden-section search (the likelihood has one peak)."""
    lo, hi = np.zeros(len(na)), np.minimum(na / nb, nb / na)
    g = (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(x, na, nb, more, less) >= log_likelihood(y, na, nb, more, less)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS) for c in (4, 5))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in (2, 3))
            more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
            best = estimate(na, nb, more, less)
            at = np.minimum(percent / 100, np.minimum(na / nb, nb / na))
            fine = (best >= at) | (log_likelihood(at, na, nb, more, less) >= log_likelihood(best, na, nb, more, less) - DOUBT)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(fine))

    return run


def _labelled(tokens: str, lacking: bool) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(lacking).alias("lacking")))


class _Linker:
    def __init__(self, docs: DataFrame, text: str, key: str, k: int, percent: int) -> None:
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
        self.k, self.percent = k, percent

    def sketches(self) -> DataFrame:
        sets = self.docs.select("id", "text_hash", F.array_distinct(shingles(F.col("text"), self.k)).alias("shingles"))
        return cut(sets.mapInArrow(frugal(_sketch), "id long, text_hash long, n long, set_id binary, regs binary"))

    def sets(self, classes: DataFrame) -> DataFrame:
        """(set_id, n, shingles) of classes that bring id and text_hash."""
        own = join_small(self.docs, classes.select("id", "text_hash", "set_id", "n"), ["id", "text_hash"])
        # Rows with one identifier and text are alike: any one of them gives the set.
        return own.select("set_id", "n", F.array_distinct(shingles(F.col("text"), self.k)).alias("shingles")).dropDuplicates(["set_id"])

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb) those that are linked, as (a, b)."""
        regs = classes.select("set_id", "regs")
        with_regs = pairs.join(regs.withColumnRenamed("set_id", "a").withColumnRenamed("regs", "ra"), "a").join(regs.withColumnRenamed("set_id", "b").withColumnRenamed("regs", "rb"), "b")
        maybe = cut(with_regs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(frugal(_plausible(self.percent)), "a binary, b binary, na long, nb long"))
        ends = maybe.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        sets = cut(self.sets(cut(classes.join(ends, "set_id", "left_semi").select("id", "text_hash", "set_id", "n"))))
        both = maybe.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared * 100 >= F.lit(self.percent) * (F.col("na") + F.col("nb") - shared)).select("a", "b")

    def near_size(self, na: str, nb: str) -> Column:
        return (F.col(na) * 100 >= F.col(nb) * self.percent) & (F.col(nb) * 100 >= F.col(na) * self.percent)

    def links(self, classes: DataFrame) -> DataFrame:
        """(node, component) of the classes that have a link."""
        keys = F.array(*[F.xxhash64(F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS), F.lit(i)) for i in range(BANDS)])
        bands = classes.select("set_id", "n", F.explode(keys).alias("key"))
        counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = cut(bands.join(counts, "key"))
        pairs = self.pairs_of_few(shared.where(F.col("members") <= CROWD))
        groups = cut(self.groups(shared.where(F.col("members") > CROWD)))
        known = []
        if not groups.isEmpty():
            known, more = self.pairs_of_groups(groups, classes)
            for p in more:
                pairs = pairs.unionByName(p)
        found = self.verified(pairs.distinct(), classes)
        for edges in known:
            found = found.unionByName(edges)
        return components(found)

    def pairs_of_few(self, few: DataFrame) -> DataFrame:
        """All pairs (a, b, na, nb) of classes with one key, of like size."""
        listed = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("set_id", "n"))).alias("m"))
        return (
            listed.select(F.posexplode("m").alias("i", "x"), "m")
            .select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
            .select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
            .where(self.near_size("na", "nb"))
        )

    def groups(self, crowd: DataFrame) -> DataFrame:
        """(group, set_id) of classes (set_id, key, members): those with one key are together in some group."""
        home = crowd.groupBy("set_id").agg(F.max(F.struct("members", "key")).alias("h")).select("set_id", F.col("h.key").alias("home"))
        votes = crowd.select("set_id", "key").join(home, "set_id").groupBy("key", "home").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy("key").agg(F.max(F.struct("n", "home")).alias("h")).select("key", F.col("h.home").alias("group"))
        return crowd.select("set_id", "key").join(chosen, "key").select("group", "set_id").distinct()

    def pairs_of_groups(self, groups: DataFrame, classes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Links (a, b) that templates prove, and the other candidates (a, b, na, nb), of (group, set_id)."""
        ids = groups.select("set_id").distinct()
        sets = cut(self.sets(cut(classes.join(ids, "set_id", "left_semi").select("id", "text_hash", "set_id", "n"))))
        both, less = 100 + self.percent, 100 - self.percent
        links, pairs = [], []
        while not groups.isEmpty():
            own = groups.join(sets, "set_id")
            sizes = cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("m")))
            often = own.select("group", F.explode("shingles").alias("token")).groupBy("group", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
            often = cut(join_small(often, sizes, ["group"]))
            most = often.where(F.col("df") * 2 > F.col("m"))
            # Sets have half of the template each on average, so it is at most two average sets long.
            template = most.groupBy("group").agg(F.collect_list("token").alias("template"))
            if most.count() <= TEMPLATE_TOKENS:
                template = F.broadcast(template)
            form = F.coalesce("template", F.array().cast("array<bigint>"))
            apart = own.join(template, "group", "left").select("group", "set_id", "n", F.array_except("shingles", form).alias("more"), F.array_except(form, "shingles").alias("lacks"))
            apart = cut(apart.withColumn("d", F.size("more") + F.size("lacks")).withColumn("e", F.col("d") * both - F.col("n") * less))
            best = apart.groupBy("group").agg(F.min(F.struct("e", "set_id")).alias("best"))
            near = (F.col("best.e") <= 0) & (F.col("e") + F.col("best.e") <= 0)
            rated = cut(join_small(apart, cut(best), ["group"]).withColumn("near", near))
            taken = cut(rated.groupBy("group").agg((F.count_if("near") * 4 >= F.count(F.lit(1))).alias("split")))
            told = join_small(rated, taken, ["group"]).select(
                "group",
                "set_id",
                "n",
                "d",
                "e",
                F.col("best.set_id").alias("centre"),
                "near",
                "split",
                F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("best.e")) / (2.0 * both) - F.lit(1e-9))).alias("least"),
                "more",
                "lacks",
            )
            links.append(told.where("near AND set_id <> centre").select(F.col("centre").alias("a"), F.col("set_id").alias("b")))
            pairs.append(self.across(told, often))
            groups = cut(told.where("split AND NOT near").select("group", "set_id"))
        return links, pairs

    def across(self, told: DataFrame, often: DataFrame) -> DataFrame:
        """Candidates (a, b, na, nb) of a round: classes of a group with a common difference from the template.

        In a split group these are the classes that are near the template with those that are not (which meet one
        another in the next round), else all.  Differences that no other class has match nothing: they come first and are
        counted, not listed.
        """
        of = ["group", "set_id", "n", "d", "e", "near", "split", "least"]
        each = told.select(*of, F.explode(F.concat(_labelled("more", False), _labelled("lacks", True))).alias("t")).select(*of, "t.token", "t.lacking")
        having = often.select("group", "token", F.col("df").alias("having"), (F.col("m") - F.col("df")).alias("without"))
        rated = each.join(having, ["group", "token"]).select(*of, "token", "lacking", F.when(F.col("lacking"), F.col("without")).otherwise(F.col("having")).alias("df")).where("df > 1")
        listed = rated.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("df", "token", "lacking"))).alias("s"))
        alone = F.col("d") - F.size("s")
        length = F.greatest(F.col("d") - F.col("least") + 1 - alone, F.lit(0)).cast("int")
        first = listed.select(*of, alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), length)).alias("i", "x"))
        prefix = cut(first.select(*of, F.col("x.token").alias("token"), F.col("x.lacking").alias("lacking"), (F.col("i") + F.col("alone") + 1).alias("place")))
        on = ["group", "token", "lacking"]
        side = ["set_id", "n", "d", "e", "near", "place"]
        x = prefix.where("NOT (split AND near)").select(*on, "split", *[F.col(c).alias(f"x_{c}") for c in side])
        y = prefix.where("NOT split OR near").select(*on, *[F.col(c).alias(f"y_{c}") for c in side])
        most = F.lit(1) + F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place"))
        enough = most * (2 * (100 + self.percent)) >= F.col("x_e") + F.col("y_e")
        # Two that are near are linked by way of the centre, whatever they have in common.
        once = F.col("split") | ((F.col("x_set_id") < F.col("y_set_id")) & ~(F.col("x_near") & F.col("y_near")))
        met = x.join(y, on).where(once & (F.col("x_set_id") != F.col("y_set_id")) & enough & self.near_size("x_n", "y_n"))
        swap = F.col("x_set_id") > F.col("y_set_id")
        ends = [F.when(swap, F.col(f"{u}_{c}")).otherwise(F.col(f"{v}_{c}")).alias(to) for c, u, v, to in (("set_id", "y", "x", "a"), ("set_id", "x", "y", "b"), ("n", "y", "x", "na"), ("n", "x", "y", "nb"))]
        return met.select(*ends)


def _marked(linker: _Linker) -> DataFrame:
    """(id, text_hash, n, component_id, best): ``best`` marks the one (id, text_hash) of a component that stays."""
    rows = linker.sketches()
    full = rows.where("n > 0")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    classes = cut(
        full.groupBy("set_id", "n")
        .agg(F.min(name).alias("r"), F.first("regs").alias("regs"))
        .select("set_id", "n", F.col("r.id").alias("id"), F.col("r.text_hash").alias("text_hash"), "regs")
    )
    linked = linker.links(classes)
    of_set = cut(classes.select("set_id", name.alias("r")).join(linked.withColumnRenamed("node", "set_id"), "set_id", "left"))
    names = cut(of_set.where("component is not null").groupBy("component").agg(F.min("r").alias("name")))
    told = join_small(of_set, names, ["component"], "left").select("set_id", F.coalesce("name", "r").alias("name"))
    sets = full.select("id", "text_hash", "n", "set_id").join(told, "set_id")
    best = F.col("id").eqNullSafe(F.col("name.id")) & (F.col("text_hash") == F.col("name.text_hash"))
    some = sets.select("id", "text_hash", "n", F.col("name.id").alias("component_id"), best.alias("best"))
    none = rows.where("n = 0").select("id", "text_hash", "n", F.col("id").alias("component_id"), F.lit(True).alias("best"))
    result = cut(some.unionByName(none))
    return result


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``k``-word shingles;
    component_id is the smallest identifier reachable over links, and ``kept`` marks it.
    """
    told = _marked(_Linker(docs, text, key, k, percent))
    return told.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one per component is left.

    Rows are known by identifier and text, so neither null nor repeated identifiers take other rows along.
    """
    told = _marked(_Linker(docs, text, key, k, percent))
    gone = told.where("NOT best").select("id", "text_hash").distinct()
    again = told.where("best AND n > 0").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", "text_hash")
    left = without_rows(docs, cut(gone), text, key)
    again = cut(again)
    if again.isEmpty():
        return left
    same = join_small(known_rows(left, text, key), again, ["id", "text_hash"], "left_semi")
    once = same.dropDuplicates(["id", "text_hash"]).select("row.*")
    return without_rows(left, again, text, key).unionByName(once)
