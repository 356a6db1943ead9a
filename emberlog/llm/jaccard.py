"""N-gram Jaccard join: documents grouped by equal prefixes, pairs verified, components of the links.

A document's set holds the hashes of its distinct shingles.  All sets are sorted by one order, rare shingles
first, so two sets that are similar enough share a token among the first few (their prefixes).  Documents with
equal prefixes and size are one group.  Groups that share a prefix token and are of about one size are a bucket.

A bucket of a few members gives their pairs, which sizes, places of the token and bitmaps filter before
anything is verified.  Large groups of near copies would all share some token; a bucket of many members is
not expanded into pairs.  It has a pivot, its member with the fewest rarer tokens, and every member is verified
against that: a star.  From the star each member keeps D, by how many shingles it differs from the pivot,
and which.  Let d(x, y) be the difference up to which x and y still link; then two members either

* have D(x) + D(y) <= d(x, y): both are linked to the pivot, and nothing is left to do; or
* need at least (D(x) + D(y) - d(x, y)) / 2 of their differences in common: the same prefix argument holds
  for the differences, which near copies of one text do not share.

So the second step joins the prefixes of the differences and verifies what is left, between components only.  No
link is lost between components, and no group of copies or near copies is squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import SPACED, bare, components, cut, fresh, mix, pieces, stored, table, words_of

SLOTS = 1 << 17      # counters of the frequency sketch that orders shingles
LEAST_BITS = 256     # of a set's bitmap
MOST_BITS = 1 << 28  # that mark, by hash, the documents whose sets are needed: 32 MB
FEW = 16             # members up to which a bucket gives its pairs; larger ones go by their pivot, as exactly
_FEW = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle; link at 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def differ(self) -> tuple[int, int]:
        """Sets of together n shingles link if they differ by at most n * differ[0] / differ[1]."""
        return 100 - self.percent, 100 + self.percent


def _sets(batch: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's sorted distinct shingles: k words, or all words of a shorter text."""
    words = words_of(batch, "text", SPACED)
    h, first = words.hash, words.first
    odd = [np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for j in range(k)]
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        grams += mix(h[j:len(h) - k + 1 + j] * odd[j]) if len(grams) else grams
    grams = mix(grams)
    sets = []
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            sets.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            sets.append(mix(np.array([sum(int(mix(h[a + j:a + j + 1] * odd[j])[0]) for j in range(b - a)) + int(_FEW) * int(b - a) & (1 << 64) - 1], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets, np.array([len(s) for s in sets], np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _names(sets: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        one[some] = np.add.reduceat(mix(flat), at)
        two[some] = np.bitwise_xor.reduceat(mix(flat ^ _FEW), at)
    return one.view(np.int64), two.view(np.int64)


def _measure(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row per document (doc_id, text_hash, n, h1, h2) and, in the same pass, rows (slot, times) of the frequency sketch."""
    k = rule.words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, np.int64)
        none = lambda size: pa.nulls(size, pa.int64())
        names = ["doc_id", "text_hash", "n", "h1", "h2", "slot", "times"]
        for batch in pieces(batches, "text"):
            sets, n = _sets(batch, k)
            h1, h2 = _names(sets, n)
            if n.any():
                sketch += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(h1), pa.array(h2), none(len(n)), none(len(n))], names=names)
        at = np.flatnonzero(sketch)
        empty = none(len(at))
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(at), pa.array(sketch[at])], names=names)

    return docs.mapInArrow(work, "doc_id long, text_hash long, n long, h1 long, h2 long, slot long, times long")


def _ordered(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set by the frequency of its shingles' slots, then by hash."""
    return s[np.lexsort((s, sketch[_slot(s)]))]


def _bitmap(s: np.ndarray) -> np.ndarray:
    """How often each place is hit, modulo 2: two bitmaps differ in no more places than their sets do.

    There are as many places as the set has shingles, rounded up to a power of two, so sets of any size that have little
    in common differ in more places than linked ones may."""
    size = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefixes(docs: DataFrame, rule: Rule, sketch: np.ndarray) -> DataFrame:
    """n, h1, h2, the prefix and the bitmap of every set; copies within a batch once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    k, percent = rule.words, rule.percent

    def work(batches):
        for batch in pieces(batches, "text"):
            sets, n = _sets(batch, k)
            h1, h2 = _names(sets, n)
            _, one = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
            one = one[n[one] > 0]
            parts = [_ordered(sets[i], shared.value)[:n[i] + (-n[i] * percent) // 100 + 1] for i in one]
            maps = [_bitmap(sets[i]) for i in one]
            yield pa.RecordBatch.from_arrays([pa.array(n[one]), pa.array(h1[one]), pa.array(h2[one]), _lists(parts), _lists(maps)], names=["n", "h1", "h2", "prefix", "bits"])

    return docs.mapInArrow(work, "n long, h1 long, h2 long, prefix array<long>, bits array<long>")


def _marks(ids: DataFrame) -> np.ndarray:
    """Bits, in 4 KB pieces, of which those hit by the hashes of ``doc_id`` are set: eight for each id, within bounds."""
    size = min(MOST_BITS, max(1 << 18, 1 << (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1   # these functions count from 1
    found = ids.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for row in found:
        at = (row["piece"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _whole(docs: DataFrame, involved: DataFrame, rule: Rule, sketch: np.ndarray) -> DataFrame:
    """id and ordered set of the classes in ``involved`` (id, h1, h2, and the doc_id of a row with the set), one row each.

    Texts stay where they are: a task skips those whose mark isn't set, and only the sets of the others are shuffled, to drop
    what was marked by chance."""
    spark = docs.sparkSession
    marks = _marks(involved)
    shared = spark.sparkContext.broadcast((sketch, marks))
    k = rule.words
    placed = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(marks))).alias("place"))

    def work(batches):
        sketch, marks = shared.value
        for batch in batches:
            place = np.asarray(batch.column(1), np.int64)
            wanted = batch.filter(pa.array((marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for part in pieces([wanted], "text"):
                sets, n = _sets(part, k)
                h1, h2 = _names(sets, n)
                _, one = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h1[one]), pa.array(h2[one]), _lists([_ordered(sets[i], sketch) for i in one])], names=["h1", "h2", "tokens"])

    sets = placed.mapInArrow(work, "h1 long, h2 long, tokens array<long>").join(involved.drop("doc_id"), ["h1", "h2"])
    return sets.dropDuplicates(["id"]).select("id", "tokens")


def _allowed(n: Column, rule: Rule) -> Column:
    """By how many shingles sets of together ``n`` may differ."""
    a, b = rule.differ
    return F.floor(n * a / b + 1e-9)


def _met(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (x, y) with their sizes, what either has alone, how much they differ, and whether they link."""
    pairs = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx")), "x")
    pairs = pairs.join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty")), "y")
    kept = [c for c in pairs.columns if c not in ("x", "y", "tx", "ty")]
    pairs = pairs.select("x", "y", *kept, F.size("tx").cast("long").alias("nx"), F.size("ty").cast("long").alias("ny"),
                         F.array_except("tx", "ty").alias("more"), F.array_except("ty", "tx").alias("less"))
    pairs = pairs.withColumn("apart", (F.size("more") + F.size("less")).cast("long"))
    common = F.col("nx") - F.size("more")
    return pairs.withColumn("linked", 100 * common >= rule.percent * (F.col("nx") + F.col("ny") - common))


def _candidates(grouped: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (x, y) to verify, and whether y is the pivot of a large bucket.

    ``grouped``: id, prefix, bits, ...; ``members``: id, n, group, held."""
    others = stored(members.filter("id <> group").select("id"), "grouped")
    heads = grouped.join(others, "id", "left_anti").select(F.col("id").alias("group"), F.posexplode("prefix").alias("pos", "token"))
    common = heads.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
    sizes = members.filter("id = group").select("group", "n", "held")
    shared = cut(heads.join(common, "token").join(sizes, "group"))
    # linked sets differ in size by less than a band, so each bucket takes a band and the one below
    band = F.floor(F.log("n") / math.log(100 / rule.percent)).cast("int")
    banded = shared.withColumn("band", F.explode(F.array(band, band + 1)))
    buckets = banded.groupBy("token", "band").agg(F.sum("held").alias("all"), F.min(F.struct("pos", "group")).alias("pivot")).filter("all > 1")
    banded = banded.join(buckets, ["token", "band"])
    star = banded.filter(F.col("all") > FEW).select("group", F.col("pivot.group").alias("y")).distinct()
    star = star.unionByName(sizes.filter(F.col("held") > FEW).select("group", F.col("group").alias("y"))).distinct()
    star = star.join(members.select("group", F.col("id").alias("x")), "group").filter("x <> y").select("x", "y").distinct()
    few = banded.filter(F.col("all") <= FEW).select("token", "band", "group", "n", "pos").join(members.select("group", "id"), "group").drop("group")
    other = few.select("token", "band", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("j"))
    needed = F.col("n") + F.col("ny") - _allowed(F.col("n") + F.col("ny"), rule)
    possible = 2 * F.least(F.col("n") - F.col("pos"), F.col("ny") - F.col("j"))
    alike = (F.col("id") < F.col("y")) & (possible >= needed) & (100 * F.least("n", "ny") >= rule.percent * F.greatest("n", "ny"))
    inside = members.filter((F.col("held") > 1) & (F.col("held") <= FEW)).select("group", "id", "n")
    inside = inside.join(inside.toDF("group", "y", "ny"), "group").filter("id < y").select(F.col("id").alias("x"), "y", "n", "ny")
    direct = few.join(other, ["token", "band"]).filter(alike).select(F.col("id").alias("x"), "y", "n", "ny")
    direct = direct.unionByName(inside).distinct()
    bits = grouped.select("id", "bits")
    direct = direct.join(bits.select(F.col("id").alias("x"), F.col("bits").alias("bx")), "x").join(bits.select(F.col("id").alias("y"), F.col("bits").alias("by")), "y")
    # of two sizes, the longer bitmap is folded: its halves together are the bitmap of half the places
    words = F.least(F.size("bx"), F.size("by"))
    folded = lambda b: F.when(F.size(b) > words, F.zip_with(F.slice(b, 1, words), F.slice(b, words + 1, words), lambda v, w: v.bitwiseXOR(w))).otherwise(F.col(b))
    apart = F.aggregate(F.zip_with(folded("bx"), folded("by"), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)
    direct = direct.filter(apart <= _allowed(F.col("n") + F.col("ny"), rule)).select("x", "y")
    return stored(star.select("x", "y", F.lit(True).alias("star")).unionByName(direct.select("x", "y", F.lit(False).alias("star"))), "pairs")


def _further(met: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members of one pivot, in different components so far, whose differences from it overlap enough."""
    # only pivots with a member that isn't linked to them can hide further links
    open_pivots = met.filter("star AND NOT linked").select("y").distinct()
    rest = met.filter("star").join(open_pivots, "y", "left_semi").join(roots.withColumnRenamed("node", "x"), "x", "left")
    rest = rest.select("x", "y", "nx", "apart", F.coalesce("component", "x").alias("root"), F.posexplode("differences").alias("pos", "d"))
    rest = rest.select("x", "nx", "apart", "root", "pos", F.xxhash64("y", "d.side", "d.token").alias("key"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rest = cut(rest.join(mixed, "key", "left_semi"))
    other = rest.toDF(*[c if c == "key" else f"o_{c}" for c in rest.columns])
    allowed = _allowed(F.col("nx") + F.col("o_nx"), rule)
    needed = F.ceil((F.col("apart") + F.col("o_apart") - allowed) / 2)
    possible = 1 + F.least(F.col("apart") - F.col("pos") - 1, F.col("o_apart") - F.col("o_pos") - 1)
    pairs = rest.join(other, "key").filter((F.col("x") < F.col("o_x")) & (F.col("root") != F.col("o_root")))
    pairs = pairs.filter((needed >= 1) & (possible >= needed) & (100 * F.least("nx", "o_nx") >= rule.percent * F.greatest("nx", "o_nx")))
    return stored(pairs.select("x", F.col("o_x").alias("y")).distinct(), "pairs")


def join_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Texts are cut at blanks and the controls 9 to 13 after A-Z became lower case; a document's set holds its distinct shingles
    of ``rule.words`` words, or its whole sequence if that is shorter.  Two documents link when
    100 * intersection >= percent * union.  ``component_id`` is the least doc_id reachable, its own included.

    A null or empty text has an empty set and links with nothing.  Equal sets are one class.  Rows that share a doc_id are one
    document: all their texts are linked.  A row with a null doc_id names no document; it links by its text, and has the
    component of documents that it reaches, if any, else null.
    """
    return _joined(docs, rule)[0].drop("rid")


def _joined(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``join_classes`` with each row's own number ``rid``; and (rid, doc_id, group, text_hash), ``group`` naming the component of a row with a set."""
    rows = bare(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    measured = cut(_measure(rows, rule).withColumn("rid", F.monotonically_increasing_id()))
    slots = measured.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum("times").alias("times")).toPandas()
    sketch = np.zeros(SLOTS, np.int64)
    sketch[slots["slot"].to_numpy(np.int64)] = slots["times"].to_numpy(np.int64)
    own = measured.filter("slot IS NULL").select("rid", "doc_id", "n", "h1", "h2", "text_hash")
    names = ["n", "h1", "h2"]
    # a class is named by one of its rows; ids are shared or missing
    classes = cut(own.filter("n > 0").groupBy(*names).agg(F.min("rid").alias("id"), F.min("doc_id").alias("doc_id")))
    prefixes = _prefixes(rows.select("text"), rule, sketch).groupBy(*names).agg(F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    # classes with equal prefix and size are one group, named after its least member
    grouped = cut(classes.join(prefixes, names).select("id", "n", "prefix", "bits", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.reverse("prefix")).alias("p2")))
    groups = grouped.groupBy("n", "p1", "p2").agg(F.min("id").alias("group"), F.count("*").alias("held"))
    members = cut(grouped.select("id", "n", "p1", "p2").join(groups, ["n", "p1", "p2"]).select("id", "n", "group", "held"))
    star = _candidates(grouped, members, rule)
    involved = star.select(F.explode(F.array("x", "y")).alias("id")).distinct().join(classes, "id")
    involved = cut(involved.select("id", "doc_id", "h1", "h2"))
    sets = cut(_whole(rows, involved, rule, sketch))
    # the first differences of each member: its own tokens, rare ones first, then the pivot's
    reach = _allowed(F.col("nx") * (100 + rule.percent) / rule.percent, rule) + 1
    signed = F.concat(F.transform("more", lambda t: F.struct(F.lit(0).alias("side"), t.alias("token"))), F.transform("less", lambda t: F.struct(F.lit(1).alias("side"), t.alias("token"))))
    met = _met(star, sets, rule)
    met = cut(met.select("x", "y", "star", "nx", "apart", "linked", F.slice(signed, F.lit(1), reach.cast("int")).alias("differences")))
    links = met.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = cut(components(links))
    more = _met(_further(met, roots, rule), sets, rule).filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    every = roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    of_rows = cut(own.filter("n > 0").join(classes.drop("doc_id"), names).select("rid", "doc_id", F.col("id").alias("class")))
    several = of_rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    same = of_rows.join(several.select("doc_id", "low"), "doc_id").filter("class > low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    final = cut(components(every.unionByName(same)).withColumnRenamed("node", "id"))
    # the least doc_id of each component, of the linked classes only
    linked = final.join(classes.select("id", "doc_id"), "id")
    linked = linked.select("id", "component").join(linked.groupBy("component").agg(F.min("doc_id").alias("least")), "component")
    by_class = classes.join(linked, "id", "left").select(F.col("id").alias("class"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("component", "id").alias("group"))
    of_rows = of_rows.join(by_class, "class").select("rid", "doc_id", "component_id", "group")
    # a row without a set has the component of its document's other rows
    empty = own.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    by_doc = of_rows.join(empty, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("by_doc"))
    with_set = own.filter("n > 0").join(of_rows.drop("doc_id"), "rid")
    without = own.filter("n = 0").join(by_doc, "doc_id", "left").withColumnRenamed("by_doc", "component_id")
    out = with_set.unionByName(without, allowMissingColumns=True)
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), out.select("rid", "doc_id", "group", "text_hash")


def deduplicate(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component, that with the least doc_id, and every row that links with nothing; all columns as they are.

    Of rows that share the least doc_id, or if none has one, that with the least hash of its text stays, and one of rows that
    are equal in both.  Rows without words link with nothing and all stay, repeated ones too.
    """
    grouped = _joined(docs, rule)[1].filter("group IS NOT NULL")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rid")).alias("first"))
    judged = grouped.join(first, "group").select(
        "doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.struct("first.doc_id", "first.text_hash")).alias("stays"), (F.col("rid") == F.col("first.rid")).alias("is_first"))
    judged = cut(judged.filter("NOT is_first").select("doc_id", "text_hash", "stays").distinct())
    id_, hash_ = fresh(docs, "id", "text_hash")
    keyed = docs.withColumns({id_: F.col("`doc_id`").cast("long"), hash_: F.xxhash64(F.col("`text`"))})
    wanted = lambda rows: rows.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    same = lambda rows: keyed[id_].eqNullSafe(rows["of"]) & (keyed[hash_] == rows["hash"])
    gone, again = wanted(judged.filter("NOT stays")), wanted(judged.filter("stays"))
    keyed = keyed.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        keyed = keyed.join(again, same(again), "left_anti").unionByName(keyed.join(again, same(again), "left_semi").dropDuplicates([id_, hash_]))
    return keyed.drop(id_, hash_)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, links at 85 percent, over all documents."""
    return join_classes(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))
