"""Exact n-gram Jaccard join: prefix, length, positional and suffix filters, one verification per pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import fresh
from capstrata.llm.wordhash import _FACTOR, Texts, mix, slices
from capstrata.operators.graph import connected_components
from capstrata.session import stage, unstage

#: Shingles whose hash is divisible by this decide which documents can have a partner at all.
PROBED = 4
#: Parts of the hash range in which two sets' counts are compared (the suffix filter).
PARTS = 64
#: The set of documents to read again is a bitmap of this many slots: fixed in size, and only too large a set.
SLOTS = 1 << 22
#: Rounds in which every document meets one other per shared prefix shingle, before the round that meets all others.
PIVOT_ROUNDS = 2


@dataclass(frozen=True)
class JaccardRule:
    """Documents are linked when den * |A and B| >= num * |A or B| over their distinct `words`-word shingles."""

    words: int = 5
    num: int = 80
    den: int = 100
    lower: bool = True

    def prefix(self, n: Column) -> Column:
        """A set of n shingles shares one of its first so many shingles with any set it is linked to."""
        return (n - F.floor((self.num * n + self.den - 1) / self.den) + 1).cast("int")

    def least_overlap(self, a: Column, b: Column) -> Column:
        """Fewest common shingles of linked sets of these sizes."""
        return F.ceil(F.lit(self.num) * (a + b) / F.lit(self.num + self.den))


def shingle_sets(t: Texts, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; one hash of the whole sequence if it has fewer words."""
    first, h = t.windows(words)
    at = np.searchsorted(t.row[first], np.arange(t.n + 1))
    n_words = t.words_per_row()
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    short = t.hash(t.starts, t.ends) if len(t.starts) else h
    for i in range(t.n):
        if 0 < n_words[i] < words:
            one = short[word_at[i]:word_at[i] + 1]
            for j in range(1, n_words[i]):
                one = mix(one * _FACTOR + short[word_at[i] + j:word_at[i] + j + 1])
            yield mix(one + np.uint64(n_words[i]))
        else:
            yield np.unique(h[at[i]:at[i + 1]])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only."""
    a, b = mix(s), mix(s * _FACTOR + np.uint64(7))
    return int(np.add.reduce(a, dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(b).astype(np.int64)) if len(b) else 0


def parts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS).astype(np.int32)


def document_sets(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """(doc, text) to one row each: size and fingerprint of its set, and the probed shingles."""
    words, lower, kind = rule.words, rule.lower, docs.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, t in slices(batch.column(1), lower):
                out: list[list] = [[] for _ in range(4)]
                for s in shingle_sets(t, words):
                    for c, v in zip(out, (len(s), *fingerprint(s), s[s % np.uint64(PROBED) == 0].view(np.int64))):
                        c.append(v)
                longs = pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, t.n), *[pa.array(c, k) for c, k in zip(out, (longs, longs, longs, pa.list_(longs)))]], names=["doc", "n", "k1", "k2", "probed"])

    return docs.select("doc", "text").mapInArrow(work, f"doc {kind}, n long, k1 long, k2 long, probed array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, rule: JaccardRule) -> DataFrame:
    """The whole shingle sets of the wanted documents (node, doc, k1, k2), computed again from their texts.

    Only texts whose id falls into a wanted slot are cut into shingles; the join then takes exactly the wanted ones.
    """
    slot = F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(SLOTS)).cast("int")
    bits = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1, s & 31))").alias("bits"))
    bitmap = np.zeros(SLOTS // 32, np.uint32)
    for r in bits.toLocalIterator():
        bitmap[r["word"]] = r["bits"] & 0xFFFFFFFF
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # SLOTS bits, whatever the input
    words, lower, kind = rule.words, rule.lower, docs.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            hit = (shared.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            for start, t in slices(batch.column(1), lower):
                out: list[list] = [[] for _ in range(5)]
                for u in shingle_sets(t, words):
                    for c, v in zip(out, (*fingerprint(u), len(u), parts_of(u), u.view(np.int64))):
                        c.append(v)
                longs = pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, t.n), *[pa.array(c, k) for c, k in zip(out, (longs, longs, longs, pa.list_(pa.int32()), pa.list_(longs)))]], names=["doc", "k1", "k2", "n", "parts", "shingles"])

    again = docs.select("doc", "text", slot.alias("slot")).mapInArrow(work, f"doc {kind}, k1 long, k2 long, n long, parts array<int>, shingles array<long>")
    w = wanted.select(F.col("doc").alias("w_doc"), F.col("k1").alias("w1"), F.col("k2").alias("w2"), "node")
    same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    return stage(again.join(w, same).select("node", "n", "parts", "shingles").dropDuplicates(["node"]))


def possible(base: DataFrame, nodes: DataFrame, rule: JaccardRule) -> DataFrame:
    """Nodes that can have a partner, judged by their probed shingles.

    A shingle of one document finds no partner. A set with as many of those as its prefix is long shares no shingle of
    the prefix of any order that puts them first, so it has no partner at all. Most documents go here, and only a
    fixed share of all shingles is counted for it.
    """
    tokens = base.where("n > 0").select("rid", F.explode("probed").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    common = tokens.join(shared, "token").groupBy("rid").agg(F.count(F.lit(1)).alias("common"))
    sets = base.select("rid", "n", F.size("probed").alias("n_probed")).join(common, "rid", "left")
    left = sets.where(F.col("n_probed") - F.coalesce("common", F.lit(0)) < rule.prefix(F.col("n"))).select(F.col("rid").alias("node"))
    return stage(nodes.join(left, "node"))


def prefix_entries(sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """(token, node, n, pos, left, largest): the prefix of every set, rarest shingles first.

    All sets are ordered alike, by how many of them have a shingle, then by hash; shingles of one set come first and
    make no entry. pos counts the shared shingles before this one, left those from it on. largest is the size of the
    largest set that can be linked to this one: they share at most the shingles that are not its own alone.
    """
    tokens = sets.select("node", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    ranked = ranked.join(sets.select("node", "n"), "node").withColumn("prefix", rule.prefix(F.col("n"))).withColumn("single", (F.col("n") - F.size("common")).cast("int"))
    most = F.floor(F.size("common") * F.lit(rule.num + rule.den) / F.lit(rule.num)) - F.col("n")
    first = F.slice("common", F.lit(1), F.col("prefix") - F.col("single"))
    entries = ranked.where("single < prefix").select("node", "n", F.size("common").alias("m"), most.alias("largest"), F.posexplode(first).alias("pos", "e"))
    return stage(entries.select("e.token", "node", "n", "pos", (F.col("m") - F.col("pos")).alias("left"), "largest"))


def live(entries: DataFrame) -> DataFrame:
    """Entries whose list holds another set that is small enough for them and lies in another component."""
    lists = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("token", "least")
    return entries.join(lists, "token").where(F.col("largest") >= F.col("least")).select(*entries.columns)


def can_link(rule: JaccardRule, a: str, b: str) -> Column:
    """Length and positional filters for two entries of one token."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = (F.lit(rule.den) * F.least(na, nb) >= F.lit(rule.num) * F.greatest(na, nb)) & (na <= F.col(f"{b}.largest")) & (nb <= F.col(f"{a}.largest"))
    shared = F.least(f"{a}.pos", f"{b}.pos") + F.least(f"{a}.left", f"{b}.left")  # at most, before the token and from it on
    return length & (shared >= rule.least_overlap(na, nb))


def first_common(rule: JaccardRule, a: str, b: str) -> Column:
    """Whether the token is the first that both prefixes have: a pair then shows up once, and shares nothing before it."""
    common = F.array_intersect(f"{a}.prefix", f"{b}.prefix")
    enough = F.least(f"{a}.left", f"{b}.left") >= rule.least_overlap(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return enough & (F.element_at(common, 1) == F.col(f"{a}.token"))


def verify(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """The linked ones of the candidate pairs (a, b); the suffix filter goes before the whole sets are moved.

    Common shingles lie in the same part of the hash range, so two sets share at most the smaller count of each part.
    """
    def side(name: str, *cols: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    most = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side("a", "n", "parts"), "a").join(side("b", "n", "parts"), "b")
    near = near.where(most >= rule.least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b")
    both = near.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.where(common >= rule.least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b")


def linked_sets(entries: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """Components (node, component) of the sets under the links, without listing a group's pairs.

    In the first rounds every set meets one pivot per prefix shingle, another one in every round. That joins almost
    all of a large group of copies in one component, with work in proportion to the entries. The last round meets
    every pair that shares a prefix shingle and still lies in different components, so no link between components
    is missed; per shingle only the sets outside its largest component are joined with all others.
    """
    vertices = sets.select("node")
    comps, links = vertices.select("node", F.col("node").alias("component")), []
    seen: list[DataFrame] = []

    def meet(pairs: DataFrame) -> bool:
        """Verify pairs that are new; whether any is linked."""
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        for s in seen:
            pairs = pairs.join(s, ["a", "b"], "left_anti")
        seen.append(stage(pairs))
        links.append(stage(verify(seen[-1], sets, rule)))
        return not links[-1].isEmpty()

    def connected() -> DataFrame:
        return connected_components(vertices, reduce(DataFrame.union, links), [], "node", "a", "b")

    apart = F.col("x.component") != F.col("y.component")
    for r in range(PIVOT_ROUNDS):
        e = stage(live(live(entries.join(comps, "node"))))
        order = F.xxhash64(F.lit(r), "token", "node") if r else F.col("node")
        pivot = e.groupBy("token").agg(F.min(F.struct(order.alias("o"), "node", "n", "pos", "left", "component", "largest")).alias("p")).select("token", "p.*")
        found = meet(e.alias("x").join(pivot.alias("y"), "token").where(apart & can_link(rule, "x", "y")))
        unstage(e)
        if found and r < PIVOT_ROUNDS - 1:  # one step of the smallest label: equal labels are connected, which is all that is asked here
            both = links[-1].select(F.col("a").alias("node"), F.col("b").alias("other")).union(links[-1].select("b", "a"))
            met = both.join(comps.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
            comps = stage(comps.join(met, "node", "left").select("node", F.least("component", "low").alias("component")))
    comps = stage(connected()) if links else comps
    prefixes = entries.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("p")).select("node", F.col("p.token").alias("prefix"))
    e = stage(live(live(entries.join(comps, "node"))).join(prefixes, "node"))
    sizes = e.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m")).select("token", F.col("m.component").alias("main"))
    outside = e.join(largest, "token").where("component <> main")
    once = (F.col("y.component") == F.col("x.main")) | (F.col("x.node") < F.col("y.node"))
    if meet(outside.alias("x").join(e.alias("y"), "token").where(apart & once & can_link(rule, "x", "y") & first_common(rule, "x", "y"))):
        comps = stage(connected())
    unstage(e, *seen)
    return comps


def jaccard_components(df: DataFrame, key: str, text: str, rule: JaccardRule) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key reachable by links, its own included).

    Texts are taken whole. Equal sets are one node of the graph, so copies never make pairs. A text that is null or
    has no word has the empty set: n_shingles 0, linked with nothing. Rows may repeat and keys need not be unique:
    every row is a document of its own; null keys are ignored as component ids (null if a component has no other).
    Other columns are not read.
    """
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    base = stage(document_sets(docs, rule).withColumn("rid", F.monotonically_increasing_id()))
    nodes = stage(
        base.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("rid", "doc")).alias("first"), F.min("doc").alias("low"))
        .select("k1", "k2", F.col("first.rid").alias("node"), F.col("first.doc").alias("doc"), "low")
    )
    sets = whole_sets(docs, possible(base, nodes, rule), rule)
    entries = prefix_entries(sets, rule)
    comps = linked_sets(entries, sets, rule)
    lows = comps.join(nodes.select("node", "low"), "node")
    least = stage(lows.groupBy("component").agg(F.min("low").alias("least")))  # staged, so that a hot component can be split in the join
    ids = nodes.join(comps, "node", "left").join(least, "component", "left").select("k1", "k2", F.coalesce("least", "low").alias("component_id"))
    ids = stage(ids)
    unstage(entries, sets)
    found = base.select("doc", "n", "k1", "k2").join(ids, ["k1", "k2"], "left")
    return found.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )


def keep_one(df: DataFrame, key: str, text: str, rule: JaccardRule) -> DataFrame:
    """One document of every group of linked texts, that of the smallest key; all columns stay.

    A document is its key and its text: repeated rows are one document and leave one row, rows of one key with
    different texts are different documents. Rows without a key come last in the order. Texts without words stay.
    """
    of_id, of_version, first, mark = fresh(df.columns, "kj_id", "kj_version", "kj_twice", "kj_version_of_row")
    version = F.xxhash64(F.lit("text"), F.col(text))
    docs = df.select(F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), version.alias("version")).alias("doc"), F.col(text).alias("text"))
    found = jaccard_components(docs, "doc", "text", rule)
    counts = stage(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.any_value("component_id").alias("c")).where("n > 1 or doc <> c"))
    flat = counts.select(F.col("doc.id").alias(of_id), F.col("doc.version").alias(of_version), (F.col("doc") == F.col("c")).alias(first))
    twice = stage(flat.where(F.col(first)))
    same = F.col(key).eqNullSafe(F.col(of_id)) & (version == F.col(of_version))
    rest = df.join(flat, same, "left_anti")
    once = df.join(twice, same, "left_semi").withColumn(mark, version).dropDuplicates([key, mark]).drop(mark)
    return rest.unionByName(once)
