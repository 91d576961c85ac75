"""N-gram Jaccard join by vertical partitioning.

A document's n-grams are distinct runs of words, as 64-bit hashes; the order of the hashes is the
global order. It is cut into fragments: ranges of the order. Two sets of sizes x and y whose
Jaccard coefficient reaches the threshold differ in at most H elements, H from x and y alone, so of
more than H fragments at least one is equal in both. Sizes fall into bands so that partners are of
the same or the next band; a set is cut for its own band, and for the one below if it can have a
partner there, and the hash of each fragment is a key that partners share. That finds every
pair, and a common word or passage makes no pairs unless it fills whole fragments.

The overlap of a pair to verify is counted in each of ``PARTS`` fragments apart and summed by
pair, exactly (up to collisions of 64-bit hashes), so large sets are never in one piece.

Equal sets are one node. The nodes of one key don't all meet (see ``components.resolved``), yet no
link between components is lost. Keys are combined in each batch before the shuffle, so that a
key which a third of all rows hold arrives as a row for each batch, not for each document.

Cases: a null or empty text has no n-grams and links with nothing; a text with fewer words than n
is one n-gram; rows that repeat an id are all returned, with the same component if their texts are
equal; a null id is never a component's id (it is null where there is no other); other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_KEYS, BROADCAST_ROWS, bounded, pieces, scoped, small, unwrapped, wrapped, written
from lodestar.llm.components import asked_for, resolved

N, PERCENT = 4, 85
PARTS = 8
#: So many fragments more than differences can spoil, or a tenth; sets with as many empty ones get
#: keys for those.
SPARE = 3

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * _GOLD + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def node_of(own: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).astype(np.int64))


class Bands:
    """Bands of set sizes, each up to half as large again as it begins, and the number of
    differences that two linked sets can have whose smaller is of a band."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.starts = percent, [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, last * 3 // 2, -(-last * 100 // self.percent)))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def levels(self, size: int) -> list[int]:
        """The set's own band, and the one below if a set there can link to one of this size."""
        own = self.band(size)
        return [own, own - 1] if own and size * self.percent <= 100 * (self.starts[own] - 1) else [own]

    def differences(self, band: int) -> int:
        return (100 - self.percent) * (self.starts[band + 1] - 1) // self.percent

    def fragments(self, band: int) -> int:
        """More fragments than differences can spoil, by ``SPARE`` or a tenth."""
        most = self.differences(band)
        return most + 1 + min(most, max(SPARE, most // 10))

    def need(self, size: int, band: int, empty: int) -> int:
        """The fewest keys that a set shares with any that it links to at a band's level: all fragments
        but those that are empty and those that the differences of a linked pair spoil, of which the other
        is as large as can be (at its own level), or ends before this one's band (at the one below)."""
        other = size * 100 // self.percent if band == self.band(size) else self.starts[band + 1] - 1
        spoilt = (100 - self.percent) * (size + other) // (100 + self.percent)
        return max(1, self.fragments(band) - spoilt - empty)


def keys(own: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The fragment keys of a set for its levels, and beside each its level and how many keys of that level
    the set shares with any that it links to, as ``need << 8 | level``."""
    found, tags, spread = [], [], mixed(own + _GOLD)
    for level in bands.levels(len(own)):
        most, count = bands.differences(level), bands.fragments(level)
        where = ((own >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        sums = np.add.reduceat(spread, first)
        place = np.uint64(level) << np.uint64(40)
        found.append(mixed(sums + mixed(where[first] + place + np.uint64(1))))
        if len(first) <= most:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), where[first])
            found.append(mixed(mixed(empty + place + np.uint64(1))))
        tags.append(np.full(sum(map(len, found)) - sum(map(len, tags)), bands.need(len(own), level, count - len(first)) << 8 | level, np.int64))
    return np.concatenate(found), np.concatenate(tags)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for whole in batches:
        for part in pieces(whole, 1):
            yield part.column(0), part.column(1).to_pylist()


def named(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, node of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            sets = [grams(t, n) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())], names=["id", "n_shingles", "node"])

    tagged = bounded(docs).select(F.struct("doc_id", F.xxhash64("text").alias("tag")).alias("id"), "text")
    return tagged.mapInArrow(run, f"id struct<doc_id: {kind}, tag: bigint>, n_shingles long, node long").select("id.doc_id", "id.tag", "n_shingles", "node")


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """route, node, tag, key, up: within a batch the first node of a key stands for the others.

    The first has route = key, and itself as ``up`` if there are others; another has its key, its first
    as ``up``, and a route of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for _, texts in _texts(batches):
            sets = [s for s in map(lambda t: grams(t, n), texts) if len(s)]
            if not sets:
                continue
            each = [keys(s, bands) for s in sets]
            key = np.concatenate([k for k, _ in each]).view(np.int64)
            tag = np.concatenate([t for _, t in each])
            node = np.repeat(np.array([node_of(s) for s in sets], np.int64), [len(k) for k, _ in each])
            order = np.lexsort((node, key))
            key, node, tag = key[order], node[order], tag[order]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, tag = key[new], node[new], tag[new]
            first = np.append(True, key[1:] != key[:-1])
            up = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            alone = first & np.append(first[1:], True)
            route = np.where(first, key, mixed(key.view(np.uint64) ^ mixed(node.view(np.uint64))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(node), pa.array(tag), pa.array(key, mask=first), pa.array(up, mask=alone)], names=["route", "node", "tag", "key", "up"])

    return docs.select("doc_id", "text").mapInArrow(run, "route long, node long, tag long, key long, up long")


def parted(docs: DataFrame, n: int, parts: int = PARTS) -> DataFrame:
    """node, part, own: the n-grams of each row in fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            for at in range(0, len(texts), 64):
                node, part, own = [], [], []
                for s in (grams(t, n) for t in texts[at : at + 64]):
                    if len(s):
                        name = node_of(s)
                        place = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                        for i, x in enumerate(np.split(s.view(np.int64), np.searchsorted(place, np.arange(1, parts, dtype=np.uint64)))):
                            node.append(name), part.append(i), own.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(own, pa.list_(pa.int64()))], names=["node", "part", "own"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, part int, own array<long>")


class Candidates:
    """The sets of nodes, from the first document of each node; by a hash of the text if none has an id."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame, n: int) -> None:
        self.docs, self.nodes, self.n = docs.select("doc_id", "text"), nodes, n
        self.unnamed = nodes.where("first is null").limit(1).count() > 0
        self.repeats = self.unnamed or repeats(rows)

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """The documents that stand for nodes."""
        firsts = written(wanted.join(self.nodes, "node").select(F.col("first").alias("of"), "tag"))
        firsts = small(firsts, firsts.count())
        named = self.docs.join(firsts, F.col("doc_id") == F.col("of"), "left_semi").select("doc_id", "text")
        if not self.unnamed:
            return named
        tags = firsts.where("of is null").select("tag")
        return named.union(self.docs.where("doc_id is null").join(tags, F.xxhash64("text") == F.col("tag"), "left_semi").select("doc_id", "text"))

    def parts(self, wanted: DataFrame) -> DataFrame:
        """node, part, own of the nodes ``wanted`` (distinct)."""
        sets = parted(self._texts(wanted), self.n)
        return written(sets.dropDuplicates(["node", "part"]) if self.repeats else sets)


def _sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, part, own_a, own_b of each pair and fragment; every set has a row for each fragment."""
    sets = asked_for(sets, pairs)
    mine = sets.join(pairs.select("a", "b"), F.col("node") == F.col("a")).select("a", "b", "part", F.col("own").alias("own_a"))
    return mine.join(sets.select(F.col("node").alias("b"), "part", F.col("own").alias("own_b")), ["b", "part"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, x, y, both of each pair: the overlap in each fragment is counted apart and summed by pair."""
    total = lambda c: F.sum(F.size(c).cast("long"))
    return _sides(pairs, sets).groupBy("a", "b").agg(total("own_a").alias("x"), total("own_b").alias("y"), total(F.array_intersect("own_a", "own_b")).alias("both"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, mine, theirs of each pair: the elements that only one of the two has, found in each fragment apart."""
    only = lambda c, other: F.flatten(F.collect_list(F.array_except(c, other)))
    return _sides(pairs, sets).groupBy("a", "b").agg(only("own_a", "own_b").alias("mine"), only("own_b", "own_a").alias("theirs"))


def shared(found: DataFrame) -> DataFrame:
    """key, node of the nodes that may link, by the keys that others hold as well. A node that shares
    fewer keys of a level than any link of it needs is left out there."""
    route = Window.partitionBy("route")
    seen = found.select("*", F.min("node").over(route).alias("low"), F.max("node").over(route).alias("high"))
    held = seen.where("up is not null or low < high").select(F.coalesce("key", "route").alias("key"), "node", "tag").distinct()
    of_level = F.count("*").over(Window.partitionBy("node", "tag"))  # at most a row for each fragment of a set
    return held.withColumn("n", of_level).where(F.col("n") >= F.shiftright("tag", 8)).select("key", "node")


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; documents link at ``percent`` Jaccard or more."""
    rows = written(named(docs, n))
    nodes = written(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("tag").alias("tag"), F.count("*").alias("n_rows")))

    def resolve() -> DataFrame:
        members = written(shared(keyed(docs, n, percent)))
        sets = Candidates(docs, rows, nodes, n).parts(members.select("node").distinct())
        return resolved(members, lambda pairs: compared(pairs, sets), lambda pairs: differences(pairs, sets), percent)

    parts = scoped(docs.sparkSession, resolve)
    firsts = nodes.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    firsts = firsts.join(smallest, "component").select("node", "component_id")
    out = rows.join(firsts, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` but for all documents of a component after its first. Of rows that
    repeat an id and text one stays; rows without an id all stay, since no group can name them."""
    found = written(joined(docs, n, percent).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("first")).where("doc_id is not null"))
    # what goes is named, not what stays: most stay, and a text is only shuffled where the ids are too many to be broadcast
    gone = written(found.groupBy(F.col("doc_id").alias("of")).agg(F.max("first").alias("first")).where("not first").select("of"))
    most = BROADCAST_KEYS if gone.schema["of"].dataType.simpleString() == "bigint" else BROADCAST_ROWS
    rows = wrapped(docs, "doc_id", "text")
    left = rows.join(small(gone, gone.count(), most), F.col("doc_id") == F.col("of"), "left_anti")
    if repeats(found.where("first")):
        left = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(left.where("doc_id is null"))
    return unwrapped(left)


def repeats(rows: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i+3], ' ') end g
  from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) b from r group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) component_id
from documents d left join n using (doc_id) left join m on m.a = d.doc_id
"""
