"""N-gram Jaccard join by a count-vector R-tree, as connected components.

Documents are sets of word shingles. Documents with equal sets form a class; only one of each class is compared.

* A prefix of each set, in one fixed order of all shingles, must share a shingle with that of any similar set. The
  order puts shingles that are common in a bounded sample last; it decides the work, never the result.
* Each set is a point: its shingles' counts in 64 to 1,024 hash groups, about a dozen shingles a group; points of
  neighbouring resolutions compare after adding up pairs of groups. The sum of coordinate minima bounds the overlap of
  two sets; of a set and an R-tree node, with the node's largest coordinates. A pair counts at the first shingle its
  prefixes share, so the places of that shingle bound the overlap too. Pairs the bounds leave are verified by exact
  intersection of the whole sets.
* First each class meets a few hubs: the classes most of whose prefix other classes share, as a text does that others
  were copied from. Where all classes of a shingle are then connected, no further pair of them can change a component.
  The other shingles' classes are joined by R-trees over their points, component by component, and what survives is
  verified: no link between different components is lost.

Large groups are split into cells of bounded size that meet pairwise; a verified class's partners are spread over
cells; nothing is gathered in one task by key. Sets of no shingles link with nothing. Null ids take part; a component
is named by its smallest id that isn't null. Rows with the same id are told apart by their text; repeated rows give
repeated rows; extra columns are left out (`keep_one` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Words, _mix, components, drop, own, pieces, save, signed, text_of, tune, windows

LEAF, FAN, CELL, SPREAD, HUBS = 32, 8, 2048, 256, 3
FULL = np.iinfo(np.uint16).max
#: Sets of so many shingles and more have 64, 128, ... 1,024 groups.
RESOLUTION = np.array([0, 768, 1536, 3072, 6144])


def level_of(n) -> np.ndarray:
    return np.searchsorted(RESOLUTION, n, side="right") - 1


def fold(points: np.ndarray) -> np.ndarray:
    """Half as many groups; a count that is cut off stays so."""
    return np.minimum(points.reshape(len(points), -1, 2).sum(axis=2, dtype=np.int64), FULL).astype(np.uint16)


def needed(na, nb, num: int, den: int):
    """The least overlap of sets of these sizes."""
    return -(-num * (na + nb) // (num + den))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document), distinct and in order of document and hash."""
    words = Words(data, offs, lower=True)
    doc = words.doc()
    n = len(doc)
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :]) if n >= k else np.empty(0, np.int64)
    shingle, owner = windows(words.hash, k)[at] if n >= k else np.empty(0, np.uint64), doc[at]
    sizes = np.diff(words.first)
    for length in range(1, k):  # the whole sequence of fewer words is one shingle
        short = np.flatnonzero(sizes == length)
        if len(short):
            shingle = np.append(shingle, windows(words.hash, length)[words.first[short]] ^ np.uint64(length))
            owner = np.append(owner, short)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new]


def _common(docs: DataFrame, k: int, sample_docs: int, most: int = 1 << 16) -> np.ndarray:
    """Shingles in three or more documents of the sample, rarest first: at most `most`."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in pieces(batch):
                u, n = np.unique(shingle_sets(data, offs, k)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], names=["h", "n"])

    got = sample.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(most).toPandas()
    return got["h"].to_numpy(np.int64).view(np.uint64)[::-1]


def _sums(shingle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of the hashes of each document's set."""
    out = []
    for h in (shingle, _mix(shingle ^ np.uint64(0x9E3779B97F4A7C15))):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def _points(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """doc_id, text_key, n, s1, s2, vec, prefix of every row."""
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for rows, data, offs in pieces(batch):
                shingle, owner = shingle_sets(data, offs, k)
                m = rows.num_rows
                first = np.searchsorted(owner, np.arange(m + 1))
                n = np.diff(first)
                s1, s2 = _sums(shingle, first)
                vec: list[bytes] = [b""] * m
                level = level_of(n)
                for x in np.unique(level).tolist():
                    rows_at, groups = np.flatnonzero(level == x), 64 << x
                    place = np.full(m, -1)
                    place[rows_at] = np.arange(len(rows_at))
                    mine = place[owner] >= 0
                    cell = np.bincount(place[owner[mine]] * groups + (shingle[mine] >> np.uint64(58 - x)).astype(np.int64), minlength=len(rows_at) * groups)
                    counts = np.minimum(cell, FULL).astype(np.uint16).reshape(-1, groups)
                    for i, v in zip(rows_at.tolist(), counts, strict=True):
                        vec[i] = v.tobytes()
                late = np.zeros(len(shingle), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
                    late = np.where(known[at] == shingle, rank[at], 0)
                by = np.lexsort((shingle, late, owner))
                size = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
                head = np.arange(len(by)) - np.repeat(first[:-1], n) < np.repeat(size, n)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column("text_key"), pa.array(n, pa.int64()), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(vec, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(shingle[by][head])))],
                    names=["doc_id", "text_key", "n", "s1", "s2", "vec", "prefix"],
                )

    keyed = docs.select("doc_id", "text", F.xxhash64(text_of("text")).alias("text_key"))
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n bigint, s1 bigint, s2 bigint, vec binary, prefix array<bigint>")


def _bounded(a: np.ndarray, b: np.ndarray, na, nb, num: int, den: int) -> np.ndarray:
    """Whether the sizes and the sum of coordinate minima leave a similarity of num/den open."""
    most = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    full = (np.maximum(a, b) == FULL).any(axis=-1)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (full | ((num + den) * most >= num * (na + nb)))


def _pairs_bounded(va: list[bytes], vb: list[bytes], na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of points the bound leaves; pairs of the same resolutions are compared together."""
    la, lb = level_of(na), level_of(nb)
    out = np.zeros(len(na), bool)
    for x, y in np.unique(np.stack([la, lb]), axis=1).T.tolist():
        some = np.flatnonzero((la == x) & (lb == y))
        for part in np.array_split(some, -(-len(some) // 2048)):
            a, b = (np.frombuffer(b"".join(v[i] for i in part), np.uint16).reshape(len(part), -1) for v in (va, vb))
            while a.shape[1] > b.shape[1]:
                a = fold(a)
            while b.shape[1] > a.shape[1]:
                b = fold(b)
            out[part] = _bounded(a, b, na[part], nb[part], num, den)
    return out


def _filter_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that the bound leaves."""
    point = classes.select("cid", "n", "vec")
    both = pairs.join(point.toDF("a", "na", "va"), "a").join(point.toDF("b", "nb", "vb"), "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _pairs_bounded(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a bigint, b bigint")


class RTree:
    """Points packed, in the order given, into leaves, and these into nodes, up to a root: each with its points' largest
    coordinates and least and largest sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray) -> None:
        self.points, self.n = points, n
        self.levels, most, low, high, fan = [], points, n, n, LEAF
        while not self.levels or len(low) > FAN:
            cuts = np.arange(0, len(low), fan)
            most, low, high = np.maximum.reduceat(most, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((most, low, high))
            fan = FAN

    def search(self, point: np.ndarray, n: int, since: int, num: int, den: int) -> np.ndarray:
        """Points from `since` on that the bound leaves for this one."""
        at = np.arange(len(self.levels[-1][1]))
        for height in range(len(self.levels) - 1, -1, -1):
            most, low, high = (x[at] for x in self.levels[height])
            reach = np.minimum(most, point).sum(axis=1, dtype=np.int64)
            full = (np.maximum(most, point) == FULL).any(axis=1)
            # For the node's sizes low..high: some size may fit, and the least overlap any of them needs is within reach.
            fits = (den * high >= num * n) & (den * n >= num * low) & (full | ((num + den) * reach >= num * (n + np.maximum(low, (num * n) // den))))
            fan, below = (FAN, len(self.levels[height - 1][1])) if height else (LEAF, len(self.n))
            at = (at[fits][:, None] * fan + np.arange(fan)).ravel()
            at = at[at < below]
            at = at[(at + 1) * self._span(height - 1) > since] if height else at[at >= since]
        return at[_bounded(self.points[at], point, self.n[at], n, num, den)]

    @staticmethod
    def _span(height: int) -> int:
        """Points below a node."""
        return LEAF * FAN**height


def _cell_pairs(cid: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, vec: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels in a cell that all bounds leave. Rows come by label."""
    level, a, b = level_of(n), [], []
    for x in np.unique(level).tolist():
        # Against sets of this resolution, and of the next one after adding up its pairs of groups.
        here, finer = np.flatnonzero(level == x), np.flatnonzero(level == x + 1)
        points = np.frombuffer(b"".join(vec[i] for i in here), np.uint16).reshape(len(here), -1)
        both = [points]
        if len(finer):
            both.append(fold(np.frombuffer(b"".join(vec[i] for i in finer), np.uint16).reshape(len(finer), -1)))
        for others, q in zip((here, finer), both, strict=False):
            tree = RTree(q, n[others])
            after = np.searchsorted(label[others], label[here], side="right") if others is here else np.zeros(len(here), np.int64)
            for k, i in enumerate(here.tolist()):
                if after[k] < len(others):
                    hit = others[tree.search(points[k], int(n[i]), int(after[k]), num, den)]
                    most = np.minimum(n[i] - pos[i], n[hit] - pos[hit])  # with the shared shingle as the first
                    hit = hit[(most >= needed(n[i], n[hit], num, den)) & (label[hit] != label[i])]
                    a.append(np.full(len(hit), cid[i]))
                    b.append(cid[hit])
    a, b = np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])
    return np.minimum(a, b), np.maximum(a, b)


def _join_cells(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: h, i, j, cid, n, pos, label, vec, ordered within partitions by (h, i, j, label, n) -> (a, b) of different labels."""
    names = ("cid", "n", "pos", "label", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in names]
        found: set[tuple[int, int]] = set()  # pairs that other shingles of this task have given

        def flush() -> None:
            label = held[3]
            if len(label) > 1 and label[0] != label[-1]:
                a, b = _cell_pairs(*(np.array(x) for x in held[:4]), held[4], num, den)
                found.update(zip(a.tolist(), b.tolist(), strict=True))

        def give() -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            h, i, j = (batch.column(c).to_numpy() for c in ("h", "i", "j"))
            columns = [batch.column(c).to_pylist() for c in names]
            cut = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(h)], strict=True):
                if s == e:
                    continue
                if key != (h[s], i[s], j[s]):
                    flush()
                    key, held = (h[s], i[s], j[s]), [[] for _ in names]
                for column, values in zip(held, columns, strict=True):
                    column.extend(values[s:e])
            if len(found) > 100_000:
                yield give()
        flush()
        if found:
            yield give()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, items) of the wanted classes: their whole sets, from one text of each. A Bloom filter spares most texts."""
    wanted = wanted.join(classes.select("cid", "n", "s1", "s2", "rep"), "cid")
    ids = wanted.select(F.xxhash64("rep").alias("key"))
    bits = sketch.bits_for(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(sketch.build(ids, "key", bits) if bits else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(shared.value.has(batch.column("key").to_numpy().view(np.uint64))))
            for rows, data, offs in pieces(batch):
                shingle, owner = shingle_sets(data, offs, k)
                first = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                s1, s2 = _sums(shingle, first)
                items = [shingle[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(items, pa.binary())], names=["rep", "n", "s1", "s2", "items"])

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    sets = texts.mapInArrow(run, f"rep {docs.schema['doc_id'].dataType.simpleString()}, n bigint, s1 bigint, s2 bigint, items binary")
    return sets.join(wanted.withColumnRenamed("rep", "r"), ["n", "s1", "s2"]).where(F.col("rep").eqNullSafe(F.col("r"))).select("cid", "items").dropDuplicates(["cid"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) of the pairs whose whole sets are similar enough."""
    sets = save(_whole_sets(docs, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), k), "jaccard-sets")
    count = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    cells = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / SPREAD)).alias("cell"))
    left = cells.select("a", "cell").distinct().join(sets.withColumnRenamed("cid", "a"), "a").select("a", "cell", F.lit(None).cast("long").alias("b"), "items")
    right = cells.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "cell", "b", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_set = np.empty(0, np.uint64)
        for batch in batches:
            hits = []
            for i, (b, items) in enumerate(zip(batch.column("b").to_pylist(), batch.column("items"), strict=True)):
                other = np.frombuffer(items.as_buffer(), np.uint64)
                if b is None:
                    own_set = other
                    continue
                at = np.searchsorted(own_set, other)
                both = int((own_set[np.minimum(at, len(own_set) - 1)] == other).sum())
                if den * both >= num * (len(own_set) + len(other) - both):
                    hits.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

    return save(left.union(right).repartition("a", "cell").sortWithinPartitions("a", "cell", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint"), "jaccard-links")


def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, text_key (a hash of the text) for every row; links are similarities of num/den or more."""
    tune(docs.sparkSession)
    docs = own(docs, doc_id=id_col, text=text_col)
    points = save(_points(docs, k, num, den, _common(docs, k, sample_docs)), "jaccard-points")
    key = ["n", "s1", "s2"]
    classes = points.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("vec").alias("vec"), F.first("prefix").alias("prefix"))
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    heads = classes.select("cid", F.posexplode("prefix").alias("pos", "h"))
    shared = heads.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    groups = save(heads.join(shared, "h"), "jaccard-groups")

    # The hub of a shingle: the class with the largest share of its prefix in common with others.
    common = groups.groupBy("cid").agg(F.count("*").alias("c")).join(classes.select("cid", F.size("prefix").alias("p")), "cid").select("cid", (F.col("c") / F.col("p")).alias("share"))
    hubs = groups.select("h", "cid").join(common, "cid").groupBy("h").agg(F.max_by("cid", F.struct("share", -F.col("cid"))).alias("hub"))
    met = groups.select("h", "cid").join(hubs, "h").where("cid <> hub").groupBy("cid", "hub").agg(F.count("*").alias("c"))
    met = met.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "hub"))), 1, HUBS).alias("hubs")).select("cid", F.explode("hubs.hub").alias("hub"))
    first = save(_filter_pairs(met.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct(), classes, num, den), "jaccard-pairs")
    links = _verify(first, docs, classes, k, num, den)

    label = components(links, "jaccard").withColumnRenamed("id", "cid")
    marked = groups.join(label, "cid", "left").select("h", "m", "cid", "pos", F.coalesce("component", "cid").alias("label"))
    open_groups = marked.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    rest = marked.join(open_groups, "h").join(classes.select("cid", "n", "vec"), "cid")
    # A large group is cut into parts that meet pairwise: (i, j) with i <= j.
    parts = F.ceil(F.col("m") / CELL)
    part = F.pmod(F.xxhash64("cid"), parts)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    cells = rest.withColumn("part", part).select("h", F.explode(meets).alias("c"), "cid", "n", "pos", "label", "vec").select("h", "c.i", "c.j", "cid", "n", "pos", "label", "vec")
    second = _join_cells(cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "label", "n"), num, den).distinct()
    second = save(second.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    links = links.union(_verify(second, docs, classes, k, num, den)) if second.limit(1).count() else links

    label = components(links, "jaccard").withColumnRenamed("id", "cid")
    whole = classes.select(*key, "rep", "class_size", "cid").join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "component").select(*key, "component_id", "class_size")
    out = points.select("doc_id", "text_key", *key).join(named, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_key")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one with the smallest id.

    Rows without shingles, and rows with a null id, stay. Of rows with that id and one text, one stays; rows with that id
    and other texts are kept, each by its own group.
    """
    found = save(similar_components(docs, k, num, den, id_col, text_col, **bounds), "jaccard-components")
    rows = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "text_key").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("__gone"), (F.count("*") > 1).alias("__twice"))
    flags = save(rows.where("__gone or __twice").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}), "jaccard-flags")
    drop(found)
    same = (F.col(f"`{id_col}`") == F.col("__id")) & (F.xxhash64(text_of(F.col(f"`{text_col}`"))) == F.col("__key"))
    if not flags.where("__twice and not __gone").limit(1).count():
        return docs.join(flags.select("__id", "__key"), same, "left_anti")
    marked = docs.join(flags, same, "left").where(~F.coalesce("__gone", F.lit(False)))
    twice, columns = F.coalesce("__twice", F.lit(False)), [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~twice).select(*columns).unionByName(marked.where(twice).select(*columns).dropDuplicates([id_col, text_col]))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
f AS (SELECT doc_id, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS m FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a WHERE r.m < l.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
