"""Documents whose word shingles have a Jaccard similarity of a threshold or more, and the groups they form.

The method is T-occurrence search over inverted lists: a document that links with a set
of n shingles shares at least T = ceil(threshold * n) of them. Lists of rare shingles
are merged, long ones only probed (DivideSkip). On a cluster:

1. Every text becomes its set of hashed shingles; equal sets are one node from then on.
2. Whatever order all sets keep to, two linked sets share at least l of the first n - T + l
   shingles of each, for any l. The order puts shingles that looked common in some block
   of texts last. Any order gives the same result; this one keeps lists short. Here l is a
   seventh of n.
3. Prefix shingles of two or more nodes are the lists. A node with fewer than l of them (of the
   smallest partner that it may have) is alone: a passage that many texts share is not enough, unless
   it is about a quarter of a text.
4. Nodes are dealt to chunks by their longest list, near copies to the same one, and search their own chunk and
   the next of its kind. That joins nearly all of a group at a cost linear in its size.
5. Lists whose nodes are still in several groups: a node searches the chunks in which at least l of
   its lists have nodes of larger groups. After this no linked pair is left unsearched,
   unless both were in one group already.

Links are only needed as far as they join groups, so copies are never expanded to pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import discard, stored
from .words import Words, word_blocks

SHINGLE = 5  # words
PERCENT = 80  # of the union that the intersection must have
LISTS = 7  # the share of a set that must be in lists with a partner is one in so many
COMMON_IN_BLOCK = 3  # texts of one block in which a shingle looks common
COMMON_KEPT = 1 << 17  # common shingles that are sent to all tasks, the most common first; only the order depends on it
BITS = 1 << 26  # bits of the table of shingles that have lists
CHUNK_NODES, CHUNK_SHINGLES = 512, 800_000  # of a chunk, about
SEARCHES = 2048  # nodes that search a copy of a chunk
PROBE = 0.01  # weight of a probe in the choice of the lists that are only probed


# ------------------------------------------------------------------ sets


def needed(n: int) -> int:
    """Least overlap of a set of n shingles with any set that it links with."""
    return -(-PERCENT * n // 100)


def least_lists(n: int) -> int:
    """Lists that a set of n shingles has in common with a linked set that is not smaller."""
    return max(1, n // LISTS)


def linked(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= PERCENT * (n + m - shared)


def block_sets(words: Words, rows: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block; a shorter text is one shingle as a whole."""
    value, at = words.windows(SHINGLE)
    cuts = np.searchsorted(words.doc[at], np.arange(rows + 1))
    sizes = np.diff(words.first)
    for k in range(rows):
        n = int(sizes[k])
        if n >= SHINGLE:
            yield np.unique(value[cuts[k] : cuts[k + 1]])
        else:
            yield words.runs(words.first[k : k + 1], n) if n else np.zeros(0, dtype=np.uint64)


def _key(values: np.ndarray) -> int:
    """A 64-bit name of a set; used together with the set's size."""
    import xxhash

    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def shingle_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``set_key`` and ``n_shingles`` of each text; null key and 0 for texts without words."""

    @F.arrow_udf("struct<set_key:long,n_shingles:long>")
    def run(texts: pa.Array) -> pa.Array:
        keys, sizes = [], []
        for row, end, words in word_blocks(texts, lower=True):
            for values in block_sets(words, end - row):
                keys.append(_key(values) if len(values) else None)
                sizes.append(len(values))
        arrays = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())]
        return pa.StructArray.from_arrays(arrays, names=["set_key", "n_shingles"])

    return docs.withColumn("_set", run(F.col(text).cast("string"))).select(
        *[c for c in docs.columns if c not in ("set_key", "n_shingles")], "_set.set_key", "_set.n_shingles"
    )


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that stand in several texts of one block, the most common ones, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in word_blocks(batch.column(0), lower=True):
                sets = {v.tobytes(): v for v in block_sets(words, end - row) if len(v)}  # copies count once
                if not sets:
                    continue
                value, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                many = n >= COMMON_IN_BLOCK
                if many.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value[many].view(np.int64)), pa.array(n[many])], names=["shingle", "n"]
                    )

    found = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).select("shingle").toArrow()
    return np.sort(rows["shingle"].to_numpy().view(np.uint64))


def _prefix(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - T + l shingles of a set: rare ones by hash, then common ones by hash."""
    size = len(values) - needed(len(values)) + least_lists(len(values))
    if len(common):
        late = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
        rare = values[~late]
        if len(rare) < size:
            return np.concatenate([rare, values[late][: size - len(rare)]])
        return rare[:size]
    return values[:size]


def lists_of(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """Prefix shingles that two or more different sets have."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in word_blocks(batch.column(0), lower=True):
                sets = {v.tobytes(): v for v in block_sets(words, end - row) if len(v)}
                if sets:
                    parts = [_prefix(v, shared.value) for v in sets.values()]
                    names = np.array([_key(v) for v in sets.values()]).astype(np.int32)  # enough to see that two differ
                    keys = np.repeat(names, [len(p) for p in parts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(parts).view(np.int64)), pa.array(keys)], names=["shingle", "name"]
                    )

    rows = texts.mapInArrow(emit, "shingle long, name int")
    ends = rows.groupBy("shingle").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return ends.filter("a <> b").select("shingle")


def _bit_table(shingles: DataFrame) -> np.ndarray:
    """A table of bits, at most ``BITS``, that are set for the shingles; others may meet a set bit by chance."""
    bit = F.pmod("shingle", F.lit(BITS)) + 1  # bitmap positions count from 1
    parts = shingles.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    table = np.zeros(BITS // 8, dtype=np.uint8)
    for k, bits in parts.toLocalIterator():
        start = (k - 1) * len(bits)
        table[start : start + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return table


def nodes_with_lists(texts: DataFrame, common: np.ndarray, lists: DataFrame) -> DataFrame:
    """Sets with enough lists: ``set_key, n, prefix`` (shingles with lists), ``shingles`` (binary).

    A few may have fewer lists than that, as table bits meet by chance; copies in other tasks give rows of their own.
    """
    shared = texts.sparkSession.sparkContext.broadcast((common, _bit_table(lists)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, table = shared.value
        for batch in batches:
            for row, end, words in word_blocks(batch.column(0), lower=True):
                seen, out = set(), []
                for values in block_sets(words, end - row):
                    if not len(values):
                        continue
                    prefix = _prefix(values, common)
                    bit = (prefix.view(np.int64) % BITS).astype(np.int64)
                    prefix = prefix[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    key = _key(values)
                    if len(prefix) >= least_lists(needed(len(values))) and key not in seen:
                        seen.add(key)
                        out.append({"set_key": key, "n": len(values), "prefix": prefix.view(np.int64).tolist(), "shingles": values.tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _NODE)

    return texts.mapInArrow(emit, "set_key long, n long, prefix array<long>, shingles binary")


_NODE = pa.schema(
    [("set_key", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary())]
)


# ------------------------------------------------------------------ search in a chunk


class Chunk:
    """Inverted lists of a chunk's sets, and the search over them."""

    def __init__(self, keys: list[int], groups: list[int], sets: list[np.ndarray]):
        self.keys, self.sets = keys, sets
        self.sizes = np.array([len(s) for s in sets])
        self.parent = {g: g for g in groups}
        self.groups = groups
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self._value, self._owner = every[order], owner[order]

    def root(self, group: int) -> int:
        parent = self.parent.setdefault(group, group)
        while parent != group:
            self.parent[group] = group = self.parent[parent]
            parent = self.parent.setdefault(group, group)
        return group

    def search(self, values: np.ndarray, group: int, all_links: bool = False) -> list[int]:
        """Sets of the chunk that link with ``values``; those already in one group with it only on request."""
        n = len(values)
        alive = (100 * np.minimum(self.sizes, n) >= PERCENT * np.maximum(self.sizes, n))
        if not all_links:
            own = self.root(group)
            alive &= np.fromiter((self.root(g) != own for g in self.groups), dtype=bool, count=len(self.groups))
        if not alive.any():
            return []
        first = np.searchsorted(self._value, values, "left")
        last = np.searchsorted(self._value, values, "right")
        lists = [self._owner[a:b] for a, b in zip(first.tolist(), last.tolist()) if b > a]
        return [d for d, shared in divide_skip(lists, needed(n), alive) if linked(shared, n, int(self.sizes[d]))]

    def join(self, key: int, group: int, values: np.ndarray) -> list[tuple[int, int]]:
        """Search, and join the groups that are found to be linked; the links that joined them."""
        links = []
        for d in self.search(values, group):
            a, b = self.root(group), self.root(self.groups[d])
            if a != b:
                self.parent[a] = b
                links.append((key, self.keys[d]))
        return links


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs]), pa.array([x[1] for x in pairs])], names=["a", "b"])


def divide_skip(lists: list[np.ndarray], least: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Members of at least ``least`` of the sorted lists, and of how many; with ``wanted``, only members that it marks.

    The longest lists are set aside; members of enough of the short ones are found by a merge with a heap, and
    looked up in each long list by binary search, all that can still reach ``least`` at once.
    """
    if len(lists) < least:
        return
    lists = sorted(map(np.asarray, lists), key=len)
    aside = min(least - 1, int(least / (PROBE * np.log2(max(len(lists[-1]), 2)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = np.fromiter(heapq.merge(*[own.tolist() for s in short if len(own := s if wanted is None else s[wanted[s]])]), dtype=np.int64)
    begins = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.zeros(0, dtype=np.int64)
    members, counts = merged[begins], np.diff(np.append(begins, len(merged)))
    for k, own in enumerate(long):
        open_ones = counts + len(long) - k >= least
        members, counts = members[open_ones], counts[open_ones]
        if not len(members):
            return
        at = np.minimum(np.searchsorted(own, members), len(own) - 1)
        counts = counts + (own[at] == members)
    yield from ((d, c) for d, c in zip(members.tolist(), counts.tolist()) if c >= least)


def search_chunks(rows: DataFrame, inside: bool) -> DataFrame:
    """Links between groups: ``rows`` has chunk, role (0: indexed, 1: searches), set_key, part (group), shingles.

    A chunk's rows come together and in order of their roles; the indexed ones are held, the searches pass by. With
    ``inside`` the indexed ones search as well. Returned are enough links to join all groups that a link of the
    chunk joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, chunk = None, [], None

        def indexed() -> Chunk:
            return Chunk([h[0] for h in held], [h[1] for h in held], [h[2] for h in held])

        def among() -> list[tuple[int, int]]:
            return [link for key, part, values in held for link in chunk.join(key, part, values)] if inside else []

        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = [batch[c].to_pylist() for c in ("chunk", "role", "set_key", "part")]
            for k, (at, role, key, part) in enumerate(zip(*columns)):
                if at != name:
                    if chunk is None and len(held) > 1 and inside:
                        chunk = indexed()
                        links += among()
                    name, held, chunk = at, [], None
                values = np.frombuffer(batch["shingles"][k].as_py(), dtype=np.uint64)
                if role == 0:
                    held.append((key, part, values))
                    continue
                if chunk is None:
                    if not held:
                        continue
                    chunk = indexed()
                    links += among()
                links += chunk.join(key, part, values)
            if links:
                yield _links(links)
        if chunk is None and len(held) > 1 and inside:
            chunk = indexed()
            if links := among():
                yield _links(links)

    return rows.repartition("chunk").sortWithinPartitions("chunk", "role").mapInArrow(run, "a long, b long")


# ------------------------------------------------------------------ the join


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, the smallest id reachable over links.

    Words are runs of characters other than blanks and tab to carriage return, A to Z lower-cased. A text's
    set is that of its distinct five-word shingles; a shorter text is one shingle, and one without words or a null
    has an empty set, links with nothing and has its own id. Two texts link when 100 * shared >= 80 * union. Rows
    with equal sets are one group. Null ids are no ids: a group without any other has a null component. Repeated
    ids give a row each. Other columns are not returned. Sets are compared by 64-bit hashes.
    """
    ids = F.col(doc_id).alias("doc_id")
    keyed = stored(shingle_counts(docs.select(ids, F.col(text).alias("_text")), "_text").drop("_text"), "keyed")
    return with_groups(keyed, set_groups(docs, text), "doc_id")


def _least_lists(n: Column) -> Column:
    """Lists that a set of n shingles shares with any that it links with: those of its smallest partner."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * F.lit(PERCENT) / 100) / LISTS))


def _members(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """``set_key, n, shingle, size`` of the lists (size: nodes), without nodes that have too few and without lists of one node."""
    every = nodes.select("set_key", "n", F.explode("prefix").alias("shingle")).join(lists, "shingle")
    enough = every.groupBy("set_key", "n").agg(F.count("*").alias("m")).filter(F.col("m") >= _least_lists(F.col("n")))
    kept = every.join(enough.select("set_key"), "set_key")
    several = kept.groupBy("shingle").agg(F.count_distinct("set_key").alias("size")).filter("size > 1")
    return kept.join(several, "shingle").select("set_key", "n", "shingle", "size")


def set_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``id, component`` of the sets that have lists; any other set is a group of its own."""
    texts = docs.select(F.col(text).cast("string"))
    common = common_shingles(texts)
    lists = stored(lists_of(texts, common), "lists")
    found = nodes_with_lists(texts, common, lists)
    first = found.groupBy("set_key", "n").agg(F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles"))
    nodes = stored(first, "nodes")
    member = stored(_members(nodes, lists), "members")
    discard(lists)

    # Chunks: nodes with the same longest list, split by hash where they are many. So the nodes of a long list, which
    # have many others to search, lie in few chunks.
    home = member.groupBy("set_key", "n").agg(F.max_by("shingle", F.struct("size", "shingle")).alias("kind"))
    placed = stored(_placed(home), "chunks")

    sets = nodes.select("set_key", "n", "shingles")
    links = stored(_meet(sets, placed), "links")
    part = stored(components(placed.select(F.col("set_key").alias("id")), links), "parts")

    # Lists whose nodes are in several groups.
    at = member.join(part.select(F.col("id").alias("set_key"), "component"), "set_key")
    open_lists = stored(_several(at), "open")
    discard(member)
    routes = stored(_routes(open_lists, placed), "routes")
    discard(open_lists)
    group = part.select(F.col("id").alias("set_key"), F.col("component").alias("part"))
    more = stored(_search_routes(routes, nodes.select("set_key", "shingles"), placed, group), "links")
    groups = stored(components(placed.select(F.col("set_key").alias("id")), links.unionByName(more)), "groups")
    discard(nodes, part, routes, links, more, placed)
    return groups


def _chunk(shift: int = 0) -> Column:
    """The chunk of a placed node, or the one so many further on of its kind."""
    return F.xxhash64("kind", F.pmod(F.col("part_no") + shift, F.col("of")))


def _meet(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Links that nodes find in their own chunk and in the following one of its kind.

    ``placed``: set_key, kind, of, part_no and, where nodes are in groups already, part.
    """
    own = F.col("part") if "part" in placed.columns else F.col("set_key")
    rows = sets.join(placed.drop("n"), "set_key")

    def role(number: int, shift: int) -> list[Column]:
        return [_chunk(shift).alias("chunk"), F.lit(number).alias("role"), F.col("set_key"), own.alias("part"), F.col("shingles")]

    following = rows.filter("of > 1").select(*role(1, 1))
    return search_chunks(rows.select(*role(0, 0)).unionByName(following), inside=True)


def _placed(home: DataFrame) -> DataFrame:
    """Nodes (set_key, n, kind) with their number among the chunks of their kind, which split it by hash where it is large."""
    kinds = home.groupBy("kind").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    split = F.greatest(F.ceil(F.col("m") / CHUNK_NODES), F.ceil(F.col("s") / CHUNK_SHINGLES))
    return home.join(kinds.select("kind", split.alias("of")), "kind").withColumn(
        "part_no", F.pmod(F.xxhash64("set_key"), F.col("of"))
    )


def _several(members: DataFrame) -> DataFrame:
    """Members (shingle, component) of lists that several groups have."""
    several = members.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    return members.join(several.select("shingle"), "shingle")


def _routes(open_lists: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunks in which a node still has to search: those in which enough of its open lists have a node of a larger group.

    Of any two linked nodes in different groups, that of the smaller one finds the other so: all lists that
    they share are open, and they share enough.
    """
    sizes = open_lists.select("set_key", "component").distinct().groupBy("component").agg(F.count("*").alias("m"))
    at = open_lists.join(sizes, "component").withColumn("rank", F.struct("m", "component"))
    met = {"chunk": 0, "following": 1, "leading": -1}  # chunks that a node has met in the first search
    at = at.join(placed.select("set_key", *[_chunk(k).alias(name) for name, k in met.items()]), "set_key")
    targets = at.groupBy("shingle", "chunk").agg(F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"))
    return (
        at.select("shingle", "set_key", "n", "component", "rank", *[F.col(c).alias(f"_{c}") for c in met]).join(targets, "shingle")
        .filter(F.col("rank") < F.col("top"))
        .filter(" and ".join(f"chunk <> _{c}" for c in met))
        .filter(f"100 * low <= {10000 // PERCENT} * n and 100 * n <= {10000 // PERCENT} * high")
        .groupBy("set_key", "n", "component", "chunk").agg(F.count("*").alias("shared"))
        .filter(F.col("shared") >= _least_lists(F.col("n")))
        .select("set_key", "component", "chunk")
    )


def _search_routes(routes: DataFrame, sets: DataFrame, placed: DataFrame, group: DataFrame) -> DataFrame:
    """Links that the routed nodes find; a chunk that many search is copied to several tasks, which share the searches.

    ``group``: set_key and part, the group as far as it is known; nodes of one part are not compared again.
    """
    wanted = routes.groupBy("chunk").agg(F.ceil(F.count("*") / SEARCHES).alias("copies"))
    salted = F.xxhash64("chunk", "salt").alias("chunk")
    indexed = (
        placed.select("set_key", _chunk().alias("chunk")).join(wanted, "chunk")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .join(sets, "set_key").join(group, "set_key")
        .select(salted, F.lit(0).alias("role"), "set_key", "part", "shingles")
    )
    searching = (
        routes.join(wanted, "chunk").withColumn("salt", F.pmod(F.xxhash64("set_key"), F.col("copies"))).join(sets, "set_key")
        .select(salted, F.lit(1).alias("role"), "set_key", F.col("component").alias("part"), "shingles")
    )
    return search_chunks(indexed.unionByName(searching), inside=False)


def with_groups(keyed: DataFrame, groups: DataFrame, doc_id: str) -> DataFrame:
    """Give each row (with set_key) the smallest id of its group; rows without a set their own."""
    named = keyed.join(groups.withColumnRenamed("id", "set_key"), "set_key", "left")
    named = named.withColumn("_group", F.coalesce("component", "set_key"))
    smallest = named.filter("_group is not null").groupBy("_group").agg(F.min(doc_id).alias("_least"))
    least = F.when(F.col("_group").isNull(), F.col(doc_id)).otherwise(F.col("_least"))
    kept = [c for c in keyed.columns if c != "set_key"]
    return named.join(smallest, "_group", "left").select(*kept, least.alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, nulls last.

    Ties go to the row with the smallest hash of all columns; of wholly equal rows one stays. Rows whose
    text has no words are no copies of anything and all stay. Only ids and hashes of the rows that go are joined to
    the documents, so texts move once.
    """
    # The row travels as one struct, so that no column of it can have the name of a column made here.
    marked = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("_id"), F.xxhash64(F.struct("*")).alias("_row"))
    keyed = shingle_counts(marked.select("_id", "_row", F.col(f"row.`{text}`").alias("_text")), "_text")
    keyed = stored(keyed.filter("set_key is not null").select("_id", "_row", "set_key"), "keyed")
    groups = set_groups(docs, text).withColumnRenamed("id", "set_key")
    named = keyed.join(groups, "set_key", "left").withColumn("_group", F.coalesce("component", "set_key"))
    rows = named.groupBy("_group", "_id", "_row").agg(F.count("*").alias("_copies"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    rows = stored(rows.withColumn("_order", order), "rows")
    first = rows.groupBy("_group").agg(F.min("_order").alias("_first"))
    judged = rows.join(first, "_group").withColumn("_goes", ~F.col("_order").eqNullSafe(F.col("_first")))

    def same(left: DataFrame, right: DataFrame):
        return left["_id"].eqNullSafe(right["_gone_id"]) & (left["_row"] == right["_gone_row"])

    gone = judged.filter("_goes").select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"))
    left = marked.join(gone, same(marked, gone), "left_anti")
    repeated = judged.filter("not _goes and _copies > 1")
    if not repeated.isEmpty():
        again = repeated.select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"))
        single = left.join(again, same(left, again), "left_anti")
        left = single.unionByName(left.join(again, same(left, again), "left_semi").dropDuplicates(["_id", "_row"]))
    return left.select("row.*")
