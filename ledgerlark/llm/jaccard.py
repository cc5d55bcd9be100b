"""N-gram Jaccard join with several global orders.

Documents are sets of distinct ``NGRAM``-word shingles; two link if their Jaccard
similarity is at least ``SIMILARITY`` percent. Equal sets are one class and need no link.
A similar pair shares a token in the prefix of either set under any order of all tokens,
so candidates must share one under each of several orders.

1. Sieve, order of token hashes. A pair shares at least ``l`` tokens of its prefixes if
   they are ``l`` tokens longer. Only prefixes are shuffled, three eighths of the
   tokens; sets too few of whose prefix tokens are in another set can have no partner.
2. Whole sets of what is left. Tokens are ordered by document frequency among them with
   two different ways to break ties, and by hash after those of frequency one. Sets
   whose prefix has only tokens of frequency one have no partner.
3. Sets that share prefix tokens of the first order form clusters. In a cluster, or in
   pairs of its blocks if it is large, pairs sharing prefix tokens under all orders are
   verified by exact counts, except those already connected; only links leave a task.

Skew: tokens that several classes of one batch share are folded before the shuffle, so a
token of any frequency costs a row per batch. Later joins are Spark's own, which adaptive
execution can split. Blocks hold about ``BLOCK`` shingles and ``BLOCK_ROWS`` rows; in a
cluster of several blocks every set is first compared with a hub, and blocks of one
component are not compared. Where ``link_counts`` asks for all links, they are.

Sets are compared by 64-bit hashes of shingles. Defined cases: null and blank texts have
an empty set and link with nothing; texts of fewer words are one shingle of their length;
a null id counts as the largest; equal rows are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, free_name, keyed, small, stored
from .components import components
from .hashing import WordHasher, mixed, texts_of, windows

NGRAM = 5
SIMILARITY = 75
BLOCK = 1_500_000
# Rows that a block may have, however short, since the pairs of a task grow with their square.
BLOCK_ROWS = 10_000
# The sieve's prefixes are longer by one token in so many.
SLACK = 8
_LOW = np.uint64((1 << 48) - 1)


def shingles(text: np.ndarray, hasher: WordHasher, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's bytes."""
    words = hasher.words(text)
    size = min(ngram, len(words))
    return np.unique(windows(words, size, size)) if size else words


def _signature(own: np.ndarray) -> int:
    return int(mixed(np.array([np.add.reduce(mixed(own ^ np.uint64(0xA5A5A5A5)))]) + np.uint64(len(own)))[0])


def _least(n: np.ndarray | int, similarity: int) -> np.ndarray | int:
    """Tokens a set of ``n`` shares with any partner at least."""
    return -(-similarity * n // 100)


def signatures(rows: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``(id, th, n, node)`` of each row; equal sets have equal ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            own = [shingles(t, hasher, ngram) for t in texts_of(batch.column(2))]
            nodes = np.array([_signature(s) for s in own], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in own], pa.int64()), pa.array(nodes)], names=["id", "th", "n", "node"])

    return rows.mapInArrow(run, "id long, th long, n long, node long")


def _slack(n: np.ndarray | int) -> np.ndarray | int:
    return 1 + n // SLACK


def _prefix_tokens(rows: DataFrame, ngram: int, similarity: int) -> DataFrame:
    """``(token, node, known)``: prefixes in hash order. A token that classes of the batch
    share is sent once, with ``known`` -1; how many of those a class has is sent as
    ``known``, with a token of its own that settles nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            prefixes, nodes, seen = [], [], set()
            for text in texts_of(batch.column(2)):
                own = shingles(text, hasher, ngram)
                node = _signature(own)
                if len(own) and node not in seen:
                    seen.add(node)
                    n = len(own)
                    prefixes.append(own[: n - _least(n, similarity) + _slack(n)])
                    nodes.append(node)
            if not nodes:
                continue
            # The highest bits order the tokens, so the low ones are free to name them.
            token, owner = np.concatenate(prefixes) & _LOW, np.repeat(np.arange(len(nodes)), [len(p) for p in prefixes])
            _, first, group, count = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            shared = count[group] > 1
            known = np.bincount(owner[shared], minlength=len(nodes))
            node = np.array(nodes, dtype=np.uint64).view(np.int64)
            once, some = first[count > 1], np.flatnonzero(known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((token[~shared], token[once], mixed(node[some].view(np.uint64)) & _LOW)).view(np.int64)),
                    pa.array(np.concatenate((node[owner[~shared]], np.zeros(len(once), dtype=np.int64), node[some]))),
                    pa.array(np.concatenate((np.zeros(int((~shared).sum()), dtype=np.int64), np.full(len(once), -1), known[some])).astype(np.int32)),
                ],
                names=["token", "node", "known"],
            )

    return rows.mapInArrow(run, "token long, node long, known int")


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: for each node, how many of its tokens are shared."""
    rest: pa.Table | None = None

    def settle(table: pa.Table) -> pa.RecordBatch:
        token, node, known = (table.column(c).to_numpy() for c in ("token", "node", "known"))
        counted = known > 0
        t, n, several = token[~counted], node[~counted], known[~counted] < 0
        new = np.append(True, t[1:] != t[:-1])[: len(t)]
        start = np.flatnonzero(new)
        mixed_nodes = np.zeros(len(start), dtype=bool)
        if len(start):
            mixed_nodes = (np.maximum.reduceat(n, start) != np.minimum.reduceat(n, start)) | np.logical_or.reduceat(several, start)
        shared = n[mixed_nodes[np.cumsum(new) - 1] & ~several] if len(start) else n
        nodes, inverse = np.unique(np.concatenate((shared, node[counted])), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate((np.ones(len(shared)), known[counted])), minlength=len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int64)), pa.array(sums.astype(np.int64))], names=["_node", "hits"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        token = table.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if cut:
            yield settle(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield settle(rest)


def _whole_sets(rows: DataFrame, ngram: int) -> DataFrame:
    """``(node, n, shingles)`` of ``rows (id, th, text, node)`` with that signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            own = [shingles(t, hasher, ngram) for t in texts_of(batch.column(2))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in own]))).astype(np.int32)
            values = np.concatenate([*own, np.empty(0, dtype=np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            nodes = np.array([_signature(s) for s in own], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.diff(offsets).astype(np.int64)), lists], names=["node", "n", "shingles"])

    return rows.select("id", "th", "text").mapInArrow(run, "node long, n long, shingles array<long>")


def _prefixes(sets: DataFrame, similarity: int) -> DataFrame:
    """``(node, n, p1, p2, p3)``: prefix tokens of frequency two or more under three
    orders. Tokens of frequency one come first in all of them and match nothing."""
    tokens = sets.select("node", "n", F.explode("shingles").alias("token"))
    often = tokens.groupBy(F.col("token").alias("_token")).agg(F.count("*").alias("df")).where(F.col("df") > 1)
    shared = tokens.join(often, F.col("token") == F.col("_token")).groupBy("node").agg(
        F.max("n").alias("n"), F.collect_set(F.struct("df", "token")).alias("t")
    )
    least = F.ceil(F.lit(similarity) * F.col("n") / 100)
    length = (F.col("n") - least + 1 - (F.col("n") - F.size("t"))).cast("int")

    def prefix(*order: Column) -> Column:
        placed = F.array_sort(F.transform("t", lambda t: F.struct(*[o(t) for o in order], t["token"].alias("token"))))
        return F.transform(F.slice(placed, 1, F.greatest(length, F.lit(0))), lambda t: t["token"])

    return shared.select(
        "node",
        "n",
        prefix(lambda t: t["df"]).alias("p1"),
        prefix(lambda t: F.floor(F.log2(t["df"])), lambda t: F.xxhash64(t["token"])).alias("p2"),
        prefix(lambda t: F.xxhash64(t["token"], F.lit(3))).alias("p3"),
    ).where(F.size("p1") > 0)


def _is_link(overlap, a, b, similarity: int):
    return 100 * overlap >= similarity * (a + b - overlap)


class _Sets:
    """Token sets of many rows, one after another, with the rows that hold a token."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        _, self.token = np.unique(np.concatenate([*lists, np.empty(0, dtype=np.int64)]), return_inverse=True)
        count = np.bincount(self.token)
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.holders = np.repeat(np.arange(len(lists)), self.size)[np.argsort(self.token, kind="stable")]
        self.marked = np.zeros(len(count), dtype=bool)

    def own(self, row: int) -> np.ndarray:
        return self.token[self.start[row] : self.start[row] + self.size[row]]

    def later(self, token: int, row: int) -> np.ndarray:
        """Rows after ``row`` that hold the token."""
        rows = self.holders[self.begin[token] : self.end[token]]
        return rows[np.searchsorted(rows, row, "right") :]

    def shared(self, row: int, others: np.ndarray) -> np.ndarray:
        """How many tokens of ``row`` each of the ``others``, all after it, holds: from the
        holders of its tokens, or from the others' tokens where these are fewer by far."""
        own, size = self.own(row), self.size[others]
        if 50 * len(own) + (self.end[own] - self.begin[own]).sum() < 8 * size.sum():
            return np.bincount(np.concatenate([self.later(t, row) for t in own]), minlength=len(self.size))[others]
        first = np.cumsum(size) - size
        self.marked[own] = True
        held = self.marked[self.token[np.repeat(self.start[others] - first, size) + np.arange(size.sum())]]
        self.marked[own] = False
        return np.bincount(np.repeat(np.arange(len(others)), size)[held], minlength=len(others))


class _Components:
    """Rows by component; the smaller one takes the label of the larger."""

    def __init__(self, labels: np.ndarray):
        _, self.root = np.unique(labels, return_inverse=True)
        by = np.argsort(self.root, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(self.root[by])) + 1) if len(by) else []
        self.members = {int(self.root[g[0]]): g.tolist() for g in groups}

    def join(self, a: int, b: int) -> bool:
        one, other = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: len(self.members[r]))
        if one == other:
            return False
        moved = self.members.pop(one)
        self.root[moved] = other
        self.members[other].extend(moved)
        return True


def _group_sets(group: pd.DataFrame) -> tuple[pd.DataFrame, list[_Sets]]:
    group = group.drop_duplicates("node").reset_index(drop=True)
    return group, [_Sets([np.asarray(x, dtype=np.int64) for x in group[c]]) for c in ("p1", "p2", "p3", "shingles")]


def _linked_rows(sets: list[_Sets], row: int, others: np.ndarray, size: np.ndarray, similarity: int) -> np.ndarray:
    """Those of ``others``, which share a token of the first order, that link with ``row``."""
    *orders, whole = sets
    others = others[100 * np.minimum(size[others], size[row]) >= similarity * np.maximum(size[others], size[row])]
    for order in orders[1:]:
        others = others[order.shared(row, others) > 0]
    return others[_is_link(whole.shared(row, others), size[others], size[row], similarity)]


def _verified(similarity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links that connect what the rows' labels do not connect yet.

        A token whose later holders are all in one component with the row can give no link
        to any of them any more and is closed, so a group of near copies costs one pass.
        """
        group, sets = _group_sets(group)
        size, side = group["n"].to_numpy(), group["side"].to_numpy()
        known, first = _Components(group["label"].to_numpy()), sets[0]
        closed, met = np.zeros(len(first.marked), dtype=bool), np.zeros(len(group), dtype=bool)
        links = []
        for i in range(len(group)):
            open_tokens = first.own(i)[~closed[first.own(i)]]
            if not len(open_tokens):
                continue
            for token in open_tokens:
                rows = first.later(token, i)
                rows = rows[known.root[rows] != known.root[i]]
                closed[token] = not len(rows)
                met[rows] = True
            others = np.flatnonzero(met)
            met[others] = False
            others = others[(side[others] < 0) | (side[others] != side[i])]
            if len(others):
                links += [(group["node"][i], group["node"][j]) for j in _linked_rows(sets, i, others, size, similarity) if known.join(i, j)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _counted(similarity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """How many links each row has in this task."""
        group, sets = _group_sets(group)
        size, side = group["n"].to_numpy(), group["side"].to_numpy()
        count = np.zeros(len(group), dtype=np.int64)
        for i in range(len(group)):
            others = np.unique(np.concatenate([sets[0].later(t, i) for t in sets[0].own(i)]))
            found = _linked_rows(sets, i, others[(side[others] < 0) | (side[others] != side[i])], size, similarity)
            count[i] += len(found)
            count[found] += 1
        return pd.DataFrame({"node": group["node"], "links": count})

    return run


def _tasks(sets: DataFrame, similarity: int, block: int, block_rows: int, all_links: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the verifying tasks, and links found on the way. With ``all_links`` every
    candidate pair is in one task; else pairs that are connected already may be in none."""
    prefixes = stored(_prefixes(sets, similarity), "prefixes")
    postings = prefixes.select("node", F.explode("p1").alias("token"))
    hubs = postings.groupBy(F.col("token").alias("_token")).agg(F.min("node").alias("hub"))
    stars = stored(postings.join(hubs, F.col("token") == F.col("_token")).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    clusters = components(stars).withColumnRenamed("label", "cluster")
    members = prefixes.join(clusters, "node")
    weights = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / block_rows)).alias("blocks"))
    members = members.join(weights, "cluster")
    wide = stored(members.where(F.col("blocks") > 1).select("node", "cluster", "blocks"), "wide")
    rows = members.where(F.col("blocks") == 1).withColumns({"label": F.col("node"), "side": F.lit(-1), "task": F.struct("cluster", F.lit(0).alias("a"), F.lit(0).alias("b"))})
    rows = rows.select("task", "side", "label", "node")
    found = None
    if wide.limit(1).count():
        if all_links:
            placed = wide.withColumns({"label": F.col("node"), "blk": F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("blocks")))})
            more = _block_pairs(prefixes, stored(placed, "placed"), F.lit(True))
        else:
            found, more = _wide_tasks(sets, prefixes, stars, wide, similarity)
        rows = rows.unionByName(more)
    return rows.join(prefixes.select("node", "p1", "p2", "p3"), "node").join(sets, "node"), found


def _links(sets: DataFrame, similarity: int, block: int, block_rows: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what links connect."""
    rows, found = _tasks(sets, similarity, block, block_rows, all_links=False)
    links = rows.groupBy("task").applyInPandas(_verified(similarity), "a long, b long")
    return links if found is None else links.unionByName(found)


def _wide_tasks(sets: DataFrame, prefixes: DataFrame, stars: DataFrame, wide: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Links of hubs in clusters of several blocks, and their block pairs that still may
    hold links: pairs that share a token and are not wholly in one component."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"s_{s}"))
    pairs = stars.join(wide.select(F.col("node").alias("b")), "b", "left_semi").join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("s_a", "s_b"))
    found = stored(pairs.where(_is_link(overlap, F.col("n_a"), F.col("n_b"), similarity)).select("a", "b").distinct(), "hub-links")
    labels = components(found)
    placed = wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_size"))
    placed = placed.join(sizes, F.col("label") == F.col("_label"))
    # A component gets blocks of its own if it is large; the others of a cluster share blocks.
    home = F.when(F.col("_size") > 50, F.col("label")).otherwise(F.lit(None).cast("long"))
    placed = stored(
        placed.withColumn("home", home).withColumn("blk", F.xxhash64("cluster", "home", F.pmod(F.xxhash64("node"), F.col("blocks")))), "placed"
    )
    return found, _block_pairs(prefixes, placed, F.expr("not (loa = hib and hia = lob)"))


def _block_pairs(prefixes: DataFrame, placed: DataFrame, wanted: Column) -> DataFrame:
    """Rows of one task per pair of blocks that share a prefix token, of those ``wanted``."""
    tokens = prefixes.select("node", F.explode("p1").alias("token")).join(placed, "node").groupBy("token", "cluster", "blk").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    left, right = (tokens.select("token", F.col("cluster").alias(f"c{s}"), F.col("blk").alias(s), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")) for s in "ab")
    met = left.join(right, "token").where("a <= b").where(wanted).select(F.col("ca").alias("cluster"), "a", "b").distinct()
    task = F.struct("cluster", "a", "b")
    sides = met.select(task.alias("task"), F.explode(F.array_distinct(F.array(
        F.struct(F.col("a").alias("blk"), F.when(F.col("a") == F.col("b"), -1).otherwise(0).alias("side")),
        F.struct(F.col("b").alias("blk"), F.when(F.col("a") == F.col("b"), -1).otherwise(1).alias("side")),
    ))).alias("s")).select("task", "s.blk", "s.side")
    return sides.join(placed, "blk").select("task", "side", "label", "node")


def _classes(docs: DataFrame, key: str, text: str, ngram: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, their classes of equal sets, and whole sets of the classes that may have a partner."""
    rows = keyed(docs, key, text)
    signed = stored(signatures(rows, ngram), "signatures")
    classes = signed.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct("id", "th")).alias("first"))
    tokens = _prefix_tokens(rows, ngram, similarity).repartition("token").sortWithinPartitions("token")
    hits = tokens.mapInArrow(_shared_counts, "_node long, hits long").groupBy("_node").agg(F.sum("hits").alias("hits"))
    needed = 1 + F.floor(F.ceil(F.lit(similarity) * F.col("n") / 100) / SLACK)
    left = classes.join(hits, F.col("node") == F.col("_node")).where(F.col("hits") >= needed)
    left = small(stored(left.select("first.id", "first.th").distinct(), "sieved"))
    sets = stored(_whole_sets(rows.join(left, ["id", "th"], "left_semi"), ngram), "sets")
    return signed, classes, sets


def linked(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    similarity: int = SIMILARITY,
    block: int = BLOCK,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, th, n, head)``: ``head`` is the struct ``(id, th)``
    of the first document of its component."""
    signed, classes, sets = _classes(docs, key, text, ngram, similarity)
    labels = components(_links(sets, similarity, block, block_rows))
    heads = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = heads.groupBy("label").agg(F.min("first").alias("head"))
    heads = heads.select("node", "label").join(first, "label").select("node", "head")
    joined = signed.join(heads, "node", "left")
    own = F.struct("id", "th")
    return joined.select("id", "th", "n", F.when(F.col("n") > 0, F.col("head")).otherwise(own).alias("head"))


def link_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    similarity: int = SIMILARITY,
    block: int = BLOCK,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, th, n, class_id, n_links)``: the class of equal sets it
    is in, and how many other classes link with that one. Every candidate pair is verified,
    so a group of near copies costs its pairs, block by block; none leaves its task.
    """
    signed, _, sets = _classes(docs, key, text, ngram, similarity)
    rows, _ = _tasks(sets, similarity, block, block_rows, all_links=True)
    counts = rows.groupBy("task").applyInPandas(_counted(similarity), "node long, links long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    class_id = F.when(F.col("n") > 0, F.col("node")).alias("class_id")
    return signed.join(counts, "node", "left").select("id", "th", "n", class_id, F.coalesce("links", F.lit(0)).alias("n_links"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without those linked to an earlier document; equal rows once."""
    found = stored(linked(docs, key, text, **options), "linked")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    names = [free_name(docs.columns, n) for n in ("own_id", "own_th", "own_text")]
    rows = docs.withColumns({names[0]: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST_ID)), names[1]: F.xxhash64(body)})
    match = lambda side: (F.col(names[0]) == side["_id"]) & (F.col(names[1]) == side["_th"])
    ids = lambda df: df.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    later = small(stored(ids(found.where(F.struct("id", "th") != F.col("head"))), "later"))
    rows = rows.join(later, match(later), "left_anti")
    twice = found.where("n > 0").groupBy("id", "th").count().where("count > 1")
    twice = small(stored(ids(twice), "twice"))
    once = rows.join(twice, match(twice), "left_anti")
    folded = rows.join(twice, match(twice), "left_semi").withColumn(names[2], body).dropDuplicates(names).drop(names[2])
    return once.unionByName(folded).drop(*names)
