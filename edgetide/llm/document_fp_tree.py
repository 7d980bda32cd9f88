"""Ranked lexical search by branch and bound over a document FP-tree (operator 13).

Given queries (benchmark items), every document's terms are restricted to those that occur in some item, with their
counts tf, and ordered from the most frequent term of the corpus to the rarest. Documents whose ordered vectors begin
alike share a path of a trie, as in an FP-tree. A node holds, over all documents below it, the largest tf of its term
and the least length norm m; a term's contribution grows with tf and falls with m, so both together bound it.

An item looks only at the nodes of its own terms. The documents below a node are a run of the sorted documents, so
these nodes are nested intervals: the item's own small tree. From its leaves upward the bound of a node is its own
contribution plus the largest bound among its children, because a document goes on in one child only. The search then
descends depth first, children with the largest bound first, and leaves out every node whose bound, with what its path
contributes at most, is below the k-th best score so far. Runs of at most ``LEAF`` documents are scored exactly, and
so are documents that end at a node.

Tasks build a tree over ``TREE_ENTRIES`` (document, term) pairs at a time and carry their k best from tree to tree. The
vectors, a small part of the texts, are dealt evenly over tasks of ``TASK_ENTRIES`` pairs, whatever the files hold.
The best of all tasks are ranked by item, in two steps, so that one item's candidates are never one large group.
What reaches the driver and all tasks are the items' terms, their document frequencies and the item numbers, in blocks of about ``BLOCK_TERMS``
terms; each block reads the documents again. Only one item's own distinct terms are held whole. No shuffle moves texts.

Defined results: null and empty texts have no terms and no rank; an item without terms, or whose terms no document has,
gives no rows; repeated documents are ranked each; repeated item rows are ranked each; a null doc_id comes last among
equal scores; empty tables give an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch

TOP = 50
BLOCK_TERMS = 200_000
TREE_ENTRIES = 300_000
TASK_ENTRIES = 2_000_000
LEAF = 32
MERGE = 1024
NO_ID = 2**63 - 1
# Fixed value: a term, a run of letters and digits of ASCII and of everything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes: what is no term becomes a blank, A-Z lower-case letters.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
BEST = "item int, doc_id long, score long, part int"


def item_terms(items: DataFrame) -> DataFrame:
    """(number, item_id, terms) of every item row; its terms once each."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select("item_id", F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms")).withColumn(
        "number", F.monotonically_increasing_id())


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and its counts of the terms in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for scalar in batch["text"].cast(pa.binary()):
                found = (scalar.as_py() or b"").translate(FOLD).split()
                sizes.append(len(found))
                counts = Counter(found)
                here = counts.keys() & words.keys()
                terms += [words[t] for t in here]
                tfs += [counts[t] for t in here]
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTOR)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def contribution(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


@dataclass
class Tree:
    """Documents sorted by their term vectors, and the trie nodes over them.

    Entries are (document, term) pairs in that order; ``exact`` is what each adds to a score. Nodes are sorted by term,
    then by their first document; those of term t are ``first[t]`` to ``first[t + 1]``. ``bound`` is the largest
    contribution of the node's term in its documents, from the tf maximum and the m minimum below the node.
    """

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    exact: np.ndarray
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    bound: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> "Tree":
        """``terms`` are numbered by falling document frequency; each document has one at least."""
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((terms, doc))
        terms, tfs = terms[order], tfs[order]
        ends = np.cumsum(sizes)
        paths = terms.astype(">u4").tobytes()
        keys = [paths[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
        rank = sorted(range(len(ids)), key=keys.__getitem__)
        ids, m, begins, sizes = ids[rank], m[rank], (ends - sizes)[rank], sizes[rank]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(begins - starts[:-1], sizes) + np.arange(starts[-1])
        terms, tfs = terms[take], tfs[take]

        path: list[int] = []  # the nodes from the root to the last document's end
        node_of: list[int] = []
        lo: list[int] = []
        closed: list[int] = []
        closed_at: list[int] = []
        before = b""
        for i, k in enumerate(rank):
            key = keys[k]
            shared = common(before, key)
            gone = path[shared:]
            closed += gone
            closed_at += [i] * len(gone)
            del path[shared:]
            more = len(key) // 4 - shared
            path += range(len(lo), len(lo) + more)
            lo += [i] * more
            node_of += path
            before = key
        closed += path
        closed_at += [len(ids)] * len(path)
        hi = np.empty(len(lo), dtype=np.int64)
        hi[closed] = closed_at
        node = np.array(node_of)
        tf_max, m_min = np.zeros(len(lo), dtype=np.int64), np.full(len(lo), 2**62)
        m_of = np.repeat(m, sizes)
        np.maximum.at(tf_max, node, tfs)
        np.minimum.at(m_min, node, m_of)
        term = np.empty(len(lo), dtype=np.int64)
        term[node] = terms
        bound = contribution(weights[term], tf_max, m_min)
        by_term = np.lexsort((lo, term))
        first = np.searchsorted(term[by_term], np.arange(len(weights) + 1))
        return Tree(ids, starts, terms, contribution(weights[terms], tfs, m_of), first,
                    np.array(lo)[by_term], hi[by_term], bound[by_term])

    def scores(self, lo: int, hi: int, mine: np.ndarray) -> np.ndarray:
        """Exact scores of a run of documents for the item whose terms ``mine`` marks."""
        a, b = self.starts[lo], self.starts[hi]
        return np.add.reduceat(np.where(mine[self.terms[a:b]], self.exact[a:b], 0), self.starts[lo:hi] - a)

    def search(self, item: np.ndarray, mine: np.ndarray, best: "Best") -> None:
        """Adds to ``best`` every document that may be among the item's best; ``item`` has its terms in order."""
        nodes = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in item] or [np.empty(0, dtype=np.int64)])
        if not len(nodes):
            return
        above = np.zeros(len(self.ids), dtype=np.int64)  # the bound of the subtree that a document lies in, so far
        totals = []
        for t in item[::-1]:
            part = slice(self.first[t], self.first[t + 1])
            lo, hi = self.lo[part], self.hi[part]
            if not len(lo):
                totals.append(np.empty(0, dtype=np.int64))
                continue
            # an even place is a node's run, an odd one the gap behind it
            edges = np.column_stack([lo, hi]).ravel()
            padded = np.append(above, 0)
            total = self.bound[part] + np.maximum.reduceat(padded, edges)[::2]
            totals.append(total)
            size = hi - lo
            above[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(total, size)
        total = np.concatenate(totals[::-1])
        own, lo, hi = self.bound[nodes], self.lo[nodes], self.hi[nodes]
        # by first document and then from the root downwards: an item's tree in preorder
        level = np.repeat(np.arange(len(item)), [self.first[t + 1] - self.first[t] for t in item])
        order = np.lexsort((level, lo))
        own, total, lo, hi = own[order], total[order], lo[order], hi[order]
        after = np.searchsorted(lo, hi).tolist()  # the first node behind a node's subtree
        own, total, lo, hi = own.tolist(), total.tolist(), lo.tolist(), hi.tolist()

        def children(at: int, end: int) -> list[int]:
            found = []
            while at < end:
                found.append(at)
                at = after[at]
            return found

        # a stack of (node, what its path adds at most, whether it is about the documents that end at the node); the
        # child with the largest bound lies on top, the documents that end at a node below its children
        stack = [(v, 0, False) for v in sorted(children(0, len(lo)), key=total.__getitem__)]
        while stack:
            v, prefix, ending = stack.pop()
            if prefix + (own[v] if ending else total[v]) < best.least:
                continue
            inner = children(v + 1, after[v])
            if ending:
                at = lo[v]
                for end, behind in [*((lo[c], hi[c]) for c in inner), (hi[v], 0)]:
                    if at < end:
                        best.add(self.ids[at:end], self.scores(at, end, mine))
                    at = behind
            elif hi[v] - lo[v] <= LEAF or not inner:
                best.add(self.ids[lo[v]:hi[v]], self.scores(lo[v], hi[v], mine))
            else:
                stack.append((v, prefix, True))
                stack += [(c, prefix + own[v], False) for c in sorted(inner, key=total.__getitem__)]


def common(a: bytes, b: bytes) -> int:
    """The number of equal 4-byte numbers at the beginning of both."""
    size = min(len(a), len(b)) // 4
    if a[:4 * size] == b[:4 * size]:
        return size
    x, y = np.frombuffer(a, ">u4", size), np.frombuffer(b, ">u4", size)
    return int((x != y).argmax())


class Best:
    """The ``k`` best (score, then the least id) that one item has found so far in a task, ties at the end included."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.ids, self.found = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        ids, found = np.concatenate([self.ids, ids[good]]), np.concatenate([self.found, scores[good]])
        if len(ids) > self.k:
            order = np.lexsort((ids, -found))[:self.k]
            ids, found = ids[order], found[order]
            self.least = int(found[-1])
        self.ids, self.found = ids, found


def best_of_tasks(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int = TOP) -> DataFrame:
    """(item, doc_id, score, part): each task's best for each item, by number, of rows (doc_id, m, terms, tfs)."""
    context = rows.sparkSession.sparkContext
    asked = context.broadcast((items, weights))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, entries = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                entries += len(batch["terms"].flatten())
            if entries >= TREE_ENTRIES:
                yield grow(held)
                held, entries = [], 0
        if held:
            yield grow(held)

    def grow(held: list[pa.RecordBatch]) -> Tree:
        table = pa.Table.from_batches(held).combine_chunks()
        column = {c: table[c].combine_chunks() for c in table.column_names}
        sizes = np.diff(column["terms"].offsets.to_numpy())
        return Tree.build(column["doc_id"].fill_null(NO_ID).to_numpy(), column["m"].to_numpy(), sizes.astype(np.int64),
                          column["terms"].flatten().to_numpy().astype(np.int64), column["tfs"].flatten().to_numpy().astype(np.int64), asked.value[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = asked.value
        best = [Best(k) for _ in wanted]
        mine = np.zeros(len(w), dtype=bool)
        for tree in trees(batches):
            for item, found in zip(wanted, best):
                mine[item] = True
                tree.search(item, mine, found)
                mine[item] = False
        part = TaskContext.get().partitionId() % MERGE
        for number, found in enumerate(best):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found.ids), number), pa.int32()), pa.array(found.ids, pa.int64(), mask=found.ids == NO_ID),
                    pa.array(found.found, pa.int64()), pa.array(np.full(len(found.ids), part), pa.int32())], schema=schema)

    return rows.mapInArrow(run, BEST)


def ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of all ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked, seen = scratch.save_counted(item_terms(items), "items", F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"))
    blocks = max(1, -(-seen["terms"] // block_terms))
    found = None
    for block in range(blocks):
        # about BLOCK_TERMS terms
        mine = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).orderBy("number").collect()
        part = _search_block(docs, [(r["item_id"], r["terms"]) for r in mine], k, scratch, block)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int, scratch: Scratch, block: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, own in items for t in own})
    rows, seen = scratch.save_counted(
        vectors(docs, {t.encode(): i for i, t in enumerate(terms)}), f"vectors-{block}",
        F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries"))
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = dict(map(tuple, counted.collect()))  # as many rows as the block has terms
    order = sorted(df, key=lambda t: (-df[t], terms[t]))
    place = {t: i for i, t in enumerate(order)}
    weights = np.array([weight(seen["documents"], df[t]) for t in order], dtype=np.int64)
    number = {t: i for i, t in enumerate(terms)}
    wanted = [np.array(sorted(place[number[t]] for t in own if number[t] in place), dtype=np.int64) for _, own in items]
    # terms are renumbered from the most frequent one on
    by_place = spark.sparkContext.broadcast(np.array([place.get(t, -1) for t in range(len(terms))], dtype=np.int32))
    ready = rows.filter(F.size("terms") > 0).select(
        "doc_id", F.expr(f"50L + (50L * n * {seen['documents']}L) div {max(seen['terms'], 1)}L").alias("m"), "terms", "tfs")

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["terms"]
            offsets = lists.offsets.to_numpy()
            new = pa.ListArray.from_arrays(pa.array(offsets - offsets[:1], pa.int32()), pa.array(by_place.value[lists.flatten().to_numpy()], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["m"], new, batch["tfs"]], names=batch.schema.names)

    # small tables go to as many tasks as there are cores, if each has a tree to build
    few = min(spark.sparkContext.defaultParallelism, -(-seen["entries"] // TREE_ENTRIES))
    ready = ready.repartition(max(1, few, -(-seen["entries"] // TASK_ENTRIES)))
    ready = ready.mapInArrow(renumber, "doc_id long, m long, terms array<int>, tfs array<int>")
    best = ranked(ranked(best_of_tasks(ready, wanted, weights, k), ["item", "part"], k), ["item"], k)
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
