"""Near-duplicates by ProbMinHash (operator 6).

Shingles of five words weigh as often as they occur. Each shingle is a Poisson process whose rate is its weight:
arrivals are exponential gaps apart, each arrival picks a register, a register keeps the shingle that arrives first.
Two texts then agree in a register with the probability Jaccard similarity of their weighted shingles. A process stops
as soon as its next arrival comes after every register has been taken, so most shingles draw a number or two.
A second signature with all weights 1 estimates the plain Jaccard similarity, which repeated passages leave high while
the weighted one falls. It is the first one again for texts that repeat no shingle.

1. Equal texts are one node, however many rows they have. Its signatures are cut into bands; equal bands are buckets.
2. Each member of a bucket is compared with the bucket's first one: a row per member, never a row per pair.
3. Pairs of which either signature agrees in ``PROMISING`` registers or more are verified on the full texts: a link is a
   probability Jaccard or a plain Jaccard similarity of ``SIMILARITY`` or more. Links make classes.
4. Buckets that still hold several classes are compared whole, in blocks: first by signature, which leaves the members
   near to one of another class, then those by their texts. A task gives the links that join the classes of its
   bucket, fewer than members, never all pairs. Buckets of one class, such as those of copies, end after step 3.

With 24 bands of 4 registers a link at 0.8 misses every bucket with probability 3e-6, and falls below ``PROMISING``
with less than 4e-4. Texts with fewer than five words have no shingles and are only joined by equality.

Defined results: null and empty texts are equal to their like only; a class is named after its smallest doc_id (null
if all are null); repeated rows are members like any other; an empty table gives an empty table; extra columns are
carried along by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch, broadcast_below, content_key, fresh

SHINGLE, SIMILARITY = 5, 0.8
# Rounds of rewiring links; more are an error, as classes would be incomplete.
ROUNDS = 64
REGISTERS, BANDS, ROWS = 96, 24, 4
PROMISING = 0.66  # 0.8 less 3.4 standard deviations of 96 registers
BLOCK = 2048  # members of a block
BLOCK_BYTES = 16 << 20
BROADCAST_ROWS = 200_000  # at most so many keys are broadcast; more are joined by shuffle
BATCH_ELEMENTS = 400_000
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier with mixed bits (golden ratio)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one (the finaliser of splitmix64; fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of a text, sorted, and how often each occurs."""
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate(([False], ~SPACES[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < SHINGLE:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # a word's hash is its polynomial in ODD: running sums of byte * ODD^position, divided by ODD^start
    powers, inverses = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)])))
    word = mix64((sums[ends] - sums[starts]) * inverses[starts] ^ (ends - starts).astype(np.uint64) * ODD)
    count = len(word) - SHINGLE + 1
    shingle = np.zeros(count, np.uint64)
    for k in range(SHINGLE):
        shingle = mix64(shingle + ODD + word[k:k + count])
    return np.unique(shingle, return_counts=True)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """ODD^i and its inverse modulo 2^64 for i below n, kept for the longest text so far."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        inverse = pow(int(ODD), -1, 2**64)
        for k, factor in enumerate((int(ODD), inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def signatures(documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The ProbMinHash registers (shingle hashes) of documents given as (hashes, weights); none is empty."""
    owner = np.repeat(np.arange(len(documents)), [len(h) for h, _ in documents])
    element = np.concatenate([h for h, _ in documents])
    rate = np.concatenate([w for _, w in documents]).astype(float)
    first = np.full(len(documents) * REGISTERS, np.inf)
    holder = np.zeros(len(first), np.uint64)
    at, step = np.zeros(len(element)), 0
    while len(element):
        step = (step + int(ODD)) % 2**64
        drawn = mix64(element + np.uint64(step))
        at = at - np.log(((drawn >> np.uint64(11)).astype(float) + 1) / 2.0**53) / rate
        register = owner * REGISTERS + (mix64(drawn ^ ODD) % np.uint64(REGISTERS)).astype(np.int64)
        early = at < first[register]
        slot, when, who = register[early], at[early], element[early]
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        holder[slot[won]] = who[won]
        open_ = at < first.reshape(-1, REGISTERS).max(axis=1)[owner]  # early termination
        element, rate, owner, at = element[open_], rate[open_], owner[open_], at[open_]
    return holder.reshape(-1, REGISTERS)


def both_signatures(documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The registers by weights and, behind them, those with all weights 1."""
    weighted = signatures(documents)
    plain, repeats = weighted.copy(), [i for i, (_, w) in enumerate(documents) if w.max() > 1]
    if repeats:
        plain[repeats] = signatures([(documents[i][0], np.ones_like(documents[i][1])) for i in repeats])
    return np.hstack((weighted, plain))


SIGNED = "doc_id long, key binary, signature binary, bands array<long>"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> ``SIGNED``; a short text has null signature and bands."""
    def flush(rows: list, found: list) -> pa.RecordBatch:
        registers = iter(both_signatures(found)) if found else iter(())
        ids, keys, marks, bands = [], [], [], []
        for doc_id, key, has in rows:
            own = next(registers) if has else None
            ids.append(doc_id)
            keys.append(key)
            marks.append(None if own is None else (own & np.uint64(255)).astype(np.uint8).tobytes())
            bands.append(None if own is None else _bands(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "key", "signature", "bands"])

    rows, found, size = [], [], 0
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            hashes, weights = shingles(text or b"")
            rows.append((doc_id, key, len(hashes) > 0))
            if len(hashes):
                found.append((hashes, weights))
            size += len(hashes)
            if size > BATCH_ELEMENTS or len(rows) >= 2000:
                yield flush(rows, found)
                rows, found, size = [], [], 0
    if rows:
        yield flush(rows, found)


def _bands(registers: np.ndarray) -> list[int]:
    """The different bands of both signatures; a text without repeats meets the second one of a text with some by its first."""
    found = []
    for own in registers.reshape(2, REGISTERS):
        mixed = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            mixed = mix64(mixed * ODD + own[k::ROWS][:BANDS])
        found += mixed.astype(np.int64).tolist()
    return list(dict.fromkeys(found))


def agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The share of equal registers of the better of both signatures."""
    return (one == two).reshape(-1, 2, REGISTERS).mean(axis=2).max(axis=1)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """The probability Jaccard and the plain Jaccard similarity of two weighted sets."""
    every = np.union1d(a[0], b[0])
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a[0])] = a[1]
    v[np.searchsorted(every, b[0])] = b[1]
    both = (u > 0) & (v > 0)
    if not both.any():
        return 0.0, 0.0
    pairs, count = np.unique(np.stack((u[both], v[both])), axis=1, return_counts=True)
    weighted = sum(n / np.maximum(u / x, v / y).sum() for (x, y), n in zip(pairs.T, count))
    return float(weighted), float(both.sum() / len(every))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, linked). Rows come by b, whose shingles are kept from row to row."""
    last, own = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        linked = []
        for i in range(len(a)):
            if b[i] != last:
                last, own = b[i], shingles(tb[i])
            linked.append(max(probability_jaccard(shingles(ta[i]), own)) >= SIMILARITY - 1e-12)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked, pa.bool_())],
                                         names=["a", "b", "linked"])


def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, signature_a, signature_b) -> the pairs (a, b) whose signatures agree well enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS) for c in ("signature_a", "signature_b"))
            good = pa.array(agreement(one, two) >= PROMISING)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def by_group(work):
    """A ``mapInArrow`` function that hands whole groups of rows sorted by (bucket, i, j) to ``work(table, starts)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            held = whole if held is None else pa.concat_tables([held, whole])
            starts = _starts(held)
            if len(starts) > 1:  # the last group may go on in the next batch
                yield from work(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from work(held, _starts(held))

    return run


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
    return np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)) if table.num_rows else np.empty(0, int)


def _groups(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group the rows of its one block and those of the other; the same array twice for a block on its own."""
    part, i, j = (table.column(c).to_numpy() for c in ("part", "i", "j"))
    for start, end in zip(starts, [*starts[1:], table.num_rows]):
        own = np.arange(start, end)
        yield (own, own) if i[start] == j[start] else (own[part[own] == i[start]], own[part[own] == j[start]])


def _marks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS)
    return marks, pd.factorize(np.array(table.column("class").to_pylist(), dtype=object))[0]


def near_others(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, node) of the members whose signature agrees well enough with that of a member of another class."""
    marks, classes = _marks(table)
    found = np.zeros(table.num_rows, bool)
    for mine, theirs in _groups(table, starts):
        near = np.zeros((len(mine), len(theirs)), bool)
        rows = np.union1d(mine, theirs)
        repeats = (marks[rows, :REGISTERS] != marks[rows, REGISTERS:]).any()  # without any, both signatures are the same
        for at in (0, REGISTERS) if repeats else (0,):
            agree = np.zeros(near.shape, np.uint8)
            for r in range(at, at + REGISTERS):
                agree += marks[mine, r][:, None] == marks[theirs, r][None, :]
            near |= agree >= PROMISING * REGISTERS
        good = near & (classes[mine][:, None] != classes[theirs][None, :])
        found[mine[good.any(axis=1)]] = True
        found[theirs[good.any(axis=0)]] = True
    for batch in table.select(["bucket", "node"]).filter(pa.array(found)).combine_chunks().to_batches():
        yield batch


def links_between(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b): links that join all classes of a bucket that its members link, fewer than it has members.

    Plain similarity is counted for a member and all others at once: its shingles are marked among all of the group,
    and the marks within each other member are summed. Weighted similarity differs from it only where shingles repeat.
    """
    marks, classes = _marks(table)
    nodes, texts = table.column("node").to_pylist(), table.column("text")
    left, right = [], []
    for mine, theirs in _groups(table, starts):
        rows = np.unique(np.concatenate((mine, theirs)))
        sets = [shingles(texts[int(r)].as_py()) for r in rows]
        sizes = np.array([len(h) for h, _ in sets])
        repeats = np.array([c.max() > 1 for _, c in sets])
        ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        marked, label = np.zeros(ids.max() + 1, bool), classes[rows].copy()
        one, two = np.searchsorted(rows, mine), np.searchsorted(rows, theirs)
        for x in one:
            others = two[label[two] != label[x]]
            if mine is theirs:
                others = others[others > x]
            if not len(others):
                continue
            own = ids[offsets[x]:offsets[x + 1]]
            marked[own] = True
            if 4 * len(others) > len(rows):
                shared = np.add.reduceat(marked[ids], offsets[:-1], dtype=np.int64)[others]
            else:
                shared = np.array([marked[ids[offsets[y]:offsets[y + 1]]].sum() for y in others])
            marked[own] = False
            linked = shared >= (SIMILARITY - 1e-12) * (sizes[x] + sizes[others] - shared)
            for k in np.flatnonzero(~linked & (repeats[others] | repeats[x])):
                if (marks[rows[others[k]], :REGISTERS] == marks[rows[x], :REGISTERS]).mean() >= PROMISING:
                    linked[k] = probability_jaccard(sets[x], sets[others[k]])[0] >= SIMILARITY - 1e-12
            for y in others[linked]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    left.append(nodes[rows[x]])
                    right.append(nodes[rows[y]])
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, class): each node with the least node it is linked to, over any number of links.

    Links are rewired to the least neighbour round by round (large star and small star in one); the number of rounds
    grows with the logarithm of the longest chain, and a node with many links is only ever reduced by a minimum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    for step in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        least = least.withColumn("least", F.least("u", "least"))
        # every node and every neighbour of it now point to the least of them
        wired = both.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))).filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # a star: no node is both above one node and below another, and none is above two
        edges = scratch.save(wired, f"{name}-{step}")
        tops = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("class"))
        loose = tops.filter("n > 1").limit(1).count() or edges.join(tops.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not loose:
            break
    else:
        raise RuntimeError(f"{name}: links still not rewired to stars after {ROUNDS} rounds")
    return nodes.join(tops.select(F.col("u").alias("node"), "class"), "node", "left").select(
        "node", F.coalesce("class", "node").alias("class"))


PAIR = "a binary, b binary"


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): (doc_id, key) for each row, and (node, class, doc_id) for each different text.

    ``node`` is the text's key, ``class`` the key that names its class, ``doc_id`` the text's smallest.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", content_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    rows = scratch.save(keyed.mapInArrow(sign, SIGNED), "rows")
    texts = scratch.save(rows.groupBy(F.col("key").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "texts")
    nodes, signed = texts.select("node"), texts.select("node", "signature")

    banded = texts.select("node", F.explode("bands").alias("bucket"))
    firsts = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch.save(banded.join(firsts, "bucket"), "members")
    texts_of = _texts_of(members.select("node").distinct(), docs, texts, scratch)
    beside = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    for side in ("a", "b"):
        beside = beside.join(signed.select(F.col("node").alias(side), F.col("signature").alias(f"signature_{side}")), side)
    stars = beside.select("a", "b", "signature_a", "signature_b").mapInArrow(promising, PAIR)
    tested = scratch.save(_verified(stars, texts_of), "tested-0")
    found = scratch.save(components(nodes, tested.filter("linked"), scratch, "star-links"), "classes-0")

    links = tested.filter("linked").select("a", "b")
    placed = members.select("bucket", "node").join(found, "node")
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("bucket")
    near = scratch.save(_dealt(placed.join(mixed, "bucket", "left_semi").join(signed, "node").withColumn("bytes", F.lit(0)), scratch, "mixed").mapInArrow(
        by_group(near_others), "bucket long, node binary").distinct(), "near")
    with_texts = near.join(found, "node").join(signed, "node").join(texts_of, "node").withColumn("bytes", F.octet_length("text"))
    more = scratch.save(_dealt(with_texts, scratch, "near-texts").mapInArrow(by_group(links_between), PAIR).distinct(), "links")
    found = scratch.save(components(nodes, links.unionByName(more), scratch, "all-links"), "classes-1")
    return rows.select("doc_id", "key"), texts.select("node", "doc_id").join(found, "node")


def _dealt(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of buckets, sorted by pairs of blocks (bucket, i, j): a member goes to each pair that its block is one of.

    A block has about ``BLOCK`` members or ``BLOCK_BYTES`` of text at most, so that a task holds two of them.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("parts")
    counts = rows.groupBy("bucket").agg(parts)
    large = scratch.save(counts.filter("parts > 1"), f"{name}-large")
    # nearly all buckets are one block; the others are looked up
    split = rows.drop("bytes").join(broadcast_below(large, BROADCAST_ROWS), "bucket", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    each = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts").repartition(
        "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def _texts_of(wanted: DataFrame, docs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) for the wanted nodes: the one text of each is read from its row of the smallest doc_id."""
    named = scratch.save(wanted.join(texts.select("node", F.col("doc_id").alias("least")), "node"), "wanted")
    keyed = docs.select(content_key(F.col("text")).alias("node"), "doc_id", F.col("text").cast("binary").alias("text"))
    named = broadcast_below(named, BROADCAST_ROWS).withColumnRenamed("node", "wanted")
    found = keyed.join(named, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return scratch.save(found.select("node", "text").dropDuplicates(["node"]), "member-texts")


def _verified(pairs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs of nodes, by their full texts."""
    beside = pairs.join(texts_of.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts_of.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return beside.select("a", "b", "text_a", "text_b").mapInArrow(verify, f"{PAIR}, linked boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_rows, copies) for every row: its class, the class's rows and the rows of its own text."""
    rows, texts = classes(docs.select("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(texts.join(rows.groupBy(F.col("key").alias("node")).agg(F.count(F.lit(1)).alias("copies")), "node"), "counted")
    named = counted.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    return rows.join(counted.join(named, "class").select(F.col("node").alias("key"), "class_id", "class_rows", "copies"), "key").drop("key")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest doc_id, with its columns as they were."""
    spark, columns = docs.sparkSession, docs.columns
    scratch = Scratch(spark)
    key, doc, one = fresh(docs, "_key"), fresh(docs, "_doc"), fresh(docs, "_one")
    rows, texts = classes(docs.select("doc_id", "text"))
    chosen = texts.groupBy("class").agg(F.min_by(F.struct("node", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("c")).select(
        F.col("c.node").alias("key"), F.col("c.doc_id").alias("doc_id"))
    counted = rows.join(chosen.withColumnRenamed("doc_id", "chosen"), "key").filter(F.col("doc_id").eqNullSafe(F.col("chosen"))).groupBy(
        "key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    keep = scratch.save(counted.select(F.col("key").alias(key), F.col("doc_id").alias(doc), (F.col("n") == 1).alias(one)), "keep")
    keyed, own = docs.withColumn(fresh(docs, "_own"), content_key(F.col("text"))), F.col(fresh(docs, "_own"))
    same = (own == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    plain = [F.col(f"`{c}`") for c in columns]
    single = keyed.join(keep.filter(one), same, "left_semi").select(plain)
    twice = keep.filter(~F.col(one))
    if not twice.limit(1).count():
        return single
    # rows that repeat both doc_id and text: any one of them
    return single.unionByName(keyed.join(broadcast_below(twice, BROADCAST_ROWS), same).dropDuplicates([key]).select(plain))
