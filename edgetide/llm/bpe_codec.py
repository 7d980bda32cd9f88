"""Byte-level BPE encoding and decoding by batched numpy merge rounds (operator 11).

A text is cut at the tokenizer's added tokens, then into words by the pattern of byte-level tokenizers. The words of
many texts stand as one flat array of symbols, a symbol per byte at first. In each round the rank of every neighbouring
pair is looked up by binary search over the sorted keys of all merges, the lowest rank of each word is found by one
reduction, and all places that hold it are merged at once (of overlapping places the left ones). Words without a pair
that merges leave the array. Only the pairs around a merge are looked up again.

That equals merging one pair after the other: a merged symbol takes part in later merges only, which ``Merges`` checks.
Words are kept with their ids, up to ``CACHE_WORDS`` of them in a task, so a word that is met again costs one look-up.

The tokenizer file is read by the driver and its merges (some 2 MB, ``MAX_MERGES`` at most) are broadcast. Texts are
cut into pieces of about ``PIECE`` characters, at a blank behind a character that is none, which no word spans; only a
run without such a blank is held as one piece. Memory is bounded by the longest text and its ids. No shuffle.

Defined results: a null and an empty text have no ids and decode to the empty text; repeated rows and null doc_ids give
a row each; an empty table gives an empty table; other columns are left out of the results, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern of byte-level tokenizers. Their white space is the Unicode property.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
PIECE = 1 << 18
BATCH_WORDS = 1 << 17
BATCH_BYTES = 8 << 20
CACHE_WORDS = 300_000
MAX_MERGES = 2_000_000
NONE = np.int32(2**31 - 1)
ENCODED = "doc_id long, n_tokens long, ids binary"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}
    return [chr(hidden.get(b, b)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """A byte-level BPE vocabulary as arrays: merges sorted by the key of their pair, and the bytes of every id."""

    size: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray
    token_bytes: np.ndarray
    token_starts: np.ndarray
    added: dict[str, int]

    @staticmethod
    def read(path: str) -> "Merges":
        """Reads a tokenizer file on the driver; raises if it asks for steps other than the ones above."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split, shown = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        options = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        plain = (model["type"] == "BPE" and split.get("type") == shown.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not spec["normalizer"] and not any(options))
        if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Merges.build(vocab, pairs, {a["content"]: a["id"] for a in spec["added_tokens"]})

    @staticmethod
    def build(vocab: dict[str, int], pairs: list[tuple[str, str]], added: dict[str, int]) -> "Merges":
        if len(pairs) > MAX_MERGES:
            raise ValueError(f"more than {MAX_MERGES} merges")
        letters = byte_letters()
        known = set(letters)
        for left, right in pairs:
            if left not in known or right not in known:
                raise ValueError(f"the merge of {left!r} and {right!r} stands before one that makes its parts")
            known.add(left + right)
        size = 1 + max([*vocab.values(), *added.values()])
        left, right, merged = (np.array([vocab[x] for x in column], dtype=np.int64) for column in (
            [p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        keys, first = np.unique(left * size + right, return_index=True)
        byte_of = {letter: b for b, letter in enumerate(letters)}
        of_token = [b""] * size
        for token, number in vocab.items():
            of_token[number] = bytes(byte_of[c] for c in token)
        for token, number in added.items():
            of_token[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        starts = np.concatenate([[0], np.cumsum([len(t) for t in of_token])])
        return Merges(size, keys, first.astype(np.int32), merged[first].astype(np.int32),
                      np.array([vocab[x] for x in letters], dtype=np.int32),
                      np.frombuffer(b"".join(of_token), dtype=np.uint8), starts.astype(np.int64), added)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, ``NONE`` for pairs that do not merge, and the place of its merge."""
        key = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(key), NONE), place
        return np.where(self.keys[place] == key, self.ranks[place], NONE), place

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each word's begin (and the end)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), NONE)  # of the pair of a symbol and the next one of its word
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.look_up(symbols[inner], symbols[inner + 1])[0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.concatenate([first, [len(symbols)]]))
            lowest = np.repeat(lowest, lengths)
            over = lowest == NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                symbols, owner, rank, lowest = symbols[~over], owner[~over], rank[~over], lowest[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == lowest)
            # neighbours that both hit are a run of one symbol: every second of them merges, from its start on
            begins = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            symbols[at] = self.merged[self.look_up(symbols[at], symbols[at + 1])[1]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # as many symbols before it have gone as merges
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            near = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[near] = NONE
            near = near[near < len(symbols) - 1]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.look_up(symbols[near], symbols[near + 1])[0]
        owners = np.concatenate([d[0] for d in done]) if done else np.empty(0, dtype=np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.empty(0, dtype=np.int32)
        order = np.argsort(owners, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Encodes texts of one task; keeps words it has met with their ids."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pattern = regex.compile(WORDS)
        # of two added tokens that begin at the same place the longer one counts
        added = sorted(merges.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.cut = regex.compile(r"(?<=\P{White_Space}) ")
        self.forget()

    def forget(self) -> None:
        self.number = {token: i for i, token in enumerate(self.merges.added)}
        self.ids = np.array(list(self.merges.added.values()), dtype=np.int32)
        self.starts = np.arange(len(self.number) + 1)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text and its added tokens, in pieces of bounded size."""
        parts = self.added.split(text) if self.added else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
                continue
            at = 0
            while at < len(part):
                cut = self.cut.search(part, at + PIECE) if len(part) - at > PIECE else None
                end = cut.start() if cut else len(part)
                yield self.pattern.findall(part[at:end])
                at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        pieces: list[tuple[int, int]] = []
        for row, text in enumerate(texts):
            for piece in self.pieces(text):
                words += piece
                pieces.append((row, len(piece)))
                if len(words) >= BATCH_WORDS:
                    self.give(words, pieces, found)
                    words, pieces = [], []
        self.give(words, pieces, found)
        return [np.concatenate(x) if x else np.empty(0, dtype=np.int32) for x in found]

    def give(self, words: list[str], pieces: list[tuple[int, int]], found: list[list[np.ndarray]]) -> None:
        if len(self.number) > CACHE_WORDS:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            ids, starts = self.merges.merge([w.encode() for w in new])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + starts[1:]])
            self.ids = np.concatenate([self.ids, ids])
        numbers = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        starts, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ids = gather(self.ids, starts, sizes)
        ends = np.cumsum([n for _, n in pieces])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for (row, n), end in zip(pieces, ends):
            found[row].append(ids[bounds[end - n]:bounds[end]])


def decode_ids(merges: Merges, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    starts, ends = merges.token_starts[ids], merges.token_starts[ids + 1]
    return gather(merges.token_bytes, starts, ends - starts).tobytes().decode("utf-8", "replace")


def _groups(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (start, end) of about ``BATCH_BYTES``, so that no batch holds many long texts at once."""
    start, held, end = 0, 0, 0
    for end, size in enumerate(pc.binary_length(values).to_pylist(), 1):
        held += size or 0
        if held >= BATCH_BYTES:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def encode(docs: DataFrame, merges: Merges) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of ``docs`` (doc_id, text); ids are little-endian 32-bit integers."""
    table = docs.sparkSession.sparkContext.broadcast(merges)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            for start, end in _groups(batch["text"]):
                part = batch.slice(start, end - start)
                ids = encoder.encode([t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, merges: Merges) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for rows as ``encode`` gives them; a null list decodes to the empty text."""
    table = encoded.sparkSession.sparkContext.broadcast(merges)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in _groups(batch["ids"]):
                part = batch.slice(start, end - start)
                texts = [decode_ids(table.value, np.frombuffer(x or b"", dtype="<u4").astype(np.int64)) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_tokens"], part["ids"], pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded string")
