"""Packing documents into sequences: vector best-fit, decreasing.

A sequence has three capacities: tokens, documents, and attention cost, which
is the sum of its documents' squared lengths. A document that is longer than a
sequence is cut; each piece goes to the open sequence that fits it best under
every constraint, longest pieces first. Best is the least weighted dot product
of what would be left with what the piece needs, or the least weighted norm of
what would be left.

A piece's needs depend on its length alone. So the fit is made for lengths and
how many pieces have each, and for classes of sequences that are in the same
state: all pieces of a length that go to one class are placed in one step. The
driver sees one count per length, at most as many as a sequence has tokens,
and the plan is a list of runs: pieces k .. k+n of a length go to sequences
b .. b+n at some offset. Pieces are numbered within their length on Spark and
look up their run. The result is that of one best-fit over all documents,
wherever they lie.

The bound on runs: a step either uses up the pieces of a length, or puts one
more piece in every sequence of a class. There are at most two classes more for
each length, so at most tokens * (1 + 2 * most documents of a sequence) runs.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm.session import written
from cadenza.llm.token_counts import BYTE_LEVEL
from cadenza.operators.ordered import numbered

#: Rows of a batch of pieces; ids of a batch of sequences.
_ROWS = 10_000
_KEY_BITS = 40


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin characters for themselves, those from 256 on, in order, for
    the other bytes."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class RankEncoder:
    """Texts -> ids as little-endian 32-bit integers, equal to the `tokenizers`
    library's, for byte-level tokenizers without a normalizer. Where a
    vocabulary's ids are its merges' ranks, which the constructor checks, Latin
    text is encoded by rank with `tiktoken`, many times as fast; other text,
    where classes of characters could be disputed, and text with the strings of
    added tokens go to the library."""

    #: All but ASCII, its common white space, and Latin letters and signs.
    odd = re.compile("[^\t\n\r -~¡-ɏ]").search

    def __init__(self, spec: str):
        config = json.loads(spec)
        if config["pre_tokenizer"]["type"] != "ByteLevel" or config["pre_tokenizer"]["add_prefix_space"] or config["normalizer"]:
            raise ValueError("a byte-level tokenizer without a normalizer or a prefix space is needed")
        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t["content"] for t in config["added_tokens"]]
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        by_rank = all(vocab["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + i for i, m in enumerate(merges))
        self.fast = None
        if by_rank and config["model"]["type"] == "BPE":
            byte = byte_of()
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.added}
            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.odd(text) or any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_encoders: dict[int, RankEncoder] = {}


def _encoder(spec: str) -> RankEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = RankEncoder(spec)
    return _encoders[key]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of the pieces of each row of
    docs: its text's ids and end_id, cut from behind into pieces of `capacity`
    ids, so that only the first may be shorter. ids are little-endian unsigned
    32-bit integers, and so is what the crc32 is taken of. No shuffle."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            rows, held = [], 0
            for r, text in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for p, stop in enumerate(stops):
                    start = 0 if p == 0 else stop - capacity
                    part = ids[4 * start : 4 * stop]
                    rows.append((r, p, start, stop - start, zlib.crc32(part), bytes(part) if with_ids else None))
                held += len(ids) if with_ids else 0
                if len(rows) >= _ROWS or held > 16 << 20:
                    yield made(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield made(batch.column(0), rows)

    def made(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [keys.take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names=names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. None: as many as the tokens allow."""

    tokens: int
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


#: (score, weights of tokens, documents and attention cost).
Score = tuple[str, tuple[float, float, float]]
SCORES: tuple[Score, ...] = (("norm", (1, 0, 0)), ("norm", (1, 0.25, 0.25)), ("dot", (1, 0.25, 0.25)), ("dot", (1, 1, 1)))


def scored(left: np.ndarray, need: np.ndarray, limits: np.ndarray, score: Score) -> np.ndarray:
    """How badly a piece fits sequences of which `left` would be left."""
    name, weights = score
    free = left / limits
    return (free * (free if name == "norm" else need / limits)) @ np.array(weights, dtype=float)


def best_fit(counts: Mapping[int, int], limits: Limits, score: Score) -> tuple[int, np.ndarray]:
    """Places counts[n] pieces of each length n. Returns the number of sequences
    and the runs: rows (length, k, n, sequence, offset), by length and k; the
    k-th to (k+n-1)-th piece of that length, from 0, go to the sequences from
    `sequence` on, each at that offset. Ties go to the class opened first."""
    caps = limits.vector()
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    free = np.zeros((0, 3), np.int64)
    runs, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        # Sequences that take no piece of this length take no shorter one only
        # if they are full; those are set aside.
        keep = (free[:, 0] > 0) & (free[:, 1] > 0) & (free[:, 2] > 0)
        first, many, free = first[keep], many[keep], free[keep]
        k, left = 0, counts[length]
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if not len(fits):
                new = -(-left // int((caps // need).min()))
                first, many, free = np.append(first, opened), np.append(many, new), np.vstack([free, caps])
                opened += new
                continue
            c = fits[np.argmin(scored(free[fits] - need, need, caps, score))]
            n = min(left, int(many[c]))
            runs.append((length, k, n, int(first[c]), int(caps[0] - free[c, 0])))
            if n < many[c]:  # the rest of the class stays as it was
                first, many, free = np.append(first, first[c] + n), np.append(many, many[c] - n), np.vstack([free, free[c]])
                many[c] = n
            free[c] -= need
            k, left = k + n, left - n
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return opened, table[np.lexsort((table[:, 1], table[:, 0]))]


def pack_pieces(pieces: DataFrame, limits: Limits, scores: Sequence[Score] = SCORES) -> DataFrame:
    """pieces (any columns, `length` among them) with sequence_id and offset.
    Of the scores, the one that needs the fewest sequences is used; what comes
    to the driver is one count per length. Pieces of a length are numbered by
    all other columns, so reruns agree."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plans = [best_fit(counts, limits, s) for s in scores]
    _, table = min(plans, key=lambda p: p[0])
    sent = pieces.sparkSession.sparkContext.broadcast((table[:, 0] * (1 << _KEY_BITS) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ks, sequences, offsets = sent.value
        for batch in batches:
            k = batch.column("_k").to_numpy() - 1
            run = np.searchsorted(starts, batch.column("length").to_numpy() * (1 << _KEY_BITS) + k, "right") - 1
            found = [pa.array(sequences[run] + k - ks[run], pa.int64()), pa.array(offsets[run], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    order = [c for c in pieces.columns if c != "length"]
    rows = numbered(pieces, ["length"], order, "_k", "pieces-by-length").select(*pieces.columns, "_k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits(1024), end_id: int = 2, scores: Sequence[Score] = SCORES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each row of docs goes: (id_col, piece, start, length,
    ids_crc32, sequence_id, offset).

    A null text is empty: one piece, the end id alone. Ids may be null or
    repeat: each row is packed. An empty table gives no row; other columns are
    not read. A document longer than limits.tokens is cut (`token_pieces`); the
    longest piece must fit an empty sequence, so limits.attention must allow
    limits.tokens squared, or ValueError is raised.
    """
    pieces = written(token_pieces(docs, tokenizer_file, limits.tokens, end_id, False, id_col, text_col), "pieces")
    return pack_pieces(pieces, limits, scores).withColumnRenamed("id", id_col)


def packed_sequences(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits(1024), end_id: int = 2, scores: Sequence[Score] = SCORES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: (sequence_id, ids, documents); ids are the
    tokens as little-endian unsigned 32-bit integers, documents the pieces in
    their order, each with (id, piece, start, length). A sequence's pieces are
    few, so a group is never large."""
    pieces = token_pieces(docs, tokenizer_file, limits.tokens, end_id, True, id_col, text_col).withColumn("key", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    placed = pack_pieces(pieces.drop("ids"), limits, scores).select("key", "sequence_id", "offset")
    there = pieces.join(placed, "key").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "start", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return there.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"))).alias("documents"))
