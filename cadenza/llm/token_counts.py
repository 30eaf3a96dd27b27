"""Token counts by the whole-token shortcut.

Which vocabulary strings encode, alone, as one token is proven once per run by
encoding every one of them. A text is then cut into pre-tokens; those that are
proven whole count one each, and only the others are merged. Pre-tokens are
merged independently of each other, so the sum is the library's own count.

Stays in one stage without a shuffle: each row is counted where it is read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Byte-level pre-token pattern; a fixed value of that tokenizer kind.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: As above with white space as the library has it: without 0x1C-0x1F.
_PATTERN = BYTE_LEVEL.replace(r"\S", r"[^\p{White_Space}]").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
#: Bytes of merged pre-tokens that a worker remembers at most; beyond it starts
#: afresh. What each takes beside its text; longer ones are not remembered.
REMEMBERED_BYTES, ENTRY, LONGEST = 128 << 20, 130, 200


def prove_whole_tokens(spec: str) -> list[str]:
    """The strings of the vocabulary that the library encodes, alone, as
    exactly one token: the proof is that encoding."""
    tokenizer = Tokenizer.from_str(spec)
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    special = {t["content"] for t in json.loads(spec)["added_tokens"]}
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return [s for i, (s, e) in enumerate(zip(strings, encoded, strict=True)) if e.ids == [i] and s not in special and regex.fullmatch(_PATTERN, s)]


class Unassigned(Exception):
    """A pre-token holds a code point on whose class Unicode versions differ."""


class Counter(dict):
    """Pre-token -> number of tokens. Starts from the proven ones."""

    def __init__(self, spec: str, whole: list[str]):
        config = json.loads(spec)
        if config["pre_tokenizer"]["type"] != "ByteLevel" or config["normalizer"]:
            raise ValueError("the shortcut is proven for byte-level tokenizers without a normalizer")
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.held = whole, 0
        self.tokenizer = Tokenizer.from_str(spec)
        self.pieces = regex.compile(_PATTERN).findall
        special = [t["content"] for t in config["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, piece: str) -> int:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            raise Unassigned
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = n
            self.held += ENTRY + len(piece)
        return n

    def count(self, text: str) -> int:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0
            self.update(dict.fromkeys(self.whole, 1))
        parts = self.special.split(text) if self.special else [text]
        try:
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)
        except Unassigned:  # the library's own tables decide
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs.

    tokenizer_file: a byte-level `tokenizers` JSON file; read on the driver and
    broadcast (its size is that of the vocabulary, whatever the data).
    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat:
    each row gives one row. Other columns of docs are not read.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value[0])
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*sent.value)
        counter = _counters[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
