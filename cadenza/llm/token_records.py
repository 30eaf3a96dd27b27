"""Token ids as length-delimited binary records with an offset index.

A shard holds the records of one range of ids, in ascending id order:

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian. The payload is one document's token ids, unsigned, in 2
bytes each if the vocabulary has at most 65,536 ids and else in 4. A masked crc
is the crc32 rotated right by 15 bits plus a constant, so that a checksum over
bytes that hold checksums stays meaningful. Beside each shard lies an index: an
i64 array with a row (offset, number of ids) per record, for reads in any order.

Documents are dealt out by id range once; each task encodes its range and
writes one shard under a temporary name, then renames it. A task that runs
again (a lost executor, a speculative copy) writes the same bytes to the same
name.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm.session import fresh_path, partitions

MASK_DELTA = 0xA282EAD8
#: Bytes of encoded words that a worker remembers at most; beyond it keeps those
#: of the last texts. What one of them takes beside its text and ids.
REMEMBERED_BYTES, ENTRY = 96 << 20, 220
_FLUSH = 4 << 20
#: Text that is cut into words at a time.
_CHUNK = 1 << 20
#: White space to Python's str.split() but not to the tokenizers library.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
#: All but Latin text and common punctuation: where case, composition or what is
#: a letter or white space could be disputed.
NOT_PLAIN = "\x1c-\x1f\u0130\u0180-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, offset: int = 0) -> tuple[memoryview, int]:
    """The payload at offset and the offset of the next record; raises
    ValueError if a checksum or the length is wrong."""
    view = memoryview(data)
    head = view[offset : offset + 8]
    if len(head) < 8:
        raise ValueError(f"record at {offset}: cut short")
    (n,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", view, offset + 8)[0] != masked_crc(head):
        raise ValueError(f"record at {offset}: the length's checksum is wrong")
    payload = view[offset + 12 : offset + 12 + n]
    if len(view) < offset + 16 + n or struct.unpack_from("<I", view, offset + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"record at {offset}: the payload's checksum is wrong")
    return payload, offset + 16 + n


class WordEncoder:
    """Texts -> ids, where tokens never cross white space; the constructor
    checks this of the tokenizer. Plain Latin text is lower-cased and cut into
    the tokenizer's own pre-tokens, whose ids are remembered; a batch's new ones
    are encoded in one call, whose ids fall apart at the tokens that end a word.
    Other text is cut at white space, and its words are remembered."""

    def __init__(self, spec: str):
        config = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = width(spec)
        pre = config["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        split, suffix = steps[0], config["model"].get("end_of_word_suffix")
        self.by_word = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"]["Regex"] and not any(s.get("add_prefix_space") for s in steps)
        self.by_piece = self.by_word and bool(suffix)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        #: Words and pieces of the last texts.
        self.last: list[set[str]] = [set(), set()]
        if self.by_piece:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            openers = "".join({re.escape(t["content"][0]) for t in config["added_tokens"]})
            self.plain = re.compile(f"[^{NOT_PLAIN}{openers}]*").fullmatch
            self.cut = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", _members("L")).replace(r"\p{N}", _members("N"))).findall

    def ids(self, text: str) -> bytes:
        return self.found(text).tobytes()

    def found(self, text: str) -> np.ndarray:
        # Of one text, the batch's form gives the same ids without offsets.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def learn(self, known: dict[str, bytes], fresh: list[str], together: bool) -> None:
        """Takes in new words or pieces, so that looking them up finds them."""
        for k in range(0, len(fresh), 5000):
            part = fresh[k : k + 5000]
            found = None
            if together:
                ids = self.found(" ".join(part))
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) == len(part) and stops[-1] == len(ids):
                    data, step = ids.tobytes(), ids.itemsize
                    found = [data[a * step : b * step] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            found = found or [self.ids(p) for p in part]
            known.update(zip(part, found, strict=True))
            self.held += self.taken(part, found)

    @staticmethod
    def taken(words, ids) -> int:
        return sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)

    def forget(self) -> None:
        """Keeps what the last texts had: of common words, most."""
        self.words, self.pieces = ({w: known[w] for w in had if w in known} for known, had in ((self.words, self.last[0]), (self.pieces, self.last[1])))
        self.held = sum(self.taken(known, known.values()) for known in (self.words, self.pieces))
        if self.held > REMEMBERED_BYTES // 2:
            self.words, self.pieces, self.held = {}, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, of about _CHUNK characters together."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        out: list[bytes] = []
        cut: list[tuple[dict, list[str]] | None] = []
        for t in texts:
            if self.by_piece and self.plain(t):
                cut.append((self.pieces, self.cut(t.lower())))
            elif self.by_word and not _ODD_SPACE(t):
                cut.append((self.words, t.split()))
            else:
                cut.append(None)
        for k, (known, together) in enumerate(((self.words, False), (self.pieces, True))):
            self.last[k] = set().union(*(c[1] for c in cut if c and c[0] is known))
            # Not a difference of sets: that would go through all that is known.
            if fresh := [w for w in self.last[k] if w not in known]:
                self.learn(known, fresh, together)
        for t, c in zip(texts, cut, strict=True):
            out.append(self.ids(t) if c is None else b"".join(map(c[0].__getitem__, c[1])))
        return out


def _members(category: str) -> str:
    """The plain code points of a category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == category)


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about _CHUNK characters, cut at spaces."""
    begin = 0
    while len(text) - begin > _CHUNK:
        end = text.find(" ", begin + _CHUNK)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


def width(spec: str) -> str:
    return "<u2" if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else "<u4"


def _encoded(encoder: WordEncoder, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text; about _CHUNK characters are cut up at a time."""
    held, size = [], 0
    for t in texts:
        t = t or ""
        if len(t) > 2 * _CHUNK:
            yield from encoder.encode(held)
            held, size = [], 0
            yield b"".join(encoder.encode([part])[0] for part in (stretches(t) if encoder.by_word else [t]))
            continue
        held.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield from encoder.encode(held)
            held, size = [], 0
    yield from encoder.encode(held)


_encoders: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def write_token_records(docs: DataFrame, tokenizer_file: str, out: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes docs as shards under out (default: a fresh path in the shared
    folder) and returns that path and one row per shard: (shard, n_docs,
    n_ids). Running it is one Spark job; what comes to the driver is that row
    per shard. end_id is appended to each document. A null text is empty: its
    record holds the end id alone. A null id sorts first; rows with the same id
    sort by text. Other columns are not read. An empty docs gives no shard.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-records")
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fs, root = pyarrow.fs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype, index, ids, at = _encoder(spec.value), width(spec.value), [], [], 0
        end = np.array([end_id], dtype=dtype).tobytes()
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        shard = temporary = stream = None
        pending, size = [], 0
        for batch in batches:
            shards, keys, texts = (c.to_pylist() for c in batch.columns)
            for shard_no, doc_id, encoded in zip(shards, keys, _encoded(encoder, texts), strict=True):
                if stream is None:
                    shard = f"{root}/shard-{shard_no:06d}"
                    temporary = f"{shard}.{uuid.uuid4().hex}.tmp"
                    stream = fs.open_output_stream(temporary)
                payload = encoded + end
                record = frame(payload)
                index.append((at, len(payload) // len(end)))
                ids.append(doc_id)
                at += len(record)
                pending.append(record)
                size += len(record)
                if size >= _FLUSH:
                    stream.write(b"".join(pending))
                    pending, size = [], 0
        if stream is None:
            return
        stream.write(b"".join(pending))
        stream.close()
        table = np.array(index, dtype="<i8").reshape(-1, 2)
        for name, data in (("idx", table.tobytes()), ("ids", pa.BufferOutputStream())):
            part = f"{temporary}.{name}"
            if name == "ids":
                keys = pa.record_batch([pa.array(ids, batch.schema.field(1).type)], names=["id"])
                with pa.ipc.new_stream(data, keys.schema) as w:
                    w.write_batch(keys)
                data = data.getvalue()
            with fs.open_output_stream(part) as f:
                f.write(data)
            fs.move(part, f"{shard}.{name}")
        fs.move(temporary, f"{shard}.rec")
        yield pa.RecordBatch.from_arrays([pa.array([shard_no], pa.int32()), pa.array([len(table)], pa.int64()), pa.array([int(table[:, 1].sum())], pa.int64())], names=["shard", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The beginning of the text deals out rows of one id, in the order of texts.
    dealt = rows.repartitionByRange(partitions(spark), "id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text").select(F.spark_partition_id().alias("shard"), "id", "text")
    shards = dealt.mapInArrow(write, "shard int, n_docs bigint, n_ids bigint").collect()
    return out, spark.createDataFrame(sorted(shards), "shard int, n_docs bigint, n_ids bigint")


def read_token_records(spark, out: str, shards: DataFrame, tokenizer_file: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each record under out. start
    counts the ids of all records before it; ids_crc32 is the crc32 of the ids
    as little-endian unsigned 32-bit integers. Every checksum is verified."""
    with open(tokenizer_file, encoding="utf-8") as f:
        dtype = width(f.read())
    counts = sorted(shards.collect())  # a row per shard
    starts = np.concatenate([[0], np.cumsum([c["n_ids"] for c in counts])]).tolist()
    listed = spark.createDataFrame([(c["shard"], s) for c, s in zip(counts, starts)], "shard int, start bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/shard-{shard:06d}"
                with fs.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)
                with fs.open_input_stream(f"{path}.ids") as f:
                    keys = pa.ipc.open_stream(f).read_all().column(0).combine_chunks()
                crcs = []
                with fs.open_input_stream(f"{path}.rec") as f:
                    for offset, n in index:
                        payload, _ = unframe(f.read(int(n) * int(dtype[-1]) + 16))
                        ids = np.frombuffer(payload, dtype=dtype)
                        if len(ids) != n:
                            raise ValueError(f"{path} at {offset}: {len(ids)} ids, {n} in the index")
                        crcs.append(zlib.crc32(ids.astype("<u4")))
                first = start + np.cumsum(index[:, 1]) - index[:, 1]
                if isinstance(keys, pa.ChunkedArray):
                    keys = pa.concat_arrays(keys.chunks)
                whole = pa.RecordBatch.from_arrays([keys, pa.array(first, pa.int64()), pa.array(index[:, 1], pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                for k in range(0, len(whole), 10_000):
                    yield whole.slice(k, 10_000)

    tasks = listed.repartition(max(1, min(len(counts), partitions(spark))), "shard") if counts else listed
    return tasks.mapInArrow(read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def token_records(docs: DataFrame, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as token records and reads the files back; see
    `write_token_records` and `read_token_records`."""
    out, shards = write_token_records(docs, tokenizer_file, None, end_id, id_col, text_col)
    return read_token_records(docs.sparkSession, out, shards, tokenizer_file, docs.schema[id_col].dataType.simpleString(), id_col)
