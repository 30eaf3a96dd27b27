"""Benchmark decontamination by winnowing.

The fingerprints of a text are its minimum k-gram hashes: of every W - k + 1
neighbouring k-grams (that is, of every window of W words) the least is kept.
Two texts that share W consecutive words therefore share a fingerprint at the
same place inside them, so joining fingerprints and extending each hit word by
word finds every shared window. Items of fewer than W words are one window as a
whole and are looked up by their own length.

The items are the small side. Their size is counted first; they are taken in
blocks of at most BLOCK_BYTES of text. If one block holds them all, as is usual,
it is broadcast and documents are decided where they are read, without a
shuffle. Else each block is broadcast by itself and dropped again; its pass over
the documents writes what it hits (keys, spans, item ids; no texts) to a table
in the shared folder, and at the end the tables' rows are put together by
document. So a larger benchmark costs more passes, not more memory.

Words are told apart by 64-bit hashes. Windows that are equal are looked up
once, whatever number of items or places has them, so repeated words cost no
more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.session import written
from cadenza.llm.wordhash import Words, block, mix, run_owner, runs

WINDOW = 10
GRAM = 5
#: Item text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Words of an item that stay together.
PIECE_WORDS = 1 << 16
#: Document text that is hashed at a time.
CHUNK_BYTES = 1 << 20


def least_grams(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each window: the least of its `width` k-grams."""
    if not len(starts):
        return np.empty(0, np.uint64)
    least = grams[starts]
    for j in range(1, width):
        np.minimum(least, grams[starts + j], out=least)
    return least


class Keys:
    """Where each of many hashes is among these ascending ones; -1 if nowhere."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << min(24, max(16, (len(keys) * 16).bit_length()))) - 1)
        self.seen = np.zeros(int(self.mask) + 1, dtype=bool)
        self.seen[(keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1)
        at = np.flatnonzero(self.seen[(hashes & self.mask).astype(np.int64)])
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            same = self.keys[place] == hashes[at]
            out[at[same]] = place[same]
        return out


class Windows(Keys):
    """The distinct n-word windows of some items: a place of each, and the
    number of its set of items. Windows that occur in the same items share a
    set, which is held once."""

    def __init__(self, h: np.ndarray, start: np.ndarray, item: np.ndarray, n: int):
        self.n, self.h = n, h
        key = runs(h, n)[start] if len(start) else np.empty(0, np.uint64)
        order = np.lexsort((item, key))
        key, start, item = key[order], start[order], item[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        other = new.copy()
        other[1:] |= item[1:] != item[:-1]
        super().__init__(key[new])
        self.place, self.items = start[new], item[other]
        first = np.flatnonzero(new[other])
        size = np.diff(np.append(first, len(self.items)))
        mark = np.add.reduceat(mix(self.items.astype(np.uint64) + np.uint64(1)), first) if len(first) else np.empty(0, np.uint64)
        _, one, self.set = np.unique(mix(mark ^ size.astype(np.uint64)), return_index=True, return_inverse=True)
        self.set_first, self.set_size = first[one], size[one]

    def hits(self, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, set) of the windows at these starts that an item has."""
        found = self.find(runs(h, self.n)[start]) if len(start) else np.empty(0, np.int64)
        at = np.flatnonzero(found >= 0)
        start, found = start[at], found[at]
        same = np.ones(len(at), dtype=bool)
        for j in range(self.n):
            same &= h[start + j] == self.h[self.place[found] + j]
        return start[same], self.set[found[same]]


class ItemIndex:
    """Fingerprints and windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[bytes | None], window: int, gram: int):
        words = block(texts, "alnum")
        self.ids, self.window, self.gram = ids, window, gram
        h, first = words.hashes(), words.first
        start, item = run_owner(first, window)
        self.prints = Keys(np.unique(least_grams(runs(h, gram), start, window - gram + 1)))
        self.long = Windows(h, start, item, window)
        sizes = np.diff(first)
        self.short = [Windows(h, first[:-1][sizes == n], np.flatnonzero(sizes == n), n) for n in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist()]

    def hits(self, words: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """(hit, items): whether each word of the block is hit, and (text, item
        id) of each item with a window in a text."""
        h, first = words.hashes(), words.first
        edges = np.zeros(len(h) + 1, np.int64)
        named: set[tuple[int, str]] = set()
        start, _ = run_owner(first, self.window)
        # Fingerprints that both sides have, extended to the windows they stand for.
        start = start[self.prints.find(least_grams(runs(h, self.gram), start, self.window - self.gram + 1)) >= 0]
        for windows in (self.long, *self.short):
            at, of = windows.hits(h, start if windows is self.long else run_owner(first, windows.n)[0])
            if not len(at):
                continue
            edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + windows.n, minlength=len(edges))
            text = np.searchsorted(first, at, "right") - 1
            for t, k in {*zip(text.tolist(), of.tolist(), strict=True)}:
                a = windows.set_first[k]
                named.update((t, self.ids[i]) for i in windows.items[a : a + windows.set_size[k]].tolist())
        return np.cumsum(edges)[:-1] > 0, sorted(named)


def covered(hit: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of each run of hit words, in words of the text."""
    begins = np.zeros(len(hit) + 1, dtype=bool)
    begins[first] = True
    before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
    start = np.flatnonzero(hit & (~before | begins[:-1]))
    end = np.flatnonzero(hit & (~after | begins[1:])) + 1
    text = np.searchsorted(first, start, "right") - 1
    return zip(text.tolist(), (start - first[text]).tolist(), (end - first[text]).tolist(), strict=True)


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def benchmark_blocks(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, id, text) of the items, and the number of blocks, each of at
    most BLOCK_BYTES unless one row is more. A long item is several rows, of
    which each two neighbours share window - 1 words."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [text]
                if len(text) > PIECE_WORDS:
                    words = block([text], "alnum")
                    n = len(words.start)
                    begins = range(0, max(n - window + 1, 1), PIECE_WORDS)
                    parts = [text[words.start[a] : words.end[min(a + PIECE_WORDS + window - 1, n) - 1]] for a in begins] if n else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["id", "text"])

    rows = written(rows.mapInArrow(cut, "id string, text binary").distinct(), "benchmark")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    while True:
        blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1))))
        sizes = blocks.groupBy("block").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows"))
        if n <= 1 or not sizes.filter((F.col("n") > BLOCK_BYTES) & (F.col("rows") > 1)).limit(1).count():
            return blocks, n
        n *= 2


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, hit, items) for each row of docs.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII. hit:
    the document's words that lie in an occurrence of some item's window, as
    disjoint ascending (start, end) word spans. items: ids, as strings, of the
    items with an occurring window, sorted; items with equal ids are one, a
    null id is "". A null or wordless text (of either side) matches nothing.
    id_col may be of any type, as it is only handed on. Rows with equal or null
    ids each give a row; other columns are not read. A task holds one text whole.
    """
    spark = docs.sparkSession
    spans_kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("hit", spans_kind), T.StructField("items", T.ArrayType(T.StringType()))])

    def against(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*sent.value, window, gram) if sent else None
            for batch in batches:
                texts = batch.column(1).to_pylist()
                spans: list[list] = [[] for _ in texts]
                named: list[list] = [[] for _ in texts]
                counts = np.zeros(len(texts), np.int64)
                for a, b in _chunks([len(t or b"") for t in texts], CHUNK_BYTES):
                    words = block(texts[a:b], "alnum")
                    counts[a:b] = np.diff(words.first)
                    if index is None:
                        continue
                    hit, items = index.hits(words)
                    for t, start, end in covered(hit, words.first):
                        spans[a + t].append({"start": start, "end": end})
                    for t, name in items:
                        named[a + t].append(name)
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "hit", "items"])

        return search

    blocks, n = benchmark_blocks(items, window, item_id_col, item_text_col)

    def sent(k: int):
        got = blocks.filter(F.col("block") == k).collect()
        return spark.sparkContext.broadcast(([r["id"] for r in got], [bytes(r["text"]) for r in got]))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if n <= 1:
        return rows.mapInArrow(against(sent(0) if n else None), schema).withColumnRenamed("id", id_col)
    # Rows of equal key are equal, and so is what is found in them.
    keyed = rows.select(F.struct(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), F.xxhash64("text").alias("c")).alias("id"), "text")
    by_key = T.StructType([T.StructField("id", keyed.schema["id"].dataType), *schema.fields[1:]])
    found = None
    for k in range(n):
        block_ = sent(k)
        part = written(keyed.mapInArrow(against(block_), by_key).filter("size(hit) > 0").distinct(), "benchmark-hits")
        block_.unpersist()
        found = part if found is None else found.union(part)
    merged = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.mapInArrow(_joined, merged.schema)
    counted = rows.withColumn("key", F.struct(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), F.xxhash64("text").alias("c")))
    counted = counted.select(F.struct("id", "key").alias("id"), "text").mapInArrow(against(None), T.StructType([T.StructField("id", T.StructType([schema["id"], T.StructField("key", keyed.schema["id"].dataType)])), *schema.fields[1:]]))
    joined = counted.select("id.id", "id.key", "n_words").join(merged.withColumnRenamed("id", "key"), "key", "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("hit", F.array().cast(spans_kind)).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, hit, items) with sorted spans, without overlaps or seams."""
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            held: list[dict[str, int]] = []
            for s in spans:
                if held and s["start"] <= held[-1]["end"]:
                    held[-1]["end"] = max(held[-1]["end"], s["end"])
                else:
                    held.append(s)
            out.append(held)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type), batch.column(2)], names=["id", "hit", "items"])


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs, with all columns, without the rows in which an item's window occurs."""
    text_col = options.pop("text_col", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return contaminated_spans(rows, items, id_col="row", text_col="text", **options).filter(F.size("hit") == 0).select("row.*")
