"""Exact BM25 top-k by block-max WAND over sharded inverted indexes.

Documents are dealt into shards by a hash of the row; each shard's inverted
index (postings by term; documents in blocks of BLOCK neighbours) is one row of
a table in the shared folder. Queries are packed into blocks of bounded size,
with the inverse document frequencies of their terms over all shards, so every
shard scores with the global statistics. A block of queries is a file in the
shared folder, which the tasks that hold a shard read: neither queries nor
results pass the driver.

In a shard, pruning goes by upper bounds, as in WAND, for all documents at once.
Of words that many of the shard's documents have, which hold most of a query's
postings, the weights are kept by document too. A query's words of this kind are
sorted by their greatest contributions to a score; those that together stay
below the floor can't lift a document above it alone, so only documents with
another term are looked at. Of these the blocks' own greatest contributions say
which can still reach the floor, and only they are scored by the weak terms:
bounds of blocks and scores of documents are products with a matrix, and no
posting of a weak term is read. What a block of queries asks for is looked up in
a shard once, not query by query.

Shards are searched in rounds, for each block of queries first 1 shard, then 3,
12, 48 and so on, another shard for each block to begin with. After a round the
k best so far of a query give it a floor, a (score, id) that the k-th best of
all can't be behind. Shards send only what is before the floor: about 3 k rows
a round, so the rows of a query grow with the logarithm of the shards, not with
the shards.

Inside a shard documents are ordered by their most frequent word, which brings
texts of one language together and makes bounds tight. Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.fragments import chunks, narrow, split_value
from cadenza.llm.session import fresh_path, partitions, written
from cadenza.llm.wordhash import block

K1, B = 1.2, 0.75
BLOCK = 64
#: A word in more than one of so many documents of a shard is kept by document.
OFTEN = 10
#: Query text in a block, of which each query counts as some bytes at least;
#: and the least number of blocks, which are searched side by side.
QUERY_BYTES, QUERY_LEAST, QUERY_BLOCKS = 16 << 20, 1 << 12, 32
#: Each round searches so many times the shards of all rounds before.
GROWTH = 3
#: Scores round to the same 4 decimals only within one step of them; and float error.
_SLACK = 1e-4 + 1e-6
#: The place of a null id: before all others.
_FIRST = -(1 << 63)
HIT = "block int, q int, query_id bigint, doc bigint, score double"


def term_counts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of distinct terms, by text then term; text lengths."""
    parts = [(np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64))]
    for i, j in chunks(texts):
        words = block(texts[i:j], "alnum")
        n = np.diff(words.first)
        text = np.repeat(np.arange(i, j, dtype=np.int32), n)
        h = words.hashes()
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        parts.append((text[at], h[at], np.diff(np.append(at, len(h))).astype(np.int32), n))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _wide(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1")


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per shard: (shard, n_docs, n_words, and packed: ids, lengths, terms,
    starts, docs, counts). Rows without words are left out: nothing finds them,
    but n_docs counts them."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").fill_null(_FIRST).to_numpy()
        text, term, count, lengths = term_counts(table.column("text").to_pylist())
        # Neighbours: texts with the same most frequent word (by some bits of its
        # hash, below those of the count), then by length.
        top = np.zeros(len(ids), np.uint64)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        if len(first):
            rank = (count.astype(np.uint64) << np.uint64(32)) | (term >> np.uint64(32))
            top[text[first]] = np.maximum.reduceat(rank, first) & np.uint64((1 << 32) - 1)
        place = np.empty(len(ids), np.int32)
        seat = np.lexsort((ids, lengths, top))
        place[seat] = np.arange(len(ids))
        order = np.lexsort((place[text], term))
        terms, starts = np.unique(term[order], return_index=True)
        cells = (ids[seat].astype("<i8"), lengths[seat].astype("<u4"), terms.astype("<u8"), np.append(starts, len(term)).astype("<u4"), narrow(place[text][order]), narrow(count[order]))
        out = {"shard": table.column("shard").slice(0, 1), "n_docs": pa.array([len(ids)], pa.int64()), "n_words": pa.array([int(lengths.sum())], pa.int64())}
        pa.default_memory_pool().release_unused()
        return pa.table(out | {name: pa.array([c.tobytes()], pa.binary()) for name, c in zip(("ids", "lengths", "terms", "starts", "docs", "counts"), cells, strict=True)})

    return rows.groupBy("shard").applyInArrow(build, "shard int, n_docs bigint, n_words bigint, ids binary, lengths binary, terms binary, starts binary, docs binary, counts binary")


class Met(NamedTuple):
    """What a shard has of each word that a block of queries asks for."""

    have: np.ndarray
    first: np.ndarray
    n: np.ndarray
    bound: np.ndarray
    column: np.ndarray
    idf: np.ndarray


class Shard:
    """An index row, ready to be searched. It reads the row's buffers where they
    are, and holds a weight for each posting beside them; for the most frequent
    words also one for each document, of which there are no more than postings."""

    def __init__(self, row: dict[str, pa.Buffer], mean: float):
        self.ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<u4")
        self.terms, self.starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
        n, held = int(self.starts[-1]), len(self.ids)
        self.docs = _wide(row["docs"], n)
        self.weight = _wide(row["counts"], n).astype(np.float64)
        slack = (K1 * (1 - B + B * lengths / mean))[self.docs]
        slack += self.weight
        self.weight *= K1 + 1
        self.weight /= slack
        del slack
        self.term_max = np.maximum.reduceat(self.weight, self.starts[:-1]) if n else np.empty(0)
        df = np.diff(self.starts)
        often = np.flatnonzero(df * OFTEN > held)
        often = often[np.argsort(-df[often], kind="stable")[: n // max(held, 1)]]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.by_doc = np.zeros((held, len(often)))
        for j, t in enumerate(often.tolist()):
            mine = slice(self.starts[t], self.starts[t + 1])
            self.by_doc[self.docs[mine], j] = self.weight[mine]
        # The greatest weight of each frequent word in each block.
        self.block_max = np.maximum.reduceat(self.by_doc, np.arange(0, held, BLOCK)) if held else self.by_doc

    def meet(self, terms: np.ndarray, idf: np.ndarray) -> Met:
        """These words in this shard."""
        if not len(self.terms):
            none = np.zeros(len(terms), np.int64)
            return Met(none > 0, none, none, none, none, idf)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return Met(self.terms[at] == terms, self.starts[at], self.starts[at + 1] - self.starts[at], self.term_max[at] * idf, self.column[at], idf)

    def _scores(self, met: Met, words: np.ndarray) -> np.ndarray:
        """Each document's score by these words alone."""
        n = met.n[words]
        posting = np.repeat(met.first[words] - (np.cumsum(n) - n), n)
        posting += np.arange(len(posting))
        weight = self.weight.take(posting)
        weight *= np.repeat(met.idf[words], n)
        return np.bincount(self.docs.take(posting), weight, minlength=len(self.ids))

    def _rest(self, met: Met, words: np.ndarray, acc: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those whose score acc by other words can reach
        the floor with these frequent ones; the scores are by all words."""
        asked = np.zeros(self.by_doc.shape[1])
        asked[met.column[words]] = met.idf[words]
        bound = np.repeat(self.block_max @ asked, BLOCK)[: len(acc)]
        found = np.flatnonzero((acc > 0) & (acc + bound >= floor - _SLACK))
        return found, acc[found] + self.by_doc[found] @ asked

    def search(self, met: Met, words: np.ndarray, k: int, floor: float = 0.0, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rounded scores) of this shard's k best, by score and then id,
        if they are before (floor, before) in that order. words: a query's, as
        places in what was met."""
        strong = words[met.have[words]]
        weak = strong[:0]
        if floor > _SLACK:
            often = met.column[strong] >= 0
            sorted_ = strong[often]
            sorted_ = sorted_[np.argsort(met.bound[sorted_], kind="stable")]
            below = int(np.searchsorted(np.cumsum(met.bound[sorted_]), floor - _SLACK, "left"))
            weak, strong = sorted_[:below], np.concatenate([strong[~often], sorted_[below:]])
        acc = self._scores(met, strong)
        if len(weak):
            found, scores = self._rest(met, weak, acc, floor)
        else:
            found = np.flatnonzero(acc)
            scores = acc[found]
        ids, scores = self.ids[found], np.round(scores.astype(np.float64), 4)
        keep = scores >= floor if before is None else (scores > floor) | ((scores == floor) & (ids < before))
        ids, scores = ids[keep], scores[keep]
        if len(ids) > k:
            high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[high], scores[high]
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def _put(fs: pyarrow.fs.FileSystem, path: str, table: pa.Table) -> None:
    """Writes a file under its name at once, so that a task can run again."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    fs.move(temporary, path)


def _get(fs: pyarrow.fs.FileSystem, path: str) -> pa.Table | None:
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return pa.ipc.open_stream(f).read_all()


def query_blocks(index: DataFrame, queries: DataFrame, n_docs: int, out: str) -> int:
    """Writes the queries (id, text) as files: out/words-N has the words that
    block N asks for, with their inverse document frequencies, and out/block-N a
    row (id, words) of each query, its words as packed places in that list.
    Returns the number of blocks."""
    n = partitions(index.sparkSession)
    size = queries.agg(F.sum(F.length("text") + QUERY_LEAST)).first()[0] or 0
    blocks = max(QUERY_BLOCKS, -(-size // QUERY_BYTES))
    asked = queries.distinct().withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        text, term, _, _ = term_counts(table.column("text").to_pylist())
        edges = np.searchsorted(text, np.arange(table.num_rows + 1)).tolist()
        parts = [term[a:b].astype("<u8").tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"block": table.column("block"), "id": table.column("id"), "terms": pa.array(parts, pa.binary())})

    def cut(terms: np.ndarray) -> Iterator[tuple[int, slice]]:
        fragment, _ = split_value(terms, n)
        edges = np.flatnonzero(np.diff(fragment, prepend=-1, append=n)).tolist()
        return ((int(fragment[a]), slice(a, b)) for a, b in zip(edges, edges[1:]))

    def wanted(table: pa.Table) -> pa.Table:
        terms = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in table.column("terms").to_pylist()]))
        parts = [(f, terms[s].tobytes()) for f, s in cut(terms)]
        return pa.table({"fragment": pa.array([f for f, _ in parts], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()), "terms": pa.array([b for _, b in parts], pa.binary())})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                terms, df = np.frombuffer(terms.as_buffer(), "<u8"), np.diff(np.frombuffer(starts.as_buffer(), "<u4")).astype("<u4")
                parts = [(f, terms[s].tobytes(), df[s].tobytes()) for f, s in cut(terms)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[j] for p in parts], pa.binary()) for j in (1, 2))], names=["fragment", "terms", "df"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        terms = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, "<u8") for b in held.column("terms").to_pylist())])
        terms, place = np.unique(terms, return_inverse=True)
        df = np.bincount(place, np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(b, "<u4") for b in held.column("df").to_pylist())]), minlength=len(terms))
        out = []
        for b in asked.column("terms").to_pylist():
            at = np.minimum(np.searchsorted(terms, mine := np.frombuffer(b, "<u8")), max(len(terms) - 1, 0))
            out.append(np.where(terms[at] == mine, df[at], 0).astype("<i8").tobytes() if len(terms) else bytes(8 * len(mine)))
        return pa.table({"block": asked.column("block"), "terms": asked.column("terms"), "df": pa.array(out, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        get = lambda c, t: np.concatenate([np.empty(0, t), *(np.frombuffer(b, t) for b in answers.column(c).to_pylist())])
        terms, df = get("terms", "<u8"), get("df", "<i8")
        order = np.argsort(terms)
        terms, idf = terms[order], np.log1p((n_docs - df[order] + 0.5) / (df[order] + 0.5))
        places = [np.searchsorted(terms, np.frombuffer(b, "<u8")).astype("<i4").tobytes() for b in table.column("terms").to_pylist()]
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        block = table.column("block")[0].as_py()
        _put(fs, f"{root}/words-{block}", pa.table({"terms": pa.array(terms), "idf": pa.array(idf)}))
        _put(fs, f"{root}/block-{block}", pa.table({"id": table.column("id"), "words": pa.array(places, pa.binary())}))
        return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})

    packed = written(asked.groupBy("block").applyInArrow(pack, "block int, id bigint, terms binary"), "bm25-queries")
    terms = packed.groupBy("block").applyInArrow(wanted, "fragment int, block int, terms binary")
    held = index.select("terms", "starts").mapInArrow(known, "fragment int, terms binary, df binary")
    answers = terms.groupBy("fragment").cogroup(held.groupBy("fragment")).applyInArrow(answer, "block int, terms binary, df binary")
    packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "block int, n bigint").agg(F.sum("n")).first()
    return blocks


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of docs with the greatest
    BM25 scores for each row of queries (same id and text columns), fewer if
    fewer have a word of it.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII; a query is
    the set of its text's words. Scores are rounded to 4 decimals; ties go to
    the smaller id, null ids first. Queries of equal id and text are one. Null
    and wordless texts find nothing and are not found. Ids are bigint.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    index = written(build_index(docs, id_col, text_col), "bm25-index")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    state = spark.createDataFrame([], f"{HIT}, rank int")
    if total["w"]:
        mean = total["w"] / total["n"]
        out = fresh_path(spark, "bm25-blocks")
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text is not null")
        blocks = query_blocks(index, asked, total["n"], out)
        low, high = 0, 1
        while low < shards:
            found = written(index.mapInArrow(_searched(out, low, high, shards, blocks, mean, k), HIT), "bm25-found")
            merged = state.drop("rank").union(found).groupBy("block").applyInArrow(_merged(out, high, k), f"{HIT}, rank int")
            state = written(merged, "bm25-best")
            low, high = high, min(high * (GROWTH + 1), shards) if high < shards else shards + 1
    doc = F.when(F.col("doc") != _FIRST, F.col("doc"))
    return state.select("query_id", F.col("rank").cast("int").alias("rank"), doc.alias(id_col), "score")


def _searched(out: str, low: int, high: int, shards: int, blocks: int, mean: float, k: int):
    """The search of a round: of the shards by their distance from a block's
    first one, those from low to below high; floors are those of round low."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("shard")[i].as_py()
                row = {name: batch.column(name)[i].as_buffer() for name in ("ids", "lengths", "terms", "starts", "docs", "counts")}
                mine = [b for b in range(blocks) if low <= (number - b * shards // blocks) % shards < high]
                shard = Shard(row, mean) if mine else None
                for b in mine:
                    queries = _get(fs, f"{root}/block-{b}")
                    if queries is None:
                        continue
                    floor, before = np.zeros(queries.num_rows), [None] * queries.num_rows
                    floors = _get(fs, f"{root}/floor-{low}-{b}") if low else None
                    if floors is not None:
                        for q, s, d in zip(*(c.to_pylist() for c in floors.columns), strict=True):
                            floor[q], before[q] = s, d
                    met = shard.meet(*(c.to_numpy() for c in _get(fs, f"{root}/words-{b}").columns))
                    n, d, s = [], [], []
                    for q, words in enumerate(queries.column("words").to_pylist()):
                        hit, score = shard.search(met, np.frombuffer(words, "<i4"), k, floor[q], before[q])
                        n.append(len(hit))
                        d.append(hit)
                        s.append(score)
                    q = np.repeat(np.arange(len(n), dtype=np.int32), n)
                    names = queries.column("id").combine_chunks().take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), b, np.int32)), pa.array(q), names, pa.array(np.concatenate(d)), pa.array(np.concatenate(s))], names=["block", "q", "query_id", "doc", "score"])

    return search


def _merged(out: str, high: int, k: int):
    """The k best of each query of a block; writes their floors for the round
    that begins at high."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q, doc, score = (table.column(c).to_numpy() for c in ("q", "doc", "score"))
        order = np.lexsort((doc, -score, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
        order, rank = order[rank <= k], rank[rank <= k]
        last = order[rank == k]
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        _put(fs, f"{root}/floor-{high}-{table.column('block')[0].as_py()}", pa.table({"q": q[last], "score": score[last], "doc": doc[last]}))
        return table.take(pa.array(order)).append_column("rank", pa.array(rank.astype(np.int32)))

    return merge
