"""Document frequencies over the vertical fragments of a hash order.

The values of a document (hashes of its shingles, say) have a global order, the
hash's own. Fragments are equal ranges of it. Documents are gathered into
batches by a hash of the row; a batch sends each fragment the distinct values
it has there, packed, with the number of its documents that have each. So a
value that a third of all documents share costs one entry a batch, not one a
document. A fragment adds up the batches' counts and answers each batch with
the class of every value it sent: floor(log2(documents)), 0 for values of one
document.

Inside a fragment 32 bits tell values apart. Two values that collide there get
the class of their sum: classes may be too high, never too low, for about one
value in a thousand at a few million values a fragment; callers use them only
to order values and to leave out those of class 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.session import partitions
from cadenza.llm.wordhash import Words, block

#: Text that is hashed at a time.
CHUNK_BYTES = 1 << 20
#: Batches for each shuffle partition.
BATCHES = 4
#: A block of words -> (values, text of each), not yet distinct.
Extract = Callable[[Words], tuple[np.ndarray, np.ndarray]]
ANSWER = "batch int, fragment int, key binary, class binary"


def batched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, id, text, hash): the text as bytes, and its hash. The batch is a
    hash of the row, so it holds the same rows whenever it is made again."""
    n = BATCHES * partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("batch"), "id", "text", F.xxhash64("text").alias("hash"))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if total and total + n > CHUNK_BYTES:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def doc_values(texts: list[bytes | None], kind: str, extract: Extract) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, and the offset of each text's."""
    values, counts = [], []
    for a, b in chunks(texts):
        v, owner = extract(block(texts[a:b], kind))
        order = np.lexsort((v, owner))
        v, owner = v[order], owner[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (owner[1:] != owner[:-1])
        values.append(v[new])
        counts.append(np.bincount(owner[new], minlength=b - a))
    if not values:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes each as the greatest needs: 1, 2 or 4."""
    most = int(values.max()) if len(values) else 0
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def split_value(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, key in it) of values."""
    fragment = ((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return fragment.astype(np.int64), values.astype(np.uint32)


def classes(batches: DataFrame, kind: str, extract: Extract) -> DataFrame:
    """The fragments' answers to the batches of `batched`: see ANSWER."""
    n = partitions(batches.sparkSession)

    def send(table: pa.Table) -> pa.Table:
        values, _ = doc_values(table.column("text").to_pylist(), kind, extract)
        fragment, key = split_value(values, n)
        packed, count = np.unique((fragment.astype(np.uint64) << np.uint64(32)) | key, return_counts=True)
        fragment, key = (packed >> np.uint64(32)).astype(np.int64), packed.astype(np.uint32)
        edge = np.flatnonzero(np.diff(fragment, prepend=-1, append=n))
        parts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        return pa.table(
            {
                "fragment": pa.array([int(fragment[a]) for a, _ in parts], pa.int32()),
                "batch": pa.array([table.column("batch")[0].as_py()] * len(parts), pa.int32()),
                "key": pa.array([key[a:b].tobytes() for a, b in parts], pa.binary()),
                "count": pa.array([narrow(count[a:b]).tobytes() for a, b in parts], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(b, "<u4") for b in table.column("key").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, f"<u{len(b) // len(k)}") for b, k in zip(table.column("count").to_pylist(), keys, strict=True)])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts)
        found = np.floor(np.log2(total)).astype(np.uint8)[place]
        ends = np.cumsum([len(k) for k in keys])
        # Only what more than one document has is worth an answer.
        out = [(k[c > 0].tobytes(), c[c > 0].tobytes()) for k, c in ((k, found[e - len(k) : e]) for k, e in zip(keys, ends, strict=True))]
        return pa.table({"batch": table.column("batch"), "fragment": table.column("fragment"), "key": pa.array([k for k, _ in out], pa.binary()), "class": pa.array([c for _, c in out], pa.binary())})

    sent = batches.groupBy("batch").applyInArrow(send, "fragment int, batch int, key binary, count binary")
    return sent.groupBy("fragment").applyInArrow(answer, ANSWER)


def looked_up(values: np.ndarray, answers: pa.Table, n: int) -> np.ndarray:
    """The class of each value, from the answers to its batch."""
    out = np.zeros(len(values), np.uint8)
    if not len(values) or not answers.num_rows:
        return out
    fragments = answers.column("fragment").to_pylist()
    keys = [np.frombuffer(b, "<u4") for b in answers.column("key").to_pylist()]
    found = np.concatenate([np.frombuffer(b, np.uint8) for b in answers.column("class").to_pylist()])
    known = np.concatenate([(np.uint64(f) << np.uint64(32)) | k for f, k in zip(fragments, keys, strict=True)])
    order = np.argsort(known, kind="stable")
    known, found = known[order], found[order]
    if not len(known):
        return out
    fragment, key = split_value(values, n)
    packed = (fragment.astype(np.uint64) << np.uint64(32)) | key
    at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
    same = known[at] == packed
    out[same] = found[at[same]]
    return out


