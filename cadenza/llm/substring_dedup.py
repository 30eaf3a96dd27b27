"""Removal of word runs that an earlier document has, by suffix automata.

An automaton of all documents would not fit anywhere, and a broadcast automaton
for each shard of them would have to meet every document: work that grows with
the square of the data. So documents and shards are matched up first.

- The anchor of a window (RUN consecutive words) is its least k-gram hash.
  Equal windows have equal anchors. The windows of a document that lie side by
  side and share an anchor are one span.
- `fragments` finds the anchors that more than one document has; only spans
  with such anchors go on. A batch of documents sends each distinct span once,
  with the smallest id that has it, to the shard that owns its anchor. So a
  passage that a third of all documents share travels once a batch.
- A shard goes through the spans of an anchor in ascending id order. It streams
  each through the suffix automaton of the spans of smaller ids: where the
  matching statistic reaches RUN, a window ends that an earlier document has.
  Then the span joins the automaton. Automata are per anchor, so they stay as
  small as the text around one repeated phrase.
- The batches get the verdicts on the spans they sent, and each document drops
  the words that its condemned windows cover.

Documents are shuffled once, by batch, and read three times from there.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.fragments import batched, chunks, classes, looked_up, split_value
from cadenza.llm.session import partitions
from cadenza.llm.wordhash import Words, block, run_owner, runs, span_hashes

RUN = 13
GRAM = 5
#: The place of a null id in the order: after all others.
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, q: int, c) -> int:
        """A state for the strings of q up to one longer than p's."""
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def matching(self, sequence: list) -> list[int]:
        """For each place, the length of the longest suffix of the sequence up
        to there that has been added."""
        state = n = 0
        out = []
        for c in sequence:
            while c not in self.next[state] and state:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            out.append(n)
        return out


class Spans:
    """The spans of a block of texts: windows `start` (first words), the anchor
    of each; spans as ranges `a`..`b` of windows; their text and content hash."""

    def __init__(self, words: Words, run: int, gram: int):
        self.h = words.hashes()
        self.start, self.text = run_owner(words.first, run)
        self.anchor = anchors_of(self.h, self.start, run, gram)
        new = np.ones(len(self.start), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        self.a = np.flatnonzero(new)
        self.b = np.append(self.a[1:], len(self.start))[: len(self.a)]
        self.first = self.start[self.a]
        self.end = self.start[self.b - 1] + run if len(self.a) else self.first
        self.key = span_hashes(runs(self.h, gram), self.first, self.end - gram + 1)


def anchors_of(h: np.ndarray, start: np.ndarray, run: int, gram: int) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    grams = runs(h, gram)
    least = grams[start].copy()
    for j in range(1, run - gram + 1):
        np.minimum(least, grams[start + j], out=least)
    return least


def verdicts(run: int, anchor: np.ndarray, doc: np.ndarray, key: np.ndarray, sequence) -> tuple[dict, np.ndarray, list]:
    """What a shard finds for its distinct spans: (key -> place), the smallest
    id of each, and for each span the windows (bools) that a smaller id has."""
    order = np.lexsort((doc, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = order[new]  # of each distinct span, one with its smallest id
    first = first[np.lexsort((doc[first], anchor[first]))]
    seen: list = [None] * len(first)
    edges = np.flatnonzero(np.diff(anchor[first].astype(np.int64), prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo == 1:
            continue
        automaton = SuffixAutomaton()
        for _, same in itertools.groupby(range(lo, hi), key=lambda i: doc[first[i]]):
            held = []
            for i in same:
                words = sequence(first[i])
                found = automaton.matching(words)[run - 1 :] if len(automaton.next) > 1 else [0] * (len(words) - run + 1)
                seen[i] = [n >= run for n in found]
                if not all(seen[i]):
                    held.append(words)
            for words in held:
                automaton.add(words)
    return first, doc[first], seen


def deduplicated(docs: DataFrame, run: int = RUN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept) for each row of docs.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. kept is
    the words that are left, joined by one space. A word goes if a window of
    `run` words that covers it also starts in a document with a smaller id;
    what other documents lose does not matter. A null text has no words. A null
    id counts as larger than every other; rows with equal ids (or null ones) do
    not remove each other's words. Other columns are not read. Ids are bigint.
    """
    rows = batched(docs, id_col, text_col)
    n = partitions(docs.sparkSession)

    def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
        start, text = run_owner(words.first, run)
        return anchors_of(words.hashes(), start, run, gram), text

    answers = classes(rows, "nonspace", anchors)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        anchor, doc, key, sizes, words = [], [], [], [], []
        if table.num_rows and answers.num_rows:
            texts = table.column("text").to_pylist()
            ids = table.column("id").fill_null(LAST).to_numpy()
            for i, j in chunks(texts):
                spans = Spans(block(texts[i:j], "nonspace"), run, gram)
                shared = np.flatnonzero(looked_up(spans.anchor[spans.a], answers, n) > 0)
                size = (spans.end - spans.first)[shared]
                at = np.repeat(spans.first[shared] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                anchor.append(spans.anchor[spans.a[shared]])
                doc.append(ids[i:j][spans.text[spans.a[shared]]])
                key.append(spans.key[shared])
                sizes.append(size)
                words.append(spans.h[at])
        if not anchor:
            return pa.table({name: pa.array([], t) for name, t in sent_kinds.items()})
        anchor, doc, key, sizes, words = (np.concatenate(x) for x in (anchor, doc, key, sizes, words))
        offset = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((doc, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        kept = order[new]
        fragment, short = split_value(anchor[kept], n)
        kept, fragment, short = (x[np.argsort(fragment, kind="stable")] for x in (kept, fragment, short))
        out = {name: [] for name in sent_kinds}
        edges = np.flatnonzero(np.diff(fragment, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = kept[lo:hi]
            size = sizes[mine]
            at = np.repeat(offset[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            names, index = np.unique(words[at], return_inverse=True)
            parts = (short[lo:hi], doc[mine].astype("<i8"), key[mine], size.astype("<u4"), names, index.astype("<u2" if len(names) <= 1 << 16 else "<u4"))
            for name, value in zip(sent_kinds, (int(fragment[lo]), table.column("batch")[0].as_py(), *(p.tobytes() for p in parts)), strict=True):
                out[name].append(value)
        return pa.table({name: pa.array(out[name], t) for name, t in sent_kinds.items()})

    def judge(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(b, t) for b in table.column(c).to_pylist()]
        anchors_, docs_, keys, sizes, names = get("anchor", "<u4"), get("doc", "<i8"), get("key", "<u8"), get("size", "<u4"), get("names", "<u8")
        words = [w[np.frombuffer(b, "<u2" if len(w) <= 1 << 16 else "<u4")] for w, b in zip(names, table.column("words").to_pylist(), strict=True)]
        anchor, doc, key, size, words = (np.concatenate(x) for x in (anchors_, docs_, keys, sizes, words))
        offset = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        first, least, seen = verdicts(run, anchor, doc, key, lambda i: words[offset[i] : offset[i + 1]].tolist())
        by_key = np.argsort(key[first], kind="stable")
        known = key[first][by_key]
        out_least, out_seen = [], []
        for k, s in zip(keys, sizes, strict=True):
            place = by_key[np.searchsorted(known, k)]
            out_least.append(least[place].astype("<i8").tobytes())
            out_seen.append(b"".join(bytes(seen[p]) if seen[p] else bytes(int(m) - run + 1) for p, m in zip(place.tolist(), s.tolist(), strict=True)))
        return pa.table({"batch": table.column("batch"), "key": table.column("key"), "size": table.column("size"), "least": pa.array(out_least, pa.binary()), "seen": pa.array(out_seen, pa.binary())})

    def cut(table: pa.Table, judged: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({name: pa.array([], t) for name, t in cut_kinds.items()})
        texts = table.column("text").to_pylist()
        ids = table.column("id").fill_null(LAST).to_numpy()
        get = lambda c, t: np.concatenate([np.empty(0, t), *(np.frombuffer(b, t) for b in judged.column(c).to_pylist())])
        key, size, least, seen = get("key", "<u8"), get("size", "<u4").astype(np.int64), get("least", "<i8"), get("seen", np.uint8)
        place = np.cumsum(size - run + 1) - (size - run + 1)
        order = np.argsort(key, kind="stable")
        key, least, place = key[order], least[order], place[order]
        counts, removed, kept = [], [], []
        for i, j in chunks(texts):
            words = block(texts[i:j], "nonspace")
            gone = np.zeros(len(words.start), dtype=bool)
            if len(key) and len(words.start):
                spans = Spans(words, run, gram)
                at = np.minimum(np.searchsorted(key, spans.key), len(key) - 1)
                mine = np.flatnonzero(key[at] == spans.key)
                at, windows = at[mine], (spans.b - spans.a)[mine]
                inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                later = ids[i:j][spans.text[spans.a[mine]]] > least[at]
                condemned = np.repeat(later, windows) | (seen[np.repeat(place[at], windows) + inner] > 0)
                start = spans.start[np.repeat(spans.a[mine], windows) + inner][condemned]
                step = np.bincount(start, minlength=len(gone) + 1) - np.bincount(start + run, minlength=len(gone) + 1)
                gone = np.cumsum(step)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            lost = total[words.first[1:]] - total[words.first[:-1]]
            counts.append(np.diff(words.first))
            removed.append(lost)
            for t, m, f in zip(texts[i:j], lost.tolist(), words.first.tolist(), strict=False):
                split = (t or b"").split()
                kept.append(b" ".join(itertools.compress(split, (~gone[f : f + len(split)]).tolist()) if m else split))
        return pa.table({"id": table.column("id"), "n_words": np.concatenate(counts), "n_removed": np.concatenate(removed), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    sent_kinds = {"fragment": pa.int32(), "batch": pa.int32(), "anchor": pa.binary(), "doc": pa.binary(), "key": pa.binary(), "size": pa.binary(), "names": pa.binary(), "words": pa.binary()}
    cut_kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    sent = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(send, "fragment int, batch int, anchor binary, doc binary, key binary, size binary, names binary, words binary")
    judged = sent.groupBy("fragment").applyInArrow(judge, "batch int, key binary, size binary, least binary, seen binary")
    out = rows.groupBy("batch").cogroup(judged.groupBy("batch")).applyInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)
