"""Language identification with spans for mixed-language text.

A word's script (by the code points of its letters) leaves the languages that
use this script in the training texts; each of these scores the word by its
letter n-grams. Viterbi over the words of a text, with a penalty for each
switch of language, labels every word, and runs of a label are spans.

Training counts n-grams per language on the executors; the model (languages x
buckets) is what comes to the driver, and its size does not depend on the data.
Labelling is one stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scripts as ranges of code points; a letter outside all of them is "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS) + 1
#: Labelled rows that training reads, about, in equal parts for each language
#: (all rows of one that has fewer); chosen by a hash of id and text.
TRAINING_ROWS = 20_000
#: Languages that a model can hold, each with BUCKETS counts; more raise.
MOST_LANGUAGES = 1000
BUCKETS = 1 << 16
#: Log-likelihood that a switch of language costs.
SWITCH = 12.0
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.01
#: Characters that are scored at a time, and labelled side by side.
CHUNK_CHARS, GROUP_CHARS = 1 << 18, 1 << 22

_tables: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """Code point -> 0 if not a letter, else 1 + its script."""
    if not _tables:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000).astype(np.uint8)
        table[table > 0] = OTHER
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                table[a : b + 1][table[a : b + 1] > 0] = k
        _tables.append(table)
    return _tables[0]


class Letters:
    """Words (runs of letters, lower-cased) of some texts: `start` and `end` of
    each, `first` word of each text, `script` of each word, and for each letter
    its n-gram bucket."""

    def __init__(self, texts: list[str]):
        # Lower-casing a few letters lengthens them; spans count code points of
        # the text as it is, so these stay as they are.
        lowered = [low if len(low := t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
        joined = "\n".join(lowered) + "\n"
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        script = _script_table()[self.code]
        letter = script > 0
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        self.begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.begin)
        self.script = script[self.start] if len(self.start) else np.empty(0, np.uint8)
        self.letters = script
        # A letter's n-gram: itself and the two before it, a word's edge being 0.
        c = np.where(letter, self.code, 0).astype(np.uint64)
        before = np.concatenate([[0], c[:-1]]).astype(np.uint64)
        before2 = np.where(before > 0, np.concatenate([[0, 0], c[:-2]]).astype(np.uint64)[: len(c)], 0).astype(np.uint64)
        h = (c * np.uint64(0x9E3779B97F4A7C15) ^ before * np.uint64(0xC2B2AE3D27D4EB4F) ^ before2 * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        self.bucket = (h >> np.uint64(48)).astype(np.int64)
        self.bucket2 = ((c * np.uint64(0x9E3779B97F4A7C15) ^ before * np.uint64(0x27D4EB2F165667C5)) * np.uint64(0xA0761D6478BD642F) >> np.uint64(48)).astype(np.int64)


class Model:
    """Log-likelihoods by bucket and language, and the scripts of each."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        smooth = counts + 0.5
        self.langs = langs
        self.table = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)
        self.table -= self.table.mean(1, keepdims=True)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[:, ~allowed.any(0)] = True  # a script that none has narrows nothing
        self.allowed = np.where(allowed.T, 0.0, -1e4).astype(np.float32)  # script x language

    def word_scores(self, words: Letters) -> np.ndarray:
        sums = np.empty((len(words.start), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            column = self.table[:, k]
            per = np.where(words.letters > 0, column[words.bucket] + column[words.bucket2], np.float32(0)).astype(np.float64)
            total = np.concatenate([[0.0], np.cumsum(per)])
            sums[:, k] = total[words.end] - total[words.start]
        return sums + self.allowed[words.script]

    def label(self, scores: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The language of each word, by Viterbi over each text; the texts go
        side by side, word by word. begin: the first word of each text, and the
        end. scores: of each word, for each language."""
        n = np.diff(begin)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        out = np.empty(len(scores), np.int64)
        if not len(order):
            return out
        first, n = begin[:-1][order], n[order]
        best = scores[first].copy()
        came = np.empty(scores.shape, np.int16)
        live = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # texts longer than t words
        own = np.arange(len(self.langs), dtype=np.int16)
        for t in range(1, int(n[0])):
            m = live[t]
            at = first[:m] + t
            top = best[:m].argmax(1)
            switched = best[np.arange(m), top] - SWITCH
            stay = best[:m] >= switched[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best[:m] = np.where(stay, best[:m], switched[:, None]) + scores[at]
        now = best.argmax(1)
        for t in range(int(n[0]) - 1, 0, -1):
            m = live[t]
            at = first[:m] + t
            out[at] = now[:m]
            now[:m] = came[at, now[:m]]
        out[first] = now
        return out


def _stretches(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text in parts of about CHUNK_CHARS, cut at spaces."""
    begin = 0
    while len(text) - begin > 2 * CHUNK_CHARS:
        end = text.find(" ", begin + CHUNK_CHARS)
        if end < 0:
            break
        yield begin, text[begin:end]
        begin = end
    yield begin, text[begin:]


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about this many characters together."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> Model | None:
    """A model of the labelled rows of docs (null labels and texts are left
    out), or None if there are none. About `rows` of them, chosen by a hash of
    id and text, are read, whole; every language has an equal part, so a rare
    one is learned whatever the others' sizes. Of more than MOST_LANGUAGES
    labels those with the most rows are learned, by name where equal; the others
    are predicted for no text."""
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    frequent = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1)
    sizes = {r["lang"]: r["count"] for r in frequent.collect()}
    if len(sizes) > MOST_LANGUAGES:
        sizes.popitem()
        labelled = labelled.filter(F.col("lang").isin(list(sizes)))
    part = {lang: rows / len(sizes) / n for lang, n in sizes.items()}
    if any(p < 1 for p in part.values()):
        share = F.create_map(*[F.lit(x) for lang, p in part.items() for x in (lang, min(1.0, p))])[F.col("lang")]
        labelled = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 52)) < share * (1 << 52))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lang in set(langs):
                mine = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                for i, j in _chunks(mine, CHUNK_CHARS):
                    for group in [[t] for _, t in _stretches(mine[i])] if j - i == 1 else [mine[i:j]]:
                        words = Letters(group)
                        inside = words.letters > 0
                        grams = np.bincount(words.bucket[inside], minlength=BUCKETS) + np.bincount(words.bucket2[inside], minlength=BUCKETS)
                        counts[lang] = counts.get(lang, 0) + grams
                        scripts[lang] = scripts.get(lang, 0) + np.bincount(words.letters[inside], minlength=OTHER + 1)
        for lang in counts:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts[lang].astype("<i8").tobytes()], pa.binary()), pa.array([scripts[lang].astype("<i8").tobytes()], pa.binary())], names=["lang", "grams", "scripts"])

    def add(table: pa.Table) -> pa.Table:
        total = [np.sum([np.frombuffer(b, "<i8") for b in table.column(c).to_pylist()], axis=0).astype("<i8").tobytes() for c in (1, 2)]
        return pa.table({"lang": [table.column(0)[0].as_py()], "grams": pa.array([total[0]], pa.binary()), "scripts": pa.array([total[1]], pa.binary())})

    schema = "lang string, grams binary, scripts binary"
    counted = labelled.mapInArrow(count, schema)
    # In two steps, so that no task gets the counts of all tasks for a language.
    for part in (F.pmod(F.spark_partition_id(), F.lit(16)), F.lit(0)):
        counted = counted.withColumn("part", part).groupBy("lang", "part").applyInArrow(lambda table: add(table.drop_columns(["part"])), schema)
    got = sorted(counted.collect())
    if not got:
        return None
    return Model([r["lang"] for r in got], np.stack([np.frombuffer(r["grams"], "<i8") for r in got], 1).astype(np.float64), np.stack([np.frombuffer(r["scripts"], "<i8") for r in got]).astype(np.float64))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of docs, then `_lang_pred`, `_score` and `_spans`.

    _lang_pred: the language with most letters by label; "und" if the text is
    null, has no letter, or there is no model. _score: its share of the letters
    (0 for "und"). _spans: (start, end, lang) in code points, from the first to
    the last letter of each run of a label. Ties go to the lesser language code.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = spark.createDataFrame([], "_lang_pred string, _score double, _spans array<struct<start:int,end:int,lang:string>>").schema
    out_schema = type(docs.schema)([*docs.schema.fields, *schema.fields])
    at = docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for low, high in _chunks(texts, GROUP_CHARS) if model else ():
                parts = []
                for i, j in _chunks(texts[low:high], CHUNK_CHARS):
                    for shift, group in ([(o, [t]) for o, t in _stretches(texts[low + i])] if j - i == 1 else [(0, texts[low + i : low + j])]):
                        words = Letters(group)
                        text = np.repeat(np.arange(i, j), np.diff(words.first))
                        origin = words.begin[text - i] - shift
                        parts.append((model.word_scores(words), text, words.start - origin, words.end - origin))
                word_scores, text, start, end = (np.concatenate(p) for p in zip(*parts, strict=True))
                labels = model.label(word_scores, np.searchsorted(text, np.arange(high - low + 1)))
                letters = np.bincount(text * len(model.langs) + labels, weights=end - start, minlength=(high - low) * len(model.langs)).reshape(-1, len(model.langs))
                top, total = letters.argmax(1), letters.sum(1)
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0)) if len(text) else np.empty(0, np.int64)
                last = np.append(new[1:], len(text))[: len(new)] - 1
                for k, a, b, name in zip(text[new].tolist(), start[new].tolist(), end[last].tolist(), labels[new].tolist(), strict=True):
                    spans[low + k].append({"start": a, "end": b, "lang": model.langs[name]})
                for k in np.flatnonzero(total).tolist():
                    langs[low + k] = model.langs[top[k]]
                    scores[low + k] = float(letters[k, top[k]] / total[k])
            columns = [*batch.columns, pa.array(langs), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out_schema])

    return docs.mapInArrow(label, out_schema)


def held_out(id_col: str = "doc_id"):
    """Rows never trained on: crc32 of the id as text is 2 modulo 4 (null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row of docs: trained on
    its labelled rows that are not held out, applied to all. A null id, text or
    label is allowed; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.filter(~held_out("id")), "id", "text", "lang")
    found = identify(rows.select("id", "text"), model)
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def recognised(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, with all columns, without the rows that have no language ("und")
    or none with at least the share `least` of their letters."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(docs.toDF(*plain), model, text_col=plain[docs.columns.index(text_col)])
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_score") >= least)).select(*plain).toDF(*docs.columns)
