"""How filters interact, over every order in which they could be applied.

With five filters there are 80 edges (set already applied, next filter) in the
lattice of subsets, and each of the 120 orders is a path of five of them. What
a document contributes to an edge depends only on which filters it fails, so
documents are first counted by (part, failures, labels); these few cells
contribute to the edges, and the edges are joined to the 600 steps of the paths.
No document is looked at once per order.

Texts stay at the scan: one row of a hash and a few flags for each document is
shuffled to its labels and to its copies.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The whole table of steps has as many rows as orders times filters.
MOST_FILTERS = 7
#: Values over which rows without an id are spread.
_SPREAD = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"

Failures = Callable[[Column], dict[str, Column]]


def standard_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: A few words, B repeated
    words, C capitals, D symbols."""
    words = F.split(F.btrim(text, F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    n_words = F.when(F.btrim(text, F.lit(_SPACE)) == "", 0).otherwise(F.size(words))
    n_distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {"A": n_words < 200, "B": (n_words > 0) & (100 * n_distinct < 50 * n_words), "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, failures: Failures = standard_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): the number of documents of each part with
    exactly these failures and labels. Bit i of mask is the i-th of failures,
    the bit after those says that a smaller id has the same text.

    A null text is empty, a null part is the empty string. A null id is smaller
    than none and has no smaller one; rows with the least id of their text are
    all no copies. A document is good or toxic if any row of labels with its id
    says so.
    """
    named = failures(F.col("text"))
    mask = F.lit(0)
    for i, failed in enumerate(named.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "part", mask.alias("own"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("same"), F.lit(_SPREAD))).otherwise(0))
    marks = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(*[F.max(F.coalesce(F.col(k) == 1, F.lit(False))).alias(k) for k in ("quality", "toxic")])
    marked = rows.join(marks.withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    flags = [F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # Rows of one document first, so that a group below has each id once.
    counted = marked.groupBy("id", "spread", "same", "part", "own", *flags).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    kinds = counted.groupBy("same", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("same"))
    fail = F.col("n_known") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).select("part", "own", "good", "toxic", "n", F.coalesce(fail, F.lit(0)).alias("copies"))
    both = F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("own") + (1 << len(named))).alias("mask"), F.col("copies").alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def lattice_edges(cells: DataFrame, k: int) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost) for each part and edge: `next` is a filter's number, `applied`
    the bits of those before it."""
    edges = [(sum(1 << i for i in s), f) for f in range(k) for r in range(k) for s in combinations([i for i in range(k) if i != f], r)]
    each = cells.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in edges])).alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("next"))
    alive, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(bit) != 0

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    return each.groupBy("part", "applied", "next").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, failures: Failures = standard_failures, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order and step: (part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    failures gives the conditions of single texts by name; `copies` names the
    filter that removes a text that a smaller id has, wherever that is and
    whether it was removed or not. step is 1, 2, ...; its filter is that
    character of filter_order. kept counts what stays after the step, removed
    what it takes, redundant what it would have taken were it not gone,
    unique_fails what fails this filter alone; shapley is what the filter
    removes summed over all orders. Names are single characters, at most
    MOST_FILTERS. See `failure_cells` for nulls and repeated ids. No documents
    give no row; other columns are not read.
    """
    names = [*failures(F.col("text")), copies]
    k = len(names)
    if k > MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < k:
        raise ValueError(f"at most {MOST_FILTERS} filters, each with a character of its own")
    edges = lattice_edges(failure_cells(docs, labels, failures, id_col, text_col, part_col), k)
    # Through an edge go as many orders as its applied filters and the rest have.
    before = F.bit_count("applied")
    through = F.element_at(F.array(*[F.lit(factorial(r) * factorial(k - 1 - r)).cast("bigint") for r in range(k)]), before + 1)
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * through).alias("shapley"))
    steps = [("".join(names[i] for i in p), j + 1, sum(1 << i for i in p[:j]), f) for p in permutations(range(k)) for j, f in enumerate(p)]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    found = edges.join(shares, ["part", "next"]).join(F.broadcast(paths), ["applied", "next"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
