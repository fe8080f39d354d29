"""Spelling variants of words: near words by finite-state composition, forms by frequency, and their roots.

1. The words of whole texts are counted: runs of letters, A-Z lower-cased. In one of `every` of them, by a hash of
   document and run, one symbol is left out, which plants misspellings.
2. Two words that differ by one inserted, deleted or replaced symbol share their first FRONT symbols, or else all after
   those: at least BACK at the end. So the words are dealt twice, by their start and, reversed, by their end. A start is
   the partition's state of the composition acceptor - one-edit transducer - acceptor that it goes on from; each task
   builds the minimised acceptor of its starts' words and enumerates what the composition accepts from there
   (acceptor.py). Pairs of the second pass that share the first FRONT symbols belong to the first and are left out.
3. A start of more than `limit` words goes one symbol on, again and again: the composition's step at that symbol is done
   by a join of what is left after the edit, and longer starts take the rest. So no task gets the words of a hot start.
4. No pairs leave a task: per word their number, and the most frequent near word. A word's form is that one if it is
   `ratio` times as frequent; its root is found by following forms, doubling the way in each round.

Null texts have no words; a null doc_id is hashed as an empty one. Repeated rows count again. Words of any length are
taken. Ties of frequency go to the word that is first by code points. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.acceptor import Acceptor
from topicspark.llm.common import ascii_lower, release, stored, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = 7, 2, 31, 10
FRONT, BACK = 3, 4  # a word of 7 symbols with an edit in its first 3 keeps 4 at its end
LIMIT = 200_000  # words of a task and of a start
FOUND = "word string, n_near long, best struct<less: long, near: string>"


def spelled(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the words of at least so many symbols and occurrences."""
    run = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(run).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    marked = runs.select("run", F.crc32(ident.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    counted = marked.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _composed(dealt: DataFrame, tasks: int, reverse: bool) -> DataFrame:
    """FOUND of the words (word, n, start): pairs of a start, each with the words as they are or reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("word", pa.string()), ("n", pa.int64()), ("start", pa.string())]))
        if not table.num_rows:
            return
        words, starts = table.column("word").to_pylist(), table.column("start").to_pylist()
        read = [w[::-1] for w in words] if reverse else words
        order = sorted(range(len(words)), key=read.__getitem__)
        words, read = [words[i] for i in order], [read[i] for i in order]
        least = np.array([len(starts[i]) for i in order])
        n = table.column("n").to_numpy()[order]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        names: dict[str, int] = {}
        front = np.array([names.setdefault(w[:FRONT], len(names)) for w in words])
        # of two near words the more frequent is better, then the first: both in one order
        better = np.empty(len(words), np.int64)
        better[np.lexsort((-rank, n))] = np.arange(len(words))
        near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for i, j in Acceptor(read).near_pairs(least):
            if reverse:
                apart = front[i] != front[j]
                i, j = i[apart], j[apart]
            for x, y in ((i, j), (j, i)):
                near += np.bincount(x, minlength=len(words))
                np.maximum.at(best, x, better[y])
        by = np.empty(len(words), np.int64)
        by[better] = np.arange(len(words))
        found = np.flatnonzero(near)
        top = by[best[found]]
        best_near = pa.StructArray.from_arrays([pa.array(-n[top]), pa.array([words[i] for i in top], pa.string())], ["less", "near"])
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in found], pa.string()), pa.array(near[found]), best_near], ["word", "n_near", "best"])

    return dealt.select("word", "n", "start").repartition(tasks, "start").mapInArrow(run, FOUND)


def _edit_here(hot: DataFrame, reverse: bool) -> DataFrame:
    """FOUND of the pairs of a start (word, n, start) whose edit is the symbol right after the start.

    What is left of both words after the edit is the same, so they meet by start and rest. A meeting has at most one word
    per symbol and one whose rest is all that follows the start.
    """
    read = F.reverse("word") if reverse else F.col("word")
    size = F.length("start")
    symbol = F.substring(read, size + 1, F.lit(1))
    entry = lambda edited: F.struct(F.lit(edited).alias("edited"), symbol.alias("symbol"), "word", "n")
    without = hot.where(F.length("word") > size).select("start", F.substring(read, size + 2, F.length("word")).alias("rest"), entry(True).alias("e"))
    whole = hot.select("start", F.substring(read, size + 1, F.length("word")).alias("rest"), entry(False).alias("e"))
    met = without.union(whole).groupBy("start", "rest").agg(F.collect_list("e").alias("met")).where(F.size("met") > 1)
    one = met.select("met", F.explode("met").alias("x"))
    # two left out at the same place are no pair but both replaced; of the two ways to see a pair one has an edited word
    other = F.filter("met", lambda y: (y["symbol"] != F.col("x.symbol")) & (y["edited"] | F.col("x.edited")))
    if reverse:
        other = F.filter(other, lambda y: F.substring(y["word"], 1, FRONT) != F.substring(F.col("x.word"), 1, FRONT))
    best = F.array_min(F.transform("other", lambda y: F.struct((-y["n"]).alias("less"), y["word"].alias("near"))))
    told = one.select("x.word", other.alias("other")).where(F.size("other") > 0)
    return told.select("word", F.size("other").cast("long").alias("n_near"), best.alias("best"))


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best) of the words (word, n) that have near words, which are written tables of distinct words."""
    found = None
    for reverse, length in ((False, FRONT), (True, BACK)):
        read = F.reverse("word") if reverse else F.col("word")
        left, parts = words, []
        while True:
            dealt = left.withColumn("start", F.substring(read, 1, length))
            sizes = dealt.groupBy("start").agg(F.count(F.lit(1)).alias("size"))
            large = stored(sizes.where(F.col("size") > limit).select("start"), "starts")
            if not large.limit(1).count():
                parts.append(dealt)
                break
            parts.append(dealt.join(large, "start", "left_anti"))
            hot = stored(dealt.join(large, "start", "left_semi"), "hot")
            here = stored(_edit_here(hot, reverse), "here")
            found = here if found is None else found.union(here)
            left, length = hot.where(F.length("word") > length).select("word", "n"), length + 1
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        tasks = max(1, -(-whole.count() // limit), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        near = _composed(whole, tasks, reverse)
        found = near if found is None else found.union(near)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last one on the way. Forms grow more frequent, so ways end."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return ways


def spelling_variants(docs: DataFrame, ratio: int = RATIO, limit: int = LIMIT, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    mark = written()
    words = stored(spelled(docs, **options), "words")
    near = stored(words.join(near_words(words, limit), "word", "left"), "near")
    form_n = -F.col("best.less")
    fits = form_n >= ratio * F.col("n")
    told = near.select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, form_n).alias("form_n"),
    )
    roots = _roots(told.where("form IS NOT NULL"))
    release(docs.sparkSession, mark, near, roots)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
