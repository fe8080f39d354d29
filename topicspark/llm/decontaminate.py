"""Benchmark decontamination: which words of a document lie in a run of words that a benchmark item has too.

A word is a longest run of letters and digits after lower-casing A-Z; every character beyond ASCII counts as a letter.
An item gives a window for each `window` consecutive words; an item of fewer words is one window. All windows go into
one Aho-Corasick automaton, and each text passes it once. The automaton reads the text's words joined by single
spaces; where something is found, the words' places are mapped back to character offsets of the original text.

The automaton is built in each Python worker from the items, which the driver collects. It takes some 600 bytes per
character of the benchmark, so it holds at most about `part_chars` characters. A larger benchmark is cut into pieces,
items of any length too, and dealt to several automata: the texts pass one after the other, and what the earlier ones
hit goes along with each text as a written column, so driver and workers hold one part at a time. The result is that of
one automaton. With `max_chars` a call fails beyond that size instead.

Null texts and texts without words have no words and no hits. Items without words have no window. Items of a null id
count as contamination, but cannot be named. Repeated items and documents are treated one by one; an item id is named
once. An empty benchmark finds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import release, stored, written

WINDOW = 13
PART_CHARS = 1 << 18
PIECE = 2000  # windows of an item that stay together where the benchmark is cut
FOUND = "struct<ranges: array<struct<start: long, stop: long>>, items: array<string>>"
SCHEMA = (
    "doc_id long, n_words long, n_hit long, items array<string>, "
    "spans array<struct<start: long, stop: long>>, contaminated boolean"
)
_KEPT = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_AUTOMATA: dict = {}


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def windows(items: list[tuple], size: int) -> dict[str, set]:
    """Each distinct window, as ` word word ... `, with the ids of its items."""
    found: dict[str, set] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(" " + b" ".join(w[i : i + size]).decode() + " ", set()).add(item_id)
    return found


class Scanner:
    """All windows in one automaton; its values are (length in characters, item ids)."""

    def __init__(self, items: list[tuple], size: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, ids in windows(items, size).items():
            self.automaton.add_word(text, (len(text), ids))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str | None):
        """(number of words, flags of hit words, ids of items found)."""
        w = words(text)
        if not w or self.empty:
            return len(w), None, ()
        joined = (b" " + b" ".join(w) + b" ").decode()
        found = list(self.automaton.iter(joined))
        if not found:
            return len(w), None, ()
        lengths = np.fromiter((len(x.decode()) for x in w), np.int64, len(w))
        starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]])
        last = np.fromiter((end for end, _ in found), np.int64, len(found))
        size = np.fromiter((value[0] for _, value in found), np.int64, len(found))
        a = np.searchsorted(starts, last - size + 2)
        b = np.searchsorted(starts, last)  # the word after the window would start one further on
        step = np.bincount(a, minlength=len(w) + 1) - np.bincount(b, minlength=len(w) + 1)
        ids = set().union(*(value[1] for _, value in found))
        return len(w), np.cumsum(step[: len(w)]) > 0, ids


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original text of each run of hit words."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in _runs(hit)]


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """The items cut so that each window is whole in one piece, and no piece has another window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for a in range(0, max(1, len(w) - window + 1) if w else 0, PIECE):
                    piece = b" ".join(w[a : a + PIECE + window - 1]).decode()
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([piece])], ["item_id", "text"])

    return items.mapInArrow(run, "item_id string, text string")


def _parts(docs: DataFrame, benchmark: DataFrame, window: int, max_chars: int | None, part_chars: int):
    """(number of automata, i -> a function that gives the Python worker's scanner for the i-th of them)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if max_chars is not None and size > max_chars:
        raise ValueError(f"the benchmark has {size} characters; at most {max_chars} are allowed")
    parts = max(1, math.ceil(size / part_chars))
    if parts > 1:
        items = stored(_pieces(items, window), "benchmark")

    def part(i: int) -> Callable[[], Scanner]:
        mine = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == i) if parts > 1 else items
        held = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=str)
        key = hashlib.sha256(repr((window, held)).encode()).hexdigest()
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def scanner() -> Scanner:
            if key not in _AUTOMATA:
                _AUTOMATA.clear()
                _AUTOMATA[key] = Scanner(sent.value, window)
            return _AUTOMATA[key]

        return scanner

    return parts, part


def _looked(scanner: Scanner, text: str | None, before: dict | None):
    """As Scanner.scan, with what earlier automata have found in the text."""
    n, hit, ids = scanner.scan(text)
    if before and before["ranges"]:
        hit = np.zeros(n, bool) if hit is None else hit
        for r in before["ranges"]:
            hit[r["start"] : r["stop"]] = True
        ids = set(ids) | set(before["items"])
    return n, hit, ids


def _all_but_last(docs: DataFrame, benchmark: DataFrame, window: int, max_chars: int | None, part_chars: int):
    """(rows, name, scanner): the rows after all automata but the last, what these found in column `name`, and the last one."""
    mark = written()
    parts, part = _parts(docs, benchmark, window, max_chars, part_chars)
    if parts == 1:
        return docs, None, part(0)
    name = "_found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    rows = docs.withColumn(name, F.lit(None).cast(FOUND))

    def add(scanners: Callable[[], Scanner]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = scanners()
            for batch in batches:
                found = []
                for value, before in zip(batch.column("text"), batch.column(name).to_pylist()):
                    _, hit, ids = _looked(scanner, value.as_py(), before)
                    ranges = [] if hit is None else [{"start": a, "stop": b} for a, b in _runs(hit)]
                    found.append({"ranges": ranges, "items": list(ids)})
                at = batch.schema.get_field_index(name)
                yield batch.set_column(at, name, pa.array(found, batch.schema.field(at).type))

        return run

    for i in range(parts - 1):
        scanner = part(i)
        done = stored(rows.mapInArrow(add(scanner), rows.schema), "scanned")
        if i < parts - 2:
            rows = done
            continue
        last = part(parts - 1)
        release(docs.sparkSession, mark, done)
        return done, name, last


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, max_chars: int | None = None, part_chars: int = PART_CHARS
) -> DataFrame:
    """Per document its words, hit words, item ids found (sorted as text), spans, and whether it is contaminated.

    Contaminated: some word is hit, and hit words are at least one in `one_in` of all.
    """
    rows, earlier, scanners = _all_but_last(docs.select("doc_id", "text"), benchmark, window, max_chars, part_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanners()
        for batch in batches:
            n_words, n_hit, names, spans = [], [], [], []
            for value, before in zip(batch.column("text"), _before(batch, earlier)):
                text = value.as_py()
                n, hit, ids = _looked(scanner, text, before)
                n_words.append(n)
                n_hit.append(0 if hit is None else int(hit.sum()))
                names.append(sorted(x for x in ids if x is not None))
                spans.append([] if hit is None else spans_of(text, hit))
            bad = [h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(names, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(bad, pa.bool_())],
                ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return rows.mapInArrow(run, SCHEMA)


def _before(batch: pa.RecordBatch, name: str | None) -> list:
    return batch.column(name).to_pylist() if name else [None] * batch.num_rows


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, max_chars: int | None = None, part_chars: int = PART_CHARS
) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    rows, earlier, scanners = _all_but_last(docs, benchmark, window, max_chars, part_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanners()
        for batch in batches:
            keep = []
            for value, before in zip(batch.column("text"), _before(batch, earlier)):
                n, hit, _ = _looked(scanner, value.as_py(), before)
                hits = 0 if hit is None else int(hit.sum())
                keep.append(not (hits > 0 and one_in * hits >= n))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select([c for c in kept.schema.names if c != earlier]) if earlier else kept

    return rows.mapInArrow(run, docs.schema)
