"""Token ids as flat binary files.

A folder of token files holds, per part,

* `part-N.ids`      the ids of all its documents, one after the other, as unsigned little-endian integers
                    (16 bits if the vocabulary allows, else 32),
* `part-N.offsets`  64-bit offsets into them: document i is ids[offsets[i]:offsets[i + 1]],
* `part-N.docs`     the 64-bit ids of the documents, ascending over the parts and inside each; null ids come first,

and a table `manifest` with one row per part. The base of a part, that is the number of documents and tokens
before it, is a prefix sum over that table; so the parts are written side by side and no file is rewritten.

The documents are encoded where they are read; only the ids are shuffled, to the part that holds their range of
doc_id. A task writes its files under a name of its own and renames them, so a repeated or speculative task
leaves the same files.

Null texts count as empty and give the end id alone. Documents of the same id are ordered by their ids' bytes.
An empty table gives a manifest without rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHED_WORDS = 900_000  # per Python worker; a full cache is emptied
CACHED_CHARS = 48
MARK = "|"
# Latin letters that lower-case to one letter: no multiplication or division sign, no dotted capital I
NO_SPLIT = re.compile(r"[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,] ").search
MANIFEST = "part int, docs long, nulls long, tokens long, width int"
_ENCODERS: dict = {}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of words.

    For a tokenizer that drops white space, the ids of a text are those of its space-separated words in order;
    so only words not seen lately go through the library, many in a call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        same = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("The", "the")]
        self.folds = same[0] == same[1]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The library's ids of each word: many words to a call, with a mark between them that no word holds."""
        out = {}
        if self.mark is not None:
            joined = [w for w in words if MARK not in w]
            words = [w for w in words if MARK in w]
            groups = [joined[i : i + 200] for i in range(0, len(joined), 200)]
            texts = [f" {MARK} ".join(g) + f" {MARK}" for g in groups]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, self.dtype)
                ends = np.flatnonzero(ids == self.mark)
                raw, start = ids.tobytes(), 0
                for word, end in zip(group, (ends * self.width).tolist()):
                    out[word] = raw[start:end]
                    start = end + self.width
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return out | {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, found)}

    def words(self, text: str) -> list[str]:
        """Space-separated words whose ids, one after the other, are those of the text.

        Fewer distinct words mean fewer calls. So a comma or full stop between a letter and a space gets a place of
        its own, and A-Z become small letters, where neither can change the ids.
        """
        if self.folds and "<|" not in text and text.isascii():
            text = text.lower()
        text = text.replace("\n", " ")
        if self.mark is not None and not NO_SPLIT(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.words(t) for t in texts]
        fresh: set[str] = set()
        for words in lists:
            fresh.update(words)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        missing = [w for w in fresh if w not in self.known]
        short = [w for w in missing if len(w) <= CACHED_CHARS]
        self.known.update(self.learn(short))
        long = self.learn([w for w in missing if len(w) > CACHED_CHARS])
        get = {**self.known, **long}.__getitem__ if long else self.known.__getitem__
        return [b"".join(map(get, words)) for words in lists]


class TextEncoder(WordEncoder):
    """The same for any other tokenizer: whole texts through the library."""

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


def encoder(path: str, by_word: bool) -> WordEncoder:
    """One encoder per Python worker and tokenizer."""
    key = (path, by_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = (WordEncoder if by_word else TextEncoder)(path)
    return _ENCODERS[key]


def _pieces(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, cuts: list[int], by_word: bool) -> DataFrame:
    """(part, doc_id, ids): the ids as bytes, with the end id; the part by the range of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_file, by_word)
        end = np.array([end_id], tool.dtype).tobytes()
        edges = np.array(cuts, np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                doc_id = piece.column("doc_id")
                texts = [t or "" for t in piece.column("text").to_pylist()]
                at = np.searchsorted(edges, doc_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
                ids = [x + end for x in tool.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), doc_id, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "part int, doc_id long, ids binary")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))


class _PartWriter:
    """The three files of one part, under a name of the attempt until they are complete."""

    def __init__(self, folder: str, part: int):
        self.files, self.base = _open(folder)
        self.part, self.token = part, uuid.uuid4().hex
        self.kinds = {k: self.files.open_output_stream(self._name(k, True)) for k in ("ids", "offsets", "docs")}
        self.kinds["offsets"].write(np.zeros(1, "<i8").tobytes())
        self.docs = self.nulls = self.tokens = 0

    def _name(self, kind: str, own: bool) -> str:
        return f"{self.base}/" + (f"_{self.token}." if own else f"part-{self.part:06d}.") + kind

    def add(self, doc_id: pa.Array, ids: pa.Array, width: int) -> None:
        raw = ids.to_pylist()
        sizes = np.array([len(x) for x in raw], np.int64) // width
        self.kinds["ids"].write(b"".join(raw))
        self.kinds["offsets"].write((self.tokens + np.cumsum(sizes)).astype("<i8").tobytes())
        self.kinds["docs"].write(doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.docs += len(raw)
        self.nulls += doc_id.null_count
        self.tokens += int(sizes.sum())

    def close(self) -> tuple[int, int, int, int]:
        for kind, stream in self.kinds.items():
            stream.close()
            final = self._name(kind, False)
            if self.files.type_name != "local" and self.files.get_file_info(final).type != fs.FileType.NotFound:
                self.files.delete_file(final)
            self.files.move(self._name(kind, True), final)
        return self.part, self.docs, self.nulls, self.tokens


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1, parts: int | None = None, by_word: bool = True
) -> DataFrame:
    """Write the files of all documents into `folder` and return the manifest.

    `folder` is one that all executors share. `by_word` says that the tokenizer drops white space.
    `parts`: the number of files, the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    width = encoder(tokenizer_file, by_word).width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            number = batch.column("part").to_numpy()
            for part in np.unique(number):
                mine = np.flatnonzero(number == part)
                if writer is None or writer.part != part:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _PartWriter(folder, int(part))
                rows = batch.slice(int(mine[0]), len(mine))
                writer.add(rows.column("doc_id"), rows.column("ids"), width)
        if writer is not None:
            done.append(writer.close())
        if done:
            part, n, nulls, tokens = (list(x) for x in zip(*done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(nulls, pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([width] * len(part), pa.int32())],
                ["part", "docs", "nulls", "tokens", "width"],
            )

    ids = encoded(docs, tokenizer_file, end_id, cuts, by_word)
    placed = ids.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    placed.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part, with the documents and tokens before it (one row per file is all the window sees)."""
    table = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table.select(
        "*",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
    )


def _mapped(files: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system allows."""
    info = files.get_file_info(path)
    if not info.size:
        return np.zeros(0, dtype)
    if files.type_name == "local":
        return np.frombuffer(pa.memory_map(path).read_buffer(), dtype)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_token_files(spark: SparkSession, folder: str, rows: int = 2000) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit integers."""
    table = manifest(spark, folder)
    parts = max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{base}/part-{row['part']:06d}."
                ids = _mapped(files, stem + "ids", f"<u{row['width']}")
                offsets, doc_ids = _mapped(files, stem + "offsets", "<i8"), _mapped(files, stem + "docs", "<i8")
                for a in range(0, row["docs"], rows):
                    b = min(a + rows, row["docs"])
                    edge = offsets[a : b + 1]
                    wide = ids[edge[0] : edge[-1]].astype("<u4").tobytes()
                    at = (edge - edge[0]) * 4
                    held = [wide[x:y] for x, y in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:b], mask=np.arange(a, b) < row["nulls"]),
                         pa.array(row["tokens_before"] + edge[:-1]), pa.array(np.diff(edge)), pa.array(held, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    wanted = table.select("part", "docs", "nulls", "tokens_before", "width").repartition(parts)
    return wanted.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")

