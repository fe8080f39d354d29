"""Language identification by compression.

Each language has a zstandard raw-content dictionary: texts of that language, up to `dictionary` bytes. A text is cut
into blocks, each block is compressed with each dictionary, and the language whose dictionary gives the fewest bytes
in all is chosen. Only letters count: a text is lower-cased and all else becomes single spaces. Blocks keep a long
text from becoming its own dictionary; the whole text is read. Each block starts with zeros, which compress to nothing
but keep zstandard from storing a short block as it is.

The margin is the share of bytes by which the second best is larger; texts of a margin under the least one for their
length are rejected. These are learned from texts that were not put into a dictionary, and from their beginnings: the
margins of those judged rightly, and the margins that the same texts get from the dictionaries of all other languages, as
a text of an unknown language would. In each class of length the least margin lies halfway between the `foreign`
quantile of the latter and the `tail` quantile of the former; where these overlap it is the `tail` quantile, so that
plain text passes whatever its length.

Fitted on a bounded sample: `per_language` rows per language, by a hash of text and doc_id. Rows of a null language or text
teach nothing. A text that is null or has no letter is `und` with score 0, and rejected; so is every text if nothing
was learned. If two languages give the same size, the first in order of name is chosen, with margin 0.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded_sample, in_fold

PER_LANGUAGE, DICTIONARY, BLOCK = 600, 96 << 10, 4096
TAIL, FOREIGN = 0.003, 0.98
LENGTHS = (40, 100, 250, 700)  # bytes; borders of the classes of length
PAD = bytes(64)
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, margin double, accepted boolean"
_OTHER = re.compile(r"[\W\d_]+").sub
_TOOLS: dict = {}


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    least: tuple[float, ...]  # by class of length
    block: int = BLOCK


def has_letter(text: str) -> bool:
    """Whether some character is a letter; number signs such as one half or Roman eight are none."""
    return any(map(str.isalpha, text))


def letters(text: str) -> bytes:
    """The text as the compressors see it."""
    return _OTHER(" ", text.lower()).strip().encode()


class Compressors:
    """One compressor per language, with its dictionary digested once."""

    def __init__(self, model: LanguageModel):
        import zstandard as z

        self.model, self.tools = model, []
        # a thorough search and short matches: the languages differ in syllables
        tuned = z.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        for content in model.dictionaries:
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=tuned)
            self.tools.append(z.ZstdCompressor(dict_data=held, compression_params=tuned).compress)

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [PAD + raw[i : i + self.model.block] for i in range(0, len(raw), self.model.block)]
        return [sum(map(len, map(tool, blocks))) for tool in self.tools]

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted); the margin is -1 for texts that cannot be judged."""
        if not text or not self.tools or not has_letter(text):
            return UNKNOWN, 0.0, -1.0, False
        raw = letters(text)
        sizes = self.sizes(raw)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.model.languages[0], 1.0, 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        told = margin >= self.model.least[bisect(LENGTHS, len(raw))]
        return self.model.languages[best], 0.5 + 0.5 * min(1.0, 4 * margin), margin, told


def compressors(model: LanguageModel) -> Compressors:
    key = hash(model)
    if key not in _TOOLS:
        _TOOLS.clear()
        _TOOLS[key] = Compressors(model)
    return _TOOLS[key]


def fit(
    docs: DataFrame, per_language: int = PER_LANGUAGE, dictionary: int = DICTIONARY, tail: float = TAIL, foreign: float = FOREIGN,
    mod: int = 5, rest: int = 0,
) -> LanguageModel:
    """Learn from `text` and `lang` of the rows outside the held-out fold.

    Of a language's sample, two thirds fill the dictionary, the rest set the least margins.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), mod, rest))
    rows = bounded_sample(known.select("lang", "text", "doc_id"), "lang", "text", per_language, "doc_id")
    by: dict[str, list[str]] = {}
    for row in rows:
        if has_letter(row["text"]):
            by.setdefault(row["lang"], []).append(row["text"])
    languages = tuple(sorted(by))
    dictionaries, apart = [], []
    for name in languages:
        texts = by[name]
        into = [t for i, t in enumerate(texts) if i % 3] or texts
        whole = b" ".join(map(letters, into))
        every = max(1, -(-len(whole) // dictionary))  # blocks from all over the sample
        blocks = [whole[i : i + 512] for i in range(0, len(whole), 512 * every)]
        dictionaries.append(b"".join(blocks)[:dictionary])
        apart += [(name, t) for t in texts[::3]]
    none = (0.0,) * (len(LENGTHS) + 1)
    model = LanguageModel(languages, tuple(dictionaries), none)
    return LanguageModel(languages, tuple(dictionaries), least_margins(model, apart, tail, foreign))


def least_margins(model: LanguageModel, apart: list[tuple[str, str]], tail: float, foreign: float) -> tuple[float, ...]:
    """For each class of length the least margin, from texts (language, text) that are in no dictionary."""
    classes = range(len(LENGTHS) + 1)
    right, strange = [[] for _ in classes], [[] for _ in classes]
    tools = Compressors(model)
    for name, text in apart if len(model.languages) > 1 else []:
        raw = letters(text)
        own = model.languages.index(name)
        for piece in {raw, *(raw[:n].rsplit(b" ", 1)[0] for n in (30, 70, 170, 450) if n < len(raw))}:
            sizes = tools.sizes(piece)
            at = bisect(LENGTHS, len(piece))
            others = sorted(x for i, x in enumerate(sizes) if i != own)
            if sizes[own] < others[0]:
                right[at].append((others[0] - sizes[own]) / others[0])
            if len(others) > 1:
                strange[at].append((others[1] - others[0]) / others[1])
    out = []
    for good, bad in zip(right, strange):
        low = float(np.quantile(good, tail)) if good else 0.0
        high = float(np.quantile(bad, foreign)) if bad else 0.0
        out.append((low + high) / 2 if high < low else low)
    return tuple(out)


def _batches(model: LanguageModel, batches: Iterator[pa.RecordBatch]):
    tool = compressors(model)
    for batch in batches:
        yield batch, [tool.judge(value.as_py()) for value in batch.column("text")]


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, margin, accepted) of every row; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, judged in _batches(model, batches):
            pred, score, margin, told = zip(*judged) if judged else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()),
                 pa.array(told, pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows, with all their columns, whose language is told with a sufficient margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, judged in _batches(model, batches):
            yield batch.filter(pa.array([told for *_, told in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
