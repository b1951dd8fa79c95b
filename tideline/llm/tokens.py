"""Token ids of whole texts, with ids of white-space separated chunks kept per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks, words among them, of one generation of a task's memory. Changes cost, not results.
REMEMBERED = 200_000
#: Chunks of printable ASCII and Latin letters that have one composed form and one lower-case letter.
LETTER = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
#: Fixed value: the vocabulary's own rule for words, on lower-case plain chunks.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^0-9{LETTER}]+")

#: Marks that often end a chunk: a run of them is one word by that rule.
MARKS = ".,;:!?)\""


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in own else next(others) for b in range(256)]


class Memory(dict):
    """Values by key, computed when first asked for. What a whole generation did not ask for is forgotten."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        super().__init__()
        self.compute, self.most, self.before = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.most:
            self.before = self.copy()
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.before = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    The vocabulary drops white space before it merges, so no token reaches over a blank or a
    line feed, and a text's ids are those of its chunks one after another. In plain chunks the
    model is asked for each distinct word, in others the whole tokenizer for each chunk.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks = Memory(self.chunk, REMEMBERED)

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if (chunk.isprintable() if chunk.isascii() else PLAIN.fullmatch(chunk)) and "<|" not in chunk:
            lower = chunk.lower()
            word = lower.rstrip(MARKS)
            found = [word, lower[len(word):]] if word.isalpha() else WORDS.findall(lower)
            # A word is a chunk too: it is remembered as one.
            if found and found[0] == chunk:
                return self.word(chunk)
            return b"".join([self.chunks[w] for w in found if w])
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        get = self.chunks.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) for t in texts]

    def forget(self) -> None:
        """Give the memory back: a worker that has ended a task may wait long for the next."""
        self.chunks.forget()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker; every node holds the vocabulary file at ``path``."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``chars`` bytes of text, so that long texts don't add up."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chars, "right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, path: str, end_id: int, longest: int | None = None) -> DataFrame:
    """Ids of each text with ``end_id`` behind them, cut every ``longest`` ids.

    Takes ``doc_id`` and ``text`` (null is empty); other columns are left out. Returns per piece
    ``doc_id``, ``start``, ``length``, ``ids`` (binary), ``doc_tokens``. An empty text gives one
    piece that holds the end id; repeated rows give repeated pieces.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [x + tail for x in encode(batch.column(1).to_pylist())]
                step = [4 * longest if longest else len(x) for x in ids]
                rows = [(d, at // 4, x[at:at + s], len(x) // 4)
                        for d, x, s in zip(batch.column(0).to_pylist(), ids, step)
                        for at in range(0, len(x), s)]
                doc, start, part, total = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
                     pa.array([len(p) // 4 for p in part], pa.int64()), pa.array(part, pa.binary()),
                     pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])
        encode.forget()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long")
