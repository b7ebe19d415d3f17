"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of what is left, longest first. A piece is a sequence of its own, so no
sequence crosses documents, none is padded, and pieces of one length form a bucket to draw batches
from. Nothing is shuffled.

Defined cases: null and empty texts have the closing id alone; a null ``doc_id`` stays null; repeated
rows are cut each for itself; texts of any length are whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import prepare

LONGEST = 4096
CLOSE = 2
TAIL = ".,!?;:*$%&#|"
KNOWN = 800_000  # words remembered by a worker; then it starts afresh

SCHEMA = """doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint,
    sequence_id bigint, offset bigint, bucket int"""

_TOKENIZERS: dict[str, "Words"] = {}


class Words:
    """Ids (little-endian unsigned 32 bit) of what stands between single spaces, looked up once.

    The tokenizer's own splitting drops white space and never joins across it, and it parts letters
    from the punctuation after them, so ids of the parts in a row are the ids of the text. Its
    normalisation of ASCII letters is lower case, so these go to its model directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}

    def _unknown(self, words: list[str]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = array("I", got.ids).tobytes()

    def learn(self, new: set[str]) -> None:
        known, tokenize = self.known, self.model.tokenize
        if len(known) > KNOWN:
            known.clear()
            known[""] = b""
        cut, others = [], set()
        for word in new:
            stem = word.rstrip(TAIL)
            if stem.isalpha() and stem.isascii():
                small = stem.lower()
                if (ids := known.get(small)) is None:
                    ids = known[small] = array("I", [t.id for t in tokenize(small)]).tobytes()
                if len(stem) == len(word):
                    known[word] = ids
                    continue
            elif not (stem and stem[-1].isalpha()) or len(stem) == len(word):
                others.add(word)
                continue
            else:
                ids = known.get(stem)
                if ids is None:
                    others.add(stem)
            tail = word[len(stem):]
            if tail not in known:
                others.add(tail)
            cut.append((word, small if stem.isascii() and stem.isalpha() else stem, tail))
        if others:
            self._unknown(list(others))
        for word, stem, tail in cut:
            known[word] = known[stem] + known[tail]

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        while new := set(words).difference(self.known):  # twice where it has just started afresh
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))


def words_of(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, longest first, none above ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, close: int = CLOSE,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit numbers, ``bucket``
    the logarithm of its length. ``sequence_id`` numbers the pieces of a task's rows, with the task's
    number in front: the same again when the task is repeated."""
    prepare(docs.sparkSession)
    end = int(close).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        words = words_of(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        for batch in T.slices(batches, "text"):
            rows = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = words.ids(body or "") + end
                total, start = len(ids) // 4, 0
                for n in lengths(total, longest):
                    piece = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, piece, zlib.crc32(piece), total, sequence, 0, n.bit_length() - 1))
                    start += n
                    sequence += 1
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.int32()]
            names = [c.split()[0] for c in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces of equal length together, a folder per length."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(path)
