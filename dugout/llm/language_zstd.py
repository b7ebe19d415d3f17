"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of sample texts. A text is cut into
pieces, each piece is compressed once with every dictionary, and the language with the smallest sum
of compressed bytes is chosen (ties: that with more training texts, then the first by code point).
Case is folded first. ``accepted`` is false where the
runner-up comes too near.

The dictionaries are fitted on a bounded sample: of each language the ``SAMPLE`` documents (about)
with the smallest hash, ``EXCERPT`` characters of each. Predictions read whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training
text everything is ``und``; a language with few documents has a short dictionary; a null ``doc_id``
is predicted like any other; repeated rows are predicted each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import prepare

SAMPLE = 900
EXCERPT = 600
DICTIONARY = 400 * 1024  # bytes
PIECE = 8192  # bytes
LEVEL, MATCH = 3, 4  # of zstandard: level, and bytes of a match at least
MARGIN = 0.01  # a runner-up within this share of the smallest size: not accepted
SHARPNESS = 0.02  # of the score, per compressed byte
UNKNOWN = "und"


def dictionaries(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
                 lang: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes per language. The driver sees one count per language and the sample."""
    rows = docs.filter(train).filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    limit, order = None, {}
    for r in rows.groupBy("lang").count().collect():
        order[r.lang] = (-r["count"], r.lang)
        own = (F.col("lang") == r.lang) & (share < min(1.0, SAMPLE / r["count"]))
        limit = own if limit is None else limit | own
    if limit is None:
        return {}
    sample = rows.filter(limit).select("lang", F.substring("text", 1, EXCERPT).alias("t"), share.alias("s")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r.s, r.t)):
        out.setdefault(r.lang, []).append(r.t.lower().encode())
    return {k: b"\n".join(out[k])[:DICTIONARY] for k in sorted(out, key=order.get)}


def classifier(books: dict[str, bytes]):
    """A function from text bytes to compressed sizes, one per language in order."""
    packers = []
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    for book in books.values():
        data = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        packers.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=data))

    def sizes(body: bytes) -> np.ndarray:
        out = np.zeros(len(packers), np.int64)
        for at in range(0, len(body), PIECE):
            piece = body[at : at + PIECE]
            out += [len(p.compress(piece)) for p in packers]
        return out

    return sizes


def predicted(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
              lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, accepted, margin) for every row; ``train`` says which rows may be
    learned from. ``score`` is the softmax of the compressed sizes."""
    prepare(docs.sparkSession)
    books = dictionaries(docs, train, doc_id, text, lang)
    names = list(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = classifier(books)
        for batch in T.slices(batches):
            out = []
            for body, letters in zip(batch.column("text").to_pylist(), batch.column("letters").to_pylist()):
                if not letters or not names:
                    out.append((UNKNOWN, 0.0, False, 0.0))
                    continue
                n = sizes(body.lower().encode())
                best = int(n.argmin())
                rest = np.delete(n, best)
                margin = float((rest.min() - n[best]) / n[best]) if len(rest) else 1.0
                score = 1 / np.exp(np.minimum(-SHARPNESS * (n - n[best]), 0)).sum()
                out.append((names[best], float(score), margin >= MARGIN, margin))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             ["doc_id", "lang_pred", "score", "accepted", "margin"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean, margin double")
