"""Packing by power-of-two decomposition.

A document of n ids is cut, front to back, into n // 1024 pieces of 1024 ids and then into the binary parts of
the rest, largest first. Each piece is a sequence of its own, of a length that is a power of two, so no sequence
crosses documents and none is padded; batches are made of sequences of one length, the bucket.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, single_thread, slices

FILE, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LENGTH = 1024
END = 0
#: Below this lead byte all characters are under U+0240; both encoders read these alike.
PLAIN = 0xC9


class Encoder:
    """The ids that the tokenizers library gives for ``byte_bpe_50k.json``.

    Plain texts are encoded by tiktoken from the same vocabulary, which is four times as fast and gives the same
    ids (tests hold both together); texts with rarer characters or with the special token go to the library.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None) -> None:
        single_thread()
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path or public_tokenizers.path(FILE))
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, raw: bytes | None) -> list[int]:
        if not raw:
            return []
        text = raw.decode("utf-8")
        if max(raw) < PLAIN and "<|endoftext|>" not in text:
            return self.fast.encode_ordinary(text)
        return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids


def parts(n: int, longest: int = LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: as many of ``longest`` as go in, then the binary parts of what is left."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def _pieces(docs: DataFrame, keep_ids: bool, longest: int, path: str | None) -> DataFrame:
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in slices(batches):
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for d, raw in zip(b.column(0).to_pylist(), byte_rows(b.column(1)), strict=True):
                a = np.array([*encode(raw), END], dtype="<u4")
                at = 0
                for k in parts(len(a), longest):
                    piece = a[at : at + k]
                    doc.append(d)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(a))
                    if keep_ids:
                        ids.append(piece.astype(np.int32))
                    at += k
            out = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    # a sequence has one piece, so a number for each row is one for each sequence; buckets are the lengths' powers
    return found.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def pack(docs: DataFrame, longest: int = LENGTH, path: str | None = None) -> DataFrame:
    """The sequences with their ids: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset, bucket.

    Write them ``partitionBy("bucket")`` to have equal lengths together. Null and empty texts have the end id
    alone. Rows that repeat a doc_id are packed each. An empty table gives no sequences.
    """
    return _pieces(docs, True, longest, path)


def query(docs: DataFrame) -> DataFrame:
    """The digest: what ``pack`` returns, without the ids."""
    return _pieces(docs, False, LENGTH, None)
