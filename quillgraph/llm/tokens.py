"""Token counts: the pieces of each distinct pre-token are counted once and joined to per-document pre-token frequencies.

Three steps. (1) From a bounded sample of rows come the pre-tokens that are frequent, at most DICTIONARY and so a number
that doesn't grow with the data; their pieces are counted once and go to every worker. The sample only decides which join
a pre-token takes. (2) Each text is cut once; its frequencies are joined to that dictionary on the spot, and those of other
pre-tokens are written, a row for each text and pre-token. (3) Of these, each distinct one's pieces are counted once, and a
shuffle joins them, which so has no frequent keys. Sums per row follow. No ids are kept.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, settle, single_thread, slices

FILE = "word_bpe_49k.json"
OVER = 2048
#: Entries that every worker gets, and their largest length in bytes: at most 200,000 x 40 bytes; and as many longer ones of
#: at most LONG_BYTES as are frequent, 2,000 x 4,096 bytes.
DICTIONARY, ENTRY_BYTES = 200_000, 40
LONG_ENTRIES, LONG_BYTES = 2_000, 4_096
#: Rows of the sample from which they are taken, about.
SAMPLE = 4_000
#: Distinct pre-tokens after which a worker's running count is handed on.
FLUSH = 400_000
#: Below this lead byte all characters are under U+0240, where this pre-tokenization and the library's agree.
PLAIN = 0xC9


class PreTokenizer:
    """A tokenizer file's normalization and pre-tokenization, without its mapping of bytes.

    Texts with only characters below U+0240 are cut by the file's own pattern after lower-casing (none of these
    characters changes under NFC); all others go through the library's parts. Special tokens that the library
    finds in a text are entries of their own.
    """

    def __init__(self, path: str) -> None:
        single_thread()
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)

    def _part(self, text: str, plain: bool) -> list[str]:
        if plain:
            return self.pattern.findall(text.lower())
        return [t for t, _ in self.split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def __call__(self, raw: bytes) -> list[str]:
        text, plain = raw.decode("utf-8"), max(raw, default=0) < PLAIN
        if "<|" not in text or not (found := self.special.findall(text)):
            return self._part(text, plain)
        return [t for part in self.special.split(text) for t in self._part(part, plain)] + found

    def pieces(self, entries: list[str]) -> list[int]:
        """How many tokens each entry has."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(entries, add_special_tokens=False)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def frequencies(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(token, freq): each distinct pre-token of the texts, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = PreTokenizer(path or default_path()), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for b in slices(batches):
            for raw in byte_rows(b.column(0)):
                if raw:
                    seen.update(cut(raw))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("freq"))


def with_pieces(vocab: DataFrame, path: str | None = None) -> DataFrame:
    """(token, pieces) of distinct pre-tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PreTokenizer(path or default_path())
        for b in slices(batches, rows=10_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut.pieces(b.column(0).to_pylist()), pa.int64())], ["token", "pieces"])

    return vocab.select("token").mapInArrow(encode, "token string, pieces long")


def dictionary_of(docs: DataFrame, path: str | None = None, most: int = DICTIONARY, sample: int = SAMPLE) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of a sample of rows; of bounded size."""
    n = docs.count()
    seen = settle(frequencies(docs.sample(min(1.0, sample / max(1, n)), seed=1), path).where("freq > 1"))
    size = F.octet_length("token")
    short = seen.where(size <= ENTRY_BYTES).orderBy(F.desc("freq"), "token").limit(most)
    long = seen.where((size > ENTRY_BYTES) & (size <= LONG_BYTES)).orderBy(F.desc("freq"), "token").limit(min(most, LONG_ENTRIES))
    chosen = short.unionByName(long).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return {r[0]: r[1] for r in with_pieces(chosen, path).collect()}


def count_tokens(docs: DataFrame, path: str | None = None, over: int = OVER, dictionary: int = DICTIONARY, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    A null or empty text has no bytes and no tokens. Rows that repeat a doc_id, or have none, are counted each
    by itself. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(dictionary_of(docs, path, dictionary, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = PreTokenizer(path or default_path()), known.value
        for b in slices(batches):
            rid, doc, size, token, n = [], [], [], [], []
            for r, d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_rows(b.column(2)), strict=True):
                total, rest = 0, []
                for t, k in Counter(cut(raw)).items() if raw else ():
                    p = pieces.get(t)
                    if p is None:
                        rest.append((t, k))
                    else:
                        total += p * k
                for t, k in [(None, total), *rest]:  # the row itself, with what is known
                    rid.append(r)
                    doc.append(d)
                    size.append(len(raw or b""))
                    token.append(t)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(token, pa.string()), pa.array(n, pa.int64())], ["rid", "doc_id", "n_bytes", "token", "n"])

    # the number of a row is given once and written
    rows = settle(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_bytes long, token string, n long"))
    rare = rows.where("token is not null").select("rid", "token", "n")
    counted = settle(with_pieces(rare.select("token").distinct(), path))
    more = rare.join(counted, "token").groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    each = rows.where("token is null").join(more, "rid", "left")
    n_tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return each.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > over).alias("over_limit"))


query = count_tokens
