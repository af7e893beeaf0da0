"""Language identification with error-correcting output codes.

Each language gets a codeword of BITS bits; for each bit a logistic classifier over hashed byte n-grams (1 to 3)
predicts it, and loss-weighted decoding chooses the language whose codeword has the least logistic loss. The gap to the
next codeword gives the score, and a small gap flags the text as ambiguous.

The classifiers learn from a bounded sample of labelled rows: of every value of ``lang``, the PER_LANGUAGE distinct texts
of least hash (fewer where there are so many languages that they would be more than ROWS in all, but LEAST at least), and of a
text longer than WINDOW characters a stretch of so many at a place that the hash chooses. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, settle, slices

#: Texts of each language that training uses, of all languages (if LEAST of each allow it), and characters of a text.
PER_LANGUAGE, ROWS, LEAST, WINDOW = 400, 40_000, 8, 1500
#: Texts of a training step, steps at least, and rounds over all texts at least.
BATCH, STEPS, ROUNDS = 2048, 150, 10
SIZE = 1 << 13
MIN_BITS = 15
#: Least difference of the mean bit losses of the two nearest codewords.
CLEAR = 0.1
UNKNOWN = "und"

# letters keep their bytes (A-Z lower-cased), all other ASCII is one separator
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; such rows teach nothing. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def codewords(k: int, bits: int = MIN_BITS, seed: int = 5) -> np.ndarray:
    """k distinct codewords of 0 and 1, far apart: of random ones, each time the one farthest from those chosen."""
    r = np.random.default_rng(seed)
    bits = max(bits, 2 * int(np.ceil(np.log2(max(2, k)))) + 1)
    pool = np.unique(r.integers(0, 2, size=(4096, bits)), axis=0)
    pool = pool[r.permutation(len(pool))]
    chosen = [pool[0]]
    near = (pool != chosen[0]).sum(axis=1)
    while len(chosen) < k:
        chosen.append(pool[int(near.argmax())])
        near = np.minimum(near, (pool != chosen[-1]).sum(axis=1))
    out = np.array(chosen)
    # a bit that all codewords share says nothing
    return out[:, (out.min(axis=0) != out.max(axis=0))] if k > 1 else out[:, :1]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, and the number of the text of each."""
    code, owner = [], []
    for i, t in enumerate(texts):
        a = np.frombuffer(b" ".join([b"", *t.translate(_FOLD).split(), b""]), dtype=np.uint8).astype(np.uint32)
        two = a[:-1] | (a[1:] << np.uint32(8))
        three = two[:-1] | (a[2:] << np.uint32(16)) if len(a) > 2 else two[:0]
        for k, x in enumerate((a, two, three)):
            h = (x + np.uint32(k * 0x51ED27)) * np.uint32(2654435761)
            code.append(h >> np.uint32(32 - 13))
            owner.append(np.full(len(x), i, dtype=np.int32))
    return np.concatenate(code), np.concatenate(owner)


def vectors(texts: list[bytes], size: int = SIZE) -> np.ndarray:
    """Square roots of the share of each hashed n-gram, a row for each text."""
    code, owner = grams(texts)
    flat = np.bincount(owner.astype(np.int64) * size + code, minlength=len(texts) * size).reshape(len(texts), size).astype(np.float32)
    flat /= np.maximum(flat.sum(axis=1, keepdims=True), 1)
    return np.sqrt(flat)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text, and how often each occurs."""
    code, n = np.unique(grams([text])[0], return_counts=True)
    return code.astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)


class Codes:
    """Languages, their codewords, and weights of the bits' classifiers."""

    def __init__(self, languages: list[str], texts: list[bytes], labels: list[str], l2: float = 1e-4, seed: int = 3) -> None:
        self.languages = languages
        self.words = codewords(len(languages))
        where = {lang: i for i, lang in enumerate(languages)}
        label = np.array([where[t] for t in labels])
        share = np.bincount(label, minlength=len(languages))
        rows = [counted(t) for t in texts]  # sparse; a step makes its own rows dense
        w, b = np.zeros((SIZE, self.words.shape[1]), dtype=np.float32), np.zeros(self.words.shape[1], dtype=np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        order, parts = np.random.default_rng(seed), -(-len(rows) // BATCH)
        for _ in range(max(ROUNDS, -(-STEPS // parts))):
            mixed = order.permutation(len(rows))
            for part in np.array_split(mixed, parts):
                x = np.zeros((len(part), SIZE), dtype=np.float32)
                for k, i in enumerate(part.tolist()):
                    code, n = rows[i]
                    x[k, code] = np.sqrt(n / np.float32(n.sum()))
                y = (2.0 * self.words[label[part]] - 1).astype(np.float32)
                weight = (1.0 / share[label[part]])[:, None].astype(np.float32)
                weight /= weight.sum()
                g = -y * weight / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
                vw = 0.9 * vw - 12 * (x.T @ g + l2 * w)
                vb = 0.9 * vb - 12 * g.sum(axis=0)
                w, b = w + vw, b + vb
        self.weights, self.bias = w, b

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is ambiguous, of each text."""
        margins = vectors(texts) @ self.weights + self.bias
        sign = 2.0 * self.words - 1
        # loss-weighted decoding: the mean logistic loss of a codeword's bits under the margins
        loss = np.logaddexp(0, -sign[None] * margins[:, None, :].astype(np.float64)).mean(axis=2)
        best = loss.argmin(axis=1)
        likely = np.exp(-sign.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / likely.sum(axis=1)
        ranked = np.sort(loss, axis=1)
        close = ranked[:, 1] - ranked[:, 0] < CLEAR if loss.shape[1] > 1 else np.zeros(len(loss), dtype=bool)
        return [(self.languages[i], float(s), bool(c)) for i, s, c in zip(best, score, close, strict=True)]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(lang, text): the bounded sample, of rows that are not held out and have a label and a letter.

    Copies of a text are one, and are folded before anything is shuffled, so a hot text crowds out nothing.
    """
    known = docs.where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    distinct = settle(known.select("lang", "h").distinct())
    # written: its size is known then, and rows need not meet by language
    sizes = settle(distinct.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sizes.count()
    most = min(per_language, max(least, rows // max(1, languages)))
    # hashes are uniform: those below this share are about 1.5 times what is wanted, and are ranked
    draw = (F.col("h") / F.lit(2.0**64) + 0.5) < F.lit(1.5 * most + 50) / F.col("n")
    few = distinct.join(sizes, "lang").where(draw).select("lang", "h")
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most)
    chosen = settle(ranked.select("lang", "h"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int") + 1
    found = known.join(chosen, ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", start, F.lit(window)).alias("text"))
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Codes | None:
    """The classifiers, from the bounded sample; None where no row has a label and a letter."""
    found = sorted((r[0], r[1].encode()) for r in sample(docs, per_language, rows).toLocalIterator())
    found = [(lang, t) for lang, t in found if any(map(str.isalpha, t.decode("utf-8")))]
    languages = sorted({lang for lang, _ in found})
    return Codes(languages, [t for _, t in found], [lang for lang, _ in found]) if languages else None


def identify(docs: DataFrame, model: Codes | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of ``docs``.

    A text that is null or has no letter, and any text if nothing was learned, is ``und`` with score 0. Rows that
    repeat a doc_id, or have none, are judged each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = sent.value
        for b in slices(batches, rows=256):
            raw = byte_rows(b.column(2))
            at = [i for i, t in enumerate(raw) if t and codes is not None and any(map(str.isalpha, t.decode("utf-8")))]
            out = [(UNKNOWN, 0.0, True)] * len(raw)
            for i, r in zip(at, codes.predict([raw[i] for i in at]) if at else [], strict=True):
                out[i] = r
            lang, score, close = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def query(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and judge all."""
    return identify(docs, train(docs))
