"""Toxicity of whole documents: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word boundaries) and itself, each hashed to a row of an embedding
table; words never seen, such as misspellings, share n-gram rows with words that were. The rows of a window of words
are averaged and go through a linear softmax of two classes; embeddings and softmax are trained together by Adam on
the cross entropy. A document's score is that of its most toxic window; a window begins at every word, so one
insult in a long document isn't averaged away and no phrase is cut. In training a toxic document teaches through its most toxic window (all
of them in the first round), a clean one through every window.

Because the two-class softmax over an average is linear, a word's contribution is one number; workers work it out for all
new words of some texts at once, keep it in a bounded cache and score a text with one lookup for each word.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Characters that are hashed at a time.
CHARS = 1 << 17
#: Rows of the embedding table, its width, and lengths of the n-grams.
BUCKETS, DIM, GRAMS = 1 << 17, 4, (3, 4, 5)
#: Words in a window.
WINDOW = 5
#: Labelled toxic and clean rows that the model is fitted on, taken in order of a hash of doc_id, and windows of them: where
#: they have more, each row gives the same number at most, drawn from its whole text, so none is left out for its
#: length. Scoring knows no bound.
TRAIN_ROWS, TRAIN_WINDOWS = (1500, 2500), 250_000
#: Clean windows below this logit are easy: one in EASY of them is used in a round, with EASY times the weight.
EASY_LOGIT, EASY = -4.0, 8
#: After this share of the rounds, a toxic document without a window above this logit is left out of a round: the others
#: don't bear its label out.
TRUST, DOUBT = 0.1, 0.0
#: Windows of a step, and steps that a small sample takes at least.
BATCH, STEPS = 2048, 48
#: Words that a worker remembers, in each of two generations.
CACHE_WORDS = 150_000


def crc_table() -> np.ndarray:
    """What CRC-32 does with each value of a byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = crc_table()


def grams_of(word: str) -> list[str]:
    bound = f"<{word}>"
    return [bound, *(bound[i : i + n] for n in GRAMS for i in range(len(bound) - n + 1) if n < len(bound))]


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding table, one word's after another's; how many each word has): the CRC-32 of the word with
    its boundaries, and of their n-grams; of all words at once where they are ASCII, so a character is a byte."""
    bound = [f"<{w}>".encode() for w in words]
    plain = np.fromiter(map(str.isascii, words), dtype=bool, count=len(words))
    length = np.where(plain, np.fromiter(map(len, bound), dtype=np.int64, count=len(words)), 0)
    codes = np.frombuffer(b"".join(x for x, ok in zip(bound, plain, strict=True) if ok), dtype=np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    after = length[word] - place  # characters of the word from here on
    rows, owner = [np.fromiter(map(zlib.crc32, bound), dtype=np.uint32, count=len(words))], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero((after >= n) & ~((place == 0) & (after == n)))  # the whole word is there already
        h = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = CRC[(h ^ codes[at + k]) & np.uint32(255)] ^ (h >> np.uint32(8))
        rows.append(~h)
        owner.append(word[at])
    for i in np.flatnonzero(~plain):
        rest = [zlib.crc32(g.encode()) for g in grams_of(words[i])[1:]]
        rows.append(np.array(rest, dtype=np.uint32))
        owner.append(np.full(len(rest), i))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order].astype(np.int64) % BUCKETS, np.bincount(owner, minlength=len(words))


def word_rows(word: str) -> list[int]:
    return rows_of([word])[0].tolist()


def portions(words: Iterable[str]) -> Iterator[list[str]]:
    """The words in lists of some CHARS characters, or of one longer word."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > CHARS:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w) + 2
    if part:
        yield part


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """rows: each embedding row's share of the logit (embedding times the softmax's weight difference)."""

    rows: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[complex]:
        rows, sizes = rows_of(words)
        return (np.add.reduceat(self.rows[rows].astype(np.float64), np.cumsum(sizes) - sizes) + 1j * sizes).tolist()


class Scorer(dict):
    """word -> share of the logit and number of rows, as the parts of a complex number."""

    def __init__(self, model: Model):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> complex:
        found = self.old.get(word)
        return self.model.words([word])[0] if found is None else found

    def learn(self, found: set[str]) -> None:
        """Words that aren't remembered yet, as many as a generation holds; others are worked out when they are met."""
        new = list(islice((x for x in found if x not in self), CACHE_WORDS))
        if len(self) + len(new) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self.update((x, self.old[x]) for x in new if x in self.old)
        for part in portions(x for x in new if x not in self):
            self.update(zip(part, self.model.words(part), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        parts = [words(t) for t in texts]
        self.learn(set().union(*parts))
        return [self.window(w) for w in parts]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def window(self, w: list[str]) -> float:
        logit = self.model.bias
        if w:
            each = np.fromiter(map(self.__getitem__, w), dtype=np.complex128, count=len(w))
            sums = np.concatenate([np.zeros(1, dtype=np.complex128), np.cumsum(each)])
            ends = np.minimum(np.arange(len(w)) + WINDOW, len(w))
            windows = sums[ends] - sums[:-1]  # one from each word on, shorter where the text ends
            logit += float((windows.real / windows.imag).max())
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def allowance(sizes: np.ndarray, total: int) -> int:
    """The greatest number c for which min(size, c) adds up to `total` at most, and 1 at least."""
    order = np.sort(sizes)
    below = np.append(0, np.cumsum(order))[:-1]
    left = len(order) - np.arange(len(order))
    fits = np.flatnonzero(below + left * order <= total)
    if len(fits) == len(order):
        return int(order[-1]) if len(order) else 1
    k = len(fits)
    return max(1, int((total - below[k]) // left[k]))


def sample_windows(rows: list[tuple[str | None, int]], total: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(words as numbers, n windows x WINDOW, -1 where the text has ended; document of each window; labels; the words)."""
    rng = np.random.default_rng(seed)
    sizes = np.array([-(-sum(1 for _ in WORD.finditer(t.lower())) // WINDOW) if t else 0 for t, _ in rows], dtype=np.int64)
    most = allowance(sizes[sizes > 0], total)
    vocabulary: dict[str, int] = {}
    found, doc, label = array("i"), array("i"), []
    for (text, y), size in zip(rows, sizes, strict=True):
        if not size:
            continue
        w = words(text)
        picked = range(size) if size <= most else np.sort(rng.choice(size, most, replace=False)).tolist()
        for k in picked:
            part = [vocabulary.setdefault(x, len(vocabulary)) for x in w[k * WINDOW : (k + 1) * WINDOW]]
            found.extend(part + [-1] * (WINDOW - len(part)))
            doc.append(len(label))
        label.append(y)
    return np.frombuffer(found, dtype=np.int32).reshape(-1, WINDOW), np.frombuffer(doc, dtype=np.int32), np.array(label, dtype=np.int64), vocabulary


def fit(rows: list[tuple[str | None, int]], rounds: int = 10, rate: float = 0.2, seed: int = 7, total: int = TRAIN_WINDOWS) -> Model:
    """A model from (text, label) rows. Without rows of both classes every score is the share of label 1, or 0.

    A step touches only the table's rows that its windows have: sums over n-grams are made once for each distinct word,
    gradients go back the same way, and Adam's moments of other rows rest.
    """
    tokens, doc, label, vocabulary = sample_windows(rows, total, seed)
    share = float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, dtype=np.float32), 60.0 if share else -60.0)
    found = [(r.astype(np.int32), n) for r, n in map(rows_of, portions(vocabulary))]
    del vocabulary
    grams = np.concatenate([r for r, _ in found])
    sizes = np.concatenate([*(n for _, n in found), [0]])  # the last word is none: it stands for -1
    del found
    starts = np.append(0, np.cumsum(sizes))
    tokens = np.where(tokens < 0, len(sizes) - 1, tokens)
    n = sizes[tokens].sum(1)
    first = np.flatnonzero(np.diff(np.append(-1, doc)))  # each document's first window
    y = label[doc]

    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.01, 0.01, (BUCKETS, DIM)).astype(np.float32)
    emb[np.bincount(grams, minlength=BUCKETS) == 0] = 0  # rows that the fit never meets add nothing
    out, bias = rng.normal(0, 0.1, DIM).astype(np.float32), 0.0
    moments = [np.zeros((BUCKETS, DIM), np.float32), np.zeros((BUCKETS, DIM), np.float32)], [np.zeros(DIM), np.zeros(DIM)], [np.zeros(1), np.zeros(1)]
    step = 0

    def adam(m: np.ndarray, v: np.ndarray, grad: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        return m, v, rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def logits() -> np.ndarray:
        """Of all windows."""
        word = np.append(np.add.reduceat((emb @ out)[grams], starts[:-2]), 0.0)
        return word[tokens].sum(1) / n + bias

    rounds = max(rounds, -(-STEPS // -(-len(y) // BATCH)))
    for k in range(rounds):
        weight = np.ones(len(y))
        if k:  # of a toxic document its most toxic window, of clean ones what is hard and some of the rest
            z = logits()
            top = np.maximum.reduceat(z, first)
            easy = (y == 0) & (z < EASY_LOGIT)
            weight = np.where(easy, EASY * (rng.random(len(y)) < 1 / EASY), 1.0)
            weight[(y == 1) & ((z < top[doc]) | (top[doc] < DOUBT) & (k >= TRUST * rounds))] = 0
        chosen = rng.permutation(np.flatnonzero(weight))
        for at in range(0, len(chosen), BATCH):
            b = chosen[at : at + BATCH]
            used, inverse = np.unique(tokens[b], return_inverse=True)
            inverse = inverse.reshape(len(b), WINDOW)
            size = sizes[used]
            offset = np.append(0, np.cumsum(size))
            part = grams[np.repeat(starts[used] - offset[:-1], size) + np.arange(offset[-1])]
            touched = np.flatnonzero(np.bincount(part, minlength=BUCKETS))
            share_of = np.zeros(BUCKETS, dtype=np.float32)
            share_of[touched] = emb[touched] @ out
            sums = np.append(0.0, np.cumsum(share_of[part], dtype=np.float64))
            word = sums[offset[1:]] - sums[offset[:-1]]
            z = word[inverse].sum(1) / n[b] + bias
            miss = weight[b] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[b]) / len(b)
            back = np.bincount(inverse.ravel(), weights=np.repeat(miss / n[b], WINDOW), minlength=len(used))
            each = np.bincount(part, weights=np.repeat(back, size), minlength=BUCKETS)[touched].astype(np.float32)
            step += 1
            pace = rate * (1 - k / rounds)
            (m, v), of_out, of_bias = moments
            g_out = emb[touched].T @ each
            m[touched], v[touched], change = adam(m[touched], v[touched], each[:, None] * out, pace)
            emb[touched] -= change
            of_out[0], of_out[1], change = adam(*of_out, g_out, pace)
            out = (out - change).astype(np.float32)
            of_bias[0], of_bias[1], change = adam(*of_bias, np.array([miss.sum()]), pace)
            bias -= float(change[0])
    return Model((emb @ out).astype(np.float32), bias)


def held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from: crc32 of doc_id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    """A model from so many labelled toxic and clean documents at most, none of them held out.

    A doc_id with several labels is toxic if any of them says so; null labels and ids count as none. Of rows with one
    doc_id those that come first by a hash of their text are taken while the bound lasts. The sample is the same for the
    same tables, whatever their partitions. Other columns are ignored, whatever their names.
    """
    one = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = one.where("_toxic = 1").orderBy(*order).limit(rows[0]).unionByName(one.where("_toxic = 0").orderBy(*order).limit(rows[1]))
    # at most sum(rows) ids of 12 bytes: a fixed bound
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    got = texts.join(F.broadcast(some), "_id").orderBy(*order, F.xxhash64("_text"), "_text").limit(sum(rows))
    return fit([(r._text, r._toxic) for r in got.select("_toxic", "_text").toLocalIterator()])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1 (a column of that name is replaced). Empty and null texts get a score."""
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    at = next(i for i, c in enumerate(rest) if c.lower() == "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found, part, size = [], [], 0
            for t in b.column(at):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > CHARS:  # some texts at a time, or one longer text
                    found += scorer.scores(part)
                    part, size = [], 0
            found += scorer.scores(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, column])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic (boolean); the model is fitted on the labelled rows that aren't held out.

    Null and empty texts, and texts without words, have the score of the bias alone; every text is scored whole.
    Repeated rows get one score; an empty table gives no rows; without labels of both kinds every score is 0 or 1.
    Extra columns are kept; one named toxicity or toxic is replaced.
    """
    scored = score(docs, train(docs, labels), "toxicity")
    return scored.withColumn("toxic", F.col("toxicity") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the model doesn't reject, with the same columns, whatever their names. For null and empty
    texts, repeated rows and empty tables see judge()."""
    own = "_toxicity".ljust(1 + max(map(len, docs.columns)), "_")  # longer than any name of docs
    scored = score(docs, train(docs, labels), own)
    return scored.where(F.col(own) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
