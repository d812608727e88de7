"""Language identification with error-correcting output codes.

Each language gets a codeword of signs. For each bit a binary classifier over
hashed character n-grams (1 to 3, in sqrt-frequency space) learns to predict
the sign of a document's language; a text's language is the codeword with the
least logistic loss against the predicted margins, so a few wrong bits are
outvoted. The share of that codeword among all, by ``exp(-loss)``, is the
score; a text is flagged ambiguous if the runner-up's loss is close.

The classifiers are fitted on the driver from at most ``SAMPLE`` labelled
documents, an equal number of each language, those with the least keyed hashes
of their ids; executors send sparse n-gram counts of them (not texts). The
languages are those of all rows that may be learned from, so that a rare one
has its documents in the fit; if they are more than ``SAMPLE``, the most
frequent are learned. All documents are scored from their whole texts, in one
map. Features and weights are whole numbers, whose products are summed without
rounding: a text's score doesn't depend on the texts beside it.

Defined results: a null text or one without a letter is ``und`` with score 0,
and so is every text if there is no labelled document; with a single learned
language every text with a letter gets it; repeated rows get equal results; a
null id is neither learned from nor held out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Labelled documents that the fit may use, and the key that draws them.
SAMPLE, KEY = 2000, 17
BUCKETS = 4096
#: Below this gap between the two least losses a text is ambiguous.
MARGIN = 1.0
#: Characters whose n-grams are counted at once.
GROUP = 400_000
#: Feature and weight units: sums of BUCKETS products stay below 2^53.
FEATURE_UNIT, WEIGHT_UNIT = 2.0**14, 2.0**18
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _letters() -> np.ndarray:
    """By code point: itself in lower case if it is a letter, else a blank."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = c
    return out


class Counter:
    """Counts of the character n-grams of whole texts, each between two blanks."""

    def __init__(self):
        self.fold = _letters()

    def _chars(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Folded characters of all texts, and how many each has."""
        padded = [f" {t.lower()} " for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.fold[chars], np.array([len(t) for t in padded])

    @staticmethod
    def _buckets(c: np.ndarray) -> Iterator[np.ndarray]:
        """For n = 1, 2, 3: the bucket of the n-gram at each character."""
        key = np.zeros(len(c), np.uint32)
        shift = np.uint32(32 - BUCKETS.bit_length() + 1)
        for n, prime in enumerate(_PRIMES):
            key = key[: len(c) - n] * prime + c[n:]
            yield (key * np.uint32(0x9E3779B1)) >> shift

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[text, bucket] counts, and the number of letters of each text."""
        c, size = self._chars(texts)
        doc = np.repeat(np.arange(len(texts)), size)
        letters = np.bincount(doc, weights=c != 32, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(size)
        out = np.zeros(len(texts) * BUCKETS + 1, np.int64)
        for n, bucket in enumerate(self._buckets(c)):
            cell = doc[: len(bucket)] * BUCKETS + bucket
            # The last n grams of a text would reach into the next one.
            over = (ends[:, None] - 1 - np.arange(n)).ravel()
            cell[over[over < len(cell)]] = len(out) - 1
            out += np.bincount(cell, minlength=len(out))
        return out[:-1].reshape(len(texts), BUCKETS), letters

    def long_counts(self, text: str, step: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
        """As ``counts`` of one text, ``step`` characters at a time and the two after them."""
        c, _ = self._chars([text])
        out = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(c), step):
            for bucket in self._buckets(c[at : at + step + 2]):
                out += np.bincount(bucket[:step], minlength=BUCKETS)
        return out[None, :], np.array([np.count_nonzero(c != 32)])

    def features(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(counts, letters) of successive groups of texts."""
        group, chars = [], 0
        for t in texts:
            if group and (chars + len(t) > GROUP or len(group) >= 256):
                yield self.counts(group)
                group, chars = [], 0
            if len(t) > GROUP:
                yield self.long_counts(t)
                continue
            group.append(t)
            chars += len(t)
        if group:
            yield self.counts(group)


def scale(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted frequencies."""
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """[language, bit] signs: exhaustive up to five languages, then the best of
    seeded random codes by least distance between two rows."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1)][1:]
        return np.array(columns, float).T
    draw = np.random.default_rng(11)
    length = 10 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (n, length))
        least = int((length - (code @ code.T - np.eye(n) * 2 * length).max()) // 2)
        if least > far:
            best, far = code, least
    return best


class Model:
    """Bit classifiers, codewords and the languages they stand for."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, code: np.ndarray):
        self.langs, self.bias, self.code = langs, bias, code
        self.weights = np.rint(np.clip(weights.astype(float), -64, 64) * WEIGHT_UNIT)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of feature rows."""
        margins = np.rint(x * FEATURE_UNIT).astype(float) @ self.weights / (FEATURE_UNIT * WEIGHT_UNIT) + self.bias
        loss = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :]).sum(2)
        best = loss.argmin(1)
        least = loss[np.arange(len(x)), best]
        score = 1.0 / np.exp(least[:, None] - loss).sum(1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else least + 2 * MARGIN
        return best, score, second - least < MARGIN


def fit(x: np.ndarray, y: list[str], rounds: int = 60) -> Model:
    """Logistic bit classifiers by Adam on all rows; classes weigh the same."""
    langs = sorted(set(y))
    code = codewords(len(langs))
    index = np.array([langs.index(v) for v in y])
    share = np.bincount(index, minlength=len(langs))
    row_weight = (1.0 / share[index] / len(langs))[:, None].astype(np.float32)
    signs = code[index].astype(np.float32)
    x = x.astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    slow, fast = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        pull = row_weight * signs / (1.0 + np.exp(np.clip(signs * (x @ w + b), -30, 30)))
        grad = x.T @ pull - 1e-6 * w
        slow, fast = 0.9 * slow + 0.1 * grad, 0.98 * fast + 0.02 * grad**2
        w += 1.0 * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.98**step)) + 1e-7)
        b += 2.0 * pull.sum(0)
    return Model(langs, w, b, code)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(lang, text) of ``sample`` rows at most: of each language the same number,
    the first by a keyed hash.

    The table of languages has ``sample`` rows at most, which bounds what is
    broadcast. It tells about which hashes can be drawn, so that little more than
    the rows wanted goes to the window.
    """
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col("doc_id"))
    rows = docs.where(usable).select("doc_id", "lang", F.col(text_col).alias("text"), F.xxhash64("doc_id", F.lit(KEY)).alias("key"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    each = F.greatest(F.lit(1), F.floor(F.lit(sample) / F.count("*").over(Window.partitionBy())))
    wanted = langs.select("lang", "n", each.alias("each"))
    share = F.least(F.lit(1.0), (1.2 * F.col("each") + 100) / F.col("n"))
    few = rows.join(F.broadcast(wanted), "lang").where(F.col("key") / F.lit(2.0**64) + 0.5 <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", F.xxhash64("text")))
    return few.withColumn("rank", rank).where("rank <= each").orderBy("lang", "rank").select("lang", "text")


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model of the labelled documents that are not held out."""
    drawn = sample_rows(docs, text_col, sample)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for batch in batches:
            rows, labels = [], batch["lang"].tolist()
            for counts, letters in counter.features(batch["text"].tolist()):
                for row, n in zip(counts, letters):
                    at = np.flatnonzero(row) if n else np.zeros(0, int)
                    rows.append((labels[len(rows)], at.astype("<u2").tobytes(), row[at].astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "buckets", "counts"])

    rows = [r for r in drawn.select("lang", "text").mapInPandas(sparse, "lang string, buckets binary, counts binary").collect() if len(r[1])]
    if not rows:
        return None
    counts = np.zeros((len(rows), BUCKETS), np.int64)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r[1], "<u2")] = np.frombuffer(r[2], "<u4")
    return fit(scale(counts), [r[0] for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``: (lang_pred, score, ambiguous)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter, known = Counter(), sent.value
        for texts in batches:
            preds: list[str] = []
            scores: list[float] = []
            flags: list[bool] = []
            for counts, letters in counter.features([t or "" for t in texts]):
                best, score, near = (np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters), bool)) if known is None else known.decode(scale(counts))
                sure = (letters > 0) & (known is not None)
                preds += [known.langs[k] if ok else "und" for k, ok in zip(best, sure)]
                scores += np.where(sure, np.clip(score, 0.0, 1.0), 0.0).tolist()
                flags += (near | ~sure).tolist()
            yield pd.DataFrame({"lang_pred": preds, "score": np.array(scores, float), "ambiguous": np.array(flags, bool)})

    return docs.withColumn("found", predict(F.col(text_col)))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns and the ambiguity flag."""
    model = learn(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.ambiguous")
