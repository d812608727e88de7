"""Toxicity: misspelling-tolerant lexicon matches, weighed by their context.

Lexicon. Terms are learned from all labelled documents: words that stand in
toxic texts far more often than in others (by counts of distinct texts, made by
Spark, as copies are no evidence of their own). Callers without labels can give
terms. A word of any length is a term if the
Chernoff bound of its counts arising by chance, times the number of words
tried, is below ``DOUBT``; the lexicon is as large as the evidence makes it.
Words are cut in one place (``tokens``), for learning and for matching. Each
labelled document is cut once, to its distinct words; misspellings are then
sought in the table of words and their counts, not in the documents again.

Matching. The terms form a trie. A Levenshtein automaton of the allowed
distance runs along it: a state is the set of (trie node, edits) pairs that a
word's letters so far can reach. States are made when first met and kept, so
that a worker turns the product of automaton and trie into a plain table and a
word costs one step for each letter until its state is empty. Terms of four
letters allow one edit, of nine two; shorter ones none, and neither do learned
terms whose misspellings turn out to be common in other documents. A word that
only looks like a misspelling is dropped after ``CLEAN_DOCS`` other documents.

Context. A match inside quotation marks, or within ``WINDOW`` words of a word
of reporting, counts as quoted; one within the window of "you" or another match
counts as aimed. The log-odds of the text's terms are summed by context, a
misspelled match weighing less than an exact one; the sums, the number of aimed
matches and the matches' share of all words are the features of a logistic
regression with weights of at least 0 that the driver fits. The weights are
fitted on at most ``SAMPLE`` label rows, the first by a keyed hash of their ids;
that bound is also what is broadcast to find their documents.

Sizes. Up to ``BROADCAST`` label rows, which are counted first, are broadcast
to the documents, so that texts without a label go nowhere; more are joined
through a shuffle, with the same rows. The driver gets the lexicon and the
words that only look like a misspelling of it: strings within two edits of a
term that stand in ``CLEAN_DOCS`` or more documents. ``most`` bounds the terms
for callers who want that; none is the default.

Rows whose CRC-32 of the id is 0 modulo 5 are never learned from. Scores use
the text alone.

Defined results: a null or empty text has no match and gets the score of that;
without labelled rows of both classes fixed weights are used; repeated rows get
equal scores; a label row without a document, or of a null id, is not used, and
a document with several labels counts once for each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import draw
from graphloom.session import cut

#: Label rows that the fit may use.
SAMPLE = 8000
#: Label rows (an id and a flag) up to which they are broadcast.
BROADCAST = 1_000_000
WINDOW = 6
#: A learned term's least number of toxic documents and least odds against others.
LEAST_DOCS, LEAST_ODDS = 3, 12.0
#: The chance that any learned term is one by chance, and the least number of
#: other documents that speak against a misspelling.
DOUBT, CLEAN_DOCS = 0.05, 3
#: The weights used without labels.
FALLBACK = (1.0, 0.2, 0.5, 0.3)
#: Cues of reporting and of address.
REPORTING = frozenset("said says wrote quoted quote called cited reported stated according term word phrase".split())
ADDRESS = frozenset("you your youre yourself u du dich ihr vous toi tu ustedes".split())
_OPEN, _CLOSE, _BOTH = "“«„‹", "”»“›", '"'
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„‹›]")
FEATURES = ("evidence", "quoted", "aimed", "share")
#: What a match counts by its number of edits.
EDIT_WEIGHT = (1.0, 0.7, 0.5)


def tokens(text: str) -> list[str]:
    """Words and quotation marks in lower case; an apostrophe belongs to a word only within it."""
    return _TOKEN.findall(text.lower())


def edits_allowed(term: str) -> int:
    """Misspellings a term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms, walked by a Levenshtein automaton."""

    def __init__(self, terms, rigid=()):
        self.rigid = frozenset(rigid)
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.limit: list[int] = [0]
        for term in sorted(set(terms)):
            node, allowed = 0, self.allowed(term)
            self.limit[0] = max(self.limit[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.limit.append(0)
                node = self.next[node][c]
                self.limit[node] = max(self.limit[node], allowed)
            self.term[node] = term
        self.alphabet = {c for below in self.next for c in below}
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.first = self._state({0: 0})

    def allowed(self, term: str) -> int:
        return 0 if term in self.rigid else edits_allowed(term)

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Add the nodes reached by leaving out a term's letters."""
        out, todo = dict(state), list(state)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                cost = out[node] + 1
                if cost <= self.limit[child] and cost < out.get(child, 99):
                    out[child] = cost
                    todo.append(child)
        return out

    def _state(self, state: dict[int, int]) -> int:
        closed = self._close(state)
        name = frozenset(closed.items())
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = len(self.states)
            self.states.append(closed)
            self.steps.append({})
            hits = [(cost, self.term[n]) for n, cost in closed.items() if self.term[n] is not None and cost <= self.allowed(self.term[n])]
            self.ends.append(min(hits)[::-1] if hits else None)
        return number

    def _step(self, number: int, c: str) -> int:
        """The state after letter ``c``; -1 if no term can be reached."""
        after: dict[int, int] = {}
        for node, cost in self.states[number].items():
            if cost + 1 <= self.limit[node]:  # a letter too many
                after[node] = min(after.get(node, 99), cost + 1)
            for label, child in self.next[node].items():  # the letter, or another one for it
                paid = cost + (label != c)
                if paid <= self.limit[child]:
                    after[child] = min(after.get(child, 99), paid)
        out = self.steps[number][c] = self._state(after) if after else -1
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed distance."""
        at, steps, alphabet = self.first, self.steps, self.alphabet
        for c in word:
            c = c if c in alphabet else "\0"
            to = steps[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return None
            at = to
        return self.ends[at]


class Reader:
    """Feature rows of texts; keeps the words it has matched, up to a bound."""

    def __init__(self, terms: dict[str, float], rigid=(), ordinary=()):
        self.lexicon = Lexicon(terms, rigid)
        self.odds = dict(terms)
        self.ordinary = frozenset(ordinary)
        self.known: dict[str, tuple[str, int] | None] = {}

    def match(self, word: str):
        if word in self.known:
            return self.known[word]
        if len(self.known) > 200_000:
            self.known.clear()
        found = self.lexicon.match(word)
        if found and found[1] and word in self.ordinary:
            found = None
        self.known[word] = found
        return found

    def hits(self, text: str) -> tuple[list[tuple[int, str, int]], list[str]]:
        """(token number, term, edits) of each match, and all tokens."""
        found_words = tokens(text)
        match, known = self.match, self.known
        out = []
        for i, w in enumerate(found_words):
            found = known[w] if w in known else match(w)
            if found is not None:
                out.append((i, *found))
        return out, found_words

    def features(self, text: str | None) -> list[float]:
        """The values of FEATURES."""
        hits, words = self.hits(text or "")
        if not hits:
            return [0.0] * len(FEATURES)
        marks = [i for i, w in enumerate(words) if len(w) == 1 and w in _OPEN + _CLOSE + _BOTH]
        inside = self._inside(words, marks)
        at = [i for i, _, _ in hits]
        plain: dict[str, float] = {}
        cited: dict[str, float] = {}
        aim = total = 0.0
        for n, (i, term, edits) in enumerate(hits):
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = i in inside or any(w in REPORTING for w in near)
            aimed = any(w in ADDRESS for w in near) or (n and i - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - i <= WINDOW)
            weight = EDIT_WEIGHT[edits]
            best = cited if quoted else plain
            best[term] = max(best.get(term, 0.0), weight * self.odds[term])
            aim += weight * (bool(aimed) and not quoted)
            total += weight * (0.3 if quoted else 1.0)
        share = 100 * total / len(words)
        return [sum(plain.values()), sum(cited.values()), math.log1p(aim), math.log1p(share)]

    @staticmethod
    def _inside(words: list[str], marks: list[int]) -> set[int]:
        """The tokens between paired quotation marks at most 60 tokens apart."""
        out: set[int] = set()
        start = None
        for i in marks:
            closes = start is not None and words[i] in _CLOSE + _BOTH and i - start <= 60
            if closes:
                out.update(range(start + 1, i))
                start = None
            else:
                start = i if words[i] in _OPEN + _BOTH else None
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps with a ridge, weights at least 0."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), 0.05)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge * w
        free = (w > 0) | (grad > 0)
        free[-1] = True
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        w[free] += 0.7 * np.linalg.solve(curve[np.ix_(free, free)], grad[free])
        w[:-1] = np.maximum(w[:-1], 0.0)
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the sampled rows that may be learned from."""
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    drawn = draw(labels.where(usable).select("doc_id", "toxic"), "doc_id", sample, 29)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    return cut(found.select("text", "toxic"), "toxic-sample")


def learnable(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(words, toxic): the distinct words of each distinct text that may be learned from, once for each mark.

    Of documents with one text and mark the least id stands for all, so a first pass digests the labelled
    texts and a second one cuts those that are left; texts themselves go nowhere.
    """
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marked = labels.where(usable & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    texts = docs.select("doc_id", "text").where(usable & F.col("text").isNotNull())
    few = marked.limit(broadcast + 1).count() <= broadcast
    met = lambda rows: texts.join(F.broadcast(rows) if few else rows.hint("merge"), "doc_id")
    digests = met(marked).groupBy(F.unhex(F.sha2("text", 256)).alias("digest"), "toxic").agg(F.min("doc_id").alias("doc_id"))
    found = met(cut(digests.select("doc_id", "toxic").distinct(), "toxic-distinct"))

    @F.pandas_udf("array<string>")
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([sorted(set(tokens(t))) for t in rows], dtype=object)

    return cut(found.select(distinct(F.col("text")).alias("words"), "toxic"), "toxic-learnable")


def count_words(rows: DataFrame) -> DataFrame:
    """(word, bad, n): each word's toxic documents and all its documents."""
    each = rows.select(F.explode("words").alias("word"), F.col("toxic").cast("long").alias("bad"))
    each = each.where(~F.col("word").isin(*_OPEN, *_CLOSE, *_BOTH))
    return cut(each.groupBy("word").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")), "toxic-words")


def learn_terms(rows: DataFrame, counts: DataFrame, most: int | None = None) -> dict[str, float]:
    """Words of far more toxic texts than others, with their log-odds.

    With a share ``p`` of toxic documents, chance puts ``bad`` or more of a
    word's ``n`` documents among them with a probability of at most
    ``exp(-n KL(bad / n, p))``.
    """
    totals = rows.agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n")).head()
    if not totals["n"] or not totals["bad"] or totals["bad"] == totals["n"]:
        return {}
    bad, good = totals["bad"], totals["n"] - totals["bad"]
    tried = counts.where(F.col("bad") >= LEAST_DOCS)
    odds = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    clean = F.col("n") - F.col("bad")
    base, share = bad / totals["n"], F.col("bad") / F.col("n")
    against = F.when(clean > 0, clean * F.log(clean / F.col("n") / (1 - base))).otherwise(0.0)
    evidence = F.col("bad") * F.log(share / base) + against
    sure = (share > base) & (evidence >= math.log(max(1, tried.count()) / DOUBT))
    found = tried.withColumn("odds", F.log(odds)).where((F.col("odds") >= math.log(LEAST_ODDS)) & sure)
    if most is not None:
        found = found.orderBy(F.desc(evidence), "word").limit(most)
    return {r["word"]: r["odds"] for r in found.collect()}


def common_misspellings(counts: DataFrame, terms: dict[str, float], known=()) -> tuple[list[str], list[str]]:
    """Learned terms whose misspelled matches are no sign of toxicity, and
    words that only look like a misspelling of another term. ``known`` terms stay open to misspellings."""
    sent = counts.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("string")
    def misspelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(sent.value)
        for words in batches:
            hits = map(lexicon.match, words)
            yield pd.Series([hit[0] if hit and hit[1] else None for hit in hits], dtype=object)

    each = counts.select(misspelled(F.col("word")).alias("term"), "word", "bad", "n")
    each = cut(each.where("term IS NOT NULL"), "toxic-near")
    clean = (2 * F.col("bad") < F.col("n")) & (F.col("n") - F.col("bad") >= CLEAN_DOCS)
    by_term = each.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(clean).collect()
    rigid = sorted(r["term"] for r in by_term if r["term"] not in known)
    words = each.where(clean & ~F.col("term").isin(rigid)).select("word").collect()
    return rigid, sorted(r["word"] for r in words)


def feature_rows(df: DataFrame, lexicon: tuple, carry: list[str]) -> DataFrame:
    """``carry`` and ``x``, the features of the text."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(*sent.value)
        for texts in batches:
            yield pd.Series([reader.features(t) for t in texts], dtype=object)

    return df.select(*carry, read(F.col("text")).alias("x"))


def learn(docs: DataFrame, labels: DataFrame, known: dict[str, float] | None = None) -> tuple[tuple, np.ndarray, float]:
    """The lexicon (terms, those that allow no misspelling, words that are none),
    weights and bias. ``known`` gives terms and log-odds beside those learned."""
    every = learnable(docs, labels)
    counts = count_words(every)
    terms = (known or {}) | learn_terms(every, counts)
    lexicon = (terms, *common_misspellings(counts, terms, known or ()))
    seen = feature_rows(labelled(docs, labels), lexicon, ["toxic"]).collect()
    y = np.array([float(r["toxic"] > 0) for r in seen])
    if len(set(y)) < 2:
        return lexicon, np.array(FALLBACK), -3.0
    return lexicon, *fit(np.array([r["x"] for r in seen]), y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score by a model of ``learn``."""
    lexicon, weights, bias = model
    rows = feature_rows(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    total = F.lit(float(bias))
    for k, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.col("x")[k]
    return rows.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
