"""Personal data: fixed patterns and a linear-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers, each leftmost and non-overlapping. The field adds person names and
personal numbers from the shapes of words and of their neighbours: it is
trained by gradient ascent on a small labelled table (``LABELLED`` below, or
the caller's own) and decoded by Viterbi in numpy over batches of lines.

A line is decoded only if some word of it could outweigh the all-outside path:
with every word's best gain over "outside", plus the most that transitions can
add, at or below zero, that path is optimal, so the screen changes no result.

The cues are titles and phrases around names, not names: a name is known by
its shape and place alone.

Workers get the trained weights (a few hundred numbers) with the function;
texts are read whole, one by one, and memory is bounded by the longest line.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; a field span that touches a pattern span is dropped; repeated
rows have equal spans; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("name", "id")

# --- patterns -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, which the look-behind
#: says outright so that long digit runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` outwards."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            pos = end.end()
            out.append((start, pos))
        at = text.find("@", max(at + 1, pos))
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", *span) for span in find_emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- the field ------------------------------------------------------------------

OUT, BEGIN, INSIDE, NUMBER = range(4)
LABELS = 4
#: An "inside" follows only a "begin" or an "inside".
NEVER = -1e4

#: Cue words by group.
CUES = {
    "title": "mr mrs ms dr prof professor herr frau monsieur madame mme señor señora",
    "called": "name named called signed contact regards sincerely dear attn nom heißt nombre llamo",
    "number": "ssn passport license licence social insurance taxpayer",
    "link": "is am are was the of and to a an number no nr id from by for in on le la el der die das",
}
_CUE = {w: group for group, text in CUES.items() for w in text.split()}
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’*%$#&|"

#: The labelled table: sentences in which [..] marks a name and {..} a personal
#: number. ``table()`` adds the frames below, each filled with all names.
LABELLED = (
    "Please contact [Maria Lopez] about the order.",
    "My name is [John Carter] and I live here.",
    "Contact [Peter Novak] or call the office.",
    "Dr. [Susan Miller] signed the report yesterday.",
    "We met Mr. [Brown] at the station.",
    "Mrs. [Linda Green] called this morning.",
    "Regards, [David Stone]",
    "Sincerely, [Karen Hill]",
    "Dear Mr. [Thomas Reed] , thank you for the letter.",
    "The letter was signed by [Anna Schmidt] on Monday.",
    "Prof. [Klaus Weber] gave the talk.",
    "Herr [Hans Meier] wohnt in der Stadt.",
    "Frau [Ingrid Braun] ist heute nicht da.",
    "Madame [Claire Dubois] est dans la maison.",
    "Monsieur [Pierre Martin] est parti.",
    "Señora [Carmen Ruiz] vive en la casa.",
    "Señor [Juan Torres] no está.",
    "Me llamo [Carlos Vega] y vivo aquí.",
    "Her SSN is {536-22-1984} and must stay private.",
    "ssn {219-09-9999} was on the form.",
    "Social insurance number {078-05-1120} is listed.",
    "The passport number {123-45-6789} has expired.",
    "Name: [Laura Bennett] SSN: {414-55-2020}",
    "Mr. [Paul King] and Mrs. [Sarah King] were there.",
    "Attn: [Michael Ford]",
    # Running text without personal data, in which capitals and numbers mean nothing.
    "The house by the river was sold. They moved away in May.",
    "In London the Museum of Natural History opens at nine on Sundays.",
    "Chapter Four. The Return Of The Ships. It was late.",
    "North America and Western Europe signed the treaty in Geneva.",
    "On Monday the Supreme Court called the witness. The hearing was short.",
    "We named the boat Sea Breeze and sailed to Crete.",
    "The Old Bridge Is Closed. The New One Was Opened In Spring.",
    "The Red Lion was a pub. The White Horse Is An Inn.",
    "Contact Sales or Technical Support at any time.",
    "The name of the town is Old Harbour, and nobody knows why.",
    "Contact the office. Name the parts. Signed copies are here.",
    "Please contact the nearest branch, or call the main number.",
    "the name of the thing is not called for in the text",
    "we called the office and signed the form for the order",
    "Dear all, the meeting is moved to Tuesday.",
    "Dear reader, thank you. Regards to everyone at home.",
    "Signed. Sealed. Delivered. The end.",
    "The doctor said so. Dr. is short for doctor, Mr. for mister.",
    "Total 1234 items, 56 units and 7890 parts in 2021.",
    "Version 10.2.3 of 12-04-2020 and 555-1234 or 12-345.",
    "Call 555-0100 before 10:30, room 12-B, code 77-4120-9.",
    "The passport office is closed. Social insurance is a tax.",
    "The license of the software and the passport of the ship are lost.",
    "NOTICE THE AND OF THE LICENSE. ALL RIGHTS ARE HERE.",
    "Copyright 2019 The Authors. All rights reserved.",
    "is licensed under the GNU General Public License, Version 2",
    "Home | About Us | Contact | News And Events | Sign In",
    "Red Apples Red Apples Red Apples Green Pears and Plums.",
    "Very good. Very good. Very Good. VERY GOOD news today.",
    "by Land and Sea, from East to West, for King and Country",
    "*** Special Offer *** Buy One. Get One. Today %%% Only &&&",
    "Als der Regen kam, gingen die Leute in das Haus am Markt.",
    "Der Bericht über die Lage der Wirtschaft wurde in Berlin vorgestellt.",
    "Die Stadt heißt Neustadt und liegt an der Donau.",
    "Am Montag hat der Ausschuss die Entscheidung über den Antrag vertagt.",
    "Unter dem Namen Alte Brücke kennt jeder das Bauwerk von Heidelberg.",
    "Das Buch von der Reise nach Indien und der Weg des Wassers.",
    "Le train de Paris est arrivé à Lyon avec une heure de retard.",
    "La maison des Quatre Vents est au bord de la Loire.",
    "Le nom de la rue est Grande Rue, près de la Place du Marché.",
    "Selon le Journal Officiel, la loi est entrée en vigueur en Janvier.",
    "El mercado de la Plaza Mayor abre los sábados por la mañana.",
    "La ciudad de Granada y el río Guadalquivir están en el sur.",
    "El nombre de la calle es Gran Vía y va de este a oeste.",
    "Según el Banco Central, los precios de la energía bajaron en Abril.",
)


NAMES = (
    "Adam Smith", "Olga Petrov", "Jane Anne Doe", "Maria Garcia", "Peter Black", "Ivan Horvat", "Lucia Fernandez",
    "Hans Peter Vogel", "Chloe Moreau", "Ahmed Khan",
)
FRAMES = (
    "My name is [N]. The rest is here.", "Please write to Mr. [N], or call the office.", "Contact [N] today.",
    "and Dr [N] was there", "Regards, [N]", "it was signed by [N] and sent.", "Mrs. [N] is away.",
)


def table() -> tuple[str, ...]:
    """The whole labelled table."""
    filled = (frame.replace("[N]", f"[{name}]") for frame in FRAMES for name in NAMES)
    return (*LABELLED, *filled)


def _shape(core: str) -> str:
    if core.isalpha():
        if core.islower():
            return "x"
        if core[0].isupper() and (len(core) == 1 or core[1:].islower()):
            return "Xx" if len(core) > 1 else "X"
        return "mixed" if not core.isupper() else "XX"
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", core):
        return "ddd-dd-dddd"
    if not core:
        return "none"
    return "digits" if any(c.isdigit() for c in core) else "other"


def word_features(word: str) -> tuple[str, str, bool]:
    """(shape, cue group, ends a clause): all that the field sees of a word."""
    core = word.strip(_EDGE)
    return _shape(core), _CUE.get(core.lower(), ""), core != "" and not word.endswith(core) and word[-1] in ".,;:!?"


#: Where a seen word stands: its distance from the word that is labelled.
PLACES = {"self": 0, "prev": -1, "next": 1, "prev2": -2}


def _named_features(feats: tuple[str, str, bool] | None, place: str) -> list[str]:
    if feats is None:
        return [f"{place}:edge"]
    if place == "prev2":
        return [f"{place}:cue={feats[1]}"]
    shape, cue, stop = feats
    return [f"{place}:shape={shape}", f"{place}:cue={cue}", f"{place}:stop={stop}", f"{place}:both={shape}/{cue}/{stop}"]


def read_labelled(marked: str) -> tuple[list[str], list[int]]:
    """Words and labels of a marked sentence."""
    words, labels, state = [], [], OUT
    for raw in marked.split():
        opens = re.search(r"[\[{]", raw)
        if opens:
            state = BEGIN if opens[0] == "[" else NUMBER
        words.append(re.sub(r"[\[\]{}]", "", raw))
        labels.append(state)
        if re.search(r"[\]}]", raw):
            state = OUT
        elif state == BEGIN:
            state = INSIDE
    return words, labels


class Field:
    """Weights of a linear-chain field and the batched decoder."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights = weights
        self.moves = moves
        self.words: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.rows = np.zeros((len(PLACES), 0, LABELS))
        self.edge = {place: self._sum(None, place) for place in PLACES}
        rel = moves - moves[OUT, OUT]
        self.leave = np.maximum(0.0, rel[1:, OUT])
        self.slack = rel[:, 1:].max(0) + self.leave
        self.plain = self._learn_kind(("x", "", False))

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__init__(state["weights"], state["moves"])

    def _sum(self, feats, place) -> np.ndarray:
        zero = np.zeros(LABELS)
        return sum((self.weights.get(f, zero) for f in _named_features(feats, place)), zero)

    def _learn_kind(self, feats: tuple) -> int:
        row = self.kinds.get(feats)
        if row is None:
            row = self.kinds[feats] = len(self.kinds)
            new = np.stack([self._sum(feats, place) for place in PLACES])[:, None, :]
            self.rows = np.concatenate([self.rows, new], axis=1)
        return row

    def _learn_word(self, word: str) -> int:
        simple = word.islower() and word.isalpha() and word not in _CUE
        row = self.plain if simple else self._learn_kind(word_features(word))
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[word] = row
        return row

    def emissions(self, lines: list[list[str]]) -> np.ndarray:
        """[word, label] scores of the words of non-empty lines, line after line."""
        look = self.words.get
        words = [w for line in lines for w in line]
        ids = [look(w, -1) for w in words]
        ids = np.array([k if k >= 0 else self._learn_word(w) for k, w in zip(ids, words)] if -1 in ids else ids)
        size = np.array([len(line) for line in lines])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place_in_line = np.arange(len(ids)) - np.repeat(first, size)
        to_end = np.repeat(size, size) - 1 - place_in_line
        out = self.rows[0][ids]
        for n, (place, step) in enumerate(PLACES.items()):
            if step:
                seen = np.roll(self.rows[n][ids], -step, axis=0)
                beyond = place_in_line < -step if step < 0 else to_end < step
                seen[beyond] = self.edge[place]
                out += seen
        return out

    def can_hold(self, emissions: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The lines, named by the ends of their words, that may hold a span.

        A span opens with a "begin" or a "number". With each word's gain over
        "outside" raised by the most that transitions can add, and with what
        all later words of the line could add as "inside", a line without a
        positive sum is best outside throughout. No move leads to the first
        word of a line.
        """
        gain = emissions[:, 1:] - emissions[:, :1] + self.slack
        first = np.concatenate([[0], ends[:-1]]).astype(int)
        gain[first] = emissions[first, 1:] - emissions[first, :1] + self.leave
        inside = np.cumsum(np.maximum(gain[:, INSIDE - 1], 0.0))
        line = np.searchsorted(ends, np.arange(len(gain)), side="right")
        later = inside[ends - 1][line] - inside
        can = (gain[:, BEGIN - 1] + later > -1e-9) | (gain[:, NUMBER - 1] + later > -1e-9)
        return np.unique(line[can])

    def decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences of many lines, by Viterbi over padded batches."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            longest = len(lines[order[at]])
            end = at
            while end < len(order) and len(lines[order[end]]) <= max(16, 2 * longest) and end - at < 1024:
                end += 1
            group = order[at:end]
            width = len(lines[group[-1]])
            padded = np.zeros((len(group), width, LABELS))
            size = np.array([len(lines[i]) for i in group])
            for k, i in enumerate(group):
                padded[k, : size[k]] = lines[i]
            best = padded[:, 0].copy()
            best[:, INSIDE] = NEVER
            came = np.zeros((width, len(group), LABELS), np.int8)
            for t in range(1, width):
                paths = best[:, :, None] + self.moves
                came[t] = paths.argmax(1)
                step = paths.max(1) + padded[:, t]
                best = np.where((t < size)[:, None], step, best)
            label = best.argmax(1)
            labels = np.zeros((len(group), width), np.int8)
            rows = np.arange(len(group))
            for t in range(width - 1, -1, -1):
                inside = t < size
                labels[inside, t] = label[inside]
                if t:
                    label = np.where(inside, came[t][rows, label], label)
            for k, i in enumerate(group):
                out[i] = labels[k, : size[k]]
            at = end
        return out


def train(labelled=None, rounds: int = 300, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Fit by full-batch gradient ascent with L2; the result is deterministic."""
    data = [read_labelled(s) for s in labelled or table()]
    names: dict[str, int] = {}
    seqs = []
    for words, labels in data:
        feats = [word_features(w) for w in words]
        rows = []
        for i in range(len(feats)):
            seen = {place: i + step for place, step in PLACES.items()}
            used = [u for place, j in seen.items() for u in _named_features(feats[j] if 0 <= j < len(feats) else None, place)]
            rows.append([names.setdefault(u, len(names)) for u in used])
        seqs.append((rows, labels))
    width, count = max(len(r) for r, _ in seqs), len(seqs)
    x = np.zeros((count, width, len(names)))
    y = np.zeros((count, width), int)
    size = np.array([len(r) for r, _ in seqs])
    for n, (rows, labels) in enumerate(seqs):
        y[n, : len(labels)] = labels
        for t, row in enumerate(rows):
            x[n, t, row] = 1.0
    mask = np.arange(width) < size[:, None]
    w, moves = np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS))
    free = moves.copy()
    gold = np.eye(LABELS)[y] * mask[..., None]
    pair_mask = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("nta,ntb,nt->ab", np.eye(LABELS)[y[:, :-1]], np.eye(LABELS)[y[:, 1:]], pair_mask)
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(moves)
    barred = np.zeros_like(moves)
    barred[[OUT, NUMBER], INSIDE] = NEVER

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for _ in range(rounds):
        e, moves = x @ w, free + barred
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        forward[:, 0, INSIDE] = NEVER
        for t in range(1, width):
            forward[:, t] = lse(forward[:, t - 1][:, :, None] + moves, 1) + e[:, t]
        for t in range(width - 2, -1, -1):
            step = lse(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1][:, None], step, 0.0)
        last = forward[np.arange(count), size - 1]
        total = lse(last, 1)
        chance = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        pair = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.where(pair_mask[:, :, None, None], np.exp(np.minimum(pair, 0.0)), 0.0).sum((0, 1))
        grad_w = np.einsum("ntf,nta->fa", x, gold - chance) - decay * w
        grad_m = gold_moves - pair - decay * free
        speed_w, speed_m = speed_w + grad_w**2, speed_m + grad_m**2
        w += rate * grad_w / np.sqrt(speed_w + 1e-8)
        free += rate * grad_m / np.sqrt(speed_m + 1e-8)
    return Field({name: w[i] for name, i in names.items()}, free + barred)


_WORD = re.compile(r"\S+")  # as str.split() has it


def field_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Names and numbers of a text, by kind, then start."""
    lines, starts, at = [], [], 0
    for line in text.split("\n"):
        words = line.split()
        if words:
            lines.append(words)
            starts.append((at, line))
        at += len(line) + 1
    if not lines:
        return []
    scores = field.emissions(lines)
    ends = np.cumsum([len(line) for line in lines])
    hot = field.can_hold(scores, ends)
    held = [(starts[i][0], list(_WORD.finditer(starts[i][1]))) for i in hot]
    best = field.decode([scores[ends[i] - len(lines[i]) : ends[i]] for i in hot])
    out = []
    for (start, marks), labels in zip(held, best):
        i = 0
        while i < len(labels):
            if labels[i] == OUT:
                i += 1
                continue
            kind, end = ("id" if labels[i] == NUMBER else "name"), i + 1
            while kind == "name" and end < len(labels) and labels[end] == INSIDE:
                end += 1
            raw, last = marks[i][0], marks[end - 1][0]
            a = marks[i].start() + len(raw) - len(raw.lstrip(_EDGE))
            b = marks[end - 1].end() - (len(last) - len(last.rstrip(_EDGE)))
            if a < b:
                out.append((kind, start + a, start + b))
            i = end
    return sorted(out, key=lambda s: (FIELD_KINDS.index(s[0]), s[1]))


def all_spans(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    """Pattern spans, then field spans that touch none of them."""
    if not text:
        return []
    base, found = base_spans(text), field_spans(text, field)
    if not base or not found:
        return base + found
    # A span touches one of those that begin before its end if the furthest of
    # their ends is beyond its start.
    begins, ends = zip(*sorted((a, b) for _, a, b in base))
    furthest = list(accumulate(ends, max))
    before = [bisect_left(begins, end) for _, _, end in found]
    return base + [s for s, k in zip(found, before) if not k or furthest[k - 1] <= s[1]]


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each stretch of spans replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at, until, kind = [], 0, -1, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < until:
            until = max(until, b)
            continue
        if until >= 0:
            out.append(f"[{kind.upper()}]")
            at = until
        out.append(text[at:a])
        at, until, kind = a, b, k
    return "".join([*out, f"[{kind.upper()}]", text[until:]])


def spans_column(text: Column, field: Field | None = None) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    field = field or train()

    @F.pandas_udf("string")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([",".join(f"{k}:{a}:{b}" for k, a, b in all_spans(t, field)) for t in batch], dtype=object)

    return find(text)


def masked_column(text: Column, field: Field | None = None) -> Column:
    """The text with its personal data masked; null stays null."""
    field = field or train()

    @F.pandas_udf("string")
    def cover(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([mask(t, all_spans(t, field)) for t in batch], dtype=object)

    return cover(text)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end)."""
    spans = F.filter(F.split(spans_column(F.col(text_col)), ","), lambda x: x != "")
    parts = F.transform(spans, lambda x: F.split(x, ":"))
    return docs.withColumn("spans", F.transform(parts, lambda p: F.struct(
        p[0].alias("kind"), p[1].cast("int").alias("start"), p[2].cast("int").alias("end"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in the text masked."""
    return docs.withColumn(text_col, masked_column(F.col(text_col)))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = docs.select("doc_id", spans_column(F.col("text")).alias("spans"))
    listed = found.withColumn("_all", F.filter(F.split("spans", ","), lambda x: x != ""))
    kind = lambda x: F.substring_index(x, ":", 1)
    count = lambda k: F.size(F.filter("_all", lambda x: kind(x) == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in (*BASE_KINDS, *FIELD_KINDS)]
    base = F.array_join(F.filter("_all", lambda x: kind(x).isin(*BASE_KINDS)), ",")
    return listed.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), "spans")
