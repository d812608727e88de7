"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows a public SentencePiece BPE model: of all neighbouring symbols
whose join is a piece, the pair with the best score is merged, the leftmost of
equals first, until none is left; characters outside the vocabulary become
byte pieces. With dropout, a candidate merge that the agenda comes to is
skipped for good if a keyed hash of it falls below the rate. The key is made of
the seed, the word's variant and bytes (or the text's bytes and the word's
place in it), and the candidate's start, middle and end, so a candidate's fate
is fixed before any merge is done: retried tasks and other machines give the
same pieces. With a rate of 0 the pieces are those of the library.

No piece joins a blank to text before it, so a text is cut before each run of
blanks, which changes no merge. With ``variants=None``, the default of the functions on
documents, each occurrence of a word has a key of its own, and any segmentation that dropout can give
occurs. If it skips none of the candidates that the word's agenda comes to, it has the word's pieces.
If it skips some, what the agenda makes without these is worked out once for the word, a fork, with
the candidates that only it comes to; an occurrence that skips none of them has the fork's
pieces, and others are merged for themselves. So are words and forks that are met once; only what is
met again is kept, as most are not. With a number, each occurrence
is given one of so many variants by a hash of its text and place, and each
variant of a word has merges of its own; a worker merges a (word, variant) once
and looks it up from then on. Merging runs over many words at once in numpy; words of over
``LONG`` characters, such as texts without blanks, go through a heap of
candidates, in time n log n.

Decoding joins the pieces' bytes. It gives the text back exactly, whatever was
skipped; a literal U+2581, which the model would read as a blank, is written
as byte pieces so that it survives too.

The model file is read by the driver and sent to the workers as half a
megabyte; its path is a parameter. Workers keep a bounded table of words.

Defined results: null gives null pieces and counts as an empty text in
``query``; an empty text has no pieces; equal texts have equal pieces; other
columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 7
VARIANTS = 8
BLANK = 0x2581
#: Words of more characters are merged one by one, with a heap.
LONG = 192
#: Slots of a worker's word table, and characters handled at once.
SLOTS, GROUP = 150_000, 600_000
#: Forks that a worker keeps, and how many of a word's candidates they tell apart; what is beyond is merged for itself.
FORKS, TOLD = 200_000, 43
#: Pieces and candidates that a worker keeps for its words and forks.
PIECES, MET = 6_000_000, 3_000_000
#: Bits of a hash by which words and forks are known to have been met before; others that share them are kept too.
BEFORE = 22
_NONE = np.int32(2**31 - 1)
_WORDS = re.compile(r" *[^ \n]+|\n| +")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):  # numpy tells of overflow for single numbers
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def candidate_hash(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The keyed hash that decides whether a candidate merge is skipped."""
    place = (np.asarray(start, np.uint64) << np.uint64(42)) ^ (np.asarray(middle, np.uint64) << np.uint64(21)) ^ np.asarray(end, np.uint64)
    return mix64(np.asarray(key, np.uint64) ^ mix64(place + np.uint64(1)))


def _place(row: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row and a candidate of a word of at most LONG characters as one number."""
    return np.asarray(row, np.int64) << 24 | np.asarray(start, np.int64) << 16 | np.asarray(middle, np.int64) << 8 | np.asarray(end, np.int64)


class _Slots(dict):
    """Word to slot; an unseen word gets the next one."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word):
        slot = self[word] = len(self.words)
        self.words.append(word)
        return slot


class Segmenter:
    """Encodes and decodes with one model, in batches."""

    def __init__(self, model: bytes, rate: float = RATE, seed: int = SEED, variants: int | None = VARIANTS):
        import sentencepiece

        self.rate, self.seed = rate, seed
        self.variants = variants
        self.width = variants if rate > 0 and variants else 1
        self.limit = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
        # Symbols: pieces by their ids, then characters that are no piece.
        self.symbols = {names[i]: i for i in range(size) if plain[i]}
        self.spelled: list[list[int]] = [[i] for i in range(size)]
        self.by_char = np.full(0x110000, -1, np.int32)
        for name, i in self.symbols.items():
            if len(name) == 1:
                self.by_char[ord(name)] = i
        for name in [n for n in self.symbols if len(n) > 1]:
            for c in name:
                if c not in self.symbols:
                    self.symbols[c] = self._spell(ord(c))
        blank = chr(BLANK)
        self.by_char[BLANK] = -1
        self.by_char[0x20] = self.symbols[blank]
        if any(blank in n.lstrip(blank) for n in self.symbols):
            raise ValueError("a piece joins text across a blank; this model can't be cut into words")
        lefts, rights, whole, score = [], [], [], []
        for name, i in list(self.symbols.items()):
            if i < size:
                for k in range(1, len(name)):
                    left, right = self.symbols.get(name[:k]), self.symbols.get(name[k:])
                    if left is not None and right is not None:
                        lefts.append(left)
                        rights.append(right)
                        whole.append(i)
                        score.append(sp.get_score(i))
        pair = np.array(lefts, np.int64) << 32 | np.array(rights, np.int64)
        order = np.argsort(pair)
        self.pairs, self.joined = pair[order], np.array(whole, np.int32)[order]
        # Ranks: equal scores share one, so that the leftmost goes first.
        self.rank = np.unique(-np.array(score, np.float64), return_inverse=True)[1].astype(np.int32)[order]
        data = [bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else b"" if not plain[i] else n.replace(blank, " ").encode() for i, n in enumerate(names)]
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.piece_size = np.array([len(d) for d in data], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)[:-1]])
        self.prefix = bool(sp.encode("a", out_type=str)[0].startswith(blank))
        self._hash_pairs()
        self._reset()

    def _hash_pairs(self) -> None:
        """The pairs in an open table at most a quarter full, where most looks end at once; -1 is an empty place."""
        self.shift = np.uint64(64 - max(4, (4 * len(self.pairs)).bit_length()))
        self.place_pair = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.place_rank = np.full(len(self.place_pair), _NONE)
        self.place_joined = np.zeros(len(self.place_pair), np.int32)
        todo, at = np.arange(len(self.pairs)), self._first_place(self.pairs)
        while len(todo):
            free = self.place_pair[at] < 0
            self.place_pair[at[free]] = self.pairs[todo[free]]
            put = self.place_pair[at] == self.pairs[todo]
            self.place_rank[at[put]], self.place_joined[at[put]] = self.rank[todo[put]], self.joined[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) % len(self.place_pair)

    def _first_place(self, pair: np.ndarray) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _spell(self, char: int) -> int:
        """A new symbol for a character that is no piece: its bytes' pieces."""
        symbol = len(self.spelled)
        self.spelled.append([int(self.byte_ids[b]) for b in chr(char).encode("utf-8", "surrogatepass")])
        self.by_char[char] = symbol
        return symbol

    def _reset(self) -> None:
        self.slots = _Slots()
        self.start = np.full(1024 * self.width, -1, np.int64)
        self.count, self.met_start, self.met_count = (np.zeros(1024 * self.width, np.int64) for _ in range(3))
        self.met_place, self.met_used = np.zeros((1 << 16, 3), np.uint8), 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.forks: dict[int, int] = {}
        #: Of each fork: where its pieces begin and their number, then the same of its candidates.
        self.fork = np.zeros((4, 1024), np.int64)
        self.word_before, self.fork_before = (np.zeros(1 << BEFORE, bool) for _ in range(2))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of joined symbols; rank _NONE if they make no piece."""
        want = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._first_place(want)
        there = self.place_pair[at]
        other = np.flatnonzero((there != want) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.place_pair)
            there = self.place_pair[at[other]]
            other = other[(there != want[other]) & (there >= 0)]
        return self.place_rank[at], self.place_joined[at]

    def _candidates(self, left, right, key, start, middle, end):
        """Rank and piece; a key decides which candidates are skipped, None skips none."""
        rank, piece = self._look_up(left, right)
        if self.rate > 0 and key is not None:
            rank = np.where(candidate_hash(key, start, middle, end) < self.limit, _NONE, rank)
        return rank, piece

    def _merge(self, symbols: np.ndarray, size: np.ndarray, keys: np.ndarray | None, met: list | None = None, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run the agenda of each row of padded symbols; symbols left and their number.

        ``met`` gets (row, start, middle, end) of the candidates that the agenda comes to;
        those of ``skip``, four in a number and sorted, are skipped.
        """
        rows, width = symbols.shape
        if width < 2:
            return symbols.copy(), size.copy()
        # Symbols are a list linked by columns: that which is merged into the one before it is -1.
        sym = symbols.flatten()
        after, before = (np.broadcast_to(np.arange(width) + k, (rows, width)).flatten() for k in (1, -1))

        def look(row, left, right, start, middle, end):
            rank, piece = self._candidates(left, right, None if keys is None else keys[row], start, middle, end)
            if skip is not None:
                code = _place(row, start, middle, end)
                rank = np.where(skip[np.minimum(np.searchsorted(skip, code), len(skip) - 1)] == code, _NONE, rank)
            if met is not None:
                hit = rank != _NONE
                met.append((row[hit], start[hit], middle[hit], end[hit]))
            return rank, piece

        rank, piece = np.full((rows, width), _NONE), np.zeros(rows * width, np.int32)
        r, c = np.nonzero(np.arange(width) < (size - 1)[:, None])
        at = r * width + c
        rank[r, c], piece[at] = look(r, sym[at], sym[at + 1], c, c + 1, c + 2)
        live = np.arange(rows)
        while True:
            best = rank.argmin(1)
            i = np.flatnonzero(rank[np.arange(len(live)), best] != _NONE)
            if not len(i):
                break
            if 4 * len(i) < 3 * len(live):
                rank, live, best = rank[i], live[i], best[i]
                i = np.arange(len(live))
            row, start = live[i], best[i]
            first = row * width
            at = first + start
            middle = after[at]
            end = after[first + middle]
            sym[at], sym[first + middle], after[at] = piece[at], -1, end
            rank[i, start] = rank[i, middle] = _NONE
            right = np.flatnonzero(end < size[row])
            left = np.flatnonzero(before[at] >= 0)
            before[first[right] + end[right]] = start[right]
            ahead, behind = before[at[left]], first[right] + end[right]
            who, begin = np.concatenate([left, right]), np.concatenate([ahead, start[right]])
            rank[i[who], begin], piece[first[who] + begin] = look(
                row[who], np.concatenate([sym[first[left] + ahead], sym[at[right]]]), np.concatenate([sym[at[left]], sym[behind]]),
                begin, np.concatenate([start[left], end[right]]), np.concatenate([end[left], after[behind]]))
        sym = sym.reshape(rows, width)
        real = (sym >= 0) & (np.arange(width) < size[:, None])
        n, out = real.sum(1), np.full((rows, width), -1, np.int32)
        out[np.arange(width) < n[:, None]] = sym[real]
        return out, n

    def _merge_long(self, symbols: np.ndarray, key: int | None) -> np.ndarray:
        """The agenda of one long word: a heap over a linked list of symbols."""
        n = len(symbols)
        sym = symbols.tolist()
        start, middle = np.arange(n - 1), np.arange(1, n)
        rank, piece = self._candidates(symbols[:-1], symbols[1:], None if key is None else np.uint64(key), start, middle, middle + 1)
        hits = np.flatnonzero(rank != _NONE)
        # (rank, start, middle, end, piece): stale once a neighbour has changed.
        heap = list(zip(rank[hits].tolist(), hits.tolist(), (hits + 1).tolist(), (hits + 2).tolist(), piece[hits].tolist()))
        heapq.heapify(heap)
        end = list(range(1, n + 1))  # by start; 0 once merged away
        before = list(range(-1, n - 1))
        while heap:
            _, a, b, c, joined = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue
            sym[a], end[a], end[b] = joined, c, 0
            if c < n:
                before[c] = a
            for left, right in ((before[a], a), (a, c)):
                if left < 0 or right >= n:
                    continue
                r, p = self._candidates(*(np.array([x]) for x in (sym[left], sym[right])), None if key is None else np.array([key], np.uint64), *(np.array([x]) for x in (left, right, end[right])))
                if r[0] != _NONE:
                    heapq.heappush(heap, (int(r[0]), left, right, end[right], int(p[0])))
        out, at = [], 0
        while at < n:
            out.append(sym[at])
            at = end[at]
        return np.array(out, np.int32)

    def _spelled_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words' characters, word after word, and the words' sizes."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(chars[self.by_char[chars] < 0]):
            self._spell(int(c))
        return self.by_char[chars], np.fromiter(map(len, words), np.int64, len(words))

    def _groups(self, flat: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, padded symbols) of words of like size; a word of over LONG stands alone."""
        first = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            if size[order[at]] <= LONG:
                widest = min(LONG, max(8, int(size[order[at]] * 1.25)))
                end = int(np.searchsorted(size[order], widest, side="right"))
                end = max(at + 1, min(end, at + max(1, 400_000 // widest)))
            group = order[at:end]
            width = int(size[group[-1]])
            cell = first[group][:, None] + np.arange(width)
            real = np.arange(width) < size[group][:, None]
            yield group, np.where(real, flat[np.minimum(cell, len(flat) - 1)], -1).astype(np.int32)
            at = end

    def _learn(self, wanted: np.ndarray) -> None:
        """Merge the (slot, variant) codes ``wanted`` and pool their pieces."""
        words = [self.slots.words[k] for k in (wanted // self.width).tolist()]
        flat, size = self._spelled_out(words)
        keys = None
        if self.rate > 0 and self.variants:
            own = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), self.seed) for w in words), np.uint64, len(words))
            keys = mix64(own + (wanted % self.width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        each = self.rate > 0 and not self.variants
        for group, padded in self._groups(flat, size):
            if padded.shape[1] > LONG:
                merged = self._merge_long(padded[0], None if keys is None else int(keys[group[0]]))
                self._pool(wanted[group], merged[None, :], np.array([len(merged)]))
                continue
            met: list | None = [] if each else None
            left_over, n = self._merge(padded, size[group], None if keys is None else keys[group], met)
            self._pool(wanted[group], left_over, n)
            if each:
                self.met_start[wanted[group]], self.met_count[wanted[group]] = self._note(len(group), met)

    def _note(self, rows: int, met: list, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keep the candidates that the agendas of so many rows come to, but known ones: where each row's begin, and their number."""
        row, *place = (np.concatenate(x) if met else np.zeros(0, np.int64) for x in (zip(*met) if met else [()] * 4))
        if known is not None and len(known):
            code = _place(row, *place)
            new = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] != code
            row, *place = (x[new] for x in (row, *place))
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=rows)
        starts = self.met_used + np.cumsum(counts) - counts
        while self.met_used + len(row) > len(self.met_place):
            self.met_place = np.concatenate([self.met_place, np.zeros_like(self.met_place)])
        self.met_place[self.met_used : self.met_used + len(row)] = np.stack([p[order] for p in place], 1)
        self.met_used += len(row)
        return starts, counts

    def _hits(self, start: np.ndarray, counts: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number, place among its candidates) of what each occurrence skips, some occurrences at a time."""
        upto = np.cumsum(counts)
        for a in range(0, len(start), 1 << 17):
            b = min(len(start), a + (1 << 17))
            n = counts[a:b]
            place = np.arange(int(n.sum())) - np.repeat(upto[a:b] - n - (upto[a] - n[0]), n)
            hit = candidate_hash(np.repeat(key[a:b], n), *self.met_place[np.repeat(start[a:b], n) + place].T) < self.limit
            yield np.repeat(np.arange(a, b), n)[hit], place[hit]

    def _fork(self, codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Numbers of new forks: words whose candidates of a mask are skipped and no others."""
        words = [self.slots.words[k] for k in codes.tolist()]
        flat, size = self._spelled_out(words)
        base = len(self.forks)
        while base + len(codes) > self.fork.shape[1]:
            self.fork = np.concatenate([self.fork, np.zeros_like(self.fork)], 1)
        counts = self.met_count[codes]
        i = np.repeat(np.arange(len(codes)), counts)
        bit = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.met_place[self.met_start[codes[i]] + bit].T
        without = (masks[i] >> bit & 1).astype(bool)
        row = np.zeros(len(codes), np.int64)
        for group, padded in self._groups(flat, size):
            row[:] = -1
            row[group] = np.arange(len(group))
            mine = row[i] >= 0
            known = _place(row[i[mine]], *place[:, mine])
            met: list = []
            merged, n = self._merge(padded, size[group], None, met, np.sort(known[without[mine]]))
            self.fork[:2, base + group] = self._append(merged, n)
            # Of what the word comes to too, it is known that it isn't skipped.
            self.fork[2:, base + group] = self._note(len(group), met, np.sort(known))
        return base + np.arange(len(codes))

    def _each(self, code: np.ndarray, key: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of occurrences with a key each; words are kept up to that slot.

        One of which no candidate is skipped has the pieces of its word; one of which no more are skipped
        than its fork has those of the fork; the others are merged for themselves.
        """
        mask, words = np.zeros(len(code), np.int64), self.slots.words
        skipped = code >= kept
        code_of = np.where(skipped, 0, code)
        met_count = np.where(skipped, 0, self.met_count[code_of])
        for row, place in self._hits(self.met_start[code_of], met_count, key):
            skipped[row[place >= TOLD]] = True
            told = place < TOLD
            if told.any():
                first = int(row[0])
                bits = np.bincount(row[told] - first, weights=np.ldexp(1.0, place[told])).astype(np.int64)
                mask[first : first + len(bits)] += bits
        start, size = self.start[code_of], self.count[code_of]
        forked = np.flatnonzero((mask > 0) & ~skipped & (code < 1 << (63 - TOLD)))
        skipped |= mask > 0
        if len(forked):
            wanted, which, times = np.unique(code[forked] << TOLD | mask[forked], return_inverse=True, return_counts=True)
            number = np.fromiter(map(self.forks.get, wanted.tolist(), repeat(-1)), np.int64, len(wanted))
            again = self._again(self.fork_before, mix64(wanted), times)
            new = np.flatnonzero((number < 0) & again)[: max(0, FORKS - len(self.forks))]
            if len(new):
                number[new] = self._fork(wanted[new] >> TOLD, wanted[new] & (1 << TOLD) - 1)
                self.forks.update(zip(wanted[new].tolist(), number[new].tolist()))
            fork = number[which]
            forked, fork = forked[fork >= 0], fork[fork >= 0]
            skipped[forked] = False
            start[forked], size[forked], met_start, met_count = self.fork[:, fork]
            for row, _ in self._hits(met_start, met_count, key[forked]):
                skipped[forked[row]] = True
        own = np.flatnonzero(skipped)
        if len(own):
            base = self.used
            flat, length = self._spelled_out([words[k] for k in code[own].tolist()])
            places, sizes = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for group, padded in self._groups(flat, length):
                if padded.shape[1] > LONG:
                    merged = self._merge_long(padded[0], int(key[own[group[0]]]))
                    merged, n = merged[None, :], np.array([len(merged)])
                else:
                    merged, n = self._merge(padded, length[group], key[own[group]])
                places[group], sizes[group] = self._append(merged, n)
            start[own], size[own] = places, sizes
            self.used = base  # room for the next group: these pieces are read below
        upto = np.cumsum(size)
        return self.pool[np.repeat(start - (upto - size), size) + np.arange(int(size.sum()))], size

    @staticmethod
    def _again(before: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Which are met more than once, here or before; all have been met from now on."""
        at = (hashes >> np.uint64(64 - BEFORE)).astype(np.int64)
        again = before[at] | (times > 1)
        before[at] = True
        return again

    def _keep(self, code: np.ndarray, old: int) -> int:
        """Number the words from slot ``old`` on so that those met again come first; the others go from the table. Where they begin."""
        fresh = self.slots.words[old:]
        new = code >= old
        hashes = mix64(np.fromiter(map(hash, fresh), np.int64, len(fresh)).view(np.uint64))
        again = self._again(self.word_before, hashes, np.bincount(code[new] - old, minlength=len(fresh)))
        again &= np.fromiter(map(len, fresh), np.int64, len(fresh)) <= LONG  # occurrences of longer ones are always merged for themselves
        order = np.argsort(~again, kind="stable")
        rank = np.zeros(len(fresh), np.int64)
        rank[order] = np.arange(len(fresh))
        code[new] = old + rank[code[new] - old]
        words = self.slots.words[old:] = [fresh[k] for k in order.tolist()]
        kept = int(again.sum())
        self.slots.update(zip(words[:kept], range(old, old + kept)))
        for w in words[kept:]:
            del self.slots[w]
        return old + kept

    def _pool(self, codes: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> None:
        self.start[codes], self.count[codes] = self._append(symbols, n)

    def _append(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put rows of symbols into the pool as pieces: where each begins, and its number."""
        real = np.arange(symbols.shape[1]) < n[:, None]
        flat = symbols[real]
        size = np.ones(len(flat), np.int64)
        odd = np.flatnonzero(flat >= len(self.piece_size))
        if len(odd):
            spelled = [self.spelled[s] for s in flat[odd].tolist()]
            size[odd] = [len(s) for s in spelled]
            ids = np.repeat(flat, size)
            begin = np.cumsum(size) - size
            for k, s in zip(begin[odd].tolist(), spelled):
                ids[k : k + len(s)] = s
            row = np.repeat(np.arange(len(n)), n)
            counts = np.bincount(row, weights=size, minlength=len(n)).astype(np.int64)
        else:
            ids, counts = flat, n.astype(np.int64)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return start, counts

    def _encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > SLOTS or self.used > PIECES or self.met_used > MET:
            self._reset()
        cut = [_WORDS.findall(" " + t if self.prefix else t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        old, each = len(self.slots.words), self.rate > 0 and not self.variants
        code = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        kept = self._keep(code, old) if each else 0
        draw = None
        if self.rate > 0:
            seeds = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed) for t in texts), np.uint64, len(texts))
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            draw = mix64(np.repeat(seeds, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if self.variants:
                code = code * self.width + (draw % np.uint64(self.width)).astype(np.int64)
        need = len(self.slots) * self.width
        if need > len(self.start):
            grow = max(need, 2 * len(self.start)) - len(self.start)
            self.start = np.concatenate([self.start, np.full(grow, -1, np.int64)])
            self.count, self.met_start, self.met_count = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.count, self.met_start, self.met_count))
        new = np.arange(old, kept) if each else np.unique(code[self.start[code] < 0])
        if len(new):
            self._learn(new)
        if each:
            ids, counts = self._each(code, draw, kept)
            del self.slots.words[kept:]
            upto = np.cumsum(counts)
        else:
            counts = self.count[code]
            upto = np.cumsum(counts)
            ids = self.pool[np.repeat(self.start[code] - (upto - counts), counts) + np.arange(int(counts.sum()))]
        ends = np.concatenate([[0], upto])[np.cumsum(sizes)]
        return ids, ends

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of successive groups of texts: text i has ids[ends[i-1]:ends[i]]."""
        group, chars = [], 0
        for t in texts:
            if group and chars + len(t) > GROUP:
                yield self._encode_group(group)
                group, chars = [], 0
            group.append(t)
            chars += len(t)
        if group:
            yield self._encode_group(group)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts' UTF-8 bytes."""
        size = self.piece_size[ids]
        upto = np.cumsum(size)
        at = np.repeat(self.piece_start[ids] - (upto - size), size) + np.arange(int(size.sum()))
        flat = self.piece_bytes[at].tobytes()
        stops = np.concatenate([[0], upto])[ends].tolist()
        out, a = [], 0
        for b in stops:
            out.append(flat[a + (self.prefix and b > a) : b])
            a = b
        return out


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, from a local path or any path Spark can read."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as f:
        return f.read()


def _lazy(spark: SparkSession, path: str, rate: float, seed: int, variants: int | None = None):
    """A function that gives a worker's segmenter, made once for each process."""
    model = spark.sparkContext.broadcast(model_bytes(spark, path))
    made: dict[str, Segmenter] = {}

    def get() -> Segmenter:
        if "it" not in made:
            made["it"] = Segmenter(model.value, rate, seed, variants)
        return made["it"]

    return get


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """``docs`` with ``ids``, the pieces of the text as array<int>."""
    segmenter = _lazy(docs.sparkSession, path, rate, seed, variants)

    @F.pandas_udf("array<int>")
    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        it = segmenter()
        for texts in batches:
            rows: list = []
            for ids, ends in it.encode([t or "" for t in texts]):
                rows += np.split(ids, ends[:-1])
            yield pd.Series([None if t is None else r for t, r in zip(texts, rows)], dtype=object)

    return docs.withColumn("ids", to_ids(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """``docs`` with ``decoded``, the text of the pieces."""
    segmenter = _lazy(docs.sparkSession, path, 0.0, 0)

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        it = segmenter()
        for rows in batches:
            yield pd.Series(
                [None if r is None else it.decode(np.asarray(r, np.int64), np.array([len(r)]))[0].decode("utf-8", "replace") for r in rows],
                dtype=object,
            )

    return docs.withColumn("decoded", to_text(F.col(ids_col)))


DIGEST = "n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def digest(docs: DataFrame, text_col: str = "text", path: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """doc_id and, for its pieces and for the text decoded from them: sizes,
    SHA-256 (of the ids as little-endian 32-bit integers; of the UTF-8 bytes)
    and whether the decoded bytes are those of the text."""
    segmenter = _lazy(docs.sparkSession, path, rate, seed, variants)

    @F.pandas_udf(DIGEST)
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        it = segmenter()
        for texts in batches:
            texts = [t or "" for t in texts]
            rows = []
            for ids, ends in it.encode(texts):
                low = ids.astype("<i4", copy=False)
                a = 0
                for b, back in zip(ends.tolist(), it.decode(ids, ends)):
                    text = texts[len(rows)].encode("utf-8", "surrogatepass")
                    rows.append((len(text), b - a, hashlib.sha256(low[a:b].tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text))
                    a = b
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return docs.select("doc_id", sums(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def query(docs: DataFrame) -> DataFrame:
    """The digest of every document's pieces."""
    return digest(docs)
