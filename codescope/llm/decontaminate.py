"""Benchmark decontamination by CGK walks, bit sampling and exact edit distance.

Documents and items are read as lower-cased words with one blank between. The
random walk of Chakraborty, Goldenberg and Koucky copies a string's character at
each step and moves on to the next one by a coin that depends on step and
character; strings a few edits apart walk in step again after each edit, so edit
distance turns into Hamming distance of the copies. One long walk falls out of
step for good when a quarter of the characters are edited. So walks of STEPS
steps start all over an item, and all over a document, and
two of every three of its steps, chosen at random, are hashed to a key: two walks meet if no
edit touched the sampled steps. Each meeting votes for the item and the diagonal
(place in the document less place in the item); bands of diagonals with enough
votes put an item-sized window on the document. REPEATS walks with other coins
and samples make the recall; each character's coins hold as many heads as tails,
so that no walk stays on a few characters and meets half the corpus. Items under
LONG characters are too short for enough walks: for them every place of a document
is a window unless too few of the item's pairs and triples of characters lie there for any
likeness, which rules out none that is one. Windows go through a bit-parallel edit distance over
many windows at once, with characters folded to ``FOLD`` classes, so that it is
never above the true one, first for the item's pieces of 64 characters, whose sum is
not above it either; what passes is verified by exact edit distance over
characters.

Recall: an equal copy meets in all its walks on one diagonal and is always found.
Items under LONG characters are found exactly, at any edits within the limit. A
longer edited passage is found when enough walks outlive the edits; edits placed so
that no walk does leave none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Steps of a walk, of which two in three are sampled, and how often.
STEPS, REPEATS = 18, 4
#: Items under LONG characters are searched for exactly, by GRAMS characters in a row, in blocks of PLACES.
LONG, GRAMS, PLACES = 80, (2, 3), 16
#: Documents walk from one in so many characters, items from each; each repeat takes others.
EVERY = 3
#: Width of a band of diagonals; two bands that touch vote together.
BAND = 16
#: So many bands share one window.
BANDS = 4
FOLD = 64
#: Under so many windows left, each goes to the exact edit distance at once.
FEW = 16
#: Items under MIN_CHARS characters are found by equal words only: so short a likeness says nothing.
MIN_CHARS = 20
#: Votes that make a window: a share of the item's characters, within limits.
VOTES, FEWEST, MOST = 0.035, 2, 9
SIMILAR = 0.75
#: So many items are searched for in one pass; more take more passes.
BLOCK_ITEMS = 5000
LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"

_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(11))


def _coins() -> np.ndarray:
    """A random word for each character; bits 3 to STEPS + 2 are its coins, half of them heads."""
    word = _RANDOM.integers(0, 2**32, 4096, dtype=np.uint32) & ~np.uint32((1 << STEPS) - 1 << 3)
    heads = _RANDOM.random((4096, STEPS)).argsort(axis=1) < STEPS // 2
    return word | (heads.astype(np.uint32) << np.arange(3, STEPS + 3, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


#: By repeat: the coins, and the sampled steps.
_COINS = [_coins() for _ in range(REPEATS)]
_SAMPLES = [frozenset(range(STEPS)) - {int(j) for j in np.arange(0, STEPS, 3) + _RANDOM.integers(0, 3, STEPS // 3)} for _ in range(REPEATS)]
#: Scripts that set no blanks between words: Thai and Lao, Myanmar, Khmer, kana, Han.
SPACELESS = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All words (letters and digits, A-Z lower-cased): start, end, text; and the lower-cased bytes."""
    data, _, ends = common.joined(texts)
    low = _LOWER[data]
    edge = np.diff(_WORD[data].astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.searchsorted(ends, start, side="right"), low


def characters(low: np.ndarray) -> np.ndarray:
    """Code points of all words, one blank between words, over document borders too."""
    word = _WORD[low]
    keep = word.copy()
    keep[1:] |= word[:-1]
    return np.frombuffer(np.where(word, low, np.uint8(32))[keep].tobytes().decode("utf-8", "replace").rstrip(" ").encode("utf-32-le"), dtype=np.uint32)


def walks(chars: np.ndarray, repeat: int, begin: int = 0, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Key of the walk from each of ``chars[begin::every]`` on, and where it ends."""
    n = len(chars)
    coins = np.zeros(n + STEPS, dtype=np.uint64)
    coins[:n] = _COINS[repeat].take(chars & 4095)
    stop = np.arange(begin, n, every, dtype=np.int64)
    key = np.zeros(len(stop), dtype=np.uint64)
    room = np.empty(1 << 14, dtype=np.uint64)
    for c in range(0, len(stop), len(room)):  # parts that stay in the processor's cache
        h, i = key[c : c + len(room)], stop[c : c + len(room)]
        x, moved = room[: len(h)], i.view(np.uint64)  # one type throughout: nothing is converted
        for j in range(STEPS):
            coins.take(i, out=x, mode="clip")
            if j in _SAMPLES[repeat]:
                h *= _ODD
                h += x
            x >>= np.uint64(j + 3)
            x &= np.uint64(1)
            moved += x
    return key * np.uint64(0xD6E8FEB86659FD93), stop


def spaceless(chars: np.ndarray) -> np.ndarray:
    found = np.zeros(len(chars), dtype=bool)
    if len(chars) and int(chars.max()) >= SPACELESS[0][0]:
        for a, b in SPACELESS:
            found |= (chars >= a) & (chars < b)
    return found


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Class of each ``q`` characters in a row, folded."""
    fold = (chars % FOLD).astype(np.int64)
    key = fold[: len(fold) - q + 1]
    for j in range(1, q):
        key = key * FOLD + fold[j : len(fold) - q + 1 + j]
    return key


def needed(m: int) -> int:
    """Votes that make a window, for an item of ``m`` characters."""
    return min(max(round(m * VOTES), FEWEST), MOST)


class Table:
    """Items' walks by the upper bits of their keys."""

    def __init__(self, key: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
        self.shift = np.uint64(64 - min(24, max(16, len(key).bit_length() + 6)))
        bucket = (key >> self.shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.owner, self.offset, bucket = owner[order], offset[order], bucket[order]
        bucket, self.first, self.many = np.unique(bucket, return_index=True, return_counts=True)
        self.used = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.used[bucket] = True
        # used buckets as bits, 64 a word, and how many come before each word: a bucket's number without a search
        self.bits = np.zeros(len(self.used) >> 6, dtype=np.uint64)
        np.bitwise_or.at(self.bits, bucket >> 6, np.uint64(1) << (bucket & 63).astype(np.uint64))
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.bits[:-1])), dtype=np.int64)

    def meet(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``key``, item and place in the item of all walks that meet."""
        bucket = (key >> self.shift).view(np.int64)
        at = np.flatnonzero(self.used.take(bucket))
        bucket = bucket[at]
        lower = (np.uint64(1) << (bucket & 63).astype(np.uint64)) - np.uint64(1)
        known = self.before[bucket >> 6] + np.bitwise_count(self.bits[bucket >> 6] & lower)
        low, many = self.first[known], self.many[known]
        which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.repeat(at, many), self.owner[which], self.offset[which]


class Items:
    """One block of benchmark items: their walks, the bits of the edit distance, and the short ones by text."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.rows, self.texts = [], []
        self.short: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.exact: list[tuple[int, list[np.ndarray]]] = []
        key = [[np.zeros(0, np.uint64)] for _ in range(REPEATS)]
        owner, offset = ([[np.zeros(0, np.int64)] for _ in range(REPEATS)] for _ in range(2))
        need: list[int] = []
        self.bits: list[np.ndarray | None] = []
        for item_id, text in rows:
            start, end, _, low = words_of([(text or "").encode()])
            if not len(start):
                continue  # nothing but signs
            n = len(self.rows)
            self.rows.append((item_id, len(start)))
            self.texts.append(plain(low, start, end))
            chars = characters(low)
            if len(chars) < MIN_CHARS:
                self.short[len(chars)][self.texts[n]].append(n)
                need.append(1 << 30)
                self.bits.append(None)
                continue
            need.append(needed(len(chars)) if len(chars) >= LONG else 1 << 30)
            if len(chars) < LONG:
                self.exact.append((n, [np.unique(grams(chars, q)) for q in GRAMS]))
            else:
                for r in range(REPEATS):
                    keys, stop = walks(chars, r)
                    whole = np.flatnonzero(stop <= len(chars))
                    key[r].append(keys[whole])
                    offset[r].append(whole)
                    owner[r].append(np.full(len(whole), n))
            bits = np.zeros((-(-len(chars) // 64), FOLD), dtype=np.uint64)
            at = np.arange(len(chars))
            np.bitwise_or.at(bits, (at >> 6, chars % FOLD), np.uint64(1) << (at & 63).astype(np.uint64))
            self.bits.append(bits)
        self.tables = [Table(*(np.concatenate(x[r]) for x in (key, owner, offset))) for r in range(REPEATS)]
        self.need = np.array(need, dtype=np.int64)
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.longest = int(self.length[self.need < 1 << 30].max(initial=0))

    def windows(self, chars: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, first and last diagonal) of all windows to be compared, ``most[item]`` edits allowed."""
        return tuple(map(np.concatenate, zip(self._voted(chars), self._even(chars, most), strict=True)))

    def _even(self, chars: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of the items under LONG characters: all that hold enough of the item's pairs and triples.

        An item of m characters has m - q + 1 grams of q characters, and an edit destroys
        q at most, so m - q + 1 - q * edits of them lie inside every likeness.
        """
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        of = []
        for q in GRAMS if self.exact and len(chars) > max(GRAMS) else ():
            key = grams(chars, q)
            of.append(np.append(key, np.full(-(-len(chars) // PLACES) * PLACES - len(key), FOLD**q)))  # the last class is nobody's
        own = [np.zeros(FOLD**q + 1, dtype=bool) for q in GRAMS]
        for n, mine in self.exact if of else ():
            m, k = int(self.length[n]), int(most[n])
            reach = (m + k - 2) // PLACES + 2  # so many blocks hold all grams of any m + k characters
            enough = True
            for q, key, table, these in zip(GRAMS, of, own, mine, strict=True):
                table[these] = True
                blocks = table[key].reshape(-1, PLACES).sum(axis=1, dtype=np.uint8)
                table[these] = False
                total = np.cumsum(np.concatenate([[0], blocks, np.zeros(reach, dtype=np.uint8)]), dtype=np.int64)
                enough = enough & (total[reach:-1] - total[: -reach - 1] >= m - q + 1 - q * k)
            first = np.unique(np.flatnonzero(enough) // 3 * 3)
            found.append((np.full(len(first), n), first * PLACES + k))
        item, a = (np.concatenate(x) for x in zip(*found, strict=True))
        return item, a, a + (BANDS + 1) * BAND

    def _voted(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows with enough votes of walks: up to BANDS bands that have them, and the band next to the last."""
        if not self.longest:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        base = -(-self.longest // (BAND * BANDS)) * BAND * BANDS
        bands = (len(chars) + base) // BAND + 2
        found = []
        for r, table in enumerate(self.tables):
            if not len(table.owner):
                continue
            place, item, offset = table.meet(walks(chars, r, r % EVERY, EVERY)[0])
            found.append(item * bands + (place * EVERY + r % EVERY - offset + base) // BAND)
        votes = np.sort(np.concatenate(found))
        first = np.flatnonzero(np.diff(votes, prepend=-2))
        band, many = votes[first], np.diff(np.append(first, len(votes)))
        touch = np.append(band[1:] == band[:-1] + 1, False)  # the last band of an item stays empty
        many = many + np.where(touch, np.append(many[1:], 0), 0)
        band = band[many >= self.need[band // bands]]
        item, band = band // bands, band % bands
        # bands are in order: the first and last of each window
        first = np.flatnonzero(np.diff(item * (bands // BANDS + 1) + band // BANDS, prepend=-1))
        last = np.append(first[1:], len(band)) - 1 if len(first) else first
        return item[first], band[first] * BAND - base, (band[last] + 2) * BAND - base

    def near(self, chars: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """False where the item doesn't lie in ``chars[a:b]`` with at most ``most`` edits, characters folded (bit-parallel over windows)."""
        good = np.zeros(len(item), dtype=bool)
        fold = np.append((chars % FOLD).astype(np.int64), np.zeros(int((b - a).max(initial=0)) + 1, dtype=np.int64))
        words = -(-self.length[item] // 64)
        order = np.lexsort((b - a, words))
        order = order[self._possible(fold, item, a, b, most)[order]]
        ends = np.flatnonzero(np.diff(words[order])) + 1
        for group in np.split(order, ends):
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                # few windows cost less one by one
                good[part] = len(part) < FEW or self._distances(fold, item[part], a[part], b[part]) <= most[part]
        return good

    def _possible(self, fold: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """False where the item's pieces of 64 characters alone take more than ``most`` edits.

        Pieces share no edits, so what their best places in the window take adds up to no
        more than the item's distance. What lies before a piece takes as many characters
        as in the item but for the edits, and likewise behind it.
        """
        left, length = most.copy(), self.length[item]
        for p in range(int(length.max(initial=0)) // 64):
            at = np.flatnonzero((left >= 0) & (length >= 64 * (p + 1)))
            if len(at) < FEW:
                break
            begin = np.maximum(a[at], a[at] + 64 * p - most[at])
            end = np.minimum(b[at], b[at] - (length[at] - 64 * (p + 1)) + most[at])
            order = np.argsort(end - begin, kind="stable")
            for k in range(0, len(at), 4096):
                part = order[k : k + 4096]
                left[at[part]] -= self._piece(fold, p, item[at[part]], begin[part], end[part])
        return left >= 0

    def _piece(self, fold: np.ndarray, p: int, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the items' characters ``64 * p`` to ``64 * p + 63`` in ``fold[a:b]``, as :meth:`_distances` finds them."""
        own, place = np.unique(item, return_inverse=True)
        table = np.concatenate([self.bits[i][p] for i in own.tolist()])
        base, at, size = place * FOLD, a.copy(), b - a
        pv, mv = np.full(len(item), ~np.uint64(0)), np.zeros(len(item), dtype=np.uint64)
        eq, xh, ph = (np.empty_like(pv) for _ in range(3))
        sign = np.empty(len(item), dtype=np.int64)
        score, best = np.full(len(item), 64), np.full(len(item), 64)
        one, top, least = np.uint64(1), np.uint64(63), int(size.min())
        for j in range(int(size.max())):
            fold.take(at, out=sign, mode="clip")
            sign += base
            table.take(sign, out=eq, mode="clip")
            at += 1
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            eq |= mv  # the vertical one from here on
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            pv &= xh  # the horizontal decreases
            score += np.right_shift(ph, top, out=xh).view(np.int64)
            score -= np.right_shift(pv, top, out=xh).view(np.int64)
            ph <<= one
            pv <<= one
            np.bitwise_and(ph, eq, out=mv)
            eq |= ph
            np.invert(eq, out=eq)
            pv |= eq
            if j < least:
                np.minimum(best, score, out=best)
            else:
                np.minimum(best, score, out=best, where=size > j)
        return best

    def _distances(self, fold: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, n = np.uint64(1), len(item)
        if not n:
            return np.zeros(0, dtype=np.int64)
        own, place = np.unique(item, return_inverse=True)
        bits = np.stack([self.bits[i] for i in own.tolist()])  # item, word, class
        words = bits.shape[1]
        tables = [np.ascontiguousarray(bits[:, w]).ravel() for w in range(words)]
        base, last = place * FOLD, ((self.length[item] - 1) & 63).astype(np.uint64)
        pv, mv = [np.full(n, ~np.uint64(0)) for _ in range(words)], [np.zeros(n, dtype=np.uint64) for _ in range(words)]
        score = self.length[item].copy()
        best = score.copy()
        size = b - a
        for j in range(int(size.max())):
            at = base + fold[np.minimum(a + j, len(fold) - 1)]
            up = down = None
            for w in range(words):
                eq, p, m = tables[w][at], pv[w], mv[w]
                xv = eq | m
                if down is not None:
                    eq |= down
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = m | ~(xh | p), p & xh
                if w == words - 1:
                    score += ((ph >> last) & one).astype(np.int64)
                    score -= ((mh >> last) & one).astype(np.int64)
                    up2 = down2 = None
                else:
                    up2, down2 = ph >> np.uint64(63), mh >> np.uint64(63)
                ph, mh = ph << one, mh << one
                if up is not None:
                    ph |= up
                    mh |= down
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                up, down = up2, down2
            best = np.where((score < best) & (j < size), score, best)
        return best

    def equal(self, chars: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place) of the short items, from word edge to word edge where the script has blanks."""
        if not self.short or not len(chars):
            return
        text, loose = chars.tobytes().decode("utf-32-le"), spaceless(chars)
        edge = (chars == 32) | loose
        starts = np.append(True, edge[:-1] | loose[1:])
        stops = np.append(edge[1:] | loose[:-1], True)
        power = np.cumprod(np.full(max(self.short), _ODD))
        for m, known in self.short.items():
            at = np.flatnonzero(starts[: len(chars) - m + 1] & stops[m - 1 :]) if len(chars) >= m else []
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(m):
                h += chars[at + j] * power[j]
            mine = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in known]
            wanted = np.array([(c * power[:m]).sum(dtype=np.uint64) for c in mine], dtype=np.uint64)
            for place in at[np.isin(h, wanted)].tolist():
                for n in known.get(text[place : place + m], ()):
                    yield n, place


def plain(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    return b" ".join(low[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)).decode("utf-8", "replace")


def infix_distance(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any substring of ``text``, and that substring's end (bit-parallel)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def leaks(texts: list[bytes], items: Items, similar: float = SIMILAR) -> list[list[dict]]:
    """For each text the items it holds: item_id, distance, and the first and last word of the window (best one an item)."""
    out: list[list[dict]] = [[] for _ in texts]
    if not items.rows:
        return out
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    allowed = ((1 - similar) * items.length).astype(np.int64)
    held: list[tuple[np.ndarray, ...]] = []  # characters and windows of parts, so that many windows are verified at once
    size = 0

    def verify() -> None:
        chars = np.concatenate([x[0] for x in held])
        base = np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[1]) for x in held])
        item, a, b, text, most, word = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        good = np.flatnonzero(items.near(chars, item, a + base, b + base, most))
        for i, x, y, k, limit, w in zip(*(v[good].tolist() for v in (item, a + base, b + base, text, most, word)), strict=True):
            window = chars[x:y].tobytes().decode("utf-32-le")
            distance, _ = infix_distance(items.texts[i], window)
            if distance <= limit and ((k, i) not in best or distance < best[k, i][0]):
                best[k, i] = (distance, w, w + window.strip(" ").count(" ") + 1)
        held.clear()

    for at, part in common.chunks_of(texts, 1 << 20):
        start, _, doc, low = words_of(part)
        if not len(start):
            continue
        chars = characters(low)
        first = np.append(0, np.flatnonzero(chars == 32) + 1)  # of each word
        cut = np.searchsorted(doc, np.arange(len(part) + 1))
        edges = np.append(first, len(chars) + 1)[cut]
        for item, place in items.equal(chars):
            d = int(np.searchsorted(edges, place, side="right")) - 1
            if place + len(items.texts[item]) < edges[d + 1]:
                w = int(np.searchsorted(first, place, side="right")) - 1 - int(cut[d])
                best.setdefault((at + d, item), (0, w, w + items.rows[item][1]))
        item, a, b = items.windows(chars, allowed)
        most = allowed[item]
        # an edit moves a likeness by one diagonal at most, so these hold all of one that meets the diagonals
        a, b = a - most, b + items.length[item] + most
        a, b = np.clip(a, 0, len(chars)), np.clip(b, 0, len(chars))
        # a window over a border is one for each document
        d = np.searchsorted(edges, a, side="right") - 1
        many = np.maximum(np.searchsorted(edges, b, side="left") - d, 1)
        item, a, b, most = (np.repeat(x, many) for x in (item, a, b, most))
        d = np.repeat(d, many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        d = np.minimum(d, len(part) - 1)
        a, b = np.maximum(a, edges[d]), np.minimum(b, edges[d + 1] - 1)
        some = b - a >= items.length[item] - most
        item, a, b, d, most = (x[some] for x in (item, a, b, d, most))
        word = np.searchsorted(first, a + (chars[np.minimum(a, len(chars) - 1)] == 32), side="right") - 1 - cut[d]
        held.append((chars, item, a, b, at + d, most, word))
        size += len(chars)
        if size > 1 << 23:
            verify()
            size = 0
    if held:
        verify()
    for (k, i), (distance, a, b) in best.items():
        out[k].append({"item_id": items.rows[i][0], "distance": distance, "start": a, "end": b})
    for found in out:
        found.sort(key=lambda x: x["item_id"])
    return out


def find(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: the items of ``benchmark(item_id, text)`` in each whole text.

    Null and empty texts hold nothing. Null item_ids and items without a letter or
    digit are left out; items are searched for in blocks of BLOCK_ITEMS, so that
    what tasks get is bounded. A column that is called leaks is replaced.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    docs = docs.drop("leaks")
    names = docs.columns
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    many = -(-max(items.count(), 1) // BLOCK_ITEMS)
    schema = StructType([*docs.schema.fields, *spark.createDataFrame([], f"leaks {LEAKS}").schema.fields])
    out = docs.withColumn("leaks", F.lit(None).cast(LEAKS))
    for block in range(many):
        part = items if many == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == block)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]

        def work(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            common.lean()
            found = Items(rows)
            for batch in batches:
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                more = [(a or []) + b for a, b in zip(batch.column("leaks").to_pylist(), leaks(texts, found, similar), strict=True)]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(more, kind)], [*names, "leaks"])

        out = out.mapInArrow(work, schema)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they had, whatever their names."""
    plain = common.guarded(docs, ("text",))
    return find(plain, benchmark, similar).filter(F.size("leaks") == 0).select(*plain.columns).toDF(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item: doc_id, item_id, distance (characters), first and last word of the window."""
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")
