"""Held-out texts that leak, fully or partly, into a corpus.

Texts become words (in Chinese and Japanese, characters) that case, punctuation, spacing, markup and Unicode form leave
alone. A passage is a run of an item of at least 14 words or 40 characters, of which one word in five may differ. Items are
cut into such passages, documents into overlapping windows of twice their length, so that a short passage never drowns in a long
document. The search is a containment search by MinHash, partitioned by size: of a window only the shingles that some item has
count, and windows are parted by how many of these there are, passages by how many they have. Each pair of sizes has its own
number of bands, so that a passage contained to the least share shares a band with the odds asked for. Candidates are
verified: first by the exact share of the passage's shingles that the window has, then by the edit distance of every stretch
of the item to the place, in words. Of the words that only this item has one must be found, misspelled or not (items made from
the same phrases differ in those alone).

One pass over the corpus serves any number of items. Every task gets two bitmaps of a bounded size, of the items' shingles and
of their bands; what hits neither is dropped there. Only the windows that are left, with their band keys, meet the items
themselves, in blocks of items of a bounded size.
"""

from __future__ import annotations

import html
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from stowage.session import busy, checkpointed

#: Least passage: words, or characters of scripts without spaces.
WORDS, CHARACTERS = 14, 40
#: Cost of an edit, above the own words of any stretch; tokens of a document aligned at once.
UNIT, PIECE = 1 << 10, 1024
#: Words per shingle. Five, with every fifth word changed, would leave no shingle whole; two leave two thirds.
SHINGLE = 2
#: Least share of a passage's shingles that must lie in a window: of 15 words with 3 changed, begun two or three words off the
#: nearest cuts, 5 of a cut's 13 shingles are left, the least of all lengths and places.
CONTAINED = 5 / 13
#: Chance that a passage with just that share is found, and rows of a band.
RECALL, ROWS = 0.995, 2
#: Passages by their tokens: each family is sought in windows of twice its most tokens, one every so many tokens.
FAMILIES = (14, 28, 40)
#: Greatest number of an item's shingles in each size of window, and least number in each size of passage.
WINDOW_SIZES = (8, 13, 20, 28, 40, 56, 80)
PASSAGE_SIZES = (1, 3, 5, 8, 12, 14, 20, 28)
#: Tokens of items handled at once, and tokens of a piece of a very long item.
GROUP_TOKENS, ITEM_PIECE = 40_000, 2_048
#: Bits of a bitmap for each value in it, most bits of one, and places of a value.
BITS, MOST_BITS, PLACES = 32, 1 << 28, 5

#: Characters of texts handled at once.
AT_ONCE = 1_000_000
#: Stands between texts handled at once.
BORDER = "\x1e"

WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}"
TAG = regex.compile(r"</?[A-Za-z][^<>]{0,60}>")
# Letters of other scripts that pass for Latin ones, used in words that mix scripts.
LOOKALIKE = str.maketrans("аеорсухіјѕԁԛһӏкмтвнαορνικτυχ", "aeopcyxijsdqhlkmtbhaopviktux")
IS_WIDE = regex.compile(rf"[{WIDE}]")
#: Classes of characters: others, letters with their marks, digits, wide ones, dots within numbers, and such as count for nothing.
OTHER, LETTER, DIGIT, BROAD, INNER, NOTHING = range(6)
LATIN, FOREIGN = 1, 2


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and whether it is Latin or of a script with letters that look so."""
    # planes 4 to 13 and the private ones hold nothing of these classes
    every = "".join(map(chr, [*range(0x34000), *range(0xE0000, 0xE0200)]))
    at = np.array([*range(0x34000), *range(0xE0000, 0xE0200)])
    kind, script = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for value, chars in ((LETTER, r"\p{L}\p{M}"), (DIGIT, r"\p{N}"), (BROAD, WIDE), (NOTHING, r"\p{Cf}\p{Mn}'’ʼ`´")):
        for m in regex.finditer(f"[{chars}]+", every):
            kind[at[m.start() : m.end()]] = value
    for value, chars in ((LATIN, r"\p{Latin}"), (FOREIGN, r"\p{Cyrillic}\p{Greek}")):
        for m in regex.finditer(f"[{chars}]+", every):
            script[at[m.start() : m.end()]] = value
    return kind, script


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """Words of several texts in lower case without marks, punctuation, markup and invisible characters; wide characters one by one.

    A word is a number with its inner dots, or letters and digits behind a letter. All texts are cut at once.
    """

    def __init__(self, texts: list[str]):
        kind, script = classes()
        whole = BORDER.join([self._bare(t) for t in texts])
        if not whole.isascii():
            whole = unicodedata.normalize("NFKD", whole)
        codes = np.frombuffer(whole.casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = kind[codes]
        codes, own = codes[own != NOTHING], own[own != NOTHING]
        # digits are led by a letter if the last other character before them is one
        at = np.arange(len(own))
        last = np.maximum.accumulate(np.where(own != DIGIT, at, -1)) if len(own) else at
        led = (own == DIGIT) & (last >= 0) & (own[last] == LETTER)
        number = (own == DIGIT) & ~led
        if len(own) > 2:
            dot = (codes == ord(".")) | (codes == ord(","))
            own[1:-1][dot[1:-1] & number[:-2] & (own[2:] == DIGIT)] = INNER
        before = np.concatenate([[OTHER], own[:-1]])
        first = (own == BROAD) | ((own == DIGIT) & ((before == OTHER) | (before == BROAD))) | ((own == LETTER) & ((before == OTHER) | (before == BROAD) | np.concatenate([[False], number[:-1]])))
        inside = own != OTHER
        self.starts = np.flatnonzero(first)
        borders = np.flatnonzero(codes == ord(BORDER))
        #: First token of each text, and behind the last.
        self.offsets = np.concatenate([[0], np.searchsorted(self.starts, borders), [len(self.starts)]])
        self.wide = own[self.starts] == BROAD
        kept = np.flatnonzero(inside)
        begins = np.searchsorted(kept, self.starts)
        self.ends = self.starts + np.diff(np.append(begins, len(kept)))
        letters = codes[kept]
        if len(begins):
            kinds = np.bitwise_or.reduceat(script[letters], begins)
            for k in np.flatnonzero(kinds == (LATIN | FOREIGN)):
                a, b = self.starts[k], self.ends[k]
                codes[a:b] = [LOOKALIKE.get(c, c) for c in codes[a:b].tolist()]
            letters = codes[kept]
        self.codes = codes
        place = np.arange(len(kept)) - np.repeat(begins, np.diff(np.append(begins, len(kept))))
        parts = mixed((letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        self.hashes = np.add.reduceat(parts, begins) if len(begins) else parts

    @staticmethod
    def _bare(text: str) -> str:
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = TAG.sub(" ", text)
        return text.replace(BORDER, " ") if BORDER in text else text

    def words(self, first: int, last: int) -> list[str]:
        """Tokens from the first to before the last of all."""
        if first >= last:
            return []
        low = int(self.starts[first])
        text = self.codes[low : self.ends[last - 1]].tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a:b] for a, b in zip((self.starts[first:last] - low).tolist(), (self.ends[first:last] - low).tolist())]


def words(text: str) -> list[str]:
    tokens = Tokens([text])
    return tokens.words(0, len(tokens.starts))


@lru_cache(100_000)
def is_wide(word: str) -> bool:
    return len(word) == 1 and word > "⸀" and IS_WIDE.match(word) is not None


def lengths(tokens: list[str]) -> list[float]:
    """How far each token goes towards a passage of length 1."""
    if sum(map(is_wide, tokens)) * 3 > len(tokens):
        return [len(t) / CHARACTERS for t in tokens]
    return [1 / WORDS] * len(tokens)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit number per shingle, in order."""
    out = hashes[: max(len(hashes) - SHINGLE + 1, 0)].copy()
    for k in range(1, SHINGLE if len(out) else 0):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : len(out) + k]
    return mixed(out)


def hashes_of(tokens: list[str]) -> np.ndarray:
    """The hashes of words that were cut already; a space parts them, as wide characters part themselves."""
    return Tokens([" ".join(tokens)]).hashes


def cuts(tokens: list[str]) -> list[tuple[int, int]]:
    """Passages of the least length, each begun a third of it behind the last one; an item shorter than one has none."""
    far = np.concatenate([[0.0], np.cumsum(lengths(tokens))])
    if far[-1] < 0.999:
        return []
    found, a = [], 0
    while far[-1] - far[a] >= 0.999:
        found.append((a, int(np.searchsorted(far, far[a] + 0.999))))
        a = max(int(np.searchsorted(far, far[a] + 0.34)), a + 1)
    last = int(np.searchsorted(far, far[-1] - 0.999, side="right")) - 1
    if found[-1][1] < len(tokens):
        found.append((max(last, 0), len(tokens)))
    return found


def tagged(marks: np.ndarray, family: int) -> np.ndarray:
    """The shingles of a family's passages as they stand in the bitmap."""
    return mixed(marks + np.uint64(family + 1))


def family_of(tokens: int) -> int:
    return next(k for k, most in enumerate(FAMILIES) if tokens <= most or most == FAMILIES[-1])


def size_of(passage: int) -> int:
    """Class of a passage by its shingles."""
    return max(k for k, least in enumerate(PASSAGE_SIZES) if passage >= least)


def plan_bands(window: int, passage: int, contained: float = CONTAINED, recall: float = RECALL) -> int:
    """Bands for windows of up to and passages of at least so many shingles; 0 if such a window can't hold enough."""
    both = math.ceil(contained * passage)
    if both > window:
        return 0
    jaccard = both / (window + passage - both)
    return 1 if jaccard == 1 else math.ceil(math.log(1 - recall) / math.log(1 - jaccard**ROWS))


#: Bands of each family, size of passage and size of window, which holds fewer shingles than tokens.
PLANS = [[[plan_bands(w, p) if k == 0 or WINDOW_SIZES[k - 1] < 2 * most - 1 else 0 for k, w in enumerate(WINDOW_SIZES)] if p < most else [0] for p in PASSAGE_SIZES] for most in FAMILIES]


@lru_cache(1)
def multipliers() -> np.ndarray:
    """One for each hash function, as many as the largest number of bands needs."""
    count = ROWS * max(max(plan) for plans in PLANS for plan in plans)
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(values: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of the hash functions."""
    turned = values[:, None] * multipliers()[None, :count]
    return (turned ^ (turned >> np.uint64(31))).min(axis=0)


def band_keys(sign: np.ndarray, family: int, passage: int, window: int) -> np.ndarray:
    """A 64-bit number per band, of the rows in it, its place and what it is for."""
    bands = PLANS[family][passage][window]
    rows = sign[: bands * ROWS].reshape(bands, ROWS)
    out = np.arange(bands, dtype=np.uint64) + np.uint64((family * 64 + passage) * 64 + window << 32)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, k])
    return out


def passage_keys(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of an item: what its passages' shingles are in the bitmap, their bands for all sizes of window, and (family, size) of each passage."""
    marks = shingles(hashes_of(tokens))
    keys, kinds, used = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint64)]
    for a, b in cuts(tokens):
        own = np.unique(marks[a : b - SHINGLE + 1])
        family, size = family_of(b - a), size_of(len(own))
        kinds.append((family, size))
        used += [own, tagged(own, family)]
        sign = signature(own, ROWS * max(PLANS[family][size]))
        keys += [band_keys(sign, family, size, w) for w, bands in enumerate(PLANS[family][size]) if bands]
    return np.unique(np.concatenate(used)), np.unique(np.concatenate(keys)), kinds


class Bitmap:
    """Which values may be there: none that is there is missed."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that may be there."""
        left = np.arange(len(values))
        low, step = values & np.uint64(0xFFFFFFFF), (values >> np.uint64(32)) | np.uint64(1)
        for k in range(PLACES):
            at = (low + np.uint64(k) * step) & self.mask
            hit = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            left, low, step = left[hit], low[hit], step[hit]
        return left


class Search:
    """What every task gets: the two bitmaps, and the families and sizes of passages there are."""

    def __init__(self, marks: Bitmap, bands: Bitmap, kinds: list[tuple[int, int]]):
        self.marks, self.bands = marks, bands
        self.kinds = [(f, [s for g, s in sorted(set(kinds)) if g == f]) for f in sorted({f for f, _ in kinds})]
        #: The least number of an item's shingles in a window that holds enough of a passage.
        self.need = {f: min(math.ceil(CONTAINED * PASSAGE_SIZES[s]) for s in sizes) for f, sizes in self.kinds}

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text the stretches around windows that may hold a passage: tokens and (first token, tokens, key) of the windows' bands."""
        out: list[list[dict]] = [[] for _ in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            if text:
                held.append(k)
                size += len(text)
            if held and (size >= AT_ONCE or k == len(texts) - 1):
                tokens = Tokens([texts[h] for h in held])
                marks = shingles(tokens.hashes)
                places = self.marks.has(marks)
                edges = np.searchsorted(places, tokens.offsets)
                hits = []
                for h in np.flatnonzero(np.diff(edges) >= min(self.need.values())).tolist():
                    first, last = int(tokens.offsets[h]), int(tokens.offsets[h + 1])
                    own = places[edges[h] : edges[h + 1]]
                    # the last shingle reaches into the next text
                    hits += [(h, *w) for w in self._windows(marks[first : last - SHINGLE + 1], own[own < last - SHINGLE + 1] - first, last - first)]
                for h, windows in self._in_bands(hits).items():
                    out[held[h]] = self._stretches(windows, tokens, int(tokens.offsets[h]), int(tokens.offsets[h + 1]))
                held, size = [], 0
        return out

    def _windows(self, marks: np.ndarray, places: np.ndarray, size: int) -> list[tuple]:
        """(first token, tokens, shingles, keys) of the windows of one text with enough shingles of items. places: of shingles that some item has."""
        hits = []
        for family, sizes in self.kinds:
            if len(places) < self.need[family]:
                continue
            own = places[self.marks.has(tagged(marks[places], family))]
            step = FAMILIES[family]
            # windows with enough of the items' shingles, told from the places of these alone
            starts = np.arange(0, max(size - step, 1), step)
            first, last = np.searchsorted(own, starts), np.searchsorted(own, starts + 2 * step - SHINGLE + 1)
            for k in np.flatnonzero(last - first >= self.need[family]):
                found = np.unique(marks[own[first[k] : last[k]]])
                if len(found) < self.need[family]:
                    continue
                window = next(w for w, most in enumerate(WINDOW_SIZES) if len(found) <= most)
                sizes_here = [s for s in sizes if PLANS[family][s][window]]
                if not sizes_here:
                    continue
                sign = signature(found, ROWS * max(PLANS[family][s][window] for s in sizes_here))
                hits.append((int(starts[k]), 2 * step, found, np.concatenate([band_keys(sign, family, s, window) for s in sizes_here])))
        return hits

    def _in_bands(self, hits: list[tuple]) -> dict[int, list[tuple]]:
        """The windows (first token, tokens, shingles, keys) of each text that share a band with an item, with those bands."""
        found: dict[int, list[tuple]] = defaultdict(list)
        if hits:
            keys = np.concatenate([h[4] for h in hits])
            there = self.bands.has(keys)
            cut = np.searchsorted(there, np.concatenate([[0], np.cumsum([len(h[4]) for h in hits])]))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                found[hits[k][0]].append((*hits[k][1:4], keys[there[cut[k] : cut[k + 1]]]))
        return found

    @staticmethod
    def _stretches(hits: list[tuple], tokens: Tokens, begin: int, end: int) -> list[dict]:
        spans: list[list] = []
        for at, width, marks, keys in sorted(hits, key=lambda h: h[0]):
            # a stretch of two lengths with its differences ends within that
            first, last = max(0, at - width), min(end - begin, at + 2 * width)
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last, []])
            spans[-1][2].append({"at": at, "width": width, "marks": marks.view(np.int64), "keys": keys.view(np.int64)})
        for first, _, windows in spans:
            for w in windows:
                w["at"] -= first
        return [{"tokens": " ".join(tokens.words(begin + a, begin + b)), "windows": windows} for a, b, windows in spans]


class Item:
    """An item's tokens, the words that only it has, and its passages."""

    def __init__(self, tokens: list[str], own: set[str] | frozenset[str]):
        self.tokens = tokens
        self.own = np.array([w in own and not is_wide(w) for w in tokens], dtype=np.int32)
        self.own_before = np.concatenate([[0], np.cumsum(self.own)])
        far = np.concatenate([[0.0], np.cumsum(lengths(tokens))])
        #: Words of the shortest and longest stretch from each word on.
        self.least = np.searchsorted(far, far[:-1] + 0.999) - np.arange(len(tokens))
        self.most = np.minimum(np.searchsorted(far, far[:-1] + 2), len(tokens)) - np.arange(len(tokens))
        self.forms: dict[str, int] = {}
        for w in tokens:
            self.forms.setdefault(w, len(self.forms))
        self.rows = np.array([self.forms[w] for w in tokens], dtype=np.int32)
        #: Words by their first and last letter, of which a misspelled one keeps one.
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.forms:
            if len(w) > 3 and not w[0].isdigit():
                self.near["^" + w[0]].append(w)
                self.near["$" + w[-1]].append(w)
        self.known: dict[str, int] = {}
        #: First and behind the last word of the shortest stretches, and whether any of these has no own word.
        self.begin = np.flatnonzero(self.least + np.arange(len(tokens)) <= len(tokens))
        self.end = self.begin + self.least[self.begin]
        self.plain = bool((self.own_before[self.end] == self.own_before[self.begin]).any())
        marks = shingles(hashes_of(tokens))
        self.passages = [frozenset(marks[a : b - SHINGLE + 1].tolist()) for a, b in cuts(tokens)]
        #: All their shingles, and how many of them enough of any passage has at least.
        self.marks = frozenset().union(*self.passages)
        self.need = min((math.ceil(CONTAINED * len(p)) for p in self.passages), default=1)

    def number(self, word: str) -> int:
        """The number of the item's word that a token is, also misspelled, or -1."""
        got = self.forms.get(word)
        if got is None:
            got = self.known.get(word)
        if got is None:
            got = -1
            if len(word) > 3 and not word[0].isdigit():
                got = next((self.forms[x] for x in (*self.near.get("^" + word[0], ()), *self.near.get("$" + word[-1], ())) if abs(len(x) - len(word)) <= 2 and similar(word, x)), -1)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = got
        return got

    def holds(self, marks: set[int]) -> bool:
        """Whether shingles have enough of a passage."""
        return len(self.marks & marks) >= self.need and any(len(p & marks) >= CONTAINED * len(p) for p in self.passages)

    def _matches(self, doc: np.ndarray, exact: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bool:
        """The same for the shortest stretches with no word put in or left out, which most leaks have: along the fullest diagonals."""
        at, to = np.nonzero(self.rows[:, None] == doc[None, :])
        if not len(at):
            return False
        counts = np.bincount(to - at + len(self.rows))
        for diagonal in np.argsort(-counts, kind="stable")[:3] - len(self.rows):
            place = np.arange(len(self.rows)) + diagonal
            inside = (place >= 0) & (place < len(doc))
            place = np.where(inside, place, 0)
            same = inside & (doc[place] == self.rows)
            right = np.concatenate([[0], np.cumsum(same & exact[place])])
            own = np.concatenate([[0], np.cumsum(same & (self.own == 1))])
            there = self.own_before[end] - self.own_before[begin]
            length = end - begin
            if ((5 * (length - (right[end] - right[begin])) <= length) & (own[end] - own[begin] >= np.minimum(there, 1))).any():
                return True
        return False

    def lies_in(self, tokens: list[str]) -> bool:
        """Whether some stretch of the item of the least length or more lies in the tokens, of which at most one word in five
        differs and one of the item's own words, if it has any there, is found (misspelled ones count as both).

        A passage of twice the least length has a part of one to two lengths of which no more differs, so no longer stretches
        are tried. For all first words of stretches at once, row by row of the edit distance: cost counts UNIT for each word
        changed, left out or put in, less one for each own word found.
        """
        own, own_before, begin, end = self.own, self.own_before, self.begin, self.end
        doc = np.array([self.number(w) for w in tokens], dtype=np.int32)
        exact = np.array([w in self.forms for w in tokens], dtype=bool)
        if self._matches(doc, exact, begin, end):
            return True
        longest = int(self.most.max(initial=0))
        span = longest + longest // 5 + 1
        for first in range(0, max(len(doc) - span, 1), PIECE):
            piece = doc[first : first + PIECE + span]
            spelled = np.where(exact[first : first + PIECE + span], 0, UNIT).astype(np.int32)
            unlike = np.where(self.rows[:, None] == piece[None, :], spelled[None, :] - own[:, None], np.int32(UNIT))
            put_in = np.arange(len(piece) + 1, dtype=np.int32) * UNIT
            start = begin
            cost = np.zeros((len(start), len(piece) + 1), dtype=np.int32)
            for n in range(1, longest + 1):
                new = cost + UNIT
                np.minimum(new[:, 1:], cost[:, :-1] + unlike[start + n - 1], out=new[:, 1:])
                new -= put_in
                np.minimum.accumulate(new, axis=1, out=new)
                cost = new + put_in
                if n >= int(self.least[start].min()):
                    differ = -(-cost // UNIT)
                    there = own_before[start + n] - own_before[start]
                    good = (differ * 5 <= n) & (differ * UNIT - cost >= np.minimum(there, 1)[:, None]) & (self.least[start] <= n)[:, None]
                    if good.any():
                        return True
                alive = (-(-cost.min(axis=1) // UNIT) * 5 <= self.most[start]) & (self.most[start] > n)
                if not alive.all():
                    start, cost = start[alive], cost[alive]
                if not len(start):
                    break
        return False


def deletions(word: str) -> set[str]:
    """A word without up to one letter, or two if it is long enough to be found with two errors."""
    found = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= 7:
        found |= {w[:i] + w[i + 1 :] for w in list(found) for i in range(len(w)) if len(w) < len(word)}
    return found


def similar(a: str, b: str) -> bool:
    """Whether two words differ by one edit or swap, or by two if they are long. Another number is another number."""
    if a == b:
        return True
    if a[0].isdigit() or b[0].isdigit():
        return False
    most = 1 if min(len(a), len(b)) < 8 else 2
    if abs(len(a) - len(b)) > most or (a[0] != b[0] and a[-1] != b[-1]):
        return False
    if sum((Counter(a) - Counter(b)).values()) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        before, row = row, new
    return row[-1] <= most


class Group:
    """Items that are handled at once, found by their bands."""

    def __init__(self, rows: list[tuple[object, list[str], list[str], np.ndarray]]):
        """rows: of each item (or piece of one) its id, tokens, own words and band keys."""
        self.ids = [r[0] for r in rows]
        self.texts = [(r[1], frozenset(r[2])) for r in rows]
        self.items: list[Item | None] = [None] * len(rows)
        keys = np.concatenate([r[3] for r in rows]).view(np.uint64)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[3]) for r in rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        #: The items of each word that only one has (all pieces of it), and those words by what is left of them without a letter or two.
        self.having: dict[str, list[int]] = defaultdict(list)
        for k, (tokens, own) in enumerate(self.texts):
            for w in own.intersection(tokens):
                if not is_wide(w):
                    self.having[w].append(k)
        self.near: dict[str, list[str]] | None = None
        self.owners: dict[str, frozenset[int]] = {}
        self.common = {w for tokens, own in self.texts for w in tokens if w not in own}

    def item(self, k: int) -> Item:
        got = self.items[k]
        if got is None:
            got = self.items[k] = Item(*self.texts[k])
        return got

    def owners_of(self, word: str) -> frozenset[int]:
        """Items that a word, also misspelled, belongs to alone."""
        got = self.owners.get(word)
        if got is None:
            if self.near is None:
                self.near = defaultdict(list)
                for w in self.having:
                    if len(w) > 3 and not w[0].isdigit():
                        for form in deletions(w):
                            self.near[form].append(w)
            if len(self.owners) > 200_000:
                self.owners.clear()
            if word in self.having:
                got = frozenset(self.having[word])
            elif len(word) <= 3 or len(word) > 40 or word in self.common or word[0].isdigit():
                got = frozenset()
            else:
                got = frozenset(k for form in deletions(word) for x in self.near.get(form, ()) if similar(word, x) for k in self.having[x])
            self.owners[word] = got
        return got

    def leaks(self, spans: list[dict]) -> list:
        """Ids of the items of which passages lie in a text's stretches."""
        out: dict = {}
        for span in spans:
            places: dict[int, list[list[int]]] = defaultdict(list)
            for w in span["windows"]:
                keys = np.array(w["keys"], dtype=np.int64).view(np.uint64)
                low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
                candidates = set().union(*(self.owner[a:b].tolist() for a, b in zip(low.tolist(), high.tolist()) if b > a))
                marks = set(np.array(w["marks"], dtype=np.int64).view(np.uint64).tolist())
                for k in candidates:
                    if self.ids[k] not in out and self.item(k).holds(marks):
                        first, last = max(0, w["at"] - w["width"]), w["at"] + 2 * w["width"]
                        if places[k] and first <= places[k][-1][1]:
                            places[k][-1][1] = max(places[k][-1][1], last)
                        else:
                            places[k].append([first, last])
            if places:
                tokens = span["tokens"].split(" ")
                named = [self.owners_of(w) for w in tokens]
                for k, own in places.items():
                    for a, b in own:
                        if self.ids[k] not in out and (self.item(k).plain or any(k in n for n in named[a:b])) and self.item(k).lies_in(tokens[a:b]):
                            out[self.ids[k]] = True
        return list(out)


def read_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(it, item, part, tokens, marks, keys, kinds): words of each piece of each item, what stands for them in the bitmaps, and
    a bit for each family and size of its passages. Null keys and texts are left out."""
    made = pa.list_(pa.struct([("part", pa.int32()), ("tokens", pa.list_(pa.string())), ("marks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("kinds", pa.int64())]))

    @F.arrow_udf("array<struct<part:int,tokens:array<string>,marks:array<bigint>,keys:array<bigint>,kinds:bigint>>")
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            whole, parts = words(t), []
            # what lies in one piece whole can be twice the least length, with what surrounds it
            for part, at in enumerate(range(0, max(len(whole) - 3 * CHARACTERS, 1), ITEM_PIECE)):
                tokens = whole[at : at + ITEM_PIECE + 3 * CHARACTERS]
                marks, keys, kinds = passage_keys(tokens)
                parts.append({"part": part, "tokens": tokens, "marks": marks.view(np.int64), "keys": keys.view(np.int64), "kinds": sum({1 << (f * len(PASSAGE_SIZES) + s) for f, s in kinds})})
            out.append(parts)
        return pa.array(out, made)

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    rows = busy(rows).select(F.monotonically_increasing_id().alias("it"), "item", F.explode(read("text")).alias("r"))
    return checkpointed(rows.select("it", "item", "r.*"))


def own_words(items: DataFrame) -> DataFrame:
    """(it, own): the words that no other item has."""
    lone = items.select("it", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.min("it").alias("it"), F.max("it").alias("last")).where("it = last")
    return lone.groupBy("it").agg(F.collect_list("word").alias("own"))


def bitmap(rows: DataFrame, name: str, count: int) -> Bitmap:
    """A bitmap of the 64-bit values in an array column, MOST_BITS at most: beyond that more windows pass it, and are dropped when
    they meet the items. Each task makes one, and their blocks are united."""
    bits = 1 << min(max(math.ceil(math.log2(max(count, 1) * BITS)), 12), MOST_BITS.bit_length() - 1)
    block = min(bits // 8, 1 << 16)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            low, step = values & np.uint64(0xFFFFFFFF), (values >> np.uint64(32)) | np.uint64(1)
            for k in range(PLACES):
                at = (low + np.uint64(k) * step) & np.uint64(bits - 1)
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        parts = own.reshape(-1, block // 8)
        for n in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([n], pa.int32()), "bits": pa.array([parts[n].tobytes()], pa.binary())})

    def unite(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint64) for x in table["bits"].to_pylist()])
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    kind = "block int, bits binary"
    filled = np.zeros((bits // 8 // block, block // 8), dtype=np.uint64)
    for row in rows.select(name).mapInArrow(make, kind).groupBy("block").applyInArrow(unite, kind).collect():
        filled[row["block"]] = np.frombuffer(row["bits"], dtype=np.uint64)
    return Bitmap(filled.ravel())


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_key, item_key) for each document that holds a passage of an item.

    Null, empty and blank texts on either side leak nothing; items shorter than a passage can't be found. Equal items are each
    reported, but have no word of their own and are told from others by length and order alone. Repeated documents give repeated
    rows; other columns play no part. Texts are searched whole, in one pass for all items.
    """
    context = documents.sparkSession.sparkContext
    index = read_items(items, item_key, item_text)
    marks, keys, kinds, total = index.agg(F.sum(F.size("marks")), F.sum(F.size("keys")), F.bit_or("kinds"), F.sum(F.size("tokens"))).first()
    item_type = items.schema[item_key].dataType
    if not kinds:
        return documents.select(F.col(doc_key)).withColumn(item_key, F.lit(None).cast(item_type)).where(F.lit(False))
    each = [(f, s) for f in range(len(FAMILIES)) for s in range(len(PASSAGE_SIZES)) if kinds >> (f * len(PASSAGE_SIZES) + s) & 1]
    # two bitmaps of 32 MB at most
    search = context.broadcast(Search(bitmap(index, "marks", marks), bitmap(index, "keys", keys), each))
    window = "struct<at:int,width:int,marks:array<bigint>,keys:array<bigint>>"
    spanned = pa.list_(pa.struct([("tokens", pa.string()), ("windows", pa.list_(pa.struct([("at", pa.int32()), ("width", pa.int32()), ("marks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])))]))

    @F.arrow_udf(f"array<struct<tokens:string,windows:array<{window}>>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array(search.value.spans(texts.to_pylist()), spanned)

    found = busy(documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text"))).select("doc", spans("text").alias("spans"))
    count = max(1, math.ceil(total / GROUP_TOKENS))
    rows = index.withColumn("group", F.pmod(F.xxhash64("it", "part"), F.lit(count))).join(own_words(index).hint("merge"), "it", "left").select("group", "item", "tokens", F.coalesce("own", F.array().cast("array<string>")).alias("own"), "keys")
    if count > 1:
        # what is left of the corpus meets one group after the other
        rows = checkpointed(rows)
        found = checkpointed(found.where("size(spans) > 0").withColumn("row", F.monotonically_increasing_id()))
    parts = [_of_group(found, context.broadcast(_group(rows.where(F.col("group") == k).toArrow())), item_type) for k in range(count)]
    if count == 1:
        return parts[0].select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionAll(part)
    # pieces of one item may lie in several groups
    return all_.distinct().select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))


def _group(rows: pa.Table) -> Group:
    keys = rows["keys"].combine_chunks()
    edges, values = keys.offsets.to_numpy(), keys.values.to_numpy()
    return Group([(item, tokens, own, values[a:b]) for item, tokens, own, a, b in zip(rows["item"].to_pylist(), rows["tokens"].to_pylist(), rows["own"].to_pylist(), edges, edges[1:])])


def _of_group(found: DataFrame, sent, item_type) -> DataFrame:
    kind = pa.list_(to_arrow_type(item_type))

    @F.arrow_udf(ArrayType(item_type))
    def leaks(spans: pa.Array) -> pa.Array:
        return pa.array([sent.value.leaks(s) if s else [] for s in spans.to_pylist()], kind)

    return found.select(*[c for c in found.columns if c != "spans"], F.explode(leaks("spans")).alias("item"))
