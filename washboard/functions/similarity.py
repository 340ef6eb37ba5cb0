"""Text similarity.

``indel_ratio`` is a native expression for the base score, bit-parallel over 60-bit words. The weighted score also slides the shorter
text along the longer one, which SQL cannot express well, so it runs in a pandas UDF. Callers feed that
UDF distinct values only; the labels are a short list from the rule pack and travel with the function.

Definitions (all scores 0..100):

* ratio: share of characters in a longest common subsequence, ``200 * lcs / (len a + len b)``;
* partial ratio: best ratio of the shorter text against every stretch of the longer one that has its
  length, with stretches cut off at both ends counted too;
* token sort / token set: ratio after sorting the words / after setting common words apart;
* weighted ratio: for lengths within a factor 1.5 the best of ratio and 0.95 x token score; otherwise the
  best of ratio, s x partial ratio and 0.95 x s x partial token score, with s = 0.9 up to a factor 8 and
  0.6 beyond.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from washboard.functions.text import as_col

# the scorer travels to the executors as code, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Bits of a word of the LCS row. Sums of two words and a carry stay within 64 bits.
WORD_BITS = 60
WORD_MASK = (1 << WORD_BITS) - 1


def _ones(count: Column) -> Column:
    """A word with that many low bits set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), count.cast("int")) - 1


def _places(text: Column) -> Column:
    """Map from each character of a text of up to one word to the bits of its places."""
    chars = F.split(text, "")
    bit = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i).alias("bit")))

    def entry(c: Column) -> Column:
        own = F.filter(bit, lambda b: b["c"] == c)
        return F.struct(c, F.aggregate(own, F.lit(0).cast("bigint"), lambda bits, b: bits.bitwiseOR(b["bit"])))

    return F.map_from_entries(F.transform(F.array_distinct(chars), entry))


def _lcs(text: Column, pattern: Column) -> Column:
    """Length of a longest common subsequence, for two texts that are not empty.

    The row of the LCS table over ``pattern`` is kept as differences, one bit each: a zero bit is a step up. One character of ``text``
    turns a row into the next by an addition, which carries from word to word."""
    none, chars = F.lit(0).cast("bigint"), F.split(text, "")

    def bits_of(places: Column, c: Column, row: Column) -> Column:
        return row.bitwiseAND(F.coalesce(F.try_element_at(places, c), none))

    def one_word(places: Column) -> Column:
        def step(row: Column, c: Column) -> Column:
            hit = bits_of(places, c, row)
            return (row + hit).bitwiseAND(F.lit(WORD_MASK)).bitwiseOR(row - hit)

        return F.length(pattern) - F.bit_count(F.aggregate(chars, _ones(F.length(pattern)), step).bitwiseAND(_ones(F.length(pattern))))

    words = F.sequence(F.lit(0), F.ceil(F.length(pattern) / WORD_BITS).cast("int") - 1)
    pieces = F.transform(words, lambda w: F.substring(pattern, w * WORD_BITS + 1, F.lit(WORD_BITS)))

    def many_words(places: Column) -> Column:
        def step(row: Column, c: Column) -> Column:
            def add(done: Column, w: Column) -> Column:
                own = F.get(row, w)
                hit = bits_of(F.get(places, w), c, own)
                total = own + hit + done["carry"]
                word = total.bitwiseAND(F.lit(WORD_MASK)).bitwiseOR(own - hit)
                return F.struct(F.array_append(done["row"], word).alias("row"), F.shiftright(total, WORD_BITS).alias("carry"))

            return F.aggregate(words, F.struct(F.array().cast("array<bigint>").alias("row"), none.alias("carry")), add)["row"]

        full = F.transform(pieces, lambda p: _ones(F.length(p)))
        last = F.aggregate(chars, full, step)
        left = F.zip_with(last, full, lambda row, own: F.bit_count(row.bitwiseAND(own)))
        return F.length(pattern) - F.aggregate(left, F.lit(0), lambda x, y: x + y)

    # the places are looked up once per pair: a list of one goes through ``transform``, which names it
    short = F.get(F.transform(F.array(_places(pattern)), one_word), F.lit(0))
    long = F.get(F.transform(F.array(F.transform(pieces, _places)), many_words), F.lit(0))
    return F.when(F.length(pattern) <= WORD_BITS, short).otherwise(long)


def indel_ratio(a, b) -> Column:
    """``200 * lcs(a, b) / (len(a) + len(b))``, two empty texts score 100. The shorter text is the pattern whose places are bits."""
    a, b = as_col(a), as_col(b)
    first_shorter = F.length(a) < F.length(b)
    text, pattern = F.when(first_shorter, b).otherwise(a), F.when(first_shorter, a).otherwise(b)
    lcs = F.when((F.length(a) > 0) & (F.length(b) > 0), _lcs(text, pattern)).otherwise(F.lit(0))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)


class _Pattern:
    """A text with one bit set per character position, for fast LCS lengths."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full = (1 << self.size) - 1
        self.bits: dict[str, int] = {}
        for i, ch in enumerate(text):
            self.bits[ch] = self.bits.get(ch, 0) | (1 << i)

    def lcs(self, text: str) -> int:
        row = self.full
        for ch in text:
            both = row & self.bits.get(ch, 0)
            row = (row + both) | (row - both)
        return self.size - (row & self.full).bit_count()


def _score(common: int, total: int) -> float:
    return 200.0 * common / total if total else 100.0


def ratio(a: str, b: str) -> float:
    return _score(_Pattern(a).lcs(b), len(a) + len(b))


def _slide(short: str, long: str) -> float:
    pattern, size = _Pattern(short), len(short)
    best = 0.0
    start = 1 - size
    while start < len(long):
        window = long[max(0, start):start + size]
        common = pattern.lcs(window)
        best = max(best, _score(common, size + len(window)))
        if 0 <= start and start + size < len(long):
            # one step changes the common length by at most one, so hopeless starts are passed over
            needed = int(best * size / 100.0)
            start = min(start + max(1, needed - common), max(start + 1, len(long) - size))
        else:
            start += 1
    return best


def partial_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _slide(short, long)
    return max(best, _slide(long, short)) if len(a) == len(b) else best


def _token_set(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return 0.0
    common = a & b
    if common and (a <= b or b <= a):
        return 100.0
    rest_a, rest_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    joint = len(" ".join(common))
    gap = 1 if joint else 0
    long_a, long_b = joint + gap + len(rest_a), joint + gap + len(rest_b)
    # the shared words match in full, so only the rest has to be compared
    best = _score(joint + gap + _Pattern(rest_a).lcs(rest_b), long_a + long_b)
    if joint:
        best = max(best, _score(joint, joint + long_a), _score(joint, joint + long_b))
    return best


def weighted_ratio(a: str, b: str, at_least: float = 0.0) -> float:
    """Weighted ratio of two texts; anything below ``at_least`` may come back as 0."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    scale = 1.0 if spread < 1.5 else 0.9 if spread <= 8.0 else 0.6
    if max(100.0 * scale, 200.0 / (1.0 + spread)) < at_least:
        return 0.0
    best = ratio(a, b)
    words_a, words_b = a.split(), b.split()
    set_a, set_b = set(words_a), set(words_b)
    sorted_a, sorted_b = " ".join(sorted(words_a)), " ".join(sorted(words_b))
    if spread < 1.5:
        return max(best, 0.95 * max(ratio(sorted_a, sorted_b), _token_set(set_a, set_b)))
    best = max(best, scale * partial_ratio(a, b))
    if set_a & set_b:
        tokens = 100.0
    else:
        tokens = partial_ratio(sorted_a, sorted_b)
        if len(set_a) < len(words_a) or len(set_b) < len(words_b):
            tokens = max(tokens, partial_ratio(" ".join(sorted(set_a)), " ".join(sorted(set_b))))
    return max(best, 0.95 * scale * tokens)


def best_choice(value: str | None, choices: Sequence[str], at_least: float = 0.0) -> tuple[str, int] | None:
    """Best choice and its whole-number score; the first choice in code-point order wins ties."""
    if not value or not choices:
        return None
    best, top = None, -1.0
    for choice in sorted(choices):
        score = weighted_ratio(value, choice, at_least)
        if score > top:
            best, top = choice, score
    return (best, int(top)) if top >= at_least else None


class LabelIndex:
    """Inverted index from characters and words to labels, for the best label of a text without scoring all of them.

    No subsequence of two texts is longer than the number of characters they share, each counted as often as both have it. With the
    lengths this bounds every part of the weighted score from above; a common or repeated word lets the part on sets of words reach
    100. Labels are scored from the highest bound down, until the bound is below the best score or what is asked for."""

    #: (text, label) pairs whose bounds are worked out at once.
    PAIRS = 1 << 20

    def __init__(self, labels: Sequence[str]):
        self.labels = sorted(set(labels))
        words = [label.split() for label in self.labels]
        self.sizes = self._sizes(self.labels, words)
        self.repeats = np.array([len(set(w)) < len(w) for w in words], dtype=bool)
        self.of_char: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for ch in sorted({c for ws in words for w in ws for c in w}):
            counts = np.array([label.count(ch) for label in self.labels])
            self.of_char[ch] = (np.flatnonzero(counts), counts[counts > 0])
        self.of_word: dict[str, list[int]] = {}
        for i, ws in enumerate(words):
            for w in set(ws):
                self.of_word.setdefault(w, []).append(i)

    @staticmethod
    def _sizes(texts: Sequence[str], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of each text, those that are not white space, and the gaps between words."""
        number = np.array([len(w) for w in words], dtype=np.int64)
        return np.array([len(t) for t in texts], dtype=np.int64), np.array([sum(map(len, w)) for w in words], dtype=np.int64), np.maximum(number - 1, 0)

    def bounds(self, texts: Sequence[str]) -> np.ndarray:
        """Upper bounds of the weighted ratio, one row per text."""
        words = [t.split() for t in texts]
        length, letters, gaps = (x[:, None] for x in self._sizes(texts, words))
        size, own_letters, own_gaps = self.sizes
        common = np.zeros((len(texts), len(self.labels)), dtype=np.int64)
        for ch, (labels, counts) in self.of_char.items():
            here = np.array([t.count(ch) for t in texts])
            rows = np.flatnonzero(here)
            common[np.ix_(rows, labels)] += np.minimum(here[rows, None], counts)
        as_written = common + np.minimum(length - letters, size - own_letters)
        by_word = common + np.minimum(gaps, own_gaps)
        short, long = np.minimum(length, size), np.maximum(length, size)
        short_words = np.minimum(letters + gaps, own_letters + own_gaps)
        none = short == 0

        def share(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
            return 200.0 * shared / np.maximum(total, 1)

        spread = long / np.maximum(short, 1)
        scale = np.where(spread < 1.5, 1.0, np.where(spread <= 8.0, 0.9, 0.6))
        whole = share(as_written, length + size)
        close = 0.95 * share(by_word, letters + gaps + own_letters + own_gaps)
        # the best stretch has no characters but common ones
        part = scale * np.maximum(share(as_written, short + as_written), 0.95 * share(by_word, short_words + by_word))
        bound = np.maximum(whole, np.where(spread < 1.5, close, part))
        open_ = np.array([len(set(w)) < len(w) for w in words], dtype=bool)[:, None] | self.repeats
        for i, ws in enumerate(words):
            for w in ws:
                open_[i, self.of_word.get(w, [])] = True
        bound = np.where(open_, np.maximum(bound, 95.0 * scale), bound)
        return np.where(none, 0.0, bound)

    def best(self, texts: Sequence[str], at_least: float = 0.0) -> list[tuple[str, int] | None]:
        """``best_choice`` of each text."""
        out: list[tuple[str, int] | None] = []
        step = max(1, self.PAIRS // max(len(self.labels), 1))
        for start in range(0, len(texts), step):
            part = texts[start : start + step]
            bounds = self.bounds(part) + 1e-9 if self.labels else np.zeros((len(part), 0))
            for text, row in zip(part, bounds):
                out.append(self._best(text, row, at_least))
        return out

    def _best(self, text: str, bounds: np.ndarray, at_least: float) -> tuple[str, int] | None:
        place, top = -1, -1.0
        fit = np.flatnonzero(bounds >= at_least) if text else []
        for j in sorted(fit, key=lambda j: -bounds[j]):
            if bounds[j] < top:
                break
            score = weighted_ratio(text, self.labels[j], at_least)
            if score > top or (score == top and j < place):
                place, top = int(j), score
        return (self.labels[place], int(top)) if place >= 0 and top >= at_least else None


BEST_TYPE = "struct<choice:string,score:int>"


def best_choice_udf(choices: dict[int, Sequence[str]], at_least: float = 0.0, fold_case: bool = False):
    """Pandas UDF (slot, value) -> (choice, score), with one list of choices per slot.

    Each batch looks its distinct values up once in an index of the labels. ``fold_case`` compares with lower-cased choices and still
    returns the choice as written. Declared nondeterministic so that the optimizer neither moves a filter on the
    result below the aggregate that finds the distinct values nor evaluates it twice."""
    compare = {
        slot: {c.lower() if fold_case else c: c for c in sorted(set(many), reverse=True)}
        for slot, many in choices.items()
    }

    indexes = {slot: LabelIndex(tuple(many)) for slot, many in compare.items()}

    @F.pandas_udf(BEST_TYPE)
    def score(slots: pd.Series, values: pd.Series) -> pd.DataFrame:
        pairs = list(zip(slots, values))
        distinct: dict[int, list[str]] = {}
        for slot, v in set(pairs):
            if v and slot in indexes:
                distinct.setdefault(slot, []).append(v)
        found = {(slot, v): hit for slot, many in distinct.items() for v, hit in zip(many, indexes[slot].best(many, at_least))}
        hits = [found.get(p) for p in pairs]
        return pd.DataFrame({
            "choice": [compare[p[0]][h[0]] if h else None for p, h in zip(pairs, hits)],
            "score": pd.array([h[1] if h else None for h in hits], dtype="Int32"),
        })

    return score.asNondeterministic()
