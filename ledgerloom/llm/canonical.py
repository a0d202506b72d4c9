"""Free-entered values mapped to a canonical list.

1. A multi-pattern automaton (Aho-Corasick) over all names and aliases finds every embedded mention that begins and ends at word limits, blanks and
   punctuation ignored; the longest non-overlapping mention wins.
2. Values without a mention go to token-set similarity: an entry fits where each of its words has a word of the value of its own that is equal or near,
   in whatever order and whatever stands between them; neighbouring words of the value also count as one, since words get joined and split. Near words
   are found in an inverted index of character pairs, of which only the rarest few of a word are looked up, then compared by shared pairs (Dice) and
   confirmed by edit distance (with transpositions), by a cut-off end, or as abbreviations beside a whole word. No value is compared with every entry.
3. What is left is reported as unmatched (entry 0).

The mapping is a narrow per-row step: the list is checked for size and shipped once per worker, each worker keeps a bounded cache of values it has
resolved, and no shuffle or join by value takes place, so a value that a third of all rows hold costs one look-up per row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Entries a list may have; more of them raise, since the list is shipped to every worker.
MAX_ENTRIES = 200_000
#: Resolved values a worker keeps.
CACHE = 200_000
#: Edits allowed between a value and an entry, and least share of common character pairs.
MAX_EDITS, LEAST_DICE = 2, 0.34
#: A name may be cut off after this many letters at least, by this many letters at most.
LEAST_PREFIX, MOST_CUT = 5, 6
#: Aliases of at most this many letters count only as the whole value.
SHORT_ALIAS = 3
#: Words of a value that are looked at together, beyond the longest entry's.
EXTRA_WORDS = 1
#: Character pairs looked up of a word: an edit or transposition changes three at most, so a word within MAX_EDITS keeps one of any PROBES pairs.
PROBES = 3 * MAX_EDITS + 1
#: Least mean similarity of an entry's words to those of the value they stand for.
LEAST_WORDS = 0.5
#: Words of fewer letters must be equal.
SHORT_WORD = 4


def plain(text: str) -> str:
    """Upper case without accents."""
    if text.isascii():
        return text.upper()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transposed neighbours, or most + 1 where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


WORD = re.compile(r"[^\W\d_]+")


def pairs_of(word: str) -> set[str]:
    s = f"^{word}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


class PairIndex:
    """Inverted index of names by character pairs."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.sets = [pairs_of(n) for n in self.names]
        self.postings: dict[str, list[int]] = {}
        for i, pairs in enumerate(self.sets):
            for p in pairs:
                self.postings.setdefault(p, []).append(i)

    def near(self, word: str) -> list[tuple[str, float]]:
        """(name, Dice) of all names within MAX_EDITS of the word or beginning with it, and of others that share one of its rarest pairs, with LEAST_DICE."""
        own = pairs_of(word)
        known = sorted((len(self.postings.get(p, ())), p) for p in own)
        found = {i for _, p in known[:PROBES] for i in self.postings.get(p, ())}
        out = []
        for i in found:
            dice = 2 * len(own & self.sets[i]) / (len(own) + len(self.sets[i]))
            if dice >= LEAST_DICE:
                out.append((self.names[i], dice))
        return out


class Matcher:
    """entries: (entry_id, name, aliases, context). Several entries may share a name; their context (a state) tells them apart.

    Entries without an id and names or aliases without a letter are left out; without entries nothing matches. Null and blank values are `blank`, values
    without a letter are `none`. Equally near entries are decided by the row's context, then by shared pairs, then by the lowest id. Values may be of any
    length; each distinct one is resolved on its own, so repeated rows give the same entry.
    """

    def __init__(self, entries: Sequence[tuple[int, str, Sequence[str], str | None]]):
        entries = [e for e in entries if e[0] is not None]
        self.by_key: dict[str, list[int]] = {}
        self.context = {e[0]: e[3] for e in entries}
        self.whole: dict[str, list[int]] = {}
        self.words: dict[str, list[str]] = {}
        for entry_id, name, aliases, _ in entries:
            for k, form in enumerate([name, *aliases]):
                words = WORD.findall(plain(form or ""))
                key = "".join(words)
                if not key:
                    continue
                target = self.whole if k and len(key) <= SHORT_ALIAS else self.by_key
                ids = target.setdefault(key, [])
                if entry_id not in ids:
                    ids.append(entry_id)
                if target is self.by_key:
                    self.words.setdefault(key, words)
        self.keys = sorted(self.by_key)
        self.most_words = max((len(w) for w in self.words.values()), default=1) + EXTRA_WORDS
        self.automaton = ahocorasick.Automaton()
        for key in self.keys:
            self.automaton.add_word(key, key)
        if self.keys:
            self.automaton.make_automaton()
        self.index = PairIndex(self.keys)
        #: Keys of several words by each of their words.
        self.with_word: dict[str, list[str]] = {}
        for key in self.keys:
            if len(self.words[key]) > 1:
                for w in set(self.words[key]):
                    self.with_word.setdefault(w, []).append(key)
        self.word_index = PairIndex(sorted(self.with_word))
        self.near_words: dict[str, list[tuple[str, int, float]]] = {}
        self.cache: dict[tuple[str, object], tuple[int, str, float]] = {}

    def _pick(self, ids: Sequence[int], context: object) -> int:
        """One of several entries of a name: the one whose context is the row's, else none of two equals can be preferred: the lowest id."""
        same = [i for i in ids if context is not None and self.context[i] == context]
        return min(same or ids)

    def mentions(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(start, end, key) in letters: longest non-overlapping mentions at word limits."""
        text = "".join(words)
        limits = {0}
        at = 0
        for w in words:
            at += len(w)
            limits.add(at)
        found = []
        for last, key in self.automaton.iter(text) if self.keys and text else ():
            start, end = last + 1 - len(key), last + 1
            if start in limits and end in limits:
                found.append((start, end, key))
        taken: list[tuple[int, int, str]] = []
        for f in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(f[1] <= t[0] or f[0] >= t[1] for t in taken):
                taken.append(f)
        return taken

    def _near(self, word: str) -> list[tuple[str, int, float]]:
        """(entry's word, edits, similarity) of the words of entries of several words that are near a word."""
        known = self.near_words.get(word)
        if known is None:
            if len(self.near_words) >= CACHE:
                self.near_words.clear()
            known = [(word, 0, 1.0)] if word in self.with_word else []
            if len(word) >= SHORT_WORD:
                for name, dice in self.word_index.near(word):
                    most = MAX_EDITS if min(len(name), len(word)) >= 6 else 1
                    if name != word and len(name) >= SHORT_WORD and (d := edits(word, name, most)) <= most:
                        known.append((name, d, dice))
            self.near_words[word] = known
        return known

    def token_sets(self, words: list[str]) -> list[tuple[float, float, str]]:
        """(cost, similarity, key) of the entries of several words each of which is near a word of the value of its own, in any order."""
        near: dict[str, dict[int, tuple[int, float]]] = {}
        for i, w in enumerate(words):
            for name, d, sim in self._near(w):
                near.setdefault(name, {})[i] = (d, sim)
        out = []
        for key in {k for name in near for k in self.with_word[name]}:
            taken: set[int] = set()
            cost, total, left = 0, 0.0, []
            own = self.words[key]
            # Words with the fewest choices choose first, each the nearest word left.
            for w in sorted(own, key=lambda w: len(near.get(w, ()))):
                free = [(d, -sim, i) for i, (d, sim) in near.get(w, {}).items() if i not in taken]
                if not free:
                    left.append(w)
                    continue
                d, sim, i = min(free)
                taken.add(i)
                cost, total = cost + d, total - sim
            # A word left over may be abbreviated beside whole ones.
            for w in left if cost == 0 and taken else ():
                short = [i for i, v in enumerate(words) if i not in taken and w.startswith(v)]
                if short:
                    taken.add(short[0])
                    total += len(words[short[0]]) / len(w)
            if len(taken) == len(own) and total / len(own) >= LEAST_WORDS:
                out.append((cost + (0.5 if left else 0.0), 2 * total / (len(own) + len(words)), key))
        return out

    def nearest(self, words: list[str], context: object) -> tuple[int, str, float] | None:
        best: list[tuple[float, int, float, int, str]] = []

        def offer(d: float, score: float, key: str, how: str) -> None:
            for entry in self.by_key[key]:
                other = 0 if context is not None and self.context[entry] == context else 1
                best.append((d, other, -score, entry, how))

        # Several words of an entry say more than one near word: among equally many edits they come first.
        for cost, score, key in self.token_sets(words):
            offer(cost + 0.25 - 0.5 * (len(self.words[key]) - 1), score, key, "tokens")
        windows = {"".join(words[i:j]): words[i:j] for i in range(len(words)) for j in range(i + 1, min(len(words), i + self.most_words) + 1)}
        for name, own in windows.items():
            if len(name) <= SHORT_ALIAS:
                continue
            for key, dice in self.index.near(name):
                most = MAX_EDITS if min(len(key), len(name)) >= 6 else 1
                d: float = edits(name, key, most)
                how = "similar"
                if d > most or d > 1:
                    if len(name) >= LEAST_PREFIX and key.startswith(name) and len(key) - len(name) <= MOST_CUT:
                        d, how = 1.5, "cut"
                    elif self._abbreviates(own, self.words[key]):
                        d, how = 1.25, "abbreviated"
                    elif d > most:
                        continue
                offer(d, dice, key, how)
        if not best:
            return None
        d, _, score, entry, how = min(best)
        return entry, how, -score

    @staticmethod
    def _abbreviates(words: list[str], full: list[str]) -> bool:
        """Equally many words, one of them whole, each other one the beginning of its full word."""
        return len(words) == len(full) > 1 and words != full and any(w == f for w, f in zip(words, full)) and all(f.startswith(w) for w, f in zip(words, full))

    def match(self, value: str | None, context: object = None) -> tuple[int, str, float]:
        """(entry_id, how, score). how: blank, mention, tokens, similar, cut, abbreviated or none; entry 0 for blank and none."""
        if value is None or not value.strip():
            return 0, "blank", 0.0
        known = self.cache.get((value, context))
        if known is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            known = self.cache[value, context] = self._match(value, context)
        return known

    def _match(self, value: str, context: object) -> tuple[int, str, float]:
        words = WORD.findall(plain(value))
        if not words:
            return 0, "none", 0.0
        if ids := self.whole.get("".join(words)):
            return self._pick(ids, context), "mention", 1.0
        found = self.mentions(words)
        if found:
            start, end, key = found[0]
            ids = self.by_key[key]
            tied = [f for f in found if f[1] - f[0] == end - start]
            for f in tied:
                for i in self.by_key[f[2]]:
                    if context is not None and self.context[i] == context:
                        return i, "mention", 1.0
            return self._pick(ids, context), "mention", 1.0
        return self.nearest(words, context) or (0, "none", 0.0)


def spark_matcher(entries: Sequence[tuple[int, str, Sequence[str], str | None]], states: Sequence[tuple[int, str, Sequence[str], str | None]], spark):
    """An Arrow UDF (city, state) -> struct of both entries. The row's state, once mapped, decides between cities of one name."""
    lists, key = spark.sparkContext.broadcast((list(entries), list(states))), uuid.uuid4().hex

    @F.arrow_udf("struct<city_id:bigint,city_how:string,city_score:double,state_id:bigint,state_how:string,state_score:double>")
    def mapped(city: pa.Array, state: pa.Array) -> pa.Array:
        cities_of, states_of, names = _matchers(key, lists)
        # A batch holds few different pairs of values; each is resolved once.
        c, s = city.dictionary_encode(), state.dictionary_encode()
        different, stated = [*c.dictionary.to_pylist(), None], [*s.dictionary.to_pylist(), None]
        codes = [x.indices.fill_null(len(x.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (c, s)]
        pairs, at = np.unique(codes[0] * len(stated) + codes[1], return_inverse=True)
        found = [states_of.match(v) for v in stated]
        out = [(*cities_of.match(different[p // len(stated)], names.get(found[p % len(stated)][0])), *found[p % len(stated)]) for p in pairs]
        kinds = {"city_id": pa.int64(), "city_how": pa.string(), "city_score": pa.float64(), "state_id": pa.int64(), "state_how": pa.string(), "state_score": pa.float64()}
        columns = [pa.array([r[k] for r in out], t).take(pa.array(at)) for k, t in enumerate(kinds.values())]
        return pa.StructArray.from_arrays(columns, names=list(kinds))

    return mapped


_held: dict = {}


def _matchers(key: str, lists):
    """Built once per worker; a worker holds the last pair of lists only."""
    if key not in _held:
        _held.clear()
        cities, states = lists.value
        _held[key] = Matcher(cities), Matcher(states), {s[0]: s[1] for s in states}
    return _held[key]
