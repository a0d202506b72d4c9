"""Language of documents and of their stretches, by error-correcting output codes.

Each language has a codeword of bits at large Hamming distances. One binary classifier per bit weighs the character n-grams and words of a sentence
(log-odds of the languages with bit 1 against those with bit 0). Decoding is loss-weighted: each bit's loss counts for a language by how reliably the
bit is predicted for it; the nearest codeword wins, its softmax share is the confidence, and a near second flags ambiguity. A sentence too far from
every codeword is in none of the languages (`und`).

The model is fitted on a bounded sample of labelled rows (`SAMPLE` documents a label, `SENTENCES` sentences each, `SENTENCE_CHARS` characters a
sentence); since labels can be wrong, sentences that the first fit gives another language are left out of the second. What turns losses into
confidences, and the farthest loss of a known language, are fitted on held-out documents, on their sentences and on pieces of a few words, wrongly decoded
ones included. A model can be written and read back, so that fitting and scoring may be apart. Whole texts are classified sentence by sentence in Arrow
batches, without a shuffle.
"""

from __future__ import annotations

import io
import math
import unicodedata
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANKS

#: Languages told apart, with the codes and names by which labels give them.
LANGUAGES = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "hi": ("hin", "hindi", "हिन्दी", "हिंदी"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pl": ("pol", "polish", "polski"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "sv": ("swe", "swedish", "svenska"),
}
CODES = tuple(LANGUAGES)

#: Bounds of the labelled sample the model is fitted on.
SAMPLE, SENTENCES, SENTENCE_CHARS = 500, 12, 400
BITS, HASH_BITS, ALPHA, CLIP = 31, 16, 0.05, 6.0
#: A sentence of less confidence, or of a lesser lead over the second language, is flagged ambiguous; its language stays the decoder's.
LEAST_CONFIDENCE, NEAR = 0.80, 0.20
#: An unfinished last piece (a cut text) of fewer words than this is no whole sentence.
LEAST_WORDS = 4
#: Code of text in none of the languages.
NONE = "und"
#: One document in so many is held out for calibration; one whose sentences agree less with its label is taken as wrongly labelled or mixed.
HELD_OUT, AGREEING = 4, 0.8
#: Words of the pieces cut out of held-out sentences, besides these themselves.
PIECES = (1, 2, 4)

WORD = regex.compile(r"[\p{L}\p{M}]+")
SENTENCE = regex.compile(r"(?:[.!?।…]+[\"'»”’)\]]*(?=\s|$)|\s+[—–|/•]\s+|[\r\n]+)")


def label_language(label: Column) -> Column:
    """Two-letter code a label names, by code or name, with or without a region or in other case; null for any other label."""
    entries = {n: c for c, names in LANGUAGES.items() for n in (c, *names)}
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    plain = F.lower(F.btrim(label, F.lit(BLANKS)))
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_extract(plain, r"^([a-z]{2,3})[-_].*$", 1)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a whole text; separators belong to none."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        end = m.end() if text[m.start()] in ".!?।…" else m.start()
        if text[at:end].strip():
            out.append((at, end))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.casefold())


def bare(word: str) -> str:
    """A word of a Latin script without its accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ")


def features(word: str) -> np.ndarray:
    """Hashed n-grams of a word with its limits, and the word."""
    s = f"^{word}$"
    grams = {s[i : i + n] for n in (1, 2, 3, 4, 5) for i in range(len(s) - n + 1)} - {"^", "$"}
    grams.add("=" + word)
    return np.array([zlib.crc32(g.encode()) & ((1 << HASH_BITS) - 1) for g in sorted(grams)], np.int64)


def codewords(n: int, bits: int = BITS, seed: int = 1) -> np.ndarray:
    """n words of -1 and 1 far apart from each other: the best of seeded draws with balanced columns."""
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(400):
        columns = set()
        while len(columns) < bits:
            c = np.ones(n, np.int8)
            c[rng.permutation(n)[: n // 2]] = -1
            c *= c[0]
            columns.add(tuple(c))
        m = np.array(sorted(columns), np.int8).T
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best.astype(np.float32)


class Coder:
    """Weights of the bit classifiers over hashed features, and what decoding needs. Picklable; its size is fixed by HASH_BITS and BITS."""

    def __init__(self, counts: np.ndarray):
        self.code = codewords(len(CODES))
        share = (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * counts.shape[1])
        self.bits = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            one = self.code[:, b] > 0
            self.bits[:, b] = np.clip(np.log(share[one].mean(0) / share[~one].mean(0)), -CLIP, CLIP)
        self.bits[counts.sum(0) == 0] = 0
        self.known = counts.sum(1) > 0
        self.trust = np.ones_like(self.code) / self.code.shape[1]
        self.sharpness, self.growth = 8.0, 0.0
        self.farthest = math.inf
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, self.code.shape[1] + 1), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "rows", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def _ids(self, ws: list[str]) -> list[int]:
        ids = []
        for w in ws:
            i = self.index.get(w)
            if i is None:
                i = self.index[w] = len(self.index)
                f = features(w)
                self.rows.append(np.append(self.bits[f].sum(0), np.float32(len(f))))
            ids.append(i)
        return ids

    def scores(self, texts: Sequence[list[str]]) -> np.ndarray:
        """Mean log-odds of each bit over the features of each sentence; zero for sentences without words."""
        if len(self.index) > 300_000:
            self.forget()
        ids, lengths = [], []
        for ws in texts:
            ids += self._ids(ws)
            lengths.append(len(ws))
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.float32)])
            self.rows = []
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        if ids:
            lengths = np.array(lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            some = lengths > 0
            out[some] = np.add.reduceat(self.table[np.array(ids)], starts[some], axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)

    def losses(self, scores: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each sentence to each codeword."""
        out = np.empty((len(scores), len(self.code)), np.float32)
        for c in range(len(self.code)):
            out[:, c] = np.logaddexp(0, -4 * scores * self.code[c]) @ self.trust[c]
        # A language without a labelled row cannot be told from others.
        out[:, ~self.known] = 1e3
        return out

    def shares(self, loss: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Softmax share of each language; sharper for sentences of more words."""
        k = self.sharpness * np.power(np.maximum(sizes, 1), self.growth)[:, None]
        p = np.exp(-k * (loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)

    def decode(self, texts: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, or that after the last for none of them, confidence, lead over the second) of each sentence."""
        if not texts:
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        loss = self.losses(self.scores(texts)).astype(np.float64)
        p = self.shares(loss, np.array([len(ws) for ws in texts]))
        top = np.sort(p, axis=1)
        found, sure = loss.argmin(1), top[:, -1]
        none = loss.min(1) > self.farthest
        return np.where(none, len(CODES), found), np.where(none, 1 - sure, sure), top[:, -1] - top[:, -2]

    def trusted(self, texts: Sequence[list[str]], labels: np.ndarray) -> None:
        """How reliably each bit is predicted for each language."""
        scores = self.scores(texts)
        for c in range(len(self.code)):
            own = scores[labels == c]
            right = ((own * self.code[c]) > 0).mean(0) if len(own) else np.ones(self.code.shape[1])
            w = np.maximum(2 * right - 1, 0.05)
            self.trust[c] = w / w.sum()

    def calibrate(self, texts: Sequence[list[str]], labels: np.ndarray) -> None:
        """Sharpness from held-out sentences and pieces of them by likelihood; the farthest loss from whole sentences decoded rightly."""
        if not texts:
            return
        rng = np.random.default_rng(3)
        cut = [(ws[a : a + n], c) for ws, c in zip(texts, labels) for n in PIECES if len(ws) > n for a in [int(rng.integers(0, len(ws) - n))]]
        every, truth = [*texts, *(ws for ws, _ in cut)], np.concatenate([labels, np.array([c for _, c in cut], int)])
        loss = self.losses(self.scores(every)).astype(np.float64)
        sizes = np.array([len(ws) for ws in every])
        best = (math.inf, self.sharpness, 0.0)
        for k in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48):
            for growth in (0.0, 0.25, 0.5, 0.75):
                self.sharpness, self.growth = float(k), growth
                nll = float(-np.log(np.maximum(self.shares(loss, sizes)[np.arange(len(loss)), truth], 1e-12)).mean())
                best = min(best, (nll, float(k), growth))
        self.sharpness, self.growth = best[1:]
        whole = loss[: len(texts)]
        right = whole.min(1)[whole.argmin(1) == labels]
        if len(right):
            # Halfway between the farthest sentence and a loss that no bit's prediction lowers.
            self.farthest = max(float(right.max()), (float(right.max()) + math.log(2)) / 2)

    def to_bytes(self) -> bytes:
        """The model in numpy's own format, without code in it."""
        out = io.BytesIO()
        np.savez_compressed(out, code=self.code, bits=self.bits, known=self.known, trust=self.trust, scale=np.array([self.sharpness, self.growth, self.farthest]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Coder:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            self.code, self.bits, self.known, self.trust = held["code"], held["bits"], held["known"], held["trust"]
            self.sharpness, self.growth, self.farthest = map(float, held["scale"])
        self.forget()
        return self


def train(rows: Sequence[tuple[str, str]], documents: Sequence[object] | None = None) -> Coder:
    """rows: (sentence, language code), some of them labelled wrongly; documents: what tells the rows of a document apart, each row by default. One document
    in HELD_OUT is left out of the fit and calibrates it, unless most of its sentences contradict its label."""
    documents = range(len(rows)) if documents is None else documents
    every = [(words(t), CODES.index(c), d) for (t, c), d in zip(rows, documents)]
    every = [r for r in every if r[0]]
    kept_out = {d for d in {d for *_, d in every} if zlib.crc32(str(d).encode()) % HELD_OUT == 0}
    parsed = [(w, c) for w, c, d in every if d not in kept_out]
    if {c for _, c in parsed} != {c for _, c, _ in every}:
        # Too few documents to hold any out.
        parsed, kept_out = [(w, c) for w, c, _ in every], {d for *_, d in every}
    cache: dict[str, np.ndarray] = {}
    coder = None
    for _ in range(3):
        kept = parsed
        if coder is not None and parsed:
            found, sure, _ = coder.decode([w for w, _ in parsed])
            kept = [p for p, f, s in zip(parsed, found, sure) if f == p[1] or s < 0.5]
        counts = np.zeros((len(CODES), 1 << HASH_BITS), np.float64)
        for ws, c in kept:
            for w in ws:
                for form in {w, bare(w)}:
                    if form not in cache:
                        cache[form] = features(form)
                    counts[c, cache[form]] += 1
        coder = Coder(counts)
        if kept:
            labels = np.array([c for _, c in kept])
            found, _, _ = coder.decode([w for w, _ in kept])
            same = found == labels
            coder.trusted([w for (w, _), s in zip(kept, same) if s], labels[same])
    held = [r for r in every if r[2] in kept_out]
    if held:
        found, _, _ = coder.decode([w for w, *_ in held])
        agree: dict[object, list[bool]] = {}
        for f, (_, c, d) in zip(found, held):
            agree.setdefault(d, []).append(bool(f == c))
        sound = [(w, c) for w, c, d in held if sum(agree[d]) >= AGREEING * len(agree[d])]
        coder.calibrate([w for w, _ in sound], np.array([c for _, c in sound], int))
    coder.forget()
    return coder


def fit(df: DataFrame, text: str, label: str, sample: int = SAMPLE) -> Coder:
    """A model from about `sample` labelled documents a language, taken by hash of the text. Languages without a labelled row are never predicted;
    without any labelled row no text gets a language."""
    rows = df.select(F.col(text).alias("t"), label_language(F.col(label)).alias("c")).where(F.col("c").isNotNull())
    # The labels alone are read to count them.
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = rows.where(F.col("t").isNotNull())
    if not sizes:
        return train([])
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, sample / n))])
    place = F.pmod(F.xxhash64("t"), F.lit(1_000_000)) / 1_000_000
    taken = rows.where(place < share[F.col("c")]).limit(2 * sample * len(CODES))
    split = F.slice(F.split("t", r"(?<=[.!?।])\s+|\s+[—–|/•]\s+|[\r\n]+", SENTENCES + 1), 1, SENTENCES)
    taken = taken.select("c", F.transform(split, lambda s: F.substring(s, 1, SENTENCE_CHARS)).alias("s"))
    pairs = [((s, r["c"]), i) for i, r in enumerate(sorted(taken.collect(), key=lambda r: (r["c"], r["s"]))) for s in r["s"]]
    return train([p for p, _ in pairs], [i for _, i in pairs])


def save(coder: Coder, path: str) -> None:
    with open(path, "wb") as f:
        f.write(coder.to_bytes())


def load(path: str) -> Coder:
    with open(path, "rb") as f:
        return Coder.from_bytes(f.read())


def analyse(coder: Coder, texts: Sequence[str | None]) -> list[list[dict]]:
    """Stretches of one language of each whole text: lang, confidence, start, length, ambiguous, whole. Null, empty and wordless texts have none.

    The language of every sentence is the decoder's, `und` for none. Confidence is the mean over a stretch's sentences by words, each that of the language
    reported. A stretch is ambiguous if all its sentences have a low confidence or a near second language, and whole unless it is an unfinished
    last piece of a few words.
    """
    if not coder.known.any():
        return [[] for _ in texts]
    spans, owner, parsed = [], [], []
    for k, t in enumerate(texts):
        for a, b in sentences(t or ""):
            ws = words(t[a:b])
            if ws:
                spans.append((a, b))
                owner.append(k)
                parsed.append(ws)
    found, sure, lead = coder.decode(parsed)
    names = (*CODES, NONE)
    out: list[list[dict]] = [[] for _ in texts]
    for k, ((a, b), o, ws) in enumerate(zip(spans, owner, parsed)):
        last = k + 1 == len(spans) or owner[k + 1] != o
        whole = not (last and out[o] and len(ws) < LEAST_WORDS and texts[o][:b].rstrip()[-1:] not in ".!?।…\"'»”’)")
        unsure = bool(lead[k] < NEAR or sure[k] < LEAST_CONFIDENCE)
        lang, weight = names[int(found[k])], len(ws)
        if out[o] and out[o][-1]["lang"] == lang:
            s = out[o][-1]
            n = s["_n"] + weight
            s["confidence"] = (s["confidence"] * s["_n"] + float(sure[k]) * weight) / n
            s["_n"], s["length"], s["ambiguous"], s["whole"] = n, b - s["start"], s["ambiguous"] and unsure, s["whole"] or whole
        else:
            out[o].append({"lang": lang, "confidence": float(sure[k]), "start": a, "length": b - a, "ambiguous": unsure, "whole": whole, "_n": weight})
    for stretches in out:
        for s in stretches:
            del s["_n"]
    return out


def document_languages(stretches: Column) -> Column:
    """array<string>: the languages of a document's whole, unambiguous sentences in order of appearance; where there are none, that of its longest stretch
    in a known language, if any."""
    clear = F.filter(stretches, lambda s: s["whole"] & ~s["ambiguous"] & (s["lang"] != NONE))
    known = F.filter(stretches, lambda s: s["lang"] != NONE)
    longest = F.slice(F.sort_array(F.transform(known, lambda s: F.struct(s["length"].alias("length"), s["lang"].alias("lang"))), False), 1, 1)
    lang = lambda a: F.array_distinct(F.transform(a, lambda s: s["lang"]))
    return F.when(F.size(clear) > 0, lang(clear)).otherwise(lang(longest))


STRETCH = "array<struct<lang:string,confidence:double,start:int,length:int,ambiguous:boolean,whole:boolean>>"
_held: dict = {}


def analyser(spark: SparkSession, coder: Coder):
    """A pandas UDF: whole text -> stretches. The model's size is fixed, some MB, whatever the data."""
    shipped, key = spark.sparkContext.broadcast(coder), uuid.uuid4().hex

    @F.pandas_udf(STRETCH)
    def stretches(text: pd.Series) -> pd.Series:
        if key not in _held:
            _held.clear()
            _held[key] = shipped.value
        return pd.Series(analyse(_held[key], list(text)))

    # Otherwise Catalyst would run the analysis once for a filter on its result and again for the result.
    return stretches.asNondeterministic()
