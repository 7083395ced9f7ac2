"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums, over all subsequences of three letters, the
products of their weights in both; an occurrence that spans s places weighs
decay**s, so letters in between cost a little and do not break a match. What is
not a letter takes a place and is never part of a subsequence ("i.d-i o_t").
Kernels are normalised.

Strings are words, and words written letter by letter. Nyström: they are mapped to
their kernels with the landmarks, whitened. Landmarks are strings that are told
apart from the other class by their documents, plain strings, and those plain
strings that are most like the first.

A linear SVM with squared hinge loss is trained on labelled sentences, of which
each counts by its worst string: every sentence of a civil document is civil, and
of a toxic document the worst sentence is toxic (the others are not judged). Which
string is the worst follows from the model, so training goes in rounds: all sentences
are read, those that do not keep their margin add their worst string to what is
learnt from, and the SVM is solved again. What the SVM says of a string is linear in
its subsequences: the landmarks fold into one weight for each triple of letters,
which gives the same values in microseconds. A document counts by its worst
sentences, calibrated by a logistic curve on the labelled documents.

At most ``SAMPLE`` labelled documents of each class are learnt from (the ones
whose ids hash lowest), with all their sentences; everything is scored, in whole.

Defined results: null, empty and wordless texts score 0, repeated rows
score alike, texts and runs of letters of any length count in whole, a table
without usable labels gives every document the score 0; an empty table gives no
rows; a null doc_id is scored, but has no label; other columns are ignored by
``score`` and kept by ``keep_civil``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, settle

#: Labelled documents of either class that are learnt from, at most.
SAMPLE = 5000
#: Landmarks: telling strings, plain strings, and plain strings most like the telling ones.
TELLING, PLAIN, HARD = 128, 64, 192
DECAY = 0.7
#: Letters in a string that counts as one; longer runs count as the overlapping windows that cover them.
LONGEST = 24
#: Strings that a task keeps with their values.
MEMO = 500_000
#: Partitions of the labelled sample, rounds of training, and Newton steps in each, at most.
PARTS, ROUNDS, STEPS = 16, 3, 30

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóáúàâîôû"
#: Signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SYMBOLS = len(LETTERS) + 2  # any other letter, and the start of a word
START = SYMBOLS - 1
GAP = 255
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SINGLES = re.compile(r"(?<!\S)(?:\w[\W_]?\s+){3,}\w(?!\w)")


#: Ends of sentences; signs within a word end none.
ENDS = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+")


def spelt_out(lower: str, words: list[str]) -> list[str]:
    """The words of a text (``words``: its runs between white space) that are written letter by letter."""
    if b"\1\1\1" not in bytes([len(w) < 3 for w in words]):  # such a word has three short runs behind one another; the pattern tries every place
        return []
    return ["".join(m.group().split()) for m in SINGLES.finditer(lower)]


def sentences(text: str) -> list[list[str]]:
    """The strings of each sentence, each once; a word written letter by letter is a sentence, too."""
    lower = text.lower()
    out = [list(dict.fromkeys(part.split())) for part in ENDS.split(lower)]
    out += [[word] for word in spelt_out(lower, lower.split())]
    return [found for found in out if found]


def strings(text: str) -> set[str]:
    """The strings of all sentences."""
    lower = text.lower()
    words = lower.split()
    return {*words, *spelt_out(lower, words)}


def _table() -> np.ndarray:
    code = np.full(0x250, GAP, np.uint8)
    for i in range(0x250):
        if chr(i).isalpha():
            code[i] = SYMBOLS - 2
    for i, c in enumerate(LETTERS):
        code[ord(c)] = i
    for c, letter in STAND_INS.items():
        code[ord(c)] = LETTERS.index(letter)
    return code


CODES = _table()


def bare(word: str) -> str:
    """Without signs at its edges; most words have none, or usual ones."""
    word = word.strip(punctuation)
    return word if not word or (word[0].isalnum() and word[-1].isalnum()) else EDGES.sub("", word)


def windows(word: str) -> list[str]:
    word = bare(word)
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def coded(words: list[str]) -> np.ndarray:
    """One row for each word: its start, the codes of its letters, and gaps as padding."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), 1 + lengths.max(initial=1)), GAP, np.uint8)
    out[:, 0] = START
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], SYMBOLS - 2)
    row = np.repeat(np.arange(len(words)), lengths)
    out[row, 1 + np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes
    return out


@lru_cache(maxsize=64)
def _fading(n: int) -> np.ndarray:
    """DECAY ** (j - i) for i <= j, else 0."""
    at = np.arange(n)
    return np.where(at >= at[:, None], float(DECAY) ** np.maximum(at - at[:, None], 0), 0.0)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Plain kernels of the rows of x with those of y (as many, or one against all)."""
    n = np.broadcast_shapes(x.shape[:1], y.shape[:1])[0]
    ly, d = y.shape[1], DECAY
    fading = _fading(ly)
    # one, two: weights of common subsequences of one and two letters in x so far and y up to each place
    one, two, out = np.zeros((n, ly + 1)), np.zeros((n, ly + 1)), np.zeros(n)
    for i in range(x.shape[1]):
        letter = x[:, i : i + 1]
        same = ((letter == y) & (letter != GAP)) * (d * d)
        out += (same * two[:, :-1]).sum(axis=1)
        paired = (same * one[:, :-1]) @ fading
        one *= d
        two *= d
        one[:, 1:] += same @ fading
        two[:, 1:] += paired
    return out


POWERS = DECAY ** np.arange(4 * LONGEST, dtype=float)


def alike(x: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of rows with as many letters (three or more, after the start) and alike in having gaps, few enough at a time for their triples to fit in memory."""
    letters = x != GAP
    counts = letters.sum(axis=1)
    whole = np.arange(x.shape[1]) < counts[:, None]
    gaps = (letters != whole).any(axis=1)
    for n in np.unique(counts[counts >= 4]).tolist():
        room = max(1, 3_000_000 // (n * (n - 1) * (n - 2)))
        for rows in (np.flatnonzero((counts == n) & ~gaps), np.flatnonzero((counts == n) & gaps)):
            for at in range(0, len(rows), room):
                yield rows[at : at + room]


@lru_cache(maxsize=64)
def _choices(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All i < j < k below n."""
    i, j, k = (a.ravel() for a in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    keep = (i < j) & (j < k)
    return i[keep], j[keep], k[keep]


def triples(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the letter triples of rows that have as many letters; one row of weights if no row has gaps."""
    letters = x != GAP
    n = int(letters[0].sum())
    i, j, k = _choices(n)
    whole = letters[:, :n].all()
    place = None if whole else np.nonzero(letters)[1].reshape(-1, n)
    code = (x[:, :n] if whole else np.take_along_axis(x, place, axis=1)).astype(np.int32)
    codes = (code * SYMBOLS * SYMBOLS)[:, i]
    codes += (code * SYMBOLS)[:, j]
    codes += code[:, k]
    return codes, POWERS[k - i + 1][None] if whole else POWERS[place[:, k] - place[:, i] + 1]


def trimmed(x: np.ndarray) -> np.ndarray:
    """Without the columns on the right in which no row has a letter."""
    return x[:, : int(np.flatnonzero((x != GAP).any(axis=0)).max(initial=0)) + 1]


class Landmarks:
    """Normalised kernels with some strings: their triples in a table, a column for each string."""

    def __init__(self, words: list[str]):
        x = coded(words)
        own = np.sqrt(kernel(x, x))
        use = np.flatnonzero(own > 0)
        found = [triples(x[i : i + 1]) for i in use]
        codes = np.unique(np.concatenate([c[0] for c, _ in found])) if found else np.zeros(0, np.int64)
        self.index = np.zeros(SYMBOLS**3, np.int32)
        self.index[codes] = 1 + np.arange(len(codes))
        self.table = np.zeros((1 + len(codes), len(use)), np.float32)
        for column, (i, (code, weight)) in enumerate(zip(use, found, strict=True)):
            np.add.at(self.table[:, column], self.index[code[0]], weight[0] / own[i])
        self.words, self.own = [words[i] for i in use], own[use]

    def similar(self, words: list[str]) -> np.ndarray:
        """A row for each string, a column for each landmark."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for at in range(0, len(words), 20_000):
            x = coded(words[at : at + 20_000])
            for rows in alike(x):
                room = max(1, 40_000 // max(1, len(_choices(int((x[rows[0]] != GAP).sum()))[0])))
                for a in range(0, len(rows), room):
                    some = rows[a : a + room]
                    part = trimmed(x[some])
                    code, weight = triples(part)
                    near = np.matmul(np.broadcast_to(weight, code.shape)[:, None, :].astype(np.float32), self.table[self.index[code]])[:, 0]
                    out[at + some] = near / np.sqrt(kernel(part, part))[:, None]
        return out

    def whitening(self) -> np.ndarray:
        """What makes the landmarks' own kernels the unit matrix (directions without weight left out)."""
        values, vectors = np.linalg.eigh(self.similar(self.words).astype(float))
        keep = values > 1e-5 * values.max()
        return vectors[:, keep] / np.sqrt(values[keep])

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """The weight of each triple of letters in a sum of kernels with the landmarks."""
        return (self.table @ alpha)[self.index]


def apart(words: list[str], n: int) -> list[str]:
    """Up to n of the words (the first of them, then in turn the one that those chosen are least like)."""
    known, chosen = np.zeros(len(words)), []
    while words and len(chosen) < n:
        i = int(np.argmin(known))
        if known[i] > 0.999:
            break
        chosen.append(words[i])
        known = np.maximum(known, Landmarks([words[i]]).similar(words).max(axis=1, initial=0))
        known[i] = 1
    return chosen


@dataclass(frozen=True)
class Model:
    """A weight for each triple of letters, and the calibration; no weights: nothing was learnt."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: np.ndarray | None = None
    shift: float = -30.0

    def words(self, words: list[str]) -> np.ndarray:
        """The SVM's value for each word; a word in windows has its greatest."""
        cut = [windows(w) for w in words]
        flat = [v for vs in cut for v in vs]
        values = self.strings(flat)
        starts = np.cumsum([0] + [len(vs) for vs in cut[:-1]])
        return np.maximum.reduceat(values, starts) if len(flat) else values

    def strings(self, flat: list[str]) -> np.ndarray:
        """The SVM's value for each string, which has no signs at its edges and no more letters than count as one."""
        values = np.full(len(flat), self.bias)
        for at in range(0, len(flat), 20_000):
            x = coded(flat[at : at + 20_000])
            for rows in alike(x):
                part = trimmed(x[rows])
                code, weight = triples(part)
                found = self.weights[code]
                found = found @ weight[0] if len(weight) == 1 else (found * weight).sum(axis=1)
                values[at + rows] += found / np.sqrt(kernel(part, part))
        return values

    def probability(self, value: np.ndarray) -> np.ndarray:
        """Of documents by their ``_values``; 0 for texts without words."""
        found = 1 / (1 + np.exp(-np.clip(value @ self.slope + self.shift, -500, 500)))
        return np.where(value[:, 3] > 0, found, 0.0)


#: Values below count as this.
FLOOR = -3.0


def _learn(model: Model, words: set[str], memo: dict[str, float]) -> None:
    """Sees to it that the memo has these words. A word counts as it does without signs at its edges, which is looked at once."""
    if len(memo) > MEMO:
        memo.clear()
    new = words.difference(memo)
    own = list(map(bare, new))
    plain = set(own).difference(memo)
    long = [word for word in plain if len(word) > LONGEST]
    short = list(plain.difference(long))
    memo.update(zip(short, model.strings(short).tolist(), strict=True))
    memo.update(zip(long, model.words(long).tolist(), strict=True))
    memo.update(zip(new, map(memo.__getitem__, own), strict=True))


def _values(model: Model, texts: list[str], memo: dict[str, float]) -> np.ndarray:
    """What a document counts by: the greatest and second greatest value of a string, then logarithms of the sum of what is
    over 0 (of each string, at most 1) and of the number of strings (the greatest of many is greater)."""
    held = [strings(t) for t in texts]
    _learn(model, set().union(*held), memo)
    out = np.zeros((len(texts), 4))
    out[:, :2] = FLOOR
    for i, words in enumerate(held):
        if words:
            v = np.fromiter(map(memo.__getitem__, words), float, len(words))
            high = np.sort(np.partition(v, max(0, len(v) - 2))[-2:])
            out[i, : len(high)] = np.maximum(high[::-1], FLOOR)
            out[i, 2:] = np.clip(v, 0, 1).sum(), len(v)
    out[:, 2:] = np.log1p(out[:, 2:])
    return out


def worst_strings(model: Model, texts: list[str], toxic: list[int], memo: dict[str, float]) -> list[list[str]]:
    """Of a toxic text the worst string of all; of a civil one, that of each sentence without margin."""
    held = [sentences(t) for t in texts]
    _learn(model, set().union(*(words for said in held for words in said)), memo)
    value = memo.__getitem__
    out = []
    for said, bad in zip(held, toxic, strict=True):
        tops = [max(words, key=value) for words in said]
        chosen = ([max(tops, key=value)] if tops else []) if bad else [w for w in tops if value(w) > -1]
        cut = [(w, windows(w)) for w in chosen]
        out.append([parts[0] if len(parts) == 1 else max(zip(model.words(parts).tolist(), parts, strict=True))[1] for _, parts in cut])
    return out


def _logistic(value: np.ndarray, label: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve where class 1 has this share, with targets pulled in from 0 and 1."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, rate / max(n1, 1), (1 - rate) / max(n0, 1))
    x, w = np.c_[value, np.ones(len(value))], np.zeros(value.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        hessian = (x.T * (weight * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and right side of the squared hinge loss at w."""
    active = y * (x @ w) < 1
    x, y, weight = x[active].astype(float), y[active], weight[active, None]
    return x.T @ (weight * x), (weight * x).T @ y


def solved(sums, width: int) -> np.ndarray:
    """Weights of the SVM by Newton steps over ``sums(w)``; the last is the bias."""
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-3
    w = np.zeros(width)
    for _ in range(STEPS):
        hessian, right = sums(w)
        step = np.linalg.solve(ridge + hessian, right)
        if np.abs(step - w).max() < 1e-6 * max(1.0, np.abs(step).max()):
            break
        w = step
    return w


#: Weight of all strings of a class against the ridge.
COST = 2000.0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``labels`` (doc_id, toxic 0 or 1) of ``docs``."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = marked.agg(F.avg("toxic")).head()[0] or 0.0
    order = [F.xxhash64("id"), F.col("id")]
    sample = marked.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(marked.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    sample = settle(sample, "sample")  # at most 2 * SAMPLE rows
    rows = documents(docs)
    known = settle(rows.join(F.broadcast(sample), rows["doc_id"] == sample["id"]).select("toxic", "text").distinct().repartition(PARTS), "labelled")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(None)
    telling, others = _landmarks(known, n)
    if not telling or not others:
        return Model(None)
    marks = Landmarks(telling + others)
    white = marks.whitening()
    width = white.shape[1] + 1
    # before anything is learnt: the sum of kernels that holds the landmarks themselves apart
    sides = np.where(np.arange(len(marks.words)) < len(telling), 1.0, -1.0)
    alpha = np.linalg.solve(marks.similar(marks.words) + 0.1 * np.eye(len(sides)), sides)
    model, civil = Model(marks.folded(alpha)), None
    for _ in range(ROUNDS):
        found = settle(_mined(known, model), "mined")
        toxic = found.where("toxic = 1")  # judged anew in each round
        new = found.where("toxic = 0")
        if civil is not None:
            new = new.join(civil.select("word"), "word", "left_anti")
        new = settle(_mapped(new, marks, white), "mapped")
        if civil is not None and new.isEmpty():
            break
        civil = new if civil is None else civil.unionByName(new)
        model = _trained(civil.unionByName(settle(_mapped(toxic, marks, white), "mapped")), marks, white, width)

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame(_values(model, part["text"].tolist(), memo), columns=list("abcd")).assign(toxic=part["toxic"].tolist())

    found = known.mapInPandas(valued, ", ".join(f"{c} double" for c in "abcd") + ", toxic int").toPandas()  # a few numbers for each document of the sample
    slope, shift = _logistic(found[list("abcd")].to_numpy(), found["toxic"].to_numpy(), share)
    return Model(model.weights, model.bias, slope, shift)


def _mined(known: DataFrame, model: Model) -> DataFrame:
    """word, toxic and n: the worst strings of the labelled sentences, and of how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = worst_strings(model, part["text"].tolist(), part["toxic"].tolist(), memo)
                yield pd.DataFrame([(word, toxic) for words, toxic in zip(found, part["toxic"], strict=True) for word in words], columns=["word", "toxic"])

    return known.mapInPandas(run, "word string, toxic int").groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"))


def _mapped(words: DataFrame, marks: Landmarks, white: np.ndarray) -> DataFrame:
    """The strings with their whitened kernels (32-bit numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(map=[row.tobytes() for row in (marks.similar(batch["word"].tolist()) @ white).astype(np.float32)])

    return words.mapInPandas(run, "word string, toxic int, n long, map binary")


def _trained(held: DataFrame, marks: Landmarks, white: np.ndarray, width: int) -> Model:
    """The SVM of these strings; a string weighs as the number of its sentences."""
    total = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hessian, right = np.zeros((width, width)), np.zeros(width)
            for batch in batches:
                if len(batch):
                    x = np.frombuffer(b"".join(batch["map"]), np.float32).reshape(-1, width - 1)
                    weight = COST * batch["n"].to_numpy(float) / batch["toxic"].map(total).to_numpy(float)
                    h, r = newton(np.c_[x, np.ones(len(x), np.float32)], 2.0 * batch["toxic"].to_numpy() - 1, weight, w)
                    hessian, right = hessian + h, right + r
            yield pd.DataFrame({"found": [np.append(hessian.ravel(), right).tobytes()]})

        parts = held.select("toxic", "n", "map").coalesce(PARTS).mapInPandas(run, "found binary").collect()  # a row of a fixed size for each of a few partitions
        found = np.sum([np.frombuffer(r["found"]) for r in parts], axis=0)
        return found[: width * width].reshape(width, width), found[width * width :]

    w = solved(sums, width)
    return Model(marks.folded(white @ w[:-1]), float(w[-1]))


def _landmarks(known: DataFrame, n: dict[int, int]) -> tuple[list[str], list[str]]:
    """Telling strings, and others: plain ones and those most like the telling ones. ``n`` counts the documents of each class."""

    def spelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                doc, around = zlib.crc32(text.encode()), ["", *text.lower().split(), ""]
                places = {w: f"{around[i - 1]} {around[i + 1]}" for i, w in enumerate(around[1:-1], 1)}
                out += [(v, toxic, doc, zlib.crc32(places.get(s, "").encode())) for s in strings(text) for v in windows(s)]
            yield pd.DataFrame(out, columns=["word", "toxic", "doc", "place"])

    seen = known.mapInPandas(spelt, "word string, toxic int, doc long, place long").where(F.length("word") > 2)
    # near copies of a document have a word between the same neighbours: they are one witness
    of = lambda toxic, what: F.count_distinct(F.when(F.col("toxic") == toxic, F.col(what)))
    words = seen.groupBy("word").agg(F.least(of(1, "doc"), of(1, "place")).alias("t"), F.least(of(0, "doc"), of(0, "place")).alias("c"))
    words = settle(words.withColumn("odds", F.log((F.col("t") + 0.5) / n[1]) - F.log((F.col("c") + 0.5) / n[0])), "words")
    rate = n[1] / (n[0] + n[1])
    surprise = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.lit(share) * (F.col("t") + F.col("c"))))).otherwise(0.0)
    strange = words.withColumn("g", 2 * (surprise("t", rate) + surprise("c", 1 - rate))).where((F.col("odds") > np.log(8.0)) & (F.col("t") > 1))
    least = 2 * np.log(max(2, words.count())) + 4  # so that chance is not likely to tell one word of so many
    top = lambda df, by, k: [r["word"] for r in df.orderBy(by, "word").limit(4 * k).collect()]
    telling = apart(top(strange.where(F.col("g") > least), F.desc("g"), TELLING), TELLING)
    if not telling:
        return [], []
    near = Landmarks(telling)
    near = Model(near.folded(np.ones(len(near.words))))  # the sum of the kernels with all of them

    def liked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "value": near.words(batch["word"].tolist())})

    clean = words.where((F.col("c") > 0) & (F.col("odds") < np.log(4.0))).select("word")
    hard = apart(top(clean.mapInPandas(liked, "word string, value double"), F.desc("value"), HARD), HARD)
    plain = apart(top(words.where("c > 0 and odds < 0"), F.xxhash64("word"), PLAIN), PLAIN)
    return telling, [w for w in dict.fromkeys([*hard, *plain]) if w not in set(telling)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability that a document is toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                if model.weights is None:
                    found = np.zeros(len(part))
                else:
                    found = model.probability(_values(model, part["text"].tolist(), memo))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": found})

    return documents(docs).mapInPandas(run, "doc_id long, score double")


def held_out(doc_id: str):
    """Whether labels of this row are kept from training."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out("doc_id"))


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    names = docs.columns
    fields = docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        memo: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = [t or "" for t in part.column(names.index("text")).to_pylist()]
                if model.weights is None:
                    yield part
                else:
                    yield part.filter(pa.array(model.probability(_values(model, texts, memo)) < threshold))

    return docs.mapInArrow(run, fields)
