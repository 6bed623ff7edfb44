"""Toxicity scores by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, no accents, look-alike letters of other scripts
and digits or signs in place of letters mapped to the letters they stand for.  The
lexicon holds beginnings of words with log-odds weights, learnt from labelled rows;
exception phrases, learnt from clean rows that hold a lexicon entry, take its weight
back.  The sum of weights, divided by the text's length, goes through a logistic
curve fitted to the same rows.

Learning uses at most ``LABELLED`` labelled rows (a documented bound; those whose id
has the least hashes), and only those whose crc32(doc_id as text) mod 3 is not 1.
Scoring covers every row.

Defined results: null and empty texts have no matches and get the score of a text
without any; a label row that is null or repeated counts by its maximum; without
labelled rows every score is 0; texts of any length are matched whole; repeated rows
are scored each; a null id is not held out; an empty table gives no rows.  Only id and
text are read for a score, whatever other columns are called.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import remove, written
from graphloom.llm.tokens import slices

LABELLED = 20_000
SHORTEST, LONGEST = 4, 10  # letters of a lexicon entry
LEAST_TEXTS = 5  # toxic texts in which an entry occurs
LEAST_ODDS = 3.5  # natural logarithm
THRESHOLD = 0.7

# Letters that look alike, by script, and signs that stand for letters.
CYRILLIC = dict(zip("авеёзкмнорстухіѕјԁһӏ", "abee3kmhopctyxisjdhl", strict=True))
GREEK = dict(zip("αβεηικνορτυχω", "abenikvoptuxw", strict=True))
LATIN = dict(zip("ıɑɡøłđßæ", ("i", "a", "g", "o", "l", "d", "ss", "ae"), strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "+": "t"}

_FOLD = str.maketrans(CYRILLIC | GREEK | LATIN)
_SIGNS = str.maketrans(SIGNS)
_OTHER = re.compile(r"[^a-z]+")
# Only within a word: prices, years and runs of signs are no letters in disguise.
_DISGUISED = re.compile(r"(?:[a-z]+[0-9@$€+!|]+|[@$€!|0-9]+[a-z]+)[a-z0-9@$€+!|]*")


def _undisguised(m: re.Match) -> str:
    word = m[0].rstrip("!|+$€@")  # signs after a word are punctuation
    return word.replace("!", "i").replace("|", "l").translate(_SIGNS) + " "


def fold(text: str) -> str:
    """The text's folded words, each with one space before it, and one at the end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
        text = "".join(c for c in text if not unicodedata.combining(c)) if any(map(unicodedata.combining, set(text))) else text
    text = _DISGUISED.sub(_undisguised, text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass
class Model:
    entries: dict[str, float]
    exceptions: dict[str, float]
    slope: float = 0.0
    offset: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for words, sign in ((self.entries, 1.0), (self.exceptions, -1.0)):
            for w, weight in words.items():
                a.add_word(w, sign * weight)
        if not len(a):
            return None
        a.make_automaton()
        return a

    def score(self, density: np.ndarray) -> np.ndarray:
        if math.isinf(self.offset):
            return np.zeros(len(density))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(density) + self.offset, -30, 30)))


def density(text: str, automaton) -> float:
    """Weight of all matches for every hundred words; short texts count as of 20 words."""
    folded = fold(text)
    if automaton is None:
        return 0.0
    total = sum(w for _, w in automaton.iter(folded))
    return max(0.0, 100 * total / max(20, folded.count(" ") - 1))


def _texts(batches, *columns):
    for batch in batches:
        for a, b in slices(batch, "text"):
            part = batch.slice(a, b - a)
            yield ([t or "" for t in part.column("text").to_pylist()], *(part.column(c).to_pylist() for c in columns))


def _starts(folded: str) -> set[str]:
    words = set(folded.split())
    return {" " + w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _counted(rows: DataFrame, terms_of, least: int) -> dict[str, int]:
    """Numbers of texts that hold each term, for terms in at least ``least`` texts."""

    def run(batches):
        counts: Counter = Counter()
        for (texts,) in _texts(batches):
            for t in texts:
                counts.update(terms_of(fold(t)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()

    sums = rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    # The bound of the labelled rows bounds the terms too.
    return {r["term"]: r["n"] for r in sums.filter(F.col("n") >= least).collect()}


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Lexicon, exception phrases and curve from doc_id, text and doc_id, toxic."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    # At most ``most`` rows of two integers: a proven bound for the broadcast.
    picked = labels.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)
    # Copies of a text count once, else the words of a much copied text would seem telling.
    train, path = written(docs.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-train")
    toxic, clean = train.filter("toxic = 1"), train.filter("toxic <> 1")
    sizes = {bool(r["t"]): r["n"] for r in train.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        remove(train.sparkSession, path)
        return Model({}, {})
    least = min(max(LEAST_TEXTS, round(0.01 * n_toxic)), max(2, n_toxic // 2))
    in_toxic = _counted(toxic, _starts, least)
    known = docs.sparkSession.sparkContext.broadcast(frozenset(in_toxic))
    in_clean = _counted(clean, lambda folded: _starts(folded) & known.value, 1)
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in in_toxic.items()}
    entries: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):  # the shortest beginning that tells speaks for all longer ones
        if odds[t] >= LEAST_ODDS and not any(t[:n] in entries for n in range(SHORTEST + 1, len(t))):
            entries[t] = round(odds[t], 4)

    def phrases(folded: str) -> set[str]:
        words, out = folded.split(), set()
        for k, w in enumerate(words):
            for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                if " " + w[:n] in entries:
                    out |= {f" {words[k - 1]} {w} "} if k else set()
                    out |= {f" {w} {words[k + 1]} "} if k + 1 < len(words) else set()
                    break
        return out

    excused = _counted(clean, phrases, 3)
    asked = frozenset(excused)
    against = _counted(toxic, lambda folded: phrases(folded) & asked, 1) if excused else {}
    exceptions = {}
    for p in excused:
        if not against.get(p):
            exceptions[p] = max(w for e, w in entries.items() if e in p)
    model = Model(entries, exceptions)

    def measured(batches):
        a = model.automaton()
        for texts, label in _texts(batches, "toxic"):
            yield pa.RecordBatch.from_pydict({"x": pa.array([density(t, a) for t in texts], pa.float64()), "y": pa.array([float(v == 1) for v in label], pa.float64())})

    rows = train.mapInArrow(measured, "x double, y double").toArrow()  # two numbers for each labelled row
    remove(train.sparkSession, path)
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    order = np.lexsort((y, x))  # the same sums, however the rows were dealt
    model.slope, model.offset = logistic(np.log1p(x[order]), y[order])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes of equal weight, by damped Newton steps."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    scale = max(float(x.max()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (weight * (p - y)) + ridge / 100 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge / 100 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 2 / np.linalg.norm(step)) if np.linalg.norm(step) else step
        if np.linalg.norm(step) < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches):
        a = model.automaton()
        for batch in batches:
            for s, e in slices(batch, "text"):
                part = batch.slice(s, e - s)
                x = np.array([density(t or "", a) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(model.score(x), pa.float64())})

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    out = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    return score(docs, learn(docs, labels, most))
