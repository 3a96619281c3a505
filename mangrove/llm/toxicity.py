"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded: lower case, compatibility forms, look-alike letters of other scripts and digits or signs that
stand for letters inside words, everything but letters to single blanks.  The lexicon holds whole words and
word beginnings with the log-odds of toxic over other documents as weights; exception phrases (a lexicon word
with the word before or after it, seen in several clean documents and in no toxic one) cancel the hits inside
them.  A document's weighted hits, as a sum and per hundred words, go through a logistic curve.

Everything is learned from a bounded sample of labelled rows: SAMPLE_DOCS by smallest hash of doc_id, of a repeated
doc_id one text.  Entries stand in at least MIN_DF of its toxic documents; all that are strong enough are kept, as
are all exception phrases.  The sample bounds the model, which is broadcast; scoring sees every whole text.

Cases: null or empty text is scored as one without hits; without labels of both kinds every score is the share
of toxic labels (0 without labels); a doc_id labelled twice counts as toxic if once toxic; rows
without doc_id are neither learned from nor held out; an empty table gives
an empty result; extra columns are kept by ``score_documents``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import tidy, written

SAMPLE_DOCS, MIN_DF = 20_000, 4
BEGINNINGS = range(3, 10)
MIN_LOG_ODDS = 3.0

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмнтвоαορνικεητ", "aeopcyxijsdhkmhtboaopvikent"))
#: Signs that stand for letters inside words.
LEET = dict(zip("013457@$!|", "oieastasil"))

_LEET_RUN = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457](?=[^\W\d_])|(?<=[^\W\d_])[013457](?![^\W_])")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_GLYPHS, _SIGNS = str.maketrans(HOMOGLYPHS), str.maketrans(LEET)
_HAS_LATIN = re.compile(r"[a-z]")
_MIXED = re.compile("[" + "".join(HOMOGLYPHS) + r"]")
_WORD = re.compile(r"[^\W\d_]+")


def _latin(match: re.Match) -> str:
    """A word that mixes scripts becomes Latin; one of another script alone stays."""
    word = match[0]
    return word.translate(_GLYPHS) if _MIXED.search(word) and _HAS_LATIN.search(word) else word


def fold(text: str | None) -> str:
    """Folded text: words between single blanks, a blank at either end."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _MIXED.search(text):
        text = _WORD.sub(_latin, text)
    text = _LEET_RUN.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {_NO_LETTERS.sub(' ', text).strip()} "


def entries_of(folded: str) -> set[str]:
    """Candidate entries: " word " and " beginning" for each different word."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in BEGINNINGS if n < len(w))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    prior: float = 0.0


def choose_entries(toxic_df: dict[str, int], clean_df: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with log-odds of at least MIN_LOG_ODDS.  A beginning goes if one longer entry stands in nearly all
    its toxic documents; after that, an entry goes that a shorter beginning of like weight covers."""
    odds = {e: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean_df.get(e, 0) + 0.5) / (n_clean + 1)) for e, t in toxic_df.items()}
    strong = {e: w for e, w in odds.items() if w >= MIN_LOG_ODDS}
    longer: dict[str, int] = {}
    for e in strong:
        body = e.rstrip()
        for n in range(2, len(body) + (e != body)):
            longer[body[:n]] = max(longer.get(body[:n], 0), toxic_df[e])
    strong = {e: w for e, w in strong.items() if longer.get(e, 0) < 0.95 * toxic_df[e]}
    out = {}
    for e, w in strong.items():
        body = e.strip()
        shorter = [f" {body[:n]}" for n in BEGINNINGS if n < len(body)]
        if not any(s in strong and strong[s] >= w - 0.3 for s in shorter if s != e):
            out[e] = w
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0])))


class Matcher:
    def __init__(self, model: Model):
        self.model, self.lexicon, self.spared = model, None, None
        if model.weights:
            self.lexicon = ahocorasick.Automaton()
            for e, w in model.weights.items():
                self.lexicon.add_word(e, (len(e), w))
            self.lexicon.make_automaton()
        if model.exceptions:
            self.spared = ahocorasick.Automaton()
            for phrase in model.exceptions:
                self.spared.add_word(f" {phrase} ", len(phrase) + 2)
            self.spared.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each hit outside exception phrases; of hits at one start the heaviest."""
        if self.lexicon is None:
            return []
        found: dict[int, float] = {}
        for end, (size, w) in self.lexicon.iter(folded):
            start = end - size + 1
            if w > found.get(start, 0.0):
                found[start] = w
        if found and self.spared is not None:
            for end, size in self.spared.iter(folded):
                for start in [s for s in found if end - size + 1 <= s < end]:
                    del found[start]
        return sorted(found.items())

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 10))

    def score(self, text: str | None) -> float:
        a, b, c = self.model.curve
        if not (a or b or c):
            return self.model.prior
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))


def fit_curve(x: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with slight shrinkage, by Newton steps; rows of ``x`` end in 1."""
    w, ridge = np.zeros(x.shape[1]), np.diag([*[0.05] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (label - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _counts(candidates):
    """Partial document frequencies; of ``candidates`` only, where given."""

    @tidy
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = entries_of(fold(text.as_py()))
                counts.update(found if candidates is None else found & candidates.value)
            if len(counts) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

    return run


def _contexts(model):
    """(features, toxic) of each document and its hits' neighbouring words as phrases."""

    @tidy
    def run(batches):
        matcher = Matcher(model.value)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                folded = fold(text.as_py())
                phrases = set()
                for start, _ in matcher.hits(folded):
                    end = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start) + 1 if start else 0, folded.find(" ", end + 1)
                    if start:
                        phrases.add(folded[before:end])
                    if after > 0:
                        phrases.add(folded[start + 1 : after])
                rows.append((toxic.as_py(), sorted(phrases)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["toxic", "phrases"])

    return run


def _features(model):
    @tidy
    def run(batches):
        matcher = Matcher(model.value)
        for batch in batches:
            got = [matcher.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["toxic", "x", "y"])

    return run


def learnable(doc_id: Column) -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE_DOCS labelled documents."""
    context = docs.sparkSession.sparkContext
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # bounded, so it may be broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of a repeated doc_id the text of the smallest hash, so documents and not rows bound the sample
    rows = met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = written(rows.select("text", "toxic"), "toxic-sample")
    n = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") > 0).count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    prior = n_toxic / (n_toxic + n_clean) if n else 0.0
    if not n_toxic or not n_clean:
        return Model(prior=prior)
    toxic_rows, clean_rows = rows.where("toxic > 0"), rows.where("toxic <= 0")
    counted = lambda part, given: part.mapInArrow(_counts(given), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    top = counted(toxic_rows, None).where(F.col("n") >= MIN_DF)
    toxic_df = dict(map(tuple, top.collect()))
    clean_df = dict(map(tuple, counted(clean_rows, context.broadcast(frozenset(toxic_df))).collect()))
    model = Model(choose_entries(toxic_df, clean_df, n_toxic, n_clean), prior=prior)
    seen = rows.mapInArrow(_contexts(context.broadcast(model)), "toxic int, phrases array<string>")
    seen = seen.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") <= 0, 1).otherwise(0)).alias("c"))
    spared = seen.where("t = 0 AND c >= 3")
    model.exceptions = sorted(r[0] for r in spared.collect())
    points = np.array([tuple(r) for r in rows.mapInArrow(_features(context.broadcast(model)), "toxic int, x double, y double").collect()], dtype=float)
    label = (points[:, 0] > 0).astype(float)
    model.curve = fit_curve(np.column_stack([points[:, 1:], np.ones(len(points))]), label)
    return model


def score_documents(docs: DataFrame, model: Model, column: str = "_toxicity") -> DataFrame:
    """``docs`` with the score as a further column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pa.array([matcher.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(column, F.arrow_udf(score, DoubleType())(docs["text"]))


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_documents(docs.select("doc_id", "text"), learn(docs, labels.select("doc_id", "toxic")), "score")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
