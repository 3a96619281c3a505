"""Language identification by compression with per-language zstandard raw-content dictionaries.

For each language a bounded sample of labelled documents is learned from, their whole texts.  A dictionary is raw
content, so of a sample larger than DICT_BYTES it holds each document's even share: runs of words from places
evenly spread over the whole text.  A text, folded to lower-case letters and single spaces, is compressed whole
with every dictionary, in pieces of PIECE bytes so that the dictionary matters to the end; the language of the
smallest sum wins.  A narrow margin to the second smallest marks the document as rejected.

Bounds, as parameters: SAMPLE_DOCS documents a language (smallest hashes of doc_id under a threshold) and at most
MAX_LANGUAGES languages, more of which are an error; DICT_BYTES a dictionary.  Everything else sees all documents
and whole texts.

Cases: null text or no letter gives ``und`` with score 0, rejected; with one learned language only it is
predicted with score 1; with none learned all are ``und``; equal sums go to the language with more
learned documents, then to the first by name; rows without doc_id are
neither learned from nor held out; extra columns are kept by ``identify`` and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import attach, tidy, written

SAMPLE_DOCS, DICT_BYTES, RUN_BYTES, MAX_LANGUAGES = 300, 110 << 10, 120, 400
PIECE, LEVEL = 4096, 9
#: Blanks behind each piece: without them a short one is stored raw, whatever the dictionary.
FILL = b" " * 32
#: A margin (second sum over smallest sum, less 1) under this is narrow.
NARROW = 0.004
SCORE_SCALE = 25.0

_NO_LETTERS = re.compile(r"[\W\d_]+")
_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


def fold(text: str | None) -> str:
    """Lower-case letters, all else single spaces."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def even_share(text: str, room: int) -> str:
    """``text`` in at most ``room`` bytes: all of it, or runs of about RUN_BYTES evenly spread over the whole of it."""
    data = text.encode()
    if len(data) <= room:
        return text
    n = max(1, room // RUN_BYTES)
    size = room // n - 1
    starts = [round(i * (len(data) - size) / max(1, n - 1)) for i in range(n)]
    return " ".join(data[at : at + size].decode("utf-8", "ignore") for at in starts)


def fitted(texts: list[str]) -> list[str]:
    """An even share of each text, so that all together fill DICT_BYTES at most; what short ones leave goes to others."""
    room, out = DICT_BYTES, {}
    for left, k in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda k: len(texts[k].encode()))):
        out[k] = even_share(texts[k], max(0, room // left - 1))
        room -= len(out[k].encode()) + 1
    return [out[k] for k in range(len(texts))]


@tidy
def _shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whole texts -> what of each can enter a dictionary, folded: DICT_BYTES at most."""
    for texts in batches:
        yield pa.array([even_share(fold(t.as_py()), DICT_BYTES) for t in texts], pa.string())


def training_rows(docs: DataFrame) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def learn_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content by language, from a bounded sample of ``docs`` (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("_n")), "language-counts")
    # a hash threshold leaves about twice the sample of each language, whatever the size of the input; of these
    # the smallest hashes are taken
    slim = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    slim = attach(slim, counts, "lang", F.col("_h"), counts.count())
    share = F.pmod("_h", F.lit(1 << 31)) / F.lit(float(1 << 31))
    n_langs = counts.count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"{n_langs} languages are labelled, {MAX_LANGUAGES} at most can be learned")
    # a repeated doc_id counts once, with its first text by hash, before ranks are given
    slim = slim.where(share < 2.0 * SAMPLE_DOCS / F.col("_n")).groupBy("lang", "doc_id").agg(F.min(F.struct("_t")).alias("_t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id"))
    chosen = slim.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_DOCS).select("doc_id", "lang", "_t._t")
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("_t"))
    rows = sample.join(F.broadcast(chosen), ["doc_id", "lang", "_t"])  # SAMPLE_DOCS a language, MAX_LANGUAGES languages
    rows = rows.groupBy("lang", "doc_id").agg(F.first("text").alias("text"))
    texts: dict[str, list[str]] = {}
    share_of = F.arrow_udf(_shares, StringType())(rows["text"])
    for row in sorted(rows.select("lang", "doc_id", share_of.alias("text")).collect(), key=lambda r: (r[0], r[1])):
        texts.setdefault(row[0], []).append(row[2])
    sizes = {r[0]: r[1] for r in counts.where(F.col("lang").isin(list(texts))).collect()} if texts else {}
    order = sorted((lang for lang, parts in texts.items() if any(parts)), key=lambda lang: (-sizes.get(lang, 0), lang))
    return {lang: " ".join(fitted(texts[lang])).encode() for lang in order}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected) of one text."""
        folded = fold(text)
        if not self.langs or not any(map(str.isalpha, folded)):  # numerals such as ½ are no letters
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        data = folded.encode()
        pieces = [data[i : i + PIECE] + FILL for i in range(0, len(data), PIECE)]
        sizes = [(sum(len(c.compress(p)) for p in pieces), k) for k, c in enumerate(self.coders)]
        (best, k), (second, _) = sorted(sizes)[:2]
        margin = second / best - 1
        return self.langs[k], 1 - math.exp(-SCORE_SCALE * margin) if margin else 0.0, margin < NARROW


_classifier: list = [None, None]


def _predictor(dictionaries):
    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _classifier[0] != dictionaries.id:
            _classifier[:] = [dictionaries.id, Classifier(dictionaries.value)]
        for texts in batches:
            rows = [_classifier[1].classify(t.as_py()) for t in texts]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(cols, ["lang", "score", "rejected"])

    return predict


class _Shared:
    """A broadcast value with a name that workers can compare."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, column: str = "_language") -> DataFrame:
    """``docs`` with a struct column (lang, score, rejected)."""
    if dictionaries is None:
        dictionaries = learn_dictionaries(docs.where(training_rows(docs)))
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(dictionaries))
    predict = F.arrow_udf(_predictor(shared), _RESULT)
    return docs.withColumn(column, predict(docs["text"]))


def op8_query(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce(~training_rows(docs), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"), F.col("_language.rejected").alias("rejected"))
