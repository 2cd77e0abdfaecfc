"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A
text is encoded with every dictionary, in pieces of ``PIECE`` bytes over its whole
length so that the dictionary counts throughout; the language of the smallest
total is chosen. A margin to the second under ``MIN_MARGIN`` rejects.

The fit takes ``SAMPLE_TEXTS`` distinct labelled texts of each language at most, chosen
by hash, and reads them whole. Null texts and those without a letter (a character of
Unicode category L) are ``und`` with score 0, as is every text if nothing could be
learned. Ties go to the language first in order. A null id is held out from nothing:
its row is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, id_remainder, slices

SAMPLE_TEXTS = 40
PIECE = 4096
LEVEL = 6
MIN_MARGIN = 0.004
_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """A dictionary for each language of labelled ``docs`` (text, lang); at most about 3 ``texts`` of each come to the driver."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string"), "text", F.xxhash64("text").alias("h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not n:
        return {}
    share = {lang: int(min(1.0, 2.5 * texts / max(1, k)) * 2**31) for lang, k in n.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    part = rows.where(F.pmod(F.col("h"), F.lit(2**31)) < limit)
    got = sorted((r["lang"], r["h"], r["t"]) for r in part.groupBy("lang", "h").agg(F.min("text").alias("t")).collect())
    out: dict[str, list[str]] = {}
    for lang, _, t in got:
        if len(have := out.setdefault(lang, [])) < texts and _LETTER.search(t):
            have.append(t.lower())
    return {lang: "\n".join(t).encode() for lang, t in out.items() if t}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin."""
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0
        s = np.array(self.sizes(text), dtype=np.float64)
        best = int(np.argmin(s))
        if len(s) == 1:
            return self.langs[0], 1.0, 1.0
        margin = float(np.partition(s, 1)[1] / s[best] - 1.0)
        return self.langs[best], margin / (margin + 0.02), margin


_made: dict[int, Classifier] = {}


def _classifier(shared) -> Classifier:
    """One for each worker process and model."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Classifier(shared.value)
    return _made[shared.id]


class _Shared:
    """Dictionaries: SAMPLE_TEXTS texts of each language at most."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``(doc_id, lang_pred, score, margin, rejected)`` for each row; lang, source and id are not looked at."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(dictionaries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            c = _classifier(shared)
            out = [c.predict(t) for t in b.column(1).to_pylist()]
            lang, score, margin = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(margin), pa.array([m < MIN_MARGIN for m in margin])], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Documents, all columns, whose language is told with a clear margin."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(dictionaries))

    def keep(b: pa.RecordBatch) -> np.ndarray:
        c = _classifier(shared)
        return np.array([c.predict(t)[2] >= MIN_MARGIN for t in b.column(1).to_pylist()], dtype=bool)

    return filtered(docs, ["text"], keep)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder("doc_id", 4) != 2)


__all__ = ["Classifier", "accepted", "fit", "predict", "training_rows"]
