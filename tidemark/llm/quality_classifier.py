"""Quality classifier: which of two zstandard dictionaries suits a text better.

One dictionary is built from good and one from bad labelled texts. A text is
compressed with either, piece by piece; the difference of the two sizes over
their sum is turned into a probability by a logistic curve fitted on labelled
texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.runtime import table

#: Labelled texts of each class that build its dictionary, the pieces taken from
#: them, and labelled texts that fit the curve: bounds of what reaches the driver.
DICT_DOCS, DICT_PIECES, CURVE_DOCS = 1500, 8000, 12_000
DICT_BYTES = 112_640
#: Pieces of a text (bytes; characters in samples) are compressed apart, so long
#: texts lean on the dictionary too.
PIECE = 1024
LEVEL = 3


def build_dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary trained on pieces of text, of DICT_BYTES or of their size if
    that is less; empty if there is too little to train one on."""
    size = min(DICT_BYTES, sum(map(len, pieces)))
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8, level=LEVEL).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = []
        for d in (self.good, self.bad):
            z = zstandard.ZstdCompressionDict(d) if d else None
            if z:
                z.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))
        return tuple(made)


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with bad - size with good) / their sum, over the whole text."""
    g = b = 0
    for i in range(0, max(1, len(text)), PIECE):
        piece = text[i : i + PIECE]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / (b + g)


def _differences(df: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for b in batches:
            d = [difference((t.as_py() or "").encode(), *pair) for t in b.column(text)]
            kept = [b.column(n) for n in names if n != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(d, pa.float64())], names=[*(n for n in names if n != text), out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in (text, out))
    return df.select(*names).mapInArrow(run, (fields + ", " if fields else "") + f"`{out}` double")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps on standardised x."""
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from labelled texts (label 0 or 1; others are ignored).

    A hash of its id puts a labelled text on the dictionaries' or the curve's
    side; of either, those of smallest hash are drawn: DICT_DOCS of each class,
    CURVE_DOCS in all. A dictionary is trained on at most DICT_PIECES pieces, one
    of each text before a second of any. So reruns agree and the sample is
    bounded. An id counts with its largest label and its least text, however many
    rows have it. Where a class has too little text for a dictionary, there is
    none and every score is the share of label 1 (one half without labels)."""
    named = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_y"))
    named = named.withColumn("_h", F.xxhash64(F.col(id_col), F.lit("sample"))).withColumn("_dict", F.pmod("_h", F.lit(2)) == 0)
    draw = lambda which, n: named.where(which).orderBy("_h", id_col).limit(n)
    sides = [draw(F.col("_dict") & (F.col("_y") == y), DICT_DOCS) for y in (0, 1)]
    # at most 2 * DICT_DOCS + CURVE_DOCS small rows
    ids = F.broadcast(sides[0].unionByName(sides[1]).unionByName(draw(~F.col("_dict"), CURVE_DOCS)))
    some = docs.select(F.col(id_col), text_of(docs, text).alias("_t")).join(ids, id_col)
    some = table(some.groupBy("_h", "_y", "_dict").agg(F.min("_t").alias("_t")), "labelled")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / PIECE).cast("int")))
    pieces = some.where("_dict and _t <> ''").select("_h", "_y", "_t", at.alias("i")).withColumn("h", F.xxhash64("_h", "i"))
    pieces = pieces.withColumn("r", F.row_number().over(Window.partitionBy("_h").orderBy("h")))
    pieces = pieces.withColumn("_t", F.substring("_t", F.col("i") * PIECE + 1, F.lit(PIECE)))
    drawn = [pieces.where(F.col("_y") == y).orderBy("r", "h").limit(DICT_PIECES).select("_t").collect() for y in (0, 1)]
    bad, good = (build_dictionary([r["_t"].encode() for r in rows]) for rows in drawn)
    if not good or not bad:
        n, ones = some.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
        share = (ones + 0.5) / (n + 1)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(good, bad)
    of = lambda rows: _differences(rows.select("_y", "_h", "_t"), model, "_t", "_d").select("_d", "_y", "_h").collect()
    got = of(some.where(~F.col("_dict")))
    if len({r["_y"] for r in got}) < 2:
        got = of(some)
    got.sort(key=lambda r: (r["_h"], r["_d"]))
    slope, offset = _logistic(np.array([r["_d"] for r in got]), np.array([float(r["_y"]) for r in got]))
    return Model(model.good, model.bad, slope, offset)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`df` without `text`, with `out`: the probability of label 1. Null counts
    as the empty text; every row, repeats included, gets a score from its text
    alone; a column named `out` is replaced."""
    d = _differences(df, model, text, out)
    return d.withColumn(out, 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), model.slope * F.col(out) + model.offset)))))
