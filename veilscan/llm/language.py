"""Language identification in two steps: the family first, then the language within it.

A text becomes one vector: hashed counts of its letters' 1- to 3-grams (lower case, runs of other
characters as one gap), damped and scaled to length one. A linear support vector machine per family, one
against the rest, picks the family. Within it every pair of languages has a machine of its own; the
language that wins most pairs is taken, ties by the sum of margins, then by name.

Training needs few rows: it takes a sample of labelled texts of at most ``sample_rows`` rows over all
languages, chosen by hash, equal shares per language. Only their vectors reach the driver. Prediction is
one narrow pass over all whole texts.

Rows without a text, or whose text has no letter, get ``und`` and score 0; so does every row if no
labelled text with a letter exists.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.common import byte_slices, give_back, numbered, small_batches

UNKNOWN = "und"

#: Families of languages (ISO 639-1); any other language counts as a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro", "rm"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

DIM = 1 << 12
#: Characters that are hashed at once.
STEP = 1 << 18

#: What makes a letter: lower-case code points of letters, 0 for everything else, filled block by block.
_LETTERS: dict[int, np.ndarray] = {}


def letters(codes: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for all other characters."""
    out = np.zeros(len(codes), dtype=np.uint32)
    blocks = codes >> 8
    for block in np.unique(blocks).tolist():
        if block not in _LETTERS:
            chars = [chr(c) for c in range(block << 8, (block + 1) << 8)]
            _LETTERS[block] = np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], dtype=np.uint32)
        here = blocks == block
        out[here] = _LETTERS[block][codes[here] & 0xFF]
    return out


def vector(text: str) -> np.ndarray | None:
    """The vector of a whole text, None if it has no letter."""
    counts = np.zeros(DIM)
    before = np.zeros(3, dtype=np.uint32)  # the last characters of the step before
    seen = False
    for at in range(0, len(text), STEP):
        c = letters(np.frombuffer(text[at : at + STEP].encode("utf-32-le", "replace"), dtype=np.uint32))
        c = c[(c > 0) | (np.concatenate([before[-1:], c[:-1]]) > 0)]  # gaps count as one character
        if not len(c):
            continue
        seen |= bool(c.any())
        c = np.concatenate([before[-2:], c])
        a, b, d = c[:-2], c[1:-1], c[2:]
        with np.errstate(over="ignore"):
            one = d * np.uint32(0x9E3779B1)
            two = one ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
            three = two ^ (a * np.uint32(0xC2B2AE35) + np.uint32(0x165667B1))
            for h in (one, two, three):
                counts += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIM)
        before = c[-2:]
    if not seen:
        return None
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge, classes weighted alike) by accelerated descent.

    ``y`` has +1 and -1; the last weight is the constant term.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    ahead, t, step = w.copy(), 1.0, 1 / (4.0 + penalty)  # rows have length sqrt(2)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2 * ((share * y * slack) @ x))
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / faster * (new - w)
        w, t = new, faster
    return w


def likelihood(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margins, -20, 20)))


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # one row per family
    langs: dict[str, list[str]] = field(default_factory=dict)  # family -> its languages
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)  # family -> one row per pair

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of vectors."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        sure = likelihood((x @ self.family_weights.T).astype(np.float64))
        sure /= sure.sum(axis=1, keepdims=True)
        first = sure.argmax(axis=1)
        names = [""] * len(x)
        score = sure[np.arange(len(x)), first]
        for f, family in enumerate(self.families):
            rows, langs = np.flatnonzero(first == f), self.langs[family]
            if not len(rows):
                continue
            if len(langs) == 1:
                for r in rows:
                    names[r] = langs[0]
                continue
            margins = (x[rows] @ self.pair_weights[family].T).astype(np.float64)
            wins, total, chance = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for k, (i, j) in enumerate(combinations(range(len(langs)), 2)):
                m = margins[:, k]
                for lang, signed in ((i, m), (j, -m)):
                    wins[:, lang] += signed > 0
                    total[:, lang] += signed
                    chance[:, lang] += likelihood(signed)
            best = np.lexsort((np.broadcast_to(-np.arange(len(langs)), wins.shape), total, wins), axis=1)[:, -1]
            score[rows] *= chance[np.arange(len(rows)), best] / (len(langs) - 1)
            for r, b in zip(rows, best, strict=True):
                names[r] = langs[b]
        return names, score


def train(x: np.ndarray, langs: np.ndarray) -> Model:
    """A model of at least one labelled vector."""
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(by_family)
    family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
    if len(families) == 1:
        weights = np.zeros((1, DIM + 1), dtype=np.float32)
        weights[0, -1] = 1
    else:
        weights = np.vstack([machine(x, np.where(family == f, 1.0, -1.0)) for f in families])
    model = Model(families, weights, by_family)
    for f, own in by_family.items():
        if len(own) > 1:
            rows = [np.isin(langs, pair) for pair in combinations(own, 2)]
            model.pair_weights[f] = np.vstack(
                [machine(x[r], np.where(langs[r] == i, 1.0, -1.0)) for r, (i, _) in zip(rows, combinations(own, 2), strict=True)]
            )
    return model


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of ``lang, text, key``, equal shares per language, chosen by hash of ``key``."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = rows / max(1, len(counts))
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(part)
    return labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < part * (1 << 20))


def fit(labelled: DataFrame, sample_rows: int = 2_000) -> Model | None:
    """A model of rows ``lang, text, key``. At most ``sample_rows`` vectors (and a quarter more) are used."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                vectors = [vector(t) for t in part.column(1).to_pylist()]
                kept = [(lang, v.tobytes()) for lang, v in zip(part.column(0).to_pylist(), vectors, strict=True) if v is not None]
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([k for k, _ in kept], pa.string()), "v": pa.array([v for _, v in kept], pa.binary())}
                )

    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    taken = sample(labelled, sample_rows).select("lang", "text").mapInArrow(run, "lang string, v binary")
    got = taken.limit(sample_rows * 5 // 4).toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["v"].to_pylist()), dtype=np.float32).reshape(-1, DIM)
    langs = np.array(got["lang"].to_pylist(), dtype=object)
    order = np.lexsort((x[:, 0], langs))
    return train(x[order], langs[order])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (input columns of these names give way)."""
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights per family and pair

    def run(batches):
        own = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                vectors = [vector(t) if t and own else None for t in batch.column(at).to_pylist()]
                names, scores = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
                if known := [i for i, v in enumerate(vectors) if v is not None]:
                    found, score = own.predict(np.vstack([vectors[i] for i in known]))
                    scores[known] = score
                    for i, name in zip(known, found, strict=True):
                        names[i] = name
                columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return kept.mapInArrow(run, schema)


def lettered(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` without the rows that have no text, or no letter in it."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, at):
                kept = [bool(t) and any(map(str.isalpha, t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def learned(docs: DataFrame) -> Model | None:
    """A model from the documents outside the held-out fold; rows without an id are not learned from."""
    return fit(docs.where(fold() != 0).select("lang", "text", F.col("doc_id").alias("key")))


def known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows in no language (no text, or no letter in it), also if there is nothing to learn from."""
    rows, text_col = numbered(docs), f"c{docs.columns.index('text')}"
    if (model := learned(docs)) is None:  # every row would be in no language
        return lettered(rows, text_col).toDF(*docs.columns)
    done = identify(rows, model, text_col)
    return done.where(F.col("lang_pred") != UNKNOWN).select(*rows.columns).toDF(*docs.columns)


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: whether it is held out (false without an id), its language and the score."""
    done = identify(docs.select("doc_id", "text"), learned(docs))
    return done.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
