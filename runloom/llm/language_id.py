"""Language identification in two steps: family first, then one-versus-one within it.

A text is its counts of hashed character n-grams (1 to 3, over lower-cased
letters with other characters as one blank), scaled by the square root and to
unit length. A linear support vector machine for each family, one against the
rest, picks the family; one for each pair of its languages votes on the
language. All are trained here, by L2-regularised squared hinge loss, on a
bounded sample of labelled documents: at most PER_LANGUAGE for each language
and MOST_VECTORS in all, drawn by a hash of the id, whatever the corpus's size.
Of more than MOST_LANGUAGES values of the language column those with the most
documents are learned. Every text is judged whole, however long it is.

Languages of no listed family form families of their own. The score is the
logistic of the family's margin times the mean logistic of the language's
margins over its rivals. Null texts and texts without a letter are `und` with
score 0. With no labelled document every text is `und`. Repeated rows are
judged each; further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import spread

#: Language families by ISO 639 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "hellenic": ("el",),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "iranian": ("fa", "ku", "ps"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "sinitic": ("yue", "zh"),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "austronesian": ("id", "jv", "ms", "tl"),
    "bantu": ("sw", "xh", "zu"),
    "vietic": ("vi",),
    "tai": ("lo", "th"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMS = 1 << 12
PER_LANGUAGE = 500
MOST_LANGUAGES = 200
#: Training documents of all languages together: 16 kB each on the driver, and half as many again while they are drawn.
MOST_VECTORS = 12_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str) -> np.ndarray | None:
    """Unit vector of n-gram counts; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == 0:
        return None
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter | np.concatenate(([True], letter[:-1]))  # a run of other characters is one blank
    x = np.where(letter, codes, 32)[keep].astype(np.uint64)
    x = np.concatenate(([32], x, [32])).astype(np.uint64)
    counts = np.zeros(DIMS, np.int64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, 4):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] * np.uint64(0x100000001B3)) ^ x[n - 1 :]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64), minlength=DIMS)
    v = np.sqrt(counts)
    return v / np.sqrt((v * v).sum())


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias for y in -1, 1: L2-regularised squared hinge loss by accelerated gradient steps."""
    n = len(y)
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    xb = np.hstack((x, np.ones((n, 1)))).astype(np.float32)
    v = np.ones(xb.shape[1], np.float32)
    for _ in range(12):  # largest squared singular value, by power iteration
        v = xb.T @ (xb @ v)
        size = np.linalg.norm(v)
        v /= size
    step = np.float32(1.0 / (1.0 + 2.2 * c * weight.max() / n * size))
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    w = z = np.zeros(xb.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ z))
        gradient = z - np.float32(2 * c / n) * (xb.T @ (weight * y * slack))
        new = z - step * gradient
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Model:
    families: list[list[str]]
    family_weights: np.ndarray  # a row for each family, the bias last
    duels: dict[int, tuple[list[tuple[int, int]], np.ndarray]]  # by family: pairs of languages, their weights

    @staticmethod
    def train(x: np.ndarray, langs: list[str]) -> Model:
        names = sorted(set(langs))
        grouped: dict[str, list[str]] = {}
        for lang in names:
            grouped.setdefault(FAMILY_OF.get(lang.lower().split("-")[0], f"own:{lang}"), []).append(lang)
        families = list(grouped.values())
        labels = np.array(langs)
        member = [np.isin(labels, f) for f in families]
        one = lambda rows, y: np.append(*train_svm(x[rows], y))
        every = np.ones(len(labels), bool)
        if len(families) < 2:
            weights = np.zeros((len(families), x.shape[1] + 1))
            weights[:, -1] = 3.0
        else:
            weights = np.array([one(every, np.where(m, 1.0, -1.0)) for m in member])
        duels = {}
        for i, langs_of in enumerate(families):
            pairs = [(a, b) for a in range(len(langs_of)) for b in range(a)]
            ws = [one(r, np.where(labels[r] == langs_of[a], 1.0, -1.0)) for a, b in pairs for r in [np.isin(labels, (langs_of[a], langs_of[b]))]]
            duels[i] = (pairs, np.array(ws).reshape(len(pairs), x.shape[1] + 1))
        return Model(families, weights, duels)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        v = np.append(v, 1.0)
        margins = self.family_weights @ v
        i = int(np.argmax(margins))
        langs, (pairs, weights) = self.families[i], self.duels[i]
        score = _logistic(margins[i])
        if len(langs) == 1:
            return langs[0], score
        votes, support = np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), m in zip(pairs, weights @ v, strict=True):
            p = _logistic(m)
            votes[a if m > 0 else b] += 1
            support[a] += p
            support[b] += 1 - p
        best = max(range(len(langs)), key=lambda j: (votes[j], support[j], -j))
        return langs[best], score * float(support[best]) / (len(langs) - 1)


def _logistic(m: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(m, -8, 8))))


def held_out(id_column) -> F.Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most per_language documents of each language, those of the smallest hashes."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()
    if not counts:
        return np.zeros((0, DIMS)), []
    per_language = min(per_language, MOST_VECTORS // len(counts))
    order = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 40))
    # half as many again as wanted; the exact bound is set below
    shares = docs.sparkSession.createDataFrame([(r.l, int(min(1.0, 1.5 * per_language / r.n) * (1 << 40))) for r in counts], "l string, share bigint")
    labelled = labelled.join(F.broadcast(shares), "l")
    drawn = labelled.where(order < F.col("share")).select("l", order.alias("o"), "t")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t.as_py()) for t in part.column(2)]
                vectors = [None if f is None else f.astype(np.float32).tobytes() for f in found]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(vectors, pa.binary())], names=["l", "o", "v"])

    by_lang: dict[str, list] = {}
    for r in spread(drawn).mapInArrow(rows, "l string, o bigint, v binary").where("v is not null").toLocalIterator():
        by_lang.setdefault(r.l, []).append((r.o, bytes(r.v)))
    picked = [(lang, v) for lang in sorted(by_lang) for _, v in sorted(by_lang[lang])[:per_language]]
    return np.array([np.frombuffer(v, np.float32) for _, v in picked], np.float32).reshape(-1, DIMS), [lang for lang, _ in picked]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    x, langs = sample(docs, id_col, text_col, lang_col, per_language)
    return Model.train(x, langs) if langs else None


def judged(rows: DataFrame, model: Model | None, text: str) -> DataFrame:
    """rows with lang_pred and score of the column text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # families and pairs of languages times DIMS numbers
    at = rows.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(at):
                v = features(t.as_py()) if t.is_valid and shared.value is not None else None
                lang, score = (UNKNOWN, 0.0) if v is None else shared.value.predict(v)
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread(rows).mapInArrow(work, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score; trains on docs unless a model is given."""
    model = train(docs, id_col, text_col, lang_col) if model is None else model
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return judged(texts, model, "t").select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a language whose score is at least `least`."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"))
    return judged(rows, model, "t").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
