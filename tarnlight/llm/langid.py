"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with L1 and L2
penalties, then calibrated by a temperature.

Features are hashed n-grams of one to three code points of the lower-cased text
(``FEATURES`` slots). Document frequencies count every learnable text in full. A
term's weight is its share of the text's n-grams times its IDF, so a whole text is
scored by one pass of table look-ups. The classifier is fitted on a bounded
sample: about ``PER_LABEL`` documents a label, those of smallest id hash; a fifth
of them set the temperature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, cut, fresh, lists, map_batches, prepare, small, table

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the fitting sample, in documents a label (expected; picked by a hash of the id).
PER_LABEL = 600
UNKNOWN = "und"
#: Code points hashed and looked up at a time.
CHUNK = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature slots of the n-grams of the text, in chunks of bounded size that together cover it."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(1, len(points) - 2), CHUNK):
        own = points[start : start + CHUNK + 2]  # the last n-grams of a chunk reach into the next
        parts = []
        for order in ORDERS:
            n = min(CHUNK, len(points) - start - order + 1)
            if n <= 0:
                continue
            h = np.full(n, order * 0x9E3779B1 % 2**32, np.uint32)
            for i in range(order):
                h = (h ^ own[i : i + n]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            parts.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(16))
        yield np.concatenate(parts)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _document_counts(batches):
    df, seen, n = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not has_letter(text):
                continue
            seen[:] = False
            for slots in grams(text):
                seen[slots] = True
            df += seen
            n += 1
    slots = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(slots, -1)), pa.array(np.append(df[slots], n))], names=["slot", "n"])


def _profiles(batches):
    """Sparse counts of the sampled texts."""
    for batch in batches:
        slots, counts = [], []
        for text in batch.column(1).to_pylist():
            total = np.zeros(FEATURES, np.int64)
            for part in grams(text or ""):
                total += np.bincount(part, minlength=FEATURES)
            own = np.flatnonzero(total)
            slots.append(own.astype(np.int32))
            counts.append(total[own].astype(np.float32))
        if slots:
            yield pa.record_batch([batch.column(0), lists(slots), lists(counts), batch.column(2)], names=["lang", "slots", "counts", "h"])


@dataclass
class FTRL:
    """Per-coordinate FTRL-Proximal for softmax regression; w is 0 where |z| <= l1."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-6

    def __post_init__(self) -> None:
        self.z = np.zeros((FEATURES + 1, self.classes))
        self.n = np.zeros((FEATURES + 1, self.classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, slots: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # IDF times weights, float32, FEATURES rows
    bias: np.ndarray
    heat: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, probability); ``und`` with 0 for a null text, one without a letter, or no labels."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.labels)), 0
        for slots in grams(text):
            total += self.table[slots].sum(0, dtype=np.float64)
            n += len(slots)
        p = softmax((SCALE * total / n + self.bias) / self.heat)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


#: Features are shares of a text's n-grams; this brings them to the size FTRL's rates suit.
SCALE = 10.0


def fit_language_model(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_label: int = PER_LABEL, epochs: int = 4, seed: int = 5) -> LanguageModel:
    """Learn from the rows of ``docs`` with a label that is not null and a text with a letter.

    Document frequencies cover all of them; the weights a sample of about
    ``per_label`` documents a label, picked by a hash of id and text, so null or
    repeated ids do no harm. Rows repeated count each; very long texts count whole.
    No such rows: a model that says ``und``. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    learn = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counted = map_batches(learn.select(text_col), _document_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    n_docs = int(counted.loc[counted["slot"] < 0, "n"].sum())
    counted = counted[counted["slot"] >= 0]
    idf = np.zeros(FEATURES)
    idf[counted["slot"].to_numpy(np.int64)] = np.log1p(n_docs / counted["n"].to_numpy(np.float64))

    sizes = cut(learn.groupBy(F.col(label_col).alias("own")).agg(F.count("*").alias("n")))  # one row a label
    labels = sorted(r["own"] for r in sizes.select("own").collect())
    if not labels or not n_docs:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed)), F.lit(1_000_000))
    share = sizes.select("own", F.ceil(F.lit(per_label * 1_000_000) / F.col("n")).alias("share"))
    sample = learn.join(small(share), F.col(label_col) == F.col("own")).select(F.col("own").cast("string").alias("lang"), F.col(text_col).alias("text"), place.alias("h"), "share").where("h < share")
    rows = map_batches(sample.select("lang", "text", "h"), _profiles, "lang string, slots array<int>, counts array<float>, h bigint").toArrow().to_pandas()
    return fit_profiles(rows, labels, idf, epochs, seed)


def fit_profiles(rows: pd.DataFrame, labels: list[str], idf: np.ndarray, epochs: int, seed: int) -> LanguageModel:
    rows = rows.assign(size=[float(np.sum(c)) for c in rows["counts"]]).sort_values(["h", "lang", "size"], kind="stable")
    at = {str(x): i for i, x in enumerate(labels)}
    data = []
    for lang, slots, counts in zip(rows["lang"], rows["slots"], rows["counts"]):
        slots, counts = np.asarray(slots, np.int64), np.asarray(counts, np.float64)
        if len(slots):
            x = SCALE * counts / counts.sum() * idf[slots]
            data.append((np.append(slots, FEATURES), np.append(x, 1.0), at[lang]))
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    fit = [d for i, d in enumerate(data) if i % 5 != 4]
    model, rng = FTRL(len(labels)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            model.step(*fit[i])
    w = model.weights()
    logits = np.array([x @ w[slots] for slots, x, _ in held]).reshape(len(held), len(labels))
    heat = temperature(logits, np.array([y for _, _, y in held], np.int64))
    return LanguageModel([str(x) for x in labels], (idf[:, None] * w[:-1]).astype(np.float32), w[-1], heat)


def _predict(model, kept: int, at: int, names: list[str]) -> Callable:
    def run(batches):
        own = model.value
        for batch in batches:
            said = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns[:kept], pa.array([x for x, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], names=names)

    return run


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of each row and the two of ``out``, which must not be among them: the language and its
    probability. Null texts and texts without a letter: ``und``, 0. Very long texts are read whole."""
    sent = Shared(docs.sparkSession, model)
    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(fresh(docs, "text"))]))
    at = keep.index(text_col) if text_col in keep else len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return map_batches(rows, _predict(sent, len(keep), at, [*keep, *out]), f"{schema}, `{out[0]}` string, `{out[1]}` double")


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def keep_known_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is recognised with a probability of ``least`` or more.

    The model learns from the rows' own labels, all but a quarter; without any
    label all rows stay. Null texts and texts without a letter go. All columns are
    kept, with their own values even if one is called score.
    """
    model = fit_language_model(docs.where(crc_mod("doc_id", 4) != 2))
    if not model.labels:
        return docs
    out = (fresh(docs, "lang_pred"), fresh(docs, "score"))
    said = predict_language(docs, model, docs.columns, out=out)
    return said.where((F.col(out[0]) != UNKNOWN) & (F.col(out[1]) >= least)).select(*docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = fit_language_model(docs.where("NOT held_out"))
    return predict_language(docs, model, ["doc_id", "held_out"])
