"""Quality of feedback texts by compression: which of two Zstandard dictionaries, of good or of bad texts, shortens a text more.

One dictionary is built from pieces of texts labelled good, one from pieces of texts labelled bad. A text is cut into
pieces of about ``PIECE_BYTES``, every piece is compressed with both, and the difference of the sizes, divided by their sum,
says which kind the text resembles: over the whole text and for its worst piece. These differences, the compressed
size per byte and the length are calibrated by a logistic regression with squares and products, weighted so that the
classes count as often as they are labelled. The labelled rows used are bounded by ``rows_per_class``: keys are taken
whose hash lies below the share wanted. For the calibration each half of them is measured with dictionaries made from
the other half; the model's own dictionaries are made from both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import per_batch

PIECE_BYTES = 1000
PIECES_PER_TEXT = 4
DICTIONARY_BYTES = 112_640
LEVEL = 1
ROWS_PER_CLASS = 4000
THRESHOLD = 0.7


def pieces_of(text: str | None) -> list[bytes]:
    """Nearly equal pieces that together are the whole text; one empty piece for a null or empty text."""
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // PIECE_BYTES))
    edges = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def spread_pieces(text: str | None, most: int = PIECES_PER_TEXT) -> list[bytes]:
    """At most ``most`` pieces, evenly spread over the text."""
    found = pieces_of(text)
    return found if len(found) <= most else [found[len(found) * i // most] for i in range(most)]


@dataclass
class QualityModel:
    """Two dictionaries and the calibration. Without labelled rows of both classes every text gets ``share``."""

    share: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def compressors(self):
        import zstandard
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress
                for d in (self.good, self.bad)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        good, bad = self.compressors()
        rows = []
        for text in texts:
            cut = pieces_of(text)
            g, b = np.array([len(good(p)) for p in cut], float), np.array([len(bad(p)) for p in cut], float)
            size = sum(map(len, cut))
            rows.append(((b.sum() - g.sum()) / (b.sum() + g.sum()), np.log(g.sum() / (size + 1)), ((b - g) / (b + g)).min(), np.log(size + 1)))
        return np.array(rows).reshape(-1, 4)

    def expand(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.column_stack([np.ones(len(z)), z, *pairs])

    def calibrate(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> None:
        """Weighted logistic regression by Newton steps, halved until the objective falls."""
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        x = self.expand(rows)
        self.weights = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-6

        def loss(w: np.ndarray) -> float:
            margin = np.where(labels > 0, x @ w, -(x @ w))
            return float(weight @ np.logaddexp(0, -margin) + penalty @ (w * w) / 2)

        now = loss(self.weights)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))
            slope = x.T @ (weight * (p - labels)) + penalty * self.weights
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
            rate = 1.0
            while rate > 1e-6 and (then := loss(self.weights - rate * step)) >= now:
                rate /= 2
            if rate <= 1e-6 or now - then < 1e-9 * max(1.0, now):
                break
            self.weights, now = self.weights - rate * step, then

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.expand(self.features(texts)) @ self.weights, -500, 500)))


def as_dictionary(raw: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(raw)


def build_dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the pieces themselves."""
    import zstandard
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 4)), pieces, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"-" * 8


def sampled_labels(labels: DataFrame, key: str, label: str, rows_per_class: int) -> DataFrame:
    """(key, label, weight, part): about ``rows_per_class`` labelled keys of each class, all where there are fewer, and
    how many labelled keys each stands for; ``part`` halves them.

    Keys are taken whose hash lies below the share that is wanted, so no class is ordered or gathered.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    totals = known.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    place = F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(totals), "label").filter(place * F.col("total") < rows_per_class)
    weight = F.greatest(F.col("total") / rows_per_class, F.lit(1.0))
    return chosen.select("key", "label", weight.alias("weight"), F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(2)).alias("part"))


def train_quality(feedback: DataFrame, labels: DataFrame, key: str = "session_id", text: str = "free_text_feedback", label: str = "quality",
                  rows_per_class: int = ROWS_PER_CLASS, pieces_per_text: int | None = PIECES_PER_TEXT) -> QualityModel:
    """A model from ``feedback`` and ``labels`` (key, label 0 or 1), of which only rows to be learnt from may be given.

    The sampled labels (about 2 x ``rows_per_class`` rows at most) are broadcast; their texts are read in one pass.
    The dictionaries learn from ``pieces_per_text`` pieces of each of them, spread over the text, or from all (None); the
    calibration reads whole texts. Null keys and other label values are left out.
    """
    chosen = F.broadcast(sampled_labels(labels, key, label, rows_per_class))
    texts = feedback.select(feedback[key].alias("key"), feedback[text].alias("text")).join(chosen, "key")

    def cut(rows: dict[str, list]) -> dict[str, list]:
        return {"label": rows["label"], "part": rows["part"], "pieces": [pieces_of(t) if pieces_per_text is None else spread_pieces(t, pieces_per_text) for t in rows["text"]]}

    seen = per_batch(texts, {"text": "text", "label": "label", "part": "part"}, "label int, part bigint, pieces array<binary>", cut, weigh="text").toArrow()
    label, part = seen.column("label").to_numpy(), seen.column("part").to_numpy()
    pieces = seen.column("pieces").to_pylist()

    def dictionary(wanted: int, parts: tuple[int, ...]) -> bytes:
        return build_dictionary(sorted(p for q, n, found in zip(label, part, pieces) if q == wanted and n in parts for p in found))

    share = float(label.mean()) if len(label) else 0.5
    if len(set(zip(label.tolist(), part.tolist()))) < 4:
        return QualityModel(share)
    # Each half is measured with the dictionaries of the other half; the model keeps those of both.
    halves = [QualityModel(share, dictionary(1, (n,)), dictionary(0, (n,))) for n in (0, 1)]
    model = QualityModel(share, dictionary(1, (0, 1)), dictionary(0, (0, 1)))

    def measure(rows: dict[str, list]) -> dict[str, list]:
        found = [None] * len(rows["text"])
        for n in (0, 1):
            places = [i for i, p in enumerate(rows["part"]) if p == n]
            for i, row in zip(places, halves[1 - n].features([rows["text"][i] for i in places]).tolist()):
                found[i] = row
        return {"label": rows["label"], "weight": rows["weight"], "features": found}

    held = per_batch(texts, {"text": "text", "label": "label", "weight": "weight", "part": "part"},
                     "label int, weight double, features array<double>", measure, weigh="text").collect()
    held.sort(key=lambda r: (r["label"], r["features"]))
    model.calibrate(np.array([r["features"] for r in held]), np.array([r["label"] for r in held], float), np.array([r["weight"] for r in held]))
    return model


def score_quality(feedback: DataFrame, model: QualityModel, key: str = "session_id", text: str = "free_text_feedback", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) for every feedback row; no shuffle. Only the text goes into the score.

    ``score`` is between 0 and 1, higher where label 1 is likelier; ``predicted`` is 1 from ``threshold`` on. Null texts
    are scored as empty ones. Null and repeated keys are kept row by row; other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        scores = model.scores(rows["text"])
        return {"key": rows["key"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, score double, predicted int", work, weigh="text").withColumnRenamed("key", key)


def keep_good(feedback: DataFrame, model: QualityModel, text: str = "free_text_feedback", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``feedback`` that the model does not reject, columns unchanged: all of them where it has no weights."""
    if not len(model.weights):
        return feedback

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return feedback.filter(score(feedback[text]) >= threshold)
