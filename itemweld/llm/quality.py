"""Document quality by co-training.

Two logistic classifiers see different views of a document: its text (hashed words and
character statistics) and its metadata (language, source, length). Starting from labelled rows, in
each round either one labels the unlabelled rows it is surest of for the other. The finished
views are calibrated on held-out labelled rows and their calibrated odds are added up.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import labelled_sample, sigmoid

HASHED, META = 1 << 10, 1 << 8
STATISTICS = 10
EVIDENCE = 10       # words at which a text's features count half: a few words prove little
ROUNDS, PER_ROUND, SURE = 5, 300, 0.95
PER_CLASS, POOL = 3000, 6000     # bounds of the rows that teach
KEEP = 0.5


def text_view(texts) -> np.ndarray:
    """One row per text: log counts of hashed words, scaled to length one, then statistics.
    A null text is an empty one."""
    out, cache = np.zeros((len(texts), HASHED + STATISTICS), np.float32), {}
    for row, text in zip(out, texts):
        text = text or ""
        words = text.lower().split()
        if not words:
            continue
        if len(cache) > 300_000:
            cache.clear()
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            if w not in cache:
                cache[w] = xxhash.xxh32_intdigest(w) % HASHED
            at[i] = cache[w]
        counts = np.log1p(np.bincount(at, minlength=HASHED))
        row[:HASHED] = counts / np.sqrt((counts ** 2).sum())
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = sum(len(w) for w in words)
        upper = text.upper()
        raised = np.frombuffer(upper.encode("utf-32-le"), np.uint32) if len(upper) == len(text) else codes
        lowered = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32) if len(text.lower()) == len(text) else codes
        cased = raised != lowered
        plain = cased | (codes <= 32) | ((codes >= 48) & (codes < 58)) | np.isin(codes, (44, 46))
        row[HASHED:] = (
            2 * (1 - plain.mean()),                                      # odd characters
            2 * ((codes == raised) & cased).sum() / max(cased.sum(), 1),     # capitals
            3 * ((codes >= 48) & (codes < 58)).mean(),                   # digits
            2 * (at[1:] == at[:-1]).mean() if len(at) > 1 else 0,        # words said twice running
            2 * len(set(words)) / len(words) * min(1.0, len(words) / 20),
            np.log1p(len(words) / len(set(words))) / 2,
            np.log1p(letters / len(words)) / 2,
            sum(not w[-1].isalnum() for w in words) / len(words),        # words that end in a sign
            sum(len(w) == 1 and not w.isalnum() for w in words) / len(words),
            np.log1p(len(words)) / 8)
        row *= len(words) / (len(words) + EVIDENCE)
    return out


def meta_view(columns) -> np.ndarray:
    """One row per document: hashed name=value of each metadata column; numbers by octave of size."""
    names = list(columns)
    out, cache = np.zeros((len(columns[names[0]]) if names else 0, META), np.float32), {}
    for name in names:
        for row, value in zip(out, columns[name]):
            if value is not None and not isinstance(value, str):
                value = "none" if value != value else int(np.log2(max(value, 0) + 1) * 2)
            key = f"{name}={value}"
            if key not in cache:
                cache[key] = xxhash.xxh32_intdigest(key) % META
            row[cache[key]] += 1
    return out


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0       # calibration of the log odds
    offset: float = 0.0

    def odds(self, x):
        return x @ self.weights + self.bias

    def calibrated(self, x):
        return self.slope * self.odds(x) + self.offset


def logistic(x, y, *, ridge=1e-3, steps=120, rate=0.5) -> Logistic:
    """Full-batch Adam; both classes weigh the same."""
    w, b, y = np.zeros(x.shape[1], np.float32), 0.0, np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        return Logistic(w, 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        g = (sigmoid(x @ w + b) - y) * weight
        grad = np.append(g @ x + ridge * w, g.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate / np.sqrt(t) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Logistic(w, float(b))


def calibrate(model: Logistic, x, y) -> Logistic:
    """Platt scaling on held-out rows; the slope never turns negative."""
    if len(y) and y.min() < y.max():
        z = model.odds(x)
        scale = max(float(np.std(z)), 1e-9)
        fitted = logistic((z / scale)[:, None], y, steps=400, rate=0.3)
        model.slope, model.offset = max(float(fitted.weights[0]) / scale, 0.0), fitted.bias
    return model


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    meta_columns: list
    rounds: list        # rows taught to (text, metadata) in each round

    def score(self, t, m):
        """Probability of good quality: the calibrated odds of both views together."""
        return sigmoid(self.text.calibrated(t) + self.meta.calibrated(m))


def co_train(text_rows, meta_rows, labels, pool_text, pool_meta, meta_columns, *, rounds=ROUNDS,
             per_round=PER_ROUND, sure=SURE, validation=4) -> CoTrained:
    """Co-training in the driver on bounded rows. Every ``validation``-th labelled row only calibrates."""
    y = np.asarray(labels, float)
    held = np.arange(len(y)) % validation == 0
    views = [(text_rows[~held], text_rows[held], pool_text), (meta_rows[~held], meta_rows[held], pool_meta)]
    fresh = [np.full(len(pool_text), -1) for _ in views]       # label a view has been taught for a pool row
    history, models = [], []
    for step in range(rounds + 1):
        models = []
        for (own, _, pool), taught in zip(views, fresh):
            use = taught >= 0
            models.append(logistic(np.concatenate([own, pool[use]]), np.concatenate([y[~held], taught[use]])))
        for model, (_, x, _) in zip(models, views):
            calibrate(model, x, y[held])
        if step == rounds or not len(pool_text):
            break
        given = []
        for teacher, pupil in ((0, 1), (1, 0)):
            p = sigmoid(models[teacher].calibrated(views[teacher][2]))
            count = 0
            for label, trust in ((1, p), (0, 1 - p)):
                best = np.argsort(-trust, kind="stable")
                best = best[(trust[best] >= sure) & (fresh[pupil][best] < 0)][:per_round]
                fresh[pupil][best] = label
                count += len(best)
            given.append(count)
        history.append((given[1], given[0]))
        if not any(given):
            break
    return CoTrained(models[0], models[1], list(meta_columns), history)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", meta=("lang", "source", "n_chars"),
        label="quality", per_class=PER_CLASS, pool=POOL) -> CoTrained:
    """Learns from at most ``per_class`` labelled rows of either class and ``pool`` unlabelled
    ones, those of lowest key hash. Rows with null keys teach nothing."""
    meta = [c for c in meta if c in docs.columns]
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                        *[F.col(c).alias(f"m{i}") for i, c in enumerate(meta)])
    columns = ["text", *[f"m{i}" for i in range(len(meta))]]
    named_labels = labels.select(F.col("doc_id"), F.col(label).alias("value"))
    known = labelled_sample(named, named_labels, "value", per_class, columns=columns).toPandas()
    ids = named.select("doc_id").where("doc_id IS NOT NULL").join(named_labels, "doc_id", "left_anti").distinct()
    lowest = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    more = (named.join(F.broadcast(lowest), "doc_id", "left_semi").where("length(text) <= 200000")
            .dropDuplicates(["doc_id"]).toPandas())
    known, more = known.sort_values("k", key=lambda c: c * 2654435761 % 2**32), more.sort_values("doc_id")

    def views(frame):
        own = {c: [None if v is None or v != v else v for v in frame[f"m{i}"].tolist()] for i, c in enumerate(meta)}
        return text_view(frame["text"].tolist()), meta_view(own) if meta else np.zeros((len(frame), META), np.float32)

    (t, m), (pt, pm) = views(known), views(more)
    return co_train(t, m, known["label"].to_numpy(), pt, pm, meta)


def score(docs: DataFrame, model: CoTrained, *, text="text") -> DataFrame:
    """``docs`` with one more column ``quality_view``: struct(score double, text_score double,
    meta_score double, keep boolean). Every whole text is scored. Null, empty and blank texts have
    nothing to train on: score 0, not kept. An input column of that name is replaced."""
    names = model.meta_columns

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text_part, *rest in parts:
            frames = []
            for a in range(0, len(text_part), 2000):
                some = text_part.iloc[a:a + 2000].tolist()
                t = text_view(some)
                own = {n: [None if v is None or v != v else v for v in c.iloc[a:a + 2000].tolist()]
                       for n, c in zip(names, rest)}
                m = meta_view(own) if names else np.zeros((len(some), META), np.float32)
                empty = np.array([not (x or "").strip() for x in some])
                s = np.where(empty, 0.0, model.score(t, m))
                frames.append(pd.DataFrame({"score": s, "text_score": np.where(empty, 0.0, sigmoid(model.text.calibrated(t))),
                                            "meta_score": sigmoid(model.meta.calibrated(m)), "keep": s >= KEEP}))
            yield pd.concat(frames) if frames else pd.DataFrame(
                {"score": [], "text_score": [], "meta_score": [], "keep": []})

    udf = F.pandas_udf(run, "struct<score:double,text_score:double,meta_score:double,keep:boolean>")
    return docs.withColumn("quality_view", udf(F.col(text).cast("string"), *[F.col(n) for n in names]))
