"""Quality classifier by co-training of a content view and a metadata view.

Two logistic regressions see different things: one the text (byte shares, word
statistics, hashed words), the other the page's metadata (language, source, length).
Over rounds each labels, of all documents outside the labelled sample, those it is
surest of for the other to learn from.  Both are calibrated on rows held out of the training, and a last regression
on the calibrated log odds combines them.  Then all documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Words, small_batches

#: Bound of the sample of labelled rows.
LABELLED = 3_000
ROUNDS = 2
#: Pseudo-labels per round, view and label, and how sure a view must be of them.
EACH_ROUND, SURE = 200, 0.97
HASHED, META = 256, 64


def content_features(texts: list[bytes]) -> np.ndarray:
    """A row per text: shares of bytes, word statistics and hashed words; zeros for a text without words."""
    words = Words(texts, lower=True)
    n = len(texts)
    counts = words.counts()
    raw = np.frombuffer(words.data, np.uint8)
    out = np.zeros((n, 128 + 8 + HASHED), np.float32)
    for i, t in enumerate(texts):
        if not counts[i]:
            continue
        a, b = words.text_at[i], words.text_at[i] + len(t)
        share = np.bincount(np.minimum(raw[a:b], 128), minlength=129) / len(t)
        out[i, :128] = np.log1p(1000 * share[:128]) / 7
        h = words.hashes[words.first[i] : words.first[i + 1]]
        size = words.ends[words.first[i] : words.first[i + 1]] - words.starts[words.first[i] : words.first[i + 1]]
        distinct = np.unique(h, return_counts=True)[1]
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 128:136] = (
            share[128], np.log1p(size.mean()) / 3, size.std() / 10, len(distinct) / len(h), distinct.max() / len(h),
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(size.max()) / 5, (share[65:91].sum() > 0.3),
        )
        out[i, 136:] = np.log1p(1000 * np.bincount((h % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / len(h)) / 7
    return out


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """A row per document: language and source, hashed, and length classes."""
    out = np.zeros((len(langs), 2 * META + 16), np.float32)
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, zlib.crc32(f"l{lang}".encode()) % META] = 1
        out[i, META + zlib.crc32(f"s{source}".encode()) % META] = 1
        out[i, 2 * META + min(15, max(0, int(size or 0)).bit_length() // 2)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, intercept last, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Both views, their calibrations and the combination, as far as they are trained.

    A quarter of the labelled rows calibrates the views and the combination; the rest
    trains.  ``taught`` has, per view, the pseudo-labels it got from the other one.
    """

    def __init__(self, content: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views, self.y = (content, meta), y
        self.held = np.arange(len(y)) % 4 == 3
        self.taught: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
        self.constant = None
        if len(np.unique(y[~self.held])) < 2 or len(np.unique(y[self.held])) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
        else:
            self.train()

    def train(self) -> None:
        held, y = self.held, self.y
        self.weights = []
        for own, more in zip(self.views, self.taught, strict=True):
            rows = [more[i] for i in sorted(more)]
            x = np.concatenate((own[~held], np.stack([v for _, v in rows]))) if rows else own[~held]
            z = np.concatenate((y[~held], [label for label, _ in rows]))
            self.weights.append(logistic(x, z, np.concatenate((np.ones((~held).sum()), np.full(len(rows), 0.5)))))
        self.scale = [logistic(odds(w, own[held])[:, None], y[held], ridge=1e-2) for w, own in zip(self.weights, self.views, strict=True)]
        self.mix = logistic(np.column_stack(self._calibrated([own[held] for own in self.views])), y[held], ridge=1e-1)

    def _calibrated(self, views) -> list[np.ndarray]:
        return [odds(s, odds(w, x)[:, None]) for s, w, x in zip(self.scale, self.weights, views, strict=True)]

    def teach(self, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> bool:
        """Give the other view the labels of rows (doc_id, view, label, content, metadata); whether any are new."""
        before = [len(t) for t in self.taught]
        for doc_id, view, label, content, meta in rows:
            self.taught[1 - view].setdefault(doc_id, (label, (content, meta)[1 - view]))
        if [len(t) for t in self.taught] == before:
            return False
        self.train()
        return True

    def scorer(self) -> Model:
        """What scoring needs, without the rows learned from."""
        out = object.__new__(Model)
        out.constant = self.constant
        if self.constant is None:
            out.weights, out.scale, out.mix = self.weights, self.scale, self.mix
        return out

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: by content, by metadata, combined."""
        n = len(content)
        if self.constant is not None:
            return (np.full(n, self.constant),) * 3
        z = self._calibrated((content, meta))
        return _p(z[0]), _p(z[1]), _p(odds(self.mix, np.column_stack(z)))


_ROW = "doc_id long, lang string, source string, n_chars long, text string"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))


def _surest(docs: DataFrame, model: Model, learned: set[int], each: int, sure: float) -> list:
    """Of all rows but the learned ones, per view and label the ``each`` that the view is surest of.

    Copies of one text count once.  A task passes on no more than ``each`` rows per view and label.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.scorer(), learned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value
        best: dict[tuple[int, int], dict[int, tuple[float, int]]] = {(v, label): {} for v in (0, 1) for label in (0, 1)}
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                p = known.score(content_features(texts), meta_features(*(part[k].to_pylist() for k in ("lang", "source", "n_chars"))))
                ids, bodies = part["doc_id"].to_pylist(), part["body"].to_pylist()
                for (v, label), kept in best.items():
                    how = p[v] if label else 1 - p[v]
                    for i in np.flatnonzero(how >= sure).tolist():
                        if ids[i] in seen or not texts[i].strip():
                            continue
                        have = kept.get(bodies[i])
                        if have is None or (-how[i], ids[i]) < (-have[0], have[1]):
                            kept[bodies[i]] = (float(how[i]), ids[i])
                    if len(kept) > 8 * each:
                        best[v, label] = dict(sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:each])
        rows = [(v, label, body, *x) for (v, label), kept in best.items() for body, x in sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:each]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["view", "label", "body", "sure", "doc_id"])

    rows = _rows(docs).where("doc_id is not null").withColumn("body", F.xxhash64("text"))
    found = common.written(rows.mapInArrow(run, "view int, label int, body long, sure double, doc_id long").groupBy("view", "label", "body").agg(F.min(F.struct((-F.col("sure")).alias("less"), "doc_id")).alias("x")).select("view", "label", "body", (-F.col("x.less")).alias("sure"), "x.doc_id"), "surest")
    # The report of the surest rows: a top-k of each view and label.
    out = [r for v in (0, 1) for label in (0, 1) for r in found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.desc("sure"), "body").limit(each).collect()]
    common.dropped(found)
    return out


def _vectors(docs: DataFrame, wanted: list[tuple[int, int | None]]) -> dict[tuple[int, int | None], tuple[np.ndarray, np.ndarray]]:
    """Content and metadata vectors of a bounded number of documents, each given by its doc_id and the hash of its text.

    Without the hash it is the text with the least hash under that doc_id; of rows alike in both, the least vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                c = content_features(texts)
                m = meta_features(*(part[k].to_pylist() for k in ("lang", "source", "n_chars")))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["body"], part["any_text"], pa.array([x.tobytes() for x in c], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["doc_id", "body", "any_text", "c", "m"])

    if not wanted:
        return {}
    asked = F.broadcast(docs.sparkSession.createDataFrame(wanted, "id long, of long"))  # as many rows as the sample or a round has
    rows = _rows(docs).where("doc_id is not null").withColumn("body", F.xxhash64("text"))
    rows = rows.join(asked, (F.col("doc_id") == F.col("id")) & (F.col("of").isNull() | (F.col("of") == F.col("body")))).withColumn("any_text", F.col("of").isNull()).drop("id", "of")
    least = F.min(F.struct("body", "c", "m")).alias("x")
    got = rows.mapInArrow(run, "doc_id long, body long, any_text boolean, c binary, m binary").groupBy("doc_id", F.when(~F.col("any_text"), F.col("body")).alias("of")).agg(least).select("doc_id", "of", "x.c", "x.m").collect()
    return {(r.doc_id, r["of"]): (np.frombuffer(r.c, np.float32), np.frombuffer(r.m, np.float32)) for r in got}


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, rounds: int = ROUNDS, each: int = EACH_ROUND, sure: float = SURE) -> Model:
    """Co-training on a bounded sample of labelled rows, those with the least hashes of doc_id, and on all others as unlabelled.

    ``labels(doc_id, quality)``: rows with a quality of 0 or 1 count; where a doc_id
    has several, the least; of several texts under one doc_id the label is of the one with the least hash, and
    a pseudo-label of the one that was scored, one for each doc_id.  In each round both views score every row outside the sample,
    and each passes the ``each`` rows per label that it is surest of (at ``sure`` or more) to
    the other.  Only the vectors of the sample and of these rows reach the driver.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    given = {r.doc_id: r.quality for r in known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    vectors = {i: v for (i, _), v in _vectors(docs, [(i, None) for i in given]).items()}
    order = sorted(vectors, key=lambda i: (zlib.crc32(str(i).encode()), i))
    stack = lambda k, width: np.stack([vectors[i][k] for i in order]) if order else np.zeros((0, width), np.float32)
    model = Model(stack(0, 136 + HASHED), stack(1, 2 * META + 16), np.array([given[i] for i in order], float))
    for _ in range(rounds if model.constant is None else 0):
        surest = _surest(docs, model, set(given).union(*model.taught), each, sure)
        more = _vectors(docs, sorted({(r.doc_id, r.body) for r in surest}))
        if not model.teach([(r.doc_id, r.view, r.label, *more[r.doc_id, r.body]) for r in surest]):
            break
    return model


def score(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """Scores for every row of ``docs(doc_id, text, lang, source, n_chars)``.

    Returns ``doc_id, p_content, p_meta, quality, kept`` (quality at ``least`` or
    more).  Null and empty texts have no content to speak for them: quality 0, not
    kept.  Null lang and source are values of their own; repeated rows and null ids stay; an
    empty table gives an empty result, and without labels of both kinds every row gets one score.
    Whole texts of any length are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_batches(batch, "text"):
                c, m, q = shared.value.score(content_features(texts), meta_features(*(part[k].to_pylist() for k in ("lang", "source", "n_chars"))))
                q = np.where([bool(t.strip()) for t in texts], q, 0.0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(c), pa.array(m), pa.array(q), pa.array(q >= least)], names=["doc_id", "p_content", "p_meta", "quality", "kept"])

    return _rows(docs).mapInArrow(run, "doc_id long, p_content double, p_meta double, quality double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """Fit on the labelled rows and score all documents; see ``fit`` and ``score``."""
    return score(docs, fit(docs, labels, **options), least=least)
