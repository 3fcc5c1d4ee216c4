"""Document quality by co-training.

Two views of a document are learned apart: its text (shapes of words, repetition,
lengths) and its page metadata (source, language, stated length).  Over ROUNDS
rounds each view's classifier goes over all documents without a label and gives
those it is most sure of to the other view to learn from.  Each view is calibrated
on labelled documents held back from both, and the calibrated log odds are added
up, less the prior that both contain, to score every document.

Features are made once and written.  Only labelled documents are sampled: about
LABELLED, drawn by a hash of the id, of which the driver sees feature vectors,
as it does of the GIVEN documents that a view gives in a round.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.runtime import Scratch, Shield, ship

#: Labelled documents that are expected to be drawn; twice as many at most, however often an id recurs.
LABELLED = 8_000
ROUNDS = 5
#: Pseudo-labels that a view gives in a round, and how sure it has to be.
GIVEN, SURE = 400, 0.95
#: Labelled ids that are broadcast; with more, the join is left to Spark.
BROADCAST_IDS = 500_000
#: One labelled document in so many is held back for calibration.
HELD_BACK = 4
RIDGE = 1.0
SHAPES = 192
TEXT_SIZE = SHAPES + 6
SOURCES, LANGS, LENGTHS = 64, 16, 16
META_SIZE = SOURCES + LANGS + LENGTHS

_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{Ll}\p{Lo}\p{M}]+"), regex.compile(r"\p{N}+")


class Shapes(dict):
    """Bucket of a word's shape: runs of capitals, letters and digits as one sign each, runs of a sign as one."""

    def __missing__(self, word: bytes) -> int:
        s = word.decode("utf-8", "replace")
        s = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", s)))
        s = "".join(c for c, before in zip(s, " " + s, strict=False) if c != before)
        found = zlib.crc32(s.encode()) % SHAPES
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_SHAPES = Shapes()


def text_features(text: bytes | None) -> np.ndarray:
    out = np.zeros(TEXT_SIZE, np.float32)
    words = text.split() if text else []
    n = len(words)
    if n:
        at = np.fromiter(map(_SHAPES.__getitem__, words), np.int64, n)
        out[:SHAPES] = np.sqrt(np.bincount(at, minlength=SHAPES) / n)
        kinds = len(set(words))
        out[SHAPES:] = (np.log1p(n) / 5, kinds / n, np.log(kinds) / max(np.log(n), 1), sum(map(eq, words, words[1:])) / n, min(len(text) / n / 10, 5), 1)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_SIZE, np.float32)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[SOURCES + LANGS + min(LENGTHS - 1, max(int(n_chars or 0), 0).bit_length())] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    """Weights and calibration (slope, offset) of each view; the prior's log odds."""

    views: list[np.ndarray]
    calibration: list[np.ndarray]
    prior: float

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        s = -self.prior * np.ones(len(features[0]))
        for x, w, c in zip(features, self.views, self.calibration, strict=True):
            s += c[0] * log_odds(x, w) + c[1]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


#: Of a view's number, label and share of pseudo-labels: the unlabelled documents that view is most sure of.
Draw = Callable[[list[np.ndarray], list[set[int]], dict[float, int]], list[tuple[int, float, int, list[np.ndarray]]]]


def co_train(views: list[np.ndarray], y: np.ndarray, draw: Draw) -> Model:
    """``views`` are the labelled rows' features, an array for each view.

    ``draw`` gets the weights of both views, the documents that each has been
    given already and how many to give of each label, and returns the number of
    the view that gives, label, document and both views' features.
    """
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if len(y) < 2 * HELD_BACK or len(set(y)) < 2:
        flat = [np.zeros(v.shape[1] + 1) for v in views]
        return Model(flat, [np.array([0.0, prior]) for _ in views], prior)
    back = np.arange(len(y)) % HELD_BACK == 0
    fit_x, fit_y = [[v[~back]] for v in views], [[y[~back]] for _ in views]
    given: list[set[int]] = [set(), set()]
    share = {1.0: int(round(GIVEN * y.mean())), 0.0: int(round(GIVEN * (1 - y.mean())))}
    for _ in range(ROUNDS):
        ws = [logistic(np.concatenate(a), np.concatenate(b)) for a, b in zip(fit_x, fit_y, strict=True)]
        for me, label, document, features in draw(ws, given, share):
            other = 1 - me
            if document not in given[other]:
                given[other].add(document)
                fit_x[other].append(features[other][None, :])
                fit_y[other].append(np.array([label]))
    ws = [logistic(np.concatenate(a), np.concatenate(b)) for a, b in zip(fit_x, fit_y, strict=True)]
    calibration = [logistic(log_odds(v[back], w)[:, None], y[back], ridge=1e-3) for v, w in zip(views, ws, strict=True)]
    return Model(ws, calibration, prior)


def _features(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    text, source, lang, n = names
    t = [text_features(x) for x in b.column(text).cast(pa.binary()).to_pylist()]
    m = [meta_features(*x) for x in zip(*(b.column(c).to_pylist() for c in (source, lang, n)), strict=True)]
    return [np.array(t, np.float32).reshape(-1, TEXT_SIZE), np.array(m, np.float32).reshape(-1, META_SIZE)]


#: The features of a view in a row of a table, by column.
VIEWS = {"_text": (TEXT_SIZE, np.float16), "_meta": (META_SIZE, np.uint8)}


def _stored(features: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()) for v, (_, kind) in zip(features, VIEWS.values(), strict=True)]


def _loaded(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(-1, size).astype(np.float32) for c, (size, kind) in VIEWS.items()]


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """A written table of each document's ``id`` (as text), ``_h`` (a hash of id and text) and features, about 500 bytes a row."""
    ship(docs.sparkSession)
    names = ["text", "source", "lang", "n_chars"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("_h"), *_stored(_features(b, names))], names=["id", "_h", *VIEWS])

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("_h"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(n_chars).alias("n_chars"))
    kind = rows.schema["id"].dataType.simpleString()
    return Scratch(docs.sparkSession, "quality").keep(rows.mapInArrow(made, f"id {kind}, _h long, _text binary, _meta binary"), "features")


def fit_described(described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Co-trained model.  Documents with several labels take their mean, rounded, a half to 0; null ids and labels don't count.

    Documents without any label are the pool that the views draw from, all of
    them; documents alike in id and text count as one there, and ties go by
    their hash.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) > 0.5).cast("double").alias("_y"))
    known = Scratch(described.sparkSession, "quality").keep(known, "known")
    n = known.count()
    key = F.shiftrightunsigned(F.xxhash64("id"), 1) / float(2**63)
    drawn = described.join(F.broadcast(known.where(key < LABELLED / max(n, 1))), "id")  # LABELLED rows, about
    got = drawn.select("_h", "_y", *VIEWS).orderBy("_h", *VIEWS).limit(2 * LABELLED).toArrow().combine_chunks()
    # Held-back documents are dealt by the order, which tells nothing of them.
    labelled, y = [x for b in got.to_batches() for x in (_loaded(b),)], np.array(got.column("_y").to_pylist(), float)
    views = [np.concatenate([x[i] for x in labelled]) if labelled else np.zeros((0, size), np.float32) for i, (size, _) in enumerate(VIEWS.values())]
    pool = described.join(F.broadcast(known) if n <= BROADCAST_IDS else known, "id", "left_anti").select("_h", *VIEWS)

    def draw(ws: list[np.ndarray], given: list[set[int]], share: dict[float, int]) -> list[tuple[int, float, int, list[np.ndarray]]]:
        def surest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each view and label the first of this partition: view, label, how sure, and the row."""
            best: dict[tuple[int, float], dict[int, tuple]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                h, features = b.column("_h").to_numpy(), _loaded(b)
                for me in (0, 1):
                    p = 1 / (1 + np.exp(-log_odds(features[me], ws[me])))
                    for label_, sure in ((1.0, p), (0.0, 1 - p)):
                        mine = best.setdefault((me, label_), {})
                        for i in np.flatnonzero(sure >= SURE):
                            if int(h[i]) not in given[1 - me]:
                                mine[int(h[i])] = (float(sure[i]), b.column("_text")[i].as_py(), b.column("_meta")[i].as_py())
                        if len(mine) > 4 * GIVEN:
                            best[me, label_] = _first(mine, share[label_])
            rows = [(me, label_, x[0], h, x[1], x[2]) for (me, label_), mine in best.items() for h, x in _first(mine, share[label_]).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _DRAWN.types, strict=True)], schema=_DRAWN)

        rows = pool.mapInArrow(surest, "me int, label double, sure double, _h long, _text binary, _meta binary").dropDuplicates(["me", "label", "_h"])
        order = F.row_number().over(Window.partitionBy("me", "label").orderBy(F.col("sure").desc(), "_h"))
        limit = F.when(F.col("label") == 1, share[1.0]).otherwise(share[0.0])
        got = rows.withColumn("nth", order).where((F.col("nth") <= GIVEN) & (F.col("nth") <= limit)).orderBy("me", F.col("label").desc(), "nth").toArrow()
        return [(r["me"], r["label"], r["_h"], [np.frombuffer(r[c], kind).astype(np.float32) for c, (_, kind) in VIEWS.items()]) for r in got.to_pylist()]

    return co_train(views, y, draw)


_DRAWN = pa.schema([("me", pa.int32()), ("label", pa.float64()), ("sure", pa.float64()), ("_h", pa.int64()), ("_text", pa.binary()), ("_meta", pa.binary())])


def _first(mine: dict[int, tuple], n: int) -> dict[int, tuple]:
    return dict(sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))[:n])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", label: str = "quality") -> Model:
    """As :func:`fit_described`, of documents."""
    return fit_described(describe(docs, doc_id, text, source, lang, n_chars), labels, doc_id, label)


def score_described(described: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``id`` and score of each row of a table made by :func:`describe`; see :func:`score_quality`."""

    @F.arrow_udf("double")
    def scored(t: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array(model.score(_loaded(pa.RecordBatch.from_arrays([t, m], names=[*VIEWS]))))

    return described.select("id", scored(*VIEWS).alias(into))


def score_quality(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", into: str = "score") -> DataFrame:
    """``docs`` with the combined score (0 to 1) of each document in column ``into`` (replaced if there).

    Null and empty texts are scored by a text without words, null metadata as
    empty; repeated rows are alike; an empty table stays empty.
    """
    ship(docs.sparkSession)
    names = [text, source, lang, n_chars]

    @F.arrow_udf("double")
    def scored(t: pa.Array, s: pa.Array, la: pa.Array, n: pa.Array) -> pa.Array:
        b = pa.RecordBatch.from_arrays([t, s, la, n], names=names)
        # As stored and loaded, so that both ways agree.
        return pa.array(model.score([x.astype(kind).astype(np.float32) for x, (_, kind) in zip(_features(b, names), VIEWS.values(), strict=True)]))

    own = Shield(docs)
    return own.restore(own.inner.withColumn(into, scored(*[F.col(own(c)) for c in names])), into)
