"""Scoring texts by a log-bilinear neural language model.

The model predicts the next token from the two before it, in two steps.  A
context's vector is the sum of one for the class of each of the two tokens and
of the previous token's own; its product with a class's vector, plus a bias, is
that class's score.  Inside a class the previous token's class has another
vector, and its product with a token's vector, plus a bias, is that token's
score.  The SINGLE most frequent tokens are classes of their own; all others
share SURFACES classes by their first and last letters, so that unseen tokens
have a class as well.  The next VOCABULARY tokens that are counted OWN times or
more have vectors of their own as context and as target; the rest of a class is
one target, in which a token's probability comes from its count over the whole
corpus, with half a count added to each known token and for all unknown ones.
Both steps are normalised by batched matrix products, so the probabilities of
all tokens, known or not, add up to one.

All training texts are counted: classes in threes, own tokens with the class
that follows, classes with the token that follows.  These counts are sums of
whole numbers, the same however the texts are dealt out, and their number is
bounded by the model's size.  The vectors are trained on them in numpy by
noise-contrastive estimation with NOISE noise tokens to each true one, taken in
expectation, since every outcome of a count's context is at hand.

Token counts are distributed: the HOT most frequent ones are broadcast, the rest
is joined by key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.runtime import Scratch, Shield, lowered_words, ship

#: Stands for the end of a text; no word holds it.
END = b"\n"
#: Frequent tokens with a class of their own, END among them.
SINGLE = 127
PREFIXES, SUFFIXES = 16, 4
SURFACES = PREFIXES * SUFFIXES
CLASSES = SINGLE + SURFACES
#: Context class before the first token.
START = CLASSES
CONTEXTS = CLASSES + 1
SIZE = 24
#: Tokens with vectors of their own besides the single ones, and the count that they need.
VOCABULARY, OWN = 20_000, 100
#: Frequent tokens whose counts every worker holds, and their length at most.
HOT, HOT_BYTES = 200_000, 64
NOISE = 48.0
#: Passes over the counts; step size; pull of own vectors towards zero, in tokens.
PASSES, RATE, PULL = 40, 0.1, 3.0
#: Context classes trained in one step.
STEP = 8
#: Tokens handled at once by a worker; distinct tokens counted before they are passed on.
AT_ONCE, COUNTED = 150_000, 200_000
#: Contexts normalised at once.
BATCH = 2_048


def surface(token: bytes) -> int:
    """Class of a token that has none of its own."""
    end = token[-1:]
    kind = 0 if end.isalpha() or end >= b"\x80" else 1 if end in (b".", b",") else 2 if end.isdigit() else 3
    return SINGLE + PREFIXES * kind + zlib.crc32(token[:2]) % PREFIXES


@dataclass(frozen=True, eq=False)
class Counts:
    """Corpus counts: totals, the frequent tokens, and each class's mass."""

    n: int
    types: int
    hot: dict[bytes, int]
    #: Least count of the frequent tokens.
    least: int
    mass: np.ndarray

    @property
    def own(self) -> int:
        """Tokens with vectors besides the single ones."""
        return min(VOCABULARY, max(0, sum(c >= OWN for c in self.hot.values()) - SINGLE))

    def base_log10(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.types + 1)))


class Index(dict):
    """Token to place in the frequent list, or -1 less its class; remembers a bounded number of others."""

    def __init__(self, hot: dict[bytes, int], mass: np.ndarray, own: int):
        super().__init__((t, i) for i, t in enumerate(hot))
        c = np.fromiter(hot.values(), np.float64, len(hot))
        self.log10 = np.log10(c + 0.5)
        self.classes = np.fromiter((i if i < SINGLE else surface(t) for i, t in enumerate(hot)), np.int64, len(hot))
        self.room = len(hot) + 100_000
        #: Tokens with vectors besides the single ones: places SINGLE and on.
        self.own = own
        #: Targets inside classes: the own tokens, then the rest of each class.
        self.leaves = self.own + SURFACES
        self.class_of = np.concatenate([self.classes[SINGLE : SINGLE + self.own], SINGLE + np.arange(SURFACES)])
        kept = c[SINGLE : SINGLE + self.own] + 0.5
        rest = np.maximum(mass[SINGLE:] - np.bincount(self.class_of[: self.own] - SINGLE, kept, SURFACES), 0.5)
        self.mass = np.concatenate([kept, rest])

    def __missing__(self, token: bytes) -> int:
        found = -1 - surface(token)
        if len(self) < self.room and len(token) <= HOT_BYTES:
            self[token] = found
        return found

    def look(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, classes, and targets inside the class (of single tokens: 0, which is not to be used)."""
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        classes = np.where(at >= 0, self.classes.take(np.maximum(at, 0), mode="clip") if len(self.classes) else 0, -1 - at)
        own = (at >= SINGLE) & (at < SINGLE + self.own)
        return at, classes, np.where(own, at - SINGLE, np.maximum(self.own + classes - SINGLE, 0))


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """Texts as bytes, a few rows at a time, so that a batch isn't held twice."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).cast(pa.binary()).to_pylist()


def portions(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Tokens of runs of texts, and how many each text has, END included."""
    tokens: list[bytes] = []
    lengths: list[int] = []
    for t in texts:
        w = lowered_words(t)
        tokens += w
        tokens.append(END)
        lengths.append(len(w) + 1)
        if len(tokens) >= AT_ONCE:
            yield tokens, np.array(lengths)
            tokens, lengths = [], []
    if lengths:
        yield tokens, np.array(lengths)


def before(x: np.ndarray, lengths: np.ndarray, places: int, none: int) -> np.ndarray:
    """What stands one or two places before each token of the same text."""
    out = np.empty_like(x)
    out[places:] = x[:-places]
    first = np.cumsum(lengths) - lengths
    out[first] = none
    if places == 2:
        second = first + 1
        out[second[second < len(out)]] = none
    return out


class Statistics:
    """Counts that the vectors are trained on, as one flat array; ``one`` and ``two`` are the classes one and two places before."""

    def __init__(self, index: Index, flat: np.ndarray | None = None):
        sizes = CONTEXTS * CONTEXTS * CLASSES, index.own * CLASSES, CONTEXTS * index.leaves
        self.flat = np.zeros(sum(sizes), np.int32) if flat is None else flat
        a, b, c = np.split(self.flat, np.cumsum(sizes)[:-1])
        #: Class after two classes; class after an own token; target inside its class after a class.
        self.thrice, self.after, self.inner = a.reshape(CONTEXTS, CONTEXTS, CLASSES), b.reshape(-1, CLASSES), c.reshape(CONTEXTS, -1)

    def add(self, classes: np.ndarray, leaf: np.ndarray, lengths: np.ndarray, index: Index) -> None:
        one, two = before(classes, lengths, 1, START), before(classes, lengths, 2, START)
        np.add.at(self.thrice.reshape(-1), (two * CONTEXTS + one) * CLASSES + classes, 1)
        inside = np.flatnonzero(classes >= SINGLE)
        np.add.at(self.inner.reshape(-1), one[inside] * index.leaves + leaf[inside], 1)
        if index.own:
            own = before(np.where((classes >= SINGLE) & (leaf < index.own), leaf, -1), lengths, 1, -1)
            has = np.flatnonzero(own >= 0)
            np.add.at(self.after.reshape(-1), own[has] * CLASSES + classes[has], 1)


def _pull_of(n: np.ndarray, score: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gradient by score of the expected noise-contrastive objective; ``n`` are counts, ``noise`` the noise tokens to each true one."""
    total = n.sum(axis=-1, keepdims=True)
    with np.errstate(over="ignore"):
        return n - (n + total * noise) / (1 + np.exp(np.log(noise) - score))


class Steps:
    """Steps of a size that falls with the squares of the gradients met."""

    def __init__(self, x: np.ndarray):
        self.x, self.sums = x, np.full(x.shape, 1e-20, np.float32)

    def up(self, g: np.ndarray, at=slice(None)) -> None:
        self.sums[at] += g * g
        self.x[at] += RATE * g / np.sqrt(self.sums[at])


class Vectors:
    """Parameters: vectors of context classes by place, of own tokens as context, of classes with biases; and inside classes of context classes and of targets with biases."""

    def __init__(self, index: Index, mass: np.ndarray):
        rng = np.random.default_rng(7)
        made = lambda n: rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.one, self.two, self.out = made(CONTEXTS), made(CONTEXTS), made(CLASSES)
        self.bias = np.log(mass / mass.sum()).astype(np.float32)
        self.own = np.zeros((index.own + 1, SIZE), np.float32)
        self.near, self.leaf = made(CONTEXTS), made(index.leaves)
        self.leaf_bias = np.log(index.mass / mass[index.class_of]).astype(np.float32)

    def train(self, counted: Statistics, index: Index) -> None:
        n = max(1.0, float(counted.thrice.sum(dtype=np.float64)))
        self._train_classes(counted.thrice, n)
        self._train_own(counted, index)
        self._train_inner(counted.inner, index, n)

    def _train_classes(self, thrice: np.ndarray, n: float) -> None:
        noise = NOISE * np.exp(self.bias)
        steps = [Steps(x) for x in (self.one, self.two, self.out, self.bias)]
        rng = np.random.default_rng(11)
        # What was never met pulls at nothing.
        met = thrice.any(axis=2)
        two, ones = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
        for _ in range(PASSES):
            order = rng.permutation(ones)
            for i in range(0, len(order), STEP):
                one = order[i : i + STEP]
                r = (self.two[two, None] + self.one[one]).reshape(-1, SIZE)
                g = _pull_of((thrice[np.ix_(two, one)].reshape(-1, CLASSES) / n).astype(np.float32), r @ self.out.T + self.bias, noise)
                gr = (g @ self.out).reshape(len(two), len(one), SIZE)
                steps[2].up(g.T @ r)
                steps[3].up(g.sum(axis=0))
                steps[0].up(gr.sum(axis=0), one)
                steps[1].up(gr.sum(axis=1), two)

    def _train_own(self, counted: Statistics, index: Index) -> None:
        """Own tokens as context: what they add to their class's vector, with what stands two places before as after that class on average."""
        share = counted.thrice.sum(axis=2, dtype=np.float64)
        mean = (share / np.maximum(share.sum(axis=0), 1)).T.astype(np.float32) @ self.two
        noise = NOISE * np.exp(self.bias)
        for i in range(0, index.own, BATCH):
            j = slice(i, min(i + BATCH, index.own))
            c = index.class_of[j]
            fixed, n = self.one[c] + mean[c], counted.after[j].astype(np.float32)
            step = Steps(self.own[j])
            for _ in range(PASSES):
                g = _pull_of(n, (fixed + step.x) @ self.out.T + self.bias, noise)
                step.up(g @ self.out - PULL * step.x)

    def _train_inner(self, inner: np.ndarray, index: Index, n: float) -> None:
        met = np.flatnonzero(inner.any(axis=1))
        near = Steps(self.near[met])
        groups = []
        for c in range(SINGLE, CLASSES):
            at = np.flatnonzero(index.class_of == c)
            x, bias = Steps(self.leaf[at]), Steps(self.leaf_bias[at])
            groups.append((at, (inner[np.ix_(met, at)] / n).astype(np.float32), NOISE * np.exp(bias.x), x, bias))
        for _ in range(PASSES):
            for _, seen, noise, x, bias in groups:
                g = _pull_of(seen, near.x @ x.x.T + bias.x, noise)
                gn = g @ x.x
                x.up(g.T @ near.x - PULL / n * x.x)
                bias.up(g.sum(axis=0))
                near.up(gn)
        self.near[met] = near.x
        for at, _, _, x, bias in groups:
            self.leaf[at], self.leaf_bias[at] = x.x, bias.x

    def inner_log10(self, index: Index) -> np.ndarray:
        """log10 P(target | class, class before) by class before and target."""
        s = (self.near @ self.leaf.T + self.leaf_bias).astype(np.float32)
        for c in range(SINGLE, CLASSES):
            at = np.flatnonzero(index.class_of == c)
            x = s[:, at]
            x -= x.max(axis=1, keepdims=True)
            s[:, at] = (x - np.log(np.exp(x).sum(axis=1, keepdims=True))) / np.float32(np.log(10))
        return s

    def log10_of(self, one: np.ndarray, two: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(class | context); ``own`` is the number of the token before, the last one for those without.  A context that recurs is normalised once."""
        # A token's own number tells its class, so that it can stand for it.
        before_ = np.where(own < len(self.own) - 1, CONTEXTS + own, one)
        seen, where = np.unique(before_ * CONTEXTS + two, return_inverse=True)
        first = np.empty(len(seen), np.int64)
        first[where] = np.arange(len(where))
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(0, len(seen) + BATCH, BATCH))
        out = np.empty(len(target))
        for k in range(len(ends) - 1):
            at = first[k * BATCH : (k + 1) * BATCH]
            s = (self.one[one[at]] + self.two[two[at]] + self.own[own[at]]) @ self.out.T
            s += self.bias
            s -= s.max(axis=1, keepdims=True)
            norm = np.log(np.exp(s).sum(axis=1))
            mine = order[ends[k] : ends[k + 1]]
            row = where[mine] - k * BATCH
            out[mine] = s[row, target[mine]] - norm[row]
        return out / np.log(10)


def placed(tokens: list[bytes], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's place, class and target inside the class, and its own number as context."""
    at, classes, leaf = index.look(tokens)
    return at, classes, leaf, np.where((classes >= SINGLE) & (leaf < index.own), leaf, index.own)


def log10_tokens(vectors: Vectors, inner: np.ndarray, classes: np.ndarray, leaf: np.ndarray, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of each token's class and target, given the two tokens before."""
    one, two = before(classes, lengths, 1, START), before(classes, lengths, 2, START)
    out = vectors.log10_of(one, two, before(own, lengths, 1, len(vectors.own) - 1), classes)
    return out + np.where(classes >= SINGLE, inner[one, leaf], 0.0)


def _counted(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()
    for b in batches:
        for tokens, _ in portions(texts_of(b.column(text))):
            found.update(tokens)
            if len(found) >= COUNTED:
                yield _rows(found)
                found = Counter()
    if found:
        yield _rows(found)


def _rows(found: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "c"])


def _masses(batches: Iterator[pa.RecordBatch], single: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    mass = np.zeros(CLASSES)
    for b in batches:
        for t, c in zip(b.column("token").to_pylist(), b.column("c").to_pylist(), strict=True):
            if t not in single:
                mass[surface(t)] += c + 0.5
    yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int64()), pa.array(mass)], names=["class", "mass"])


def count_tokens(train: DataFrame, own: Scratch, text: str = "text") -> tuple[DataFrame, Counts]:
    """Counts of all tokens as a table (token, c), and what every worker holds of them."""
    counts = train.select(text).mapInArrow(lambda it: _counted(it, text), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counts = own.keep(counts, "counts")
    short = F.octet_length("token") <= HOT_BYTES
    # Tokens by the logarithm of their count: the least count with HOT tokens at most.
    octave = F.floor(F.log2("c") * 8)
    steps = counts.groupBy(octave.alias("at"), short.alias("short")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("n"), F.min("c").alias("least")).collect()
    least, room = 2**62, HOT
    for s in sorted((s for s in steps if s["short"]), key=lambda s: -s["at"]):
        room -= s["types"]
        if room < 0:
            break
        least = s["least"]
    rows = counts.where((F.col("c") >= least) & short).toArrow()
    found = zip(rows.column("token").to_pylist(), rows.column("c").to_pylist(), strict=True)
    hot = dict(sorted(found, key=lambda x: (-x[1], x[0])))
    single = [*hot][:SINGLE]
    got = counts.mapInArrow(lambda it, s=frozenset(single): _masses(it, s), "class long, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect()
    mass = np.full(CLASSES, 0.5)
    for r in got:
        mass[r["class"]] += r["mass"]
    for i, t in enumerate(single):
        mass[i] = hot[t] + 0.5
    return counts, Counts(sum(s["n"] for s in steps), sum(s["types"] for s in steps), hot, least, mass)


def gather(train: DataFrame, held: Held, text: str = "text") -> Statistics:
    """The counts of all training texts, at most as many numbers as :class:`Statistics` has."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.index()
        mine = Statistics(index)
        for b in batches:
            for tokens, lengths in portions(texts_of(b.column(0))):
                _, classes, leaf, _ = placed(tokens, index)
                mine.add(classes, leaf, lengths, index)
        at = np.flatnonzero(mine.flat)
        for i in range(0, len(at), 100_000):
            j = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(mine.flat[j].astype(np.int64))], names=["at", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("at").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if got:
            at, n = (np.concatenate(x) for x in zip(*got, strict=True))
            by = np.argsort(at)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (np.diff(at[by], prepend=0).astype(np.int32), n[by])], names=["at", "n"])

    rows = train.select(text).mapInArrow(seen, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).mapInArrow(packed, "at binary, n binary")
    index = held.index()
    out = Statistics(index, np.zeros_like(Statistics(index).flat, np.float32))
    for r in rows.toLocalIterator():
        out.flat[np.cumsum(np.frombuffer(zlib.decompress(r["at"]), np.int32))] = np.frombuffer(zlib.decompress(r["n"]), np.int64)
    return out


class Held:
    """The frequent tokens and the parameters on each worker, from broadcasts; built once per worker process."""

    def __init__(self, spark, counts: Counts):
        # Tokens hold no space, so one string and one array carry them all.
        self.hot = spark.sparkContext.broadcast((b" ".join(counts.hot), np.fromiter(counts.hot.values(), np.int64, len(counts.hot)), counts.mass, counts.own))
        #: The broadcast parameters, once they are fitted.
        self.fitted = None
        self.name = (spark.sparkContext.applicationId, self.hot._jbroadcast.id())

    def __getstate__(self):
        return {"hot": self.hot, "fitted": self.fitted, "name": self.name}

    def index(self) -> Index:
        tokens, n, mass, own = self.hot.value
        return _built(self.name, "index", lambda: Index(dict(zip(tokens.split(b" "), n.tolist(), strict=False)), mass, own))

    def vectors(self) -> tuple[Vectors, np.ndarray]:
        """The parameters, and the table of targets inside classes."""
        return _built(self.name, "vectors", lambda: (self.fitted.value, self.fitted.value.inner_log10(self.index())))


_BUILT: dict[str, tuple] = {}


def _built(name, what, make):
    if _BUILT.get(what, (None,))[0] != name:
        _BUILT[what] = (name, make())
    return _BUILT[what][1]


def fit(train: DataFrame, counts: Counts, held: Held, text: str = "text") -> Vectors:
    """Parameters fitted to all training texts."""
    v = Vectors(held.index(), counts.mass)
    v.train(gather(train, held, text), held.index())
    return v


def _scored(batches: Iterator[pa.RecordBatch], text: str, held: Held) -> Iterator[pa.RecordBatch]:
    index, (vectors, inner) = held.index(), held.vectors()
    log_mass = np.log10(np.concatenate([index.mass, [1.0]]))
    ids = count(TaskContext.get().partitionId() << 33)
    for b in batches:
        done = 0
        for tokens, lengths in portions(texts_of(b.column(text))):
            rows = b.slice(done, len(lengths))
            done += len(lengths)
            at, classes, leaf, own = placed(tokens, index)
            first = np.cumsum(lengths) - lengths
            known = at >= 0
            hot = np.where(known, index.log10.take(np.maximum(at, 0), mode="clip") if len(index.log10) else 0.0, 0.0)
            # Counts come in by the places and the join: all of a single token's and of an own one's, a rarer one's share of its target.
            whole = np.where(classes < SINGLE, hot, log_mass[np.where(classes < SINGLE, -1, leaf)])
            lm = log10_tokens(vectors, inner, classes, leaf, own, lengths) - whole
            rare: list[bytes] = []
            tf: list[int] = []
            ends = [0]
            where = np.flatnonzero(~known)
            for i, j in zip(*(np.searchsorted(where, x) for x in (first, first + lengths)), strict=True):
                c = Counter([tokens[k] for k in where[i:j]])
                rare += c
                tf += c.values()
                ends.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(tf, pa.int64())], ["token", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), hot, lm.astype(np.float64))]
            new = [pa.array([next(ids) for _ in lengths], pa.int64()), pa.array(lengths.astype(np.int64)), *map(pa.array, sums), lists]
            keep = [(c, x) for c, x in zip(rows.schema.names, rows.columns, strict=True) if c != text]
            yield pa.RecordBatch.from_arrays([*(x for _, x in keep), *new], names=[*(c for c, _ in keep), "_rid", "_n", "_known", "_hot", "_lm", "_rare"])


def score_texts(docs: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10; replaced if there).

    ``train`` has the texts to learn from.  A null or empty text is its end
    alone; nothing to learn from gives even chances to the classes; repeated
    rows are each scored, and each learned from; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    own = Scratch(spark, "lm")
    train = train.select(F.col(text).alias("_text"))
    table, counts = count_tokens(train, own, "_text")
    held = Held(spark, counts)
    held.fitted = spark.sparkContext.broadcast(fit(train, counts, held, "_text"))
    shield = Shield(docs)
    docs, outer, text = shield.inner, text, shield(text)
    pairs = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("tf", T.LongType())]))
    new = [("_rid", T.LongType()), ("_n", T.LongType()), ("_known", T.LongType()), ("_hot", T.DoubleType()), ("_lm", T.DoubleType()), ("_rare", pairs)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), *(T.StructField(*x) for x in new)])
    local = own.keep(docs.mapInArrow(lambda it: _scored(it, text, held), schema), "local")
    rare = local.select("_rid", F.explode("_rare").alias("r")).select("_rid", F.col("r.token").alias("token"), F.col("r.tf").alias("tf"))
    rare = rare.join(table.where((F.col("c") < counts.least) | (F.octet_length("token") > HOT_BYTES)), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = rare.groupBy("_rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("_s"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_k"))
    out = local.drop("_rare").join(rest, "_rid", "left")
    counted = F.col("_hot") + F.coalesce("_s", F.lit(0.0))
    out = out.withColumn("n_tokens", F.col("_n")).withColumn("n_known", F.col("_known") + F.coalesce("_k", F.lit(0)))
    out = out.withColumn("train_tokens", F.lit(counts.n).cast("long")).withColumn("base_score", counted - F.col("_n") * counts.base_log10())
    out = out.withColumn("score", counted + F.col("_lm"))
    return shield.restore(out, "n_tokens", "n_known", "train_tokens", "base_score", "score", without=outer)
