"""Language identification by cross-parsing entropy.

A suffix automaton over labelled text of each language yields longest matches:
a text is parsed into phrases, each the longest run of symbols found somewhere
in the language's text.  The language whose text parses it into the fewest
phrases, normalised by the log of that text's length, wins.

Symbols are lower-cased letters; every run of other characters is one separator.
Many texts are parsed in step: a text is cut into blocks of BLOCK symbols, a
block is a lane, and one table look-up per symbol moves all lanes of a language.
A block goes on where the one before it ends, so that a text's phrases are those
of one parse.  Parses that begin apart soon meet, so a block is parsed at first
from the state that the LEAD symbols before it lead to, then again from the
state that the block before ended in, wherever that differs.  Where they don't
meet within ROUNDS, as in texts that repeat themselves, the rest of the text is
parsed symbol by symbol.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.runtime import Shield, ship

#: Symbols of labelled text that a language's automaton is built from: the bound of the fitted sample.
SAMPLE_SYMBOLS = 30_000
#: Documents of a language that are looked at to fill that bound, about a quarter; the longest that isn't put off.
SAMPLE_DOCS, SAMPLE_DOC_CHARS = 64, 8_000
#: Languages whose table of counts is broadcast.
MOST_LANGUAGES = 10_000
#: Symbols of a block, symbols before it that its first state is guessed from, and how often blocks are parsed again.
BLOCK, LEAD, ROUNDS = 1_024, 64, 4
#: Characters parsed at once by a worker.
AT_ONCE = 1_000_000
#: Symbols: separator, a letter of no sample, and the samples' characters by frequency.
#: The first so many have columns in a language's table; transitions by the others are kept sparse.
ALPHABET = 64
SEPARATOR, OTHER = 0, 1
UNDETERMINED = "und"


def symbol_table(samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol by code point, and which symbols are letters."""
    seen = Counter()
    for text in samples.values():
        seen.update(c for c in text.lower() if unicodedata.category(c)[0] in "LM")
    n = len(seen) + 2
    table = np.full(0x110000, SEPARATOR, np.uint16 if n < 1 << 16 else np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = OTHER
    letter = np.zeros(n, bool)
    letter[OTHER] = True
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])), start=2):
        table[ord(c)], letter[i] = i, c.isalpha()
    return table, letter


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in a row, separators merged, and each text's number of them."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([0, *map(len, low)])
    codes = table[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SEPARATOR) | (codes[:-1] != SEPARATOR)
    keep[ends[:-1][ends[:-1] < len(codes)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[ends[1:]] - kept[ends[:-1]]


class Automaton:
    """Transitions of a text's suffix automaton, for :func:`phrases`.

    An entry is twice the next state's row start in ``table``, plus one where
    the state has no such transition, so that a new phrase starts at the symbol.
    ``keys`` are (row start, symbol) of the transitions by symbols without a
    column, ``entries`` theirs, ``restart`` the entries of new phrases.
    """

    def __init__(self, table: np.ndarray, rare: dict[tuple[int, int], int], restart: np.ndarray):
        self.table, self.restart = table, restart
        self.width = len(restart)
        keys = np.array([s * ALPHABET * self.width + c for s, c in rare], np.int64)
        by = np.argsort(keys)
        # One more that no symbol meets, so that there always is a next one.
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.entries = np.append(np.array([*rare.values()], np.int32)[by], np.int32(0))

    def step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries of symbols without a column; ``at`` are row starts."""
        key = at.astype(np.int64) * self.width + symbol
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.entries[i], self.restart[symbol])


def automaton(text: np.ndarray, width: int) -> Automaton:
    """The suffix automaton of a text whose symbols are below ``width``."""
    after: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for c in text.tolist():
        new = len(after)
        after.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    restart = np.ones(max(width, ALPHABET), np.int32)
    for c, s in after[0].items():
        restart[c] = 2 * s * ALPHABET + 1
    table = np.tile(restart[:ALPHABET], (len(after), 1))
    rare: dict[tuple[int, int], int] = {}
    for s, out in enumerate(after):
        for c, t in out.items():
            if c < ALPHABET:
                table[s, c] = 2 * t * ALPHABET
            else:
                rare[s, c] = 2 * t * ALPHABET
    return Automaton(table.ravel(), rare, restart)


def split_rare(lanes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
    """Lanes with OTHER for symbols without a column, and at each step the active lanes that have such symbols and which."""
    high = lanes >= ALPHABET
    steps: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(lanes)
    for i in np.flatnonzero(high.any(axis=1)):
        where = np.flatnonzero(high[i, : active[i]])
        if len(where):
            steps[i] = where, lanes[i, where].astype(np.int64)
    return np.where(high, lanes.dtype.type(OTHER), lanes), steps


def phrases(a: Automaton, lanes: np.ndarray, active: np.ndarray, rare: list[tuple[np.ndarray, np.ndarray] | None], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin after each lane's first symbol or with it, and the last entries; ``start`` are the entries before.

    ``lanes`` is (step, lane), ``active`` the number of lanes that go on at each step, ``rare`` as of :func:`split_rare`.
    """
    at = start.copy()
    count = np.zeros(lanes.shape[1], np.int32)
    for row, n, high in zip(lanes, active, rare, strict=True):
        x = at[:n]
        x >>= 1
        to = None if high is None else a.step(x[high[0]], high[1])
        x += row[:n]
        x[:] = a.table.take(x, mode="clip")
        if high is not None:
            x[high[0]] = to
        count[:n] += x & 1
    return count, at


def follow(a: Automaton, codes: np.ndarray, entry: int) -> int:
    """Phrases that begin in ``codes``, one symbol at a time."""
    table, at, count = memoryview(a.table), entry >> 1, 0
    for c in codes.tolist():
        entry = table[at + c] if c < ALPHABET else int(a.step(np.array([at]), np.array([c]))[0])
        count += entry & 1
        at = entry >> 1
    return count


class Lanes:
    """Blocks of texts side by side, the longest first."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[text] + nth * BLOCK
        size = np.minimum(BLOCK, starts[text] + lengths[text] - begin)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes, self.ends = codes, starts + lengths
        self.text, self.nth, self.begin, self.size = text[order], nth[order], begin[order], size[order]
        #: The lane of the block before, and which lanes have one.
        self.before, self.later = place[np.maximum(order - 1, 0)], np.flatnonzero(nth[order] > 0)
        steps = int(self.size[0]) if len(order) else 0
        self.active = np.searchsorted(-self.size, -np.arange(steps), side="left")
        padded = np.concatenate([codes, np.zeros(BLOCK, codes.dtype)])
        self.raw = padded[self.begin[None, :] + np.arange(steps)[:, None]] if steps else np.zeros((0, 0), codes.dtype)
        self.symbols, self.rare = split_rare(self.raw, self.active)
        # Blocks that another one follows are full.
        self.lead = _split(self.raw[BLOCK - LEAD :, self.before[self.later]], np.full(LEAD, len(self.later))) if len(self.later) else None

    def count(self, a: Automaton) -> np.ndarray:
        """Phrases of each lane, those that began in an earlier one not counted."""
        used = np.zeros(len(self.text), np.int32)
        if self.lead:
            used[self.later] = phrases(a, *self.lead, np.zeros(len(self.later), np.int32))[1]
        count, end = phrases(a, self.symbols, self.active, self.rare, used)
        count[self.nth == 0] += 1
        for _ in range(ROUNDS):
            redo = self.later[end[self.before[self.later]] >> 1 != used[self.later] >> 1]
            if not len(redo):
                return count
            used[redo] = end[self.before[redo]]
            active = np.searchsorted(redo, self.active)
            active = active[: int(self.size[redo[0]])]
            lanes = self.raw[: len(active), redo]
            count[redo], end[redo] = phrases(a, *_split(lanes, active), used[redo])
        redo = self.later[end[self.before[self.later]] >> 1 != used[self.later] >> 1]
        for text in np.unique(self.text[redo]):
            mine = redo[self.text[redo] == text]
            first = mine[self.nth[mine].argmin()]
            rest = np.flatnonzero((self.text == text) & (self.nth >= self.nth[first]))
            count[rest] = 0
            count[first] = follow(a, self.codes[self.begin[first] : self.ends[text]], int(end[self.before[first]]))
        return count


def _split(lanes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
    symbols_, rare = split_rare(lanes, active)
    return symbols_, active, rare


class Languages:
    """The fitted model: a table per language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        texts = dict(samples)
        self.table, self.letter = symbol_table(texts)
        fitted = {lang: symbols([t], self.table)[0] for lang, t in texts.items()}
        fitted = {lang: s for lang, s in fitted.items() if self.letter[s].any()}
        self.names = sorted(fitted)
        self.tables = [automaton(fitted[lang], len(self.letter)) for lang in self.names]
        self.bits = np.array([math.log2(len(fitted[lang]) + 1) for lang in self.names])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases by text and language, and which texts have letters."""
        codes, lengths = symbols(texts, self.table)
        lanes = Lanes(codes, lengths)
        out = np.zeros((len(texts), len(self.names)))
        for k, t in enumerate(self.tables):
            np.add.at(out[:, k], lanes.text, lanes.count(t))
        has_letter = np.zeros(len(texts), bool)
        if len(codes):
            where = np.repeat(np.arange(len(texts)), lengths)[self.letter[codes]]
            has_letter[where] = True
        return out * self.bits / np.maximum(lengths, 1)[:, None], has_letter

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: one minus the best entropy over the next (1 if only one language is known)."""
        h, has_letter = self.entropies([t or "" for t in texts])
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, score
        best = h.argmin(axis=1)
        score = np.ones(len(texts))
        if len(self.names) > 1:
            two = np.partition(h, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300)
        score[~has_letter] = 0.0
        return [self.names[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], score


@lru_cache(maxsize=1)
def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(samples)


def portions(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of AT_ONCE characters, or one longer text."""
    part: list[str | None] = []
    n = 0
    for t in texts:
        if part and n + len(t or "") > AT_ONCE:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def draw_samples(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """For each language, documents in the order of ``key``'s hash up to SAMPLE_SYMBOLS characters.

    Documents over SAMPLE_DOC_CHARS characters come after all shorter ones, so
    that they fill what those leave.  Documents are whole, but a language's
    text ends SAMPLE_DOC_CHARS characters beyond SAMPLE_SYMBOLS at the latest,
    which only cuts a long document.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    most = SAMPLE_SYMBOLS + SAMPLE_DOC_CHARS
    long_, size = (F.length(text) > SAMPLE_DOC_CHARS).alias("_long"), F.least(F.length(text), F.lit(most))
    rows = usable.select(F.col(lang).alias("_lang"), F.substring(F.col(text), 1, most).alias("_text"), size.alias("_size"), long_, F.shiftrightunsigned(F.xxhash64(key), 1).alias("_key"))
    # A threshold on the key leaves some times what is needed of each kind; then the first ones of each language.
    counts = usable.groupBy(F.col(lang).alias("_lang"), long_).agg(F.count(F.lit(1)).alias("_n"), F.sum(size.cast("long")).alias("_chars"))
    share = F.greatest(4.0 * SAMPLE_DOCS / F.col("_n"), 4.0 * SAMPLE_SYMBOLS / F.col("_chars"))
    counts = counts.select("_lang", "_long", F.least(F.lit(1.0), share).alias("_share"))
    if counts.count() <= 2 * MOST_LANGUAGES:  # two rows each: far below what a broadcast bears
        counts = F.broadcast(counts)
    drawn = rows.join(counts, ["_lang", "_long"]).where(F.col("_key") / float(2**63) < F.col("_share"))
    order = Window.partitionBy("_lang").orderBy("_long", "_key", "_text")
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.row_number().over(order))
    found: dict[str, str] = {}
    for r in drawn.where(F.col("_before") < SAMPLE_SYMBOLS).orderBy("_lang", "_n").collect():
        if len(found.get(r["_lang"], "")) < SAMPLE_SYMBOLS:
            found[r["_lang"]] = (found.get(r["_lang"], "") + "\n" + r["_text"])[:most]
    return tuple(sorted(found.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and score of each whole text in columns ``into`` and ``score`` (replaced if there).

    Null texts, texts without a letter and all texts of a model without
    languages are ``und`` with score 0; ties go to the first language by code
    point; repeated rows are alike; an empty table stays empty.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(samples)

    @arrow_udf("struct<lang:string,score:double>")
    def found(texts: pa.Array) -> pa.Array:
        model = languages(held.value)
        names: list[str] = []
        scores: list[np.ndarray] = [np.zeros(0)]
        for part in portions(t.as_py() for t in texts):
            a, b = model.identify(part)
            names += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    own = Shield(docs)
    # A filter by the result must not make Spark compute it a second time below.
    out = own.inner.withColumn("_found", found.asNondeterministic()(F.col(own(text))))
    return own.restore(out.withColumn(into, F.col("_found.lang")).withColumn(score, F.col("_found.score")), into, score)
