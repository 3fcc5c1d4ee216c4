"""Near duplicates by HyperMinHash registers.

A document is the set of its distinct word shingles, hashed to 64 bits.  The
hash's leading part picks one of REGISTERS buckets; a bucket keeps the smallest
remainder as its count of leading zeros and the MANTISSA bits that follow.  An
empty bucket is filled with the smallest of the set under a hash of its own, so
that small sets fill all buckets too.  Bands of registers that agree bring
candidates together.  A band is as long as misses allow: of r registers each,
a pair of similarity s is missed with probability (1 - s**r)**(REGISTERS / r),
and that is at most MISSED at the wanted similarity (48 bands of 6 for 0.8).

Documents with equal sets are one node from the start.  In a shared band bucket
every node is compared with the bucket's smallest, so the comparisons are linear
in the bucket; components are formed; buckets whose nodes already are one
component are done, and so are buckets of two.  In the others the nodes are
compared with the bucket's largest, which leaves buckets of four and more that
hold several components.  Their nodes meet by a prefix filter: two sets of the
wanted similarity share one of their rarest shingles, early enough in both to
leave room for the overlap.  That loses no pair, and members of a group whose
own changes set them too far apart meet nobody.  So nothing is compared all
against all within a group of copies, and no bucket is capped.
A comparison first estimates the similarity from the registers, corrected for
chance collisions, then confirms on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.components import components
from larkspur.llm.runtime import BROADCAST_ROWS, Scratch, Shield, join_told, lowered_words, ship

REGISTERS = 288
MANTISSA = 10
#: Share of pairs at exactly the wanted similarity that agree in no band.
MISSED = 5e-7
#: Word hashes that a worker remembers; at the bound it starts afresh.
REMEMBERED = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(32))


#: A hash function for each register's filling.
_SEEDS = _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _ODD)[:, None]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; of fewer words, one of them all."""
    w = lowered_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    width = min(width, len(w))
    n = len(w) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = s * _ODD + h[k : k + n]
    return np.unique(_mixed(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros (plus one) and mantissa of each bucket's smallest remainder, as 16 bits."""
    wide = (hashes >> _U(32)) * _U(REGISTERS)
    bucket = (wide >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = np.zeros(REGISTERS, np.uint64)
    low[bucket[first]] = (wide[first] << _U(32)) | (hashes[first] & _U(0xFFFFFFFF))
    empty = np.ones(REGISTERS, bool)
    empty[bucket[first]] = False
    empty = np.flatnonzero(empty)
    per = max(1, 200_000 // len(hashes))
    for i in range(0, len(empty), per):
        e = empty[i : i + per]
        x = (hashes[None, :] ^ _SEEDS[e]) * _MIX
        x ^= x >> _U(29)
        x *= _ODD
        low[e] = x.min(axis=1)
    m, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = np.clip(((2 * m - 1) * (1 << MANTISSA)).astype(np.int64), 0, (1 << MANTISSA) - 1)
    return (((zeros + 1) << MANTISSA) | mantissa).astype(np.uint16)


def band_rows(percent: int) -> int:
    """Registers of a band for this similarity; below 5 percent even single ones miss too many pairs."""
    s = percent / 100
    for rows in range(REGISTERS, 0, -1):
        if REGISTERS % rows == 0 and (1 - s**rows) ** (REGISTERS // rows) <= MISSED:
            return rows
    raise ValueError(f"a similarity of {percent} percent is too low for {REGISTERS} registers")


def slack(percent: int) -> float:
    """Candidates estimated below the threshold less this go no further: 5 standard errors of REGISTERS trials."""
    s = percent / 100
    return 5 * (s * (1 - s) / REGISTERS) ** 0.5


def band_keys(reg: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band's number and registers."""
    r = reg.reshape(-1, rows).astype(np.uint64)
    k = np.arange(1, len(r) + 1, dtype=np.uint64)
    for i in range(rows):
        k = _mixed(k * _ODD + r[:, i])
    return k.astype(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of these sizes agree."""
    k = np.arange(63)

    def octaves(n):
        load = np.maximum(n / REGISTERS, 1.0)[:, None]
        return np.exp(-load * 2.0 ** -(k + 1)) - np.exp(-load * 2.0**-k)

    return (octaves(n_a) * octaves(n_b)).sum(axis=1) / (1 << MANTISSA)


def estimate(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate of the Jaccard similarity by rows."""
    c = chance(n_a, n_b)
    return ((reg_a == reg_b).mean(axis=1) - c) / (1 - c)


def _signatures(texts: pa.Array, width: int, rows: int) -> pa.StructArray:
    """Size, digest, registers and band keys of each text's set; of an empty set only the size."""
    n, digest, reg, keys = [], [], [], []
    for t in texts.cast(pa.binary()):
        s = shingle_set(t.as_py(), width)
        n.append(len(s))
        if len(s):
            r = registers(s)
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            reg.append(r.tobytes())
            keys.append(band_keys(r, rows))
        else:
            digest.append(None)
            reg.append(None)
            keys.append(np.zeros(0, np.int64))
    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
    pa.default_memory_pool().release_unused()
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(reg, pa.binary()), lists], ["n", "digest", "reg", "keys"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes fit and whose registers promise the similarity, of rows (a, b, and of each side n and registers)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = {k: batch.column(k) for k in batch.schema.names}
        n_a, n_b = d["n_a"].to_numpy(), d["n_b"].to_numpy()
        reg = [np.frombuffer(b"".join(d[k].to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("reg_a", "reg_b")]
        fit = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
        near = pa.array(np.flatnonzero(fit & (estimate(*reg, n_a, n_b) >= percent / 100 - slack(percent))))
        yield pa.RecordBatch.from_arrays([d["a"].take(near), d["b"].take(near)], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed pairs (a, b) of rows (a, b, and of each side the text); rows with equal b stand together."""
    last, last_set = None, None
    for batch in batches:
        d = {k: batch.column(k) for k in batch.schema.names}
        d |= {k: d[k].cast(pa.binary()) for k in ("text_a", "text_b")}
        sure = []
        for i in range(batch.num_rows):
            if (b := d["b"][i].as_py()) != last:
                last, last_set = b, shingle_set(d["text_b"][i].as_py(), width)
            s = shingle_set(d["text_a"][i].as_py(), width)
            both = len(np.intersect1d(s, last_set, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(last_set) - both):
                sure.append(i)
        yield pa.RecordBatch.from_arrays([d["a"].take(pa.array(sure, pa.int64())), d["b"].take(pa.array(sure, pa.int64()))], names=["a", "b"])


def _shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, h): a row for each shingle of each node's text."""
    for b in batches:
        for node, text in zip(b.column("node").to_pylist(), b.column("_text").cast(pa.binary()).to_pylist(), strict=True):
            s = shingle_set(text, width)
            full = np.full(len(s), node), np.full(len(s), len(s))
            yield pa.RecordBatch.from_arrays([pa.array(full[0], pa.int64()), pa.array(full[1], pa.int64()), pa.array(s.astype(np.int64))], names=["node", "n", "h"])


def prefix_pairs(texts: DataFrame, width: int, percent: int, own: Scratch) -> DataFrame:
    """Pairs (a, b) that may reach the similarity, of rows (node, label, _text) with different labels; none that do is lost.

    Shingles are ordered by how many nodes have them, then by hash.  Sets of
    sizes x <= y with the similarity share at least percent / (100 + percent) *
    (x + y) shingles, so the first shared one stands that early in both orders.
    """
    rows = own.keep(texts.select("node", "_text").mapInArrow(lambda it: _shingled(it, width), "node long, n long, h long"), "shingles")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h")) - 1
    share = percent / (100 + percent)
    rest = lambda x: F.col("n") - F.ceil(F.col("n") * x - 1e-9)
    prefix = rows.join(often.where(F.col("df") > 1), "h").withColumn("p", place)
    # Shingles of one node only come first in its order: they shift the places of the others.
    alone = rows.join(often.where(F.col("df") == 1), "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    prefix = prefix.join(alone, "node", "left").withColumn("p", F.col("p") + F.coalesce("alone", F.lit(0))).where(F.col("p") <= rest(percent / 100))
    prefix = own.keep(prefix.join(texts.select("node", "label"), "node").select("h", "node", "label", "n", "p"), "prefix")
    a = prefix.where(F.col("p") <= rest(2 * share)).select("h", *[F.col(c).alias(f"a_{c}") for c in ("node", "label", "n", "p")])
    b = prefix.select("h", *[F.col(c).alias(f"b_{c}") for c in ("node", "label", "n", "p")])
    order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
    room = F.least(F.col("a_n") - F.col("a_p"), F.col("b_n") - F.col("b_p")) >= F.ceil((F.col("a_n") + F.col("b_n")) * share - 1e-9)
    fits = order & (100 * F.col("a_n") >= percent * F.col("b_n")) & room & (F.col("a_label") != F.col("b_label"))
    return a.join(b, (a["h"] == b["h"]) & fits).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id``, ``kept`` and ``survivor``.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle
    sets; ``component_id`` is the smallest id reachable, ``kept`` tells if it is
    the row's own, and exactly one row of each component is ``survivor`` (the
    smallest id, nulls last; of repeated ids the first row read).

    ``percent`` is 5 to 100; lower ones are refused.  Null and empty texts and
    texts without words have an empty set and are linked with nothing.  Null ids don't count as smallest unless all are null.
    Columns named as an output are replaced.  An empty table stays empty.
    """
    spark, rows = docs.sparkSession, band_rows(percent)
    ship(spark)
    own = Scratch(spark, "neardup")
    shield = Shield(docs)
    docs, doc_id, text = shield.inner, shield(doc_id), shield(text)

    @arrow_udf("struct<n:long,digest:binary,reg:binary,keys:array<long>>")
    def signatures(texts: pa.Array) -> pa.Array:
        return _signatures(texts, width, rows)

    # Only texts go to Python, and only once; rows are numbered as they are written.
    made = docs.withColumn("_s", signatures.asNondeterministic()(F.col(text))).withColumn("_rid", F.monotonically_increasing_id())
    signed = own.keep(made.select(*docs.columns, "_rid", *[F.col(f"_s.{c}").alias(f"_{c}") for c in ("n", "digest", "reg", "keys")]), "signed")

    # Equal sets are one node, named by its smallest row.
    digests = signed.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.min("_rid").alias("_node"), F.count(F.lit(1)).alias("_rows"))
    copies = own.keep(digests.where(F.col("_rows") > 1), "copies")
    member = join_told(signed.select("_rid", "_digest", F.col(doc_id).alias("_id")), copies, "_digest", "_rows", "left", own, "often")
    member = own.keep(member.select("_rid", "_id", F.coalesce("_node", "_rid").alias("node")), "member")
    later = member.where(F.col("_rid") != F.col("node")).select("_rid")
    nodes = signed.join(later, "_rid", "left_anti")

    banded = nodes.select(F.col("_rid").alias("node"), F.explode("_keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("of")).where(F.col("of") > 1)
    shared = own.keep(shared, "buckets")
    shared = own.keep(join_told(banded, shared, "key", "of", "inner", own, "full").select("key", "node", "low", "of"), "shared")

    texts = signed.select("_rid", F.col(text).alias("_text"))

    def sides(pairs: DataFrame, **columns: str) -> DataFrame:
        """Pairs with columns of both nodes, named <name>_a and <name>_b; only the nodes that occur are dealt out."""
        nodes = pairs.select(F.col("a").alias("_rid")).union(pairs.select(F.col("b").alias("_rid"))).distinct()
        few = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
        used = signed.join(few, "_rid", "left_semi")
        for side in ("a", "b"):
            pairs = pairs.join(used.select(F.col("_rid").alias(side), *[F.col(c).alias(f"{k}_{side}") for k, c in columns.items()]), side)
        return pairs

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that are links."""
        pairs = own.keep(pairs.distinct(), f"{name}-pairs")
        near = own.keep(sides(pairs, n="_n", reg="_reg").mapInArrow(lambda it: _near(it, percent), "a long, b long"), f"{name}-near")
        return own.keep(sides(near, text=text).mapInArrow(lambda it: _linked(it, width, percent), "a long, b long"), f"{name}-links")

    links = confirmed(shared.where(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b")), "low")
    label = components(links, own, "c1")

    def mixed(label: DataFrame, least: int) -> DataFrame:
        """Rows of the shared buckets of ``least`` or more nodes that are of more than one component, with their component."""
        now = own.keep(shared.where(F.col("of") >= least).join(label, "node", "left").select("key", "node", "of", F.coalesce("label", "node").alias("label")), f"now{least}")
        apart = now.groupBy("key", "of").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.max(F.struct("node", "label")).alias("high")).where(F.col("_l") != F.col("_h"))
        apart = own.keep(apart.select("key", "of", F.col("high.node").alias("high"), F.col("high.label").alias("high_label")), f"apart{least}")
        return join_told(now.drop("of"), apart, "key", "of", "inner", own, f"full{least}").drop("of")

    rest = own.keep(mixed(label, 3), "mixed1")
    if not rest.isEmpty():
        links = links.union(confirmed(rest.where(F.col("label") != F.col("high_label")).select(F.col("node").alias("a"), F.col("high").alias("b")), "high"))
        label = components(links, own, "c2")
        rest = own.keep(mixed(label, 4).select("node", "label").distinct(), "mixed2")
        if not rest.isEmpty():
            few = F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest
            told = few.join(texts.withColumnRenamed("_rid", "node"), "node")
            links = links.union(confirmed(prefix_pairs(told, width, percent, own), "rest"))
            label = components(links, own, "c3")

    member = own.keep(member.join(label, "node", "left").select("_rid", "_id", F.coalesce("label", "node").alias("_label")), "labelled")
    head = member.groupBy("_label").agg(F.min("_id").alias("component_id"), F.min(F.struct(F.col("_id").isNull(), "_id", "_rid"))["_rid"].alias("_head"), F.count(F.lit(1)).alias("_of"))
    head = own.keep(head.where(F.col("_of") > 1), "heads")
    told = join_told(member, head, "_label", "_of", "left", own, "crowds")
    told = told.select("_rid", F.when(F.col("_of") > 1, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), F.coalesce("_head", "_rid").alias("_head"))
    out = signed.drop("_digest", "_reg", "_keys").join(told, "_rid")
    out = out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))).withColumn("survivor", F.col("_rid") == F.col("_head"))
    return shield.restore(out.withColumnRenamed("_n", "n_shingles"), "n_shingles", "component_id", "kept", "survivor")
