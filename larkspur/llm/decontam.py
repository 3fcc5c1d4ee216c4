"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

Words are runs of letters, marks and digits in lower case; shingles are WIDTH
words (of shorter items, all their words), weighted by how often they occur.  A
document is contaminated by an item if some window of the item's length has a
weighted Jaccard similarity of SIMILARITY or more with it.

1. Windows are bounded by length alone: one of a length that is within
   SIMILARITY of some item of that length shares at least s / (1 + s) of both
   sides' weight with the items of that length taken together, so windows that
   share less with all of them are left out, which loses none.  Moving a
   window's start to its first such shingle loses none either, so those starts
   are enough.  Nothing here tells which item a window is like.
2. Each such window and each item gets a 64-bit SimHash.  The bits are cut into
   RADIUS + 1 blocks: fingerprints that differ in RADIUS bits or fewer agree in
   a block.  An index by length, block and the block's bits gives the pairs, and
   those that differ in more than RADIUS bits go.
3. The rest are verified by their exact weighted similarity.

At similarity 0.8 a bit differs with probability of about 0.15, so that more
than RADIUS of 64 do in fewer than one of 10,000 windows, and a contaminated
document mostly has several windows.  A radius that wide makes blocks of two or
three bits, so it is the length that makes the index select, and the radius: of
two unrelated fingerprints one pair in 40 differs in so few bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import Scratch, Shield, small

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 24


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(width: int) -> Column:
    """Hashes of the shingles of ``width`` words, by place, of column ``_w``."""
    parts = ", ".join(f"_w[i + {k}]" for k in range(width))
    return F.expr(f"CASE WHEN size(_w) >= {width} THEN transform(sequence(0, size(_w) - {width}), i -> xxhash64({parts})) ELSE array() END")


def _simhash(shingles: str) -> Column:
    bit = f"aggregate({shingles}, 0, (n, h) -> n + CASE WHEN shiftright(h, b) & 1 = 1 THEN 1 ELSE -1 END) > 0"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN {bit} THEN shiftleft(1L, b) ELSE 0L END)")


def _blocks(fingerprint: str) -> Column:
    """A row for each block: its number and bits."""
    n = RADIUS + 1
    cuts = [64 * k // n for k in range(n + 1)]
    parts = [f"struct({k} AS block, shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L AS bits)" for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.expr(f"explode(array({', '.join(parts)}))")


def row_key(doc_id: str, text: str) -> list[Column]:
    """Tells documents apart: id (nulls as one) and two hashes of the text.  Rows alike in all are the same document."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text, F.col(doc_id).isNull()).alias("_h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_c")]


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item found in it: ``_id``, ``_h``, ``_c`` (see :func:`row_key`), ``doc_id``, ``item_id``, ``start_word``, ``similarity``.

    One row for each document and item, with the best window: of equal ones the
    first that begins with a shared shingle or ends the document.  Null, empty and wordless texts on either side are never
    paired; equal rows count as one document; items of equal id and text count
    as one; empty tables give no rows.
    """
    own = Scratch(docs.sparkSession, "decontam")
    items = items.select(F.col(item_id).alias("item_id"), _word_hashes(F.col(item_text)).alias("_w")).where(F.size("_w") > 0).distinct()
    items = own.keep(items.withColumn("item", F.xxhash64("item_id", "_w")).withColumn("width", F.least(F.size("_w"), F.lit(WIDTH))), "items")
    found = None
    for width in sorted(r["width"] for r in items.select("width").distinct().collect()):
        pairs = _at_width(docs, items.where(F.col("width") == width), width, doc_id, text, own)
        found = pairs if found is None else found.union(pairs)
    if found is None:
        return docs.limit(0).select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0.0).alias("similarity"))
    return found


def _at_width(docs: DataFrame, items: DataFrame, width: int, doc_id: str, text: str, own: Scratch) -> DataFrame:
    items = items.select("item", "item_id", _shingles(width).alias("ish")).withColumn("m", F.size("ish"))
    items = own.keep(items.withColumn("ifp", _simhash("ish")), f"items{width}")
    told = items.select("m", F.explode("ish").alias("sh")).distinct()
    docs_w = docs.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), _word_hashes(F.col(text)).alias("_w")).where(F.size("_w") >= width)
    key = ["_id", "_h", "_c"]

    # 1. Shingles of the items of each length, and the starts whose windows hold enough of them.
    placed = docs_w.select(*key, F.size("_w").alias("words"), F.posexplode(_shingles(width)).alias("p", "sh"))
    hits = placed.join(small(told), "sh").groupBy(*key, "m", "words").agg(F.sort_array(F.collect_set("p")).alias("at"))
    hits = hits.withColumn("mw", F.least("m", F.col("words") - (width - 1)))
    # A window is as long as its item, or a whole shorter document that is long enough for SIMILARITY.
    hits = hits.where(F.col("mw") >= SIMILARITY * F.col("m") - 1e-9)
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("m") + F.col("mw")) - 1e-9).cast("int")
    # What occurs in a window counts by place: at least as often as its weight in common.
    hits = hits.withColumn("need", need).where(F.size("at") >= F.col("need"))
    last = "words - (%d) - mw" % (width - 1)
    found = f"filter(transform(slice(at, 1, greatest(size(at) - need + 1, 0)), (p, j) -> struct(p AS p, at[j + need - 1] AS q)), x -> x.q < least(x.p, {last}) + mw)"
    starts = hits.select(*key, "m", "mw", F.expr(last).alias("last"), F.explode(F.expr(found)).alias("s"))
    starts = own.keep(starts.select(*key, "m", "mw", "last", F.least("s.p", "last").alias("start")).distinct(), f"starts{width}")

    # 2. Fingerprints of those windows, and pairs that agree in a block and differ in few bits.
    slim = small(starts.select(*key).distinct())
    again = docs_w.join(slim, key, "left_semi").dropDuplicates(key).select(*key, "doc_id", _shingles(width).alias("_s"))
    windows = again.join(starts, key).select(*key, "doc_id", "m", "mw", "start", "last", F.expr("slice(_s, start + 1, mw)").alias("win"))
    windows = own.keep(windows.withColumn("wfp", _simhash("win")), f"windows{width}")
    left = windows.select(*key, "m", "start", "wfp", _blocks("wfp").alias("b")).select("*", "b.*").drop("b")
    right = small(items.select("item", "m", "ifp", _blocks("ifp").alias("b")).select("*", "b.*").drop("b"))
    close = left.join(right, ["m", "block", "bits"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    close = close.select(*key, "m", "start", "item").distinct()

    # 3. Exact weighted similarity; a start is a shared shingle's place, or the last.
    both = close.join(windows.drop("wfp"), [*key, "m", "start"]).join(small(items.select("item", "item_id", "ish")), "item")
    both = both.where(F.expr("start = last OR array_contains(ish, win[0])"))
    common = F.expr("aggregate(array_intersect(ish, win), 0, (n, h) -> n + least(size(filter(ish, x -> x = h)), size(filter(win, x -> x = h))))")
    scored = both.withColumn("k", common).withColumn("similarity", F.col("k") / (F.col("m") + F.col("mw") - F.col("k")))
    scored = scored.where(F.col("k") * (1 + SIMILARITY) >= SIMILARITY * (F.col("m") + F.col("mw")) - 1e-9)
    best = F.max_by(F.struct("doc_id", "item_id", F.col("start").alias("start_word"), "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy(*key, "item").agg(best.alias("b")).select(*key, "b.doc_id", "b.item_id", "b.start_word", "b.similarity")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; all columns as they were."""
    own = Scratch(docs.sparkSession, "clean")
    key = ["_id", "_h", "_c"]
    bad = own.keep(contaminated(docs, items, doc_id, text).select(*key).distinct(), "bad")
    shield = Shield(docs, **dict(zip(key, row_key(doc_id, text), strict=True)))
    return shield.restore(shield.inner.join(small(bad), key, "left_anti"))
