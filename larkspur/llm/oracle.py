"""SQL for the ``opN_*`` queries that SQL can express, for DuckDB over the same tables."""

from larkspur.llm.runtime import UPPER, WORD

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), u AS (
  SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b, CAST(0 AS DOUBLE)) AS score
  FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce('=' || md5(text), '-')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS nth, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), f AS (
  SELECT min(nth) AS free, arg_min(level, nth) AS level FROM l WHERE cap / w >= level
), t AS (
  SELECT source, source_size, CASE WHEN f.free IS NULL OR nth < f.free THEN cap ELSE w * f.level END AS target FROM l, f
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, epochs * size + least(greatest(CAST(round(target) AS BIGINT) - epochs * source_size - upto, 0), size) AS taken FROM r
"""

def _crc_table() -> list[int]:
    """What CRC-32 makes of each byte: eight steps of division by its polynomial, bits reversed."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _cuts_sql(column: str) -> str:
    """The values that bound the levels of a dimension, as a part of a WITH."""
    return f"""
v_{column} AS (
  SELECT {column} AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY {column}) AS upto, sum(count(*)) OVER () AS total FROM d WHERE {column} IS NOT NULL GROUP BY {column}
), c_{column} AS (
  SELECT DISTINCT v FROM v_{column}, range(1, 16) t(i) WHERE i / 16.0 * total > upto - n AND i / 16.0 * total <= upto
)"""


def _hilbert_sql() -> str:
    """Place on the curve of (x0, x1, x2) of four bits, step by step, as parts of a WITH from ``h`` to ``placed``."""
    parts, now = [], "h"
    for bit in (3, 2, 1):
        low = (1 << bit) - 1
        for i in (0, 1, 2):
            up, swap = f"(x{i} >> {bit}) & 1 = 1", f"(xor(x0, x{i}) & {low})"
            x0 = f"CASE WHEN {up} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"
            more = f", CASE WHEN {up} THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}" if i else ""
            parts.append(f"h{bit}{i} AS (SELECT * REPLACE ({x0} AS x0{more}) FROM {now})")
            now = f"h{bit}{i}"
    parts.append(f"hg AS (SELECT * REPLACE (xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2) FROM {now})")
    gray = "CASE WHEN (x2 >> 3) & 1 = 1 THEN 7 ELSE 0 END", "CASE WHEN (x2 >> 2) & 1 = 1 THEN 3 ELSE 0 END", "CASE WHEN (x2 >> 1) & 1 = 1 THEN 1 ELSE 0 END"
    parts.append(f"hx AS (SELECT *, xor(xor({gray[0]}, {gray[1]}), {gray[2]}) AS g FROM hg)")
    index = " + ".join(f"((xor(x{i}, g) >> {bit}) & 1) * {1 << (3 * bit + 2 - i)}" for bit in (3, 2, 1, 0) for i in (0, 1, 2))
    parts.append(f"placed AS (SELECT *, {index} AS cell FROM hx)")
    return ", ".join(parts)


OP4 = f"""
WITH d AS (
  SELECT doc_id, lang, source, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32,
    CAST('0x' || substr(md5(coalesce('=' || md5(text), '-')), 1, 15) AS BIGINT) AS hash
  FROM documents
), {_cuts_sql("lang")}, {_cuts_sql("source")}, {_cuts_sql("size")}, h AS (
  SELECT *, CAST('0x' || substr(md5(coalesce('=' || doc_id, '-') || chr(31) || '=' || text_crc32 || chr(31) || '=' || size), 1, 15) AS BIGINT) >> 29 AS sub,
    (SELECT count(*) FROM c_lang WHERE v <= lang) AS x0, (SELECT count(*) FROM c_source WHERE v <= source) AS x1, (SELECT count(*) FROM c_size WHERE v <= size) AS x2
  FROM d
), {_hilbert_sql()}, g AS (
  SELECT hash, min(cell) AS least, count(*) AS n FROM placed GROUP BY hash
), r AS (
  SELECT *, row_number() OVER (ORDER BY least, n > 1000, hash, sub, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER () // 40 AS q, count(*) OVER () % 40 AS more FROM placed JOIN g USING (hash)
)
SELECT doc_id, size, text_crc32, 'rows' AS law,
  CAST(CASE WHEN rank < more * (q + 1) THEN rank // (q + 1) ELSE more + (rank - more * (q + 1)) // greatest(q, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN rank < more * (q + 1) THEN rank % (q + 1) ELSE (rank - more * (q + 1)) % greatest(q, 1) END AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM r
"""

#: Windows by brute force: any that shares enough shingles with an item to reach 0.8 is compared, at each start that a shared shingle or the document's end makes.
OP10 = r"""
WITH iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), dw AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, row_number() OVER () AS item, least(len(w), 5) AS k, list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda a: array_to_string(list_slice(w, a, a + least(len(w), 5) - 1), ' ')) AS sh FROM iw WHERE len(w) > 0
), widths AS (
  SELECT DISTINCT k FROM i
), d AS (
  SELECT doc_id, row_number() OVER () AS doc, k, list_transform(range(1, len(w) - k + 2), lambda a: array_to_string(list_slice(w, a, a + k - 1), ' ')) AS sh FROM dw, widths WHERE len(w) >= k
), ip AS (
  SELECT item, k, unnest(list_distinct(sh)) AS h FROM i
), dp AS (
  SELECT doc, k, unnest(sh) AS h, unnest(range(0, len(sh))) AS p FROM d
), hit AS (
  SELECT doc, item, p, h FROM dp JOIN ip USING (k, h)
), pairs AS (
  SELECT doc, item, len(i.sh) AS m, least(len(i.sh), len(d.sh)) AS mw, len(d.sh) AS n FROM (SELECT doc, item FROM hit GROUP BY ALL) JOIN d USING (doc) JOIN i USING (item)
), starts AS (
  SELECT DISTINCT doc, item, m, mw, least(p, n - mw) AS start FROM hit JOIN pairs USING (doc, item) WHERE mw >= 0.8 * m - 1e-9
), often AS (
  SELECT item, h, count(*) AS c FROM (SELECT item, unnest(sh) AS h FROM i) GROUP BY ALL
), shared AS (
  SELECT doc, item, m, mw, start, h, count(*) AS c FROM starts JOIN hit USING (doc, item) WHERE p >= start AND p < start + mw GROUP BY ALL
), common AS (
  SELECT doc, item, m, mw, start, CAST(sum(least(shared.c, often.c)) AS BIGINT) AS k FROM shared JOIN often USING (item, h) GROUP BY ALL
), best AS (
  SELECT doc, item, k / (m + mw - k) AS similarity, CAST(start AS INTEGER) AS start_word, row_number() OVER (PARTITION BY doc, item ORDER BY k DESC, start) AS nth FROM common WHERE k * 1.8 >= 0.8 * (m + mw) - 1e-9
)
SELECT doc_id, item_id, start_word, similarity FROM best JOIN d USING (doc) JOIN i USING (item) WHERE nth = 1
"""

ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": OP3, "op4_shard": OP4, "op5_mix": OP5, "op9_nearest": OP9, "op10_decontaminate": OP10}
