"""Operators over documents: edge cases and brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontam, langid, lm, mixing, neardup, quality, sharding, tokencount
from larkspur.llm.queries import vocabulary_path

from .conftest import CLASHES, prose

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def kept_columns(out, odd, *new):
    replaced = {n.lower() for n in new}
    assert [c for c in out.columns if c not in new] == [c for c in odd.columns if c.lower() not in replaced]


# Token counts


def test_tokens_match_library():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library, mine, rng = Tokenizer.from_file(path), tokencount.TokenCounter(path), random.Random(4)
    signs = "ab 's'll \u0085\x1c  \n\té漢½²😀á​!?.,0٣"
    for _ in range(800):
        t = "".join(rng.choice([rng.choice(signs), "<|endoftext|>", " the", chr(rng.randrange(1, 0x2FFF))]) for _ in range(rng.randrange(40)))
        assert mine(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_tokens_edges(odd, none):
    out = tokencount.count_tokens(odd, vocabulary_path())
    kept_columns(out, odd, "n_tokens")
    got = out.select("doc_id", "text", "n_tokens").collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == 0 for r in got if not r.text) and all(r.n_tokens > 0 for r in got if r.text)
    assert tokencount.count_tokens(none, vocabulary_path()).count() == 0


# Language


def phrases_by_hand(train, text):
    n, m = 1, ""
    for c in text:
        if m + c in train:
            m += c
        else:
            n += 1
            m = c if c in train else ""
    return n


def test_phrases_match_definition():
    rng = random.Random(5)
    samples = (("a", prose(rng, 200)), ("b", prose(rng, 200, "le la de un des que é".split())))
    model = langid.Languages(samples)
    # Longer than a block, some so that parses from different places never meet.
    texts = [prose(rng, 20), "zzz qqq", "é" * 10, "the of and " * 300, "e" * 20_000, "ab" * 5_000 + prose(rng, 900), "", prose(rng, 2_000), samples[0][1] * 9, "é" * langid.BLOCK, "at" * 7_001]
    h, _ = model.entropies(texts)
    sign = lambda s: "".join(map(chr, langid.symbols([s], model.table)[0]))
    for i, t in enumerate(texts):
        s = sign(t)
        for k, (_, train) in enumerate(samples if s else ()):
            assert h[i, k] == pytest.approx(phrases_by_hand(sign(train), s) * model.bits[k] / len(s))


def test_phrases_of_many_letters():
    """Every character of the samples is a symbol of its own, however many there are."""
    rng = random.Random(15)
    sign = lambda low, n: "".join(chr(low + rng.randrange(3_000)) if rng.random() < 0.9 else " " for _ in range(n))
    samples = (("a", sign(0x4E00, 3_000) + "K"), ("b", sign(0x5400, 3_000)), ("c", prose(rng, 200)))
    model = langid.Languages(samples)
    letters = {c for _, t in samples for c in t.lower() if c.isalpha()}
    assert len({int(model.table[ord(c)]) for c in letters}) == len(letters) and model.table[ord("я")] == langid.OTHER
    texts = [samples[0][1][500:700], sign(0x5000, 2_500), samples[1][1][40:90] + samples[2][1][:90] + "я", "kK"]
    h, _ = model.entropies(texts)
    of = lambda s: "".join(map(chr, langid.symbols([s], model.table)[0]))
    for i, t in enumerate(texts):
        s = of(t)
        for k, (_, train) in enumerate(samples):
            assert h[i, k] == pytest.approx(phrases_by_hand(of(train), s) * model.bits[k] / len(s))


def test_language_edges(odd, none):
    samples = langid.draw_samples(odd, F.col("doc_id"))
    out = langid.identify(odd, samples)
    kept_columns(out, odd, "lang_pred", "score")
    got = out.select("doc_id", "text", "lang_pred", "score").collect()
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    assert all(r.lang_pred == "fr" for r in got if r.doc_id and 200 <= r.doc_id < 240)
    assert langid.identify(none, samples).count() == 0
    assert langid.draw_samples(none, F.col("doc_id")) == ()
    assert {r.lang_pred for r in langid.identify(odd, ()).collect()} == {"und"}


def test_language_samples_are_filled(spark):
    """A few notes, or many tiny ones, don't keep a language from its 30,000 characters."""
    rng = random.Random(8)
    rows = [(1, "short note", "en")] + [(i, prose(rng, 4_000), "en") for i in range(2, 6)]
    rows += [(i, prose(rng, 10), "fr") for i in range(100, 1_600)] + [(9, "y" * 100_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(langid.draw_samples(docs, F.col("doc_id")))
    most = langid.SAMPLE_SYMBOLS + langid.SAMPLE_DOC_CHARS
    assert set(got) == {"en", "fr", "de"} and all(langid.SAMPLE_SYMBOLS <= len(t) <= most for t in got.values())
    assert got["en"].startswith("\nshort note\n")


# Near duplicates


def components_by_hand(rows, width, percent):
    """rows: (id, text); component by row."""
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_edges(odd, none, width):
    out = neardup.near_duplicates(odd, width=width)
    kept_columns(out, odd, "n_shingles", "component_id", "kept", "survivor")
    got = out.select("doc_id", "text", "n_shingles", "component_id", "survivor").collect()
    want = components_by_hand([(r.doc_id, r.text) for r in got], width, 80)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == want
    assert sum(r.survivor for r in got) == len({(c, None if n else i) for i, (_, n, c) in enumerate(want)})
    if width == 5:
        assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_families(spark):
    """Families whose members' changes put them around the similarity wanted."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"w{family}{rng.randrange(400)}" for _ in range(90)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(60)}"
            rows.append((len(rows), " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
    assert got == sorted(components_by_hand(rows, 2, 80))


def test_prefix_pairs_lose_no_link(spark):
    from larkspur.llm.runtime import Scratch

    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(60):
        w = [x if rng.random() > i / 400 else f"z{rng.randrange(99)}" for x in base][: 70 - rng.randrange(12)]
        rows.append((i, i, " ".join(w)))
    df = spark.createDataFrame(rows, "node long, label long, _text string")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in neardup.prefix_pairs(df, 2, 80, Scratch(spark, "test")).collect()}
    sets = [set(neardup.shingle_set(t.encode(), 2).tolist()) for _, _, t in rows]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= got


@pytest.mark.parametrize("percent", [30, 50, 95])
def test_near_duplicates_at_any_similarity(spark, percent):
    """Pairs at and about the wanted similarity, whatever it is: as comparing all sets has it."""
    rng = random.Random(percent)
    rows = []
    for i in range(60):
        base = [f"w{i}x{k}" for k in range(60)]
        rows.append((2 * i, " ".join(base)))
        share = min(1, 2 * (percent / 100 + rng.uniform(-0.05, 0.05)) / (1 + percent / 100))
        kept = round(share * 60)
        rows.append((2 * i + 1, " ".join([*base[:kept], *(f"z{i}x{k}" for k in range(60 - kept))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width=2, percent=percent).collect()}
    assert [got[d] for d, _ in rows] == components_by_hand(rows, 2, percent) and any(d != c for d, _, c in got.values())
    with pytest.raises(ValueError, match="too low"):
        neardup.near_duplicates(df, percent=3)


def test_register_estimate():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2))
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[:k]], rng.integers(0, 2**63, len(a) - k).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        n = np.array([len(a)]), np.array([len(b)])
        got = neardup.estimate(neardup.registers(a)[None, :], neardup.registers(b)[None, :], *n)[0]
        assert got == pytest.approx(share, abs=0.15)


# Sharding


def test_hilbert_curve_is_continuous_and_complete():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        grid = np.array(np.meshgrid(*[range(side)] * d)).reshape(d, -1).T
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(side**d))
        path = grid[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sharding_edges(odd, none):
    tie = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    out = sharding.shard_rows(odd, ["lang", "source", "n_chars"], tie, 7)
    kept_columns(out, odd, "shard", "slot")
    by = collections.defaultdict(list)
    for r in out.select("shard", "slot").collect():
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(7)]
    assert set(by) == set(range(7)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == odd.count()
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_rows(none, ["lang", "source", "n_chars"], tie, 7).count() == 0


@pytest.mark.parametrize("big", [100, 1_000])
def test_sharding_by_brute_force(spark, monkeypatch, big):
    """Places by levels, curve, text and id, all sorted at once; groups of copies of any size stay together."""
    monkeypatch.setattr(sharding, "BIG", big)
    rng = random.Random(19)
    rows = [(i, f"l{rng.randrange(3)}", f"s{rng.randrange(5)}", rng.randrange(900), f"t{rng.choice([0, 0, 0, 1, rng.randrange(2, 300)])}") for i in range(1_500)]
    df = spark.createDataFrame(rows, "id long, lang string, source string, size long, text string")
    dims = ["lang", "source", "size"]
    got = sorted(sharding.shard_rows(df, dims, [F.col("id")], 7, together=[F.col("text")]).collect(), key=lambda r: (r.shard, r.slot))
    level = {r.id: [r.a, r.b, r.c] for r in df.select("id", *[x.alias(k) for k, x in zip("abc", sharding.levels(df, dims), strict=True)]).collect()}
    cell = {i: int(sharding.hilbert_index(np.array([v]), sharding.BITS)[0]) for i, v in level.items()}
    least = {}
    for r in rows:
        least[r[4]] = min(least.get(r[4], 1 << 40), cell[r[0]])
    # Texts come in the order of their least cells, and a text's rows are together.
    order = [r.text for r in got]
    runs = [t for t, before in zip(order, [None, *order], strict=False) if t != before]
    assert len(runs) == len(set(runs)) and [least[t] for t in runs] == sorted(least.values())
    assert [(r.shard, r.slot) for r in got] == [(s, k) for s in range(7) for k in range(1_500 // 7 + (s < 1_500 % 7))]


@pytest.mark.parametrize("together", [[], ["text"]])
def test_sharding_takes_one_python_worker_a_task(odd, together):
    """A second call of the curve in one task would take another worker, which then stays beside the first."""
    plan = sharding.shard_rows(odd, ["lang", "source", "n_chars"], [F.col("doc_id")], 7, together=[F.col(c) for c in together])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sharding_of_other_types(spark):
    df = spark.sql("SELECT id, date_add(DATE'2020-01-01', CAST(id AS INT)) AS day, timestamp_seconds(id) AS at, id % 2 = 0 AS even, CAST(id AS DECIMAL(9,2)) AS price, IF(id = 3, CAST('NaN' AS DOUBLE), id) AS x, array(id) AS odd FROM range(40)")
    for dims in (["day", "at"], ["even", "price"], ["x"]):
        out = sharding.shard_rows(df, dims, [F.col("id")], 4).collect()
        assert sorted(collections.Counter(r.shard for r in out).values()) == [10] * 4
    by_day = [r.id for r in sharding.shard_rows(df, ["day"], [F.col("id")], 4).where("shard = 0").collect()]
    assert max(by_day) < 15
    with pytest.raises(ValueError, match="array"):
        sharding.shard_rows(df, ["odd"], [F.col("id")], 4)


def test_files_of_shards_are_pruned_by_their_statistics(spark, tmp_path):
    """Readers of one source and a range of sizes skip most files, of one shard's as well, and all rows are there."""
    import pyarrow.parquet as pq

    rng = random.Random(23)
    rows = [(i, f"s{rng.randrange(16):02}", rng.randrange(100_000)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    sharding.write_shards(sharding.shard_rows(df, ["source", "size"], [F.col("id")], 8), f"file://{tmp_path}/by_curve", 48)
    df.repartition(48).write.parquet(f"file://{tmp_path}/by_chance")

    def touched(path):
        files, met = 0, 0
        for f in sorted((tmp_path / path).rglob("*.parquet")):
            group = pq.ParquetFile(f).metadata
            of = {group.schema.column(i).name: [group.row_group(g).column(i).statistics for g in range(group.num_row_groups)] for i in range(group.num_columns)}
            files += 1
            met += any(a.min <= "s07" <= a.max and b.min <= 30_000 and b.max >= 20_000 for a, b in zip(of["source"], of["size"], strict=True))
        return files, met

    files, met = touched("by_curve")
    assert files >= 40 and met <= files / 4 and touched("by_chance")[1] == 48
    back = spark.read.parquet(f"file://{tmp_path}/by_curve")
    assert back.count() == 6_000 and back.select("shard", "slot").distinct().count() == 6_000


def test_string_levels_follow_whole_values(spark):
    names = ["arxiv", *(f"crawl-2023-{c}" for c in "abcdefgh")]
    rows = spark.createDataFrame([(n,) for n in names for _ in range(50)] + [(None,)], "source string")
    got = rows.select("source", sharding.levels(rows, ["source"])[0].alias("level")).distinct().collect()
    level = {r.source: r.level for r in got}
    assert len(got) == 10 and level[None] == 0 and len({level[n] for n in names}) == 9 and [level[n] for n in names] == sorted(level[n] for n in names)


# Mixing


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    held, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (left - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return held | {s: weight[s] * level for s in free}
        held |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_edges(odd, none):
    sized = odd.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    key = mixing.random_key(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = mixing.mix(sized, key)
    kept_columns(out, sized, "source_size", "target", "taken", "copies")
    rows = out.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    want = targets_by_hand(sizes)
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix(sized.repartition(3), key).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in rows}
    whole = mixing.mix(sized, key, whole=True).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in whole)
    assert mixing.mix(none.withColumn("size", F.lit(0)), key).count() == 0


# Language model


def test_lm_edges_and_counts(odd, none):
    train = odd.where("doc_id % 3 <> 1 OR doc_id IS NULL")
    out = lm.score_texts(odd, train)
    assert "text" not in out.columns and [c for c in CLASHES if c.lower() not in ("score", "n_tokens")] == [c for c in out.columns if c in CLASHES and c not in ("score", "n_tokens")]
    token = lambda t: [*words(t), "\n"]
    counts = collections.Counter(w for r in train.select("text").collect() for w in token(r.text))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t))
    texts = collections.Counter((r.doc_id, len(token(r.text)), sum(counts[w] > 0 for w in token(r.text)), round(base(r.text), 6)) for r in odd.collect())
    got = out.collect()
    assert texts == collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(none, train).count() == 0
    assert all(math.isfinite(r.score) for r in lm.score_texts(odd.limit(5), none).collect())


def lm_of(tokens):
    """Model and index of a vocabulary {token: count}, with an unknown token's half a count in each class."""
    hot = dict(sorted(tokens.items(), key=lambda x: (-x[1], x[0])))
    mass = np.full(lm.CLASSES, 0.5)
    for i, (t, c) in enumerate(hot.items()):
        if i < lm.SINGLE:
            mass[i] = c + 0.5
        else:
            mass[lm.surface(t)] += c + 0.5
    return lm.Index(hot, mass, max(0, sum(c >= lm.OWN for c in hot.values()) - lm.SINGLE)), mass


def test_lm_probabilities_add_up():
    """Of all known tokens and the unknown ones of each class, after any two tokens, whatever the vectors."""
    rng = np.random.default_rng(2)
    tokens = {b"w%d%c" % (i % 40, 97 + i % 26): max(1, 900 - i) for i in range(1_000)}
    index, mass = lm_of(tokens)
    v = lm.Vectors(index, mass)
    assert 100 < index.own < 900 - lm.SINGLE
    v.own[:-1], v.leaf_bias[:] = rng.normal(0, 0.5, v.own[:-1].shape), rng.normal(0, 1, v.leaf_bias.shape)
    inner = v.inner_log10(index)
    known = [*index][: len(tokens)]
    for context in ([known[3], known[lm.SINGLE + 5]], [known[-1], b"never"], [known[lm.SINGLE + 9]], []):
        total = 0.0
        for t in known:
            at, classes, leaf, own = lm.placed([*context, t], index)
            share = (tokens[t] + 0.5) / (mass[classes[-1]] if classes[-1] < lm.SINGLE else index.mass[leaf[-1]])
            total += share * 10 ** lm.log10_tokens(v, inner, classes, leaf, own, np.array([len(context) + 1]))[-1]
        for c in range(lm.SINGLE, lm.CLASSES):
            _, classes, leaf, own = lm.placed([*context, b"x"], index)
            classes[-1], leaf[-1] = c, index.own + c - lm.SINGLE
            total += 0.5 / index.mass[leaf[-1]] * 10 ** lm.log10_tokens(v, inner, classes, leaf, own, np.array([len(context) + 1]))[-1]
        assert total == pytest.approx(1, abs=1e-4)


def test_lm_scores_by_brute_force(odd, none, monkeypatch):
    """Scores of the whole way, from the same vectors by plain sums of exponentials, one token at a time."""
    monkeypatch.setattr(lm, "OWN", 3)
    monkeypatch.setattr(lm, "PASSES", 2)
    monkeypatch.setattr(lm, "HOT", 250)
    fitted = {}
    plain = lm.fit
    monkeypatch.setattr(lm, "fit", lambda train, counts, held, text: fitted.setdefault("v", plain(train, counts, held, text)))
    train = odd.where("doc_id < 230")
    got = {(r.doc_id, r.text): r.score for r in lm.score_texts(odd.withColumn("copy", F.col("text")), train).withColumnRenamed("copy", "text").collect()}
    counts = collections.Counter(w for r in train.select("text").collect() for w in [*(x.encode() for x in words(r.text)), lm.END])
    order = sorted(counts, key=lambda t: (-counts[t], t))
    v = fitted["v"]
    own = [t for t in order if counts[t] >= 3][lm.SINGLE :]
    cls = lambda t: order.index(t) if t in order[: lm.SINGLE] else lm.surface(t)
    members = collections.defaultdict(list)
    for t in counts:
        members[cls(t)].append(t)
    soft = lambda s: s - math.log(sum(math.exp(x) for x in s))
    for (_, text), score in got.items():
        if len(text or "") > 2_000:
            continue
        total, seen = 0.0, []
        for t in [*(x.encode() for x in words(text)), lm.END]:
            c = cls(t)
            one, two = (cls(seen[-1]) if seen else lm.START), (cls(seen[-2]) if len(seen) > 1 else lm.START)
            r = v.one[one].astype(float) + v.two[two] + (v.own[own.index(seen[-1])] if seen and seen[-1] in own else 0)
            total += soft(v.out @ r + v.bias)[c] / math.log(10)
            if c >= lm.SINGLE:
                inside = [i for i, t2 in enumerate(own) if cls(t2) == c] + [len(own) + c - lm.SINGLE]
                p = soft(v.leaf[inside].astype(float) @ v.near[one] + v.leaf_bias[inside])
                if t in own:
                    total += p[inside.index(own.index(t))] / math.log(10)
                else:
                    rest = 0.5 + sum(counts[x] + 0.5 for x in members[c] if x not in own)
                    total += p[-1] / math.log(10) + math.log10((counts[t] + 0.5) / rest)
            seen.append(t)
        assert score == pytest.approx(total, abs=1e-3 + 1e-5 * len(seen))


def test_lm_is_the_same_however_rows_are_dealt(odd):
    train = odd.where("doc_id is null or doc_id < 230")
    one, six = ({(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.score_texts(odd.repartition(n), train.repartition(n)).collect()} for n in (1, 6))
    assert one == six


def test_lm_learns(spark):
    """Held-out texts of a language with an order are scored above the order-blind base."""
    rng = random.Random(6)
    text = lambda: " ".join(w for _ in range(60) for w in rng.choice([("a", "b"), ("c", "d"), ("e", "f")]))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    got = lm.score_texts(docs.where("doc_id >= 250"), docs.where("doc_id < 250")).collect()
    assert all(r.score > 0.8 * r.base_score for r in got)


def test_lm_tells_words_of_one_class_apart(spark):
    """Two words of one class and one count, swapped: as the next word and as what stands before it."""
    assert lm.surface(b"xxa") == lm.surface(b"xxb")
    rng = random.Random(12)
    filler = [f"f{i}" for i in range(lm.SINGLE)]
    text = lambda i: " ".join([*rng.choices(filler, k=100), *("left xxa up" if i % 2 else "right xxb down").split()])
    train = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    asked = ["left xxa", "left xxb", "right xxb", "right xxa", "xxa up", "xxb up", "xxb down", "xxa down"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {asked[r.doc_id]: r.score for r in lm.score_texts(docs, train).collect()}
    for good, bad in (asked[i : i + 2] for i in range(0, len(asked), 2)):
        assert got[good] > got[bad] + 0.1, (good, bad)


# Quality


def test_quality(odd, none, spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 80) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 80).split()), "en", f"s{i % 2}", 400) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).where("doc_id >= 150").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got) >= 0.97 * len(got)
    out = quality.score_quality(odd, model)
    kept_columns(out, odd, "score")
    assert all(0 <= r[0] <= 1 for r in out.select("score").collect())
    assert quality.score_quality(none, model).count() == 0
    flat = quality.fit(odd, labels.limit(0))
    assert all(0 <= r[0] <= 1 for r in quality.score_quality(odd, flat).select("score").collect())


# Decontamination


def test_quality_draws_from_all_documents_without_a_label(spark, monkeypatch):
    """Views that are sure of everything are given each unlabelled document once, and none that has a label."""
    docs = spark.createDataFrame([(i % 90, f"text {i % 90}", "en", "s", 9) for i in range(180)] + [(None, "no id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, None)], "doc_id long, quality int")
    seen = []
    sure = [np.append(np.zeros(n), 20.0) for n, _ in quality.VIEWS.values()]

    def drawn(views, y, draw):
        got = draw(sure, [set(), set()], {1.0: 300, 0.0: 100})
        given = {h for me, _, h, _ in got if me == 0}
        seen.append((len(y), len(got), len(given), len(draw(sure, [set(), given], {1.0: 300, 0.0: 100})), len(draw(sure, [set(), set()], {1.0: 7, 0.0: 0}))))

    monkeypatch.setattr(quality, "co_train", drawn)
    quality.fit(docs, labels)
    quality.fit(docs.where("doc_id is not null"), spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int"))
    assert seen == [(120, 62, 31, 31, 14), (180, 0, 0, 0, 0)]


def test_quality_of_labels_not_fitted(spark):
    """Labelled documents of sf0.01 whose labels were kept back."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    described = quality.describe(docs)
    model = quality.fit_described(described, labels.where("doc_id % 3 > 0"))
    got = quality.score_described(described, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where("id % 3 = 0").collect()
    right = sum((r.score >= 0.5) == bool(r.quality) for r in got)
    assert len(got) > 100 and right >= 0.9 * len(got)


def test_decontamination(odd, none, spark):
    rng = random.Random(10)
    items = [(i, prose(rng, 12 + 3 * i, [f"b{k}" for k in range(300)])) for i in range(8)] + [(50, "three short words"), (51, None), (52, ""), (None, prose(rng, 20, [f"c{k}" for k in range(99)])), (0, None)]
    rows = []
    for i in range(60):
        d = [f"d{rng.randrange(500)}" for _ in range(120)]
        item = (items[i % 8][1] if i % 9 else items[8][1]).split()
        for _ in range(i % 2):
            item[rng.randrange(len(item))] = "zz"
        at = rng.randrange(len(d))
        rows.append((i, " ".join([*d[:at], *(item if i % 5 else []), *d[at:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(docs, bench).collect()}

    split = re.compile(r"[^\W_]+").findall
    want = {}
    for d, text in rows:
        for i, item in items:
            w, t = split(item or ""), split(text)
            k = min(5, len(w))
            if not w or len(t) < k:
                continue
            ish, dsh = ([tuple(x[a : a + k]) for a in range(len(x) - k + 1)] for x in (w, t))
            m, n = len(ish), min(len(ish), len(dsh))
            best = max(sum((collections.Counter(ish) & collections.Counter(dsh[a : a + n])).values()) for a in range(len(dsh) - n + 1))
            if best / (m + n - best) >= 0.8:
                want[d, i] = round(best / (m + n - best), 9)
    assert found == want and len(want) > 20
    assert decontam.clean(docs, bench).count() == 60 - len({d for d, _ in want})
    same = decontam.clean(odd, bench)
    assert same.columns == odd.columns and same.count() == odd.count()
    assert decontam.clean(none, bench).count() == 0 and decontam.clean(odd, bench.limit(0)).count() == odd.count()
