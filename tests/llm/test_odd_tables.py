"""Cases that ordinary tables don't have: regular long words, clashing names, doc_ids that texts share; and plain versions."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, decontaminate, linededup, mixing, quality, queries, separators, sharding, simhash, sketches, sstable, suffixes
from corpusloom.llm.textkit import Words
from corpusloom.llm.tokens import Encoder
from tests.llm.test_operators import PATH, plain_edit_distance, words

NAMES = ["low", "high", "arc", "base", "_arc", "_at", "_tie", "_rank", "_row", "_id", "_d", "_r", "_h", "_hash", "_takes", "_pass", "_t", "shard_", "key", "size", "epochs", "n", "h", "fp", "w0", "row_hash", "keep", "_key", "_part", "again", "a.b", "c`d", "`", "expected_grade", "tail_probability", "shard", "slot", "c1_", "text "]


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_differ_regularly_are_told_apart(spark, n):
    a, b = thue_morse(n)
    texts = [f"x {a}", f"x {b}", a, b, f"{a} {b}", f"{b} {a}"]
    assert len(set(Words(pa.array(texts)).hashes().tolist())) == 3
    assert len({sketches.to_text(s) for s in sketches.sketches(pa.array(texts))}) == 6
    encoder = Encoder(PATH)
    ids = encoder.whole(texts)
    assert encoder.encode_each(pa.array(texts)) == [i.tobytes() for i in ids]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in separators.token_counts(docs, PATH).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    got = sstable.read_shards(sstable.write_shards(docs, PATH)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {i: zlib.crc32(np.append(x, 0).astype("<u4").tobytes()) for i, x in enumerate(ids)}


def test_very_long_words_encode_exactly():
    rnd, encoder = random.Random(1), Encoder(PATH, pool_bytes=2000)
    for _ in range(3):
        texts = ["".join(rnd.choice("ab1.é") for _ in range(rnd.randint(1, 9000))) + " " + words(rnd, 5) for _ in range(20)]
        assert encoder.encode_each(pa.array(texts)) == [x.tobytes() for x in encoder.whole(texts)]


@pytest.fixture(scope="module")
def clashing(spark):
    """Names that operators use inside; one doc_id on several texts, null ids, repeated rows."""
    rnd = random.Random(21)
    rows = [(i % 40 if i % 9 else None, words(rnd, rnd.randint(5, 60)), f"s{i % 3}") for i in range(120)]
    rows += [rows[0], rows[0], (3, None, None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)]).cache()


def contents(frame, columns):
    at = [frame.columns.index(c) for c in columns]
    return collections.Counter(tuple(r[i] for i in at) for r in frame.collect())


STAGES = {
    "shard": lambda docs, labels, items: sharding.assign_shards(docs, 8, replicas=16, shard="in shard", slot="in slot"),
    "mix": lambda docs, labels, items: mixing.mixed_corpus(docs, labels),
    "clean": lambda docs, labels, items: decontaminate.clean_documents(docs, items),
    "quality": lambda docs, labels, items: quality.good_documents(docs, labels),
    "near": lambda docs, labels, items: simhash.drop_near_duplicates(docs),
}


@pytest.mark.parametrize("stage", STAGES)
def test_rows_keep_their_columns_whatever_these_are_called(spark, clashing, stage):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, words(random.Random(3), 15))], "item_id long, text string")
    got = STAGES[stage](clashing, labels, items)
    assert got.columns[: len(clashing.columns)] == clashing.columns
    given, found = contents(clashing, clashing.columns), contents(got, clashing.columns)
    assert set(found) <= set(given) and len(found) > 20
    if stage in ("shard", "clean"):
        assert found == given
    if stage == "near":
        assert set(found.values()) == {1}
    assert STAGES[stage](clashing.limit(0), labels, items).count() == 0


@pytest.mark.parametrize("name", ["suffixes", "leaks", "lines", "sketches", "tokens", "fingerprints"])
def test_other_columns_are_ignored(spark, clashing, name):
    items = spark.createDataFrame([(1, words(random.Random(3), 15))], "item_id long, text string")
    operator = {
        "suffixes": suffixes.repeated_passages,
        "leaks": lambda d: decontaminate.contaminated(d, items),
        "lines": lambda d: linededup.digests(d, linededup.keep_bitmaps(d)),
        "sketches": sketches.edited_fingerprints,
        "tokens": lambda d: separators.token_counts(d, PATH).select("doc_id", "n_tokens"),
        "fingerprints": simhash.near_duplicates,
    }[name]
    plain = clashing.select("doc_id", "text", "source")
    columns = operator(plain).columns
    assert contents(operator(clashing), columns) == contents(operator(plain), columns)


def test_a_key_of_many_rows_is_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    nodes = sharding.ring(8, 16)
    arcs = rows.where("doc_id = 7").groupBy(sharding._arc(sharding._position(rows, "doc_id"), nodes).alias("arc")).count().collect()
    assert len(arcs) > 8 and max(r["count"] for r in arcs) < 600
    got = sharding.assign_shards(rows, 8, replicas=16)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {500}
    assert got.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).where("n <> 500 or m <> 499").count() == 0


def test_shard_query_against_a_plain_version(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i if i % 5 else None, rnd.choice([None, "", words(rnd, 9), "é€😀" * 3])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_consistent_hash_shards(spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(40)) and {len(v) for v in by.values()} <= {7, 8}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_leaks_are_those_of_all_windows(spark):
    """Every stretch of every text against every item by a plain edit distance."""
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [line(n) for n in (1, 3, 5, 6, 9, 10, 11, 14)]
    texts = [line(rnd.randint(0, 24)) for _ in range(60)]
    for i, item in enumerate(items * 4):
        edited = list(item)
        for _ in range(rnd.randint(0, len(item) // 5)):
            edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
        texts.append(line(5) + edited + line(4))
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = len(item)
            best = min((plain_edit_distance(item, t[a:b]) for a in range(len(t)) for b in range(a + 1, min(len(t), a + n + n // 5) + 1)), default=99)
            if best <= n // 5:
                expected[d, i] = best
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.contaminated(frame, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == expected
    for r in found:  # the span is the text's own and within the edits
        own = " ".join(texts[r["doc_id"]])[r["start_byte"] : r["end_byte"]].split()
        assert plain_edit_distance(items[r["item_id"]], own) == r["edits"]


def test_a_text_shorter_than_the_item_has_a_span_of_its_own():
    found = decontaminate.find(pa.array(["x y", "v " * 13]), decontaminate.index([1], ["v " * 14]))
    assert found == [(1, 1, 1, 14, 0, 25)]


@pytest.mark.parametrize("n", [10, 15, 30, 60])
def test_recall_of_the_walks_at_the_edits_allowed(n):
    rnd, items, texts = random.Random(n), [], []
    for i in range(400):
        item = [f"{rnd.randrange(5000)}" for _ in range(n)]
        edited = list(item)
        for _ in range(n // 5):
            at = rnd.randrange(len(edited))
            edited[at : at + rnd.randrange(2)] = rnd.choice([[], ["new"], [f"n{rnd.randrange(99)}"]])
        items.append(" ".join(item))
        texts.append(f"{words(rnd, 15)} {' '.join(edited)} {words(rnd, 15)}")
    index = decontaminate.index(list(range(400)), items)
    near = [i for i in range(400) if decontaminate.edit_distance(np.array([hash(w) & 0xFFFF for w in items[i].split()], np.uint64), np.array([hash(w) & 0xFFFF for w in texts[i].split()], np.uint64))[0] <= n // 5]
    found = {r[0] for r in decontaminate.find(pa.array(texts), index) if r[0] == r[1]}
    assert len(found & set(near)) >= 0.99 * len(near) > 200


def test_items_of_one_template_cost_no_more_than_their_number():
    rnd = random.Random(3)
    stem = "which of the following statements about the named subject is the most accurate answer for"
    items = [f"{stem} {words(rnd, 6)}" for _ in range(2000)]
    text = " ".join(f"{stem} {words(rnd, 5)}" for _ in range(20)) + " " + items[5]
    assert 5 in {r[1] for r in decontaminate.find(pa.array([text]), decontaminate.index(list(range(2000)), items))}


def test_candidates_that_all_fail_the_edit_distance_give_nothing():
    item = [f"i{k}" for k in range(12)]
    index = decontaminate.index([1], [" ".join(item)])
    turned = " ".join([*item[:3], *reversed(item[3:])])
    assert decontaminate.find(pa.array([turned, None, "i0"]), index) == []
    assert len(list(decontaminate.candidates(Words(pa.array([turned])).hashes(), np.array([0, 12]), index))) == 1


def test_clean_documents_decides_by_row(spark):
    rnd = random.Random(5)
    item = words(rnd, 20)
    rows = [(None, f"{words(rnd, 9)} {item}"), (1, item), (1, words(rnd, 30)), (None, words(rnd, 30)), (2, None)]
    kept = decontaminate.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))
    assert {tuple(r) for r in kept.collect()} == set(rows[2:])


def test_line_dedup_of_texts_under_one_doc_id(spark, tmp_path):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nx"), (1, "only here, and nowhere else\nz"), (2, line), (3, f"y\n{line}"), (1, f"{line}\nx"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = linededup.keep_bitmaps(docs).collect()
    assert "text" not in linededup.keep_bitmaps(docs).columns and len(maps) == 5
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in linededup.digests(docs, linededup.keep_bitmaps(docs)).collect())
    assert got == {(1, 2, 1): 2, (1, 2, 0): 1, (2, 1, 1): 1, (3, 2, 0): 1, (None, 1, 0): 1}


def test_likeness_of_short_texts_is_exact(spark):
    """Below k distinct shingles a sketch has all of them, so likeness is that of the shingle sets."""
    rnd = random.Random(12)
    vocabulary = ["Ab", "cd", "é", "x1", "y", "z"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["", None, "one two"]
    def grams(t):
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) | grams(b) else 1.0
    got = {r["doc_id"]: r for r in sketches.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)] or ""
        t, n = t or "", len(t or "") // 2
        assert got[i]["near_next"] == pytest.approx(like(t, following))
        assert got[i]["near_edited"] == pytest.approx(like(t, t[: len(t) - n] + following[:n]))


def test_fit_agrees_with_a_dense_version():
    rng = np.random.default_rng(4)
    n, m, levels = 300, 12, 3
    dense = (rng.random((n, m)) < 0.3) * rng.integers(1, 3, (n, m)).astype(np.float64)
    grades = np.clip((dense[:, :4].sum(axis=1) + rng.normal(0, 0.5, n)).astype(int), 0, 2)
    rows, columns = np.nonzero(dense)
    first = np.searchsorted(rows, np.arange(n + 1))
    names = np.sort(rng.choice(quality.BUCKETS, m, replace=False))
    model = quality.fit(names[columns].astype(np.int32), dense[rows, columns].astype(np.float32), first, grades, levels, rounds=400)
    # the likelihood falls for any small step away, penalty included
    def loss(w, cuts):
        z = np.concatenate([np.full((n, 1), -np.inf), cuts[None, :] - (dense @ w)[:, None], np.full((n, 1), np.inf)], axis=1)
        c = 1 / (1 + np.exp(-z))
        return -np.log(c[np.arange(n), grades + 1] - c[np.arange(n), grades]).mean() + 1e-4 * (w**2).sum()
    w = model.weights[names].astype(np.float64)
    best = loss(w, model.thresholds)
    for _ in range(100):
        step = rng.normal(0, 0.05, m + 2)
        assert loss(w + step[:m], model.thresholds + np.sort(step[m:])) > best - 1e-6
    scores = model.scores(names[columns].astype(np.int32), dense[rows, columns].astype(np.float32), first)
    assert np.allclose(scores, dense @ w)


def test_mix_spreads_rows_of_one_doc_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix_documents(docs, labels).toPandas()
    taken = (got["size"] * (got.epochs + got.chosen)).sum()
    assert abs(taken - got.target.iloc[0]) <= 2
    chosen = got[got.doc_id == 7].chosen.mean()
    assert 0.4 < chosen < 0.6
    assert mixing.mixed_corpus(docs, labels).count() == 4500


def test_figures_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(i, "some words " * i, "mine", "a.b") for i in range(6)], "doc_id long, text string, expected_grade string, `x.y` string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    got = quality.select_good(docs, labels, least=0.0)
    assert got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("x.y", "string"), ("expected_grade", "double"), ("tail_probability", "double")]
    assert got.count() == 6
    shards = sharding.assign_shards(docs.toDF("doc_id", "text", "shard", "slot"), 3)
    assert shards.dtypes == [("doc_id", "bigint"), ("text", "string"), ("shard", "int"), ("slot", "bigint")]


def planted(rnd, points, radius, pairs):
    """Random fingerprints, of which the first `pairs` have a partner at exactly `radius` bits."""
    bits = rnd.integers(0, 2, (points, 256)).astype(bool)
    for i in range(pairs):
        bits[points - 1 - i] = bits[i]
        bits[points - 1 - i, rnd.choice(256, radius, replace=False)] ^= True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


@pytest.mark.parametrize(("points", "radius", "least"), [(200, 46, 0.88), (6000, 46, 0.88), (40_000, 46, 0.88), (40_000, 30, 0.99)])
def test_wide_links_keep_their_recall_at_the_radius(spark, points, radius, least):
    pairs = min(300, points // 4)
    x = planted(np.random.default_rng(points), points, radius, pairs)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(x.view(np.int64).tolist())], "id long, w0 long, w1 long, w2 long, w3 long").repartition(4)
    got = {(min(r), max(r)) for r in simhash.wide_links(frame).collect()}
    assert all(int(np.bitwise_count(x[a] ^ x[b]).sum()) <= simhash.WIDE_RADIUS for a, b in got)
    assert sum((i, points - 1 - i) in got for i in range(pairs)) / pairs >= least


def test_dense_cells_of_wide_fingerprints_stay_one_component(spark):
    """Thousands of near copies of one text meet in all cells, cells beyond the limit among them."""
    rnd = np.random.default_rng(3)
    bits = np.repeat(rnd.integers(0, 2, (1, 256)).astype(bool), 3000, axis=0)
    for row in bits:
        row[rnd.choice(256, 12, replace=False)] ^= True
    x = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.int64), axis=0)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "id long, w0 long, w1 long, w2 long, w3 long")
    for limit in (1 << 17, 700):
        found = components.components(simhash.wide_links(frame, cell_rows=limit)).collect()
        assert len(found) == len(x) - 1 and {r["root"] for r in found} == {0}
