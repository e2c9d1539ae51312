"""Each operator against a plain version, over ordinary rows and over odd ones."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, decontaminate, files, linededup, mixing, quality, queries, separators, sharding, simhash, sketches, sstable, suffixes
from corpusloom.llm.ranges import in_order
from corpusloom.llm.tokens import Encoder

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, shard string, _t string"


def words(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages and lines, null and empty and very long texts, repeated rows, clashing names."""
    rnd = random.Random(11)
    passage, line = words(rnd, 60), "a line that many documents of this corpus have"
    texts = [words(rnd, rnd.randint(1, 150)) for _ in range(40)]
    texts += [texts[0]] * 6 + [texts[3] + " more"] * 2
    texts += [f"{words(rnd, 9)}\n {line.upper()} \n{words(rnd, 5)}\n{passage}\n{words(rnd, 30)}" for _ in range(7)]
    texts += [None, "", " \n\t ", words(rnd, 20_000), "x" * 50_000, "é ü\r\nß", "\n\n\n"]
    out = [(i * 3 + 1, t, None if i % 7 == 0 else f"s{i % 3}", "taken", "taken") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[1], "s1", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_balanced_and_gapless(docs, empty, rows):
    got = sharding.assign_shards(docs, 8, replicas=16).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign_shards(empty, 8).count() == 0


def test_shards_match_a_sequential_ring(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    n, nodes = 5, sharding.ring(5, 16)
    place = {r["doc_id"]: r for r in ids.select("doc_id", sharding._position(ids, "doc_id").alias("at"), sharding._arc(sharding._position(ids, "doc_id"), nodes).alias("arc")).collect()}
    for r in place.values():  # the first node clockwise
        cell = r["at"] % sharding.CELLS
        assert r["arc"] == next((i for i, (p, _) in enumerate(nodes) if p >= cell), 0)
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(ids, n, replicas=16, headroom=0.5).collect()}
    room = [-(-int(500 * 1.5) // n)] * n
    waiting = collections.defaultdict(list)
    for r in sorted(place.values(), key=lambda r: (r["arc"], r["at"], r["doc_id"])):
        waiting[r["arc"]].append(r["doc_id"])
    expected = {}
    while waiting:  # one by one, clockwise
        after = collections.defaultdict(list)
        for node in sorted(waiting):
            for doc in waiting[node]:
                shard = nodes[node][1]
                if room[shard]:
                    room[shard] -= 1
                    expected[doc] = shard
                else:
                    after[(node + 1) % len(nodes)].append(doc)
        waiting = after
    assert got == expected


def test_rows_without_a_key_spread(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    nodes = sharding.ring(8, 16)
    assert rows.select(sharding._arc(sharding._position(rows, "doc_id"), nodes).alias("arc")).distinct().count() > len(nodes) / 2
    got = sharding.assign_shards(rows, 8, replicas=16).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {375}


def test_few_rows_move_when_a_shard_is_added(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = sharding.assign_shards(ids, 40, headroom=0.25)
    b = sharding.assign_shards(ids, 41, headroom=0.25).withColumnRenamed("shard", "grown")
    assert a.join(b, "doc_id").where("shard <> grown").count() < 0.05 * 20_000


def fifty_grams(rows):
    seen = collections.defaultdict(set)
    texts = {d: t.split() for d, t, *_ in rows if d is not None and t}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(d)
    out = {}
    for d, w in texts.items():
        covered = set()
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                covered.update(range(i, i + 50))
        if covered:
            out[d] = covered
    return out


def test_repeated_passages_are_those_of_a_plain_search(docs, empty, rows):
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        assert r["other_id"] != r["doc_id"]
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == fifty_grams(rows)
    assert suffixes.repeated_passages(empty).count() == 0


def test_repeats_among_texts_that_share_a_seed(spark):
    rnd = random.Random(2)
    rows = []
    for group in range(25):  # two share the passage, others more words than these on either side of its middle
        left, seed, right = words(rnd, 60), words(rnd, 16), words(rnd, 60)
        cut = lambda a, b: f"{words(rnd, 30)} {' '.join(left.split()[60 - a :])} {seed} {' '.join(right.split()[:b])} {words(rnd, 30)}"
        rows += [(100 * group + i, cut(a, b)) for i, (a, b) in enumerate([(17, 17), (0, 33), (33, 0), (17, 17), (5, 29), (29, 5), (60, 3), (3, 60), (12, 22), (22, 12)])]
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r["other_id"] != r["doc_id"]
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == fifty_grams(rows)


def test_copies_across_ranges_keep_the_other_text(spark):
    rnd = random.Random(6)
    rows = []
    for group in range(12):  # many copies of a text and one other document with a passage of it
        passage = words(rnd, 52)
        text = f"{passage} {words(rnd, 9)}"
        rows += [(1000 * group + i, text) for i in range(300)] + [(1000 * group + 900, f"{words(rnd, 40)} {passage} {words(rnd, 40)}")]
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == fifty_grams(rows)


def test_one_doc_id_on_two_texts(spark):
    rnd = random.Random(9)
    one, two, whole = words(rnd, 55), words(rnd, 60), words(rnd, 51)
    long = f"{words(rnd, 40)} {two} {words(rnd, 307)} {one} {words(rnd, 3)}"
    rows = [(1, long), (1, f"{one} w1"), (1, long), (2, f"w2 {two} {words(rnd, 20)}"), (3, f"{words(rnd, 4)} {one}"), (1, whole), (4, whole), (1, "short")]
    got = {tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 40, 100, 2), (1, 407, 462, 3), (1, 0, 55, 3), (1, 0, 51, 4), (2, 1, 61, 1), (3, 4, 59, 1), (4, 0, 51, 1)}


def test_repeats_within_one_document_only_are_left_alone(spark):
    text = " ".join(["same words over and over"] * 60)
    assert suffixes.repeated_passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0


def test_benchmark_items_are_found_with_edits(spark, empty):
    rnd = random.Random(4)
    items = [words(rnd, n) for n in (3, 12, 25, 40, 60)]
    texts = []
    for i, item in enumerate(items):
        w = item.split()
        for _ in range(len(w) // 5):
            w[rnd.randrange(len(w))] = "edited"
        texts += [(10 * i, f"{words(rnd, 80)} {item.upper()}. {words(rnd, 50)}"), (10 * i + 1, f"{words(rnd, 80)}, {' '.join(w)} {words(rnd, 9)}")]
    clean = [(1000 + i, words(rnd, 200)) for i in range(20)] + [(2000, None), (2001, ""), (None, items[2])]
    found = decontaminate.contaminated(spark.createDataFrame(texts + clean, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (9, None), (8, "")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, d // 10) for d, _ in texts} | {(None, 2)}
    assert all(r["edits"] <= r["item_words"] // 5 for r in found)
    for r in found:
        text = dict(texts + clean)[r["doc_id"]]
        assert text.encode()[r["start_byte"] : r["end_byte"]].decode() in text
    assert decontaminate.contaminated(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_short_items_within_reach_are_found():
    rnd = random.Random(12)
    items, texts = [], []
    for i in range(1000):
        item = [f"i{i}w{j}" for j in range(10)]
        edited = list(item)
        for j in rnd.sample(range(10), 2):
            edited[j] = f"edited{rnd.randrange(1000)}"
        items.append(" ".join(item))
        texts.append(f"{words(rnd, 15)} {' '.join(edited)} {words(rnd, 15)}")
    found = decontaminate.find(pa.array(texts), decontaminate.index(list(range(1000)), items))
    assert len({(r[0], r[1]) for r in found if r[0] == r[1]}) >= 995


def test_items_in_blocks_give_the_same(spark, docs):
    items = spark.createDataFrame([(i, words(random.Random(i), 12)) for i in range(5)] + [(7, "w1")], "item_id long, text string")
    a, b = (sorted(map(tuple, decontaminate.contaminated(docs, items, block_bytes=n).collect()), key=str) for n in (1, 1 << 20))
    assert a == b


def plain_edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = (np.array([rnd.randrange(4) for _ in range(rnd.randint(1, 12))], np.uint64) for _ in range(2))
        cost, s, e = decontaminate.edit_distance(a, b)
        assert cost == plain_edit_distance(a.tolist(), b.tolist())
        assert plain_edit_distance(a.tolist(), b[s:e].tolist()) == cost if e > s else cost == len(a)


def test_classifier_separates_held_out_grades(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rated = labels.select("doc_id", quality.grade_of().alias("grade"))
    model = quality.train(docs.where("doc_id % 4 <> 1"), rated.where("doc_id % 4 <> 1"))
    assert (np.diff(model.thresholds) > 0).all()
    held = quality.score(docs.where("doc_id % 4 = 1"), model).join(rated, "doc_id").select("grade", "tail_probability", "expected_grade").toPandas()
    right = (held.tail_probability >= 0.5) == (held.grade == 2)
    assert right.mean() > 0.95
    assert held.expected_grade.between(0, 2).all()


def test_classifier_on_odd_tables(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_good(docs, none).count() == len(rows)
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, None), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, some.select("doc_id", quality.grade_of().alias("grade")))).count() == len(rows)
    assert quality.select_good(empty, some).count() == 0


def test_mix_agrees_with_sql(spark, docs, empty, rows, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, queries.op5_weighted_mix(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in sorted(con.execute(queries.SQL["op5_weighted_mix"]).fetchall(), key=str)]
    assert all(r[4] <= 2 * r[1] for r in got)
    assert mixing.mix_documents(empty, labels).count() == 0
    kept = mixing.mixed_corpus(docs, labels)
    takes = collections.Counter()
    for r in mixing.mix_documents(docs, labels).collect():
        takes[r["row_hash"]] = max(takes[r["row_hash"]], r["epochs"] + r["chosen"])
    assert kept.columns == docs.columns
    assert collections.Counter(r["h"] for r in kept.select(F.xxhash64(*docs.columns).alias("h")).collect()) == collections.Counter(x for r in docs.select(F.xxhash64(*docs.columns).alias("h")).collect() for x in [r["h"]] * takes[r["h"]])


def test_mix_reaches_targets(spark):
    rnd = random.Random(2)
    sized = spark.createDataFrame([(i, f"s{min(i % 9, 3)}", rnd.randint(1, 50), rnd.random() + 0.1) for i in range(4000)], "doc_id long, source string, size long, q double")
    got = mixing.mix_sources(sized, quality="q").toPandas()
    got["taken"] = got["size"] * (got.epochs + got.chosen)
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 50).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3


def plain_fingerprint(text):
    """A bit at a time, by the contract's words."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    grams = [" ".join(found[i : i + 4]) for i in range(max(len(found) - 3, 1))] if found else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(rows):
    fps = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    groups = [{i} for i in range(len(fps))]
    for i, (_, x) in enumerate(fps):
        for j, (_, y) in enumerate(fps[:i]):
            if (x ^ y).bit_count() <= 4 and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[i]:
                    groups[k] = groups[i]
    return sorted(((d, f, min((fps[k][0] for k in groups[i] if fps[k][0] is not None), default=None)) for i, (d, f) in enumerate(fps)), key=str)


@pytest.mark.parametrize("kept", [3, 5])
def test_every_grid_of_blocks_is_complete(spark, kept):
    rnd = random.Random(kept)
    points = [rnd.getrandbits(64) for _ in range(150)]
    points += [p ^ sum(1 << b for b in rnd.sample(range(64), 4)) for p in points]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 4, kept=kept)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in zip(signed, signed[150:]))
    assert simhash.blocks_kept(10**5, 4) == 3 and simhash.blocks_kept(10**9, 4) >= 5


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cell_rows", [2048, 9])
def test_near_copies_go_and_one_of_each_class_stays(spark, cell_rows):
    rnd, rows = random.Random(5), []
    for i in range(120):
        w = words(rnd, rnd.randint(200, 400)).split()
        near = list(w)
        for _ in range(len(w) // 100):
            near[rnd.randrange(len(w))] = "edited"
        assert jaccard(" ".join(w), " ".join(near)) > 0.85
        rows += [(10 * i, " ".join(w), "a"), (10 * i + 1, " ".join(near), "b")]
        if i < 20:
            rows.append((10 * i + 2, " ".join(w).upper(), "c"))
    rows += [(rows[0][0], words(rnd, 50), "other text"), (None, rows[3][1], "n"), (None, words(rnd, 40), "n"), rows[6], rows[6], (5000, None, "z"), (5001, "", "z"), (5002, " ", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = simhash.drop_near_duplicates(frame, cell_rows=cell_rows)
    assert kept.columns == frame.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    assert sum(r[0] is not None and r[0] < 5000 and r[0] % 10 == 0 for r in got) == 121  # none of the firsts goes
    assert sum(r[0] is not None and r[0] < 5000 and r[0] % 10 == 1 for r in got) <= 12
    assert sum(r[0] is not None and r[0] % 10 == 2 and r[0] < 5000 for r in got) == 0
    assert [r[1] for r in got if r[0] is None] == [rows[-6][1]] and [r[0] for r in got if r[2] == "z"] == [5000]
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [2048, 9])
def test_simhash_components_are_those_of_all_pairs(spark, docs, empty, rows, cell_rows):
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs, cell_rows=cell_rows).collect()]
    assert sorted(got, key=str) == hamming_components(rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_large_cells_are_cut_in_chunks(spark):
    """A chain of points that all lie in one another's cells, with cells of nine points at most."""
    rnd = random.Random(9)
    x, points = rnd.getrandbits(64), set()
    for _ in range(120):
        x ^= 1 << rnd.randrange(20)
        points.add(x)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points | {rnd.getrandbits(64) for _ in range(50)}], "fp long")
    for cell_rows in (2048, 9):
        links = simhash.links(frame, 4, cell_rows)
        assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
        roots = {r["node"]: r["root"] for r in components.components(links).collect()}
        signed = [p - (1 << 64) if p >> 63 else p for p in points]
        assert len({roots.get(p, p) for p in signed}) == 1


def test_manhattan_bounds_hamming():
    x, y = (np.random.default_rng(i).integers(0, 1 << 63, 5000, dtype=np.uint64) for i in (1, 2))
    p, q = simhash.embedding(x), simhash.embedding(y)
    fields = lambda v: (v[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    assert (simhash.manhattan(p, q) == np.abs(fields(p).astype(int) - fields(q).astype(int)).sum(axis=1)).all()
    assert (simhash.manhattan(p, q) <= np.bitwise_count(x ^ y)).all()


def test_components_of_random_graphs(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in expected:
                expected[x] = start
                stack += near[x]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert got == {k: v for k, v in expected.items() if k != v}


def test_line_dedup_agrees_with_a_plain_version(docs, empty, rows):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c < "\x80" else c for c in x.strip(white))
    holders = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                holders[key(x)].add(d)
    expected = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        expected.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = linededup.digests(docs, linededup.keep_bitmaps(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(r["n_dropped"] for r in got) > 0
    assert linededup.keep_bitmaps(empty).count() == 0


def test_bitmaps_round_trip():
    lines = list(range(1000))
    assert linededup.kept_lines(lines, linededup.bitmap(1000, [3, 999, 0])) == [x for x in lines if x not in (0, 3, 999)]


def text_hash(text):
    return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_rows_of_one_doc_id_are_spread_and_in_order(spark, ranges):
    """A third of all rows have no doc_id and a third have the same one."""
    table = [(None, f"n{i}") for i in range(300)] + [(5, f"f{i}") for i in range(299)] + [(5, None)] + [(i, f"t{i}") for i in range(300) if i != 5]
    random.Random(4).shuffle(table)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    expected = [(hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest(), d) for (d, t), (_, f) in zip([(d, t or "") for d, t in ordered], [(d, t or "") for d, t in ordered[1:] + ordered[:1]])]
    placed = in_order(docs, "text", ranges)
    most = max(r["count"] for r in placed.groupBy("range").count().collect())
    assert most <= 3 * len(table) / ranges + 20
    got = [(r["edited_sha256"], r["doc_id"]) for r in sketches.edited_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_sketches_of_edited_texts(docs, empty, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    texts = [r[1] or "" for r in ordered]
    expected = []
    for r, t, f in zip(ordered, texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        a, b, c = sketches.sketches(pa.array([t, edited, f]))
        expected.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), sketches.to_text(a), sketches.to_text(b), sketches.resemblance(a, b), sketches.resemblance(a, c)))
    got = sketches.edited_fingerprints(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sketches.edited_fingerprints(empty).count() == 0
    assert sorted(map(tuple, sketches.fingerprint(docs).collect()), key=str) == sorted([(e[0], e[3]) for e in expected], key=str)


def test_sketch_estimates():
    rnd = random.Random(1)
    a, b = words(rnd, 3000).split(), words(rnd, 3000).split()
    one, two = " ".join(a), " ".join(a[:2000] + b[:2000])
    x, y = sketches.sketches(pa.array([one, two]))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = len(grams(one) & grams(two)) / len(grams(one) | grams(two))
    assert abs(sketches.resemblance(x, y) - true) < 0.15
    assert abs(sketches.distinct_shingles(x) / len(grams(one)) - 1) < 0.3
    assert abs(sketches.containment(x, y) - 2 / 3) < 0.2
    parts = sketches.sketches(pa.array([" ".join(a[:1500]), " ".join(a[1496:])]))
    assert (sketches.merge(*parts) == x).all()
    assert (sketches.from_text(sketches.to_text(x)) == x).all()


PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counts(rows):
    ids = Encoder(PATH).whole([r[1] or "" for r in rows])
    return [(r[0], len(i) + 1, zlib.crc32(np.append(i, 0).astype("<u4").tobytes())) for r, i in zip(rows, ids)]


def test_words_encode_as_whole_texts():
    encoder, rnd = Encoder(PATH, pool_bytes=5000), random.Random(3)
    letters = [*"ab AB  \n\t.,'s123!é", " ", "日本", "\x1c", "\x85", "<|endoftext|>", "😀", "\r\n", " ", "　"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for i in range(0, 3000, 500):
        assert encoder.encode_each(pa.array(texts[i : i + 500])) == [x.tobytes() for x in encoder.whole(texts[i : i + 500])]


@pytest.mark.parametrize("block_tokens", [1 << 21, 64, 1])
def test_separator_scan_counts_tokens(docs, empty, counts, block_tokens):
    if block_tokens == 1:
        docs, counts = docs.where("length(text) < 200"), [c for c in counts if c[1] < 0]
        got = separators.token_counts(docs, PATH, block_tokens=7)
        assert got.count() == docs.count()
        return
    got = separators.token_counts(docs, PATH, block_tokens=block_tokens)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=str) == sorted(((c[0], c[1]) for c in counts), key=str)
    assert separators.token_counts(empty, PATH).count() == 0


def test_separator_scan_of_any_file(spark, tmp_path):
    rnd = np.random.default_rng(3)
    listed, expected = [], []
    for f, n in enumerate((0, 1, 100, 1000)):
        ids = rnd.choice([0, 5, 6, 7], n, p=[0.1, 0.3, 0.3, 0.3]).astype("<u2")
        ids[: n // 2] = np.where(rnd.random(n // 2) < 0.99, 5, ids[: n // 2])
        (tmp_path / str(f)).write_bytes(ids.tobytes())
        listed.append((f, str(tmp_path / str(f)), n))
        ends = (np.flatnonzero(ids == 0) + 1).tolist()
        starts = [0, *ends]
        expected += [(f, i, s, e - s, True) for i, (s, e) in enumerate(zip(starts, ends))]
        if starts[-1] < n:
            expected.append((f, len(ends), starts[-1], n - starts[-1], False))
    for block in (1, 7, 100, 5000):
        got = separators.scan_flat(spark.createDataFrame(listed, "file int, path string, n_tokens long"), 0, block)
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_sstables_round_trip(spark, docs, empty, counts, rows):
    manifest = sstable.write_shards(docs, PATH)
    got = sstable.read_shards(manifest).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(counts, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    readers = [sstable.Reader(r["path"]) for r in manifest.collect()]
    for d, n, _ in counts:
        found = [x for reader in readers for x in reader.get(d)]
        assert sum(c[0] == d for c in counts) == len(found) and n in map(len, found)
    assert not any(reader.get(2) or reader.get(-5) for reader in readers)
    assert sstable.read_shards(sstable.write_shards(empty, PATH)).count() == 0


def test_sstable_blocks(tmp_path):
    system, path = files.at(f"file://{tmp_path}/x.sst")
    writer = sstable.Writer(system.open_output_stream(path))
    rnd = np.random.default_rng(0)
    values = {k: rnd.integers(0, 60000, rnd.integers(0, 9000), dtype=np.uint16) for k in range(-50, 50)}
    for k, v in values.items():
        writer.add(sstable.key_of(k), v.tobytes())
    writer.close()
    reader = sstable.Reader(path)
    assert reader.blocks > 3 and reader.entries == 100
    assert all((reader.get(k)[0] == v).all() for k, v in values.items())
    raw = bytearray((tmp_path / "x.sst").read_bytes())
    raw[100] ^= 1
    (tmp_path / "x.sst").write_bytes(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(path).scan())
