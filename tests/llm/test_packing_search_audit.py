"""Packing, ranked search and the audit of filters against plain versions."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import audit, lexical, packing
from corpusloom.llm.tokens import Encoder, WordEncoder
from tests.llm.test_operators import words

WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["row", "bin", "offset", "sequence_id", "length", "n", "terms", "at", "score", "rank", "mask", "part", "a.b", "c`d"]


def clash(frame):
    return frame.select("*", *[F.lit("taken").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def rows():
    """Copies, ties, null ids and texts, empty and very long texts, repeated rows, special tokens, scripts."""
    rnd = random.Random(31)
    texts = [words(rnd, rnd.randint(1, 300)) for _ in range(60)]
    texts += [texts[0]] * 5 + [None, "", " \n", words(rnd, 15_000), "X" * 30_000, "İstanbul's CAFÉ, naïve. 漢字 <|endoftext|> <|ENDOFTEXT|> don't!", "A B C " * 60, "$ up"]
    out = [(i * 7 % 101, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[1], "en"), (None, texts[1], "en"), (None, None, None), (out[5][0], "other text under one id", "de")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).cache()


@pytest.mark.parametrize(("path", "kind"), [(BYTE_PATH, Encoder), (WORD_PATH, WordEncoder)])
def test_ids_are_those_of_the_library(path, kind):
    rnd, library, encoder = random.Random(4), Tokenizer.from_file(path), kind(path, pool_bytes=20_000)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", *"    \n\t\r\x0b\x1c\x00", "\u0085", " ", "　", "é", "é", "́", "aB", "It's", "'s", "12", "!?", "漢字", "😀", "ß", "İ", "Σς", "don't", "word", "ﬁ", ",", "("]
    for _ in range(30):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [None, ""]
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert encoder.encode_each(pa.array(texts)) == want


def test_special_tokens_are_text_where_asked():
    ids = Encoder(BYTE_PATH, plain=True).encode(pa.array(["a <|endoftext|> b", "<|endoftext|>"]))[0]
    assert 50256 not in ids.tolist()


def packed(found):
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == list(itertools.accumulate([0, *[n for _, n in sorted(own)]]))[:-1]
    return {s: sum(n for _, n in own) for s, own in by.items()}


def test_pieces_are_all_ids_and_sequences_are_full(docs, rows):
    found = packing.packed_documents(docs, WORD_PATH, 1, capacity=256).collect()
    library, want = Tokenizer.from_file(WORD_PATH), collections.Counter()
    for doc, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((doc, i // 256, i, len(ids[i : i + 256]), zlib.crc32(ids[i : i + 256].tobytes())) for i in range(0, len(ids), 256))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    fills = packed(found)
    assert max(fills.values()) <= 256 and sum(2 * f <= 256 for f in fills.values()) <= 1
    assert packing.packed_documents(docs.limit(0), WORD_PATH, 1).count() == 0


@pytest.mark.parametrize(("sizes", "parts", "fan_in"), [
    ([rnd for rnd in random.Random(1).choices(range(1, 101), k=3000)], 30, 2),
    ([51] * 300, 12, 3), ([1] * 500, 20, 2), ([100] * 40, 5, 8), ([60, 40] * 200, 25, 4), ([7], 9, 2), (random.Random(2).choices([30, 34, 50, 97], k=999), 16, 8),
])
def test_the_tree_leaves_few_underfull_bins(spark, sizes, parts, fan_in):
    found = spark.createDataFrame([(i, n, "taken") for i, n in enumerate(sizes)], "id long, length int, bin string")
    got = packing.pack(found, 100, fan_in, parts)
    assert got.columns == ["id", "length", "bin", "sequence_id", "offset"]
    out = got.collect()
    assert sorted((r["id"], r["length"]) for r in out) == list(enumerate(sizes))
    fills = packed(out)
    assert max(fills.values()) <= 100
    assert sum(2 * f <= 100 for f in fills.values()) <= 1  # any two could be one
    bins = packing.Bins(100)
    whole = len({bins.place(n, i)[0] for i, n in enumerate(sorted(sizes, reverse=True))})  # best-fit in one task
    assert len(fills) <= 1.03 * whole + parts  # of 30 to 100 items each


def test_partitions_of_many_pieces_pack_as_one_does(spark):
    sizes = random.Random(3).choices(range(1, 4097), k=20_000)
    fills = packed(packing.pack(spark.createDataFrame([(n,) for n in sizes], "length int"), parts=4).collect())
    assert sum(fills.values()) == sum(sizes) and len(fills) <= 1.015 * sum(sizes) / 4096


def test_a_node_hands_on_what_later_rounds_can_use():
    moves, left = packing.merge([(1, 60), (2, 55), (3, 48), (4, 90), (5, 99)], 100, fan_in=2)
    assert moves == []
    assert left == [(3, 48), (2, 55), (1, 60)]
    assert packing.merge([(1, 60), (2, 40), (3, 10)], 100, fan_in=2) == ([(2, 1, 60)], [(3, 10)])
    assert packing.merge([(1, 50), (2, 50), (3, 20), (4, 79)], 100, fan_in=1) == ([(2, 1, 50), (3, 4, 79)], [(4, 99)])


def ranked(rows, items, k):
    """The scores, straight from their definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [collections.Counter(term.findall((t or "").translate(lower))) for _, t, *_ in rows]
    n = [sum(b.values()) for b in bags]
    many, total = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        wanted = collections.Counter(term.findall((text or "").translate(lower)))
        scores = []
        for (doc, *_), bag, length in zip(rows, bags, n):
            m = 100 - 75 + (75 * length * many) // total
            score = sum(c * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in wanted.items() if bag[t])
            scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:k]) if s < 0]
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "points", "block"), [(1, 7, 1 << 20), (2, 16, 400), (32, 8192, 1 << 20)])
def test_search_is_exact(spark, docs, rows, leaf, points, block):
    rnd = random.Random(leaf)
    items = [(i, words(rnd, rnd.randint(1, 25))) for i in range(12)]
    items += [(3, "W1 w1 w1 W2"), (50, None), (51, ""), (52, "nothing-of-this"), (None, "w7 CAFÉ café 漢字"), (53, "x" * 30_000), (54, "up İstanbul's")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(docs, clash(asked), 10, leaf=leaf, block_points=points, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, items, 10)
    assert lexical.search(docs.limit(0), asked).count() == 0
    assert lexical.search(docs, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, 40, rnd.integers(1, 6)) + 40 * (i % 8)) for i in range(2000)]
    first, term = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    value = rnd.integers(1, 1_000_000, len(term))
    tree = lexical.BallTree(first, term, value, 320, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(2000))
    for _ in range(20):
        wanted = np.unique(rnd.integers(0, 320, 9))
        weights = rnd.integers(1, 25_000, len(wanted))
        dense = np.zeros(320, np.int64)
        dense[wanted] = weights
        scores = np.add.reduceat(dense[term] * value, first[:-1])
        bounds = tree.bounds(wanted, weights)
        under = {}

        def members(i):
            left, right, a, b = tree.nodes[i]
            under[i] = tree.order[a:b].tolist() if left < 0 else members(left) + members(right)  # noqa: B023
            return under[i]  # noqa: B023

        members(0)
        assert all(bounds[i] >= scores[own].max() for i, own in under.items())
        best = []

        def take(points, found):
            best.extend(found.tolist())  # noqa: B023
            best.sort(reverse=True)  # noqa: B023
            del best[5:]  # noqa: B023

        seen = tree.search(wanted, weights, take, lambda: best[-1] if len(best) == 5 else 1)  # noqa: B023
        assert best == sorted(scores.tolist(), reverse=True)[:5]
        assert seen < 1500


def test_terms_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr(lexical.Words, "hashes", lambda self: np.minimum(self.ends - self.starts, 3).astype(np.uint64))
    vocabulary = lexical.Vocabulary(["ab", "abcdefghij", "abcdefghik", "zz"])
    n, first, term, count = vocabulary.vectors(pa.array(["zz ab abcdefghik xy abcdefghij abcdefghik", None, "abc ZZ"]))
    assert n.tolist() == [6, 0, 2]
    assert [dict(zip(term[a:b].tolist(), count[a:b].tolist())) for a, b in zip(first, first[1:])] == [{0: 1, 1: 1, 2: 2, 3: 1}, {}, {3: 1}]


def audited(rows, labels):
    """All 120 orders, document by document."""
    masks, smallest = [], {}
    for doc, text, _ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    for doc, text, lang in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and doc > smallest[text]}
        mine = [(q, t) for d, q, t in labels if d == doc and doc is not None]
        masks.append((lang or "", {f for f, x in fails.items() if x}, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = {}
    for part in {m[0] for m in masks}:
        own, shapley = [m for m in masks if m[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                alive = [m for m in alive if f not in m[1]]
                failing = [m for m in own if f in m[1]]
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[f] += len(gone)
        for order, step in [(o, s) for p, o, s in out if p == part]:
            out[part, order, step].append(shapley[order[step - 1]])
    return out


def test_audit_counts_every_order(spark, docs, rows):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 3)] + [(3, 0, 1), (6, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, clash(table)).collect()
    want = audited(rows, labels)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(got) == len(want) == 600 * len({p for p, _, _ in want})
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == want
    assert audit.audit(docs.limit(0), table).count() == 0


def test_audit_takes_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["toxic_lost"]) for r in audit.interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 3, 0, 2), ("XY", 2): (5, 0, 3, 0), ("YX", 1): (5, 3, 0, 2), ("YX", 2): (5, 0, 3, 0)}
    with pytest.raises(ValueError):
        audit.prefixes(spark, "ABCDEFG")
