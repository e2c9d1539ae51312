"""Edit scripts of lines against the longest common subsequence, and the query over documents."""

import random
import time

from hypothesis import given, settings, strategies as st

from corpusloom import catalog
from corpusloom.operators.linediff import hunks, matches


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def check(a, b, **limit):
    found = matches(a, b, **limit)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    return len(found)


lines = st.lists(st.integers(0, 5), max_size=30)


@settings(max_examples=400, deadline=None)
@given(lines, lines)
def test_scripts_are_shortest(a, b):
    assert check(a, b) == longest(a, b)


@settings(max_examples=100, deadline=None)
@given(lines, lines, st.integers(0, 3))
def test_scripts_beyond_the_effort_are_valid(a, b, effort):
    assert check(a, b, effort=effort) <= longest(a, b)
    rebuilt = [x for went, came in hunks(list(map(str, a)), list(map(str, b)), effort) for x in came]
    assert len(rebuilt) == len(b) - check(a, b, effort=effort)


def test_long_versions_take_seconds():
    rnd = random.Random(1)
    a = [rnd.randrange(50_000) for _ in range(100_000)]
    b = list(a)
    for _ in range(400):
        at = rnd.randrange(len(b))
        b[at : at + rnd.randrange(3)] = [rnd.randrange(50_000) for _ in range(rnd.randrange(3))]
    began = time.time()
    assert check(a, b) > 98_000
    assert check([0, 1] * 20_000, [1, 0] * 20_000) == 39_999
    assert check(list(range(100_000)), list(range(100_000, 200_000))) == 0
    check([rnd.randrange(40) for _ in range(20_000)], [rnd.randrange(40) for _ in range(20_000)], effort=300)
    assert time.time() - began < 40


def test_query_counts_the_lines_of_shortest_scripts(spark, sf_dir):
    texts = {r["doc_id"]: [x.rstrip() for x in (r["text"] or "").replace("\r\n", "\n").split("\n") if x.strip()] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.queries()["version_diffs"](spark, sf_dir).collect()}
    assert set(got) == {d for d in texts if d - 1 in texts}
    for doc, r in got.items():
        a, b = texts[doc - 1], texts[doc]
        if any(x.startswith(("--", "++")) for x in a + b):
            continue
        common = longest(a, b)
        changed = len(a) + len(b) - 2 * common
        assert (r["added_lines"], r["removed_lines"], r["diff_truncated"]) == (len(b) - common, len(a) - common, changed > 40)
