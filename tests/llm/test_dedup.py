import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from snippetflow.llm import exact_dedup, ngram_join, substrings


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_exact_groups_and_filter(spark):
    rows = brute.awkward()
    df = brute.frame(spark, rows)
    for size in (8192, 16):
        got = exact_dedup.exact_groups(df, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute.exact(rows), key=key)
        by = {}
        for r in got:
            by.setdefault(r.text_sha256, []).append(r.kept)
        assert all(sum(x) == 1 for x in by.values())
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len(by)


def test_exact_names_survive_hash_collisions(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda c: F.octet_length(c).cast("long") % 3)
    rows = brute.awkward(30)
    got = exact_dedup.exact_groups(brute.frame(spark, rows), block_bytes=16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute.exact(rows), key=key)


@pytest.mark.parametrize("options", [{}, {"block": 8}, {"often": 0, "most": 3}])
def test_near_groups(spark, options):
    rows = brute.awkward(150)
    got = ngram_join.near_groups(brute.frame(spark, rows), **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=key) == sorted(brute.near(rows), key=key)


def test_near_filter_keeps_one_of_each_component(spark):
    rows = brute.awkward(80)
    df = brute.frame(spark, rows)
    groups = ngram_join.near_groups(df).collect()
    named = {r.component_id for r in groups if r.n_shingles}
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len(named) + sum(r.n_shingles == 0 for r in groups)


def test_hot_near_group_is_split(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != i % 60) + (f" t{i}" if i % 3 else "")) for i in range(300)]
    got = ngram_join.near_groups(brute.frame(spark, rows, extra=False), block=32).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(brute.near(rows))


@pytest.mark.parametrize("each", [0, 1, 10**6])
def test_near_groups_by_lists_and_forests(spark, each):
    rows = brute.awkward(120) + [(1000 + i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(40)]
    got = ngram_join.near_groups(brute.frame(spark, rows), each=each).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=key) == sorted(brute.near(rows), key=key)


def test_shared_passages_do_not_chain_unlike_documents(spark, monkeypatch):
    met, tasks = [], ngram_join._tasks
    monkeypatch.setattr(ngram_join, "_tasks", lambda members, *a: (met.append(members.count()), tasks(members, *a))[1])
    passage = [" ".join(f"p{i}.{j}" for j in range(20)) for i in range(201)]
    rows = [(i, f"{passage[i]} {' '.join(f'own{i}.{j}' for j in range(60))} {passage[i + 1]}") for i in range(200)]
    rows += [(500, rows[7][1] + " more"), (501, rows[9][1][:-6])]
    got = ngram_join.near_groups(brute.frame(spark, rows, extra=False)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(brute.near(rows))
    assert met == [4]


def test_sketches_never_rule_out_similar_sets():
    rnd = random.Random(3)
    for n in (1, 5, 255, 256, 257, 512, 700, 3000):
        a = {rnd.getrandbits(64) for _ in range(n)}
        for change in (0, 1, n // 10, n // 5, n):
            b = set(list(a)[change:]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(change + 1))} or {1}
            x, y = (ngram_join.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
            assert ngram_join.least_difference(x, y) == ngram_join.least_difference(y, x) <= len(a ^ b)
        other = ngram_join.sketch(np.array(sorted(rnd.getrandbits(64) for _ in range(n)), np.uint64))
        assert ngram_join.least_difference(ngram_join.sketch(np.array(sorted(a), np.uint64)), other) > n // 3


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_repeats(spark, hot):
    rows = [(i, t[:3000] if t else t) for i, t in brute.awkward(50)]
    df = brute.frame(spark, rows)
    got = [tuple(r) for r in substrings.drop_repeats(df, hot=hot).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows]), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length", [200, 400, 600])
def test_repeats_of_any_length(spark, length):
    rnd = random.Random(length)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, passage + "x" * 50), (2, "y" * 70 + passage), (3, passage[:length - 1]), (4, passage[1000:1000 + length])]
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeats(brute.frame(spark, rows), length=length).collect()}
    assert got == {1: 3000, 2: 3000, 3: 0, 4: length}


def test_kept_bytes_are_the_text_left(spark):
    rows = [(1, "a" * 50 + "0123456789" * 30 + "b"), (2, "0123456789" * 25), (3, "short")]
    got = {r.doc_id: r for r in substrings.drop_repeats(brute.frame(spark, rows, extra=False), keep_text=True).collect()}
    assert got[2].n_removed == 250 and bytes(got[2].kept) == b""
    assert bytes(got[1].kept) == b"a" * 50 + b"b"
    assert got[3].kept is None and got[3].kept_sha256 == brute.sha("short")


def test_empty_tables(spark):
    df = brute.frame(spark, [], extra=True)
    assert exact_dedup.exact_groups(df).count() == 0
    assert exact_dedup.drop_exact_copies(df).columns == df.columns
    assert ngram_join.near_groups(df).count() == 0
    assert ngram_join.drop_near_copies(df).count() == 0
    assert substrings.drop_repeats(df).count() == 0


@pytest.mark.parametrize("task_edges", [500_000, 20])
def test_components(spark, task_edges):
    import random
    from snippetflow.llm.common import components
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(200, 100 + i) for i in range(50)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    edges += [(7, 7), (None, 3), edges[0]]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = components(df, task_edges=task_edges).collect()
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert sorted((r.node, r.comp) for r in got) == sorted(want.items())
