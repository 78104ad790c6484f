import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, near_dup
from tessera.llm.components import components, smallest
from tessera.llm.near_dup import dedup_documents, near_duplicates

from .helpers import SCHEMA, edge_texts, near_components, prose, rows


def _variants(seed, groups, each, words=80, edits=6):
    rng, out = random.Random(seed), []
    for text in prose(seed, groups, words):
        for _ in range(each):
            w = text.split()
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    data = rows(edge_texts() + _variants(1, 12, 8) + _variants(2, 1, 90) + ["a b c", "A B  c", "a b", "b"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(data, SCHEMA), k, percent).collect()}
    assert got == near_components([(d[0], d[1]) for d in data], k, percent)


def test_large_nodes_are_complete(spark, monkeypatch):
    """With tiny nodes, everything goes through pivots, branching, salts and the leftovers."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "SALT_ROWS", 25)
    data = rows(_variants(7, 2, 120, edits=5) + _variants(8, 1, 60, edits=9))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(data, SCHEMA), 3, 85).collect()}
    assert got == near_components([(d[0], d[1]) for d in data], 3, 85)


def test_many_hot_nodes_are_joined(spark, monkeypatch):
    """More hot nodes than the list takes, and no broadcast."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "SALT_ROWS", 25)
    monkeypatch.setattr(near_dup, "HOT_LIST", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    data = rows(_variants(7, 2, 60, edits=5) + _variants(8, 1, 40, edits=9))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(data, SCHEMA), 3, 85).collect()}
    assert got == near_components([(d[0], d[1]) for d in data], 3, 85)


def test_a_group_in_a_crowd_with_one_common_passage(spark, monkeypatch):
    """Near copies come first in a node that many other texts share through one passage."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "SALT_ROWS", 25)
    passage = prose(31, 1, 30)[0]
    texts = [f"{passage} {t}" for t in _variants(32, 1, 40, words=90, edits=3)] + [f"{passage} {t}" for t in prose(33, 60, 60)] + [f"{passage} {t}" for t in _variants(34, 20, 2, words=60, edits=2)]
    data = rows(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(data, SCHEMA), 5, 80).collect()}
    assert got == near_components([(d[0], d[1]) for d in data], 5, 80)


def test_ids_of_text_and_a_doc_id_with_two_texts(spark):
    t = prose(9, 4, 40)
    data = [("a", t[0]), ("a", t[1]), ("b", t[0] + " x"), ("c", t[1] + " y"), ("d", t[2])]
    df = spark.createDataFrame(data, "doc_id string, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()}
    assert got == {("a", "a", True), ("b", "a", False), ("c", "a", False), ("d", "d", True)}


def test_copies_that_an_earlier_step_cut_are_found(spark):
    t = prose(41, 3, 60)
    read = [(1, t[0]), (2, t[0] + " end"), (3, t[1]), (4, t[2]), (5, t[2] + " more"), (None, t[0])]
    cut = [(1, t[0]), (2, "end"), (3, t[1]), (5, t[2] + " more"), (None, t[0])]
    schema = "doc_id long, text string, _gone int, id string"
    docs = spark.createDataFrame([(i, x, 7, "z") for i, x in cut], schema)
    kept = dedup_documents(docs, 5, 80, as_read=spark.createDataFrame(read, "doc_id long, text string"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 5}
    assert {r.doc_id for r in dedup_documents(docs, 5, 80).collect()} == {None, 1, 2, 3, 5}


def test_null_ids_repeated_ids_and_nothing(spark):
    t = prose(9, 3, 40)
    data = [(None, t[0]), (5, t[0]), (3, t[0]), (3, t[1]), (8, t[1]), (8, t[1]), (9, t[2])]
    df = spark.createDataFrame([(i, x, None, None, 1, 1, "", "", 1) for i, x in data], SCHEMA)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()))
    assert got == [(False, 0, None, True), (True, 3, 3, True), (True, 3, 3, True), (True, 5, 3, False), (True, 8, 3, False), (True, 8, 3, False), (True, 9, 9, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = dedup_documents(df, 3, 85)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, 3, 9}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_few_edges_take_no_round(spark, monkeypatch):
    """A long path and a star end in one block; more edges than FEW go by rounds, to the same roots."""
    from tessera.llm import components as c

    links = spark.createDataFrame([(i * 37 % 300, (i + 1) * 37 % 300) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)], "a long, b long").repartition(9)
    calls = []
    monkeypatch.setattr(c, "contracted", lambda df, own=c.contracted: calls.append(1) or own(df))
    once = {r.node: r.root for r in c.components(links).collect()}
    assert len(calls) == 2
    monkeypatch.setattr(c, "FEW", 0)
    assert {r.node: r.root for r in c.components(links).collect()} == once and len(calls) > 4


def test_one_row_stays_of_a_kept_doc_id(spark):
    t = prose(9, 3, 40)
    data = [(None, t[0]), (None, t[0]), (5, t[0]), (3, t[0]), (3, t[1]), (3, t[1]), (8, t[1]), (9, t[2]), (9, t[2]), (10, None), (10, None), (11, "")]
    df = spark.createDataFrame([(i, x, None, None, 1, 1, "", "", 1) for i, x in data], SCHEMA)
    kept = dedup_documents(df, 3, 85)
    low = {r.text for r in df.filter("doc_id = 3").orderBy(F.xxhash64("text")).limit(1).collect()}
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 9, 10, 11]
    assert {r.text for r in kept.collect() if r.doc_id == 3} == low


def test_a_crowd_under_salt_rows_is_not_branched():
    """200 classes that share a third of their signature, two of them alike: one pair, and no children."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import near_dup as nd

    n, rng = 200, np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (n, nd.SIGNATURE)).astype("<u2")
    sig[:, :13] = 7
    sig[150] = sig[20]
    same = {"node": 5, "salt": -1, "salts": 0, "depth": 1, "lead": 1}
    rows = pa.RecordBatch.from_pydict({**{k: [v] * n for k, v in same.items()}, "rep": list(range(n)), "n": [50] * n, "sig": [x.tobytes() for x in sig]})
    out = [r for b in nd._walk(0.8)(iter([rows])) for r in b.to_pylist()]
    assert [(r["kind"], r["rep"], r["other"]) for r in out] == [(nd.PAIR, 150, 20)]


def test_a_dense_crowd_in_one_task_sends_no_children_on():
    """300 classes in four groups that are alike, more pairs than are given: branched where they are, each pair once."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import near_dup as nd

    n, rng = 300, np.random.default_rng(4)
    group = rng.integers(0, 4, n)
    sig = rng.integers(0, 1 << 16, (n, nd.SIGNATURE)).astype("<u2")
    sig[:, :30] = group[:, None] * 100 + np.arange(30)
    same = {"node": 5, "salt": -1, "salts": 0, "depth": 1, "lead": 1}
    rows = pa.RecordBatch.from_pydict({**{k: [v] * n for k, v in same.items()}, "rep": list(range(n)), "n": [50] * n, "sig": [x.tobytes() for x in sig]})
    out = [r for b in nd._walk(0.8)(iter([rows])) for r in b.to_pylist()]
    assert {r["kind"] for r in out} <= {nd.PAIR, nd.MORE_PAIRS, nd.TIGHT}
    pairs = [(r["rep"], r["other"]) for r in out if r["kind"] != nd.TIGHT]
    assert len(pairs) == len(set(pairs))
    met = [(r["rep"], r["other"]) for r in out if r["other"] is not None]
    assert all(group[a] == group[b] for a, b in met)
    nodes, root = smallest(*np.array(met).T)
    low = {g: min(np.flatnonzero(group == g).tolist()) for g in range(4)}
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {i: low[g] for i, g in enumerate(group.tolist())}
    assert len(out) < 4 * n
