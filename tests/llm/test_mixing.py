import heapq
from collections import defaultdict

from tessera.llm.mixing import apportion, mix, mix_documents

from .helpers import SCHEMA, edge_texts, prose, rows, words


def test_apportion_is_sainte_lague(spark):
    data = [("g", n, w, 37, 30) for n, w in [("a", 50.0), ("b", 21.0), ("c", 21.0), ("d", 7.5), ("e", 0.4)]] + [("h", "a", 3.0, 5, 2), ("h", "b", 1.0, 5, 9)]
    out = {(r.g, r.n): r.q for r in apportion(spark.createDataFrame(data, "g string, n string, w double, seats long, cap long"), ["g"], "w", "seats", "cap", ["n"], "q").collect()}
    for g, seats in (("g", 37), ("h", 5)):
        won, heap = defaultdict(int), []
        for r in data:
            if r[0] == g:
                heapq.heappush(heap, (-r[2], r[1], r[2], 1, r[4]))
        for _ in range(seats):
            _, n, w, k, cap = heapq.heappop(heap)
            won[n] += 1
            if k < cap:
                heapq.heappush(heap, (-w / (2 * k + 1), n, w, k + 1, cap))
        assert {n: q for (x, n), q in out.items() if x == g} == {r[1]: won[r[1]] for r in data if r[0] == g}


def test_mix_of_edge_documents(spark):
    texts = edge_texts() + prose(5, 60, 80)
    data = rows(texts)
    data += [data[6], data[6]]  # repeated rows
    df = spark.createDataFrame(data, SCHEMA)
    out = mix(df, shard_words=700).collect()
    assert len(out) == len(data)
    assert sorted((r.doc_id, r.size) for r in out) == sorted((d[0], len(words(d[1]))) for d in data)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(s == r.source_size for r in out for s in [size[r.source]])
    # water-filling by hand
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_, budget = {}, set(order), 1.5 * sum(size.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            want[s] = 2.0 * size[s]
            budget -= want[s]
        open_ -= full
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 16 * 8 + 0.01 * want[s]
    again = mix(df.repartition(7), shard_words=700).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in out) == sorted((r.doc_id, r.size, r.taken) for r in again)


def test_small_sources_meet_their_targets_beside_a_large_one(spark):
    """A source of 60 short documents beside one of 20 and more shards: each within a block a shard."""
    made = [("large", i, 300) for i in range(900)] + [("small", 1000 + i, 6) for i in range(60)] + [("middle", 2000 + i, 200) for i in range(60)]
    data = [(i, "w " * n, None, s, None, 1, "r", "k", 1) for s, i, n in made]
    df = spark.createDataFrame(data, SCHEMA)
    taken, target, size = defaultdict(int), {}, {}
    for r in mix(df, shard_words=12_000).collect():
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert -(-size["large"] // 12_000) > 20
    for s in target:
        assert abs(taken[s] - target[s]) <= 16 * -(-size[s] // 12_000), (s, taken[s], target[s])


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame(rows([None, ""]), SCHEMA)).count() == 2


def test_mixed_documents_keep_their_columns(spark):
    df = spark.createDataFrame(rows(prose(2, 80, 50)), SCHEMA)
    out = mix_documents(df)
    assert out.columns == df.columns
    n = out.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert n <= 2 and abs(out.count() - 120) < 12


def test_mixed_long_documents_meet_the_targets(spark):
    """Long documents, leftover shares under and over a half: no source loses or gains all its copies."""
    data = rows([t for n in (320, 500, 32) for t in prose(n, 120, n)])
    df = spark.createDataFrame(data, SCHEMA)
    for budget in (0.6, 1.5):
        target = {r.source: r.target for r in mix(df, budget=budget).collect()}
        got = defaultdict(int)
        for r in mix_documents(df, budget=budget).collect():
            got[r.source] += len(words(r.text))
        assert all(abs(got[s] - t) <= 0.1 * t for s, t in target.items()), (got, target)
