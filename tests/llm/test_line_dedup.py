import random

from tessera.llm.line_dedup import dedup_documents, line_dedup, repeated_runs

from .helpers import SCHEMA, edge_texts, line_cuts, rows, words


def _texts():
    rng = random.Random(3)
    pool = ["a b", "c", "d e f g h", "i j k", "long line of more than five words", "x", "y y", "  ", "", "The. end"]
    made = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return edge_texts() + made + ["A\nA\nA\nA\nA\nA\nA"] * 2 + ["\n".join(f"l{i % 7} w" for i in range(400))]


def test_against_brute_force(spark):
    data = rows(_texts())
    df = spark.createDataFrame(data, SCHEMA)
    for m in (1, 3, 5, 9):
        want = line_cuts([(d[0], d[1]) for d in data], m)
        got = {r.row.doc_id: (r.text, r.n_deleted) for r in line_dedup(df, m).collect()}
        assert got == want


def test_documents_keep_columns_and_nulls(spark):
    data = rows(_texts())
    data += [data[8], (None, "d e f g h", None, None, 9, 1, "r", "k", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    out = dedup_documents(df)
    assert out.columns == df.columns and out.count() == len(data)
    got = out.collect()
    assert [r.text for r in got if r.doc_id == 0] == [None]
    assert [r.text for r in got if r.doc_id is None] == ["d e f g h"]  # null ids come first
    assert len({r.text for r in got if r.doc_id == 8}) == 1  # equal rows, equal results
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None and r.doc_id != 0)


def test_rows_that_come_twice_change_nothing(spark):
    """Two documents whose first lines are alike but hold four words: each twice, and all the texts each twice."""
    near = ["a\nb c\nd\ne", "a\nb c\nd\nf"]
    data = rows(near)
    got = {(r.row.doc_id, r.text, r.n_deleted) for r in line_dedup(spark.createDataFrame(data + data, SCHEMA), tails=True).collect()}
    assert got == {(i, t, 0) for i, t in enumerate(near)}
    data = rows(_texts())
    for tails in (False, True):
        once = line_dedup(spark.createDataFrame(data, SCHEMA), tails=tails).collect()
        twice = line_dedup(spark.createDataFrame(data + data, SCHEMA), tails=tails).collect()
        key = lambda r: (r.row.doc_id, r.text or "", r.n_lines, r.n_deleted, r.n_runs)
        assert sorted(map(key, twice)) == sorted(2 * [*map(key, once)])
        if not tails:
            want = line_cuts([(d[0], d[1]) for d in data], 5)
            assert {r.row.doc_id: (r.text, r.n_deleted) for r in twice} == want


def test_runs_and_empty_table(spark):
    df = spark.createDataFrame(rows(["a b\nc d\ne f", "z\na b\nc d\ne f\nq"]), SCHEMA)
    assert [(r.doc_id, r.start, r.n_lines) for r in repeated_runs(df).collect()] == [(1, 1, 3)]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_lose_maximal_runs_to_their_ends(spark):
    texts = ["a b c d e f\ng h\nq", "z\na b c d e f\ng h\ny"] + [t for t in _texts() if t is None or len(t) < 1000]
    data = rows(texts)
    got = {r.doc_id: r.text for r in dedup_documents(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1] == "z\ny"
    seen, want = set(), {}
    for d, text in enumerate(texts):
        every = (text or "").split("\n")
        full = [j for j, x in enumerate(every) if words(x)]
        gone = set()
        for i in range(len(full)):
            for j in range(i, len(full)):
                run = tuple(every[x] for x in full[i : j + 1])
                if sum(len(words(x)) for x in run) >= 5:
                    if run in seen:
                        gone |= set(full[i : j + 1])
                    seen.add(run)
        want[d] = None if text is None else "\n".join(x for j, x in enumerate(every) if j not in gone)
    assert got == want


def test_a_long_run_is_one_interval(spark):
    run = [f"line {i % 40} of {i // 3}" for i in range(300)]
    texts = ["\n".join(run), "start\n" + "\n".join(run) + "\nend", "other\n" + "\n".join(run[40:90]) + "\nend"]
    got = sorted((r.doc_id, r.start, r.n_lines, r.first_doc, r.first_start) for r in repeated_runs(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    assert got == [(1, 1, 300, 0, 0), (2, 1, 50, 0, 40)]


def test_hot_ranks_are_split(spark, monkeypatch):
    from tessera.llm import common, line_dedup as module

    df = spark.createDataFrame(rows(_texts() + [f"d e f g h\nx{i} y\nd e f g h\nx{i} y" for i in range(60)]), SCHEMA)
    want = sorted((str(r.row.doc_id), r.text) for r in line_dedup(df, 5, True).collect())
    monkeypatch.setattr(module, "RANK_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted((str(r.row.doc_id), r.text) for r in line_dedup(df, 5, True).collect()) == want
