"""The five stages one after another over planted copies, edges and clashing columns."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.pieces import decode_documents

from .helpers import near_components, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, _gone int, id string, size long, token_ids string"


def _lines(seed):
    words = prose(seed, 1, 144)[0].split()
    return [" ".join(words[i : i + 12]) for i in range(0, 144, 12)]


def _tables(spark, folder, texts):
    rows = [(i, t, ["aa", None][j % 2], ["s1", "s2", None][j % 3], len(t) if t is not None else None, "r", 1, "x", 5, "t") for j, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t in texts if i is not None], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def _stages(docs, folder, spark):
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(folder))
        got.write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def test_five_stages(spark, tmp_path):
    rng = random.Random(3)
    base = [_lines(s) for s in range(50, 54)]
    near = []
    for lines in base:
        for _ in range(2):
            copy = [x if rng.random() < 0.8 else x.replace(x.split()[3], f"q{rng.randrange(999)}") for x in lines]
            near.append("\n".join(copy))
    clean = prose(60, 40, 50)
    toxic = [f"{t} vile vile nasty" for t in prose(61, 40, 30)]
    texts = [(i, t) for i, t in enumerate(["\n".join(x) for x in base] + near + clean + toxic)]
    texts += [(200, None), (201, ""), (202, " \n\t"), (203, "word " * 20000), (None, clean[0] + " without id"), texts[5], texts[14]]
    docs = _tables(spark, tmp_path, texts)
    out = _stages(docs, tmp_path, spark)
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in out.items()}
    for name in ("toxicity", "line_dedup", "near_duplicates", "mixing"):
        assert out[name].columns == docs.columns
    first_toxic = len(base) + len(near) + len(clean)
    kept = set(ids["toxicity"])
    assert len(kept & set(range(first_toxic, first_toxic + 40))) <= 2
    assert kept >= set(range(first_toxic)) | {200, 201, 202, 203, None}
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["toxicity"]))
    # of documents that were alike as they were read, no stump stays; every clean one does, once
    left = ids["near_duplicates"]
    alike = near_components([(i, t) for i, t in texts[:first_toxic]], 5, 80)
    gone = {i for i, (_, first) in alike.items() if first != i}
    assert len(gone) >= 4 and gone <= set(range(len(base), len(base) + len(near))) and not set(left) & gone
    assert set(left) >= set(range(len(base))) | set(range(len(base) + len(near), first_toxic)) | {None}
    assert len(left) == len(set(left))
    mixed = out["mixing"].collect()
    assert all((r.text or "").split() for r in mixed) and {r.doc_id for r in mixed} <= set(left)
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2
    tokens = decode_documents(out["sentencepiece"])
    texts_of = {(r.doc_id, r.text) for r in mixed}
    assert {(r.doc_id, r.decoded) for r in tokens.collect()} == texts_of and tokens.count() == len(mixed)


def test_nothing(spark, tmp_path):
    docs = _tables(spark, tmp_path, [(1, "a")]).filter(F.lit(False))
    docs.write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    empty = spark.read.parquet(f"{tmp_path}/none/documents.parquet")
    out = _stages(empty, f"{tmp_path}/none", spark)
    assert [d.count() for d in out.values()] == [0] * 6
