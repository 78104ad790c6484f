"""The queries of this subpackage, by operator number, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_docs(spark, sf_dir), tails=True).select("row.doc_id", "text", "n_lines", "n_deleted", "n_runs")


#: The shards of op4_sharding; a key with over one row in HOT_SHARE is spread by the text.
SHARDS = [f"shard-{i:03d}" for i in range(128)]
HOT_SHARE = 1024


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with its slot and shard by doc_id."""
    from .sharding import hot_keys, place

    docs = _docs(spark, sf_dir)
    hot = hot_keys(docs, ["doc_id"], 1 / HOT_SHARE, docs.count())
    return place(docs, ["doc_id"], SHARDS, hot=hot, spread_by=["text"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import doc_crc, score_documents, train_on

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(doc_crc() % 5 == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_segments").alias("segments"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify
    from .toxicity import doc_crc

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    net = fit(docs, doc_crc() % 3 != 1)
    held = F.coalesce(doc_crc() % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), k=3, percent=85)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(_docs(spark, sf_dir).select("doc_id", "text"), check=True).drop("text")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with planted faults, by the checksum of conversation and turn."""
    named = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = named.withColumn("fault", F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import structure

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return structure(damaged(rows), rows)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


QUERIES = {"op11_conversations": op11_conversations, "op13_hard_negatives": op13_hard_negatives, "op12_packing": op12_packing, "op1_mixing": op1_mixing, "op2_neighbours": op2_neighbours, "op6_pieces": op6_pieces, "op4_sharding": op4_sharding, "op5_line_dedup": op5_line_dedup, "op3_language": op3_language, "op7_media": op7_media, "op8_near_dup": op8_near_dup, "op9_substring_dedup": op9_substring_dedup, "op10_toxicity": op10_toxicity}
_WORD = r"[^\x20\x09-\x0D]+"

#: Sainte-Laguë by its definition: every seat's quotient, sorted.
_MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
t AS (SELECT sum(size)::BIGINT AS total FROM d),
k AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, ceil(sum(size) OVER (PARTITION BY source) / 250000.0)::BIGINT) AS shard FROM d),
s1 AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1)),
s2 AS (SELECT *, cap / w AS ratio, ((SELECT 1.5::DOUBLE * total FROM t) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, coalesce(least(w * (SELECT level FROM s2 WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), cap), cap) AS target FROM s2),
s4 AS (SELECT source, target, unnest(range(1, ceil(target / 16)::BIGINT + 1)) AS seat FROM s3),
s5 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source NULLS LAST) <= (SELECT floor(1.5::DOUBLE * total / 16 + 0.5) FROM t) AS won FROM s4),
s6 AS (SELECT source, source_size, target, (SELECT count(*) FROM s5 WHERE won AND s5.source IS NOT DISTINCT FROM s3.source) AS quota FROM s3),
c1 AS (SELECT source, shard, sum(size)::BIGINT AS tokens, ceil(sum(size) / 16.0)::BIGINT AS n FROM k GROUP BY 1, 2),
c2 AS (SELECT source, shard, tokens, unnest(range(1, 2 * n + 1)) AS seat FROM c1),
c3 AS (SELECT c2.source, shard, row_number() OVER (PARTITION BY c2.source ORDER BY tokens::DOUBLE / (2 * seat - 1) DESC, shard) <= quota AS won FROM c2 JOIN s6 ON c2.source IS NOT DISTINCT FROM s6.source),
c4 AS (SELECT source, shard, count(*) FILTER (won) AS quota FROM c3 GROUP BY 1, 2),
c5 AS (SELECT c1.source, c1.shard, n, coalesce(quota, 0) // nullif(n, 0) AS base, coalesce(quota, 0) % nullif(n, 0) AS r, ('0x' || substr(md5('mix:' || coalesce(c1.source, '') || c1.shard), 1, 8))::BIGINT % nullif(n, 0) AS o
  FROM c1 LEFT JOIN c4 ON c1.source IS NOT DISTINCT FROM c4.source AND c1.shard = c4.shard),
p AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS z FROM k),
q AS (SELECT p.doc_id, p.source, p.size, n, base, (16 * ((z // 16 * r + o) // n) + z % 16 * (((z // 16 + 1) * r + o) // n - (z // 16 * r + o) // n)) - (16 * (((z - size) // 16 * r + o) // n) + (z - size) % 16 * ((((z - size) // 16 + 1) * r + o) // n - ((z - size) // 16 * r + o) // n)) AS extra
  FROM p JOIN c5 ON p.source IS NOT DISTINCT FROM c5.source AND p.shard = c5.shard)
SELECT doc_id, size, source_size, target, coalesce(base * size + extra, 0)::BIGINT AS taken FROM q JOIN s6 ON q.source IS NOT DISTINCT FROM s6.source"""

#: For each line the shortest runs from it and up to it with five words; every run but its first is cut.
#: Any run with five words is the union of such runs in it, so all lines of maximal repeated runs go.
_LINES = rf"""
WITH n AS (SELECT doc_id, i AS line, l[i] AS t, len(regexp_extract_all(l[i], '{_WORD}')) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM n WHERE w > 0),
b AS (SELECT doc_id, list(t ORDER BY i) AS ts, list(w ORDER BY i) AS ws FROM f GROUP BY 1),
s AS (SELECT f.doc_id, f.i, k, sum(g.w) AS whole, sum(g.w) FILTER (g.i < f.i + k - 1) AS but_last, sum(g.w) FILTER (g.i > f.i) AS but_first
  FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS k) JOIN f g ON g.doc_id = f.doc_id AND g.i BETWEEN f.i AND f.i + k - 1 GROUP BY 1, 2, 3 HAVING count(*) = k),
h AS (SELECT s.doc_id, i, k, row_number() OVER (PARTITION BY ts[i:i + k - 1] ORDER BY s.doc_id, i) AS nth FROM s JOIN b ON b.doc_id = s.doc_id WHERE whole >= 5 AND (coalesce(but_last, 0) < 5 OR coalesce(but_first, 0) < 5)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM h WHERE nth > 1),
y AS (SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (first) AS n_runs FROM (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) < i - 1, true) AS first FROM x) GROUP BY 1),
z AS (SELECT n.doc_id, string_agg(n.t, chr(10) ORDER BY n.line) FILTER (x.i IS NULL) AS text, count(f.i) AS n_lines FROM n LEFT JOIN f USING (doc_id, line) LEFT JOIN x ON x.doc_id = n.doc_id AND x.i = f.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(z.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN y USING (doc_id)"""

#: Every pair that shares a shingle, and every node a node reaches.
_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, min(c) = d.doc_id AS kept FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""



def _sharding() -> str:
    """The table is computed here by its rule and enters the SQL as a list; hashing, hot keys and look-up are SQL."""
    from .sharding import TABLE_SIZE, fill

    slot = f"('0x' || substr(md5(coalesce({{}}::VARCHAR, chr(0))), 1, 15))::BIGINT % {{}}"
    return f"""
WITH k AS (SELECT *, {slot.format("doc_id", TABLE_SIZE)} AS s, {slot.format("text", 16)} AS part, count(*) OVER (PARTITION BY doc_id) * {HOT_SHARE} > count(*) OVER () AS hot FROM documents),
p AS (SELECT * EXCLUDE (s, part, hot), (CASE WHEN hot THEN (s + part * {TABLE_SIZE // 16}) % {TABLE_SIZE} ELSE s END)::INT AS slot FROM k),
t AS (SELECT {fill(SHARDS)}::INT[] AS shards)
SELECT p.*, t.shards[slot + 1] AS shard FROM p, t"""


#: Every anchor against every row.
_NEGATIVES = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM r a JOIN r b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) <= 3"""

def _edit(way: str, cost: str, letter: str, text: str = "") -> str:
    """A way with one more edit, or null where there is none; text: the row that stays, as SQL."""
    more = f"{way}.t || CASE WHEN {way}.k THEN chr(10) ELSE '' END || {text}" if text else f"{way}.t"
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'k': {'true' if text else f'{way}.k'}, 't': {more}}} END"


def _conversations() -> str:
    """The checksum bit by bit, then row by row the least (cost, audit) at the start, after a system row, after a user and after an assistant."""
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"
    put = lambda w, role: _edit(w, "5", "I", f"'{role}:'")
    drop = lambda w: _edit(w, "2", "D")
    keep = lambda w, r: f"CASE WHEN NOT t.gone AND t.initial = '{r}' THEN {_edit(w, 't.cut', 'K', 't.line')} END"
    turn = lambda w, role: f"CASE WHEN NOT t.gone THEN {_edit(w, '1 + t.cut', 'R', f"'{role}:' || t.text")} END"
    after = [drop("b.s0"), least(drop("b.s1"), keep("b.s0", "s")), least(drop("b.s2"), *[f(w, "u" if f is keep else "user") for f in (keep, turn) for w in ("b.s0", "b.s1", "b.s3")]), least(drop("b.s3"), keep("b.s2", "a"), turn("b.s2", "assistant"))]
    users = lambda p: least(f"{p}.s2", *[put(f"{p}.{s}", "user") for s in ("s0", "s1", "s3")])
    agents = lambda p: least(f"{p}.s3", put(f"{p}.s2", "assistant"))
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, _: xor(r >> 1, 3988292384 * (r & 1))))"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT * EXCLUDE (k), xor({crc}, 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS unended FROM n),
t AS (SELECT *, blank OR again AS gone, CASE WHEN unended THEN 5 ELSE 0 END AS cut, role || ':' || text AS line, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (NOT blank AND again)::BIGINT AS duplicate, count(*) FILTER (NOT gone AND unended)::BIGINT AS truncated, count(*) FILTER (odd)::BIGINT AS illegal, max(i) AS rows FROM t GROUP BY 1),
w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'k': false, 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, k BOOLEAN, t VARCHAR) AS s1, {{'c': 5::BIGINT, 'a': 'I', 'k': true, 't': 'user:'}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 'k': true, 't': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM g
  UNION ALL SELECT z.conv_id, z.i, z.s0, z.s1, z.s2, {agents("z")} AS s3 FROM (SELECT y.conv_id, y.i, y.s0, y.s1, {users("y")} AS s2, y.s3 FROM (SELECT b.conv_id, t.i, {", ".join(f"{x} AS s{i}" for i, x in enumerate(after))} FROM w b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1) y) z),
r AS (SELECT w.conv_id, list_min(list_filter([s0, s3], lambda x: x IS NOT NULL)) AS best FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = g.rows)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES: dict[str, str] = {"op11_conversations": _conversations(), "op13_hard_negatives": _NEGATIVES, "op4_sharding": _sharding(), "op1_mixing": _MIXING, "op5_line_dedup": _LINES, "op8_near_dup": _NEAR}
