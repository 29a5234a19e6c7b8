"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format,
    filter_audit,
    language_kernel,
    line_templates,
    order_minhash,
    phrase_index,
    piece_sampling,
    secret_scan,
    separator_scan,
    token_blocks,
    topk_search,
    turn_repair,
    vector_dedup,
)
from tidemark.llm.shared import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_phrase_decontamination",
    f"""WITH iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS phrase
        FROM iw, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS u(s) WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, s, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase FROM dw, lens, unnest(range(0, len(w) - n + 1)) AS u(s)),
found AS (SELECT g.rid, g.s, g.n, win.item FROM grams g JOIN win ON win.phrase = g.phrase AND win.n = g.n),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits ON hits.rid = dw.rid LEFT JOIN its ON its.rid = dw.rid""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_spans(kind: int, pattern: str, keep: str = "true") -> str:
    """Rows rid, kind, s, e: matches and the gaps between them add up to positions."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, e - len(m) AS s, e, m FROM (
  SELECT rid, i, m, v, sum(len(g) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
    SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(vs) AS v FROM (
      SELECT rid, regexp_extract_all(t, '{quoted}') AS ms, regexp_split_to_array(t, '{quoted}') AS gs, regexp_extract_all(t, '{quoted}', {2 if kind == 0 else 0}) AS vs FROM d))) WHERE {keep}"""


SQL_CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
SQL_ALLOWED = " OR ".join(f"regexp_matches(m, '{p}')" for p in secret_scan.ALLOWED[:3]) + " OR m = repeat(m[1], len(m))"


@query(
    "op10_secret_scan",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_sql_spans(0, secret_scan.ASSIGN, "len(v) >= 8")} UNION ALL {_sql_spans(1, secret_scan.ACCESS)} UNION ALL {_sql_spans(2, secret_scan.HEX)}),
cand AS (SELECT * FROM ({_sql_spans(3, SQL_CANDIDATE)}) WHERE NOT ({SQL_ALLOWED})),
hot AS (SELECT rid, s + w AS s FROM (SELECT rid, s, m, unnest(range(0, len(m) - {secret_scan.SIZE} + 1)) AS w FROM cand)
        WHERE list_aggregate(string_split(m[w + 1 : w + {secret_scan.SIZE}], ''), 'entropy') >= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.BASE64_BITS} END),
clear AS (SELECT rid, s FROM hot WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = hot.rid AND b.s < hot.s + {secret_scan.SIZE} AND hot.s < b.e)),
isl AS (SELECT rid, s, sum(n) OVER (PARTITION BY rid ORDER BY s) AS g FROM (SELECT rid, s, CASE WHEN s > lag(s) OVER (PARTITION BY rid ORDER BY s) + {secret_scan.SIZE} THEN 1 ELSE 0 END AS n FROM clear)),
al AS (SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, 3, min(s), max(s) + {secret_scan.SIZE} FROM isl GROUP BY rid, g),
txt AS (SELECT rid, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM al),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
        string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg(x, ',' ORDER BY s, kind) AS x FROM txt GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN agg ON agg.rid = d.rid""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listing(F.col("base")), 256).alias("base_sha256"), secret_scan.listing(F.col("spans")).alias("spans"),
    )


def _op5_rounds() -> str:
    """Groups of distinct lines, judged and parted by their frequent tokens, round by round."""
    t = line_templates
    out = []
    for r in range(t.ROUNDS + 1):
        out.append(f"""k{r} AS (SELECT m, g, ts, count(*) OVER (PARTITION BY g) AS size FROM g{r}),
c{r} AS (SELECT m, g, size, len(ts) AS n, i, x, count(*) OVER (PARTITION BY g, i, x) AS c FROM (SELECT m, g, ts, size, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS x FROM k{r})),
j{r} AS (SELECT m, g, count(*) FILTER (c = size AND i > {t.LEADING}) / CAST(any_value(n) - {t.LEADING} AS DOUBLE) >= {t.AGREEMENT} AS whole,
  string_agg(CASE WHEN c * {t.FREQUENT} >= size AND (c >= {t.LEAST_LINES} OR size = 1) THEN x ELSE chr(1) END, ' ' ORDER BY i) AS sig FROM c{r} WHERE n > {t.LEADING} GROUP BY 1, 2),
s{r} AS (SELECT m, g FROM j{r} WHERE whole),
g{r + 1} AS (SELECT j{r}.m, j{r}.g || chr(2) || sig AS g, k{r}.ts FROM j{r} JOIN k{r} ON k{r}.m = j{r}.m WHERE NOT whole)""")
    return ",\n".join(out)


OP5_SQL = f"""WITH d AS (SELECT doc_id, text FROM documents),
ln AS (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT doc_id, text FROM d)),
raw AS (SELECT doc_id, text, pos, regexp_extract_all(line, '[^ \t\r\f]+') AS ws FROM ln),
tk AS (SELECT doc_id, text, pos, CASE WHEN len(list_filter(ws, lambda t: NOT regexp_matches(t, '[0-9]'))) = 0 THEN ws
  ELSE list_transform(ws, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) END AS ts FROM raw),
ms AS (SELECT doc_id, text, pos, ts, len(ts) AS n, array_to_string(ts, ' ') AS m, len(ts) || '|' || array_to_string(ts[1:{line_templates.LEADING}], ' ') AS leaf FROM tk WHERE len(ts) > 0),
varied AS (SELECT leaf FROM ms GROUP BY 1 HAVING count(DISTINCT m) > 1),
g0 AS (SELECT m, any_value(leaf) AS g, any_value(ts) AS ts FROM ms JOIN varied USING (leaf) GROUP BY 1),
{_op5_rounds()},
gr AS ({" UNION ALL ".join(f"SELECT m, {r} || g AS g FROM s{r}" for r in range(line_templates.ROUNDS + 1))}),
tp AS (SELECT doc_id, text, pos, n, CASE WHEN g IS NOT NULL THEN 'g' || g ELSE 'm' || m END AS t FROM ms LEFT JOIN gr USING (m)),
rec AS (SELECT t, min(doc_id) AS f FROM tp GROUP BY t HAVING count(DISTINCT doc_id) >= greatest({line_templates.MIN_DOCS}, ceil({line_templates.EVIDENCE} / any_value(n)))),
gone AS (SELECT doc_id, text, pos FROM tp JOIN rec USING (t) WHERE doc_id <> f),
agg AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT ln.doc_id, string_agg(line, chr(10) ORDER BY ln.pos) AS t FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.pos = ln.pos WHERE gone.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.t, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(agg.n, 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op5_line_templates", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


HARD_CASE = r"\### Assistant: </turn> ok"


@query(
    "op7_chat_format",
    rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HARD_CASE}'), (-7, 1, 'assistant', '{HARD_CASE}')),
e AS (SELECT *, regexp_replace(text, '(\\*)(#{{3,}}|</turn>)', '\\\1\2', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(role) + 2 + length(body) + 1 + length('</turn>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(regexp_replace(body, '\\(\\*)(#{{3,}}|</turn>)', '\1\2', 'g') = text) AS faithful
FROM e GROUP BY conv_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_CASE).alias("text")
    )
    made = chat_format.format_conversations(rows.unionByName(hard))
    back = made.select(
        "conv_id",
        chat_format.parse(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "faithful",
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "faithful",
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_blocks.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json")).write.parquet(f"{folder}-list")
    return token_blocks.token_documents(spark, folder)


END_OF_TEXT = 50256


@query("op9_separator_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "flat")
    flat = separator_scan.write_flat(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), END_OF_TEXT)
    named = stored(flat, "flat-names").withColumn("file", F.substring_index("path", "/", -1))
    counts = separator_scan.count_tokens(spark, folder, END_OF_TEXT).withColumn("file", F.substring_index("path", "/", -1)).drop("path")
    return named.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@query("op3_vector_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


@query("op8_language_kernel")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language_kernel.identify(docs.select("doc_id", "text"), language_kernel.learn(docs))
    return judged.select("doc_id", (language_kernel.remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score")


@query("op2_piece_sampling")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    back = piece_sampling.decode(piece_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return back.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


@query(
    "op11_topk_search",
    """WITH u AS (SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS cid,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
      FROM u q JOIN u c ON c.rid <> q.rid AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, cid) AS rank FROM s) WHERE rank <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


SQL_BLANKS = r"\x20\x09-\x0D"
SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@query(
    "op12_turn_repair",
    rf"""WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {SQL_CRC32} % 20 AS what FROM src),
dmg AS (SELECT c, conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS cp FROM h WHERE what <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, cp) AS i FROM dmg),
flt AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SQL_BLANKS}]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^{SQL_BLANKS}])[{SQL_BLANKS}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS f, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair FROM num),
conv AS (SELECT c, conv_id, count(DISTINCT i) AS n FROM (SELECT DISTINCT c, conv_id FROM src) LEFT JOIN (SELECT c, i FROM num) USING (c) GROUP BY ALL),
ins(s, z, letters, cost, roles) AS (VALUES (0, 0, '', 0, CAST([] AS VARCHAR[])), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
  (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])),
kp(z, f, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
st(c, i, s, best) AS (
  SELECT c, CAST(0 AS BIGINT), 0, struct_pack(cost := 0, audit := '', made := CAST([] AS VARCHAR[])) FROM conv
  UNION ALL
  SELECT c, i, t, min(struct_pack(cost := cost, audit := audit, made := made)) FROM (
    SELECT st.c, st.i + 1 AS i, m.t AS t, best.cost + ins.cost + m.cost AS cost, best.audit || ins.letters || m.letter AS audit, list_concat(list_concat(best.made, ins.roles), m.made) AS made
    FROM st JOIN ins ON ins.s = st.s JOIN flt ON flt.c = st.c AND flt.i = st.i + 1 JOIN (
      SELECT flt.c, flt.i, z, z AS t, 3 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS made FROM flt, (VALUES (0), (1), (2), (3)) AS p(z)
      UNION ALL SELECT flt.c, flt.i, p.z, p.t, 2 + CAST(fault = 'truncated' AS INT), 'R', [p.r || ':' || text] FROM flt, (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS p(z, t, r) WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT flt.c, flt.i, kp.z, kp.t, CAST(fault = 'truncated' AS INT), 'K', [role || ':' || text] FROM flt JOIN kp USING (f) WHERE fault NOT IN ('blank', 'duplicate')
    ) m ON m.c = flt.c AND m.i = flt.i AND m.z = ins.z) GROUP BY c, i, t),
fin AS (SELECT conv.c, min(struct_pack(cost := best.cost + ins.cost, audit := best.audit || ins.letters, made := list_concat(best.made, ins.roles))) AS best
  FROM conv JOIN st ON st.c = conv.c AND st.i = conv.n JOIN ins ON ins.s = st.s AND ins.z IN (0, 3) GROUP BY 1),
cnt AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
  sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM conv JOIN fin USING (c) LEFT JOIN cnt USING (c)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    out = turn_repair.repair_conversations(rows, present)
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")


SQL_TERMS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


@query(
    "op13_filter_audit",
    f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > first, false) AS E
  FROM (SELECT *, {SQL_TERMS} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d)),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, CAST(A AS INT) + 2 * CAST(B AS INT) + 4 * CAST(C AS INT) + 8 * CAST(D AS INT) + 16 * CAST(E AS INT) AS mask,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS prev
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & own = 0 AND mask & coalesce(prev, 0) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(prev, 0) = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(prev, 0) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & own <> 0 AND mask & coalesce(prev, 0) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & coalesce(prev, 0) = 0), 0) AS toxic_lost
  FROM m, (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(prev AS BIGINT) AS prev FROM s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM x""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
