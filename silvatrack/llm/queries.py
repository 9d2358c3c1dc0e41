"""The operators' queries, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, lang_id, license_scan, merkle, mixing, prefix_trie, secret_scan, sharding, simhash, token_counts, token_output, turn_repair


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.identify(documents, lang_id.fit(documents)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row_key", "row_key2")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key", "spans")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(_table(spark, sf_dir, "documents"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_main_text, op2_language, op3_licenses, op4_secrets, op5_mix_sources, op6_near_duplicates, op7_merkle_fingerprints, op8_decontaminate,
        op9_token_files, op10_shard, op11_token_counts, op12_prefix_trie, op13_repair_turns,
    )
    return {f.__name__: f for f in found}


_OP8 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM starts
), places AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc
), cand AS (
  SELECT p.r, p.i, s.k, array_to_string(p.w[p.i:p.i + s.k - 1], ' ') AS win
  FROM places p, (SELECT DISTINCT k FROM wins) s WHERE p.i + s.k - 1 <= len(p.w)
), hits AS (
  SELECT c.r, c.i, c.k, wins.item_id FROM cand c JOIN wins ON wins.win = c.win AND wins.k = c.k
), cov AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS x FROM hits) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN cov ON cov.r = d.r LEFT JOIN its ON its.r = d.r
"""


#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = (
    "xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INT), 1)) AS BIGINT)), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295))"
)

_OP12 = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos, g, bytes FROM (
    SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
    FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT c, c - c % 5 AS b, {_CRC32.format("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM t)
), heads AS (
  SELECT o.c, o.h, least(o.h, coalesce(max(t.pos), 0)) AS k FROM own o LEFT JOIN t ON t.c = o.b GROUP BY o.c, o.h
), turns AS (
  SELECT o.c, t.pos AS d, g, bytes FROM own o JOIN t ON t.c = o.b AND t.pos <= o.h
  UNION ALL SELECT h.c, t.pos - h.h + h.k, g, bytes FROM heads h JOIN t ON t.c = h.c AND t.pos > h.h
), whole AS (
  SELECT h.c, coalesce(list(g ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS w, coalesce(list(bytes ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS sizes, count(d) AS n
  FROM heads h LEFT JOIN turns t ON t.c = h.c GROUP BY h.c
), prefix AS (
  SELECT c, d, n, sha256(array_to_string(w[1:d], ',')) AS f, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM whole)
), node AS (
  SELECT d, f, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefix GROUP BY d, f
), parents AS (
  SELECT a.*, p.c AS parent FROM node a LEFT JOIN prefix x ON x.c = a.c AND x.d = a.d - 1 LEFT JOIN node p ON p.d = x.d AND p.f = x.f
), kids AS (
  SELECT a.c, a.d, a.n_convs, a.bytes, a.parent, a.ends_sha256, count(b.c) AS n_children FROM parents a LEFT JOIN parents b ON b.parent = a.c AND b.d = a.d + 1 GROUP BY ALL
), sums AS (
  SELECT u.c, u.d, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM kids v JOIN prefix x ON x.c = v.c AND x.d <= v.d JOIN node u ON u.d = x.d AND u.f = x.f GROUP BY u.c, u.d
)
SELECT k.c AS conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs, CAST(k.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM kids k JOIN sums s ON s.c = k.c AND s.d = k.d
"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: For each state (start, system, user, assistant), from the last row to the first: the cheapest edits from there on, with the repaired lines.
_BEST = """list_min([struct_pack(c := v.{s}.c + 4, a := 'D' || v.{s}.a, t := v.{s}.t),
      struct_pack(c := v.{k}.c + CASE WHEN NOT gone AND {keeps} THEN more ELSE 1000000000 END, a := 'K' || v.{k}.a, t := list_prepend(role || ':' || text, v.{k}.t)),
      struct_pack(c := v.{r}.c + CASE WHEN gone THEN 1000000000 ELSE 3 + more END, a := 'R' || v.{r}.a, t := list_prepend('{word}:' || text, v.{r}.t))])"""
_USER, _ASSISTANT = {"r": "u", "word": "user"}, {"r": "a", "word": "assistant"}
_OP13 = f"""
WITH RECURSIVE held AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS id, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), kinds AS (SELECT *, {_CRC32.format("name")} % 20 AS kind FROM held
), hurt AS (
  SELECT conv_id, id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS i, rtrim(text, {_SPACE}) AS bare FROM hurt
), seen AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) AS o, lag(role) OVER (PARTITION BY id ORDER BY i) AS before FROM ordered
), rows AS (
  SELECT *, bare = '' AS blank, bare <> '' AND o > 1 AS again, bare <> '' AND o = 1 AND substr(bare, length(bare), 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS x,
         i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM seen
), marked AS (SELECT id, i, role, text, x, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM rows
), counts AS (
  SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM rows GROUP BY id
), v AS (
  SELECT id, n + 1 AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', t := CAST([] AS VARCHAR[])) AS "0", struct_pack(c := CAST(6 AS BIGINT), a := 'II', t := ['user:', 'assistant:']) AS s,
         struct_pack(c := CAST(3 AS BIGINT), a := 'I', t := ['assistant:']) AS u, struct_pack(c := CAST(0 AS BIGINT), a := '', t := CAST([] AS VARCHAR[])) AS a FROM counts
  UNION ALL
  SELECT id, i, list_min([b0, struct_pack(c := bu.c + 3, a := 'I' || bu.a, t := list_prepend('user:', bu.t)), struct_pack(c := ba.c + 6, a := 'II' || ba.a, t := list_concat(['user:', 'assistant:'], ba.t))]),
         list_min([bs, struct_pack(c := bu.c + 3, a := 'I' || bu.a, t := list_prepend('user:', bu.t)), struct_pack(c := ba.c + 6, a := 'II' || ba.a, t := list_concat(['user:', 'assistant:'], ba.t))]),
         list_min([bu, struct_pack(c := ba.c + 3, a := 'I' || ba.a, t := list_prepend('assistant:', ba.t))]), list_min([ba, struct_pack(c := bu.c + 3, a := 'I' || bu.a, t := list_prepend('user:', bu.t))])
  FROM (SELECT v.id, m.i,
      {_BEST.format(s='"0"', k="s", keeps="x = 's'", **_USER).replace("list_min([", "list_min([struct_pack(c := v.u.c + CASE WHEN NOT gone AND x = 'u' THEN more ELSE 1000000000 END, a := 'K' || v.u.a, t := list_prepend(role || ':' || text, v.u.t)), ")} AS b0,
      {_BEST.format(s="s", k="u", keeps="x = 'u'", **_USER)} AS bs,
      {_BEST.format(s="u", k="a", keeps="x = 'a'", **_ASSISTANT)} AS bu,
      {_BEST.format(s="a", k="u", keeps="x = 'u'", **_USER)} AS ba
    FROM v JOIN marked m ON m.id = v.id AND m.i = v.i - 1)
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v."0".c, 0) AS BIGINT) AS cost, coalesce(v."0".a, '') AS audit,
       sha256(coalesce(array_to_string(v."0".t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, id FROM held) o LEFT JOIN counts c ON c.id = o.id LEFT JOIN v ON v.id = o.id AND v.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": _OP8, "op12_prefix_trie": _OP12, "op13_repair_turns": _OP13}
