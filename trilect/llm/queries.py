"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilect.llm.byte_bpe import encode_bytes
from trilect.llm.class_lm import score_held_out
from trilect.llm.conversation_repair import repair
from trilect.llm.language_id import identify
from trilect.llm.merkle import lower_ascii, manifest
from trilect.llm.mixing import mix_sources
from trilect.llm.ngram_join import ngram_join
from trilect.llm.pieces import encode_pieces
from trilect.llm.quality_model import score_quality
from trilect.llm.quality_rules import quality_rules
from trilect.llm.shared import crc_remainder, table
from trilect.llm.suffix_dedup import remove_repeats
from trilect.llm.topk_search import top_k
from trilect.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return keep


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM line GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(text) - length(translate(text, '!', '')))::BIGINT AS n_exclaims,
         coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT *, failed = 0 AS kept, failed & 3 <> 0 AS base_failed FROM f
"""


@register("op7_quality_rules", QUALITY_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """The tokenizer file: TRILECT_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("TRILECT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer(), digests=True)


def crc32_sql(value: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {shift})"
    codes = f"[ascii(x)::BIGINT for x in string_split({value}, '')]"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295)"


LEAF_SQL = "sha256(" + " || ".join(
    f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')"
    for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")
) + ")"
MERKLE_SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, lang, {LEAF_SQL.replace("{text}", "text")} AS leaf,
             {LEAF_SQL.replace("{text}", "met")} AS found
      FROM (SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
                      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                      ELSE text END AS met FROM documents)),
n AS (SELECT *, coalesce('_' || lang, '') AS g,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER () AS r FROM d),
up AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM n
       UNION ALL
       SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
       FROM up WHERE n > 1 GROUP BY g, lvl, i // 8, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, j AS i, subroot AS h, m AS n FROM sub
        UNION ALL
        SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
        FROM top WHERE n > 1 GROUP BY lvl, i // 8, n),
beside AS (
  SELECT n.r, u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < n.i // (8 ** u.lvl)::BIGINT), '') AS lefts,
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > n.i // (8 ** u.lvl)::BIGINT), '') AS rights
  FROM n JOIN up AS u ON u.g = n.g AND u.n > 1 AND u.i // 8 = n.i // (8 ** (u.lvl + 1))::BIGINT
  GROUP BY n.r, u.lvl
  UNION ALL
  SELECT n.r, 100 + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.j // (8 ** u.lvl)::BIGINT), ''),
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.j // (8 ** u.lvl)::BIGINT), '')
  FROM n JOIN sub AS s USING (g) JOIN top AS u ON u.n > 1 AND u.i // 8 = s.j // (8 ** (u.lvl + 1))::BIGINT
  GROUP BY n.r, u.lvl),
step AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, count(*) OVER (PARTITION BY r) AS last FROM beside),
f AS (SELECT r, 0 AS k, found AS h FROM n
      UNION ALL
      SELECT f.r, f.k + 1, sha256(lefts || h || rights) FROM f JOIN step ON step.r = f.r AND step.k = f.k + 1),
proof AS (SELECT r, string_agg(lefts || rights, '' ORDER BY k) AS p FROM step GROUP BY r),
folded AS (SELECT r, arg_max(h, k) AS folded_root FROM f GROUP BY r)
SELECT n.doc_id, n.leaf, sub.subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM n JOIN sub USING (g) JOIN folded USING (r) LEFT JOIN proof USING (r), (SELECT h AS root FROM top WHERE n = 1)
"""


@register("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 3) == 0)
    met = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), met, proofs=False)


BODY = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
REPAIR_SQL = f"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
      FROM conversations),
g AS (SELECT coalesce('_' || conv_id, '') AS g, conv_id FROM (SELECT DISTINCT conv_id FROM c)),
d AS (SELECT coalesce('_' || conv_id, '') AS g, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), n) AS i
      FROM c, LATERAL (SELECT unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS n) WHERE k <> 0),
e AS (SELECT *, left(role, 1) AS ini, {BODY} AS body,
             row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
             lag(ini) OVER (PARTITION BY g ORDER BY i) AS prev FROM e),
-- Before a row: nothing, or one or two insertions; states 0 start, 1 system, 2 user, 3 assistant.
ins(s, t, a, p, x) AS (VALUES (0, 0, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, '', 0, ''), (1, 2, 'I', 2, chr(10) || 'user:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, '', 0, ''), (2, 3, 'I', 2, chr(10) || 'assistant:'), (3, 3, '', 0, ''), (3, 2, 'I', 2, chr(10) || 'user:')),
due(t, u, w, ini) AS (VALUES (0, 2, 'user', 'u'), (1, 2, 'user', 'u'), (2, 3, 'assistant', 'a'), (3, 2, 'user', 'u')),
op AS (
  SELECT g, i, t, t AS u, 'D' AS a, 3 AS p, '' AS x FROM f, due
  UNION ALL
  SELECT g, i, t, u, 'R', 2 + (fault = 'truncated')::INT, chr(10) || w || ':' || text FROM f, due WHERE fault IN ('none', 'truncated')
  UNION ALL
  SELECT g, i, t, u, 'K', (fault = 'truncated')::INT, chr(10) || role || ':' || text
  FROM f JOIN due USING (ini) WHERE fault IN ('none', 'truncated')
  UNION ALL
  SELECT g, i, 0, 1, 'K', (fault = 'truncated')::INT, chr(10) || role || ':' || text
  FROM f WHERE ini = 's' AND fault IN ('none', 'truncated')),
dp AS (
  SELECT g, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS x FROM g
  UNION ALL
  SELECT dp.g, dp.i + 1, op.u, min(dp.cost + ins.p + op.p),
         arg_min(dp.audit || ins.a || op.a, lpad((dp.cost + ins.p + op.p)::VARCHAR, 9, '0') || dp.audit || ins.a || op.a),
         arg_min(dp.x || ins.x || op.x, lpad((dp.cost + ins.p + op.p)::VARCHAR, 9, '0') || dp.audit || ins.a || op.a)
  FROM dp JOIN ins ON ins.s = dp.s JOIN op ON op.g = dp.g AND op.i = dp.i + 1 AND op.t = ins.t
  GROUP BY dp.g, dp.i, op.u),
n AS (SELECT g, max(i) AS n FROM dp GROUP BY g),
done AS (
  SELECT dp.g, min(cost + ins.p) AS cost,
         arg_min(audit || ins.a, lpad((cost + ins.p)::VARCHAR, 9, '0') || audit || ins.a) AS audit,
         arg_min(dp.x || ins.x, lpad((cost + ins.p)::VARCHAR, 9, '0') || audit || ins.a) AS x
  FROM dp JOIN n ON n.g = dp.g AND n.n = dp.i JOIN ins ON ins.s = dp.s AND (ins.t = 3 OR ins.t = 0)
  GROUP BY dp.g),
s AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, done.cost::BIGINT AS cost, audit,
       sha256(substr(x, 2)) AS repaired_sha256
FROM g JOIN done USING (g) LEFT JOIN s USING (g)
"""


@register("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


@register("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    return encode_bytes(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


@register("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH c AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0)::BIGINT AS score
         , q.v AS same
  FROM (SELECT DISTINCT vec_id, v FROM c WHERE vec_id % 50 = 0) AS q JOIN c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op6_top_k_search", TOP_K_SQL)
def op6_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
t AS (SELECT html, max(page_id) AS target FROM p GROUP BY html),
r AS (SELECT p.page_id, p.html, t.target, t.target IS NOT NULL AND p.page_id IS DISTINCT FROM t.target AS again
      FROM p JOIN t USING (html)),
b AS (SELECT *, from_hex(sha1(html))::BIT::VARCHAR AS bits FROM r)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
           + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT
           + substr(bits, 5 * i + 5, 1)::INT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN target END AS refers_to
FROM b
"""


@register("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


@register("op10_class_lm")
def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


@register("op4_quality_model")
def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("of_text")


@register("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
