"""Registered queries of this subpackage: builders and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rnd
from . import byte_pairs, chat, decontaminate, html_text, licenses, line_dedup, near_dedup, negatives, quality, sentence_pieces, sharding, toxicity, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def _op1_sql() -> str:
    """Measures, votes and the fit: one recursive step per round of expectation-maximisation."""
    votes = []
    for r in quality.RULES:
        x = f"{r.over}::DOUBLE / greatest({r.under}, 1)"
        low, high = (f"{x} <= {r.good}", f"{x} >= {r.bad}") if r.good < r.bad else (f"{x} >= {r.good}", f"{x} <= {r.bad}")
        votes.append(f"CASE WHEN {high} THEN -1 WHEN {low} THEN 1 ELSE 0 END")
    j = len(quality.RULES)
    only = lambda c: f"length(regexp_replace(t, '[^{c}]', '', 'g'))"
    mass = lambda w: (
                    f"list_transform(range(1, {j + 1}), lambda j: list_transform([-1, 0, 1], lambda v: {quality.SMOOTH} + "
                    f"list_sum(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN vs[i][j] = v THEN ns[i] * {w} ELSE 0.0 END))))")
    share = lambda m: f"list_transform({m}, lambda m: list_transform(m, lambda x: x / list_sum(m)))"
    chance = lambda p, r: f"list_transform(vs, lambda v: {p} * list_aggregate(list_transform(range(1, {j + 1}), lambda j: {r}[j][v[j] + 2]), 'product'))"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
again AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             coalesce(again.n, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct_words, len(list_filter(ws, lambda x: x = '|')) AS n_cell_words,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, {only('#*$%&|<>')} AS n_symbols, {only('!')} AS n_exclaims,
             {only('\\p{L}')} AS n_letters, {only('\\p{Lu}')} AS n_upper FROM w LEFT JOIN again ON w.rid = again.rid),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed, [{', '.join(votes)}] AS votes FROM m),
pats AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
p AS (SELECT list(votes ORDER BY votes) AS vs, list(n ORDER BY votes) AS ns, sum(n) AS total FROM pats),
em AS (
  SELECT 0 AS it, list_transform(vs, lambda x: CASE WHEN list_min(x) < 0 THEN 0.05 ELSE 0.95 END)::DOUBLE[] AS g, (-1e308)::DOUBLE AS likelihood, FALSE AS done FROM p
  UNION ALL
  SELECT it + 1, list_transform(range(1, len(ns) + 1), lambda i: good[i] / (good[i] + bad[i])), lik, lik - last < {quality.TOLERANCE} * abs(lik) FROM (
    SELECT *, list_sum(list_transform(range(1, len(ns) + 1), lambda i: ns[i] * ln(good[i] + bad[i]))) AS lik FROM (
      SELECT *, {chance('prior', 'of_good')} AS good, {chance('(1 - prior)', 'of_bad')} AS bad FROM (
        SELECT it, likelihood AS last, vs, ns, {share(mass('g[i]'))} AS of_good, {share(mass('(1 - g[i])'))} AS of_bad,
               (list_sum(list_transform(range(1, len(ns) + 1), lambda i: ns[i] * g[i])) + {quality.PRIOR_GOOD}) / (total + 1) AS prior
        FROM em, p WHERE NOT done AND it < {quality.MAX_ITERATIONS})))),
fitted AS (SELECT vs, g FROM em, p ORDER BY it DESC LIMIT 1),
verdict AS (SELECT unnest(vs) AS votes, unnest(g) AS posterior FROM fitted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior, array_to_string(v.votes, ',') AS votes
FROM v JOIN verdict ON v.votes = verdict.votes
"""


@register("op1_quality_rules", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base verdict and weak-supervision verdict of every document."""
    rows, _ = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    m = F.col("__m")
    return rows.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                       F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"),
                       rnd(F.col("__posterior"), 6).alias("posterior"), F.array_join(F.col("__votes").cast("array<string>"), ",").alias("votes"))


OP5_SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
normal AS (
  SELECT *, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS norm FROM pieces),
long_enough AS (
  SELECT *, regexp_matches(norm, '^[^\\x20\\x09-\\x0D]+(?:[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+){{{line_dedup.MIN_WORDS - 1}}}') AS counts FROM normal),
shown AS (
  SELECT norm, text, min(source) AS site, len(string_split_regex(norm, '[\\x20\\x09-\\x0D]+')) AS words
  FROM long_enough WHERE counts AND source IS NOT NULL GROUP BY norm, text),
shared AS (
  SELECT norm FROM shown GROUP BY norm HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
copies AS (
  SELECT text FROM shown GROUP BY text HAVING 2 * sum(CASE WHEN norm IN (SELECT norm FROM shared) THEN words ELSE 0 END) > sum(words)),
boilerplate AS (
  SELECT norm FROM shown WHERE norm IN (SELECT norm FROM shared) AND text NOT IN (SELECT text FROM copies)
  GROUP BY norm HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
marked AS (
  SELECT l.*, l.counts AND b.norm IS NOT NULL AS gone FROM long_enough l LEFT JOIN boilerplate b ON l.norm = b.norm)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id, text
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@register("op5_line_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three sites or more show, near copies aside."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


OP6_SQL = """
WITH tab AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
             CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
               list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) END AS text_crc32,
             md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END) - 1 AS p,
             count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 16 // total)::INTEGER AS shard,
       (p - ((p * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM p
"""


@register("op6_sharding", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal mixture, counts at most one apart."""
    out = sharding.interleaved_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@register("op2_minhash_near_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (4-word shingles, 80 percent)."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("text_hash")


@register("op7_sentence_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole document, and whether decoding them gives the text."""
    return sentence_pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), sentence_pieces.read_model(), id_col="doc_id")


@register("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that tiles cover by half or more."""
    out = decontaminate.decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.round("__coverage", 6).alias("coverage"), F.col("__items").alias("leaked_items"), F.col("__leaked").alias("leaked"))


def _op3_sql() -> str:
    """The scan as SQL: sentences by position, then one step per licence rule."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    parted = "lower(coalesce(text, ''))"
    for pattern, by in licenses.EXPRESSIONS:
        parted = f"regexp_replace({parted}, {text(pattern)}, {text(by)}, 'g')"
    known = " ".join(f"WHEN regexp_matches(norm, {text(p)}) THEN {text(i)}" for i, p in licenses.KNOWN)
    steps = ["step_0 AS (SELECT doc_id, n_unknown, ids, coalesce(list_aggregate(list_transform(ids, lambda i: ',' || i || ','), 'string_agg', ''), '') AS rest, "
             "[]::VARCHAR[] AS found FROM docs)"]
    for k, (name, ids) in enumerate(licenses.RULES):
        p = text(licenses.rule_pattern(ids))
        steps.append(f"step_{k + 1} AS (SELECT doc_id, n_unknown, ids, regexp_replace(rest, {p}, ',#,', 'g') AS rest, "
                     f"CASE WHEN regexp_matches(rest, {p}) AND NOT list_contains(found, {text(name)}) THEN list_append(found, {text(name)}) ELSE found END AS found FROM step_{k})")
    return f"""
WITH low AS (SELECT doc_id, {parted} AS t, row_number() OVER () AS rid FROM documents),
cut AS (SELECT rid, unnest(string_split_regex(t, {text(licenses.SENTENCE_END)})) AS s,
               generate_subscripts(string_split_regex(t, {text(licenses.SENTENCE_END)}), 1) AS pos
        FROM low WHERE regexp_matches(t, '{licenses.TRIGGER}|spdx-license')),
named AS (SELECT rid, pos, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(s, '[^a-z0-9.+/-]+', ' ', 'g'), ' .-/'), 'licence', 'license', 'g'),
                 '([0-9])[.]0([^0-9.]|$)', '\\1\\2', 'g'), ' [./-]+ ', ' ', 'g') AS norm
          FROM cut WHERE regexp_matches(s, '{licenses.TRIGGER}|spdx-license')),
ids AS (SELECT rid, pos, CASE {known} ELSE 'unknown' END AS id FROM named),
by_doc AS (SELECT rid, list(id ORDER BY pos) AS ids, count(*) FILTER (id = 'unknown') AS n_unknown FROM ids GROUP BY rid),
docs AS (SELECT l.doc_id, coalesce(b.ids, []::VARCHAR[]) AS ids, coalesce(b.n_unknown, 0) AS n_unknown FROM low l LEFT JOIN by_doc b ON l.rid = b.rid),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(found, '|'), '') AS licenses, coalesce(array_to_string(ids, '|'), '') AS sentence_ids, n_unknown::BIGINT AS n_unknown
FROM step_{len(licenses.RULES)}
"""


@register("op3_license_scan", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and licence-sentence identifiers of every document."""
    out = licenses.scanned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", "|").alias("licenses"), F.array_join("sentence_ids", "|").alias("sentence_ids"), "n_unknown")


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity score of every document; a fifth of the ids never trains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder("doc_id") != 0)
    out = toxicity.fit(docs, labels).score(docs, ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@register("op8_chat_formatting")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as linked, ordered, checked canonical JSON lines."""
    out = chat.linked(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "position", "turn", "role", "kind", "call_id", "status", "valid", F.array_join("errors", "; ").alias("errors"), "json")


@register("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


@register("op11_byte_pairs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and the text that they decode to, as digests."""
    out = byte_pairs.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_pairs.read_vocabulary(), id_col="doc_id")
    return out.select("doc_id", "n_tokens", byte_pairs.ids_digest(F.col("token_ids")).alias("ids_sha256"),
                      byte_pairs.text_digest(F.col("decoded")).alias("decoded_sha256"))


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), id_col="vec_id")


OP13_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.rid = p.rid AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other)
QUALIFY row_number() OVER w <= 5
"""


@register("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, for each of its five positives."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows, F.col("vec_id") % 100 == 0, label=label)
