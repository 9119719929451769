"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, merkle, minhash, mix, pack, pii, quality, secret, shard, shard_sql, subspace, suffix, urls, whiten
from .common import table


def op1_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded_documents(table(spark, sf_dir, "documents"))


def op3_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(table(spark, sf_dir, "pages"))


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified_documents(table(spark, sf_dir, "documents"))


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret.secret_digest(table(spark, sf_dir, "documents"))


def op7_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(table(spark, sf_dir, "documents"))


def op9_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"))


def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.repetition_rules(table(spark, sf_dir, "documents"))
    return out.withColumn("long_repeat", F.col("longest_repeat") > quality.MOST_LONGEST).drop("longest_repeat")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op12_integer_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op13_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest_columns(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_subspace_pigeonhole,
        op2_feistel_shards,
        op3_boosted_urls,
        op4_bbit_minhash,
        op5_kneser_ney_language,
        op6_entropy_secrets,
        op7_anchor_pii,
        op8_poisson_mix,
        op9_configuration_packing,
        op10_suffix_repetition,
        op11_merkle_manifest,
        op12_integer_whitening,
        op13_interval_repeats,
    )
}
_COMPONENTS = """reach AS (SELECT a AS node, b AS to_ FROM both_ UNION SELECT r.node, l.b FROM reach r JOIN both_ l ON r.to_ = l.a),
least AS (SELECT node, min(to_) AS component FROM reach GROUP BY node)"""

#: All pairs of equal label, in double precision; components by closure.
OP1_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
both_ AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM both_ WHERE a = vec_id)::BIGINT AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id <= coalesce(component, vec_id) AS kept FROM v LEFT JOIN least ON node = vec_id"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, by exact counts; components by closure.
OP4_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(10))] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) END) AS s FROM w),
one AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
few AS (SELECT x FROM one GROUP BY x HAVING count(*) > 1), met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM (SELECT * FROM one SEMI JOIN few USING (x)) p JOIN (SELECT * FROM one SEMI JOIN few USING (x)) q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
both_ AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n_shingles + q.n_shingles - common)),
{_COMPONENTS}
SELECT doc_id, n_shingles, least(doc_id, coalesce(component, doc_id)) AS component_id, doc_id <= coalesce(component, doc_id) AS kept FROM n LEFT JOIN least ON node = doc_id"""


def _windows(size: int) -> str:
    """Words in windows of ``size`` words that occur twice or more in their text."""
    return f"""w{size} AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], chr(10)) AS x FROM t, range(1, 1000000) g(i) WHERE i <= len(w) - {size - 1}),
r{size} AS (SELECT doc_id, i FROM w{size} QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c{size} AS (SELECT doc_id, sum(least({size}, coalesce(nxt - i, {size})))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r{size}) GROUP BY doc_id)"""


#: Repeats of ten words or more cover what repeated windows of ten words cover; one exceeds fifty words where a window of 51 repeats.
OP10_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents), {_windows(5)}, {_windows(10)}, {_windows(51)},
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS covered_words, c51.n IS NOT NULL AS long_repeat
  FROM t JOIN l USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c10 USING (doc_id) LEFT JOIN c51 USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND covered_words <= 0.15 * n_words AND NOT long_repeat AS kept FROM b"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind with their places: the lengths of gaps and matches before each."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hits[k] AS hit, list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS part FROM t), range(1, 100000) g(k) WHERE k <= len(hits) AND length(part[k]) >= {least}"""


#: The base kinds as written in the contract; candidates of the method with every window's entropy computed afresh.
OP6_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans('assign', 0, r"((?i:password|passwd|secret|token|api_?key))[" + chr(34) + r"']? *[:=] *[" + chr(34) + r"']?([A-Za-z0-9+/_.=-]+)", 2, 6)}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans('hex', 2, '[0-9a-f]+', 0, 24)}),
cand AS ({_spans('entropy', 3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)}),
plain AS (SELECT *, CASE WHEN regexp_full_match(hit, '[0-9A-Fa-f]+') THEN 3.1 WHEN regexp_full_match(hit, '[A-Za-z0-9]+') THEN 3.75 ELSE 3.85 END AS most FROM cand c
  WHERE (regexp_matches(hit, '[A-Za-z][0-9]|[0-9][A-Za-z]|[+]') OR len(regexp_extract_all(hit, '[a-z][A-Z]')) * 6 > length(hit)) AND NOT regexp_matches(hit, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start <= c.start AND c.start + length(c.hit) <= b.start + length(b.hit))),
high AS (SELECT doc_id, start, hit, min(i) AS first, max(i) + 19 AS last FROM plain, range(1, 100000) g(i) WHERE i <= length(hit) - 19 AND list_aggregate(string_split(hit[i:i + 19], ''), 'entropy') >= most GROUP BY ALL),
cut AS (SELECT doc_id, 3 AS rank, 'entropy' AS kind, hit[first:last] AS hit, start + first - 1 AS start FROM high),
more AS (SELECT * FROM cut c WHERE (regexp_matches(hit, '[A-Za-z][0-9]|[0-9][A-Za-z]|[+]') OR len(regexp_extract_all(hit, '[a-z][A-Z]')) * 6 > length(hit))
  AND length(regexp_replace(hit, '(?i)(example|sample|dummy|placeholder|changeme|xxxxx|abcdefgh|12345678)', '', 'g')) >= 20
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start <= c.start AND c.start + length(c.hit) <= b.start + length(b.hit))),
found AS (SELECT * FROM base UNION ALL BY NAME SELECT * FROM more),
said AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY start, rank) FILTER (rank < 3) AS base_, string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN said USING (doc_id)"""

def _places(kind: str, rank: int, pattern: str) -> str:
    """All matches of a pattern with their places, in table t."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hits[k] AS hit, list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start, gaps[k + 1] AS after
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM t), range(1, 100000) g(k) WHERE k <= len(hits)"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT ELSE 2 * {_DIGITS}[i]::INT - CASE WHEN {_DIGITS}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD_97 = "list_reduce(list_prepend(0, list_transform(string_split(raw[5:] || raw[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"

#: The base kinds as written in the contract; credentials, account and identity numbers behind their cues.
OP7_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
email AS ({_places('email', 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}),
ip AS (SELECT * FROM ({_places('ip', 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}) WHERE len(list_filter(string_split(hit, '.'), lambda x: x::HUGEINT > 255)) = 0),
card AS (SELECT * FROM ({_places('card', 2, r"[0-9](?:[\x20-]?[0-9])+")}) WHERE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}),
phone AS (SELECT * FROM ({_places('phone', 3, r"\+[0-9][\x20().0-9-]+[0-9]")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15),
cue AS ({_places('credential', 4, '://')} UNION ALL {_places('iban', 5, 'IBAN|iban|Iban')} UNION ALL {_places('ssn', 6, 'SSN|ssn|social security|Social Security')}),
behind AS (SELECT *, CASE rank WHEN 4 THEN regexp_extract(after, '^([A-Za-z0-9._~!$&''()*+,;=%:-]*)@', 1) WHEN 5 THEN regexp_extract(after, '^[ :.#=\t]{{0,4}}([A-Z0-9](?: ?[A-Z0-9]){{0,33}})', 1) ELSE regexp_extract(after, '^[^0-9\n]{{0,12}}([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?:$|[^0-9])', 1) END AS part,
  CASE rank WHEN 4 THEN '' WHEN 5 THEN regexp_extract(after, '^[ :.#=\t]{{0,4}}') ELSE regexp_extract(after, '^[^0-9\n]{{0,12}}') END AS gap FROM cue),
more AS (SELECT doc_id, rank, kind, part AS hit, start + length(hit) + length(gap) AS start, replace(part, ' ', '') AS raw FROM behind WHERE part <> ''),
good AS (SELECT doc_id, rank, kind, hit, start FROM more WHERE CASE rank WHEN 4 THEN contains(trim(hit, ':'), ':') WHEN 5 THEN length(raw) BETWEEN 15 AND 34 AND regexp_matches(raw, '^[A-Z]{{2}}[0-9]{{2}}') AND {_MOD_97}
  ELSE hit[1:3] NOT IN ('000', '666') AND hit[1] <> '9' AND hit[5:6] <> '00' AND hit[8:11] <> '0000' END),
base AS (SELECT doc_id, rank, kind, hit, start FROM email UNION ALL SELECT doc_id, rank, kind, hit, start FROM ip UNION ALL SELECT doc_id, rank, kind, hit, start FROM card UNION ALL SELECT doc_id, rank, kind, hit, start FROM phone),
found AS (SELECT * FROM base UNION ALL SELECT * FROM good),
said AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
  string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY rank, start) FILTER (rank < 4) AS base_, string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY rank, start) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN said USING (doc_id)"""

ORACLE = {
    "op1_subspace_pigeonhole": OP1_SQL,
    "op2_feistel_shards": shard_sql.oracle_sql(),
    "op4_bbit_minhash": OP4_SQL,
    "op6_entropy_secrets": OP6_SQL,
    "op7_anchor_pii": OP7_SQL,
    "op8_poisson_mix": mix.ORACLE_SQL,
    "op10_suffix_repetition": OP10_SQL,
}
