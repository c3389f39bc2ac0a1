"""Registered queries of the operators on whole corpora (11 to 13), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import importance, manifest, mixing
from barloom.llm.staging import table


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(*mixing.mixed(table(spark, sf_dir, "documents")))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def tampered(key: str = "doc_id", column: str = "n_chars", divisor: int = 7) -> Column:
    """``column``, one more where ``divisor`` divides the crc32 of the key."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % divisor == 0
    return F.when(hit, F.col(column) + 1).otherwise(F.col(column))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    altered = [tampered() if c == "n_chars" else F.col(c) for c in columns]
    rows = manifest.manifest(table(spark, sf_dir, "documents"), columns, altered=altered)
    found = manifest.folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of texts in SQL: the table of its polynomial from its rule, then one fold over the bytes.
_CRC_TABLE = (
    "(SELECT list_transform(range(256), lambda i: list_reduce(range(8), "
    "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"
)


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return (
        f"xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode({text}))), lambda i: {byte}), "
        "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295))"
    )


OP11_SQL = rf"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), aims AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), uses AS (SELECT n, unnest(w) AS word FROM words),
hashed AS (
    SELECT word, {_crc('word')} % 10000 AS bucket
    FROM (SELECT word FROM uses UNION SELECT word FROM aims) AS v, {_CRC_TABLE} AS crc
), s AS (SELECT bucket, count(*) AS s FROM uses JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM uses) + 10000)
                                   / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket)
), weighed AS (
    SELECT n, sum(gain)::BIGINT AS total FROM uses JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY n
), scored AS (
    SELECT doc_id, len(w) AS n_features, CASE WHEN total IS NULL THEN 0 ELSE floor(total / len(w))::BIGINT END AS weight,
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM words LEFT JOIN weighed USING (n)
), final AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), places AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
           count(*) FILTER (n_features >= 20) OVER () AS able FROM final
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM places
"""

_L, _R, _P = mixing.BLOCK_WORDS, mixing.ROUNDS, mixing.PRIME


def _permutation_sql() -> str:
    at = f"(stream * {_R} + r)"
    wide = f"({mixing.mixed_number(at + ' + 700001')} * {_P} + {mixing.mixed_number(at + ' + 900007')})"
    mirror = "((p[r + 1] + blocks - x) % blocks)"
    bit = mixing.mixed_bit(f"greatest(x, {mirror}) + (stream * {_R} + r) * 1000003")
    return f"""
), laps AS (
    SELECT number, blocks, pass, number * 3 + pass AS stream FROM plan, range(3) AS l(pass) WHERE blocks > 0
), pointed AS (
    SELECT *, list_transform(range({_R}), lambda r: {wide} % blocks) AS p FROM laps
), turns AS (
    SELECT number, blocks, turn // blocks AS pass, turn % blocks AS spot
    FROM (SELECT number, blocks, unnest(range(quota)) AS turn FROM plan)
), slots AS (
    SELECT number, list_reduce(range({_R}), lambda x, r: CASE WHEN {bit} = 1 THEN {mirror} ELSE x END, spot) AS block
    FROM turns JOIN pointed USING (number, blocks, pass)
"""


OP12_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, row_number() OVER () AS n, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [5, 2, 1][number % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS stop
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sources)
), levels AS (
    SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(stop) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
    FROM weighed WINDOW up AS (ORDER BY stop / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
    SELECT source, source_size, number, ceil(source_size / {_L})::BIGINT AS blocks,
           least(stop, coalesce((SELECT level FROM levels WHERE level <= stop / weight ORDER BY stop / weight, number LIMIT 1), 0) * weight) AS target
    FROM levels
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, 3 * blocks) ELSE 0 END AS quota FROM aimed
{_permutation_sql()}
), times AS (SELECT number, block, count(*) AS times FROM slots GROUP BY number, block),
placed AS (
    SELECT doc_id, n, size, source_size, target, number,
           sum(size) OVER (PARTITION BY number ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size, n ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
    FROM sized JOIN aimed ON sized.source IS NOT DISTINCT FROM aimed.source
), pieces AS (
    SELECT n, number, start, size, unnest(range(start // {_L}, (start + size - 1) // {_L} + 1)) AS block FROM placed WHERE size > 0
), sums AS (
    SELECT n, sum(times * (least(start + size, (block + 1) * {_L}) - greatest(start, block * {_L})))::BIGINT AS taken
    FROM pieces JOIN times USING (number, block) GROUP BY n
)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN sums USING (n)
"""


def _leaf_sql(n_chars: str) -> str:
    names = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in names) + ")"


OP13_SQL = f"""
WITH RECURSIVE marked AS (
    SELECT *, CASE WHEN {_crc('doc_id::VARCHAR')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS other
    FROM documents, {_CRC_TABLE} AS crc
), leaves AS (
    SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('other')} AS changed FROM marked
), placed AS (
    SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
), nodes AS (
    SELECT grp, 0 AS level, idx, n, leaf AS h FROM placed
    UNION ALL
    SELECT grp, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, level, idx // 2
), subroots AS (
    SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, place AS idx, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
    SELECT s.grp, x.level, x.idx, coalesce(y.h, '') AS sibling, x.idx % 2 = 1 AS sibling_first
    FROM (SELECT DISTINCT grp FROM nodes) AS s JOIN nodes AS x ON x.grp = s.grp AND x.n > 1
    LEFT JOIN nodes AS y ON y.grp = x.grp AND y.level = x.level AND y.idx // 2 = x.idx // 2 AND y.idx <> x.idx
    UNION ALL
    SELECT s.grp, s.height + x.level, -1, coalesce(y.h, ''), x.idx % 2 = 1
    FROM subroots AS s JOIN upper AS x ON x.n > 1 AND x.idx = s.place // (1 << x.level)
    LEFT JOIN upper AS y ON y.level = x.level AND y.idx // 2 = x.idx // 2 AND y.idx <> x.idx
), proofs AS (
    SELECT p.grp, p.idx, list({{'s': k.sibling, 'f': k.sibling_first}} ORDER BY k.level) AS path
    FROM placed AS p JOIN subroots USING (grp) JOIN steps AS k ON k.grp = p.grp AND k.idx = CASE WHEN k.level < height THEN p.idx // (1 << k.level) ELSE -1 END
    GROUP BY p.grp, p.idx
), final AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, coalesce(path, []) AS path, changed
    FROM placed JOIN subroots USING (grp) LEFT JOIN proofs USING (grp, idx)
), folded AS (
    SELECT *, list_reduce(list_prepend({{'s': changed, 'f': false}}, path),
                          lambda a, b: {{'s': sha256(CASE WHEN b.f THEN b.s || a.s ELSE a.s || b.s END), 'f': false}}).s AS folded_root FROM final
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.s), 'string_agg', ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

QUERIES = {"op11_importance": op11_importance, "op12_mixing": op12_mixing, "op13_manifest": op13_manifest}
SQL = {"op11_importance": OP11_SQL, "op12_mixing": OP12_SQL, "op13_manifest": OP13_SQL}
