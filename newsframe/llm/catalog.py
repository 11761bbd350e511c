"""Queries opN_<name> of the operators, over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, prefix_tree, read_conversations

    marks = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_conversations(*prefix_tree(turns)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import known_licenses, scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), known_licenses(spark))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_model, predict_language
    from .sampling import fold

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(documents.filter(fold(F.col("doc_id"), 3) != 1))
    return predict_language(documents.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_search import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_records

    sharded = shard_records(_table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(documents, tokenizer("byte_bpe_multi_50k.tiktoken"), outputs=("ids_text", "decoded"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import mark_contamination

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(documents, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality_model, score_quality
    from .sampling import fold

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_model(documents, _table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2))
    return score_quality(documents.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label=label)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), (1, 2, 3)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_keys, prefix_trie, with_donated_turns

    keys = conversation_keys(_table(spark, sf_dir, "conversations"))
    own = F.col("conv_id")
    nodes = prefix_trie(with_donated_turns(keys, own - own % 100, F.crc32(own.cast("string").cast("binary")) % 6, 5))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_license_scan, op3_language_id, op4_nearest_neighbours, op5_sharding, op6_byte_bpe, op7_decontamination, op8_quality, op9_ngram_join, op10_token_counts, op11_hard_negatives, op12_source_mix, op13_prefix_trie)}

#: A-Z to a-z and no other letter, for DuckDB.
_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_ASCII_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (SELECT r, i, n, item FROM (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)) JOIN windows USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS h FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

#: The formatted length: 12 + role + 1 + text + 10 + 1 characters a turn, and one for each backslash or `<|` that is escaped.
_OP1 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<|', ''))) / 2)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, shingle FROM (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
first AS (SELECT reach.x AS r, min(d.doc_id) AS m FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN first USING (r)
"""

_KEY = "coalesce('k' || doc_id, 'null')"


def _shard_sql(shards: int) -> str:
    """The shard with the least cost, as DuckDB takes the least of structs."""
    costs = (f"{{'cost': -ln((('0x' || md5('{i}/' || {_KEY})[:13])::BIGINT + 0.5) / {16**13}.0::DOUBLE), 'shard': {i}}}" for i in range(shards))
    return f"list_aggregate([{', '.join(costs)}], 'min').shard"


#: The table of crc32, and the checksum of a string of hexadecimal digits.
_CRC = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT range::BIGINT AS i FROM range(256))))"
_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length({0}) // 2), lambda i: ('0x' || substr({0}, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"

_OP5 = f"""
WITH {_CRC},
hexes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sharded AS (SELECT doc_id, length(h) // 2 + 8 AS size, md5({_KEY}) AS digest,
  {_CRC_OF.format("h")} AS text_crc32,
  {_shard_sql(24)} AS shard, {_shard_sql(25)} AS grown_shard FROM hexes, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY digest, size, text_crc32) - 1 AS slot, grown_shard FROM sharded
"""


def _licence_sql() -> str:
    from .license_scan import ENDINGS, EQUIVALENT, KNOWN

    plain = "regexp_replace(text, '(?im)^[\\s/*#;.%-]*(?:\\(c\\)|©|copyright\\b[^\\n]*(?:\\(c\\)|©|[0-9]{4}))[^\\n]*$', ' ', 'g')"
    plain = f"' ' || regexp_replace(lower({plain}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for ending, kept in ENDINGS:
        plain = f"regexp_replace({plain}, '{ending}', '{kept}', 'g')"
    for spelling, kept in EQUIVALENT:
        plain = f"replace({plain}, '{f' {spelling} '.replace(' ', '  ')[1:-1]}', ' {kept} ')"
    plain = f"trim(replace({plain}, '  ', ' '))"
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, sha256(p) AS text_digest FROM (SELECT license_id, {plain} AS p FROM (VALUES {quoted}) AS k(license_id, text)) GROUP BY 2),
d AS (SELECT doc_id, {plain} AS p FROM documents)
SELECT doc_id, CASE WHEN p <> '' THEN sha256(p) END AS text_digest, license_id FROM d LEFT JOIN known ON text_digest = sha256(p)
"""


_OP11 = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""

_OP12 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || md5('0/' || coalesce('k' || doc_id, 'null'))[:13])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS cap, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, coalesce(sum(cap) OVER up, 0) AS clamped, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS open FROM s WINDOW up AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * open <= w * (total - clamped) AS full_up FROM o),
r AS (SELECT any_value(total) - coalesce(sum(cap) FILTER (full_up), 0) AS rest, sum(w) FILTER (NOT full_up) AS open FROM f),
t AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE rest * w / r.open END AS target FROM f, r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - whole * source_size - before)))::BIGINT AS taken, d.source
FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) d JOIN g ON g.source IS NOT DISTINCT FROM d.source
"""

_OP13 = f"""
WITH {_CRC},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, ({_CRC_OF.format("hex(encode(conv_id::VARCHAR))")} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
k AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = donor AND i <= h) AS given FROM c),
r AS (SELECT k.conv_id, i AS d, role, text FROM k JOIN t ON t.conv_id = donor AND i <= h UNION ALL SELECT k.conv_id, given + i - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND i > h),
p AS (SELECT conv_id, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r),
m AS (SELECT conv_id, 0 AS d, 0 AS chars, '' AS node, NULL AS up FROM c UNION ALL SELECT conv_id, d, chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), '') FROM p),
own AS (SELECT node, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len_), '') AS ends FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS len_ FROM m) GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM own WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT DISTINCT a.node AS top, b.node AS node FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (coalesce(kids.n, 0) = 0) AS n_leaves FROM under JOIN own USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT own.conv_id, own.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(own.ends) AS ends_sha256
FROM own LEFT JOIN own up ON up.node = own.up LEFT JOIN kids ON kids.node = own.node JOIN sums ON sums.top = own.node
"""

ORACLES: dict[str, str] = {"op1_chat_format": _OP1, "op2_license_scan": _licence_sql(), "op5_sharding": _OP5, "op7_decontamination": _OP7, "op9_ngram_join": _OP9, "op11_hard_negatives": _OP11, "op12_source_mix": _OP12, "op13_prefix_trie": _OP13}
