"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, jaccard, langid, merkle, mixing, pii, repeats, secrets, toxicity, vptree, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.union(more)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", "expected_severity", "severity", "is_toxic")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.cut_repeats(_table(spark, sf_dir, "documents"), least=400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_pii, op2_chat_formatting, op3_language_id, op4_warc, op5_nearest_neighbours, op6_ngram_jaccard, op7_mixing,
    op8_decontamination, op9_secrets, op10_toxicity, op11_filter_audit, op12_suffix_array_dedup, op13_merkle_manifest,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {
    "op2_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        -- As formatted: marks, line breaks, and a backslash for each control string of an escaped turn.
        sized AS (
            SELECT *, length(role) + length(text) + 16 + len(regexp_extract_all(text, '</?turn>')) AS n FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM f""",
    "op5_nearest_neighbours": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
        r AS (SELECT CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, query_id, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_mixing": r"""
        WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
        o AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
        -- What is left for a source and those that reach their cap later, if all that reach it earlier are at theirs.
        c AS (
            SELECT *, 3.0 * source_size / weight AS ratio, (SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER before, 0) AS lft,
                   (SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER before, 0) AS whole
            FROM o WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT CAST(lft AS DOUBLE) AS lft, CAST(whole AS DOUBLE) AS whole FROM c WHERE weight * CAST(lft AS DOUBLE) / CAST(whole AS DOUBLE) <= 3 * source_size ORDER BY ratio, source LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN weight * lft / whole > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE lft * weight / whole END AS target FROM o, l),
        k AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take FROM t),
        d AS (
            SELECT row_number() OVER () AS n, w.doc_id, w.source, w.size, k.source_size, k.target, k.take, CAST(coalesce(sum(w.size) OVER (
                PARTITION BY w.source ORDER BY CAST('0x' || md5(CAST(w.doc_id AS VARCHAR))[1:15] AS BIGINT), w.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
            FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source),
        -- Golden-ratio points through the cumulative takes; a source's slots are ranked and take its blocks of 512 words in turn.
        c2 AS (SELECT *, coalesce(sum(take) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(take) OVER () AS total FROM k),
        p AS (SELECT *, CAST(before AS HUGEINT) * 2147483648 // greatest(total, 1) AS lo, CAST(before + take AS HUGEINT) * 2147483648 // greatest(total, 1) AS hi FROM c2),
        i AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(0, CAST(total // 512 AS BIGINT))) AS slot FROM (SELECT any_value(total) AS total FROM p))),
        q AS (SELECT slot, source, source_size, take, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank, (source_size + 511) // 512 AS blocks FROM i JOIN p ON point >= lo AND point < hi),
        f AS (
            SELECT source, rank % blocks AS block, min(slot) AS slot FROM q
            WHERE least(512, source_size - (rank % blocks) * 512, take - (rank // blocks) * source_size - (rank % blocks) * 512) > 0 GROUP BY source, rank % blocks),
        b AS (SELECT n, source, unnest(range(CAST(begin // 512 AS BIGINT), CAST((begin + size - 1) // 512 + 1 AS BIGINT))) AS block FROM d WHERE size > 0),
        g AS (SELECT n, min(slot) AS first_slot FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.block = f.block GROUP BY n)
        SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size + greatest(0, least(begin + size, take % source_size) - begin) END AS taken, first_slot
        FROM d LEFT JOIN g ON g.n = d.n""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    # Every order is applied filter by filter, without a lattice.
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        f AS (
            SELECT d.doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                   regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails, l.good, l.toxic
            FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
        o AS (
            SELECT '' AS filter_order
            UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
        s AS (
            SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own,
                   list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS earlier
            FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
        e AS (
            SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
                   len(list_filter(fails, lambda x: x)) AS failures FROM c, s),
        r AS (
            SELECT part, filter_order, CAST(step AS INT) AS step, own, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (WHERE gone AND fail), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (WHERE fail AND failures = 1), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS toxic_lost
            FROM e GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    # Whole levels of nodes as lists, a language at a time; CRC-32 bit by bit.
    "op13_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, text, concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                   xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b:
                       list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, (x % 2) * 3988292384)), CAST(4294967295 AS BIGINT))) % 3 = 0 AS touched
            FROM documents),
        l AS (
            SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
        g AS (
            SELECT *, CASE WHEN touched THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE leaf END AS given,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
        v AS (
            SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM g GROUP BY lang
            UNION ALL SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')))
            FROM v WHERE len(nodes) > 1),
        s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS lang_no FROM v WHERE len(nodes) = 1),
        t AS (
            SELECT 0 AS level, list(subroot ORDER BY lang_no) AS nodes FROM s
            UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')))
            FROM t WHERE len(nodes) > 1),
        a AS (
            SELECT g.doc_id, leaf, given, subroot, 0 AS tree, v.level, idx // CAST(pow(8, v.level) AS BIGINT) AS place, nodes
            FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang JOIN v ON g.lang IS NOT DISTINCT FROM v.lang
            UNION ALL SELECT g.doc_id, leaf, given, subroot, 1, t.level, lang_no // CAST(pow(8, t.level) AS BIGINT), nodes
            FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang, t),
        p AS (
            SELECT doc_id, leaf, any_value(given) AS given, any_value(subroot) AS subroot,
                   coalesce(list(array_to_string(nodes[place - place % 8 + 1:place], '') || '#' || array_to_string(nodes[place + 2:place - place % 8 + 8], '') ORDER BY tree, level)
                            FILTER (WHERE len(nodes) > 1), []) AS proof
            FROM a GROUP BY doc_id, leaf),
        r AS (SELECT nodes[1] AS root FROM t WHERE len(nodes) = 1),
        f AS (
            SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '#', '')) AS proof_sha256,
                   list_reduce(proof, lambda node, x: sha256(split_part(x, '#', 1) || node || split_part(x, '#', 2)), given) AS folded_root
            FROM p, r)
        SELECT *, folded_root = root AS verified FROM f""",
    # Every string of 400 bytes (800 hex digits), by its MD5.
    "op12_suffix_array_dedup": """
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        w AS (SELECT k, p, md5_number(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d)),
        r AS (SELECT k, p FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
        -- Starts that are 400 apart at most cover one run of bytes.
        g AS (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 400 THEN 0 ELSE 1 END AS opens FROM r),
        o AS (SELECT k, p, sum(opens) OVER (PARTITION BY k ORDER BY p) AS run FROM g),
        s AS (SELECT k, min(p) AS a, max(p) + 400 AS b FROM o GROUP BY k, run),
        e AS (SELECT k, list({'a': a, 'b': b} ORDER BY a) AS spans, sum(b - a) AS removed FROM s GROUP BY k)
        SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(len(spans), 0) AS n_spans,
               sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(spans) + 1), lambda i:
                   h[CASE WHEN i = 0 THEN 1 ELSE 2 * spans[i].b + 1 END:CASE WHEN i = len(spans) THEN len(h) ELSE 2 * spans[i + 1].a END]), '') END)) AS kept_sha256
        FROM d LEFT JOIN e ON e.k = d.k""",
}
