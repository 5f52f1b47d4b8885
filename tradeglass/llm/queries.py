"""Named queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeglass.llm import bpe, dialogue, embeddings, exact_dedup, hilbert, hmm, html_text, langid, merkle, minhash, packing, token_files, winnow
from tradeglass.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op2_token_files")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, folder), path, tokenizer_path(), end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(documents(spark, folder), tokenizer_path(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.round_trip(documents(spark, folder).select("doc_id", "text"), tokenizer_path())
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op8_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
           doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, folder))


@query("op10_hilbert_shards")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.assign(documents(spark, folder), ["source", "lang"])


@query("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder))


@query("op1_embedding_duplicates", """
    WITH RECURSIVE good AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (
        SELECT vec_id AS node, vec_id AS seen FROM embeddings
        UNION SELECT r.node, l.v FROM reach r JOIN link l ON l.u = r.seen)
    SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.u = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return langid.detect(documents(spark, folder))


@query("op6_main_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return pages.select("page_id", "url", html_text.extract(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_hidden_markov")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(documents(spark, folder))


@query("op11_merkle_manifest", r"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, text,
               coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') ||
               coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
               list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
        FROM documents),
    tampered AS (
        SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS offered FROM leaves),
    marked AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(offered)::VARCHAR || ':' || offered, '-')) AS claimed
        FROM tampered),
    nodes AS (
        SELECT coalesce('=' || lang, '') AS g, 0 AS level, row_number() OVER t - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS node
        FROM marked WINDOW t AS (PARTITION BY lang ORDER BY doc_id, leaf)
        UNION ALL
        SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8, n),
    subroots AS (SELECT g, level AS height, node AS subroot FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, subroot AS node FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
    ways AS (
        SELECT m.doc_id, m.lang, m.leaf, m.claimed, coalesce('=' || lang, '') AS g, row_number() OVER t - 1 AS pos
        FROM marked m WINDOW t AS (PARTITION BY lang ORDER BY doc_id, leaf)),
    ranked_roots AS (SELECT g, height, subroot, row_number() OVER (ORDER BY g) - 1 AS top_pos FROM subroots),
    siblings AS (
        SELECT w.doc_id, n.level, string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < w.pos >> (3 * n.level)) AS l,
               string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > w.pos >> (3 * n.level)) AS r
        FROM ways w JOIN nodes n ON n.g = w.g AND n.n > 1 AND n.pos >> 3 = w.pos >> (3 * n.level + 3) GROUP BY w.doc_id, n.level
        UNION ALL
        SELECT w.doc_id, s.height + n.level, string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < s.top_pos >> (3 * n.level)),
               string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > s.top_pos >> (3 * n.level))
        FROM ways w JOIN ranked_roots s ON s.g = w.g JOIN tops n ON n.n > 1 AND n.pos >> 3 = s.top_pos >> (3 * n.level + 3)
        GROUP BY w.doc_id, s.height, n.level),
    paths AS (
        SELECT doc_id, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level) AS flat,
               list({'l': coalesce(l, ''), 'r': coalesce(r, '')} ORDER BY level) AS path FROM siblings GROUP BY doc_id),
    folded AS (
        SELECT w.doc_id, 0 AS done, claimed AS node, coalesce(path, []) AS path FROM ways w LEFT JOIN paths p ON p.doc_id = w.doc_id
        UNION ALL
        SELECT doc_id, done + 1, sha256(path[done + 1].l || node || path[done + 1].r), path FROM folded WHERE done < len(path))
    SELECT w.doc_id, w.leaf, s.subroot, t.node AS root, sha256(coalesce(p.flat, '')) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
    FROM ways w JOIN subroots s ON s.g = w.g JOIN tops t ON t.n = 1 LEFT JOIN paths p ON p.doc_id = w.doc_id
    JOIN folded f ON f.doc_id = w.doc_id AND f.done = len(f.path)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of all documents; where 3 divides crc32(doc_id), a text with its A-Z lower-cased is held against the manifest."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    offered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.digest("doc_id", "source", "lang", "n_chars", lowered))
    leaves = documents(spark, folder).select("doc_id", "lang", merkle.digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), offered.alias("offered"))
    proved = merkle.proofs(leaves, "leaf", "lang", "doc_id")
    return proved.select("row.doc_id", "row.leaf", "subroot", "root", F.sha2(merkle.segments(F.col("path")), 256).alias("proof_sha256"),
                         merkle.fold(F.coalesce("row.offered", "row.leaf"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_decontamination", r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    item_words AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(10, len(ws)) AS t, unnest(list_transform(range(0, len(ws) - least(10, len(ws)) + 1),
                                                                               lambda i: array_to_string(ws[i + 1:i + least(10, len(ws))], ' '))) AS win
        FROM item_words WHERE len(ws) > 0),
    known AS (SELECT DISTINCT t, win FROM windows),
    placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM words),
    ahead AS (SELECT doc_id, pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM placed),
    found AS (
        SELECT a.doc_id, a.pos, k.t, k.win FROM (SELECT *, unnest((SELECT list(DISTINCT t) FROM known)) AS t FROM ahead) a
        JOIN known k ON k.t = a.t AND len(a.l) >= a.t AND array_to_string(a.l[1:a.t], ' ') = k.win),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + t)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT f.doc_id, w.item_id::VARCHAR AS item_id FROM found f JOIN windows w ON w.win = f.win) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN items i ON i.doc_id = w.doc_id
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.find(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations after the contract's damage, by crc32 of `conv_id:turn`; alive is false where a row is dropped."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(name.cast("binary")) % 20).alias("kind")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("alive"), F.explode(copies).alias("copy")).drop("copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    facts, lines = dialogue.repair(damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    done = facts.join(dialogue.digests(lines), "_group", "left")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
