"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossgrid.llm import decontaminate, exact_dedup, hard_negatives, html_wrapper, lm, near_dedup, packing, pieces, pii, substring_dedup, top_k, toxicity, whitening
from crossgrid.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; CROSSGRID_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("CROSSGRID_TOKENIZERS"):
        return f"{folder}/{name}"
    try:
        import public_tokenizers
    except ImportError:
        if "/opt/tokenizers" not in sys.path:
            sys.path.append("/opt/tokenizers")
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def token_pattern() -> str:
    """The pre-token pattern that comes with the public vocabulary files."""
    tokenizer_path("")
    import public_tokenizers

    return public_tokenizers.PATTERN


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: the remainder of crc32(doc_id as text) by 5 is not 0."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query("op1_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(Tables(spark, sf_dir).documents)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and whether they decode to it; tested against brute force and exact round trips."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    out = pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "n_byte_pieces", "piece_ids", "round_trip", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = "regexp_extract_all(" + _ASCII_LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_decontaminate", f"""
    WITH items AS (
        SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM benchmark
    ), item_windows AS (
        SELECT DISTINCT item, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS win
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT n FROM item_windows
    ), docs AS (
        SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM documents
    ), doc_windows AS (
        SELECT r, n, i, w[i : i + n - 1] AS win
        FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
    ), hits AS (SELECT r, i, d.n, item FROM doc_windows d JOIN item_windows USING (win)
    ), words AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
    ), found AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    out = decontaminate.contamination(t.documents, t.benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op6_token_rows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of every document's token ids; tested by an exact round trip."""
    with open(tokenizer_path("byte_bpe_50k.tiktoken")) as f:
        vocabulary = f.read()
    return packing.pack_documents(Tables(spark, sf_dir).documents, vocabulary, token_pattern())


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; tested by held-out accuracy and against plain FTRL on a fixture."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    model = toxicity.train(docs, training_rows(t.labels))
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


_WORDS = "regexp_extract_all(" + _ASCII_LOWER + ", '[^\\x20\\x09-\\x0D]+')"


@query("op8_html_wrapper")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; tested on pages of known content and, with wrappers switched off, against the plain rules."""
    return html_wrapper.extract(Tables(spark, sf_dir).pages)


@query("op9_near_dedup", f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM docs WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
    ), reach(d, e) AS (SELECT doc_id, doc_id FROM docs UNION SELECT d, y FROM reach JOIN links ON e = x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept
    FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT d AS doc_id, min(e) AS low FROM reach GROUP BY d) USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(Tables(spark, sf_dir).documents, shingle=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and revealing words of every text, by whole documents; tested against a brute-force version."""
    out = pii.personal_data_everywhere(Tables(spark, sf_dir).documents)
    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS))

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op5_substring_dedup", """
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS d, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT r, d, i, array_to_string(w[i : i + 12], ' ') AS s
        FROM (SELECT r, d, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
    ), bad AS (SELECT r, i FROM (SELECT r, i, d, min(d) OVER (PARTITION BY s) AS low FROM windows) WHERE low < d
    ), gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM bad)
    ), words AS (
        SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM docs)
    ), kept AS (
        SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r
    ), counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(Tables(spark, sf_dir).documents)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; the model's own score is tested against a brute-force trie-free version."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    out = lm.score_texts(docs, train="crc32(cast(doc_id as string)) % 10 <> 0")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_WHOLE = "list_transform(embedding, lambda x: floor({} * CAST(x AS DOUBLE)))"
_FINITE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_hard_negatives", f"""
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab, {_WHOLE.format(256)} AS x
        FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.lab = b.lab AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 100 * s BETWEEN 80 * positive_score AND 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(Tables(spark, sf_dir).embeddings, F.col("vec_id") % 100 == 0, moved, 256)


@query("op12_top_k", f"""
    WITH rows AS (SELECT vec_id, {_WHOLE.format(1024)} AS x FROM embeddings WHERE {_FINITE}
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
        FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(Tables(spark, sf_dir).embeddings, F.col("vec_id") % 100 == 0, 10, 1024)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened vectors; tested against exact sums and a plain eigendecomposition."""
    return whitening.whiten(Tables(spark, sf_dir).embeddings, 64, 1_000_000)
