"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlake.llm import debruijn, decontaminate, exact, jaccard, language, lexical, packing, quality, suffixes, toxicity, trie, urls, warc
from tenderlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


@register("op1_url_trust")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its host's propagated trust."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op4_kk_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")


@register("op5_warc_revisits", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
                      sha256(html) AS payload_digest FROM p),
         m AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM d JOIN m USING (payload_digest)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as deduplicated WARC archives and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_cuckoo_dedup", """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@register("op8_trie_jaccard", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r),
    low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN low ON low.doc_id = d.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of all documents."""
    return jaccard.linked_classes(table(spark, sf_dir, "documents")).drop("text_key")


@register("op8_jaccard_links")
def op8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of all documents, and each one's number of links to different texts."""
    return jaccard.linked_classes(table(spark, sf_dir, "documents"), count=True).drop("text_key")


@register("op7_language_fusion")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: text, declared language and host prior."""
    return language.identify_documents(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "declared", "lang", "posterior", "accepted")


@register("op7_page_languages")
def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: text, language its markup declares, host and address suffix."""
    return language.identify_pages(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "declared", "lang", "posterior", "accepted")


@register("op9_quality_qda")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_subword_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_cgk_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_sparse_suffixes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur again, in all documents."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


#: crc32 of a text, bit by bit: a byte is added to the state, which is then shifted eight times
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(x) + 1), lambda i: ascii(x[i])::BIGINT)),
    lambda state, byte: list_reduce([xor(state, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


@register("op11_prefix_trie", f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h
          FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS x FROM t)),
    parts AS (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
              UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
    r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, role, text FROM parts),
    p AS (SELECT conv_id, depth, len(text) AS chars,
                 list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM r
          UNION ALL SELECT conv_id, 0, 0, [] FROM c),
    ends AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
    n AS (SELECT depth, seq, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                 sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = size), '')) AS ends_sha256
          FROM p JOIN ends ON ends.conv_id = p.conv_id GROUP BY depth, seq),
    k AS (SELECT a.depth, a.seq, min(b.conv_id) AS parent_conv_id FROM n a JOIN n b ON b.depth = a.depth - 1 AND b.seq = a.seq[:-2] GROUP BY a.depth, a.seq),
    m AS (SELECT n.*, parent_conv_id FROM n LEFT JOIN k ON k.depth = n.depth AND k.seq = n.seq),
    kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
    f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN kids ON kids.conv_id = m.conv_id AND kids.depth = m.depth)
    SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
           CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
    FROM f a JOIN f b ON b.depth >= a.depth AND b.seq[:a.depth] = a.seq
    GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on its hundred's first one."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 100,
                            head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most=5).drop("ref_conv", "ref_place")


@register("op13_document_fptree", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
    t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n_docs),
    m AS (SELECT doc_id, 10 + (90 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_debruijn_repeats", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
    w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
    kept AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id)
    SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of runs of 20 that start earlier too."""
    return debruijn.cut_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
