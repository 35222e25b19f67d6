"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelake.session import scratch_folder

from . import (
    byte_network,
    chosen_path,
    huffman_files,
    line_dedup,
    main_text,
    merkle,
    mixing,
    ngram_join,
    packing,
    phrases,
    quotient_filter,
    toxicity,
    winnowing,
)
from .tables import read, stored


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(read(spark, folder, "pages"))


def op2_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = huffman_files.write(
        read(spark, folder, "documents"),
        scratch_folder(spark, "id-files"),
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
    )
    return huffman_files.read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    found = stored(packing.pieces(read(spark, folder, "documents"), tokenizer, end_id=1), "pieces")
    return packing.pack(found)


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(read(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    marked = quotient_filter.mark_copies(docs)
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return byte_network.score_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read(spark, folder, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.with_neighbours(read(spark, folder, "documents"))


def op11_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.join(read(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(read(spark, folder, "documents"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_huffman_ids,
        op3_best_fit,
        op4_ngram_join,
        op5_toxicity,
        op6_exact_dedup,
        op7_quality,
        op8_mixing,
        op9_line_dedup,
        op10_winnowing,
        op11_chosen_path,
        op12_merkle_manifest,
        op13_phrases,
    )
}


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _crc32_sql(value: str) -> str:
    """Each byte goes in, then eight shifts (marked -1) by the reversed polynomial."""
    steps = f"flatten(list_transform(string_split({value}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda r, x: {shift}))"


def _paths_sql(leaves: str, tree: str) -> str:
    """What stands before and after each leaf's ancestors in their runs of three."""
    return f"""
        SELECT l.grp, l.i, lvl, coalesce(string_agg(h, '' ORDER BY t.i) FILTER (WHERE t.i < l.at), '') AS before,
            coalesce(string_agg(h, '' ORDER BY t.i) FILTER (WHERE t.i > l.at), '') AS after
        FROM (SELECT grp, i, lvl, i // CAST(3 ** lvl AS BIGINT) AS at
            FROM {leaves} JOIN (SELECT DISTINCT grp, lvl FROM {tree} WHERE n > 1) USING (grp)) l
        JOIN {tree} t USING (grp, lvl) WHERE t.n > 1 AND t.i // 3 = l.at // 3 GROUP BY l.grp, l.i, lvl"""


def _tree_sql(leaves: str, tree: str) -> str:
    return f"""{tree}(grp, lvl, i, h, n) AS (
            SELECT grp, 0, i, leaf, count(*) OVER (PARTITION BY grp) FROM {leaves}
            UNION ALL SELECT grp, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
            FROM {tree} WHERE n > 1 GROUP BY grp, lvl, n, i // 3)"""


_MERKLE_SQL = f"""
    WITH RECURSIVE hashed AS (
        SELECT coalesce('=' || source, '') AS grp, doc_id, {_leaf_sql("text")} AS leaf,
            {_leaf_sql("replace(text, chr(10), '')")} AS changed FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
    {_tree_sql("leaves", "tree")},
    subs AS (SELECT '' AS grp, grp AS source, h AS leaf, row_number() OVER (ORDER BY grp) - 1 AS i FROM tree WHERE n = 1),
    {_tree_sql("subs", "tops")},
    low AS ({_paths_sql("leaves", "tree")}), high AS ({_paths_sql("subs", "tops")}),
    steps AS (
        SELECT *, row_number() OVER (PARTITION BY grp, i ORDER BY lvl) AS step FROM (
            SELECT * FROM low UNION ALL
            SELECT l.grp, l.i, 1000 + high.lvl, before, after
            FROM leaves l JOIN subs s ON s.source = l.grp JOIN high ON high.i = s.i)),
    proofs AS (SELECT grp, i, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY grp, i),
    folds(grp, i, step, h) AS (
        SELECT grp, i, 0, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN changed ELSE leaf END FROM leaves
        UNION ALL SELECT grp, i, folds.step + 1, sha256(before || h || after)
        FROM folds JOIN steps USING (grp, i) WHERE steps.step = folds.step + 1)
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
    FROM leaves l JOIN (SELECT source AS grp, leaf AS subroot FROM subs) USING (grp) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r LEFT JOIN proofs p USING (grp, i)
    JOIN (SELECT grp, i, max_by(h, step) AS h FROM folds GROUP BY grp, i) f USING (grp, i)"""
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GRAMS = ", ".join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (1, 2, 3))
_PHRASES_SQL = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (SELECT lang, unnest(flatten([{_GRAMS}])) AS phrase FROM listed),
    counts AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a) AS n FROM counts WHERE len(w) = 1 GROUP BY lang),
    candidates AS (SELECT * FROM counts WHERE len(w) > 1 AND a >= 10),
    cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM candidates),
    scores AS (
        SELECT c.lang, c.phrase, c.a, k, f.a AS l, g.a AS r, 1000000 * c.a * c.a // (f.a * g.a) AS score
        FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:k], ' ')
        JOIN counts g ON g.lang = c.lang AND g.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_parts AS (
        SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS above
        FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE len(w) = 3) GROUP BY ALL),
    ranked AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
        FROM best LEFT JOIN inner_parts USING (lang, phrase) WHERE above IS NULL OR 100 * above < 50 * a)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
def _links_sql(width: int, tail: str = "") -> str:
    """Components of documents by shared shingles of ``width`` words, at 80 % of the union."""
    return rf"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingled AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [hash(array_to_string(w, ' '))]
            ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: hash(array_to_string(w[i:i + {width - 1}], ' '))) END) AS s FROM texts),
    groups AS (SELECT list_sort(s) AS s, min(doc_id) AS least, len(any_value(s)) AS n FROM shingled GROUP BY list_sort(s)),
    entries AS (SELECT least, n, unnest(s) AS shingle FROM groups),
    links AS (
        SELECT a.least AS a, b.least AS b FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.least < b.least AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
        GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, component) AS (
        SELECT least, least FROM groups UNION SELECT b, component FROM reached JOIN both_ways ON a = reached.doc_id)
    SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id{tail}
    FROM shingled d LEFT JOIN groups g ON list_sort(d.s) = g.s AND len(d.s) > 0
    LEFT JOIN (SELECT doc_id, min(component) AS component FROM reached GROUP BY doc_id) c ON c.doc_id = g.least"""


# The other results have no SQL form, or one that is too slow on whole tables: pages are read
# by rules, ids come from a tokenizer, scores from fitted models, orders from hashes. Their tests compare with brute force.
ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_ngram_join": _links_sql(5),
    "op11_chosen_path": _links_sql(4, ", coalesce(c.component, d.doc_id) = d.doc_id AS kept"),
    "op12_merkle_manifest": _MERKLE_SQL,
    "op13_phrases": _PHRASES_SQL,
}
