"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .common import table
from .jaccard_join import jaccard_groups
from .language_id import identify_languages
from .line_dedup import dedup_lines, line_digest
from .lm_scoring import score_documents
from .merkle import merkle_manifest
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .secrets import scan_secrets, secret_digest
from .sharding import shard_by_splitters
from .topk import exact_top_k


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(dedup_lines(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_rules": op4_quality_rules,
        "op5_bpe": op5_bpe,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_sharding": op7_sharding,
        "op8_secret_scans": op8_secret_scans,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_language_id": op10_language_id,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_line_dedup": op13_line_dedup,
    }


#: Brute force over all pairs of a query and a vector.
TOP_K = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id AS query_id, e.id AS vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.id <> e.id AND len(q.v) = len(e.v) WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: Brute force over all pairs of texts that share a shingle; components by recursion.
JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT min(doc_id) AS doc_id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS (SELECT doc_id, n, unnest(s) AS t FROM c), u AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM u WHERE 100 * k >= 75 * (na + nb - k) UNION ALL SELECT b, a FROM u WHERE 100 * k >= 75 * (na + nb - k)),
p AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT p.x, l.b FROM p JOIN l ON p.y = l.a), m AS (SELECT x, min(y) AS y FROM p GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.y, s.doc_id) AS component_id FROM s LEFT JOIN c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN m ON m.x = c.doc_id"""


#: Unsigned crc32 of a decimal number ({0}), a bit at a time.
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len({0}::VARCHAR) + 1), lambda i: ascii(({0}::VARCHAR)[i])::BIGINT), lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda k: k::BIGINT), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
WORDS_OF = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"

#: Prefixes as lists of turns; a subtree by the prefixes that start with its top.
TRIE = (
    r"""WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(m ORDER BY pos) AS m FROM t GROUP BY c), h AS (SELECT c, m, """
    + CRC.format("c")
    + r""" % 4 AS h FROM o),
b AS (SELECT h.c, coalesce(o.m[1:h.h], []) || h.m[h.h + 1:] AS m FROM h LEFT JOIN o ON o.c = h.c - h.c % 20),
p AS (SELECT c, len(m) AS n, unnest(range(len(m) + 1)) AS d, m FROM b), q AS (SELECT c, n, d, m[1:d] AS m FROM p),
k AS (SELECT d, m, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends FROM q GROUP BY d, m),
e AS (SELECT k.*, (n - 1) * CASE WHEN d = 0 THEN 0 ELSE """
    + WORDS_OF.format("m[d].t")
    + r""" END AS own, u.c0 AS pc, u.d0 AS pd FROM k LEFT JOIN (SELECT d AS d0, m AS m0, c AS c0 FROM k) u ON k.d > 0 AND u.d0 = k.d - 1 AND u.m0 = k.m[1:k.d - 1]),
f AS (SELECT e.*, (SELECT count(*) FROM e x WHERE x.pc = e.c AND x.pd = e.d) AS kids FROM e),
up AS (SELECT c, d, pc, pd, own, (kids = 0)::INT AS leaf FROM f UNION ALL SELECT f.c, f.d, f.pc, f.pd, up.own, up.leaf FROM up JOIN f ON f.c = up.pc AND f.d = up.pd),
s AS (SELECT c, d, sum(own) AS saved, sum(leaf) AS leaves FROM up GROUP BY c, d)
SELECT f.c AS conv_id, f.d AS depth, f.pc AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256 FROM f JOIN s ON s.c = f.c AND s.d = f.d"""
)

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: Levels by recursion; a path folds upwards with its siblings.
MERKLE = (
    "WITH RECURSIVE d AS (SELECT doc_id, lang, "
    + _LEAF.format("text")
    + " AS leaf, CASE WHEN "
    + CRC.format("doc_id")
    + " % 3 = 0 THEN "
    + _LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ ELSE NULL END AS bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
v AS (SELECT lang, 0 AS k, i, n, leaf AS h FROM l UNION ALL SELECT lang, k + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM v WHERE n > 1 GROUP BY lang, k, i // 8),
g AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
w AS (SELECT 0 AS k, i, n, h FROM g UNION ALL SELECT k + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM w WHERE n > 1 GROUP BY k, i // 8),
tops AS (SELECT lang, max(k) AS top FROM v GROUP BY lang),
a AS (SELECT lang, true AS low, k, i, h FROM v UNION ALL SELECT NULL, false, k, i, h FROM w),
path AS (SELECT l.doc_id, l.lang, l.i AS leaf_i, l.leaf, coalesce(l.bad, l.leaf) AS x, true AS low, 0 AS k, l.i AS i, '' AS proof FROM l
UNION ALL SELECT p.doc_id, p.lang, p.leaf_i, p.leaf, CASE WHEN up THEN p.x ELSE sha256(s.l || p.x || s.r) END, CASE WHEN up THEN false ELSE p.low END, CASE WHEN up THEN 0 ELSE p.k + 1 END, CASE WHEN up THEN g.i ELSE p.i // 8 END, p.proof || CASE WHEN up THEN '' ELSE s.l || s.r END
FROM (SELECT p.*, t.top, p.low AND p.k = t.top AS up FROM path p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang) p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN LATERAL (SELECT coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (WHERE a.i < p.i), '') AS l, coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (WHERE a.i > p.i), '') AS r FROM a WHERE a.low = p.low AND a.k = p.k AND a.i // 8 = p.i // 8 AND (NOT p.low OR a.lang IS NOT DISTINCT FROM p.lang)) s ON true
WHERE p.low OR p.k < (SELECT max(k) FROM w))
SELECT p.doc_id, p.leaf, g.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.x AS folded_root, p.x = r.h AS verified FROM path p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang, (SELECT h FROM w WHERE n = 1) r WHERE NOT p.low AND p.k = (SELECT max(k) FROM w)"""
)

#: A line's documents are counted and its largest found by one grouping.
LINES = r"""WITH l AS (SELECT doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
k AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.owner IS NULL OR k.owner = l.doc_id AS kept FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators (models, tokenizers, packing, sampled splitters, spans) are beyond SQL; tests hold them against
    brute force."""
    return {"op2_exact_top_k": TOP_K, "op3_jaccard_join": JACCARD, "op11_prefix_trie": TRIE, "op12_merkle_manifest": MERKLE, "op13_line_dedup": LINES}
