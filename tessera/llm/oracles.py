"""DuckDB SQL with the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, WINDOW

_SPACE = r"[\x20\x09-\x0D]+"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}'), lambda w: w <> '')"


def _closure(links: str, nodes: str) -> str:
    """CTEs ending in comp(id, c): the least node reachable by links(a, b), which hold both ways."""
    return f"reach(id, r) AS (SELECT {nodes} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.r), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    values = {"mean_word": "word_chars", "symbol_ratio": "n_symbols", "exclaim_ratio": "n_exclaim", "stop_ratio": "n_stop", "echo_ratio": "n_echo"}
    passed = []
    for _, k, low, high in RULES:
        x = f"coalesce({values[k]} / nullif(n_words, 0), 0)" if k in values else "coalesce(n_dup_lines / nullif(n_lines, 0), 0)"
        passed += [f"{x} >= {low}::DOUBLE"] * (low is not None) + [f"{x} <= {high}::DOUBLE"] * (high is not None)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, h FROM h GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM h JOIN twice USING (doc_id, h)) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!')) AS n_exclaim,
 len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 len(list_filter(ws, lambda w: lower(rtrim(w, '.,;:!?#*$%&|')) IN ({stop}))) AS n_stop, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echo FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(passed)} AS kept FROM f"""


_NGRAM = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{_closure('l', 'doc_id, doc_id FROM documents')}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN comp ON id = d.doc_id"""

_EMBEDDING = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS z FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y WHERE x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) / (x.z * y.z) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), {_closure('l', 'vec_id, vec_id FROM embeddings')}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v LEFT JOIN n ON a = vec_id JOIN comp ON id = vec_id"""

_SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (h) WHERE doc_id > least),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""

ORACLES = {"op2_ngram_join": _NGRAM, "op4_embedding_dedup": _EMBEDDING, "op6_quality": _quality(), "op10_substring_dedup": _SUBSTRING}
