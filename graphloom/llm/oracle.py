"""DuckDB SQL for those queries of the subpackage that SQL can express."""

from graphloom.llm.corpus_rules import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_WORD = r"[^\x20\x09-\x0D]+"
#: Least id reachable by links (a, b), by growing the pairs of a node and what it reaches.
_REACH = """reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        root AS (SELECT {id}, least({id}, coalesce((SELECT min(b) FROM reach WHERE a = {id}), {id})) AS least FROM {source})"""


def _embedding_links(threshold: float) -> str:
    return f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {threshold}),
        {_REACH.format(id="vec_id", source="embeddings")}
        SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, least AS component_id, vec_id = least AS kept FROM root
    """


ORACLE = {
    "op1_url_filters": f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
        cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        place AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ),
        ranked AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
            FROM place LEFT JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE n = 1
    """,
    "op3_substring_dedup": rf"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM docs),
        wins AS (SELECT doc_id, s, md5(array_to_string(words[s : s + 19], ' ')) AS w FROM starts),
        later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM wins) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept USING (doc_id)
    """,
    "op4_embedding_near_dedup": _embedding_links(0.9),
    "embedding_links_at_038": _embedding_links(0.38),
    "op8_suffix_dedup": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        size AS (SELECT doc_id, h, length(h) // 2 AS n FROM docs),
        part AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 2 * (512 + 199)) AS p FROM (SELECT *, unnest(range(0, n - 199, 512)) AS c FROM size)),
        wins AS (SELECT doc_id, c + k AS s, md5(substr(p, 2 * k + 1, 400)) AS w FROM (SELECT *, unnest(range(0, least(512, n - 199 - c))) AS k FROM part)),
        twice AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY w) AS times FROM wins) WHERE times > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 200)) AS i FROM twice),
        run AS (SELECT doc_id, i, CASE WHEN i = lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 1 THEN 0 ELSE 1 END AS opens FROM gone),
        span AS (SELECT doc_id, r, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM run) GROUP BY 1, 2),
        edge AS (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, n, n FROM size),
        hole AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS z FROM edge),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, z) AS t FROM hole JOIN size USING (doc_id) GROUP BY 1),
        lost AS (SELECT doc_id, sum(b - a) AS k, count(*) AS m FROM span GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(k, 0)::BIGINT AS n_removed, coalesce(m, 0) AS n_spans, sha256(from_hex(t)) AS kept_sha256
        FROM size JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
    """,
    "op6_ngram_jaccard_join": rf"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents
        ),
        starts AS (SELECT doc_id, words, unnest(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 3, 2) END)) AS s FROM docs),
        sets AS (SELECT DISTINCT doc_id, md5(array_to_string(words[s : s + 4], ' ')) AS x FROM starts),
        size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sets p JOIN sets q USING (x) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        {_REACH.format(id="doc_id", source="documents")}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id FROM root LEFT JOIN size USING (doc_id)
    """,
}
