"""SQL for DuckDB that gives the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from . import license_scan, quality_rules

SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array({{}}, '{SPACES}'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ngram_join() -> str:
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
    g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS shingle FROM g),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b)
    SELECT r.doc_id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def embedding_join() -> str:
    return """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    o AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b)
    SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.id) AS n_links, min(root) AS component_id, id = min(root) AS kept FROM r GROUP BY id"""


def substring_dedup() -> str:
    return f"""
    WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
    x AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win FROM p),
    f AS (SELECT win, min(doc_id) AS m FROM x GROUP BY win),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f ON f.win = x.win WHERE m < doc_id),
    u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
    kept AS (SELECT u.doc_id AS doc_id, string_agg(word, ' ' ORDER BY u.k) AS t, count(*) AS n FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.k = u.k WHERE g.k IS NULL GROUP BY 1)
    SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def rules() -> str:
    q = quality_rules
    return rf"""
    WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, host, t, {WORDS.format("t")} AS ws FROM d),
    g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
    r AS (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT g.doc_id AS doc_id, unnest(range(i, i + 5)) AS k FROM g JOIN r ON r.doc_id = g.doc_id AND r.gram = g.gram) GROUP BY 1),
    l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
    m AS (SELECT doc_id, host, line, trim(regexp_replace(lower(line), '{SPACES}', ' ', 'g')) AS norm FROM l),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM m WHERE norm <> '' GROUP BY 1),
    h AS (SELECT DISTINCT doc_id, host, md5(norm) AS h FROM m WHERE norm <> ''),
    c AS (SELECT h.host AS host, h, count(DISTINCT md5(t)) AS n FROM h JOIN d ON d.doc_id = h.doc_id GROUP BY 1, 2),
    hosts AS (SELECT host, count(*) AS n FROM d GROUP BY 1),
    bad AS (SELECT c.host AS host, c.h AS h FROM c JOIN hosts ON hosts.host IS NOT DISTINCT FROM c.host WHERE c.n > {q.LINE_MIN_DOCS} AND c.n > least({q.LINE_MAX_SHARE} * hosts.n, {q.LINE_MOST_DOCS})),
    gone AS (SELECT doc_id, CAST(sum(len({WORDS.format("line")})) AS BIGINT) AS n FROM m JOIN bad ON bad.h = md5(m.norm) AND bad.host IS NOT DISTINCT FROM m.host WHERE norm <> '' GROUP BY 1),
    s AS (SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - gone >= {q.LEFT_MIN_WORDS} AND n_words - gone >= {q.LEFT_MIN_SHARE} * n_words AS kept FROM s"""


def licenses() -> str:
    def canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(license_scan.CLAIM)}, '\\1', 'g')"
        for a, b in license_scan.EQUIVALENT:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in license_scan.KNOWN.items())
    return f"""
    WITH k AS (SELECT body, min(id) AS license_id FROM (SELECT id, {canonical("body")} AS body FROM (VALUES {values}) v(id, body)) GROUP BY 1),
    d AS (SELECT doc_id, text, {canonical("text")} AS canon FROM documents),
    hit AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM d JOIN k ON contains(' ' || canon || ' ', ' ' || body || ' ') GROUP BY 1)
    SELECT d.doc_id AS doc_id, sha256(canon) AS digest, k.license_id AS license_id, coalesce(hit.ids, '') AS notices,
      coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, {quoted(license_scan.SPDX)}, 1))), ','), '') AS spdx
    FROM d LEFT JOIN k ON k.body = d.canon LEFT JOIN hit ON hit.doc_id = d.doc_id"""
