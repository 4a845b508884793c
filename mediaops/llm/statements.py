"""DuckDB statements of the results that SQL can express."""

from __future__ import annotations

# crc32 of the decimal id: each character is mixed in, then eight shift steps (given as 999).
_CRC = """
    xor(list_reduce(
        list_prepend(4294967295::UBIGINT, flatten(list_transform(
            string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::UBIGINT, list_transform(range(8), lambda i: 999::UBIGINT))
        ))),
        lambda c, b: CASE WHEN b <> 999 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
    ), 4294967295::UBIGINT)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
           CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS start,
           {_CRC} % 7 = 0 AS tampered
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
), tree AS (
    SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree_at, count(*) OVER () AS n
    FROM tree WHERE n = 1
), upper_tree AS (
    SELECT 0 AS level, tree_at AS pos, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2
), heights AS (
    SELECT lang, max(level) AS height FROM tree GROUP BY lang
), rows_ AS (
    SELECT row_number() OVER () AS r, p.*, s.subroot, s.tree_at, t.height
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN heights t ON p.lang IS NOT DISTINCT FROM t.lang
), siblings AS (
    SELECT r.r, t.level, r.pos >> t.level::BIGINT & 1 AS side, o.h
    FROM rows_ r JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON r.lang IS NOT DISTINCT FROM t.lang
    LEFT JOIN tree o ON o.lang IS NOT DISTINCT FROM r.lang AND o.level = t.level AND o.pos = xor(r.pos >> t.level::BIGINT, 1)
    UNION ALL
    SELECT r.r, r.height + t.level, r.tree_at >> t.level::BIGINT & 1, o.h
    FROM rows_ r CROSS JOIN (SELECT DISTINCT level FROM upper_tree WHERE n > 1) t
    LEFT JOIN upper_tree o ON o.level = t.level AND o.pos = xor(r.tree_at >> t.level::BIGINT, 1)
), folded AS (
    SELECT r, 0 AS level, start AS h FROM rows_
    UNION ALL
    SELECT f.r, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END)
    FROM folded f JOIN siblings s ON s.r = f.r AND s.level = f.level
), last_ AS (
    SELECT r, arg_max(h, level) AS folded_root, max(level) AS height FROM folded GROUP BY r
), proofs AS (
    SELECT r, string_agg(h, '' ORDER BY level) AS proof FROM siblings GROUP BY r
)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       folded_root, folded_root = (SELECT h FROM upper_tree WHERE n = 1) AS verified,
       CASE WHEN tampered THEN last_.height ELSE 0 END::BIGINT AS n_copied
FROM rows_ JOIN last_ USING (r) LEFT JOIN proofs USING (r)
"""

_TERMS = r"""unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
    )) AS term"""

RANKED = f"""
WITH asked AS (
    SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), sums AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths
), norms AS (
    SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM lengths CROSS JOIN sums
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted CROSS JOIN sums GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN norms USING (doc_id) JOIN weights USING (term)
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
