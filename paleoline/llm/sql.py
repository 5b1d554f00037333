"""SQL over the same tables for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_pos DESC) rn FROM lines WHERE id IS NOT NULL) WHERE rn = 1)"

# Letters of another width or form that the tables hold, and the usual ones, for levelling.
_WIDE = "".join(chr(0xFF21 + k) for k in range(26)) + "".join(chr(0xFF41 + k) for k in range(26)) + "ſªº"
_USUAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "sao"


def _level(x: str) -> str:
    """Levelled letters of a text."""
    forms = f"replace(replace(replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬅ', 'st'), 'ﬆ', 'st')"
    plain = f"lower(strip_accents(translate({forms}, '{_WIDE}', '{_USUAL}')))"
    return f"regexp_replace(replace(replace(translate({plain}, 'vj', 'ui'), 'æ', 'ae'), 'œ', 'oe'), '[^a-z]', '', 'g')"


_EDGE = "regexp_replace(x, '^[\\s\\p{Z}\\p{Cf}]+|[\\s\\p{Z}\\p{Cf}]+$', '', 'g')"
_GROUPS = f"""e AS (
        SELECT doc_id, upper({_EDGE}) e FROM (SELECT doc_id, unnest([author_id, source_id]) x FROM works) WHERE regexp_matches(upper({_EDGE}), '^[PS][0-9]{{7}}$')
        UNION SELECT doc_id, 'W:' || regexp_extract(id, '^(.+)-[^-]+-[^-]+-lb-', 1) FROM {CURRENT} WHERE regexp_extract(id, '^(.+)-[^-]+-[^-]+-lb-', 1) <> ''),
    s AS (SELECT DISTINCT a.doc_id n, b.doc_id m FROM e a JOIN (SELECT e, min(doc_id) doc_id FROM e GROUP BY e) b USING (e) WHERE a.doc_id <> b.doc_id),
    g AS (SELECT n, m FROM s UNION SELECT m, n FROM s),
    r AS (SELECT n, n AS root FROM (SELECT DISTINCT n FROM g) UNION SELECT g.m, r.root FROM r JOIN g ON r.n = g.n WHERE r.root < g.m),
    found AS (SELECT min(root) AS group_doc, n AS doc_id FROM r GROUP BY n HAVING min(root) <> n)"""
# Every pair of a length that allows it, by edit distance: slow, but whole.
_PAIRS = f"""l AS (SELECT c.id, w.split, w.source_id, {_level("source_sic")} AS t FROM {CURRENT} c JOIN (SELECT doc_id, min(split) AS split, min(source_id) AS source_id FROM works WHERE split IN ('train', 'val', 'test') GROUP BY doc_id) w ON w.doc_id = c.doc_id),
    k AS (SELECT *, length(t) AS n FROM l WHERE length(t) >= 50),
    p AS (SELECT a.id AS id_train, b.id AS id_eval, b.split, b.source_id, levenshtein(a.t, b.t) AS d FROM k a JOIN k b ON a.split = 'train' AND b.split <> 'train' AND b.n BETWEEN a.n * 9 // 10 - 1 AND a.n * 10 // 9 + 2 WHERE levenshtein(a.t, b.t) <= greatest(a.n, b.n) // 10)"""
_WORDS = lambda table, key: f"""(SELECT {key}, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '[\\p{{Cf}}]', '', 'g'), '([\\p{{L}}\\p{{M}}⦃⦄])[-‐‑⸗﹣－][^\\S\\n\\r]*[\\n\\r]+\\s*', '\\1', 'g'), '[\\s\\p{{Z}}]+'), lambda x: {_level("x")}), lambda x: x <> '') AS w FROM {table} WHERE text <> '' AND {key} IS NOT NULL)"""
_LEAKED = f"""i AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM {_WORDS("eval_items", "item_id")} WHERE len(w) >= 12),
    d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM {_WORDS("documents", "doc_id")} WHERE len(w) >= 12),
    f AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (s))"""

# A letter of one script and one of another within a run of letters, marks and abbreviation brackets.
_OTHER, _IN = "[\\p{Greek}\\p{Cyrillic}\\p{Armenian}\\p{Cherokee}\\p{Coptic}]", "[\\p{L}\\p{M}⦃⦄]*"
_MIXED = f"[a-zA-ZÀ-ÖØ-öø-ɏ]{_IN}{_OTHER}|{_OTHER}{_IN}[a-zA-ZÀ-ÖØ-öø-ɏ]"
# Invisible characters, blanks other than the ordinary one, and width and presentation forms.
_DIRT = r"[\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{FE00}-\x{FE0F}\x{034F}]|[\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2800}\t\n\r\x0b\x0c\x1c-\x1f\x85]|[\x{FB00}-\x{FB06}\x{FF01}-\x{FFEF}\x{1D400}-\x{1D7FF}]"
_DIRTY = lambda f: f"SELECT id, '{f}' AS field FROM {CURRENT} WHERE regexp_matches({f}, '{_DIRT}') OR length(nfc_normalize({f})) < length({f}) OR regexp_matches(nfc_normalize({f}), '{_MIXED}')"

SQL = {
    "p2_found": f"WITH {_PAIRS} SELECT least(id_train, id_eval) AS id_a, greatest(id_train, id_eval) AS id_b FROM p",
    "p2_report": f"WITH {_PAIRS} SELECT split, source_id, count(*) AS pairs, count(DISTINCT id_eval) AS eval_lines, count(DISTINCT id_train) AS train_lines, count(*) FILTER (d = 0) AS exact FROM p GROUP BY split, source_id",
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT group_doc, doc_id FROM found",
    "p4_balance": f"""WITH RECURSIVE {_GROUPS}, a AS (SELECT doc_id FROM works WHERE doc_id IS NOT NULL UNION SELECT doc_id FROM {CURRENT} WHERE doc_id IS NOT NULL)
        SELECT (SELECT count(*) FROM a) AS documents, (SELECT count(*) FROM a) - (SELECT count(*) FROM found) AS groups, 0 AS divided, true AS near""",
    "p5_found": f"{_DIRTY('source_sic')} UNION ALL {_DIRTY('target_corr')}",
    "p6_found": f"""
        SELECT id, 'source_sic' AS field FROM {CURRENT} WHERE strlen(source_sic) > 480
        UNION ALL SELECT id, 'target_corr' FROM {CURRENT} WHERE strlen(target_corr) > 480""",
    "p6_cover": f"""
        SELECT id, 'source_sic' AS field, length(source_sic) AS chars, true AS fits FROM {CURRENT} WHERE source_sic IS NOT NULL
        UNION ALL SELECT id, 'target_corr', length(target_corr), true FROM {CURRENT} WHERE target_corr IS NOT NULL""",
    "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096",
    "p8_tokens": "SELECT doc_id, strlen(text) + 1 AS tokens, true AS fits FROM documents WHERE text IS NOT NULL",
    "p9_found": f"WITH {_LEAKED} SELECT doc_id, item_id FROM f",
    "p9_items": f"WITH {_LEAKED}, n AS (SELECT item_id, count(*) AS documents FROM f GROUP BY item_id) SELECT DISTINCT e.item_id, e.set_name, coalesce(n.documents, 0) AS documents FROM eval_items e LEFT JOIN n USING (item_id)",
}
