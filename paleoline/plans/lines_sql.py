"""SQL over the same tables for the queries of :mod:`paleoline.plans.lines` that SQL can express on whole tables."""

from __future__ import annotations

from paleoline.functions.text import FOLD_DIAG
from paleoline.sources.characters import CHARACTERS

CUR = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_pos DESC) rn FROM lines WHERE id IS NOT NULL) WHERE rn = 1)"
KEYS = (
    CUR
    + """, k0 AS (SELECT *, string_split(split_part(id, '-lb-', 1), '-') a, split_part(id, '-lb-', 2) q FROM cur),
    k AS (SELECT * EXCLUDE (a, q), CASE WHEN len(a) > 2 THEN array_to_string(a[:-3], '-') ELSE '' END AS work, TRY_CAST(a[-2] AS INT) AS vol, TRY_CAST(a[-1] AS INT) AS page, q LIKE 'm%' AS marg,
        TRY_CAST(regexp_replace(q, '^m', '') AS INT) AS seq FROM k0)"""
)
_ORDER = "work NULLS FIRST, vol NULLS FIRST, page NULLS FIRST, marg NULLS FIRST, seq NULLS FIRST, file_pos"
SORTED = KEYS + f", s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) - 1 AS pos FROM k)"
PAIRS = KEYS + ", p AS (SELECT a.*, b.id AS next_id, b.source_sic AS next_source_sic, NOT (a.work IS NOT DISTINCT FROM b.work AND a.vol IS NOT DISTINCT FROM b.vol AND a.page IS NOT DISTINCT FROM b.page) AS crosses FROM k a JOIN k b ON a.nonbreaking_next_line = b.id WHERE a.nonbreaking_next_line <> '')"
BOUNDARIES = (
    PAIRS
    + f""", n0 AS (SELECT *, lead(id) OVER w AS nid, lead(source_sic) OVER w AS ns, lead(work) OVER w AS nw, lead(vol) OVER w AS nv, lead(page) OVER w AS np FROM k WINDOW w AS (PARTITION BY doc_id, ancestor_id ORDER BY {_ORDER})),
    b AS (SELECT id AS boundary_id, doc_id, lang, right(coalesce(source_sic, ''), 40) AS line_end, left(coalesce(next_source_sic, ''), 40) AS line_start, 1 AS label, crosses AS crosses_page_break FROM p
        UNION ALL SELECT id, doc_id, lang, right(coalesce(source_sic, ''), 40), left(coalesce(ns, ''), 40), 0, NOT (work IS NOT DISTINCT FROM nw AND vol IS NOT DISTINCT FROM nv AND page IS NOT DISTINCT FROM np)
        FROM n0 WHERE nid IS NOT NULL AND coalesce(nonbreaking_next_line, '') = '')"""
)


def _split(src: str) -> str:
    return f"""o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM {src} WHERE doc_id IS NOT NULL)),
    d AS (SELECT doc_id, CASE WHEN pos < greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'test' WHEN pos < 2 * greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM o)"""


CHAINS = (
    SORTED.replace("cur AS", "RECURSIVE cur AS", 1)
    + """, l AS (SELECT a.doc_id, a.pos, b.pos AS nxt FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.nonbreaking_next_line = b.id WHERE a.nonbreaking_next_line <> ''),
    reach AS (SELECT doc_id, pos, pos AS head FROM s UNION SELECT l.doc_id, l.nxt, reach.head FROM reach JOIN l ON l.doc_id = reach.doc_id AND l.pos = reach.pos),
    own AS (SELECT doc_id, pos, min(head) AS head_pos FROM reach GROUP BY ALL),
    size AS (SELECT doc_id, head_pos, count(*) AS n FROM own GROUP BY ALL),
    walk AS (SELECT doc_id, head_pos, head_pos AS pos, 0 AS at FROM size
        UNION ALL SELECT w.doc_id, w.head_pos, l.nxt, w.at + 1 FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.pos = w.pos JOIN own ON own.doc_id = w.doc_id AND own.pos = l.nxt AND own.head_pos = w.head_pos JOIN size z ON z.doc_id = w.doc_id AND z.head_pos = w.head_pos WHERE w.at + 1 < z.n),
    c AS (SELECT s.id, w.doc_id, w.pos, w.head_pos, w.at AS pos_in_chain FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos)"""
)
PROFILES = (
    CUR.replace("cur AS", "RECURSIVE cur AS", 1)
    + """, z AS (SELECT id, nonbreaking_next_line AS nxt, strlen(coalesce(source_sic, '')) AS bytes FROM cur),
    h AS (SELECT id FROM z WHERE id NOT IN (SELECT nxt FROM z WHERE nxt <> '')),
    w AS (SELECT h.id AS head, z.id, z.nxt, 1 AS n, CAST(z.bytes AS BIGINT) AS b FROM h JOIN z USING (id)
        UNION ALL SELECT w.head, z.id, z.nxt, w.n + 1, w.b + z.bytes + 3 FROM w JOIN z ON w.nxt = z.id WHERE w.n < 2000),
    pr AS (SELECT head, max(n) AS n_lines, max(b) AS n_bytes FROM w GROUP BY head HAVING max(n) < 2000)"""
)
SCORED = "sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY boundary_id ORDER BY scored_at DESC NULLS LAST, prob DESC, label DESC) rn FROM boundaries WHERE boundary_id IS NOT NULL AND prob IS NOT NULL) WHERE rn = 1)"


def _prf(by: str, src: str = "sc") -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}n, n_positive, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
        SELECT {group}n, n_positive, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN n_positive = 0 THEN 0.0 ELSE tp / n_positive END AS r FROM (
        SELECT {group}count(*) AS n, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 1 AND prob >= 0.6) AS tp, count(*) FILTER (label = 0 AND prob >= 0.6) AS fp FROM {src} {"GROUP BY " + by if by else ""}))"""


CURVE = f"""{SCORED}, g AS (SELECT prob, count(*) AS n, count(*) FILTER (label = 1) AS p FROM sc GROUP BY prob),
    cv AS (SELECT prob AS threshold, sum(p) OVER w / sum(n) OVER w AS precision, CASE WHEN (SELECT sum(p) FROM g) = 0 THEN 1.0 ELSE sum(p) OVER w / (SELECT sum(p) FROM g) END AS recall FROM g WINDOW w AS (ORDER BY prob DESC))"""
_FOLD = lambda x: f"translate(regexp_replace({x}, '[⦃⦄]', '', 'g'), '{FOLD_DIAG[0]}', '{FOLD_DIAG[1]}')"
# The five references that XML knows; the tables hold no other.
_NFC = lambda x: f"nfc_normalize(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&'))"
_BARE = lambda x: f"regexp_replace({_FOLD(f'coalesce({x}, chr(32))')}, '[\\s\\p{{Z}}]+', '', 'g')"
_TOKEN = lambda x: f"regexp_extract({x}, '([^\\s\\p{{Z}}]+)[\\s\\p{{Z}}]*$', 1)"
_HEAD = lambda x: f"regexp_extract({x}, '^[\\s\\p{{Z}}]*([^\\s\\p{{Z}}]+)', 1)"
_PUNCT = "'.,;:!?()[]\"'''"
LEXICON = CUR + f", lx AS (SELECT word, count(*) AS n FROM (SELECT lower(trim(unnest(regexp_split_to_array(target_corr, '[\\s\\p{{Z}}]+')), {_PUNCT})) AS word FROM cur) WHERE length(word) > 2 GROUP BY word HAVING count(*) >= 3)"
EXPORT = (
    CUR
    + f""", fx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY corrected_at DESC NULLS LAST) rn FROM corrections WHERE id IS NOT NULL) WHERE rn = 1),
    j AS (SELECT fx.id, cur.id IS NULL AS missing, {_NFC("cur.source_sic")} AS "as", {_NFC("cur.target_sic")} AS "at", {_NFC("cur.target_corr")} AS ac, {_NFC("coalesce(new_source_corr, cur.source_sic)")} AS bs, {_NFC("new_target_sic")} AS bt, {_NFC("new_target_corr")} AS bc FROM fx LEFT JOIN cur USING (id)),
    f AS (SELECT *, {_FOLD('"at"')} IS DISTINCT FROM {_FOLD("bt")} AS dt, {_FOLD("ac")} IS DISTINCT FROM {_FOLD("bc")} AS dc, {_FOLD('"as"')} IS DISTINCT FROM {_FOLD("bs")} AS ds FROM j),
    r AS (SELECT *, CASE WHEN missing THEN 'missing_in_A' WHEN dt OR dc OR ds THEN 'differences_found' ELSE 'match' END AS status FROM f)"""
)
_WINDOW = """, e AS (SELECT doc_id, head_pos, arg_max(pos, pos_in_chain) AS last_pos FROM c GROUP BY ALL),
    m AS (SELECT e.doc_id, e.head_pos, s.*EXCLUDE (doc_id), lead(s.id) OVER (PARTITION BY e.doc_id, e.head_pos ORDER BY s.pos) AS nid FROM e JOIN s ON s.doc_id = e.doc_id AND s.pos BETWEEN e.head_pos - 2 AND e.last_pos + 2),
    sep AS (SELECT *, CASE WHEN nid IS NULL THEN '' WHEN nonbreaking_next_line = nid THEN '¬' ELSE '↵' END AS sp FROM m),
    t AS (SELECT doc_id, head_pos, string_agg(coalesce(source_sic, '') || sp, '' ORDER BY pos) AS source, string_agg(coalesce(target_corr, '') || sp, '' ORDER BY pos) AS target, bool_or(contains_abbr = 'true') AS has_abbr FROM sep GROUP BY ALL),
    cw AS (SELECT e.doc_id, e.head_pos, coalesce(source, '') AS source, coalesce(target, '') AS target, coalesce(has_abbr, false) AS has_abbr FROM e LEFT JOIN t ON t.doc_id = e.doc_id AND t.head_pos = e.head_pos)"""
_U = lambda seed, x: f"(CAST('0x' || substr(md5('{seed}|' || {x}), 1, 8) AS BIGINT) / 4294967296.0)"

SQL = {
    "lines_sorted": f"WITH {SORTED} SELECT id, doc_id, work, vol, page, marg, seq, pos FROM s",
    "dedup_last_writer": f"WITH {CUR} SELECT id, doc_id, source_sic, target_corr, file_pos FROM cur",
    "linked_pairs": f"WITH {PAIRS} SELECT p.id, p.next_id, crosses AS crosses_page_break, p.doc_id, p.source_sic, k.doc_id AS next_doc_id, next_source_sic FROM p JOIN k ON k.id = p.next_id",
    "boundary_examples": f"WITH {BOUNDARIES} SELECT boundary_id, doc_id, array_to_string(list_transform(lang, lambda x: coalesce(x, '?')), ',') AS lang, line_end, line_start, label, crosses_page_break FROM b",
    "boundary_counts": f"WITH {BOUNDARIES} SELECT label, crosses_page_break, count(*) AS n FROM b GROUP BY ALL",
    "doc_split": f"WITH {_split('lines')} SELECT doc_id, split FROM d",
    "split_examples": f"WITH {BOUNDARIES}, {_split('b')} SELECT split, label, count(*) AS n FROM b JOIN d USING (doc_id) GROUP BY ALL",
    "class_weight": f"WITH {BOUNDARIES}, {_split('b')} SELECT split, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, CASE WHEN count(*) FILTER (label = 1) = 0 THEN 1.0 ELSE least(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 8.0) END AS weight FROM b JOIN d USING (doc_id) GROUP BY split",
    "chains": f"WITH {CHAINS} SELECT id, head_pos, pos_in_chain FROM c",
    "chain_counts": f"WITH {CHAINS} SELECT count(*) AS chains, max(n) AS longest FROM size",
    "chain_profile": f"WITH {PROFILES} SELECT count(*) AS chains, CAST(sum(n_bytes) AS DOUBLE) / count(*) AS mean_bytes, max(n_bytes) AS max_bytes, list_sort(list(n_bytes))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, list_sort(list(n_bytes))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99 FROM pr",
    "chain_histogram": f"WITH {PROFILES} SELECT n_lines, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM pr GROUP BY n_lines",
    "heads": f"WITH {CUR} SELECT id FROM cur WHERE id NOT IN (SELECT nonbreaking_next_line FROM cur WHERE nonbreaking_next_line <> '')",
    "context_windows": f"WITH {CHAINS} {_WINDOW} SELECT * FROM cw",
    "budget_windows": f"""WITH {CHAINS}, e AS (SELECT c.doc_id, head_pos, arg_max(c.pos, pos_in_chain) AS last_pos, count(*) AS n_chain, sum(strlen(coalesce(s.source_sic, ''))) AS own FROM c JOIN s ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY ALL),
        y AS (SELECT doc_id, pos, strlen(coalesce(source_sic, '')) AS bytes FROM s),
        q AS (SELECT e.*, b1.bytes b1, b2.bytes b2, a1.bytes a1, a2.bytes a2 FROM e LEFT JOIN y b1 ON b1.doc_id = e.doc_id AND b1.pos = head_pos - 1 LEFT JOIN y b2 ON b2.doc_id = e.doc_id AND b2.pos = head_pos - 2
            LEFT JOIN y a1 ON a1.doc_id = e.doc_id AND a1.pos = last_pos + 1 LEFT JOIN y a2 ON a2.doc_id = e.doc_id AND a2.pos = last_pos + 2),
        v AS (SELECT q.*, v.nb AS wb, v.na AS wa, v.ord, (b1 IS NOT NULL AND nb >= 1)::INT + (b2 IS NOT NULL AND nb >= 2)::INT AS n_before, (a1 IS NOT NULL AND na >= 1)::INT + (a2 IS NOT NULL AND na >= 2)::INT AS n_after
            FROM q, (VALUES (2, 2, 1), (2, 1, 2), (2, 0, 3), (1, 0, 4), (0, 0, 5)) v(nb, na, ord)),
        z AS (SELECT *, CAST(own + CASE WHEN wb >= 1 THEN coalesce(b1, 0) ELSE 0 END + CASE WHEN wb >= 2 THEN coalesce(b2, 0) ELSE 0 END + CASE WHEN wa >= 1 THEN coalesce(a1, 0) ELSE 0 END + CASE WHEN wa >= 2 THEN coalesce(a2, 0) ELSE 0 END + n_chain + n_before + n_after - 1 AS BIGINT) AS n_bytes FROM v)
        SELECT doc_id, head_pos, n_before, n_after, CAST(n_chain AS INT) AS n_chain, n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, head_pos ORDER BY (n_bytes <= 480 OR ord = 5) DESC, ord) rk FROM z) WHERE rk = 1""",
    "seq2seq_examples": f"""WITH {CHAINS} {_WINDOW},
        x AS (SELECT cw.doc_id, cw.head_pos, 0 AS copy, CASE WHEN cw.has_abbr AND {_U(42, "cw.doc_id || '|' || cw.head_pos")} < 0.5 THEN regexp_replace(source, '[⦃⦄]', '', 'g') ELSE source END AS source, target, has_abbr,
            CASE WHEN s.lang IS NULL OR len(s.lang) = 0 THEN 'la' ELSE array_to_string(list_transform(s.lang, lambda x: coalesce(x, '?')), ',') END AS lang FROM cw JOIN s ON s.doc_id = cw.doc_id AND s.pos = cw.head_pos),
        pool AS (SELECT *, row_number() OVER (ORDER BY doc_id, head_pos) - 1 AS i, count(*) OVER () AS n FROM x WHERE has_abbr),
        draw AS (SELECT range + 1 AS copy, CAST(floor({_U(43, "range")} * n) AS BIGINT) AS i FROM range((SELECT count(*) FROM pool)), (SELECT max(n) AS n FROM pool))
        SELECT * FROM x UNION ALL SELECT doc_id, head_pos, draw.copy, source, target, has_abbr, lang FROM pool JOIN draw USING (i)""",
    "lexicon": f"WITH {LEXICON} SELECT word, n FROM lx",
    "lexicon_hits": f"WITH {LEXICON}, y AS (SELECT DISTINCT boundary_id, line_end, line_start FROM boundaries WHERE boundary_id IS NOT NULL), v AS (SELECT boundary_id, lower(trim({_TOKEN('line_end')} || {_HEAD('line_start')}, {_PUNCT})) AS candidate FROM y) SELECT boundary_id, candidate, lx.word IS NOT NULL AS known FROM v LEFT JOIN lx ON lx.word = candidate",
    "canonical_equal": f"WITH {CUR} SELECT id, {_FOLD('source_sic')} IS NOT DISTINCT FROM {_FOLD('target_sic')} AS equal, {_BARE('source_sic')} = {_BARE('target_sic')} AS blank_only FROM cur",
    "export_diff": f"""WITH {EXPORT} SELECT id, status, NULL AS field, NULL AS a, NULL AS b FROM r WHERE status <> 'differences_found' UNION ALL SELECT id, status, 'target', "at", bt FROM r WHERE status = 'differences_found' AND dt
        UNION ALL SELECT id, status, 'target_corr', ac, bc FROM r WHERE status = 'differences_found' AND dc UNION ALL SELECT id, status, 'source', "as", bs FROM r WHERE status = 'differences_found'""",
    "export_missing": f"WITH {EXPORT} SELECT id FROM r WHERE missing",
    "diff_triage": f"""WITH {EXPORT} SELECT CASE WHEN (NOT dt OR {_BARE('"at"')} = {_BARE("bt")}) AND (NOT dc OR {_BARE("ac")} = {_BARE("bc")}) AND {_BARE('"as"')} = {_BARE("bs")} THEN 'blank_only' ELSE 'real' END AS kind, count(*) AS n FROM r WHERE status = 'differences_found' GROUP BY 1""",
    "lookback_links": f"""WITH a AS (SELECT id, file_pos FROM lines WHERE source_sic <> '' AND target_sic <> '' AND translate(left(source_sic, 1), '{FOLD_DIAG[0]}', '{FOLD_DIAG[1]}') <> translate(left(target_sic, 1), '{FOLD_DIAG[0]}', '{FOLD_DIAG[1]}')),
        j AS (SELECT a.id, p.id AS preceding_id, {_TOKEN("coalesce(p.source_sic, '')")} AS last_src_token, {_TOKEN("coalesce(p.target_sic, '')")} AS last_trg_token, row_number() OVER (PARTITION BY a.id, a.file_pos ORDER BY p.file_pos DESC) rn
            FROM a JOIN lines p ON p.nonbreaking_next_line = a.id WHERE a.file_pos - p.file_pos BETWEEN 1 AND 25)
        SELECT id, preceding_id, last_src_token, last_trg_token FROM j WHERE rn = 1""",
    "apply_corrections": f"""WITH {CUR}, fx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY corrected_at DESC NULLS LAST) rn FROM corrections WHERE id IS NOT NULL) WHERE rn = 1)
        SELECT cur.id, CASE WHEN fx.id IS NULL THEN source_corr ELSE new_source_corr END AS source_corr, CASE WHEN fx.id IS NULL THEN target_sic ELSE new_target_sic END AS target_sic, CASE WHEN fx.id IS NULL THEN target_corr ELSE new_target_corr END AS target_corr FROM cur LEFT JOIN fx ON fx.id = cur.id""",
    "spans": f"WITH {CUR}, x AS (SELECT id, regexp_extract_all(source_sic, '⦃([^⦄]*)⦄', 1) AS v FROM cur WHERE contains(source_sic, '⦃')) SELECT id, unnest(generate_series(0, len(v) - 1))::INT AS n, unnest(v) AS abbr FROM x WHERE len(v) > 0",
    "prf_overall": f"WITH {SCORED} {_prf('')}",
    "prf_by_page": f"WITH {SCORED} {_prf('crosses_page_break')}",
    "prf_by_doc": f"WITH {SCORED} {_prf('doc_id')}",
    "prf_by_lang": f"WITH {SCORED}, sl AS (SELECT * EXCLUDE (lang), unnest(lang) AS lang FROM sc) {_prf('lang', 'sl')}",
    "pr_curve": f"WITH {CURVE} SELECT threshold, precision, recall FROM cv UNION ALL SELECT NULL, 1.0, 0.0",
    "threshold": f"WITH {CURVE} SELECT coalesce(min(threshold) FILTER (precision >= 0.9), 0.9) AS threshold FROM cv",
    "error_samples": f"""WITH {SCORED}, e AS (SELECT boundary_id, prob, CASE WHEN prob >= 0.6 AND label = 0 THEN 'false_positive' WHEN prob < 0.6 AND label = 1 THEN 'false_negative' END AS kind FROM sc),
        f AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY boundary_id) AS INT) AS rank, boundary_id, prob FROM e WHERE kind IS NOT NULL) SELECT * FROM f WHERE rank <= 20""",
    "restore_lines": f"WITH {CUR} SELECT id, coalesce(source_sic, '') AS text FROM cur",
    "facs_urls": f"WITH {CUR} SELECT id, CASE WHEN regexp_matches(regexp_replace(facs_id, '^(facs:|#)', ''), '^W[0-9]{{7}}-[0-9]{{4}}$') THEN 'https://facs.example.invalid/iiif/image/' || regexp_replace(facs_id, '^(facs:|#)', '') WHEN regexp_matches(regexp_replace(facs_id, '^(facs:|#)', ''), '^W[0-9]{{7}}-[A-Z0-9]-[0-9]{{4}}$') THEN 'https://facs.example.invalid/iiif/image/' || regexp_replace(regexp_replace(facs_id, '^(facs:|#)', ''), '^(W[0-9]{{7}})-([A-Z0-9])-([0-9]{{4}})$', '\\1_\\2-\\3') ELSE '' END AS url FROM cur",
    "xml_lines": f"WITH {CUR}, x AS (SELECT id, coalesce(doc_id, '') AS doc_id, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(source_sic, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' '), '⦃ *', '⦃', 'g'), ' *⦄', '⦄', 'g') AS t FROM cur) SELECT id, doc_id, t AS source_sic, t AS target_corr, 'p' AS ancestor_type, 'false' AS is_in_note FROM x",
    "lang_counts": f"WITH {CUR} SELECT lang, count(*) AS n FROM (SELECT unnest(list_distinct(lang)) AS lang FROM cur) WHERE lang <> '' GROUP BY lang",
    "normalized": f"WITH {CUR} SELECT id, nfc_normalize(source_sic) AS source_sic, nfc_normalize(source_corr) AS source_corr, nfc_normalize(target_sic) AS target_sic, nfc_normalize(target_corr) AS target_corr FROM cur",
    "first_lines": "SELECT file_pos, id, source_sic FROM lines ORDER BY file_pos LIMIT 1000",
    "zipped_views": """WITH i AS (SELECT source_sic AS input, row_number() OVER (ORDER BY file_pos) - 1 AS pos FROM lines WHERE source_sic IS NOT NULL),
        o AS (SELECT target_sic AS output, row_number() OVER (ORDER BY file_pos) - 1 AS pos FROM lines WHERE target_sic IS NOT NULL),
        t AS (SELECT target_corr AS target, row_number() OVER (ORDER BY file_pos) - 1 AS pos FROM lines WHERE target_corr IS NOT NULL)
        SELECT pos, input, output, target FROM i JOIN o USING (pos) JOIN t USING (pos)""",
    "eval_examples": f"""WITH {CHAINS} {_WINDOW}, {_split('lines')},
        x AS (SELECT d.split, cw.doc_id, cw.head_pos, regexp_replace(source, '[⦃⦄]', '', 'g') AS source, target FROM cw JOIN d ON d.doc_id = cw.doc_id)
        SELECT v.split, x.* EXCLUDE (split) FROM x JOIN (VALUES ('val'), ('test')) v(split) ON x.split = CASE WHEN EXISTS (SELECT 1 FROM x y WHERE y.split = v.split) THEN v.split ELSE 'train' END""",
    "chain_report": f"""WITH {PROFILES}, p AS (SELECT count(*) AS c, sum(n_bytes) / count(*) AS m, max(n_bytes) AS x, list_sort(list(n_bytes))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS a, list_sort(list(n_bytes))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS b FROM pr)
        SELECT CAST(k - 1 AS INT) AS n, line FROM (SELECT unnest(v) AS line, generate_subscripts(v, 1) AS k FROM (SELECT ['Chains of linked lines', 'chains: ' || c, 'mean_bytes: ' || printf('%.2f', m), 'max_bytes: ' || x, 'p95: ' || a, 'p99: ' || b] AS v FROM p))
        UNION ALL SELECT CAST(n_lines + 100 AS INT), printf('%d lines: %d chains (%.2f %%)', n_lines, count(*), 100 * count(*) / sum(count(*)) OVER ()) FROM pr GROUP BY n_lines""",
    "boundary_figures": f"""WITH {CURVE}, o AS ({_prf('')}), e AS (SELECT count(*) FILTER (prob >= 0.6 AND label = 0) AS fp, count(*) FILTER (prob < 0.6 AND label = 1) AS fn FROM sc)
        SELECT n, precision, recall, (SELECT coalesce(min(threshold) FILTER (precision >= 0.9), 0.9) FROM cv) AS threshold, (SELECT count(DISTINCT doc_id) + count(DISTINCT doc_id IS NULL) FILTER (doc_id IS NULL) FROM sc)::INT AS docs, (SELECT count(*) + 1 FROM cv)::INT AS points, (SELECT least(fp, 20) + least(fn, 20) FROM e)::INT AS errors FROM o""",
    "abbreviation_letters": f"""WITH {CUR}, m AS (SELECT id, source_sic, regexp_matches(source_sic, '[\\p{{M}}\\p{{Co}}]') OR regexp_matches(regexp_replace(source_sic, '[a-zA-Z]', '', 'g'), '\\p{{L}}') AS h, {_TOKEN("source_sic")} AS l, {_HEAD("source_sic")} AS f FROM cur)
        SELECT id, h AS has_letters, CASE WHEN l = '' THEN source_sic ELSE l END AS last_token, CASE WHEN f = '' THEN source_sic ELSE f END AS first_token FROM m""",
    "leaping_chains": f"WITH {CHAINS}, e AS (SELECT doc_id, head_pos, arg_max(pos, pos_in_chain) - head_pos AS w FROM c GROUP BY doc_id, head_pos) SELECT count(*) FILTER (w > 10000) AS leaping, max(w) FILTER (w <= 10000) AS widest FROM e",
    "character_table": "SELECT '#' || id AS ref, '' AS text, coalesce(precomposed, composed, standardized, '@') AS glyph FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in CHARACTERS) + ") v(id, precomposed, composed, standardized)",
    "byte_tokens": f"""WITH {CUR}, x AS (SELECT id, source_sic AS t, hex(encode(source_sic)) AS h FROM cur WHERE source_sic IS NOT NULL),
        y AS (SELECT id, t, h[:2 * least(strlen(t), 255)] AS h FROM x),
        z AS (SELECT id, t, h, coalesce(list_sum(list_transform(range(1, len(h), 2), lambda k: (strpos('0123456789ABCDEF', h[k]) - 1) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 1 + 3)), 0) + 1 AS s,
            list_filter(range(0, length(t) + 1), lambda k: strlen(left(t, k)) <= 255) AS fits FROM y)
        SELECT id, CAST(len(h) // 2 + 1 AS INT) AS n_tokens, CAST(s AS BIGINT) AS id_sum, left(t, fits[-1]) AS text FROM z""",
}
