"""DuckDB SQL for the queries that SQL can state whole: the transaction log and the prefix trie.

DuckDB has no CRC-32, so the SQL works it out byte by byte over a table of 256 remainders that it makes itself.
"""

from __future__ import annotations

_TABLE = "crct AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))"


def _crc(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes; `tab` is a column at hand."""
    digits = f"hex({text})"
    byte = f"CAST((instr('0123456789ABCDEF', {digits}[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', {digits}[2 * k + 2]) - 1 AS BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(length({digits}) // 2), lambda k: {byte})), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"


_LOG = f"""WITH {_TABLE}, hashed AS (SELECT doc_id, source, text, tab, {_crc('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crct WHERE doc_id IS NOT NULL),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
rec AS (SELECT h.doc_id, source, CASE WHEN h % 41 < 2 THEN 'commit' WHEN h % 41 < 3 THEN 'abort' WHEN h % 41 < 5 THEN 'savepoint' WHEN h % 41 < 7 THEN 'rollback' ELSE 'change' END AS kind, h // 100 % 3000 AS key, CASE WHEN text IS NULL OR t.doc_id IS NOT NULL THEN NULL ELSE CAST(h // 100 % 3000 AS VARCHAR) || ':' || text END AS body, tab FROM hashed h LEFT JOIN toxic t ON t.doc_id = h.doc_id),
hexed AS (SELECT doc_id, source, kind, key, tab, hex(body) AS digits FROM rec), placed AS (SELECT doc_id, source, kind, key, row_number() OVER (ORDER BY doc_id) AS pos,
  CASE WHEN kind = 'change' AND digits IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], list_transform(range(length(digits) // 2), lambda k: CAST((instr('0123456789ABCDEF', digits[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * k + 2]) - 1 AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) END AS val FROM hexed),
nexts AS (SELECT *, min(CASE WHEN kind <> 'change' THEN pos END) OVER later AS control, min(CASE WHEN kind IN ('commit', 'abort') THEN pos END) OVER later AS finish FROM placed WINDOW later AS (PARTITION BY source ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
decided AS (SELECT n.*, CASE WHEN c.kind = 'savepoint' THEN n.finish ELSE n.control END AS by_at FROM nexts n LEFT JOIN placed c ON c.pos = n.control WHERE n.kind = 'change'),
fate AS (SELECT d.doc_id, d.key, d.val, d.pos, b.kind AS by_kind, b.doc_id AS by_id, b.pos AS by_at FROM decided d LEFT JOIN placed b ON b.pos = d.by_at),
commits AS (SELECT pos, row_number() OVER (ORDER BY pos) AS rank, (row_number() OVER (ORDER BY pos) - 1) // 16 + 1 AS epoch FROM placed WHERE kind = 'commit'),
writes AS (SELECT * FROM (SELECT epoch, key, val, row_number() OVER (PARTITION BY epoch, key ORDER BY rank DESC, f.pos DESC) AS r FROM fate f JOIN commits c ON c.pos = f.by_at WHERE by_kind = 'commit') WHERE r = 1),
steps AS (SELECT epoch, CASE WHEN val IS NULL THEN 0 ELSE 1 END - CASE WHEN lag(val) OVER w IS NULL THEN 0 ELSE 1 END AS dn, coalesce(val, 0) - coalesce(lag(val) OVER w, 0) AS dv FROM writes WINDOW w AS (PARTITION BY key ORDER BY epoch)),
sums AS (SELECT e.epoch, coalesce(sum(dn), 0) AS dn, coalesce(sum(dv), 0) AS dv FROM (SELECT DISTINCT epoch FROM commits) e LEFT JOIN steps s ON s.epoch = e.epoch GROUP BY 1)
SELECT 'state' AS kind, epoch AS id, CAST(sum(dn) OVER (ORDER BY epoch) AS BIGINT) AS n, CAST(sum(dv) OVER (ORDER BY epoch) AS BIGINT) AS value FROM sums
UNION ALL SELECT coalesce(by_kind, 'abort'), doc_id, by_id, CAST(key AS BIGINT) FROM fate WHERE by_kind IS NULL OR by_kind <> 'commit'"""

_TRIE = f"""WITH {_TABLE}, turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(m ORDER BY r) AS ms, list(w ORDER BY r) AS ws FROM turns GROUP BY 1), planned AS (SELECT c.*, CAST({_crc('CAST(conv_id AS VARCHAR)')} % 4 AS INTEGER) AS h FROM convs c, crct),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ms[1:c.h], []), c.ms[c.h + 1:]) AS ms, list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) AS ws FROM planned c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (SELECT conv_id, ms, ws, unnest(range(len(ms) + 1)) AS depth FROM rebuilt), keyed AS (SELECT conv_id, depth, len(ms) AS n, ms[1:depth] AS path, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w FROM paths),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM keyed GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kids k ON k.path = n.path),
ups AS (SELECT path[1:a] AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM own) GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN ups u ON u.path = o.path LEFT JOIN nodes p ON o.depth > 0 AND p.depth = o.depth - 1 AND p.path = o.path[1:o.depth - 1]"""

ORACLES: dict[str, str] = {"op11_translog": _LOG, "op13_prefixtrie": _TRIE}
