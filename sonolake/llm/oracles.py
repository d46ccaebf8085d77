"""SQL for the corpus queries that SQL can express, written from their definitions."""

#: Words as in common.words_of; DuckDB's lower() would change more than A-Z.
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format(t='coalesce(text, chr(0))')}, '[^\x20\x09-\x0D\x00]+')"

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS x FROM p),
d AS (SELECT page_id, payload_bytes, x, list_reduce(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[instr('0123456789abcdef', substr(x, i, 1))]), lambda a, b: a || b) AS bits FROM h),
e AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * g + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * g + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * g + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * g + 4, 1) AS INT) + CAST(substr(bits, 5 * g + 5, 1) AS INT) AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def _op2() -> str:
    """Written out with the fixed masks, so that it does not follow the operator's constants."""
    FEWEST, MASKS, MIN_MATCH, REACH, SPAN = 5, ["110110101", "101011011", "111011101"], 13, 8, 9

    def key(k: int, mask: str) -> str:
        return f"'{k}'" + "".join(f" || ' ' || w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")

    def seeds(rows: str, item: bool) -> str:
        masks = [(k, m, "true") for k, m in enumerate(MASKS)] + [(len(MASKS) + n - FEWEST, "1" * n, f"len(w) = {n}" if item else "true") for n in range(FEWEST, SPAN)]
        return " UNION ALL ".join(f"SELECT *, {key(k, m)} AS key FROM (SELECT *, unnest(range(len(w) - {len(m) - 1})) AS p FROM {rows} WHERE len(w) >= {len(m)} AND {when})" for k, m, when in masks)

    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH t AS (SELECT item_id, {words} AS w FROM benchmark), d AS (SELECT doc_id, {words} AS w FROM documents),
s AS ({seeds('t', True)}), h AS ({seeds('d', False)}),
m AS (SELECT DISTINCT h.doc_id, s.item_id, h.p AS p, s.p AS q, h.w AS a, s.w AS b FROM h JOIN s USING (key)),
o AS (SELECT doc_id, item_id, len(b) AS size, list_filter(range(-{REACH}, {SPAN + REACH}), lambda i: p + i >= 0 AND p + i < len(a) AND q + i >= 0 AND q + i < len(b)) AS offs, p, q, a, b FROM m),
c AS (SELECT doc_id, item_id, size, len(offs) AS compared, len(list_filter(offs, lambda i: a[p + i + 1] = b[q + i + 1])) AS matched FROM o)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, round(max(matched / CAST(compared AS DOUBLE)), 6) AS identity FROM c
WHERE matched >= least({MIN_MATCH}, size) AND 4 * matched >= 3 * compared GROUP BY doc_id, item_id
"""


OP7 = r"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, chr(10))),
hashed AS (SELECT doc_id, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS h FROM lines),
win AS (SELECT doc_id, pos, xor((2 * h[pos]) & 1152921504606846975, h[pos + 1]) AS key FROM (SELECT doc_id, h, unnest(range(1, len(h))) AS pos FROM hashed)),
rep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM win) WHERE n > 1),
near AS (SELECT *, coalesce(lag(pos) OVER w = pos - 1, false) AS linked, lag(key) OVER w AS before, lag(n) OVER w AS n_before, coalesce(lead(pos) OVER w = pos + 1, false) AS followed, lead(key) OVER w AS after FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cut AS (SELECT doc_id, pos, -2 AS way, linked AS joined FROM near UNION ALL SELECT doc_id, pos, -1, linked AND n = n_before FROM near
  UNION ALL SELECT doc_id, pos, s, linked FROM near, (SELECT unnest(range(10)) AS s) WHERE NOT (linked AND (before >> CAST(3 * s AS INTEGER)) & 7 < 3) AND NOT (followed AND (after >> CAST(3 * s + 30 AS INTEGER)) & 7 < 3)),
runs AS (SELECT doc_id, way, pos, sum(CASE WHEN joined AND prev = pos - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, way ORDER BY pos) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, way ORDER BY pos) AS prev FROM cut)),
r AS (SELECT DISTINCT doc_id, a, z FROM (SELECT doc_id, min(pos) - 1 AS a, max(pos) + 1 AS z FROM runs GROUP BY doc_id, way, run)),
body AS (SELECT doc_id, a, z, array_to_string(list_slice(l, a + 1, z), chr(10)) AS body FROM r JOIN lines USING (doc_id)),
dup AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS n FROM body WHERE regexp_matches(body, '[^\x20\x09-\x0D]')) WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(a, z)))) AS g, count(*) AS n FROM dup GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(g, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') END AS text,
CAST(coalesce(len(g), 0) AS INTEGER) AS removed_lines, CAST(coalesce(n, 0) AS INTEGER) AS removed_chunks FROM documents d LEFT JOIN gone USING (doc_id)
"""


OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id > b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT b, r FROM reach JOIN both_ways ON v = a),
c AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES = {"op1_warc": OP1, "op2_decontaminate": _op2(), "op7_line_chunks": OP7, "op9_chosen_path": OP9}
