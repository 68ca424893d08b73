"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

_PII_KINDS = (
    (1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    (
        2, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR try_cast(p AS DECIMAL(38, 0)) > 255)) = 0",
    ),
    (
        3, "card", r"[0-9](?:[\x20-]?[0-9])+",
        "len(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(len(digits)), lambda i: "
        "CASE WHEN i % 2 = 0 THEN digits[len(digits) - i]::INT "
        "WHEN digits[len(digits) - i]::INT > 4 THEN digits[len(digits) - i]::INT * 2 - 9 "
        "ELSE digits[len(digits) - i]::INT * 2 END)) % 10 = 0",
    ),
    (4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 8 AND 15"),
    (
        5, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "len(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(plain[5:] || plain[1:4], ''), "
        "lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)), "
        "lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1",
    ),
    (
        6, "ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'",
    ),
)

_PII_WORDS = {
    "email": ("mail|contact|write|reach", 0.7), "ip": ("ip|server|host|address", 0.5),
    "card": ("card|visa|credit|payment", 0.8), "phone": ("tel|phone|call|fax|mobile", 0.6),
    "iban": ("iban|account|bank|konto|compte", 0.7), "ssn": ("ssn|social|security number|insured", 0.45),
}


def _pii_kind(order: int, name: str, pattern: str, valid: str) -> str:
    words, score = _PII_WORDS[name]
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    near = " OR ".join(
        f"regexp_matches({fold.format(part)}, '(?:^|[^a-z])(?:{words})')" for part in ("t[greatest(s - 48, 0) + 1:s]", "t[s + len(m) + 1:s + len(m) + 48]")
    )
    return f"""
    SELECT doc_id, {order} AS k, '{name}' AS kind, s AS start_at, s + len(m) AS end_at,
        least(1.0, {score} + CASE WHEN {near} THEN 0.2 ELSE 0 END)::DOUBLE AS score
    FROM (
        SELECT *, sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) - len(m) AS s,
            regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS plain
        FROM (
            SELECT doc_id, t, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
            FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)
        )
    ) WHERE {valid}"""


PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(_pii_kind(*k) for k in _PII_KINDS)}),
spans AS (SELECT * FROM proposed WHERE k < 5 OR score >= 0.6),
per_doc AS (
    SELECT doc_id,
        count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip,
        count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
        string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY k, start_at) FILTER (k < 5) AS base,
        string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY k, start_at) AS spans,
        max(score) AS top_score
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(top_score, 0.0)::DOUBLE AS top_score
FROM d LEFT JOIN per_doc USING (doc_id)
"""

URLS = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
rules(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
fits AS (
    SELECT page_id, verdict, rule_host || rule_path AS rule,
        row_number() OVER (PARTITION BY page_id ORDER BY len(rule_host) DESC, len(rule_path) DESC) AS n
    FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND n = 1
"""

LINES = """
WITH l AS (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '' AND doc_id IS NOT NULL
),
w AS (
    SELECT doc_id, unnest(range(greatest(len(ls) - 2, 1))) AS pos, ls FROM l
),
k AS (SELECT doc_id, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS key FROM w),
later AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM k) WHERE n > 1
),
covered AS (SELECT DISTINCT doc_id, pos + o AS i FROM later, (VALUES (0), (1), (2)) AS offsets(o)),
kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l)
    ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
    (coalesce(len(l.ls), 0) - coalesce(k.n, 0))::BIGINT AS lines_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (
    SELECT item_id, array_to_string(ws[p + 1:p + 10], ' ') AS w, least(len(ws), 10) AS n
    FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS p FROM i WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
    SELECT doc_id, p, n, array_to_string(ws[p + 1:p + n], ' ') AS w
    FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS p FROM d, sizes WHERE len(ws) >= n)
),
hits AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (w, n)),
hit_words AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

CODES = """
WITH c AS (
    SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64
),
p AS (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
        list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: abs(z[1] - z[2])))::INT AS distance
    FROM (SELECT * FROM c WHERE vec_id % 20 = 0) q, c r
),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, neighbour_id, distance FROM o WHERE rank <= 10
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS smallest FROM pages),
t AS (SELECT *, CASE WHEN strlen(payload) >= 100 AND page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to FROM p)
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, TRUE AS verified
FROM t
"""


def _part_codes(rounds: int = 6) -> str:
    """Rounds of assignment and replacement, a step each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
    SELECT v, p, e, sum((x.c - y.c) * (x.c - y.c)) AS d FROM cells x JOIN b{r} y USING (p, o) GROUP BY ALL
),
a{r} AS MATERIALIZED (SELECT v, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
    SELECT p, e, o, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
        SELECT p, e, o, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
        FROM a{r} JOIN cells USING (v, p) GROUP BY ALL
    ) m USING (p, e, o)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS xs,
        row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS MATERIALIZED (
    SELECT v, i // w AS p, i % w AS o, xs[i + 1] AS c
    FROM (SELECT v, xs, len(xs) // 8 AS w, unnest(range(len(xs))) AS i FROM kept)
),
b0 AS MATERIALIZED (SELECT p, v AS e, o, c FROM cells WHERE v < 16),{",".join(steps)},
coded AS (
    SELECT v, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY v
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, o)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (v)
"""


PART_CODES = _part_codes()

# The checksum of a text, byte by byte with a table that is computed here.
_CRC = """
list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(hex(encode(f))) // 2),
    lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT)),
    lambda r, b: xor(r >> 8, steps[(xor(r, b) & 255)::INT + 1]))
"""

RESAMPLED = f"""
WITH steps AS (
    SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
        lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END) ORDER BY i) AS steps
    FROM range(256) t(i)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
df AS (SELECT r, unnest(ws || list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2])) AS f FROM d),
bf AS (SELECT unnest(ws || list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2])) AS f FROM b),
hashed AS MATERIALIZED (
    SELECT f, (xor({_CRC}, 4294967295::UBIGINT) % 10000)::INT AS bucket
    FROM (SELECT f FROM df UNION SELECT f FROM bf), steps
),
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000))))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket)
),
w AS (
    SELECT r, count(*) AS n, ((sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS weight
    FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
),
scored AS (
    SELECT r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN w USING (r)
),
drawn AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank
    FROM scored WHERE n_words >= 20
    QUALIFY rank <= 25 * count(*) OVER () // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)
"""
