"""SQL for the results of those queries that SQL can state, for another engine on the same tables."""

from __future__ import annotations

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter(block: list[str], allow: list[str], hosts: list[str]) -> str:
    rules = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    values = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in rules)
    spam = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in hosts)
    part = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {n})"
    best = "(SELECT {c} FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(rule) DESC LIMIT 1)"
    return f"""WITH rules(h, p, rule, v) AS (VALUES {values}), seen AS (SELECT page_id, {_LOWER.format(x=part.format(n=1))} AS host, {part.format(n=2)} AS path FROM pages)
        SELECT page_id, host, path, {best.format(c="rule")} AS rule, coalesce({best.format(c="v")}, CASE WHEN {spam} THEN 'block' ELSE 'allow' END) AS verdict FROM seen"""


_WORDS = "regexp_extract_all(" + _LOWER.format(x="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    wins AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
    places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM wins) s WHERE len(w) >= size)),
    hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN wins USING (size, win)),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
    owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN owned USING (doc_id)"""

QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) > 8)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
    reps AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
    a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN reps USING (doc_id)),
    b AS (SELECT *, CAST((n_words < 20) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 30 * n_words) AS BIGINT) + 4 * CAST((10 * n_symbols > word_chars) AS BIGINT)
        + 8 * CAST((n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) AS BIGINT) + 16 * CAST((word_chars > 40 * n_words) AS BIGINT) + 32 * CAST((2 * word_chars < 3 * n_words) AS BIGINT) AS failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed AS failed_rules FROM b"""

_BITS = "array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '')"
_VALUE = " + ".join(f"CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INTEGER) * {16 >> k}" for k in range(5))

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, sha1(x) AS h FROM p),
    b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS first_id FROM d)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_VALUE} AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to, TRUE AS intact FROM b"""
