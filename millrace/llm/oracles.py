"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from millrace.llm import jaccard, linededup, phrases, sharding, substrings, veccodes

#: White space between words: ASCII, as everywhere here.
GAP = r"[ \t\n\x0b\x0c\r]"

DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


def repeats(length: int = substrings.LENGTH, words: int = substrings.WORDS) -> str:
    """Every window of bytes, and of words, by its digest."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
     w AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, {2 * length})) AS m FROM (SELECT doc_id, h, unnest(range(n - {length - 1})) AS k FROM d)),
     c AS (SELECT doc_id, k FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
     r AS (SELECT doc_id, k, sum(CASE WHEN k <= before + {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
           FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c)),
     s AS (SELECT doc_id, min(k) AS low, max(k) + {length} AS high FROM r GROUP BY doc_id, run),
     edges AS (SELECT doc_id, low, high FROM s UNION ALL SELECT doc_id, n, n FROM d),
     pieces AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high), 0) AS stay FROM edges),
     kept AS (SELECT doc_id, string_agg(substr(h, 2 * stay + 1, 2 * (low - stay)), '' ORDER BY low, high) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
     p AS (SELECT doc_id, regexp_extract_all(t, '[^ \t\n\x0b\x0c\r]+{GAP}*') AS parts FROM d),
     v AS (SELECT doc_id, parts, list_transform(parts, lambda x: regexp_replace(x, '{GAP}+$', '')) AS words FROM p),
     u AS (SELECT doc_id, k, md5(array_to_string(words[k:k + {words - 1}], ' ')) AS m FROM (SELECT doc_id, words, unnest(range(1, len(words) - {words - 2})) AS k FROM v)),
     uc AS (SELECT doc_id, k FROM u WHERE m IN (SELECT m FROM u GROUP BY m HAVING count(*) > 1)),
     ur AS (SELECT doc_id, k, sum(CASE WHEN k <= before + {words} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
            FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM uc)),
     us AS (SELECT doc_id, min(k) AS low, max(k) + {words - 1} AS high FROM ur GROUP BY doc_id, run),
     passages AS (SELECT doc_id, count(*) AS n_passages, sum(strlen(array_to_string(parts[low:high - 1], '')) + strlen(words[high])) AS passage_bytes FROM us JOIN v USING (doc_id) GROUP BY doc_id),
     spans AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256,
       coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(passage_bytes, 0)::BIGINT AS passage_bytes
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN passages USING (doc_id)"""


def crc_table() -> list[int]:
    """What CRC-32 (reflected, polynomial 0xEDB88320) adds for each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        out.append(byte)
    return out


def shards(n: int) -> str:
    """Running sums over all rows, by the text's hash and doc_id."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS size FROM documents),
     o AS (SELECT doc_id, t, size, md5(t) AS g, sum(size) OVER (ORDER BY md5(t), doc_id) - size AS start, sum(size) OVER () AS total FROM d),
     p AS (SELECT *, least(floor(start * {n} / total), {n - 1})::INT AS shard FROM o),
     x AS (SELECT doc_id, string_split(hex(t), '') AS digits FROM d WHERE t <> ''),
     y AS (SELECT doc_id, list_transform(list_zip(digits[1:-:2], digits[2:-:2]), lambda z: (instr('0123456789ABCDEF', z[1]) - 1) * 16 + instr('0123456789ABCDEF', z[2]) - 1) AS bytes FROM x),
     crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, {crc_table()}[xor(c & 255, v) + 1])), 4294967295) AS text_crc32 FROM y)
SELECT doc_id, size::BIGINT AS size, coalesce(text_crc32, 0)::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM p LEFT JOIN crc USING (doc_id)"""


def join(threshold: float = jaccard.THRESHOLD, words: int = 5) -> str:
    """Pairs of different sets that share a shingle, their links, and what links reach."""
    return rf"""
WITH RECURSIVE
     d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{GAP}+'), lambda x: x <> '') AS w FROM documents),
     e AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {words - 1}], ' ')))) END AS s FROM d),
     f AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(s, chr(10))) || len(s)::VARCHAR AS g FROM e),
     c AS MATERIALIZED (SELECT g, any_value(s) AS s, len(any_value(s)) AS n, count(*) AS copies, min(doc_id) AS least FROM f GROUP BY g),
     u AS MATERIALIZED (SELECT g, n, unnest(s) AS shingle FROM c),
     l AS MATERIALIZED (SELECT a.g AS a, b.g AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.g <> b.g
                        GROUP BY a.g, b.g HAVING count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
     reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
     k AS (SELECT c.g, least(any_value(c.least), coalesce(min(o.least), any_value(c.least))) AS class_id FROM c LEFT JOIN reach ON reach.a = c.g LEFT JOIN c o ON o.g = reach.b GROUP BY c.g),
     m AS (SELECT a AS g, count(*) AS n_different, sum(copies) AS documents FROM l JOIN c ON c.g = l.b GROUP BY a)
SELECT doc_id, class_id, (coalesce(documents, 0) + copies - 1)::BIGINT AS n_links, coalesce(n_different, 0)::BIGINT AS n_different, copies
FROM f JOIN c USING (g) JOIN k USING (g) LEFT JOIN m USING (g)"""


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(long: int = linededup.LONG, many: int = linededup.MANY) -> str:
    """Every line by its key, and the runs of lines that stay or go."""
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
     g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {long} GROUP BY key HAVING count(DISTINCT doc_id) >= {many}),
     m AS (SELECT doc_id, p, line, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN g USING (key)),
     e AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, stays ORDER BY p) AS island FROM m),
     r AS (SELECT doc_id, stays, min(p) AS low, count(*) AS n FROM e GROUP BY doc_id, stays, island),
     runs AS (SELECT doc_id, CASE WHEN min_by(stays, low) THEN '' ELSE '0,' END || string_agg(n::VARCHAR, ',' ORDER BY low) || CASE WHEN max_by(stays, low) THEN '' ELSE ',0' END AS keep_runs FROM r GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256, any_value(keep_runs) AS keep_runs
FROM m JOIN runs USING (doc_id) GROUP BY doc_id"""


def codes(parts: int = veccodes.PARTS, entries: int = veccodes.ENTRIES, rounds: int = veccodes.ROUNDS) -> str:
    """Every round with all distances of all parts to all entries."""
    floor = "((s - ((s % c) + c) % c) // c)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
     d{k} AS MATERIALIZED (SELECT row, p.part, entry, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} ON b{k}.part = p.part),
     a{k} AS MATERIALIZED (SELECT row, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{k} GROUP BY row, part)""")
        if k < rounds:
            steps.append(f"""
     m{k} AS (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS c FROM a{k} JOIN p USING (row, part), range(1, len(x) + 1) AS r(i) GROUP BY part, entry, i),
     u{k} AS (SELECT part, entry, list({floor}::BIGINT ORDER BY i) AS b FROM m{k} GROUP BY part, entry),
     b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{k}.b, b{k}.b) AS b FROM b{k} LEFT JOIN u{k} USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({veccodes.SCALE} * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
     p AS MATERIALIZED (SELECT row, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(part)),
     b0 AS (SELECT part, row AS entry, x AS b FROM p WHERE row < {entries}),{','.join(steps)},
     e AS (SELECT row, sum(d)::BIGINT AS error, string_agg(printf('%02x', entry), '' ORDER BY part) AS code FROM a{rounds} GROUP BY row),
     l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN v USING (row) GROUP BY label),
     h AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN e USING (row) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""


def collocations(longest: int = phrases.LONGEST, least: int = phrases.LEAST, share: int = phrases.SHARE, top: int = phrases.TOP) -> str:
    """Every phrase of every piece, and every part of every candidate."""
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
     p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
     s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     o AS (SELECT lang, w[i : i + k - 1] AS words FROM s, range(1, {longest} + 1) AS r(k) WHERE i + k - 1 <= len(w)),
     f AS MATERIALIZED (SELECT lang, words, count(*) AS n FROM o GROUP BY lang, words HAVING count(*) >= {least}),
     total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
     c AS MATERIALIZED (SELECT lang, words, n AS a FROM f WHERE len(words) > 1),
     inner_words AS (SELECT lang, words[i : i + k - 1] AS words, max(a) AS longer FROM c, range(2, {longest}) AS r(k), range(1, {longest}) AS q(i)
                     WHERE k < len(words) AND i + k - 1 <= len(words) GROUP BY ALL),
     free AS (SELECT c.lang, c.words, a FROM c LEFT JOIN inner_words USING (lang, words) WHERE longer IS NULL OR 100 * longer < {share} * a),
     cut AS (SELECT lang, words, a, k, words[1 : k] AS head, words[k + 1 : len(words)] AS tail FROM free, range(1, {longest}) AS r(k) WHERE k < len(words)),
     x AS (SELECT lang, cut.words, a, k, h.n AS l, t.n AS r, total.n AS n, (1000::HUGEINT * a * total.n) // (h.n::HUGEINT * t.n) AS score
           FROM cut JOIN f h USING (lang) JOIN f t USING (lang) JOIN total USING (lang) WHERE h.words = head AND t.words = tail),
     best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
     ranked AS (SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
