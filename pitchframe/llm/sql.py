"""Reference SQL of the operators that SQL can express, for DuckDB."""

# Squared distances are met as sums over (vector, part, place, entry); 64 * distance + entry keeps the first of equal entries.
_ASSIGN = """
near{k} AS (
    SELECT vec_id, part, min(far * 64 + entry) AS best
    FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS far
          FROM cells c JOIN book{k} b ON c.part = b.part AND c.place = b.place GROUP BY ALL)
    GROUP BY ALL),"""
_MOVE = """
sum{k} AS (
    SELECT n.part, CAST(n.best % 64 AS BIGINT) AS entry, c.place, CAST(sum(c.x) AS BIGINT) AS total, count(*) AS n
    FROM near{k} n JOIN cells c ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY ALL),
book{next} AS (
    SELECT b.part, b.entry, b.place, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, b.x) AS x
    FROM book{k} b LEFT JOIN sum{k} s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place),"""

VECTOR_CODES = (
    """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT vec_id, len(v) // 16 AS width, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept),
cells AS (SELECT vec_id, i // width AS part, i % width AS place, x FROM places),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
book0 AS (SELECT c.part, f.entry, c.place, c.x FROM cells c JOIN first f ON c.vec_id = f.vec_id),"""
    + _ASSIGN.format(k=0)
    + _MOVE.format(k=0, next=1)
    + _ASSIGN.format(k=1)
    + _MOVE.format(k=1, next=2)
    + _ASSIGN.format(k=2)
    + """
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book2),
codes AS (
    SELECT vec_id, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error
    FROM near2 GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM codes c JOIN kept k ON c.vec_id = k.vec_id CROSS JOIN digest d
"""
)

_PART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END + CASE WHEN {1} > 0 THEN {1} * log2(2 * {1} / ({0} + {1})) ELSE 0 END"

QUALITY_RULES = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
lengths AS (
    SELECT r, lang, length(text) AS n0,
        length(regexp_replace(text, '\\p{{Ll}}', '', 'g')) AS n1,
        length(regexp_replace(text, '\\p{{Ll}}|[\\x20\\x09-\\x0D]', '', 'g')) AS n2,
        length(regexp_replace(text, '\\p{{Ll}}|[\\x20\\x09-\\x0D]|\\p{{Lu}}', '', 'g')) AS n3,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]|\\p{{L}}|\\p{{M}}', '', 'g')) AS n4,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]|\\p{{L}}|\\p{{M}}|\\p{{Nd}}', '', 'g')) AS n5,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]|\\p{{L}}|\\p{{M}}|\\p{{Nd}}|[.,;:!?''"()-]', '', 'g')) AS n6,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]|\\p{{L}}|\\p{{M}}|\\p{{Nd}}|[.,;:!?''"()-]|[#*$%&|<>]', '', 'g')) AS n7
    FROM d),
classes AS (
    SELECT r, lang, n0, unnest([n0 - n1, n1 - n2, n2 - n3, n3 - n4, n4 - n5, n5 - n6, n6 - n7, n7]) AS n, unnest(range(8)) AS class
    FROM lengths),
of_class AS (SELECT lang, class, sum(n) / sum(n0) AS share FROM classes GROUP BY ALL),
class_far AS (
    SELECT c.r, sum({_PART.format("(c.n / c.n0)", "o.share")}) AS twice
    FROM classes c JOIN of_class o ON c.class = o.class AND c.lang IS NOT DISTINCT FROM o.lang WHERE c.n0 > 0 GROUP BY c.r),
tokens AS (SELECT r, lang, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
totals AS (SELECT lang, count(*) AS total FROM tokens GROUP BY lang),
common AS (
    SELECT t.lang, t.word, count(*) / any_value(s.total) AS share
    FROM tokens t JOIN totals s ON t.lang IS NOT DISTINCT FROM s.lang
    GROUP BY t.lang, t.word HAVING count(*) * 400 >= any_value(s.total)),
bins AS (SELECT lang, count(*) + 1 AS bins, 1 - sum(share) AS rest FROM common GROUP BY lang),
inside AS (
    SELECT t.r, c.share, count(*) AS n
    FROM tokens t JOIN common c ON t.word = c.word AND t.lang IS NOT DISTINCT FROM c.lang GROUP BY t.r, t.word, c.share),
seen AS (
    SELECT i.r, sum(n) AS n, sum({_PART.format("(i.n / len(d.words))", "i.share")} - i.share) AS part, sum(i.share) AS share
    FROM inside i JOIN d ON i.r = d.r GROUP BY i.r),
others AS (
    SELECT d.r, b.bins, s.total, b.rest, 1 - coalesce(n, 0) / len(d.words) AS p, coalesce(part, 0) AS part, coalesce(share, 0) AS share
    FROM d JOIN bins b ON d.lang IS NOT DISTINCT FROM b.lang JOIN totals s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN seen e ON d.r = e.r
    WHERE len(d.words) > 0),
word_far AS (
    SELECT r, bins, total, 1 + part + CASE WHEN p > 1e-12 THEN {_PART.format("p", "rest")} - rest ELSE 0 END AS twice FROM others),
windows AS (
    SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS five,
        lead(word, 4) OVER w IS NOT NULL AS whole
    FROM tokens WINDOW w AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM windows WHERE whole QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
repeated AS (
    SELECT r, CAST(sum(least(5, coalesce(next - i, 5))) AS BIGINT) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
lines AS (
    SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
    SELECT d.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
    FROM d LEFT JOIN lines l ON d.r = l.r LEFT JOIN repeated p ON d.r = p.r),
judged AS (
    SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words >= 50 AND w.total >= 2000 THEN sqrt(greatest(0, c.twice) / 2) END AS class_distance,
        CASE WHEN n_words >= 50 AND w.total >= 2000 THEN sqrt(greatest(0, w.twice) / 2) END AS word_distance,
        w.bins
    FROM base b LEFT JOIN class_far c ON b.r = c.r LEFT JOIN word_far w ON b.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_distance <= 0.24 + 0.2 * sqrt(8 / n_words) AND word_distance <= 0.24 + 0.2 * sqrt(bins / n_words), true) AS kept,
    round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance
FROM judged
"""

# The checksum of a distinct word: a reduction over its bytes with the usual table of 256 remainders.
IMPORTANCE_RESAMPLING = """
WITH remainders AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
here AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
there AS (SELECT word, count(*) AS n FROM b GROUP BY ALL),
spelled AS (SELECT word, hex(word) AS h FROM (SELECT word FROM here UNION SELECT word FROM there)),
bytes AS (
    SELECT word, list_transform(range(len(h) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', substr(h, CAST(2 * k + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(h, CAST(2 * k + 2 AS BIGINT), 1)) - 1) AS bytes
    FROM spelled),
placed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket
    FROM bytes CROSS JOIN remainders),
source AS (SELECT bucket, sum(n) AS s FROM here JOIN placed USING (word) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM there JOIN placed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS big_s, (SELECT coalesce(sum(t), 0) FROM target) AS big_t),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM source LEFT JOIN target USING (bucket) CROSS JOIN sums),
weights AS (
    SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM here JOIN placed USING (word) JOIN gains USING (bucket) GROUP BY r),
digests AS (SELECT r, sha256(concat('2024:', CAST(doc_id AS VARCHAR))) AS h FROM d),
uniform AS (SELECT r, list_reduce(list_transform(range(8), lambda k: strpos('0123456789abcdef', substr(h, CAST(k + 1 AS BIGINT), 1)) - 1), lambda a, x: 16 * a + x) AS h FROM digests),
scored AS (
    SELECT d.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
        CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS luck
    FROM d JOIN uniform USING (r) LEFT JOIN weights USING (r)),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + luck DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n
    FROM scored)
SELECT doc_id, n_features, weight, weight + luck AS score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ordered
"""
