"""SQL over the tables for the queries that SQL can express."""

from __future__ import annotations

import math

from turnout.llm import quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality(reach: int = 3, weight: int = 50) -> str:
    rates = ", ".join(f"CASE WHEN {over} > 0 THEN (({value}) * {quality.SCALE}) // ({over}) ELSE 0 END AS {column}"
                      for name, (of, over, event, _) in quality.MEASURES.items()
                      for column, value in ((name, f"greatest({of} - {event}, 0)"), (quality.upper(name), f"{of} + {event}")))
    both = ", ".join(f"'{m}'" for m, v in quality.MEASURES.items() if v[3])
    bits = quality.SKETCH_BITS
    edge = lambda v: f"(({v} >> greatest(length(bin({v})) - {bits}, 0)) << greatest(length(bin({v})) - {bits}, 0))"
    every = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{m}' AS measure, {m} AS v, {quality.upper(m)} AS u FROM measured" for m in quality.MEASURES)

    def fences(name: str, keys: str) -> str:
        group = f"{keys}, measure" if keys else "measure"
        at = ", ".join(f"min(bucket) FILTER (upto * 20 >= total * {part}) AS {q}" for q, part in (("q10", 2), ("q25", 5), ("q50", 10), ("q75", 15), ("q90", 18)))
        return f"""{name}_cum AS (SELECT {group}, bucket, sum(count(*)) OVER (PARTITION BY {group} ORDER BY bucket) AS upto,
            sum(count(*)) OVER (PARTITION BY {group}) AS total FROM bucketed GROUP BY {group}, bucket),
        {name}_q AS (SELECT {group}, max(total)::BIGINT AS n, {at} FROM {name}_cum GROUP BY {group}),
        {name} AS (SELECT *, q75 + {reach} * greatest(q90 - q50, q75 >> {bits - 1}) AS high,
            CASE WHEN measure IN ({both}) THEN greatest(q25 - {reach} * greatest(q50 - q10, q25 >> {bits - 1}), 0) ELSE 0 END AS low FROM {name}_q)"""

    drawn = lambda end: f"(a.n * a.{end} + {weight} * ((b.n * b.{end} + {weight} * c.{end}) // (b.n + {weight}))) // (a.n + {weight}) AS {end}"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM (
        SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5))),
    repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest(generate_series(0, 4)) AS k) WHERE c >= 2 GROUP BY rid),
    counted AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
            length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN repeats USING (rid)),
    lined AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
    measured AS (SELECT *, {rates} FROM lined),
    bucketed AS (SELECT *, {edge("u")} AS bucket FROM ({every}) WHERE NOT base_failed),
    {fences("a", "lang, source")}, {fences("b", "lang")}, {fences("c", "")},
    fences AS (SELECT a.lang, a.source, a.measure, a.n, {drawn("low")}, {drawn("high")}
        FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN c ON a.measure = c.measure),
    judged AS (SELECT e.rid, coalesce(max(f.n), 0)::BIGINT AS group_docs,
            bool_and(coalesce({edge("e.v")} <= f.high AND {edge("e.u")} >= f.low, true)) AS inside
        FROM ({every}) e LEFT JOIN fences f
        ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source AND e.measure = f.measure GROUP BY e.rid)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept, group_docs
    FROM measured JOIN judged USING (rid)"""


def _secrets(rate: float = 0.05) -> str:
    def found(name: str, pattern: str, group: int = 0) -> str:
        p = _quoted(pattern)
        return f"""{name} AS (SELECT rid, start, start + length(whole) AS stop, value FROM (
            SELECT rid, whole, value, sum(length(gap)) OVER w + coalesce(sum(length(whole)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT rid, unnest(regexp_extract_all(text, {p})) AS whole, unnest(regexp_extract_all(text, {p}, {group})) AS value,
                    unnest(string_split_regex(text, {p})[1:len(regexp_extract_all(text, {p}))]) AS gap,
                    unnest(generate_series(1, len(regexp_extract_all(text, {p})))) AS k
                FROM d WHERE regexp_matches(text, {p}))
            WINDOW w AS (PARTITION BY rid ORDER BY k)))"""

    tails = ", ".join(repr(secrets.tail(z)) for z in range(secrets.LOWEST, secrets.HIGHEST + 1))
    size = "CASE " + " ".join(f"WHEN n >= {least} THEN {k}" for k, least in reversed(list(enumerate(secrets.LENGTH_CLASSES)))) + " ELSE 0 END"
    by = lambda value: "CASE a " + " ".join(f"WHEN {k}.0::DOUBLE THEN {value(i, *v)}" for i, (k, v) in enumerate(secrets.LANGUAGE.items())) + " END"
    size = f"{size} + {by(lambda i, c, ch: len(secrets.LENGTH_CLASSES) * i)}"
    c, ch, one_change = (by(v) for v in (lambda i, c, ch: f"{c!r}::DOUBLE", lambda i, c, ch: f"{ch!r}::DOUBLE", lambda i, c, ch: f"{ch * (1.0 - ch)!r}::DOUBLE"))
    listed = lambda where: (
        "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop)" + (f" FILTER ({where})" if where else "") + ", '')")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    {found("assign", secrets.ASSIGN, 1)}, {found("access", secrets.ACCESS)}, {found("hex", secrets.HEX)}, {found("token", secrets.TOKEN)},
    tok AS (SELECT rid, start, stop, value, length(value) AS n, CASE
            WHEN regexp_matches(value, '\A[0-9]+\z') THEN NULL WHEN regexp_matches(value, '\A([0-9a-f]+|[0-9A-F]+)\z') THEN 16.0::DOUBLE
            WHEN regexp_matches(value, '\A([a-z]+|[A-Z]+)\z') THEN 26.0::DOUBLE WHEN regexp_matches(value, '\A[A-Z2-7]+\z') THEN 32.0::DOUBLE
            WHEN regexp_matches(value, '\A([0-9a-z]+|[0-9A-Z]+)\z') THEN 36.0::DOUBLE ELSE 64.0::DOUBLE END AS a FROM token),
    chars AS (SELECT rid, start, n, i, strpos('{secrets.VALUES}', value[i]) AS v FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM tok WHERE a IS NOT NULL)),
    squares AS (SELECT rid, start, sum(k * k)::BIGINT AS squares FROM (SELECT rid, start, v, count(*) AS k FROM chars GROUP BY ALL) GROUP BY ALL),
    neighbours AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY rid, start ORDER BY i), first(v) OVER (PARTITION BY rid, start ORDER BY i)) AS w FROM chars),
    sums AS (SELECT rid, start, sum(v)::BIGINT AS t, sum(v * v)::BIGINT AS s, sum(v * w)::BIGINT AS p FROM neighbours GROUP BY ALL),
    stats AS (SELECT rid, start, stop, a, n::DOUBLE AS x, n, squares::DOUBLE AS squares,
            CASE WHEN a = 26.0::DOUBLE THEN length(regexp_replace(regexp_replace(value, '[{secrets.VOWELS}]+', '0', 'g'), '[A-Za-z]+', 'l', 'g')) ELSE
            length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[a-z]+', 'l', 'g'), '[A-Z]+', 'U', 'g'), '[0-9]+', '0', 'g'), '[+/_-]+', '-', 'g')) END::DOUBLE AS runs,
            CASE WHEN n * s = t * t THEN 1.0::DOUBLE ELSE (n * p - t * t)::DOUBLE / (n * s - t * t)::DOUBLE END AS r
        FROM tok JOIN squares USING (rid, start) JOIN sums USING (rid, start)),
    expected AS (SELECT *, {c} AS c, {ch} AS ch, {one_change} AS one_change FROM stats),
    zs AS (SELECT rid, start, stop, {size} AS size,
            ((((a - 1.0::DOUBLE) + (x - 1.0::DOUBLE) * (a * c - 1.0::DOUBLE) - (a / x * squares - x))
               / sqrt(2.0::DOUBLE * (a - 1.0::DOUBLE) + 4.0::DOUBLE * (x - 1.0::DOUBLE) * abs(a * c - 1.0::DOUBLE)))
              + CASE WHEN a = 26.0::DOUBLE THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (((runs - 1.0::DOUBLE) - (x - 1.0::DOUBLE) * ch) / sqrt((x - 1.0::DOUBLE) * one_change))
              + least({secrets.CORRELATION!r}::DOUBLE - abs(r) * sqrt(x), 0.0::DOUBLE)) / {math.sqrt(secrets.SUM_VARIANCE)!r}::DOUBLE AS z FROM expected),
    binned AS (SELECT rid, start, stop, size, least(greatest(floor(z * {secrets.BINS}), {secrets.LOWEST}), {secrets.HIGHEST})::INT AS z FROM zs),
    counts AS (SELECT size, z, count(*) AS n FROM binned GROUP BY ALL),
    reached AS (SELECT size, z, sum(n) OVER (PARTITION BY size) AS m, sum(n) OVER (PARTITION BY size ORDER BY z DESC) AS found FROM counts),
    cuts AS (SELECT size, min(z) AS z FROM reached WHERE m * ([{tails}])[z - {secrets.LOWEST} + 1]::DOUBLE <= {rate}::DOUBLE * found GROUP BY size),
    spans AS (
        SELECT rid, 'assign' AS kind, 0 AS k, start, stop FROM assign WHERE length(value) >= 6
        UNION ALL SELECT rid, 'access', 1, start, stop FROM access UNION ALL SELECT rid, 'hex', 2, start, stop FROM hex
        UNION ALL SELECT rid, 'random', 3, start, stop FROM binned b JOIN cuts c ON b.size = c.size AND b.z >= c.z)
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256({listed("kind <> 'random'")}) AS base_sha256, {listed("")} AS spans
    FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


#: Base32 has no function in SQL: the SHA-1's 160 bits are cut into 32 groups of five.
WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    last AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex HAVING count(*) > 1),
    bits AS (SELECT DISTINCT hex, array_to_string(list_transform(string_split(hex, ''),
        lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS b FROM p),
    named AS (SELECT hex, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT, 1)), '') AS payload_digest FROM bits)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
        CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, NULL AS problem
    FROM p JOIN named USING (hex) LEFT JOIN last USING (hex)"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    t AS (SELECT vec_id, unnest(generate_series(1, len(w))) AS i, unnest(w)::BIGINT AS x FROM v),
    scores AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM t q JOIN t c ON q.i = c.i
        WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scores) WHERE rank <= 20"""

#: Pairs are counted through the shingles they share; components are closed step by step.
JACCARD = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS gram FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON r.y = b.x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n"""

SUBSTRINGS = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i FROM windows JOIN firsts USING (h) WHERE doc_id > first), (SELECT unnest(generate_series(0, 49)) AS k)),
    words AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d)),
    kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)"""


QUALITY = _quality()
SECRETS = _secrets()

HARD_NEGATIVES = """
    WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    anchors AS (SELECT vec_id, min({'v': v, 'label': label}) AS r FROM valid WHERE vec_id % 100 = 0 GROUP BY vec_id),
    scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.label AS same, list_sum(list_transform(list_zip(a.r.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
        FROM anchors a CROSS JOIN valid c),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    QUALIFY rank <= 10"""

COLLOCATIONS = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    spots AS (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) lengths(k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM spots GROUP BY ALL),
    n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    candidates AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND c >= 10),
    longer AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
    held AS (SELECT lang, phrase, max(a) AS longer FROM longer GROUP BY ALL),
    cuts AS (SELECT lang, phrase, k, a, ws, unnest(generate_series(1, k - 1)) AS cut FROM candidates LEFT JOIN held USING (lang, phrase)
        WHERE longer IS NULL OR 100 * longer < 50 * a),
    scored AS (SELECT c.lang, c.phrase, a, cut, l.c AS l, r.c AS r, ((1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c))::BIGINT AS score
        FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') AND l.k = cut
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') AND r.k = c.k - cut),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM worst JOIN n USING (lang) QUALIFY rank <= 2000"""
