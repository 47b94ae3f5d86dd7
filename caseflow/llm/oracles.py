"""DuckDB SQL for those queries of this subpackage that SQL can express.

The others rest on a fitted label model, a keyed permutation, a tokenizer, approximate quantiles or byte windows; tests compare
them with plain versions.
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LONG = ", ".join(f"'{s}'" for s in (
    "ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr com.tw gov.au gov.uk ne.jp net.au or.jp org.au org.nz org.uk"
).split())

ORACLES: dict[str, str] = {
    "op4_host_reputation": f"""
        WITH parted AS (
          SELECT page_id, {_LOWER.format("CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') END")} AS host,
            coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages),
        bare AS (SELECT *, regexp_replace(host, '\\.?(:[0-9]*)?$', '') AS h FROM parted),
        marked AS (SELECT p.*, 1 - q AS outcome, regexp_extract(h, '[^.]*\\.?[^.]*$') IN ({_LONG}) AS is_long,
            regexp_extract(h, CASE WHEN is_long THEN '[^.]*\\.?[^.]*\\.[^.]*$' ELSE '[^.]*\\.?[^.]*$' END) AS domain, regexp_extract(h, CASE WHEN is_long THEN '[^.]*\\.[^.]*$' ELSE '[^.]*$' END) AS suffix
          FROM bare p LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) ON doc_id = page_id),
        hosts AS (SELECT host, domain, suffix, count(outcome) AS n, coalesce(sum(outcome), 0)::BIGINT AS bad FROM marked GROUP BY ALL),
        domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY ALL),
        s1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS m FROM suffixes),
        k1 AS (SELECT sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) AS e, sum(n * (n - 1) * m * (1 - m)) AS s FROM s1),
        s2 AS (SELECT suffix, (bad + k * m) / (n + k) AS rate FROM s1, (SELECT CASE WHEN s <> 0 AND e / s > 0 THEN least(1000.0, greatest(1.0, s / e - 1)) ELSE 1000.0 END AS k FROM k1)),
        d1 AS (SELECT d.*, rate AS m FROM domains d JOIN s2 USING (suffix)),
        k2 AS (SELECT sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) AS e, sum(n * (n - 1) * m * (1 - m)) AS s FROM d1),
        d2 AS (SELECT domain, (bad + k * m) / (n + k) AS rate FROM d1, (SELECT CASE WHEN s <> 0 AND e / s > 0 THEN least(1000.0, greatest(1.0, s / e - 1)) ELSE 1000.0 END AS k FROM k2)),
        h1 AS (SELECT h.*, rate AS m FROM hosts h JOIN d2 USING (domain)),
        k3 AS (SELECT sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) AS e, sum(n * (n - 1) * m * (1 - m)) AS s FROM h1),
        h2 AS (SELECT host, n, bad, (bad + k * m) / (n + k) AS rate, k FROM h1, (SELECT CASE WHEN s <> 0 AND e / s > 0 THEN least(1000.0, greatest(1.0, s / e - 1)) ELSE 1000.0 END AS k FROM k3)),
        judged AS (SELECT *, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) AS low FROM h2),
        rules(decision, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
        fitting AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision FROM parted JOIN rules
          ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY 1)
        SELECT p.page_id, p.host, p.path, rule, coalesce(decision, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n, bad, round(rate, 6) AS rate, round(low, 6) AS low
        FROM parted p JOIN judged USING (host) LEFT JOIN fitting USING (page_id)""",
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
          FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
        places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT * FROM d, (SELECT DISTINCT n FROM windows)), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
        hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY 1),
        listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op6_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN links ON a = id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY 1) ON id = doc_id""",
    "op9_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(body) AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + i * 5 // 4, 2))::INTEGER) >> (3 - (i * 5 % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest
        FROM p""",
    # DuckDB has no crc32, so it goes byte by byte through the usual table of remainders.
    "op11_spelling_variants": rf"""
        WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
        coded AS (SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs),
        hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM coded, crc),
        v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM places),
        near AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
          UNION SELECT a.word, v.word, v.n FROM holes a JOIN v ON v.word = a.p || a.s
          UNION SELECT v.word, a.word, a.n FROM holes a JOIN v ON v.word = a.p || a.s),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY 1),
        forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
        follow AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT f.word, f.form, g.form FROM follow f JOIN forms g ON g.word = f.form)
        SELECT f.*, root FROM forms f JOIN (SELECT word, root FROM follow WHERE form IS NULL) USING (word)""",
}
