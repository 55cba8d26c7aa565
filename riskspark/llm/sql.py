"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from riskspark.llm import chat, decontam, substring, urlgraph

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# of payloads of 100 bytes or more the smallest page_id (then url) is the response
OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, page_id IS NOT NULL AND payload_bytes >= 100 AS counts FROM d),
r AS (SELECT *, row_number() OVER w AS nth, min(page_id) OVER (PARTITION BY payload_digest, counts) AS lead FROM f
      WINDOW w AS (PARTITION BY payload_digest, counts ORDER BY page_id, url NULLS FIRST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN counts AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN counts AND nth > 1 THEN lead END AS refers_to, url AS target_uri
FROM r"""


def _url_filter() -> str:
    """Rules, host edges and the rounds of both propagations, written out."""
    host = _LOWER.format("coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '')")
    fits = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(sorted(urlgraph.RULES, key=lambda r: -len(r[1] + r[2]))))
    order = sorted(urlgraph.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE" + fits.format(*[h + p for _, h, p in order]) + " END"
    action = "CASE" + fits.format(*[a for a, _, _ in order]) + " END"
    href = r"""(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''<>]+)"""
    out = [f"""base AS (SELECT page_id, {host.format('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages)""",
           f"ruled AS (SELECT page_id, host, path, html, {rule} AS rule, {action} AS action FROM base)",
           f"""links AS (SELECT DISTINCT page_id, host AS src, u FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '{href}', 1)) AS u FROM base))""",
           f"""named AS (SELECT DISTINCT page_id, src, {host.format("(CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END)")} AS dst FROM links)""",
           "edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
           "hosts AS (SELECT host, count(*) FILTER (action = 'allow') / count(*) AS allow, count(*) FILTER (action = 'block') / count(*) AS block FROM ruled WHERE host <> '' GROUP BY host)",
           "size AS (SELECT coalesce(sum(allow), 0) / 0.15 AS allow_unit, coalesce(sum(block), 0) / 0.15 AS block_unit FROM hosts)"]
    for kind, src, dst in (("allow", "src", "dst"), ("block", "dst", "src")):
        out += [f"{kind}_p AS (SELECT {src} AS a, {dst} AS b, weight / sum(weight) OVER (PARTITION BY {src}) AS p FROM edges)",
                f"{kind}_0 AS (SELECT host, {kind} / sum({kind}) OVER () AS mass FROM hosts WHERE {kind} > 0)"]
        for k in range(1, 12 + 1):
            out.append(f"{kind}_{k} AS (SELECT host, sum(mass) AS mass FROM (SELECT b AS host, p * mass * 0.85 AS mass FROM {kind}_p JOIN {kind}_{k - 1} ON a = host "
                       f"UNION ALL SELECT host, mass * 0.15 FROM {kind}_0) GROUP BY host)")
    last = 12
    return "WITH " + ",\n".join(out) + f"""
SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN round(coalesce(b.mass, 0) * block_unit, 12) >= 0.5
       AND round(coalesce(b.mass, 0) * block_unit, 12) > round(coalesce(a.mass, 0) * allow_unit, 12) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r CROSS JOIN size LEFT JOIN allow_{last} a ON r.host = a.host LEFT JOIN block_{last} b ON r.host = b.host"""


OP6 = rf"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT DISTINCT 'b', CAST(item_id AS VARCHAR), regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id, w, least({decontam.WINDOW}, len(w)) AS m FROM words WHERE kind = 'b' AND len(w) > 0),
windows AS (SELECT DISTINCT id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT m FROM items),
places AS (SELECT id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes WHERE kind = 'd')),
hits AS (SELECT p.id, p.i, p.m, v.id AS item FROM places p JOIN windows v ON p.m = v.m AND p.s = v.s),
marked AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN marked USING (id) LEFT JOIN named USING (id) WHERE w.kind = 'd'"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP8 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat.TURN + chat.TEXT + chat.END)} AS chars,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM t),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id"""

OP10 = rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '([.!?][ \t]+|\n+)', '\1' || chr(1), 'g'), chr(1))) AS unit, generate_subscripts(string_split(regexp_replace(text, '([.!?][ \t]+|\n+)', '\1' || chr(1), 'g'), chr(1)), 1) AS place FROM docs),
units AS (SELECT *, trim(regexp_replace({_LOWER.format("unit")}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS norm, sum(length(unit)) OVER (PARTITION BY doc_id, text ORDER BY place) AS stop FROM cut WHERE unit <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, text, place) > 1 AND norm <> '' AS again FROM units),
grouped AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, text, again ORDER BY place) AS run FROM ranked),
summed AS (SELECT *, again AND sum(len(string_split(norm, ' '))) OVER (PARTITION BY doc_id, text, again, run) >= {substring.MIN_WORDS} AS gone FROM grouped),
spans AS (SELECT doc_id, text, run, min(stop - length(unit)) AS a, max(stop) AS b FROM summed WHERE gone GROUP BY doc_id, text, run),
removed AS (SELECT doc_id, text, count(*) AS n, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id, text),
kept AS (SELECT doc_id, text, coalesce(string_agg(unit, '' ORDER BY place) FILTER (NOT gone), '') AS left_text FROM summed GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_text, '') END AS text, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS removed_spans
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text LEFT JOIN removed r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text"""

OP13 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY lang, m, w[i:i + m - 1]),
candidates AS (SELECT lang, m, g, f AS a FROM grams WHERE m >= 2 AND f >= 10),
cuts AS (SELECT lang, m, g, a, k, g[1:k] AS x, g[k + 1:m] AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scores AS (SELECT c.lang, c.m, c.g, c.a, k, p.f AS l, q.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(p.f AS HUGEINT) * q.f) AS score
           FROM cuts c JOIN grams p ON c.lang = p.lang AND p.g = c.x JOIN grams q ON c.lang = q.lang AND q.g = c.y),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + 1] AS g, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE m = 3) GROUP BY lang, g[i:i + 1]),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inside i ON l.m = 2 AND l.lang = i.lang AND l.g = i.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * l.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

OP12 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
crc(c, h) AS (SELECT conv_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, x: list_reduce([xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) FROM own),
built AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:xor(h, 4294967295) % 4], []), o.turns[(xor(h, 4294967295) % 4) + 1:]) AS turns
          FROM own o JOIN crc ON o.conv_id = crc.c LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                 (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY p, d),
born AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN born b ON n.p = b.p AND n.d = b.d),
sums AS (SELECT p[1:k] AS p, k AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
         FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY p[1:k], k)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.p = s.p AND n.d = s.d LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""

ORACLES = {"op1_warc": OP1, "op3_url_filter": _url_filter(), "op6_decontamination": OP6, "op8_chat": OP8, "op10_line_dedup": OP10, "op12_prefix_trie": OP12, "op13_collocations": OP13}
