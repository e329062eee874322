"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from larkfold.llm.common import LOWER, UPPER
from larkfold.llm.url_filter import MAX_BAD_RATE, RULES, STRONGEST, SUFFIX_RULES, TAIL, WEAKEST
from larkfold.llm.warc import DATE

FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rule(what: str) -> str:
    fits = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    return "CASE " + " ".join(
        f"WHEN (p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'" for h, p, v in fits
    ) + " END"


def _strength(level: str) -> str:
    """One row (k) with the prior strength of a level (n, bad, parent)."""
    excess, weight = "sum(n * (bad / n - parent) ** 2 - parent * (1 - parent))", "sum(parent * (1 - parent) * (n - 1))"
    return f"SELECT CASE WHEN coalesce({weight}, 0) <= 0 OR {excess} <= 0 THEN {STRONGEST} ELSE least(greatest({weight} / {excess} - 1, {WEAKEST}), {STRONGEST}) END AS k FROM {level} WHERE n > 0"


SUFFIXES = ", ".join(f"('{s}')" for s in SUFFIX_RULES)
#: Points of the integral of a beta density.
POINTS = 4000

# the posterior below the limit is the density's integral, by midpoints
OP1 = rf"""WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 o AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
 h0 AS (SELECT host, sum(coalesce(n, 0))::DOUBLE AS n, sum(coalesce(bad, 0))::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
 h1 AS (SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g'), '.') AS l FROM h0), rules AS (SELECT * FROM (VALUES {SUFFIXES}) AS v(rule)),
 c AS (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM h1),
 m AS (SELECT host, max(CASE WHEN rule = '!' || array_to_string(l[-i:], '.') THEN 1000 + i - 1 ELSE i END) AS m FROM c JOIN rules
   ON rule IN (array_to_string(l[-i:], '.'), '!' || array_to_string(l[-i:], '.')) OR (i > 1 AND rule = '*.' || array_to_string(l[-(i - 1):], '.')) GROUP BY host),
 h2 AS (SELECT h1.*, coalesce(m % 1000, 1) AS k FROM h1 LEFT JOIN m USING (host)),
 hosts AS (SELECT host, n, bad, array_to_string(l[-k:], '.') AS suffix, CASE WHEN len(l) <= k THEN array_to_string(l, '.') ELSE array_to_string(l[-(k + 1):], '.') END AS domain FROM h2),
 domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
 ls AS (SELECT *, coalesce((SELECT sum(bad) / nullif(sum(n), 0) FROM suffixes), 0) AS parent FROM suffixes), ks AS ({_strength("ls")}),
 ld AS (SELECT d.*, (ks.k * ls.parent + ls.bad) / (ks.k + ls.n) AS parent FROM domains d JOIN ls USING (suffix), ks), kd AS ({_strength("ld")}),
 lh AS (SELECT h.*, (kd.k * ld.parent + ld.bad) / (kd.k + ld.n) AS parent FROM hosts h JOIN ld USING (suffix, domain), kd), kh AS ({_strength("lh")}),
 ab AS (SELECT host, kh.k * parent + bad AS a, kh.k * (1 - parent) + n - bad AS b FROM lh, kh), shapes AS (SELECT DISTINCT a, b FROM ab WHERE a > 0 AND b > 0),
 cdf AS (SELECT a, b, {MAX_BAD_RATE} / {POINTS} * sum(exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln({MAX_BAD_RATE} * (g.i + 0.5) / {POINTS}) + (b - 1) * ln(1 - {MAX_BAD_RATE} * (g.i + 0.5) / {POINTS}))) AS below
   FROM shapes, range({POINTS}) AS g(i) GROUP BY a, b),
 rh AS (SELECT host, CASE WHEN a <= 0 THEN false WHEN b <= 0 THEN true ELSE below < {TAIL} END AS blocked FROM ab LEFT JOIN cdf USING (a, b))
 SELECT page_id, p.host, path, {_rule("rule")} AS rule, coalesce({_rule("verdict")}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN rh ON p.host = rh.host"""

OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, '{SPACE}') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
 n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
 SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n"""

OP4 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE}')) AS size, md5(doc_id::VARCHAR) AS o FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
 b AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
   sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM r),
 t AS (SELECT source, source_size, round(CASE WHEN cap <= remains / lw * w THEN cap ELSE max(CASE WHEN NOT cap <= remains / lw * w THEN remains / lw END) OVER () * w END, 6) AS target FROM b),
 q AS (SELECT doc_id, d.source, o, size, source_size, target, row_number() OVER () AS i, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 v AS (SELECT *, unnest([e, source_size + e, 2 * source_size + e]) AS fin FROM q WHERE target > 0),
 g AS (SELECT *, sum(size) OVER (ORDER BY fin / target, source NULLS LAST, o, i ROWS UNBOUNDED PRECEDING) AS total FROM v WHERE fin - size / 2 <= target),
 n AS (SELECT i, count(*) AS n FROM g WHERE total <= (SELECT sum(size) FROM d) GROUP BY i)
 SELECT doc_id, size, source_size, target, (coalesce(n, 0) * size)::BIGINT AS taken FROM q LEFT JOIN n USING (i)"""

OP6 = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
 x AS (SELECT page_id, url, h, CASE WHEN page_id <> first THEN first END AS refers_to, octet_length(encode(h)) AS n, sha1(h) AS hex FROM p),
 b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM x),
 d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * (substr(bits, i * 5 + 1, 1) = '1')::INT + 8 * (substr(bits, i * 5 + 2, 1) = '1')::INT
   + 4 * (substr(bits, i * 5 + 3, 1) = '1')::INT + 2 * (substr(bits, i * 5 + 4, 1) = '1')::INT + (substr(bits, i * 5 + 5, 1) = '1')::INT, 1)), '') AS digest, chr(13) || chr(10) AS eol, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS kind FROM b)
 SELECT page_id, n AS payload_bytes, digest AS payload_digest, kind AS record_type, refers_to,
  sha256('WARC/1.1' || eol || 'WARC-Type: ' || kind || eol || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || eol || 'WARC-Date: {DATE}' || eol || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A')
   || eol || 'WARC-Payload-Digest: sha1:' || digest || coalesce(eol || 'WARC-Refers-To: <urn:page:' || refers_to || '>', '') || eol || 'Content-Type: text/html' || eol || 'Content-Length: ' || CASE WHEN kind = 'response' THEN n ELSE 0 END
   || eol || eol || CASE WHEN kind = 'response' THEN h ELSE '' END || eol || eol) AS record_sha256 FROM d"""

OP10 = rf"""WITH i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({FOLD}, '{ALNUM}') AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda x: array_to_string(w[x:x + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
 d AS (SELECT doc_id, regexp_extract_all({FOLD}, '{ALNUM}') AS w FROM documents), ks AS (SELECT DISTINCT k FROM win),
 dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN ks ON len(w) >= k),
 hits AS (SELECT doc_id, dp.k, p, item_id FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[p:p + dp.k - 1], ' ') = g),
 hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM hits) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id"""

_NEAREST = """arg_min(e, list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::HUGEINT * 64 + e)"""


def _assigned(books: str) -> str:
    return f"SELECT i, p.part, any_value(v) AS v, {_NEAREST} AS e FROM p JOIN {books} b ON p.part = b.part GROUP BY i, p.part"


def _moved(assigned: str, books: str) -> str:
    """The codebook after one more round: floors of means, entries without parts as they were."""
    floor = "(s - ((s % n) + n) % n) // n"
    return f"""SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (SELECT part, e, list({floor} ORDER BY j) AS c FROM
   (SELECT part, e, j, sum(v[j]) AS s, count(*) AS n FROM {assigned}, range(1, (SELECT w FROM width) + 1) AS g(j) GROUP BY part, e, j) GROUP BY part, e) m ON b.part = m.part AND b.e = m.e"""


OP12 = f"""WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 d AS (SELECT len(q) AS n FROM q WHERE len(q) > 0 AND len(q) % 16 = 0 GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1), width AS (SELECT n // 16 AS w FROM d),
 k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS i FROM q WHERE len(q) = (SELECT n FROM d)),
 p AS (SELECT i, part, q[part * w + 1:(part + 1) * w] AS v FROM k, width, range(16) AS g(part)),
 c0 AS (SELECT part, i - 1 AS e, v AS c FROM p WHERE i <= 64), a0 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_moved("a0", "c0")}),
 a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_moved("a1", "c1")}), a2 AS MATERIALIZED ({_assigned("c2")}),
 s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2),
 r AS (SELECT i, string_agg(printf('%02x', a2.e), '' ORDER BY a2.part) AS code, sum(list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j]))))::BIGINT AS error
   FROM a2 JOIN c2 ON a2.part = c2.part AND a2.e = c2.e GROUP BY i)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (i), s"""

# DuckDB has no crc32: its bits are taken one by one from the table-free definition
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
   lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)))"""

OP13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS l FROM t GROUP BY conv_id),
 h AS (SELECT conv_id, l, xor({_CRC}, 4294967295) % 9 AS h FROM l),
 r AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN l b ON b.conv_id = a.conv_id - a.conv_id % 5),
 m AS (SELECT conv_id, len(l) AS n, d AS depth, l[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(l[d].text)) END AS bytes FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
 n AS (SELECT min(conv_id) AS conv_id, depth, k, count(*) AS n_convs, max(n) > depth AS goes_on, (count(*) - 1) * max(bytes) AS own,
   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY depth, k),
 s AS (SELECT a.depth, a.conv_id, sum((NOT b.goes_on)::INT)::BIGINT AS n_leaves, sum(b.own)::BIGINT AS saved_tokens, sum((b.depth = a.depth + 1)::INT)::BIGINT AS n_children
   FROM n a JOIN n b ON b.depth >= a.depth AND b.k[1:a.depth] = a.k GROUP BY a.depth, a.conv_id)
 SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
 FROM n JOIN s ON n.depth = s.depth AND n.conv_id = s.conv_id LEFT JOIN n u ON n.depth = u.depth + 1 AND u.k = n.k[1:u.depth]"""
