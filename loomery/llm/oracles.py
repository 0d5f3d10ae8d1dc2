"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from loomery.llm.decontaminate import COVER, SPAN

_WORDS = r"'[^\x20\x09-\x0D]+'"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight, 2.0 * source_size AS bound FROM s),
o AS (SELECT *, 1.5 * (SELECT sum(source_size) FROM s) AS total,
  coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM w),
f AS (SELECT *, (total - below) / above AS level FROM o),
l AS (SELECT min_by(level, bound / weight) AS level FROM f WHERE level * weight <= bound),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN bound ELSE least(bound, (SELECT level FROM l) * weight) END AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS rank,
  CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * 1073741824.0)::HUGEINT ELSE 0 END AS ratio,
  (('0x' || substr(md5(coalesce(d.source, '') || '|17'), 1, 7))::BIGINT * 4)::HUGEINT AS dice
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((((rank + 1) * ratio + dice) // 1073741824 - (rank * ratio + dice) // 1073741824) * size)::BIGINT AS taken FROM r
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS start, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, start, array_to_string(w[start + 1 : start + 20], ' ') AS seq FROM g),
n AS (SELECT doc_id, start, rank() OVER (PARTITION BY seq ORDER BY doc_id, start) AS place FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS p FROM n WHERE place > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept, count(*) AS n_kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p WHERE gone.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(sha || '00', (i * 5 // 4) + 1, 2))::BIGINT) >> (3 - i * 5 % 4)) & 31)::INT + 1, 1)) AS letters FROM m)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM b
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, unnest(range(0, n - 199)) AS pos, h FROM d WHERE n >= 200),
c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY seq) AS times FROM (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 400)) AS seq FROM g)),
r AS (SELECT doc_id, pos, CASE WHEN pos > max(pos + 200) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS apart FROM c WHERE times > 1),
s AS (SELECT doc_id, pos, sum(apart) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM r),
x AS (SELECT doc_id, span, min(pos) AS low, max(pos) + 200 AS high FROM s GROUP BY ALL),
k AS (SELECT d.doc_id, x.low, substr(d.h, 2 * coalesce(lag(high) OVER w, 0) + 1, 2 * (low - coalesce(lag(high) OVER w, 0))) AS part, substr(d.h, 2 * high + 1) AS rest, lead(low) OVER w IS NULL AS final
  FROM d JOIN x USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY x.low)),
j AS (SELECT doc_id, count(*) AS n_spans, string_agg(part, '' ORDER BY low) || max(CASE WHEN final THEN rest ELSE '' END) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, (d.n - length(coalesce(kept, h)) // 2)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""

#: The polynomial is that of zip files; a table entry is eight shifts of its byte.
SPELLING = r"""
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(concat(coalesce(doc_id::VARCHAR, 'null'), ':', run))) AS h FROM runs),
c AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS dice FROM b, t),
v AS (SELECT CASE WHEN dice % 97 = 0 THEN substr(run, 1, (dice % length(run))::INT) || substr(run, (dice % length(run))::INT + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.short = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.short = w.word),
s AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n)::BIGINT AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN s USING (word)),
r AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM r GROUP BY word) e USING (word)
""".replace("WITH t", "WITH RECURSIVE t", 1)

MIDDLES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
e AS (SELECT doc_id, text, length(text)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS dice FROM d),
c AS (SELECT *, least(dice[1] % (n + 1), dice[2] % (n + 1)) AS low, greatest(dice[1] % (n + 1), dice[2] % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR dice[3] % 100 >= 90 THEN 'plain' WHEN dice[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def leaks(least: int = 11) -> str:
    """Benchmark passages in documents. Items shorter than a window, of which the test tables have none, are left out."""
    key = lambda mask: "concat_ws(' ', " + ", ".join(f"seq[{i + 1}]" for i, x in enumerate(mask) if x == "1") + ")"
    keys = ", ".join(f"{key(m)} AS k{i}" for i, m in enumerate(COVER))
    joins = " UNION ".join(f"SELECT d.doc_id, d.start AS d_start, d.seq, i.seq AS other FROM dk d JOIN ik i ON d.k{i} = i.k{i}" for i in range(len(COVER)))
    cut = lambda table, name: f"SELECT {name}, regexp_extract_all(lower(coalesce(text, '')), {_WORDS}) AS w FROM {table}"
    return rf"""
WITH d AS ({cut('documents', 'doc_id')}), b AS ({cut('benchmark', 'item_id')}),
dw AS (SELECT doc_id, start, w[start + 1 : start + {SPAN}] AS seq FROM (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS start FROM d WHERE len(w) >= {SPAN})),
iw AS (SELECT w[pos + 1 : pos + {SPAN}] AS seq, item_id, pos, len(w) AS size FROM (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS pos FROM b WHERE len(w) >= {SPAN})),
dk AS (SELECT *, {keys} FROM dw), ik AS (SELECT *, {keys} FROM (SELECT DISTINCT seq FROM iw)),
h AS (SELECT * FROM ({joins}) WHERE list_sum(list_transform(range(1, {SPAN + 1}), lambda i: (seq[i] = other[i])::INT)) >= {least})
SELECT doc_id, item_id, count(DISTINCT d_start) AS n_windows, len(list_distinct(flatten(list(range(d_start, d_start + {SPAN})))))::BIGINT AS overlap_words, size::BIGINT AS item_words
FROM h JOIN iw ON h.other = iw.seq GROUP BY doc_id, item_id, size
"""


JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT r.doc_id, min(other) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.doc_id) AS n_links FROM r GROUP BY r.doc_id
"""
