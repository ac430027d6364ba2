"""DuckDB SQL of the queries that SQL can express."""

# Words of decontamination: folded text, runs of small letters, digits and non-ASCII characters.
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_FOLDED}, '{_WORD}'), []) AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g
    FROM b, unnest(range(1, greatest(len(w) - least(10, len(w)), 0) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS names FROM hits GROUP BY doc_id),
longest AS (
    SELECT doc_id, max(e - s) AS longest_match FROM (
        SELECT doc_id, item_id, min(i) AS s, max(i + n) AS e FROM (
            SELECT h.doc_id, h.item_id, h.i, h.n, p.pos - h.i AS diagonal, p.pos - row_number() OVER (PARTITION BY h.doc_id, h.item_id, p.pos - h.i ORDER BY p.pos) AS run
            FROM hits h JOIN (SELECT item_id, i AS pos, list_slice(w, i, i + least(10, len(w)) - 1) AS g FROM b, unnest(range(1, greatest(len(w) - least(10, len(w)), 0) + 2)) AS t(i) WHERE len(w) > 0) p
              ON p.item_id = h.item_id
            JOIN grams x ON x.doc_id = h.doc_id AND x.i = h.i AND x.n = h.n AND x.g = p.g)
        GROUP BY doc_id, item_id, diagonal, run)
    GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE octet_length(encode(body)) >= 100 GROUP BY body)
SELECT page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, sha256(p.body) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.body = f.body
"""

_RENDERED = "array_to_string(list_transform({0}, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '')"
_SPANS = """(SELECT coalesce(string_agg((stop - own) || ':' || stop, ',' ORDER BY k), '') FROM (
    SELECT k, turn, sum(head + own) OVER (ORDER BY k) AS stop, own FROM (
        SELECT k, {0}[k] AS turn, length(coalesce({0}[k].role, '')) + 13 AS head, length(coalesce({0}[k].text, '')) + 11 AS own
        FROM (SELECT unnest(range(1, len({0}) + 1)) AS k))) WHERE turn.role = 'assistant')"""

OP5 = f"""
WITH c AS (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (
    SELECT a.conv_id, a.own AS chosen,
           list_concat(list_slice(a.own, 1, coalesce(list_max(list_filter(range(1, len(a.own) + 1), lambda i: a.own[i].role = 'assistant')) - 1, len(a.own))),
                       coalesce(list_slice(list_filter(b.own, lambda t: t.role = 'assistant'), -1, -1), [])) AS rejected
    FROM c a LEFT JOIN c b ON b.conv_id = xor(a.conv_id, 1)),
n AS (
    SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                            least(len(chosen), len(rejected))) AS INTEGER) AS prompt_turns FROM p),
r AS (SELECT conv_id, prompt_turns, list_slice(chosen, 1, prompt_turns) AS prompt, list_slice(chosen, prompt_turns + 1, len(chosen)) AS chosen,
             list_slice(rejected, prompt_turns + 1, len(rejected)) AS rejected FROM n)
SELECT conv_id, prompt_turns, {_RENDERED.format("prompt")} AS prompt, {_RENDERED.format("chosen")} AS chosen_text, {_SPANS.format("r.chosen")} AS chosen_spans,
       {_RENDERED.format("rejected")} AS rejected_text, {_SPANS.format("r.rejected")} AS rejected_spans
FROM r
"""

_OP10_WORDS = r"[^\x20\x09-\x0D]+"
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_OP10_WORDS}'), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
dup AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, p FROM g JOIN dup USING (h), unnest(range(i, i + 35)) AS t(p)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_OP10_WORDS}'), []) AS w FROM documents),
s AS (
    SELECT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g, count(*) AS c
    FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE m >= 0.8 * (a.n + b.n - m)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, min(y) = x AS kept FROM reach GROUP BY x
"""

OP8 = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
pairs AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
    WITH RECURSIVE r(x, y) USING KEY (x, y) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.x, p.y FROM r JOIN pairs p ON p.x = r.y)
    SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, CAST((SELECT count(*) FROM pairs WHERE x = vec_id) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM u JOIN reach ON x = vec_id
"""

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3,
    "op4_warc": OP4,
    "op5_preferences": OP5,
    "op6_minhash_dedup": OP6,
    "op8_embedding_dedup": OP8,
    "op10_substring_dedup": OP10,
}
