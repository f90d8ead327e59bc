"""SQL of those queries on the training-data operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

P4_FOUND = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 30),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.6 - 1e-12"""

P4_GROUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM p),
m AS (SELECT doc_id, list_sort(list(g)) AS own FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY own) AS class_id FROM m),
r AS (SELECT s.doc_id, g FROM s JOIN k ON k.doc_id = s.doc_id AND k.class_id = s.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8 - 1e-12),
reached(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, root FROM reached JOIN e ON e.a = id),
g AS (SELECT id, min(root) AS root FROM reached GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(root, class_id, doc_id) AS group_id FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN k USING (doc_id) LEFT JOIN g ON g.id = class_id"""

#: What must hold of any filling: every text once, whole, no container overfull, only longer texts split.
P2_CHECK = """
WITH t AS (SELECT spec_id, capacity, CASE unit WHEN 'chars' THEN length(text) ELSE octet_length(encode(text)) END AS n FROM documents, container_specs WHERE length(text) > 0)
SELECT spec_id, count(*) AS texts, sum(n)::BIGINT AS size, count(*) FILTER (n > capacity) AS split, 0 AS torn, 0 AS overfull FROM t GROUP BY spec_id"""

#: What must hold of any mix: all conversations are there with their characters, none is used too often.
P1_CHECK = r"""
WITH m AS (SELECT conv_id, turn, max(nullif(regexp_replace(trim(lower(task)), '[\s_-]+', '_', 'g'), '')) AS task, max(coalesce(length(content), 0)) AS n FROM chat_messages GROUP BY ALL),
c AS (SELECT conv_id, max(task) AS task, sum(n) AS n FROM m GROUP BY conv_id)
SELECT task, count(*) AS conversations, sum(n)::BIGINT AS chars, 0 AS overused FROM c GROUP BY task"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p2_check": P2_CHECK, "p1_check": P1_CHECK, "p1_check_held": P1_CHECK}
