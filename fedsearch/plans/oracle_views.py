"""The fixture views of ``fedsearch.plans.fixtures`` in DuckDB SQL.

Every oracle query is ``WITH <views it needs> SELECT ...`` over the driver's
pre-registered tables. Definitions mirror FIXTURES.md section 3 exactly.
"""

from __future__ import annotations

# (name, body) in dependency order
VIEWS: list[tuple[str, str]] = [
    ("emb", "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    ("seeds", "SELECT vec_id::INTEGER AS source_id, v AS seed FROM emb WHERE vec_id < 10"),
    ("src", """SELECT vec_id, v, label, source_id FROM (
        SELECT e.vec_id, e.v, e.label, s.source_id,
               row_number() OVER (PARTITION BY e.vec_id
                                  ORDER BY list_inner_product(e.v, s.seed) DESC, s.source_id) AS rn
        FROM emb e CROSS JOIN seeds s) WHERE rn = 1"""),
    ("q", "SELECT vec_id AS qid, v AS qv, source_id AS home FROM src WHERE vec_id % 10 = 1"),
    ("corpus", "SELECT source_id, vec_id, v FROM src WHERE vec_id % 10 <> 1"),
    ("routed", """SELECT q.qid, q.qv, s.source_id FROM q CROSS JOIN seeds s
        WHERE (q.qid + s.source_id) % 3 = 0"""),
    ("hits", """SELECT qid, source_id, vec_id, score, local_rank FROM (
        SELECT r.qid, r.source_id, c.vec_id, list_inner_product(r.qv, c.v) AS score,
               row_number() OVER (PARTITION BY r.qid, r.source_id
                                  ORDER BY list_inner_product(r.qv, c.v) DESC, c.vec_id) AS local_rank
        FROM routed r JOIN corpus c ON r.source_id = c.source_id) WHERE local_rank <= 5"""),
    ("gtop", """SELECT qid, source_id, vec_id, score, rank FROM (
        SELECT q.qid, c.source_id, c.vec_id, list_inner_product(q.qv, c.v) AS score,
               row_number() OVER (PARTITION BY q.qid
                                  ORDER BY list_inner_product(q.qv, c.v) DESC, c.vec_id) AS rank
        FROM q CROSS JOIN corpus c) WHERE rank <= 20"""),
    ("source_labels", "SELECT DISTINCT qid, source_id FROM gtop WHERE rank <= 3"),
    ("qrels", """SELECT qid, vec_id, ((qid + vec_id) % 3)::INTEGER AS rel,
        row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS ord
        FROM gtop WHERE (qid * 7 + vec_id) % 5 <> 0"""),
    ("scored", """SELECT q.qid, s.source_id,
        CASE WHEN l.qid IS NULL THEN 0 ELSE 1 END AS label,
        round(1.0 / (1.0 + exp(-4.0 * list_inner_product(q.qv, s.seed))), 2) AS prob
        FROM q CROSS JOIN seeds s
        LEFT JOIN source_labels l ON l.qid = q.qid AND l.source_id = s.source_id"""),
    ("split", """SELECT qid, CASE WHEN pos <= n_test THEN 'test'
                                 WHEN pos <= n_test + ceil(0.1 * (n - n_test)) THEN 'val'
                                 ELSE 'train' END AS split
        FROM (SELECT qid, pos, n, ceil(0.6 * n) AS n_test FROM (
              SELECT qid, row_number() OVER (ORDER BY (qid * 7919) % 1009, qid) AS pos,
                     count(*) OVER () AS n FROM q))"""),
    ("cent_long", """SELECT source_id, i AS pos, avg(x) AS mean FROM (
        SELECT source_id, unnest(v) AS x, CAST(unnest(range(len(v))) AS INTEGER) AS i FROM corpus)
        GROUP BY source_id, i"""),
    ("centroid", "SELECT source_id, list(mean ORDER BY pos) AS centroid FROM cent_long GROUP BY source_id"),
    ("sstats", """SELECT c.source_id, c.centroid, count(*) AS num_documents,
        avg(CASE WHEN sqrt(list_inner_product(k.v, k.v)) * sqrt(list_inner_product(c.centroid, c.centroid)) > 0
                 THEN list_inner_product(k.v, c.centroid)
                      / (sqrt(list_inner_product(k.v, k.v)) * sqrt(list_inner_product(c.centroid, c.centroid)))
                 ELSE 0.0 END) AS density
        FROM corpus k JOIN centroid c ON c.source_id = k.source_id GROUP BY c.source_id, c.centroid"""),
    ("feats", """SELECT q.qid, c.source_id,
        list_concat(list_concat(q.qv, c.centroid),
                    list_transform(range(10), lambda i: CASE WHEN i = c.source_id THEN 1.0 ELSE 0.0 END)) AS features
        FROM q CROSS JOIN centroid c"""),
    ("examples", """SELECT f.qid, f.source_id, f.features, s.label, p.split
        FROM feats f JOIN scored s ON s.qid = f.qid AND s.source_id = f.source_id
        JOIN split p ON p.qid = f.qid"""),
    ("answers", """SELECT item_id, item_id % 4 AS bank,
        chr(65 + ((item_id // 4) % 4)::INTEGER) AS gold,
        CASE item_id % 8
          WHEN 0 THEN '{"step_by_step_thinking": "see the documents", "answer_choice": "'
                      || chr(65 + ((item_id * 3) % 4)::INTEGER) || '"}'
          WHEN 1 THEN chr(65 + ((item_id * 3) % 4)::INTEGER)
          WHEN 2 THEN chr(65 + ((item_id * 3) % 4)::INTEGER) || ' or'
          WHEN 3 THEN 'Option ' || chr(65 + ((item_id * 3) % 4)::INTEGER)
          WHEN 4 THEN chr(65 + ((item_id * 3) % 4)::INTEGER) || '.'
          WHEN 5 THEN ': ' || chr(65 + ((item_id * 3) % 4)::INTEGER)
          WHEN 6 THEN 'The best answer is ' || chr(65 + ((item_id * 3) % 4)::INTEGER) || '.'
          ELSE 'I cannot tell.' END AS llm_output
        FROM benchmark"""),
    ("latency", """SELECT event_type AS dataset, 'src' || CAST(event_id % 10 AS VARCHAR) AS source,
        user_id AS question_id, value AS duration FROM events"""),
]

_NAMES = [n for n, _ in VIEWS]


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it (transitively) references."""
    import re

    def refs(text: str) -> set[str]:
        return {n for n in _NAMES if re.search(rf"\b{n}\b", text)}

    needed: set[str] = set()
    frontier = refs(body)
    bodies = dict(VIEWS)
    while frontier:
        n = frontier.pop()
        if n in needed:
            continue
        needed.add(n)
        frontier |= refs(bodies[n]) - {n}
    parts = [f"{n} AS ({b})" for n, b in VIEWS if n in needed]
    if not parts:
        return body
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        # the query's own CTEs come after the views they may use
        return "WITH " + ",\n".join(parts) + ",\n" + head[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
