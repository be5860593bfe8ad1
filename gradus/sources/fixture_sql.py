"""The fixtures in DuckDB SQL, over the same tables."""

from gradus.sources.fixtures import CUE_PHRASES, HEADLINES, OVERVIEW


def _replaced(text: str) -> str:
    for word, phrase in CUE_PHRASES:
        text = f"replace({text}, '{word}', '{phrase}')"
    return text


def _headline(key: str) -> str:
    of = [(i, path) for i, (k, path, _) in enumerate(HEADLINES) if k == key]
    return "'{' || " + " || ', ' || ".join(f"""'"{path}": ' || (((c * {i + 1} + q) % 9973) / 100)::DECIMAL(20, 2)""" for i, path in of) + " || '}'"


def _overview(i: int, path: str | None) -> str:
    if path is None:
        return """'{"evaluated_questions": ' || k || ', "correct_outlier_count": ' || (c % k) || '}'"""
    return f"""'{{"{path}": ' || (((c * {i + 1}) % 997) / 10)::DECIMAL(20, 1) || '}}'"""


LEVEL = "['unistructural', 'multistructural', 'relational', 'extended_abstract']"
TOK = r"[\p{L}\p{N}_]+"

FIXTURE_SQL = {
    "lessons": rf"SELECT doc_id AS lesson_id, source || '/' || doc_id // 200 AS course_id, array_to_string(regexp_extract_all(text, '{TOK}')[1:3], ' ') AS title, text AS raw_content, lang FROM documents",
    "lesson_pages": "SELECT lesson_id, unnest(range(1, len(x) + 1)) AS page, unnest(x) AS page_text FROM (SELECT lesson_id, string_split(raw_content, chr(10)) AS x FROM lessons)",
    "sections": """SELECT lesson_id * 1000 + page AS section_id, lesson_id, array_to_string(string_split(page_text, ' ')[1:3], ' ') AS title, string_split(page_text, ' ')[4:5] AS key_topics,
        page AS start_page, page + 4 AS end_page, page // 5 AS order_index, page_text AS content FROM lesson_pages WHERE page % 5 = 1""",
    "learning_objects": rf"""SELECT item_id AS lo_id, item_id // 14 AS lo_section, item_id // 28 AS lo_lesson, array_to_string(w[1:3], ' ') AS title,
        [x.w for x in list_sort([{{'i': list_position(w, y), 'w': y}} for y in list_distinct([z for z in w if length(z) >= 8])])][1:6] AS keywords, text AS content,
        ['concept', 'procedure', 'example', 'law'][item_id % 4 + 1] AS object_type,
        CASE WHEN item_id % 5 = 0 THEN []::INT[] ELSE [(item_id % 7 + 1)::INT, (item_id % 7 + 3)::INT] END AS source_pages
        FROM (SELECT *, regexp_extract_all(text, '{TOK}') AS w FROM benchmark)""",
    "edges": """SELECT source_id, target_id, CASE min(f) WHEN 'A' THEN 'part_of' WHEN 'N' THEN 'prerequisite' ELSE 'relates_to' END AS relationship_type
        FROM (SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS f FROM lineitem) WHERE source_id <> target_id GROUP BY 1, 2""",
    "questions": f"""SELECT question_id, (CASE WHEN question_id % 5 = 0 THEN 'Which is not ' ELSE '' END) || text || (CASE WHEN question_id % 3 <> 0 THEN '?' ELSE '' END) AS question_text, options,
        k AS correct_option_index, options[k + 1] AS correct_answer, {LEVEL}[conv_id % 4 + 1] AS solo_level, conv_id % (SELECT count(*) FROM benchmark) AS learning_object_id, conv_id AS primary_lesson_id, conv_id + 1 AS secondary_lesson_id,
        conv_id // 10 AS quiz_id, conv_id % 7 AS question_section_id
        FROM (SELECT *, CASE WHEN conv_id % 17 = 0 OR len(options) = 0 THEN NULL ELSE (conv_id % greatest(len(options), 1))::INT END AS k
          FROM (SELECT u.conv_id, u.conv_id * 1000 + u.turn AS question_id, u.text, [y for y in [trim(x) for x in string_split_regex(a.text, '[.\\n]+')] if y <> ''][1:(u.conv_id % 5 + 2)] AS options
            FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'))""",
    "numeric_questions": """SELECT l_orderkey AS question_id, list(l_quantity::INT::VARCHAR ORDER BY l_linenumber, l_quantity::INT::VARCHAR) AS options, (l_orderkey % count(*))::INT AS correct_option_index FROM lineitem GROUP BY l_orderkey""",
    "option_vectors": """SELECT e.question_id, e.pos, [w * k.own[i] + (1 - w) * e.own[i] for i in range(1, len(e.own) + 1)] AS vector FROM
        (SELECT vec_id // 4 AS question_id, (vec_id % 4)::INT AS pos, embedding::DOUBLE[] AS own,
          (CASE vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN CASE WHEN (vec_id // 4) % 3 = 0 THEN 0.94 ELSE 0.6 END ELSE 0.0 END)::DOUBLE AS w FROM embeddings) e
        JOIN (SELECT vec_id // 4 AS question_id, embedding::DOUBLE[] AS own FROM embeddings WHERE vec_id % 4 = 0) k ON e.question_id = k.question_id""",
    "judge_pairs": f"SELECT doc_id, {LEVEL}[doc_id % 4 + 1] AS intended, {LEVEL}[quality + 2 * toxic + 1] AS classified FROM labels",
    "raw_responses": f"""SELECT doc_id AS question_id, CASE WHEN doc_id % 13 = 0 THEN substr(t, 1, 20) ELSE t END AS response FROM (SELECT doc_id,
        'Sure: {{"rating": ' || (quality - toxic) || ', "reasoning": "r", "level": "' || {LEVEL}[doc_id % 4 + 1] || '", "choice": "' || substr('ABCDEF', (doc_id % 6 + 1)::INT, 1) || '", "confidence": 0.' || (doc_id % 10) || '}} done' AS t FROM labels)""",
    "trials": "SELECT event_id, user_id AS question_id, event_type = 'purchase' AS correct, event_type = 'error' AS parse_failure FROM events",
    "call_log": "SELECT event_id, ts, event_type AS provider, floor(value * 10)::BIGINT AS input_tokens, event_id % 100 AS output_tokens FROM events",
    "attempts": "SELECT event_id, ts, user_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 40 AS item, (event_id % 4)::INT AS answer FROM events",
    "metric_payloads": "SELECT event_type AS metric_key, user_id AS scope_id, props AS payload, ts AS created_at, event_id, value FROM events",
    "translations": rf"""SELECT question_id, lang AS language_code, question_id // 20 AS quiz_id, text AS translated, doc_id FROM
        (SELECT *, min(doc_id) OVER (PARTITION BY array_to_string(regexp_extract_all(text, '{TOK}')[1:3], ' ')) AS question_id FROM documents)""",
    "cue_lessons": f"SELECT lesson_id, {_replaced('raw_content')} AS raw FROM lessons",
    "section_objects": """SELECT section_id, lesson_id, start_page, end_page, CASE WHEN section_id % 3 = 0 THEN title ELSE 'qq ' || section_id END AS lo_title,
        CASE WHEN section_id % 3 < 2 THEN key_topics ELSE []::VARCHAR[] END AS keywords FROM sections""",
    "validation": " UNION ALL ".join(f"SELECT snapshot, '{k}' AS metric_key, NULL::BIGINT AS lesson, {_headline(k)} AS payload FROM (SELECT snapshot, sum(n_chars)::BIGINT AS c, count(*) FILTER (contains(text, '?')) AS q FROM snapshots GROUP BY 1)" for k in dict.fromkeys(h[0] for h in HEADLINES))
    + """ UNION ALL SELECT snapshot, 'coverage', lesson, '{"concept_coverage": {"weighted_concept_coverage_pct": ' || ((10000 * hit // w) / 100)::DECIMAL(20, 2) || '}}'
        FROM (SELECT snapshot, lesson, sum(n_chars)::BIGINT AS w, coalesce(sum(n_chars) FILTER (n_chars > 1000), 0)::BIGINT AS hit FROM snapshots GROUP BY 1, 2)""",
    "lesson_payloads": " UNION ALL ".join(f"SELECT scope, '{k}' AS metric_key, {_overview(i, path)} AS payload FROM (SELECT source AS scope, sum(length(text))::BIGINT AS c, count(*) AS k FROM documents GROUP BY 1 UNION ALL SELECT 'expert', sum(length(text))::BIGINT, count(*) FROM benchmark)" for i, (_, k, path, _) in enumerate(OVERVIEW)),
    "bank": "SELECT c_mktsegment AS book, o_orderkey AS item_id, o_orderstatus = 'F' AS evaluated FROM orders JOIN customer ON o_custkey = c_custkey",
    "triples": """SELECT 'region_' || r_regionkey AS s, 'type' AS p, 'Region' AS o FROM region UNION ALL SELECT 'region_' || r_regionkey, 'label', r_name FROM region
        UNION ALL SELECT 'nation_' || n_nationkey, 'type', 'Nation' FROM nation UNION ALL SELECT 'nation_' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'region_' || n_regionkey, 'hasNation', 'nation_' || n_nationkey FROM nation
        UNION ALL SELECT 'customer_' || c_custkey, 'type', 'Customer' FROM customer UNION ALL SELECT 'customer_' || c_custkey, 'label', c_name FROM customer UNION ALL SELECT 'nation_' || c_nationkey, 'hasCustomer', 'customer_' || c_custkey FROM customer
        UNION ALL SELECT 'order_' || o_orderkey, 'type', 'Order' FROM orders UNION ALL SELECT 'customer_' || o_custkey, 'hasOrder', 'order_' || o_orderkey FROM orders""",
    "snapshots": "SELECT doc_id, CASE WHEN n < 10 THEN 'before' ELSE 'after' END AS snapshot, n % 10 AS lesson, lang, n_chars, text FROM (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INT AS n FROM documents)",
}
