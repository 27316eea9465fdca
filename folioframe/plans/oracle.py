"""DuckDB SQL of the registered queries: each is a SELECT over shared common table expressions."""

from __future__ import annotations

WS = r"[ \t\n\x0B\f\r]"
TRIM = rf"regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')"

CTE = {
    "raw_lines": "SELECT doc_id, lang, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS ln FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)",
    "lines": """SELECT doc_id, page_index, line_index, ln, text, x0, y0, x0 + least(CASE WHEN doc_id % 4 = 0 THEN 400 ELSE 880 END, 8 * strlen(text)) AS x1, y0 + h AS y1,
        CASE WHEN doc_id % 10 = 3 THEN 'ocr' ELSE 'pdf_text_layer' END AS source, 1 - (line_index % 10) / 100 AS confidence
      FROM (SELECT doc_id, ln, (ln // 12)::INTEGER AS page_index, (ln % 12)::INTEGER AS line_index, (40 + (doc_id + ln % 12) % 9)::DOUBLE AS h, (20 + 116 * (ln % 12))::DOUBLE AS y0,
          (CASE WHEN doc_id % 4 = 0 THEN 60 + 440 * (ln % 12 % 2) ELSE 60 END)::DOUBLE AS x0,
          CASE WHEN doc_id % 5 = 0 AND ln % 12 = 0 THEN lang || ' report ' || doc_id WHEN doc_id % 5 = 0 AND ln % 12 = 11 THEN 'Page ' || (ln // 12 + 1)
               WHEN doc_id % 7 = 2 AND ln % 12 = 5 THEN '- ' || t ELSE t END AS text
        FROM raw_lines)""",
    "spans": """SELECT doc_id, page_index, line_index, (n)::INTEGER AS span_index, text, lx + 8 * before + CASE WHEN ln % 7 = 3 THEN 120 ELSE 0 END * n AS x0, y0,
        lx + 8 * before + CASE WHEN ln % 7 = 3 THEN 120 ELSE 0 END * n + 8 * strlen(text) AS x1, y1, source, confidence
      FROM (SELECT *, coalesce(sum(strlen(text) + 1) OVER w, 0)::BIGINT AS before, count(*) OVER w AS n
        FROM (SELECT doc_id, page_index, line_index, ln, x0 AS lx, y0, y1, source, confidence, unnest(w) AS text, generate_subscripts(w, 1) AS pos FROM (SELECT *, string_split(text, ' ') AS w FROM lines))
        WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page_index, line_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "gapped": """SELECT doc_id, page_index, line_index FROM (
        SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page_index, line_index ORDER BY x0, span_index) > greatest(16.0, 1.8 * (y1 - y0)) AS wide FROM spans)
      GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (wide) >= 2""",
    "real_lines": f"SELECT * FROM lines WHERE {TRIM.format('text')} <> '' AND x1 > x0 AND y1 > y0",
    "page_heights": "SELECT doc_id, page_index, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS mh FROM real_lines GROUP BY ALL",
    "typed0": f"""SELECT *, CASE WHEN edge IS NOT NULL THEN edge WHEN g OR contains(text, '...') OR contains(text, ' . . ') THEN 'table'
        WHEN regexp_matches({TRIM.format('text')}, '^([-*+]{WS}|[0-9]+[.)]{WS})') THEN 'list'
        WHEN coalesce(max(CASE WHEN edge IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
          AND strlen(text) <= 120 AND y1 - y0 >= 1.05 * mh THEN 'title' ELSE 'text' END AS type
      FROM (SELECT l.*, mh, CASE WHEN y0 / 1400 < 0.08 THEN 'header' WHEN y1 / 1400 > 0.92 THEN 'footer' END AS edge,
          EXISTS (SELECT 1 FROM gapped g WHERE g.doc_id = l.doc_id AND g.page_index = l.page_index AND g.line_index = l.line_index) AS g
        FROM real_lines l JOIN page_heights USING (doc_id, page_index))""",
    "typed": """SELECT doc_id, page_index, line_index, ln, text, x0, y0, x1, y1, source, confidence, type, (sum(fresh) OVER (PARTITION BY doc_id, page_index ORDER BY line_index) - 1)::INTEGER AS block_index
      FROM (SELECT *, CASE WHEN type = lag(type) OVER w AND type NOT IN ('title', 'header', 'footer') AND y0 - lag(y1) OVER w BETWEEN 0 AND 1.8 * greatest(1, lag(y1 - y0) OVER w)
            AND abs(x0 - lag(x0) OVER w) <= 4 * greatest(1, lag(y1 - y0) OVER w) THEN 0 ELSE 1 END AS fresh
        FROM typed0 WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_index))""",
    "blocks": """SELECT *, CASE WHEN type = 'title' THEN 0.7 WHEN type IN ('header', 'footer') THEN 0.65 WHEN type IN ('table', 'list') THEN 0.6 WHEN n_lines > 1 THEN 0.75 ELSE 0.68 END::DOUBLE AS confidence
      FROM (SELECT doc_id, page_index, block_index, min(type) AS type, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY line_index) AS text,
          CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS source FROM typed GROUP BY doc_id, page_index, block_index)""",
    "signed": f"""SELECT *, {TRIM.format("regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'), '" + WS + "+', ' ', 'g')")} AS signature FROM blocks""",
    "furniture": "SELECT doc_id, type, signature, count(DISTINCT page_index) AS pages FROM signed WHERE type IN ('header', 'footer') AND signature <> '' GROUP BY ALL HAVING count(DISTINCT page_index) >= 2",
    "assembled": """SELECT doc_id, n - 1 AS global_order, 'doc_page_' || (page_index + 1) || '_block_' || n AS id, 'page_' || (page_index + 1) AS page_id, page_index, block_index,
        CASE type WHEN 'text' THEN 'paragraph' ELSE type END AS type, text, x0, y0, x1, y1, confidence, source
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_index) AS n FROM signed s
        WHERE NOT EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = s.doc_id AND f.type = s.type AND f.signature = s.signature))""",
    "markdown": """SELECT doc_id, string_agg(CASE type WHEN 'title' THEN '## ' || text || chr(10) || chr(10) WHEN 'list' THEN '- ' || text || chr(10) ELSE text || chr(10) || chr(10) END, '' ORDER BY global_order) AS markdown
      FROM assembled WHERE type NOT IN ('header', 'footer') AND text <> '' GROUP BY doc_id""",
    "html_docs": """SELECT doc_id, string_agg('<' || tag || '>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || tag || '>' || chr(10), '' ORDER BY global_order) AS html
      FROM (SELECT *, CASE type WHEN 'title' THEN 'h2' ELSE 'p' END AS tag FROM assembled WHERE text <> '') GROUP BY doc_id""",
    "leader_words": rf"SELECT *, regexp_replace({TRIM.format('text')}, '[._ -]', '', 'g') AS rest, {TRIM.format('text')} AS bare FROM spans",
    "good_spans": "SELECT doc_id, page_index, line_index, span_index, text, x0, x1, confidence FROM leader_words WHERE bare <> '' AND NOT (strlen(bare) >= 3 AND strlen(bare) - strlen(rest) >= 0.75 * strlen(bare))",
    "cut_spans": """SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_index, block_index, row_index ORDER BY x0, span_index) AS column_index FROM (
        SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page_index, block_index, row_index ORDER BY x0, span_index) > greatest(24.0, 2 * h) THEN 1 ELSE 0 END AS cut FROM (
          SELECT r.doc_id, r.page_index, r.block_index, r.row_index, r.line_text, r.h, r.line_confidence, s.span_index, s.text, s.x0, s.x1, s.confidence FROM (
            SELECT doc_id, page_index, block_index, line_index, row_number() OVER (PARTITION BY doc_id, page_index, block_index ORDER BY line_index) - 1 AS row_index, text AS line_text, confidence AS line_confidence, y1 - y0 AS h
            FROM typed WHERE type = 'table') r LEFT JOIN good_spans s USING (doc_id, page_index, line_index)))""",
    "cells": rf"""SELECT doc_id, page_index, block_index, row_index, column_index::BIGINT AS column_index,
        CASE WHEN count(text) = 0 THEN {TRIM.format('first(line_text)')} ELSE string_agg(text, ' ' ORDER BY x0, span_index) END AS text, coalesce(avg(confidence), first(line_confidence)) AS confidence
      FROM cut_spans GROUP BY doc_id, page_index, block_index, row_index, column_index""",
    "intervals": "SELECT doc_id, page_index, least(greatest(y0, 0.0), 1400.0) AS a, least(greatest(y1, 0.0), 1400.0) AS b FROM lines",
    "coverage": """SELECT doc_id, page_index, sum(n) / 1400 AS coverage FROM (SELECT doc_id, page_index, isle, max(b) - min(a) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_index ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM (
          SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, page_index ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM intervals WHERE b > a)) GROUP BY ALL) GROUP BY ALL""",
    "run_events": """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
        CASE event_type WHEN 'signup' THEN 'job_started' WHEN 'view' THEN 'stage_started' WHEN 'click' THEN 'stage_progress' WHEN 'purchase' THEN 'job_succeeded' WHEN 'error' THEN 'stage_failed' END AS type,
        CASE WHEN event_type IN ('view', 'error', 'click') THEN event_type END AS stage, CASE WHEN event_type = 'error' THEN props END AS error,
        CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS attempt FROM events""",
}
ORDER = list(CTE)


def sql(select: str) -> str:
    """The select with the expressions that it needs, directly or not."""
    import re

    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(CTE[name])
    names = [n for n in ORDER if n in needed]
    return (f"WITH {', '.join(f'{n} AS ({CTE[n]})' for n in names)} " if names else "") + select
