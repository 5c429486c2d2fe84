"""The registered queries as SQL for DuckDB, from shared subqueries."""

from __future__ import annotations

import re

from docspark.functions.text import STOPWORDS
from docspark.operators.context import HEADERS, ORDERS, TRUNCATED
from docspark.sources.synthetic import JUDGE_REPLY, SKETCH_REPLY


def _q(text: str) -> str:
    """A text as an SQL literal."""
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ")" if "\n" in text else "'" + text.replace("'", "''") + "'"


def _filled(template: str) -> str:
    """SQL of a reply's template, filled in from each document."""
    n, text = "length(coalesce(text, ''))", "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"
    value = {"text": text, "section": f"{n} % 7", "figure": f"{n} % 13", "table": f"{n} % 11"}
    for k in range(1, 8):
        value[f"number{k}"] = f"concat(({n} + {k} * doc_id) % 5, '.', ['0', '25', '5', '75'][(doc_id + {k}) % 4 + 1])"
        value[f"word{k}"] = f"string_split({text}, ' ')[({n} * {k}) % len(string_split({text}, ' ')) + 1]"
    return "concat(" + ", ".join(value[x[1:-1]] if x[:1] == "<" else _q(x) for x in re.split("(<[a-z0-9]+>)", template) if x) + ")"


BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
TOKENS = "greatest(1, len(regexp_extract_all({0}, '\\S+')) * 13 // 10)::BIGINT"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
NORMAL = "list_filter(list_transform(regexp_extract_all({0}, '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + STOP + ", x))"
SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+([A-Z\"‘’“”])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)), "
    "lambda x: trim(x, " + BLANK + ")), lambda x: x <> '')"
)
CAPTION = "(?i)^(Figure|Fig\\.|Table)\\s*\\d+"


def _pack(sizes: str, most: int, overlap: int) -> str:
    """Ranges [begin, end) of sentences: the state is the current range's begin and tokens, and the ranges done."""
    back = f"list_reduce(list_reverse(range(s.b, i)), lambda r, j: CASE WHEN r.go AND r.n + {sizes}[j + 1] <= {overlap} THEN {{'b': j, 'n': r.n + {sizes}[j + 1], 'go': true}} ELSE {{'b': r.b, 'n': r.n, 'go': false}} END, {{'b': i, 'n': 0::BIGINT, 'go': true}})"
    return (
        f"list_reduce(range(len({sizes})), lambda s, i: CASE WHEN i > s.b AND s.n + {sizes}[i + 1] > {most} "
        f"THEN {{'b': ({back}).b, 'n': ({back}).n + {sizes}[i + 1], 'o': list_append(s.o, [s.b, i])}} "
        f"ELSE {{'b': s.b, 'n': s.n + {sizes}[i + 1], 'o': s.o}} END, {{'b': 0::BIGINT, 'n': 0::BIGINT, 'o': []::BIGINT[][]}})"
    )


CTES = {
    "lines": f"""SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line, {BLANK}) <> ''""",
    "synth0": """SELECT doc_id, i, line, (doc_id * 31 + i * 17) % 20 AS h, i // 12 AS page, (doc_id + i // 3) % 2 AS c, (60 + ((i % 12) // 2) * 110)::DOUBLE AS base FROM lines""",
    "synth": """SELECT doc_id, i AS block_ord, page, h,
      CASE WHEN h IN (2, 3, 8) OR c = 0 THEN 54.0 ELSE 318.0 END::DOUBLE AS x0,
      CASE h WHEN 0 THEN 10.0 WHEN 1 THEN 760.0 ELSE base END::DOUBLE AS y0,
      CASE WHEN h IN (2, 3, 8) THEN 558.0 WHEN c = 0 THEN 294.0 ELSE 558.0 END::DOUBLE AS x1,
      CASE h WHEN 0 THEN 30.0 WHEN 1 THEN 780.0 WHEN 8 THEN base + 130 ELSE base + 40 END::DOUBLE AS y1,
      CASE h WHEN 2 THEN 18.0 WHEN 3 THEN 14.0 WHEN 4 THEN 11.5 WHEN 7 THEN 7.0 ELSE 10.0 END::DOUBLE AS size,
      h IN (2, 3, 4, 9) AS bold,
      CASE h WHEN 5 THEN concat('Figure ', i + 1, ': ', line) WHEN 6 THEN concat('Table ', i + 1, ': ', line) WHEN 9 THEN 'ABSTRACT' ELSE line END AS text,
      sha256(doc_id::VARCHAR) AS sha FROM synth0""",
    "ids": """SELECT *, substr(sha256(concat(sha, ':', page, ':', x0::BIGINT, '.0:', y0::BIGINT, '.0:', x1::BIGINT, '.0:', y1::BIGINT, '.0')), 1, 12) AS block_id FROM synth""",
    "medians": "SELECT *, coalesce(median(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY doc_id, page), 10.0::DOUBLE) AS median_size FROM ids",
    "classified": f"""SELECT *, CASE WHEN y1 < 792.0::DOUBLE * 0.06::DOUBLE OR y0 > 792.0::DOUBLE * 0.94::DOUBLE THEN 'header_footer'
      WHEN median_size > 0 AND ((size >= median_size * 1.1::DOUBLE AND bold) OR size >= median_size * 1.4::DOUBLE) THEN 'heading'
      WHEN bold AND regexp_matches(text, '^\\p{{L}}+$') AND text = upper(text) THEN 'heading'
      WHEN regexp_matches(text, '{CAPTION}') THEN 'caption'
      WHEN median_size > 0 AND size < median_size * 0.85::DOUBLE AND NOT bold THEN 'other' ELSE 'body' END AS block_type FROM medians""",
    "sided": "SELECT *, CASE WHEN (x1 - x0) / 612.0::DOUBLE >= 0.6::DOUBLE THEN 2 WHEN (x0 + x1) / 2 <= 306 THEN 0 ELSE 1 END AS col FROM classified",
    "bars": "SELECT doc_id, page, block_ord, y0, y1, row_number() OVER w - 1 AS zone, coalesce(lag(y1) OVER w, -1.0) AS over, lead(y0) OVER w AS nxt FROM sided WHERE col = 2 WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_ord)",
    "tails": "SELECT doc_id, page, count(*) AS n, max_by(y1, zone) AS bottom FROM bars GROUP BY ALL",
    "zoned": """SELECT s.*, CASE WHEN s.col = 2 THEN b.zone ELSE coalesce(z.zone, CASE WHEN s.y0 >= coalesce(t.bottom, -1.0) THEN coalesce(t.n, 0) END) END AS zone
      FROM sided s LEFT JOIN bars b ON s.col = 2 AND s.doc_id = b.doc_id AND s.page = b.page AND s.block_ord = b.block_ord
      LEFT JOIN (SELECT s.doc_id, s.block_ord, min(b.zone) AS zone FROM sided s JOIN bars b USING (doc_id, page) WHERE s.col <> 2 AND b.over < s.y0 AND s.y0 < b.y0 GROUP BY ALL) z
        ON s.doc_id = z.doc_id AND s.block_ord = z.block_ord
      LEFT JOIN tails t ON s.doc_id = t.doc_id AND s.page = t.page""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, zone, col, y0, block_ord) - 1 AS pos FROM zoned WHERE zone IS NOT NULL",
    "heads": f"""SELECT doc_id, row_number() OVER w - 1 AS section_ord, trim(text, {BLANK}) AS title, size, page AS page_start, coalesce(lead(page) OVER w, last_page) AS page_end
      FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last_page FROM ordered) WHERE block_type = 'heading' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "headed": "SELECT doc_id, list({'t': title, 's': size, 'a': page_start, 'b': page_end} ORDER BY section_ord) AS h FROM heads GROUP BY doc_id",
    "canon": """SELECT doc_id, section_ord, size, list_reduce(list_sort(list_distinct(p), 'DESC'), lambda a, s: CASE WHEN len(a) = 0 OR s < a[len(a)] * 0.95::DOUBLE THEN list_append(a, s) ELSE a END, []::DOUBLE[]) AS kept
      FROM (SELECT doc_id, section_ord, size, coalesce(list(size) OVER (PARTITION BY doc_id ORDER BY section_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []::DOUBLE[]) AS p FROM heads)""",
    "levels": "SELECT doc_id, section_ord, size, coalesce(nullif(list_position(list_transform(kept, lambda k: size >= k * 0.95::DOUBLE), true), 0), len(kept) + 1)::BIGINT AS level FROM canon",
    "secs": "SELECT h.*, l.level, concat('s', h.section_ord + 1) AS section_id FROM heads h JOIN levels l USING (doc_id, section_ord)",
    "paths": """SELECT doc_id, section_ord, section_id, title, level, page_start, page_end, size, list_reduce(coalesce(list_reverse(b), []), lambda a, s: CASE WHEN a.n > 0 AND s.l = a.n THEN {'n': a.n - 1, 'p': list_prepend(s.t, a.p)} ELSE a END, {'n': level - 1, 'p': [title]}).p AS path
      FROM (SELECT *, list({'l': level, 't': title}) OVER (PARTITION BY doc_id ORDER BY section_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM secs)""",
    "tblocks": """SELECT * FROM (SELECT *, CASE WHEN n > 0 THEN concat('s', n) ELSE '' END AS section_id FROM (SELECT *, count(*) FILTER (block_type = 'heading') OVER (PARTITION BY doc_id ORDER BY pos) AS n
      FROM ordered WHERE block_type NOT IN ('header_footer', 'other', 'image'))) WHERE block_type <> 'heading'""",
    "titles": f"""SELECT doc_id, coalesce(trim(arg_max(text, (size, -block_ord)) FILTER (block_type = 'heading'), {BLANK}),
      substr(trim(string_split(arg_min(text, block_ord) FILTER (block_type = 'body'), chr(10))[1], {BLANK}), 1, 200)) AS title FROM classified WHERE page = 0 GROUP BY doc_id""",
    "rasters": """SELECT doc_id, page, r.o AS rect_ord, r.x0, r.y0, r.x1, r.y1 FROM (SELECT doc_id, page, unnest(CASE
        WHEN h = 5 AND block_ord % 4 = 0 THEN [{'o': block_ord * 10, 'x0': x0, 'y0': ry, 'x1': x1, 'y1': ry + 50}, {'o': block_ord * 10 + 1, 'x0': x0, 'y0': ry - 5, 'x1': x1, 'y1': ry + 45}]
        WHEN h IN (5, 6) THEN [{'o': block_ord * 10, 'x0': x0, 'y0': ry, 'x1': x1, 'y1': ry + 50}]
        WHEN h = 10 THEN [{'o': block_ord * 10, 'x0': x0, 'y0': y0, 'x1': x0 + 10, 'y1': y0 + 10}]
        WHEN h = 12 THEN [{'o': block_ord * 10, 'x0': x0, 'y0': y0, 'x1': x0 + 60, 'y1': y0 + 50}] ELSE [] END) AS r
      FROM (SELECT *, CASE WHEN (doc_id + block_ord) % 3 = 0 THEN y1 + 6 ELSE y0 - 58 END AS ry FROM synth))""",
    "bigr": "SELECT * FROM rasters WHERE (x1 - x0) * (y1 - y0) >= 2500",
    "drawn": "SELECT doc_id, page, block_ord * 10 + k AS rect_ord, x0 + [0, 42, 84, 132][k + 1] AS x0, y0, x0 + [0, 42, 84, 132][k + 1] + 30 AS x1, y0 + 40 AS y1 FROM synth, range(4) t(k) WHERE h = 11",
    # of each chain the first three meet at a margin of 15; the fourth stays alone and is too small
    "merged": "SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_ord) - 1 AS rect_ord, x0, y0, x0 + 114 AS x1, y0 + 40 AS y1 FROM synth WHERE h = 11",
    "vector": """SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM bigr b WHERE b.doc_id = m.doc_id AND b.page = m.page
      AND greatest(0, least(m.x1, b.x1) - greatest(m.x0, b.x0)) * greatest(0, least(m.y1, b.y1) - greatest(m.y0, b.y0)) > 0)""",
    "regs": """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k, rect_ord) - 1 AS region_ord, x0, y0, x1, y1
      FROM (SELECT doc_id, page, rect_ord, x0, y0, x1, y1, 0 AS k FROM bigr UNION ALL SELECT doc_id, page, rect_ord, x0, y0, x1, y1, 1 FROM vector)""",
    "caps": "SELECT doc_id, page, block_ord, x0, y0, x1, y1, text, sha FROM classified WHERE block_type = 'caption'",
    "region_lists": "SELECT doc_id, page, list({'o': region_ord::BIGINT, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY region_ord) AS r FROM regs GROUP BY ALL",
    "raster_lists": "SELECT doc_id, page, list({'o': rect_ord::BIGINT, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY rect_ord) AS r FROM bigr GROUP BY ALL",
    "cap_lists": "SELECT doc_id, page, list({'o': block_ord::BIGINT, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY block_ord) AS c FROM caps GROUP BY ALL",
}


def _greedy(lists: str) -> str:
    """Each region in turn takes the nearest free caption: the state is the list of (region, caption) pairs."""
    below, above = "(q.y0 - g.y1)", "(g.y0 - q.y1)"
    dist = f"CASE WHEN least(g.x1, q.x1) - greatest(g.x0, q.x0) < -50 THEN NULL WHEN {below} BETWEEN 0 AND 80 THEN {below} WHEN {above} BETWEEN 0 AND 80 THEN {above} + 80 END"
    best = f"list_min(list_filter(list_transform(list_filter(l.c, lambda q: NOT list_contains(list_transform(a, lambda p: p[2]), q.o)), lambda q: {{'d': {dist}, 'o': q.o}}), lambda x: x.d IS NOT NULL))"
    return (
        f"SELECT doc_id, page, m[1] AS region_ord, m[2] AS caption_ord FROM (SELECT doc_id, page, unnest(list_reduce(l.r, lambda a, g: CASE WHEN ({best}) IS NULL THEN a ELSE list_append(a, [g.o, ({best}).o]) END, []::BIGINT[][])) AS m "
        f"FROM (SELECT * FROM {lists} JOIN cap_lists USING (doc_id, page)) l)"
    )


CTES |= {
    "matched": _greedy("region_lists"),
    "matched_rasters": _greedy("raster_lists"),
    "figs": f"""SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page, m.region_ord) - 1 AS region_ord, m.page, CASE WHEN regexp_matches(cap, '(?i)^Table\\s*\\d+') THEN 'table' ELSE 'figure' END AS kind,
      label, cap AS caption, m.caption_ord, r.x0, r.y0, r.x1, r.y1, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1,
      concat('http://host/static/', sha, '/fig_', trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), '_p', m.page, '_', m.region_ord, '.png') AS crop_url
      FROM matched m JOIN regs r USING (doc_id, page, region_ord) JOIN (SELECT *, trim(text, {BLANK}) AS cap, regexp_extract(trim(text, {BLANK}), '{CAPTION}', 0) AS label FROM caps) c
      ON c.doc_id = m.doc_id AND c.page = m.page AND c.block_ord = m.caption_ord""",
    "capblocks": """SELECT DISTINCT t.doc_id, t.block_ord FROM tblocks t JOIN figs f ON f.doc_id = t.doc_id AND f.page = t.page
      AND abs(t.x0 - f.cx0) < 2 AND abs(t.y0 - f.cy0) < 2 AND abs(t.x1 - f.cx1) < 2 AND abs(t.y1 - f.cy1) < 2""",
    # pieces of lines: five lines a section
    "line_in": """SELECT doc_id, i AS pos, substr(sha256(concat(doc_id, ':', i)), 1, 12) AS block_id, line AS text, concat('s', i // 5) AS section_id, i // 12 AS page, false AS is_caption FROM lines""",
    "corpus_in": """SELECT t.doc_id, t.pos, t.block_id, t.text, t.section_id, t.page, c.block_ord IS NOT NULL AS is_caption FROM tblocks t LEFT JOIN capblocks c USING (doc_id, block_ord)""",
}


def _pieces(source: str) -> str:
    tok = TOKENS.format("text")
    sub = f"""SELECT doc_id, pos, block_id, section_id, page, is_caption, unnest(range(len(o))) AS sub_idx, list_aggregate(list_slice(ss, unnest(o)[1] + 1, unnest(o)[2]), 'string_agg', ' ') AS text
      FROM (SELECT *, CASE WHEN len(sz) = 0 THEN [] ELSE list_append(st.o, [st.b, len(sz)]) END AS o FROM (SELECT *, {_pack('sz', 64, 16)} AS st
      FROM (SELECT *, list_transform(ss, lambda x: {TOKENS.format('x')}) AS sz FROM (SELECT *, {SENTENCES.format('text')} AS ss FROM {source} WHERE NOT is_caption AND {tok} > 64))))"""
    return f"SELECT *, {tok} AS tok FROM (SELECT doc_id, pos, block_id, section_id, page, is_caption, 0 AS sub_idx, text FROM {source} WHERE is_caption OR {tok} <= 64 UNION ALL {sub})"


def _chunks(source: str, most: int) -> str:
    fold = f"""list_reduce(p, lambda s, x: CASE WHEN s.o AND NOT x.cap AND x.sec = s.s AND s.n + x.tok <= {most} THEN {{'k': s.k, 'n': s.n + x.tok, 's': s.s, 'o': true, 'l': list_append(s.l, s.k)}}
      ELSE {{'k': s.k + 1, 'n': x.tok, 's': x.sec, 'o': NOT x.cap, 'l': list_append(s.l, s.k + 1)}} END, {{'k': -1::BIGINT, 'n': 0::BIGINT, 's': '?', 'o': false, 'l': []::BIGINT[]}}).l"""
    return f"""SELECT doc_id, chunk_ord, substr(sha256(concat(b, ':', sub)), 1, 12) AS chunk_id, section_id, page, chunk_type, blocks, text, {TOKENS.format('text')} AS token_count FROM (
      SELECT doc_id, k AS chunk_ord, arg_min(q.id, (q.pos, q.sub)) AS b, arg_min(q.sub, (q.pos, q.sub)) AS sub, arg_min(q.sec, (q.pos, q.sub)) AS section_id, arg_min(q.page, (q.pos, q.sub)) AS page,
        CASE WHEN any_value(q.cap) THEN 'caption' ELSE 'body' END AS chunk_type, list(q.id ORDER BY q.pos, q.sub) AS blocks, string_agg(q.txt, ' ' ORDER BY q.pos, q.sub) AS text
      FROM (SELECT doc_id, unnest({fold}) AS k, unnest(p) AS q FROM (SELECT doc_id, list({{'pos': pos, 'sub': sub_idx, 'id': block_id, 'sec': section_id, 'page': page, 'cap': is_caption, 'tok': tok, 'txt': text}} ORDER BY pos, sub_idx) AS p FROM {source} GROUP BY doc_id))
      GROUP BY doc_id, k)"""


CTES |= {
    "line_pieces": _pieces("line_in"),
    "line_chunks": _chunks("line_pieces", 128),
    "corpus_pieces": _pieces("corpus_in"),
    "corpus_raw": _chunks("corpus_pieces", 64),
    "corpus_chunks": "SELECT c.*, coalesce(p.path, []::VARCHAR[]) AS path FROM corpus_raw c LEFT JOIN paths p USING (doc_id, section_id)",
    "keyed": f"SELECT doc_id, chunk_ord, unnest(range(len(w))) AS word_at, unnest(w) AS keyword FROM (SELECT doc_id, chunk_ord, {NORMAL.format('text')} AS w FROM line_chunks)",
    "keywords": """SELECT doc_id, rank, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank
      FROM (SELECT doc_id, keyword, count(*) AS n, min((chunk_ord, word_at)) AS f FROM keyed GROUP BY ALL)) WHERE rank <= 20""",
    "results": f"""SELECT doc_id, unnest([0, 1, 2, 3]) AS input_ord, unnest(['gemini:weak', 'openai:strong', 'deepseek:long', 'openai:bad']) AS model, unnest(['OK', 'OK', 'OK', 'ERROR']) AS status,
      unnest([text, concat({", chr(10), ".join(f"'{h}', chr(10), '- ', coalesce(array_to_string([x FOR x, i IN string_split(text, chr(10)) IF (i - 1) % {len(HEADERS)} = {k}], concat(chr(10), '- ')), '')" for k, h in enumerate(HEADERS))}), concat('## Limitations', chr(10), text, chr(10), text), NULL]) AS text FROM documents""",
    "urls": "SELECT doc_id, [w[len(w) // 2 + 1], 'http://none'] AS u FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE doc_id % 3 <> 0",
    "raw_scores": f"""SELECT r.doc_id, input_ord, model, status,
      CASE WHEN status <> 'OK' OR trim(text, {BLANK}) = '' THEN 0.0 ELSE ({" + ".join(f"(contains(text, '{h}'))::INT" for h in HEADERS)}) / 6.0::DOUBLE END::DOUBLE AS s,
      CASE WHEN status <> 'OK' OR trim(text, {BLANK}) = '' OR k.k IS NULL THEN 0.0 ELSE len(list_intersect(k.k, {NORMAL.format('text')})) / len(k.k)::DOUBLE END::DOUBLE AS c,
      CASE WHEN status <> 'OK' THEN 0.0::DOUBLE ELSE {{LENGTH}} END AS l,
      CASE WHEN status <> 'OK' THEN 0.0 WHEN u.u IS NULL OR len(list_filter(u.u, lambda x: x <> '')) = 0 THEN 1.0
        ELSE least(1.0::DOUBLE, len(list_filter(u.u, lambda x: x <> '' AND contains(r.text, x))) / least(len(list_filter(u.u, lambda x: x <> '')), 3)::DOUBLE) END::DOUBLE AS f
      FROM results r LEFT JOIN (SELECT doc_id, list(keyword) AS k FROM keywords GROUP BY doc_id) k USING (doc_id) LEFT JOIN urls u USING (doc_id)""",
    "scored": """SELECT doc_id, input_ord, model, status, round_even(s, 3) AS structure_score, round_even(c, 3) AS coverage_score, round_even(l, 3) AS length_score, round_even(f, 3) AS figure_score,
      round_even(((s * 0.35::DOUBLE + c * 0.40::DOUBLE + l * 0.15::DOUBLE + f * 0.10::DOUBLE) * 100)::DECIMAL(30, 15), 1)::DOUBLE AS overall_score FROM raw_scores""",
    "ranked": "SELECT doc_id, model, overall_score, row_number() OVER (PARTITION BY doc_id ORDER BY overall_score DESC, input_ord) AS rank FROM scored WHERE status = 'OK'",
    "judge_json": f"SELECT doc_id, {_filled(JUDGE_REPLY)} AS j FROM documents WHERE doc_id % 7 <> 0",
    "judged": """SELECT doc_id, i AS item_ord, trim(m) AS model, coalesce(f::DOUBLE, 0) AS factuality, coalesce(c::DOUBLE, 0) AS coverage, coalesce(cl::DOUBLE, 0) AS clarity, coalesce(u::DOUBLE, 0) AS usefulness,
      round_even(coalesce(o::DOUBLE, 0) * 20, 1) AS overall_score, trim(coalesce(r, '')) AS reason, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord
      FROM (SELECT doc_id, i, x->>'model' AS m, x->>'factuality' AS f, x->>'coverage' AS c, x->>'clarity' AS cl, x->>'usefulness' AS u, x->>'overall' AS o, x->>'reason' AS r
        FROM (SELECT doc_id, i, json_extract(j, '$.scores[' || i || ']') AS x FROM judge_json, range(5) t(i))) WHERE trim(m) <> ''""",
    "judge_ranked": "SELECT doc_id, model, overall_score, reason, row_number() OVER (PARTITION BY doc_id ORDER BY overall_score DESC, ord) AS rank FROM judged",
    "replies": """SELECT doc_id, concat('intro', chr(10), '## One-Liner', chr(10), '- ', replace(text, chr(10), ' '), chr(10), 'more', chr(10), '## Problem & Method', chr(10), '- ', replace(text, chr(10), ' '),
      ' [chunk_id: ', substr(sha256(concat('a', doc_id)), 1, 12), '] [CHUNK_ID: 00112233aabb].', chr(10), '- ', chr(10), '* no bullet', chr(10), '- [chunk_id: aaaabbbbcccc]', chr(10), '## Unknown', chr(10), '- x', chr(10), '## Limitations', chr(10), '- first', chr(10),
      '## Experiments and Results', chr(10), '  - ', array_to_string(list_reverse(regexp_extract_all(replace(text, chr(10), ' '), '(?s).')), ''), ', ', chr(10), '## limitations', chr(10), '- last [chunk_id:  ', substr(sha256(concat('b', doc_id)), 1, 12), '] ;', chr(10)) AS text FROM documents""",
    "reply_lines": """SELECT *, count(*) FILTER (starts_with(line, '## ')) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM replies))""",
    "reply_keys": f"""SELECT doc_id, part, CASE lower(trim(substr(line, 4), {BLANK})) WHEN 'one-liner' THEN 'one_liner' WHEN 'one liner' THEN 'one_liner' WHEN 'problem & method' THEN 'problem_method' WHEN 'problem and method' THEN 'problem_method'
      WHEN 'experiments & results' THEN 'experiments' WHEN 'experiments and results' THEN 'experiments' WHEN 'limitations' THEN 'limitations' END AS key FROM reply_lines WHERE starts_with(line, '## ')""",
    "reply_parts": "SELECT l.doc_id, l.n, l.line, k.key FROM reply_lines l JOIN (SELECT doc_id, key, max(part) AS part FROM reply_keys WHERE key IS NOT NULL GROUP BY ALL) k USING (doc_id, part) WHERE NOT starts_with(l.line, '## ')",
    "turns": """SELECT conv_id, turn, text, reference FROM (SELECT *, lag(text) OVER w AS reference, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'""",
    "words2": f"SELECT * FROM (SELECT conv_id, turn, {NORMAL.format('coalesce(text, {E})')} AS a, {NORMAL.format('coalesce(reference, {E})')} AS b FROM turns) WHERE len(a) > 0 AND len(b) > 0".replace("{E}", "''"),
    "grams": """SELECT conv_id, turn, a, b, CASE WHEN len(a) < 2 THEN [] ELSE list_transform(range(1, len(a)), lambda i: concat(a[i], ' ', a[i + 1])) END AS a2,
      CASE WHEN len(b) < 2 THEN [] ELSE list_transform(range(1, len(b)), lambda i: concat(b[i], ' ', b[i + 1])) END AS b2,
      list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN x = b[j] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]), list_transform(range(len(b) + 1), lambda z: 0::BIGINT))[len(b) + 1] AS lcs FROM words2""",
    "metric_raw": """SELECT conv_id, turn, {F1:same(a, b)|len(a)|len(b)} AS r1, {F1:same(a2, b2)|len(a2)|len(b2)} AS r2, {F1:lcs|len(a)|len(b)} AS rl, {F1:len(list_intersect(list_distinct(a), list_distinct(b)))|len(list_distinct(a))|len(list_distinct(b))} AS tf FROM grams""",
    "metrics": """SELECT conv_id, turn, round_even(r1, 3) AS rouge1_f1, round_even(r2, 3) AS rouge2_f1, round_even(rl, 3) AS rougeL_f1, round_even(tf, 3) AS token_f1, round_even((r1 + r2 + rl + tf) / 4 * 100, 1) AS reference_score FROM metric_raw""",
}
LENGTH = "(CASE WHEN {0} < 300 THEN {0} / 300.0::DOUBLE WHEN {0} <= 3500 THEN 1.0::DOUBLE WHEN {0} >= 7000 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ({0} - 3500)::DOUBLE / 3500.0::DOUBLE END)"
CTES["raw_scores"] = CTES["raw_scores"].replace("{LENGTH}", LENGTH.format(f"length(trim(text, {BLANK}))"))


def _f1(m: re.Match) -> str:
    both, a, b = m[1].split("|")
    both = re.sub(r"same\((\w+), (\w+)\)", r"list_sum(list_transform(list_distinct(list_intersect(\1, \2)), lambda g: least(len(list_filter(\1, lambda x: x = g)), len(list_filter(\2, lambda x: x = g)))))", both)
    p, r = f"(({both})::DOUBLE / {a})", f"(({both})::DOUBLE / {b})"
    return f"(CASE WHEN {a} = 0 OR {b} = 0 OR coalesce({both}, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END)"


CTES["metric_raw"] = re.sub(r"\{F1:([^}]+)\}", _f1, CTES["metric_raw"])


def _context(source: str, piece: str, budget: int, path: str, after: str) -> str:
    """Lines of a context: headers where the path changes, pieces within the budget, one mark at the first that overflows."""
    return f"""SELECT doc_id, chunk_ord, state, CASE WHEN state = 1 THEN piece ELSE {after} END AS line,
        CASE WHEN {path} <> before THEN concat(chr(10), '### ', CASE WHEN len({path}) > 0 THEN array_to_string({path}, ' > ') ELSE 'Preamble' END, chr(10)) END AS header
      FROM (SELECT *, 1 + sum(CASE WHEN total > {budget} THEN 1 ELSE 0 END) OVER w AS state FROM (SELECT *, sum(length(piece)) OVER w AS total, coalesce(lag({path}) OVER w, []::VARCHAR[]) AS before
        FROM (SELECT *, {piece} AS piece FROM {source} WHERE chunk_type <> 'caption') WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_ord)) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_ord)) WHERE state <= 2"""


_MARK = _q(TRUNCATED)
_JOIN = "SELECT doc_id, {0} AS context FROM (SELECT doc_id, array_to_string(flatten(list(CASE WHEN header IS NULL THEN [line] ELSE [header, line] END ORDER BY chunk_ord)), chr(10)) AS t FROM {1} GROUP BY doc_id)"
CTES |= {
    "md2000": _context("line_chunks", "concat(text, chr(10))", 2000, "[section_id]", _MARK),
    "md500": _context("line_chunks", "concat(text, chr(10))", 500, "[section_id]", _MARK),
    "cited2500": _context("line_chunks", "concat('[chunk_id: ', chunk_id, ']', chr(10), text, chr(10))", 2500, "[section_id]", _MARK),
    "short": _JOIN.format(f"trim(t, {BLANK})", "md500"),
    "judge_lines": _context("corpus_chunks", f"concat('[', chunk_id, '] ', replace(trim(text, {BLANK}), chr(10), ' '), chr(10))", 1500, "path", "'... (truncated)'"),
    "sketch_texts": "SELECT doc_id, coalesce(path[len(path)], '') AS title, string_agg(text, ' ' ORDER BY chunk_ord) AS body FROM corpus_chunks WHERE chunk_type <> 'caption' GROUP BY ALL",
    "sketch_entries": f"""SELECT doc_id, 0 AS k, section_ord AS o, entry FROM (SELECT *, sum(length(entry)) OVER (PARTITION BY doc_id ORDER BY section_ord) AS total FROM (
      SELECT s.doc_id, s.section_ord, concat(chr(10), '[Section ', section_id, ': ', s.title, ' (level ', level, ')]', chr(10), trim(substr(coalesce(body, ''), 1, 400), {BLANK}), chr(10)) AS entry
      FROM secs s LEFT JOIN sketch_texts t ON t.doc_id = s.doc_id AND t.title = s.title)) WHERE total <= 3000
      UNION ALL SELECT doc_id, CASE kind WHEN 'figure' THEN 1 ELSE 2 END, region_ord, concat(chr(10), '[', label, '] ', caption, chr(10)) FROM figs""",
    "sketch_json": f"SELECT doc_id, {_filled(SKETCH_REPLY)} AS j FROM documents WHERE doc_id % 7 <> 0",
}

_ORDER = ORDERS.split("{language}")
_SPEC = "[" + ", ".join(_q(x) for x in ("openai:gpt-4o-mini", " Gemini : flash ", "plain", "nowhere:x", "openai:fail", "openai: ", "")) + "]"
#: Query name -> final SELECT; subqueries are put before it as needed.
FINAL = {
    "approx_tokens": f"SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, {TOKENS.format('text')} AS tokens FROM documents",
    "sentence_split": f"SELECT doc_id, unnest(range(len(s)))::BIGINT AS ord, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)",
    "normalize_words": f"SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {NORMAL.format('text')} AS w FROM documents)",
    "label_slug": "SELECT doc_id, i, trim(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM lines",
    "split_by_tokens": f"""SELECT doc_id, unnest(range(len(o)))::BIGINT AS part, list_aggregate(list_slice(ss, unnest(o)[1] + 1, unnest(o)[2]), 'string_agg', ' ') AS text
      FROM (SELECT *, CASE WHEN len(sz) = 0 THEN [] ELSE list_append(st.o, [st.b, len(sz)]) END AS o FROM (SELECT *, {_pack('sz', 48, 16)} AS st
      FROM (SELECT *, list_transform(ss, lambda x: {TOKENS.format('x')}) AS sz FROM (SELECT *, {SENTENCES.format('text')} AS ss FROM documents))))""",
    "chunk_documents": "SELECT doc_id, chunk_ord, chunk_id, section_id, page, token_count, array_to_string(list_reduce(blocks, lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[]), ',') AS blocks, text FROM line_chunks",
    "span_stats": "SELECT doc_id, block_ord, size AS avg_size, bold, text FROM synth",
    "page_median_font": "SELECT doc_id, page, max(median_size) AS median_size, count(*) AS n FROM medians GROUP BY ALL",
    "block_classify": "SELECT doc_id, block_ord, page, median_size, block_type FROM classified",
    "layout_classify": f"""SELECT doc_id, page, CASE WHEN y1 < 792.0::DOUBLE * 0.06::DOUBLE THEN 'header' WHEN y0 > 792.0::DOUBLE * 0.94::DOUBLE THEN 'footer' WHEN regexp_matches(text, '{CAPTION}') THEN 'caption' ELSE 'text' END AS region_type, count(*) AS n FROM synth GROUP BY ALL""",
    "block_ids": "SELECT doc_id, block_ord, block_id FROM ids",
    "html_block_classify": """SELECT page_id, block_ord, tag, CASE WHEN tag = 'p' THEN 'body' WHEN tag IN ('nav', 'footer') THEN 'header_footer' WHEN tag = 'li' THEN 'other' ELSE 'heading' END AS block_type, text
      FROM (SELECT page_id, block_ord, lower(string_split(raw, chr(2))[1]) AS tag, trim(regexp_replace(regexp_replace(substr(raw, instr(raw, chr(2)) + 1), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text
      FROM (SELECT page_id, unnest(range(len(l))) AS block_ord, unnest(l) AS raw FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?i)<(nav|h[1-6]|p|footer|li|title)(?:\\s[^>]*)?>', concat(chr(1), '\\1', chr(2)), 'g'), chr(1)) AS l FROM pages)) WHERE block_ord > 0) WHERE text <> ''""",
    "reading_order_blocks": "SELECT doc_id, page, block_ord, zone, col::BIGINT AS col, pos FROM ordered",
    "heading_levels": "SELECT doc_id, section_ord, size, level FROM secs",
    "section_tree": "SELECT doc_id, section_id, title, level, page_start, page_end FROM secs",
    "section_path": "SELECT doc_id, section_id, array_to_string(path, ' > ') AS path, len(path)::BIGINT AS depth FROM paths",
    "section_text_blocks": "SELECT doc_id, block_ord, section_id, block_type FROM tblocks",
    "title_guess": "SELECT doc_id, title FROM titles",
    "bbox_iou": """SELECT * FROM (SELECT a.doc_id, a.block_ord, b.block_ord AS other, round_even(CASE WHEN u <= 0 THEN 0 ELSE i / u END, 6) AS iou FROM synth a JOIN synth b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_ord < b.block_ord,
      LATERAL (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i) x,
      LATERAL (SELECT (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i AS u) y) WHERE iou > 0""",
    "merge_rects": "SELECT doc_id, page, x0, y0, x1, y1 FROM merged",
    "rect_anti_join": """SELECT doc_id, page, rect_ord FROM drawn m WHERE NOT EXISTS (SELECT 1 FROM bigr b WHERE b.doc_id = m.doc_id AND b.page = m.page
      AND greatest(0, least(m.x1, b.x1) - greatest(m.x0, b.x0)) * greatest(0, least(m.y1, b.y1) - greatest(m.y0, b.y0)) > 0)""",
    "caption_match": "SELECT doc_id, page, region_ord, caption_ord FROM matched_rasters",
    "figures_tables": "SELECT doc_id, region_ord, page, kind, label, caption, caption_ord, x0, y0, crop_url FROM figs",
    "caption_blocks": "SELECT doc_id, block_ord FROM capblocks",
    "crop_rects": "SELECT doc_id, region_ord, greatest(0, x0 - 5)::DOUBLE AS x0, greatest(0, y0 - 5)::DOUBLE AS y0, least(612, x1 + 5)::DOUBLE AS x1, least(792, y1 + 5)::DOUBLE AS y1 FROM figs",
    "corpus_chunks": "SELECT doc_id, chunk_ord, chunk_id, chunk_type, section_id, array_to_string(path, ' > ') AS path, page, token_count, length(text) AS chars FROM corpus_chunks",
    "prompt_context": _JOIN.format(f"trim(t, {BLANK})", "md2000"),
    "cited_context": _JOIN.format("t", "cited2500"),
    "sketch_context": "SELECT d.doc_id, coalesce(string_agg(entry, '' ORDER BY k, o), '') AS context FROM (SELECT DISTINCT doc_id FROM synth) d LEFT JOIN sketch_entries USING (doc_id) GROUP BY d.doc_id",
    "judge_context": """SELECT d.doc_id, array_to_string(flatten([CASE WHEN coalesce(t.title, '') <> '' THEN [concat('Title: ', t.title)] ELSE [] END, CASE WHEN h.l IS NULL THEN [] ELSE list_prepend('Sections:', h.l) END, ['Key source chunks:'], coalesce(j.l, [])]), chr(10)) AS context
      FROM (SELECT DISTINCT doc_id FROM synth) d LEFT JOIN titles t USING (doc_id) LEFT JOIN (SELECT doc_id, list(concat('- ', section_id, ': ', title) ORDER BY section_ord) AS l FROM secs WHERE section_ord < 12 GROUP BY doc_id) h USING (doc_id)
      LEFT JOIN (SELECT doc_id, list(line ORDER BY chunk_ord) AS l FROM judge_lines GROUP BY doc_id) j USING (doc_id)""",
    "figure_markdown": """SELECT doc_id, string_agg(concat('![figure=', n, '](', crop_url, ')'), chr(10) ORDER BY n) AS figures FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY region_ord) AS n FROM figs WHERE kind = 'figure') WHERE n <= 6 GROUP BY doc_id""",
    "build_prompt": f"""SELECT doc_id, concat('Address of the paper: http://host/', doc_id, chr(10), chr(10), CASE WHEN coalesce(context, '') <> '' THEN concat('Text of the paper, which may be cut:', chr(10), context, chr(10), chr(10)) ELSE '' END,
      {_q(_ORDER[0])}, CASE WHEN doc_id % 2 = 0 THEN 'Chinese' ELSE 'English' END, {_q(_ORDER[1])}, chr(10)) AS prompt FROM documents LEFT JOIN short USING (doc_id)""",
    "summary_parse": f"""SELECT doc_id, key, (row_number() OVER (PARTITION BY doc_id, key ORDER BY n) - 1) AS bullet_ord, text, chunk_ids FROM (SELECT doc_id, key, n, trim(regexp_replace(body, '(?i)\\[chunk_id:\\s*([0-9a-f]{{12}})\\]', '', 'g'), ' .,;') AS text,
      array_to_string(regexp_extract_all(body, '(?i)\\[chunk_id:\\s*([0-9a-f]{{12}})\\]', 1), ',') AS chunk_ids FROM (SELECT *, substr(trim(line, {BLANK}), 3) AS body FROM reply_parts WHERE key <> 'one_liner' AND starts_with(trim(line, {BLANK}), '- '))) WHERE text <> ''""",
    "summary_one_liner": f"""SELECT d.doc_id, coalesce(trim(string_split(ltrim(trim(t, {BLANK}), '- '), chr(10))[1], {BLANK}), '') AS one_liner FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM reply_parts WHERE key = 'one_liner' GROUP BY doc_id) USING (doc_id)""",
    "citation_extract": "SELECT doc_id, unnest(range(len(c)))::BIGINT AS ord, unnest(c) AS chunk_id FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\\[chunk_id:\\s*([0-9a-f]{12})\\]', 1) AS c FROM replies)",
    "sketch_parse": """SELECT doc_id, item_ord, section_id, title, level, one_liner FROM (SELECT doc_id, i AS item_ord, x->>'section_id' AS section_id, coalesce(x->>'one_liner', '') AS one_liner
      FROM (SELECT doc_id, i, json_extract(j, '$.section_summaries[' || i || ']') AS x FROM sketch_json, range(3) t(i))) JOIN secs USING (doc_id, section_id)""",
    "sketch_figures": """SELECT doc_id, item_ord, r.kind AS kind, label, caption_summary, r.page AS page FROM (SELECT doc_id, i AS item_ord, x->>'label' AS label, coalesce(x->>'caption_summary', '') AS caption_summary
      FROM (SELECT doc_id, i, json_extract(j, '$.figure_summaries[' || i || ']') AS x FROM sketch_json, range(3) t(i))) JOIN (SELECT doc_id, label, arg_max({'kind': kind, 'page': page}, (kind = 'figure', region_ord)) AS r FROM figs GROUP BY ALL) USING (doc_id, label)""",
    "term_first_chunk": """SELECT t.doc_id, item_ord, term, arg_min(page, chunk_ord) AS first_page, arg_min(chunk_id, chunk_ord) AS chunk_id FROM (SELECT doc_id, i AS item_ord, trim(json_extract_string(j, '$.key_terms[' || i || '].term')) AS term FROM sketch_json, range(4) t(i)) t
      JOIN line_chunks c ON c.doc_id = t.doc_id AND contains(lower(c.text), lower(t.term)) WHERE term <> '' GROUP BY ALL""",
    "judge_parse": "SELECT doc_id, ord AS item_ord, model, factuality, coverage, clarity, usefulness, overall_score, reason FROM judged",
    "judge_ranking": "SELECT doc_id, model, overall_score, reason, rank FROM judge_ranked",
    "top_keywords": "SELECT doc_id, rank, keyword, n FROM keywords",
    "keyword_coverage": "SELECT doc_id, model, coverage_score FROM scored",
    "header_score": "SELECT doc_id, model, structure_score AS header_score FROM scored WHERE status = 'OK'",
    "length_score": f"SELECT doc_id, round_even({LENGTH.format(f'length(trim(text, {BLANK}))')}, 3) AS length_score FROM documents",
    "figure_usage": "SELECT doc_id, model, figure_score FROM scored",
    "heuristic_score": "SELECT doc_id, model, structure_score, coverage_score, length_score, figure_score, overall_score FROM scored",
    "heuristic_ranking": "SELECT doc_id, model, overall_score, rank FROM ranked",
    "display_ranking": "SELECT doc_id, model, overall_score, rank, 'judge' AS source FROM judge_ranked UNION ALL SELECT doc_id, model, overall_score, rank, 'heuristic' FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM judge_ranked)",
    "results_with_judgement": "SELECT r.doc_id, r.model, r.status, j.s AS judge_score, j.r AS judge_reason FROM results r LEFT JOIN (SELECT doc_id, model, arg_max(overall_score, ord) AS s, arg_max(reason, ord) AS r FROM judged GROUP BY ALL) j USING (doc_id, model)",
    "rouge1": "SELECT conv_id, turn, rouge1_f1 FROM metrics",
    "rouge2": "SELECT conv_id, turn, rouge2_f1 FROM metrics",
    "rouge_l": "SELECT conv_id, turn, rougeL_f1 FROM metrics",
    "token_f1": "SELECT conv_id, turn, token_f1 FROM metrics",
    "reference_metrics": "SELECT * FROM metrics",
    "shared_metrics": """SELECT d.doc_id, coalesce(p.n, 0) AS pages_extracted, coalesce(c.n, 0)::BIGINT AS chars_used, coalesce(f.p, '') AS figure_pages, coalesce(f.n, 0) AS n_figure_urls FROM (SELECT DISTINCT doc_id FROM synth) d
      LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM tblocks GROUP BY doc_id) p USING (doc_id) LEFT JOIN (SELECT doc_id, sum(length(text)) AS n FROM corpus_chunks WHERE chunk_type <> 'caption' GROUP BY doc_id) c USING (doc_id)
      LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT page + 1)), ',') AS p, count(*) AS n FROM figs WHERE kind = 'figure' GROUP BY doc_id) f USING (doc_id)""",
    "model_spec_parse": f"""SELECT doc_id, CASE WHEN e IS NULL THEN CASE WHEN contains(s, ':') THEN p ELSE 'openai' END END AS provider, CASE WHEN e IS NULL THEN CASE WHEN contains(s, ':') THEN m WHEN s = '' THEN 'gpt-4o-mini' ELSE s END END AS model, e AS error
      FROM (SELECT *, CASE WHEN contains(s, ':') AND p NOT IN ('openai', 'gemini', 'deepseek') THEN concat('unknown provider: ', p) WHEN contains(s, ':') AND m = '' THEN 'empty model name' END AS e
      FROM (SELECT doc_id, s, lower(trim(split_part(s, ':', 1))) AS p, trim(substr(s, instr(s, ':') + 1)) AS m FROM (SELECT doc_id, trim({_SPEC}[doc_id % 7 + 1]) AS s FROM documents)))""",
    "csv_models": "SELECT doc_id, unnest(range(len(l)))::BIGINT AS ord, unnest(l) AS model FROM (SELECT doc_id, list_filter(list_transform(string_split(concat(' openai:a, ,gemini:', doc_id, ' ,,x'), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)",
    "url_normalize": """SELECT doc_id, CASE WHEN contains(u, 'arxiv.org/pdf/') AND NOT ends_with(u, '.pdf') THEN concat(u, '.pdf') ELSE u END AS url FROM (SELECT doc_id, replace(trim(concat([' https://arxiv.org/abs/', 'http://arxiv.org/pdf/', 'https://a.org/abs/'][doc_id % 3 + 1], doc_id, ['', '.pdf'][doc_id % 2 + 1])),
      'arxiv.org/abs/', 'arxiv.org/pdf/') AS u FROM documents)""",
    "language_names": "SELECT doc_id, CASE WHEN lower(trim(coalesce(CASE WHEN doc_id % 4 = 0 THEN ' CN ' WHEN doc_id % 4 <> 1 THEN lang END, 'en'))) IN ('ch', 'zh', 'cn', 'chinese') THEN 'Chinese' ELSE 'English' END AS language FROM documents",
    "latency_metrics": "SELECT doc_id, model, 2400::BIGINT AS preprocess_ms, CASE WHEN status = 'OK' THEN length(text) END AS llm_ms, 2400 + CASE WHEN status = 'OK' THEN length(text) END AS latency_ms FROM results",
    "cache_roundtrip": "SELECT doc_id, sha256(concat(doc_id, ':', text)) AS pdf_sha256, length(text) AS chars FROM documents",
}


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
        if name in CTES and name not in found:
            _needed(CTES[name], found)
            found[name] = None


def sql_of(name: str) -> str:
    """The SQL of a query with the subqueries that it needs, in order."""
    found: dict[str, None] = {}
    _needed(FINAL[name], found)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in found)
    return (f"WITH {head}\n" if head else "") + FINAL[name]


def oracle_sql() -> dict[str, str]:
    return {name: sql_of(name) for name in FINAL}
