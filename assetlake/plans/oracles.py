"""The queries in DuckDB SQL. Binary content is handled as hexadecimal text."""

from __future__ import annotations

from ..operators.candidates import EFFORTS, _deflated
from .fixtures import ASSETS_SQL, GREY, PIXELS_SQL

_ASSETS = f"""WITH assets AS ({ASSETS_SQL}),
sniffed AS (SELECT *, length(chex) // 2 AS length, CASE WHEN length(chex) <= 24 THEN NULL
  WHEN chex LIKE '89504E470D0A1A0A%' THEN 'png' WHEN chex LIKE 'FFD8FF%' THEN 'jpeg'
  WHEN chex LIKE '474946383761%' OR chex LIKE '474946383961%' THEN 'gif' END AS kind FROM assets),
named AS (SELECT *, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'gif' THEN 'gif' WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' WHEN 'png' THEN 'png' END AS name_kind FROM sniffed),
framed AS (SELECT *, 41 + CASE substr(chex,41,4) WHEN 'FFC4' THEN 12 WHEN 'FFFE' THEN 8 WHEN 'FFD8' THEN 36 ELSE 0 END AS sof FROM named),
raw_size AS (SELECT *, CASE
    WHEN kind = 'gif' THEN cast('0x' || substr(chex,15,2) || substr(chex,13,2) AS bigint)
    WHEN kind = 'png' AND length > 24 AND substr(chex,25,8) = '49484452' THEN cast('0x' || substr(chex,33,8) AS bigint)
    WHEN kind = 'jpeg' AND length > sof // 2 + 9 AND substr(chex,sof,4) IN ('FFC0', 'FFC2') THEN cast('0x' || substr(chex,sof+14,4) AS bigint) END AS rw, CASE
    WHEN kind = 'gif' THEN cast('0x' || substr(chex,19,2) || substr(chex,17,2) AS bigint)
    WHEN kind = 'png' AND length > 24 AND substr(chex,25,8) = '49484452' THEN cast('0x' || substr(chex,41,8) AS bigint)
    WHEN kind = 'jpeg' AND length > sof // 2 + 9 AND substr(chex,sof,4) IN ('FFC0', 'FFC2') THEN cast('0x' || substr(chex,sof+10,4) AS bigint) END AS rh FROM framed),
sized AS (SELECT *, CASE WHEN rw > 0 AND rh > 0 THEN rw END AS width, CASE WHEN rw > 0 AND rh > 0 THEN rh END AS height FROM raw_size),
classified AS (SELECT *, CASE WHEN length = 0 THEN 'empty file' WHEN kind IS NULL THEN 'invalid format' WHEN kind = 'jpeg' THEN 'skipped'
  WHEN width IS NULL THEN 'invalid format' WHEN width * height > 2000000 THEN 'too big' ELSE 'ok' END AS status FROM sized)
"""
_BYTES = """WITH bytes AS (SELECT doc_id, cast('0x' || substr(h, 2 * i - 1, 2) AS int) AS sym
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))),
hist AS (SELECT doc_id, sym, count(*) AS n FROM bytes GROUP BY ALL),
totals AS (SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL),
costs AS (SELECT t.doc_id, t.n_bytes, 8 * t.n_bytes + 40 * ((t.n_bytes + 65534) // 65535) AS raw_bits,
   cast(7 + coalesce(sum(n * CASE WHEN sym <= 143 THEN 8 ELSE 9 END), 0) AS bigint) AS fixed_bits,
   cast(ceil(round(log2(t.n_bytes + 1) + coalesce(sum(n * (log2(t.n_bytes + 1) - log2(n))), 0), 3) + 71 + 4 * (count(sym) + 1)) AS bigint) AS adaptive_bits
  FROM totals t LEFT JOIN hist h ON t.doc_id = h.doc_id GROUP BY t.doc_id, t.n_bytes)
"""
_PIXELS = f"""WITH pixels AS ({PIXELS_SQL}),
lagged AS (SELECT *, lag(color) OVER (PARTITION BY asset_id, pos ORDER BY frame_no) AS was FROM pixels),
delta AS (SELECT *, frame_no = 0 OR was IS DISTINCT FROM color AS changed FROM lagged),
palettes AS (SELECT asset_id, frame_no, list_sort(list(DISTINCT coalesce(color, -1))) AS palette FROM pixels GROUP BY ALL),
resets AS (SELECT asset_id, frame_no, any_value(frame_no) > 0 AND (bool_or(color IS NULL AND was IS NOT NULL) OR bool_and(changed)) AS resets, bool_or(color IS NULL) AS clear FROM delta GROUP BY asset_id, frame_no),
disposal AS (SELECT asset_id, frame_no, CASE WHEN coalesce(lead(resets) OVER w, false) OR (lead(frame_no) OVER w IS NULL AND frame_no > 0 AND first_value(clear) OVER w)
  THEN 'background' ELSE 'keep' END AS dispose FROM resets WINDOW w AS (PARTITION BY asset_id ORDER BY frame_no))
"""
_COMMENTS = "(octet_length(encode(html)) + 59999) // 60000"
_GIF_BLOCKS = "(octet_length(encode(html)) + 254) // 255"

#: Bytes of the smallest encoding of the fixture's image; which it is, only the library that deflates can say.
_IMAGE = min(len(_deflated(GREY, s)) for s in range(len(EFFORTS)))
_FILES = f"""WITH p AS (SELECT page_id, unnest(CASE WHEN page_id % 10 = 0 THEN ['pages', 'copies/of/pages'] ELSE ['pages'] END) AS folder,
    octet_length(encode(html)) AS n, hex(encode(coalesce(url, ''))) AS url, octet_length(encode(coalesce(url, ''))) AS u, {_COMMENTS} AS c, {_GIF_BLOCKS} AS b,
    3 * cast(2 ** (page_id % 8 + 1) AS bigint) AS colors FROM pages WHERE html IS NOT NULL AND html != ''),
  runs AS (SELECT page_id, folder, '.jpg' AS ending, 'jpeg' AS kind, 54 + 4 + u + n + 4 * c AS before, 54 + 4 + u AS after,
      'FFD8FFE000104A46494600010100000100010000FFEE' || printf('%04X', u + 2) || url || 'FFC00011080020001003011100021101031101FFDA0008010100003F00D2CF20FFD9' AS content FROM p
    UNION ALL SELECT page_id, folder, '.gif', 'gif', 13 + colors + 8 + 3 + n + b + 16, 13 + colors + 8 + 16,
      '47494638396110002000' || printf('%02X', 128 + page_id % 8) || '0000' || repeat('00', colors) || '21F90400000000002C00000000100020000002024C01003B' FROM p
    UNION ALL SELECT page_id, folder, '.PNG', 'png', 8 + 25 + 12 + u + 12 + n + 12 + {len(GREY) + 11} + 12, 8 + 25 + 12 + u + 12 + {_IMAGE} + 12, '' FROM p)
"""

ORACLES: dict[str, str] = {
    "path_union": _ASSETS + "SELECT path FROM assets UNION SELECT '/assets/' || (doc_id % 13)::varchar || '/' || doc_id::varchar || '.gif' FROM labels",
    "rewritten_assets": _ASSETS + ", r AS (SELECT path, kind, length AS before, length - CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length // 10 END AS after FROM classified WHERE status = 'ok') SELECT * FROM r WHERE after < before",
    "manifest_rows": "SELECT sha256(text) AS hash, './docs/' || doc_id::varchar || '.txt' AS path FROM documents",
    "pending_export": _ASSETS + "SELECT path AS value FROM assets WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ext_kind": _ASSETS + "SELECT path, name_kind AS kind FROM named",
    "sniff_kind": _ASSETS + "SELECT doc_id, kind FROM sniffed",
    "gif_dimensions": _ASSETS + "SELECT doc_id, width, height FROM sized WHERE kind = 'gif' AND width IS NOT NULL",
    "png_dimensions": _ASSETS + "SELECT doc_id, width, height FROM sized WHERE kind = 'png' AND width IS NOT NULL",
    "jpeg_dimensions": _ASSETS + "SELECT doc_id, width, height FROM sized WHERE kind = 'jpeg' AND width IS NOT NULL",
    "png_color_type": _ASSETS + "SELECT doc_id, CASE substr(chex,51,2) WHEN '00' THEN 'grey' WHEN '02' THEN 'rgb' WHEN '03' THEN 'palette' WHEN '04' THEN 'grey alpha' WHEN '06' THEN 'rgba' END AS color_type FROM sniffed WHERE kind = 'png' AND substr(chex,25,8) = '49484452' AND substr(chex,51,2) IN ('00','02','03','04','06')",
    "pixel_limit": "SELECT o_orderkey, CASE WHEN v BETWEEN 1 AND 4294967295 THEN v END AS pixels FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN o_orderkey * 1000000 WHEN 2 THEN o_orderkey * 1000000000 WHEN 3 THEN NULL ELSE o_orderkey END AS v FROM (SELECT o_orderkey::bigint AS o_orderkey FROM orders))",
    "resolution_filter": _ASSETS + "SELECT doc_id, width, height FROM sized WHERE width * height BETWEEN 1 AND 2000000",
    "kind_filter": _ASSETS + "SELECT doc_id, kind FROM sniffed WHERE kind IN ('gif', 'png')",
    "classify": _ASSETS + "SELECT doc_id, kind, status, length FROM classified",
    "kind_mismatch": _ASSETS + "SELECT path, name_kind, kind AS content_kind FROM named WHERE name_kind IS DISTINCT FROM kind",
    "effort_budget": _ASSETS + "SELECT doc_id, CASE WHEN length < 200000 THEN 60 ELSE 20 END AS rounds, CASE WHEN width * height > 65535 THEN width WHEN width * height > 32767 THEN 2 ELSE 1 END AS lzw_step FROM sized WHERE width IS NOT NULL",
    "reportable_failures": _ASSETS + "SELECT path, status FROM classified WHERE status NOT IN ('ok', 'skipped') AND name_kind IN ('gif', 'png')",
    "strip_metadata": f"""WITH p AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL AND html != ''),
      q AS (SELECT page_id, n, (n + 59999) // 60000 AS c, (n + 254) // 255 AS b FROM p)
      SELECT '/pages/' || page_id::varchar || '.jpg' AS path, 54 + n + 4 * c AS before, 54 AS after, lower('FFD8FFE000104A46494600010100000100010000FFC00011080020001003011100021101031101FFDA0008010100003F00D2CF20FFD9') AS content FROM q
      UNION ALL SELECT '/pages/' || page_id::varchar || '.gif', 29 + 3 + n + b, 29, lower('474946383961100020000000002C00000000100020000002024C01003B') FROM q""",
    "metadata_inventory": f"""WITH p AS (SELECT octet_length(encode(html)) AS n, {_COMMENTS} AS c, {_GIF_BLOCKS} AS b FROM pages WHERE html IS NOT NULL AND html != '')
      SELECT 'jpeg' AS kind, 254 AS label, cast(sum(c) AS bigint) AS segments, cast(sum(n + 4 * c) AS bigint) AS bytes, count(*) AS files, round(sum(n + 4 * c)::double / sum(54 + n + 4 * c)::double, 6) AS share FROM p
      UNION ALL SELECT 'gif', 254, count(*), cast(sum(n + b + 3) AS bigint), count(*), round(sum(n + b + 3)::double / sum(29 + n + b + 3)::double, 6) FROM p""",
    "jpeg_segments": f"""WITH p AS (SELECT '/pages/' || page_id::varchar || '.jpg' AS path, octet_length(encode(html)) AS n, {_COMMENTS} AS c FROM pages WHERE html IS NOT NULL AND html != ''),
      comments AS (SELECT path, n, unnest(range(c)) AS i FROM p),
      parts AS (SELECT path, 0 AS ordinal, 216 AS marker, 0 AS "offset", 2 AS length FROM p UNION ALL SELECT path, 1, 224, 2, 18 FROM p
        UNION ALL SELECT path, 2 + i, 254, 20 + 60004 * i, least(60000, n - 60000 * i) + 4 FROM comments UNION ALL SELECT path, 2 + c, 192, 20 + n + 4 * c, 19 FROM p
        UNION ALL SELECT path, 3 + c, 218, 39 + n + 4 * c, 13 FROM p UNION ALL SELECT path, 4 + c, 217, 52 + n + 4 * c, 2 FROM p)
      SELECT path, cast(ordinal AS int) AS ordinal, cast(marker AS int) AS marker, cast("offset" AS bigint) AS "offset", cast(length AS bigint) AS length, marker = 254 AS is_metadata, false AS malformed FROM parts""",
    "gif_blocks": f"""WITH p AS (SELECT '/pages/' || page_id::varchar || '.gif' AS path, octet_length(encode(html)) AS n, {_GIF_BLOCKS} AS b FROM pages WHERE html IS NOT NULL AND html != ''),
      parts AS (SELECT path, 0 AS ordinal, 'header' AS block, NULL AS label, 0 AS "offset", 13 AS length FROM p UNION ALL SELECT path, 1, 'extension', 254, 13, n + b + 3 FROM p
        UNION ALL SELECT path, 2, 'image', NULL, 16 + n + b, 15 FROM p UNION ALL SELECT path, 3, 'trailer', NULL, 31 + n + b, 1 FROM p)
      SELECT path, cast(ordinal AS int) AS ordinal, block, cast(label AS int) AS label, cast("offset" AS bigint) AS "offset", cast(length AS bigint) AS length, block = 'extension' AS is_metadata, false AS malformed FROM parts""",
    "byte_histogram": _BYTES + "SELECT doc_id, sym, n FROM hist",
    "entropy_cost": _BYTES + "SELECT h.doc_id, sym, round(log2(n_bytes::double) - log2(n::double), 3) AS cost FROM hist h JOIN totals t ON h.doc_id = t.doc_id",
    "block_cost": _BYTES + "SELECT *, CASE WHEN n_bytes <= 1000 AND fixed_bits < least(raw_bits, adaptive_bits) THEN 'fixed' WHEN adaptive_bits < raw_bits THEN 'adaptive' ELSE 'raw' END AS block FROM costs",
    "code_width": _BYTES + "SELECT t.doc_id, cast(greatest(2, least(8, ceil(log2(coalesce(max(sym), 0) + 1)))) AS int) AS width FROM totals t LEFT JOIN hist h ON t.doc_id = h.doc_id GROUP BY t.doc_id",
    "chunk_payload": "SELECT doc_id, cast(s // 4096 AS int) AS chunk_no, greatest(0, s - 1024) AS window_start, s AS start, least(s + 4096, n) AS \"end\", s + 4096 >= n AS last FROM (SELECT doc_id, n, unnest(range(0, n, 4096)) AS s FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))",
    "decay_histogram": """WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
      SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) // 2 + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.event_type = b.event_type UNION ALL SELECT 'end', 1""",
    "repeats_left": """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER w AS place, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY place) AS run_no FROM r)
      SELECT event_id, cast(max(place) OVER (PARTITION BY user_id, run_no) - place AS int) AS "left" FROM g""",
    "value_runs": """WITH r AS (SELECT user_id, event_type, row_number() OVER w AS place, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY place) AS run_no FROM r)
      SELECT user_id, cast(run_no AS bigint) AS run_no, event_type, min(place) - 1 AS first, count(*) AS n, count(*) >= 2 AS good FROM g GROUP BY user_id, run_no, event_type""",
    "running_offset": "SELECT event_id, cast(coalesce(sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS offset FROM events",
    "candidate_grid": "SELECT doc_id, setting_no, setting FROM documents, (VALUES (0, 'raw'), (1, 'fixed'), (2, 'adaptive')) s(setting_no, setting)",
    "best_candidate": "SELECT l_orderkey, size, l_linenumber, l_suppkey FROM (SELECT l_orderkey, l_extendedprice::double AS size, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice::double, l_linenumber, l_suppkey) AS rn FROM lineitem WHERE l_extendedprice IS NOT NULL) WHERE rn = 1",
    "dedup_compute": _BYTES + "SELECT d.doc_id, sha256(text) AS digest, n_bytes, fixed_bits FROM documents d JOIN costs c ON d.doc_id = c.doc_id",
    "run_summary": _ASSETS + ", o AS (SELECT coalesce(kind, 'none') AS kind, status, length AS before, length - length // 10 AS after FROM classified), s AS (SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS total, count(*) FILTER (status = 'ok') AS done, count(*) FILTER (status != 'ok') AS skipped, cast(coalesce(sum(before) FILTER (status = 'ok'), 0) AS bigint) AS bytes_before, cast(coalesce(sum(after) FILTER (status = 'ok'), 0) AS bigint) AS bytes_after FROM o GROUP BY ROLLUP (kind)) SELECT *, bytes_before - bytes_after AS saved, round((bytes_before - bytes_after)::double / nullif(bytes_before, 0)::double, 4) AS saved_ratio FROM s",
    "pending_assets": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "verify_manifest": "SELECT doc_id::varchar AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'mismatch' ELSE 'match' END AS verdict FROM documents",
    "duplicate_payloads": "SELECT doc_id, digest, copies, first_key FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_key FROM documents WHERE text IS NOT NULL) WHERE copies > 1",
    "sorted_paths": _ASSETS + "SELECT path, doc_id FROM assets ORDER BY string_split(path, '/')",
    "frame_delta": _PIXELS + "SELECT asset_id, cast(frame_no AS int) AS frame_no, cast(pos AS int) AS pos, changed FROM delta",
    "frame_disposal": _PIXELS + """SELECT asset_id, cast(frame_no AS int) AS frame_no, CASE WHEN coalesce(lead(resets) OVER w, false) OR (asset_id % 3 != 1 AND lead(frame_no) OVER w IS NULL AND frame_no > 0 AND first_value(clear) OVER w)
      THEN 'background' ELSE 'keep' END AS dispose FROM resets WINDOW w AS (PARTITION BY asset_id ORDER BY frame_no)""",
    "palette_index": _PIXELS + "SELECT p.asset_id, cast(p.frame_no AS int) AS frame_no, cast(pos AS int) AS pos, cast(list_position(palette, coalesce(color, -1)) - 1 AS int) AS index FROM pixels p JOIN palettes q ON p.asset_id = q.asset_id AND p.frame_no = q.frame_no",
    "merge_palettes": _PIXELS + """, lists AS (SELECT asset_id, coalesce(list(palette ORDER BY len(palette), frame_no) FILTER (len(palette) <= 12), []) AS up FROM palettes GROUP BY asset_id),
      ways AS (SELECT asset_id, up AS ordered FROM lists UNION ALL SELECT asset_id, list_reverse(up) FROM lists),
      turned AS (SELECT asset_id, list_concat(ordered[i + 1:], ordered[1:i]) AS palettes FROM (SELECT asset_id, ordered, unnest(range(len(ordered))) AS i FROM ways)),
      folded AS (SELECT asset_id, palettes, list_sort(list_reduce(palettes, lambda acc, x: CASE WHEN len(list_distinct(list_concat(acc, x))) <= 12 THEN list_distinct(list_concat(acc, x)) ELSE acc END)) AS made FROM turned),
      found AS (SELECT asset_id, list_sort(list(DISTINCT made)) AS made FROM folded WHERE len(list_filter(palettes, lambda p: list_has_all(made, p))) >= 2 GROUP BY asset_id),
      whole AS (SELECT asset_id, up, list_sort(list_distinct(flatten(up))) AS every FROM lists)
      SELECT w.asset_id, cast(to_json(CASE WHEN len(up) = 0 THEN [] WHEN len(every) <= 12 THEN [every] WHEN len(up) = 2 THEN [] ELSE coalesce(made, []) END) AS varchar) AS candidates FROM whole w LEFT JOIN found f ON w.asset_id = f.asset_id""",
    "change_bbox": _PIXELS + """, b AS (SELECT asset_id, frame_no, min(pos % 8) FILTER (changed) AS x0, max(pos % 8) FILTER (changed) AS x1, min(pos // 8) FILTER (changed) AS y0, max(pos // 8) FILTER (changed) AS y1 FROM delta GROUP BY ALL),
      r AS (SELECT asset_id, frame_no, frame_no = 0 OR coalesce(lag(dispose) OVER (PARTITION BY asset_id ORDER BY frame_no) = 'background', false) AS whole FROM disposal)
      SELECT b.asset_id, cast(b.frame_no AS int) AS frame_no, cast(CASE WHEN whole THEN 0 ELSE coalesce(x0, 0) END AS int) AS min_x, cast(CASE WHEN whole THEN 7 ELSE coalesce(x1, 0) END AS int) AS max_x, cast(CASE WHEN whole THEN 0 ELSE coalesce(y0, 0) END AS int) AS min_y, cast(CASE WHEN whole THEN 7 ELSE coalesce(y1, 0) END AS int) AS max_y FROM b JOIN r ON b.asset_id = r.asset_id AND b.frame_no = r.frame_no""",
    "distinct_palette": _PIXELS + "SELECT asset_id, cast(frame_no AS int) AS frame_no, array_to_string(palette, ',') AS palette, len(palette) <= 256 AS valid FROM palettes",
    "palette_containment": _PIXELS + "SELECT f.asset_id, cast(f.frame_no AS int) AS frame_no, cast(s.frame_no AS int) AS shared_no FROM palettes f JOIN palettes s ON f.asset_id = s.asset_id AND s.frame_no < 3 WHERE list_has_all(s.palette, f.palette)",
    "first_free_value": _PIXELS + "SELECT asset_id, cast(frame_no AS int) AS frame_no, cast(list_min(list_filter(range(0, 600), lambda x: NOT list_contains(palette, x::int))) AS int) AS free FROM palettes",
    "lossless_check": _PIXELS + """, f AS (SELECT asset_id, frame_no, bool_and(asset_id != 5 OR pos != 9 OR color IS NULL) AS same FROM pixels GROUP BY ALL)
      SELECT asset_id, count(*) AS frames, bool_and(same AND (asset_id != 3 OR frame_no > 0) AND (asset_id != 7 OR frame_no != 2) AND (asset_id != 6 OR frame_no != 1) AND (asset_id != 8 OR frame_no != 1)) AS same FROM f GROUP BY asset_id""",
    "read_status": _ASSETS + "SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'vanished!' WHEN doc_id % 5 = 0 THEN 'read error' END AS io FROM assets",
    "written_status": _ASSETS + "SELECT path, CASE WHEN length % 4 = 0 AND length > 0 THEN 'write error' ELSE 'ok' END AS status, length AS before, CASE WHEN length % 4 = 0 THEN length ELSE length // 2 END AS after FROM sniffed",
    "asset_report": _ASSETS + ", " + _FILES.removeprefix("WITH ") + """SELECT kind, status, count(*) AS assets, cast(sum(before) AS bigint) AS bytes, cast(sum(after) AS bigint) AS bytes_after FROM (
      SELECT kind, status, length AS before, length AS after FROM classified
      UNION ALL SELECT kind, CASE WHEN kind = 'jpeg' THEN 'skipped' ELSE 'ok' END, before, CASE WHEN kind = 'jpeg' THEN before ELSE after END FROM runs) GROUP BY ALL""",
    "optimize_assets": _FILES + """SELECT folder || '/' || (page_id % 7)::varchar || '/' || page_id::varchar || ending AS path, kind, 'ok' AS status, before, after FROM runs""",
    "optimized": _FILES + """SELECT folder || '/' || (page_id % 7)::varchar || '/' || page_id::varchar || ending AS path, kind, before, after, lower(content) AS content FROM runs WHERE kind != 'png'""",
    "incremental_files": _FILES + """SELECT folder || '/' || (page_id % 7)::varchar || '/' || page_id::varchar || ending AS path, kind, 'ok' AS status, before, after FROM runs""",
    "scan_assets": _ASSETS + "SELECT substr(path, 2) AS path, length, NULL::varchar AS io, sha256(unhex(chex)) AS digest FROM sniffed",
    "incremental_run": _ASSETS + "SELECT path, kind, status, length AS before, length AS after FROM classified",
}

ORACLES["segment_sizes"] = f"""WITH j AS ({ORACLES["jpeg_segments"]}), g AS ({ORACLES["gif_blocks"]})
  SELECT kind, label, count(*) AS segments, cast(sum(length) AS bigint) AS bytes, count(DISTINCT path) AS files
  FROM (SELECT 'jpeg' AS kind, marker AS label, length, path FROM j UNION ALL SELECT 'gif', label, length, path FROM g) GROUP BY kind, label"""

ORACLES["symbol_runs"] = """WITH b AS (SELECT doc_id, i - 1 AS pos, cast('0x' || substr(h, 2 * i - 1, 2) AS int) AS sym
    FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))),
  r AS (SELECT *, CASE WHEN pos = 0 OR lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) != sym THEN 1 ELSE 0 END AS begins FROM b),
  g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS run_no FROM r)
  SELECT doc_id, sym, cast(run_no AS bigint) AS run_no, min(pos) AS first, count(*) AS n FROM g GROUP BY doc_id, sym, run_no HAVING count(*) >= 2 AND (sym = 0 OR count(*) >= 3)"""
ORACLES["payload_runs"] = ORACLES["symbol_runs"]

ORACLES["payload_crc"] = """WITH payloads AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
  steps AS (SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))
  SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS bigint))),
    lambda c, b: xor(list_extract(step, (xor(c, b) & 255) + 1), c >> 8))) AS crc FROM payloads, steps"""
