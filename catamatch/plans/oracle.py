"""DuckDB SQL with the same result columns as each registered query."""

from __future__ import annotations

from catamatch import rules
from catamatch.functions import text as t
from catamatch.plans import oracle_pipeline as op
from catamatch.plans import views

P = op.PIPELINE
_ITEMS = f"WITH items AS ({views.ITEMS.format(orders='orders')})"
_CAT = f"WITH cat AS ({views.CATALOGUE.format(part='part')})"
# the feature and candidate steps over the distinct item texts
_a = op.BASE.index("marked AS (")
_b = op.BASE.index("f0 AS (")
TEXTS = ("WITH " + op.BASE.strip()[:_a - 1] + "ctx AS (SELECT name AS cname, volt, count(*) AS n_items FROM items GROUP BY ALL),\n"
         + op.BASE[_b:].rstrip().rstrip(","))
_JOIN = ("f3 JOIN {0} c ON f3.part IS NOT DISTINCT FROM c.part AND f3.band = c.band AND f3.form = c.form "
         "AND f3.vals = c.vals AND f3.opts = c.opts")
_LEFT = _JOIN.replace(" JOIN ", " LEFT JOIN ")
_DOCQ = "CAST(event_id AS VARCHAR)"
_T, _Q = op.quantity("name")
_EV = ("WITH ev AS (SELECT user_id AS doc_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS panel_idx, "
       "event_id AS item_idx, event_type, value FROM events)")
_NEAREST = """WITH wants AS (SELECT p_brand, floor(l_extendedprice / 100) / 10 AS want, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
steps AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS cap, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS code FROM part),
fits AS (SELECT w.p_brand, w.want, w.n, min({'c': s.cap, 'k': s.code}) FILTER (WHERE s.cap >= w.want) AS f, max(s.cap) AS top
  FROM wants w LEFT JOIN steps s ON s.p_brand = w.p_brand GROUP BY ALL)
SELECT p_brand, want, n, f.c AS fit, f.k AS fit_code, top, CASE WHEN f.c = want THEN '◎' WHEN f.c IS NOT NULL THEN '○' ELSE '△' END AS conf FROM fits"""


def _round(kind: str) -> str:
    steps = sorted(rules.MOTOR_SUFFIX[kind])
    return "CASE " + " ".join(f"WHEN l_quantity <= {s} THEN CAST({s} AS DOUBLE)" for s in steps) + f" ELSE CAST({steps[-1]} AS DOUBLE) END"


_FRAME = ("CASE WHEN af IS NULL THEN NULL WHEN af IN ({0}) THEN af ELSE coalesce((SELECT min(s) FROM unnest([{0}]) AS u(s) WHERE s >= CASE WHEN att > 0 AND att <= af "
          "AND att <= 3200 THEN att ELSE af END), 3200) END").format(", ".join(map(str, rules.STANDARD_FRAMES)))
_AFX = f"coalesce({op.grab('form', r'(\d+)af')}, {op.grab('form', r'[234]p(\d{2,4})(/(\d{2,4}))?', 1)})"
_ATX = (f"CASE WHEN {op.grab('form', r'(\d+)af')} IS NULL AND {op.grab('form', r'[234]p(\d{2,4})(/(\d{2,4}))?', 1)} IS NOT NULL "
        f"THEN coalesce({op._std(op.grab('form', r'[234]p(\d{2,4})(/(\d{2,4}))?', 3))}, {op._std(op.grab('form', r'(\d+)at'))}) "
        f"ELSE {op._std(op.grab('form', r'(\d+)at'))} END")
_FRAMES = f"""{_ITEMS}, n AS (SELECT item_idx, {op.norm('name')} AS form, {op.norm('panel')} AS pform FROM items),
a AS (SELECT item_idx, CASE WHEN {op.any_of('pform', ('制御', '動力'))} THEN 'control' WHEN {op.any_of('pform', ('分電', '電灯'))} THEN 'lighting'
  WHEN {op.any_of('pform', ('配電', '受電', '高圧'))} THEN 'receiving' ELSE 'lighting' END AS kind, CAST({_AFX} AS BIGINT) AS af, CAST({_ATX} AS BIGINT) AS att,
  coalesce({op.grab('form', r'(\d)p')}, '3') AS pole, contains(form, 'elb') AS elb FROM n),
b AS MATERIALIZED (SELECT *, {_FRAME} AS frame FROM a)"""


def _branch(base: str) -> str:
    return (f"'{base}' || {op.mapping(op._DIG, 'CAST(frame AS VARCHAR)')} || "
            f"{op.mapping(op._SUF, chr(10).join(['CASE WHEN pole IN (chr(50), chr(52)) THEN pole ELSE chr(51) END || chr(124) || CAST(elb AS VARCHAR)']))}")


def _tok(key: str, text: str, src: str) -> str:
    return (f"SELECT DISTINCT {key}, tok FROM (SELECT {key}, unnest(list_transform(string_split_regex({text}, '[\\s　()（）]'), "
            f"lambda w: lower(w))) AS tok FROM {src}) WHERE length(tok) >= 2")


def _summary(src: str) -> str:
    return (f"SELECT count(*) FILTER (conf IN ('◎', '○', '△')) AS total, count(*) FILTER (conf = '◎') AS ok, count(*) FILTER (conf = '○') AS warn, "
            f"count(*) FILTER (conf = '△') AS chk, count(*) FILTER (conf = '—') AS detail FROM {src}")


_RATE = "CAST(round_even((ok + warn) * 100.0 / greatest(total, 1), 0) AS BIGINT)"
_FEED = op.grab("name", r"^\s*(\d+[A-Za-z]+\d+)")
_SPLIT_PRICE = " ".join(f"WHEN o_totalprice > {lo} AND o_totalprice <= {hi} THEN '{l}'" for lo, hi, l in
                        ((0.0, 50000.0, "low"), (50000.0, 200000.0, "middle"), (200000.0, 450000.0, "high")))
_VS = ("value_score", "option_score")

SQL: dict[str, str] = {
    "catalog_scan": """SELECT code, ord, kind, spec FROM (SELECT p_name || '|' || p_brand AS code, p_partkey AS ord, p_type AS kind, p_size AS spec,
        row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1""",
    "attr_spec_long": """SELECT p_partkey, p_type AS class, a.attr AS attr, a.attr <> 'price' AS required,
        CASE a.attr WHEN 'size' THEN CAST(p_size AS VARCHAR) || 'A' WHEN 'brand' THEN p_brand END AS pattern
        FROM part CROSS JOIN (VALUES ('size'), ('brand'), ('price')) AS a(attr)""",
    "nested_flatten": f"""SELECT event_id, 0 AS panel_idx, event_type AS panel, 0 AS item_idx, event_type || ' ' || {_DOCQ} || 'A' AS name, CAST(user_id AS VARCHAR) AS qty, false AS load_detail FROM events
        UNION ALL SELECT event_id, 0, event_type, 1, 'L-1 5kVA', '', true FROM events UNION ALL SELECT event_id, 1, '', 0, '', '7', false FROM events""",
    "json_salvage": "SELECT event_id, event_id % 5 <> 3 AS ok, CASE WHEN event_id % 5 <> 3 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k FROM events",
    "dead_letter_split": f"""SELECT event_id, 0 AS panel_idx, event_type AS panel, 0 AS item_idx, event_type || ' ' || {_DOCQ} || 'A' AS name, false AS unclear FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 0, event_type, 1, 'L-1 5kVA', false FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 1, '', 0, '', false FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 0, '[抽出失敗] event-' || {_DOCQ}, 0, 'unreadable', true FROM events WHERE event_type = 'error'""",
    "read_counts": """SELECT count(*) FILTER (event_type <> 'error') AS n_docs, count(*) FILTER (event_type = 'error') AS n_failed,
        CAST(sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 2 END) AS BIGINT) AS n_panels,
        CAST(sum(CASE WHEN event_type IN ('error', 'click', 'view') THEN 0 ELSE 3 END) AS BIGINT) AS n_items FROM events""",
    "stored_results": f"SELECT doc_id, length({op.norm('text')}) AS n_form FROM documents UNION ALL SELECT item_id, length({op.norm('text')}) FROM benchmark",
    "detail_sink": P + " SELECT doc_id, panel_idx, item_idx, panel, name, qty, state FROM stated",
    "dictionary_parts": f"""{_ITEMS}, cat AS ({views.CATALOGUE.format(part='part')}),
        d0 AS (SELECT * FROM (VALUES {', '.join(f"('{t.squeeze_literal(a)}', '{p}', {i})" for i, (a, p) in enumerate(rules.aliases()))}) AS v(alias, part, priority)
          UNION ALL SELECT w, w, min(ord) + {len(rules.aliases())} FROM (SELECT {op.norm("string_split(name, ' ')[1]")} AS w, ord FROM cat) GROUP BY w),
        f AS (SELECT DISTINCT {op.norm('name')} AS form FROM items),
        h AS (SELECT form, alias, part, priority FROM f JOIN d0 ON alias <> '' AND contains(form, alias) AND (length(alias) > 2
          OR regexp_matches(form, '(^|[^a-z])' || regexp_escape(alias) || '([^a-z]|$)')))
        SELECT form, alias, part FROM h QUALIFY row_number() OVER (PARTITION BY form ORDER BY priority, alias) = 1""",
    "path_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.html?$') AND NOT contains(url, '/.')",
    "content_dedup": f"SELECT doc_id, sha256(text) AS hash, length({op.norm('text')}) AS n_form FROM documents",
    "provenance_label": "SELECT page_id, regexp_extract(url, '[^/]*$') || ' / ' || regexp_extract(url, '^https?://([^/]+)', 1) AS label FROM pages",
    "ordered_text_assembly": """SELECT conv_id, string_agg('(' || CAST(turn % 2 AS VARCHAR) || ',' || CAST(-CAST(floor(turn / 2) AS BIGINT) AS VARCHAR) || ') ' || text, chr(10)
        ORDER BY floor(turn / 2), turn % 2, text) AS text FROM conversations GROUP BY conv_id""",
    "ordered_lines": """WITH p AS (SELECT user_id AS doc_id, event_type || ' ' || CAST(event_id AS VARCHAR) AS text,
            date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, CAST(floor(value) AS BIGINT) AS y FROM events)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, text) AS line_no,
            '(' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ') ' || text AS line FROM p""",
    "report_detail": P + """SELECT doc_id, panel_idx, item_idx, panel, name AS raw, qty, CASE WHEN code = '' THEN '—' ELSE code END AS code,
        coalesce(official, '') AS official, conf, note FROM graded""",
    "report_summary": P + f""", s AS ({_summary('graded')}), d AS (SELECT count(*) AS n FROM dets WHERE parent_idx IS NOT NULL)
        SELECT 'items' AS label, CAST(total AS VARCHAR) AS value FROM s UNION ALL SELECT '◎', CAST(ok AS VARCHAR) FROM s UNION ALL SELECT '○', CAST(warn AS VARCHAR) FROM s
        UNION ALL SELECT '△', CAST(chk AS VARCHAR) FROM s UNION ALL SELECT 'rate', CAST({_RATE} AS VARCHAR) || '%' FROM s UNION ALL SELECT 'load details', CAST(n AS VARCHAR) FROM d""",
    "text_normalize": f"SELECT doc_id, {op.norm('text')} AS form FROM documents",
    "qty_split": f"{_ITEMS} SELECT item_idx, {_T} AS text, coalesce({_Q}, qty) AS qty FROM items",
    "main_option_split": TEXTS + " SELECT cname, volt, main_text, array_to_string(opts, '|') AS opts FROM f3",
    "band_classify": TEXTS + " SELECT 'item' AS side, cname || '|' || volt AS key, band FROM f3 UNION ALL SELECT 'catalogue', code, band FROM catf",
    "unit_numbers": TEXTS + f""" SELECT cname, volt, {op.grab('lower(qname)', r'(\d+\.\d+|\d+)\s*kw')} AS kw, {op.grab('qname', r'(?i)(\d+\.?\d*)\s*k?var?')} AS kva,
        {op.grab('form', r'(\d+)a')} AS amp, coalesce({op.grab('form', r'(\d)p')}, '3') AS pole, ratio FROM f3""",
    "frame_trip_parse": TEXTS + f" SELECT cname, volt, {_AFX} AS af, {_ATX} AS at FROM f3",
    "attr_value_set": TEXTS + " SELECT 'item' AS side, cname || '|' || volt AS key, array_to_string(vals, '|') AS vals FROM f3 UNION ALL SELECT 'catalogue', code, array_to_string(vals, '|') FROM catf",
    "category_fallback": TEXTS + f""", h AS (SELECT f3.* REPLACE (form AS cform, spaced AS cspaced), false AS cap_panel FROM f3), g AS (SELECT *, {op._HV} AS high FROM h)
        SELECT cname, volt, CASE WHEN contains(cname, '支給') THEN 'supplied' WHEN contains(cname, 'スペース') OR contains(cname, 'SP') THEN 'space' ELSE 'bought' END AS class_label,
        high, CASE WHEN part IN ('TR', 'SC', 'SR') AND want IS NOT NULL THEN {op._KBN} END AS ladder FROM g""",
    "alias_classify": TEXTS + " SELECT part, count(*) AS n_texts, CAST(sum(n_items) AS BIGINT) AS n_items FROM f3 GROUP BY part",
    "display_compose": P + f""", l AS (SELECT doc_id, panel_idx, parent_idx, string_agg(load, ', ' ORDER BY item_idx) AS loads FROM dets WHERE parent_idx IS NOT NULL GROUP BY ALL)
        SELECT k.item_idx, coalesce({_FEED}, '') AS feed, trim(CASE WHEN {_FEED} IS NOT NULL AND starts_with(name, {_FEED}) THEN trim(substr(name, length({_FEED}) + 1)) ELSE name END
          || CASE WHEN {_FEED} IS NOT NULL THEN ' 〈' || {_FEED} || '〉' ELSE '' END || CASE WHEN l.loads IS NOT NULL THEN '(' || l.loads || ')' ELSE '' END) AS display
        FROM kept k LEFT JOIN l ON l.doc_id = k.doc_id AND l.panel_idx = k.panel_idx AND l.parent_idx = k.item_idx""",
    "exclude_patterns": P + " SELECT item_idx, state FROM stated",
    "grade_filter": P + " SELECT item_idx, code, conf FROM graded WHERE conf = '○'",
    "code_lookup": """SELECT l_orderkey AS ord, count(*) AS n, sum(l_quantity) AS qty, any_value(p_name) AS p_name, any_value(p_brand) AS p_brand
        FROM lineitem LEFT JOIN part ON p_partkey = l_orderkey GROUP BY l_orderkey""",
    "code_exists_semi": "SELECT l_orderkey AS ord, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_orderkey IN (SELECT p_partkey FROM part) GROUP BY l_orderkey",
    "code_missing_anti": "SELECT l_orderkey AS ord, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_orderkey",
    "nearest_above_join": _NEAREST,
    "nearest_above_window": _NEAREST,
    "ladder_round_clamp": f"""SELECT l_quantity AS value, {_round('direct')} AS direct, l_quantity > {max(rules.MOTOR_SUFFIX['direct'])} AS clamped, {_round('inverter')} AS inverter,
        CAST({_FRAME} AS BIGINT) AS frame, count(*) AS n FROM (SELECT l_quantity, CAST(floor(l_extendedprice / 30) AS BIGINT) AS af, CAST(l_quantity * 10 AS BIGINT) AS att FROM lineitem) GROUP BY ALL""",
    "bucket_range_join": f"SELECT CASE {_SPLIT_PRICE} END AS label, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL",
    "decision_table_join": _FRAMES + f" SELECT item_idx, kind, frame, {op.mapping(op._MAINS, 'kind || chr(124) || CAST(frame AS VARCHAR)')} AS code FROM b",
    "first_existing_key": _FRAMES + f""", cat AS MATERIALIZED ({views.CATALOGUE.format(part='part')}), tried AS MATERIALIZED (SELECT DISTINCT kind, frame, pole, elb,
          unnest(CASE WHEN kind = 'control' THEN [{', '.join(f"{{'p': {i}, 'c': {_branch(x)}}}" for i, x in enumerate(('50', '40', '60')))}]
            ELSE [{', '.join(f"{{'p': {i}, 'c': {_branch(x)}}}" for i, x in enumerate(('40', '60', '50')))}] END) AS k FROM b),
        found AS (SELECT t.kind, t.frame, t.pole, t.elb, arg_min(t.k.c, t.k.p) AS code FROM tried t JOIN cat ON cat.code = t.k.c GROUP BY ALL)
        SELECT b.item_idx, b.kind, b.frame, found.code FROM b LEFT JOIN found ON b.kind = found.kind AND b.frame IS NOT DISTINCT FROM found.frame AND b.pole = found.pole AND b.elb = found.elb""",
    "interval_contains_join": TEXTS + """, s AS (SELECT lo, hi, count(*) AS n_codes FROM catf WHERE lo IS NOT NULL GROUP BY ALL),
        p AS (SELECT ratio, CAST(sum(n_items) AS BIGINT) AS n_items FROM f3 WHERE ratio IS NOT NULL GROUP BY ratio) SELECT ratio, n_items, lo, hi, n_codes FROM p JOIN s ON ratio BETWEEN lo AND hi""",
    "token_overlap_topk": f"""WITH i AS ({_tok('item_id', 'text', 'benchmark')}), r AS ({_tok('doc_id', 'text', 'documents')}),
        h AS (SELECT DISTINCT item_id, doc_id AS ord FROM i JOIN r USING (tok))
        SELECT item_id, ord, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS rn FROM h QUALIFY rn <= 25""",
    "token_contains_topk": f"""{_ITEMS}, cat AS ({views.CATALOGUE.format(part='part')}), r AS (SELECT ord, {op.norm('name')} AS form FROM cat),
        i AS (SELECT DISTINCT name AS cname FROM items),
        k AS (SELECT DISTINCT cname, {op.norm('w')} AS tok FROM (SELECT cname, unnest(string_split_regex(cname, '[\\s　()（）]')) AS w FROM i) WHERE length(w) >= 2),
        h AS (SELECT DISTINCT cname, ord FROM k JOIN r ON contains(form, tok))
        SELECT cname, ord, row_number() OVER (PARTITION BY cname ORDER BY ord) AS rn FROM h QUALIFY rn <= 25""",
    "closed_world_check": """SELECT o_orderkey, CASE WHEN p_partkey IS NOT NULL THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS code, coalesce(p_name, '') AS name,
        CASE WHEN p_partkey IS NOT NULL AND o_orderstatus = 'F' THEN '○' ELSE '△' END AS conf FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND o_orderstatus IN ('F', 'O')""",
    "catalogue_arrays": """SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS ord,
        p_partkey % 7 < 2 AS failed, CASE WHEN p_partkey % 7 < 2 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS code,
        CASE p_partkey % 7 WHEN 0 THEN '{"name":"' || p_name || '"}' WHEN 1 THEN '' ELSE p_name END AS name, '' AS volt,
        CASE WHEN p_partkey % 7 < 2 THEN '' ELSE p_type END AS kind, '' AS spec FROM part""",
    "required_attrs_table": """SELECT l_orderkey, l_linenumber,
        concat_ws('|', CASE WHEN NOT regexp_matches(text, '(^| )' || size || 'A') THEN 'size' END,
            CASE WHEN NOT contains(lower(text), lower(brand)) THEN 'brand' END) AS required,
        CASE WHEN regexp_matches(text, '(?i)[ar]$') THEN '' ELSE 'mode' END AS optional
        FROM (SELECT l_orderkey, l_linenumber, p_type, p_brand || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'A ' || l_returnflag AS text
              FROM lineitem JOIN part ON l_partkey = p_partkey)
        JOIN (SELECT p_type, min(p_size) AS size, min(p_brand) AS brand FROM part GROUP BY p_type) USING (p_type)""",
    "required_attrs": TEXTS + f" SELECT cname, volt, part, array_to_string({op._lacking(True)}, '|') AS required, array_to_string({op._lacking(False)}, '|') AS optional FROM f3",
    "recipe_expand": f"""WITH {op.BASE.strip()[:op.BASE.strip().index('catf AS (')]}
        known AS (SELECT list(code) AS known FROM cat WHERE code IN ({', '.join(repr(c) for c in rules.rule_codes())})),
        g AS (SELECT name, symbol, kw, volt, count(*) AS n FROM items WHERE symbol <> '' GROUP BY ALL),
        a AS (SELECT g.*, coalesce(r.seq, 0) AS seq, coalesce(r.q, 1) AS q, r.dev, TRY_CAST(coalesce(nullif(g.kw, ''), {op.grab('lower(name)', r'(\d+\.\d+|\d+)\s*kw')}) AS DOUBLE) AS v
          FROM g LEFT JOIN {op._recipe()} ON r.sym = upper(trim(g.symbol))),
        b AS (SELECT a.*, (SELECT min(s.step) FROM {op._STEPS} WHERE s.dev = a.dev AND s.step >= a.v) AS fit, (SELECT max(s.step) FROM {op._STEPS} WHERE s.dev = a.dev) AS top FROM a),
        c AS (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(fit, top) END AS step, coalesce(v > top, false) AS clamped FROM b),
        e AS (SELECT *, coalesce({op.mapping(op._MOTOR, "dev || '|' || CASE WHEN volt = '400V' THEN '400V' ELSE '200V' END || '|' || " + op._kw_key('step') + " || '|' || CAST(contains(name, '支給') AS VARCHAR)")}, '') AS c0 FROM c),
        o AS (SELECT e.*, CASE WHEN list_contains(known, c0) THEN c0 ELSE '' END AS code, upper(trim(symbol)) AS sign,
            count(*) OVER (PARTITION BY name, symbol, kw, volt) AS devices FROM e CROSS JOIN known)
        SELECT o.name, symbol, kw AS given, o.volt, n, seq, o.code, q AS qty, CAST(step AS DOUBLE) AS step, clamped,
          coalesce((SELECT arg_max(c.name, c.ord) FROM cat c WHERE c.code = o.code), '') AS part_name,
          CASE WHEN dev IS NULL AND sign IN ({', '.join(repr(s) for s in rules.SYMBOL_RECIPES)}) THEN 'symbol ' || sign || ': supply only'
            WHEN dev IS NULL THEN 'symbol ' || sign || ' unknown, check'
            ELSE CASE dev WHEN 'direct' THEN 'direct starter' WHEN 'stardelta' THEN 'star-delta starter' ELSE 'inverter' END
              || CASE WHEN seq > 0 THEN ' as bypass' ELSE '' END
              || CASE WHEN v IS NULL THEN '' WHEN o.code = '' THEN ' ' || {op._kw_key('v')} || ' kW'
                   WHEN devices = 1 THEN ' ' || {op._kw_key('v')} || ' -> ' || {op._kw_key('step')} || ' kW' ELSE ' ' || {op._kw_key('step')} || ' kW' END
              || CASE WHEN q > 1 THEN ' x' || q ELSE '' END || CASE WHEN o.code = '' THEN ', check' ELSE '' END END AS part_note
        FROM o""",
    "group_promotion": P + """ SELECT cname, volt, symbol, kw, grp, kind AS panel_kind, tb_control, cap_panel AS capacitor_panel, after_main, rule, code, conf FROM settled WHERE grp <> ''""",
    "candidate_topk": TEXTS + f" SELECT cname, volt, n_items, c.rn, c.ord, c.code, c.score FROM {_JOIN.format('ranked')}",
    "attr_score": TEXTS + f" SELECT cname, volt, c.rn, c.value_score AS score FROM {_JOIN.format('ranked')}",
    "option_bonus": TEXTS + f" SELECT cname, volt, c.rn, c.option_score AS bonus FROM {_JOIN.format('ranked')}",
    "residual_explain": TEXTS + f""", t AS (SELECT f3.cname, f3.volt, f3.vals, c.code, r.name, r.vals AS tvals, r.lo, r.hi FROM {_JOIN.format('ranked')} JOIN catf r ON r.ord = c.ord WHERE c.rn = 1)
        SELECT cname, volt, code, len(list_filter(vals, lambda v: list_contains(tvals, v))) AS n_matched, array_to_string(list_sort(list_filter(list_filter(vals, lambda v: NOT list_contains(tvals, v)),
          lambda v: NOT ((ends_with(v, '/5A') AND coalesce(len(list_filter(vals, lambda r: ends_with(r, '/5A') AND TRY_CAST(replace(r, '/5A', '') AS BIGINT) BETWEEN lo AND hi)) > 0, false))
            OR (ends_with(v, 'P') AND NOT regexp_matches(name, '[234]P'))
            OR (ends_with(v, 'V') AND len(list_filter(vals, lambda r: list_contains(tvals, r) AND ends_with(r, 'φ'))) > 0 AND len(list_filter(vals, lambda r: list_contains(tvals, r) AND ends_with(r, 'KVA'))) > 0)))), '|') AS missing FROM t""",
    "candidate_options": TEXTS + f""", o AS (SELECT f3.cname, f3.volt, c.cands, coalesce(c.cands[3], c.cands[1]) AS ch FROM {_LEFT.format('cands')})
        SELECT cname, volt, CASE WHEN ch IS NULL THEN '' ELSE array_to_string(list_concat([ch.code || '（' || ch.name || '）'], list_transform(list_filter(cands[1:5], lambda c: c.code <> ch.code), lambda c: c.code || '（' || c.name || '）')), '|') END AS labels FROM o""",
    "first_match_in_ranked": TEXTS + f""", o AS (SELECT f3.cname, f3.volt, list_filter(c.cands, lambda c: contains(c.name, '標準') OR contains(c.name, '静止型'))[1] AS h FROM {_LEFT.format('cands')})
        SELECT cname, volt, h.rn AS rn, h.code AS code FROM o""",
    "decision_list": P + " SELECT doc_id, panel_idx, item_idx, qty, part, rule, code, conf, carried, gone AS absorbed FROM graded",
    "grade_summary": P + f", s AS ({_summary('graded')}) SELECT *, {_RATE} AS rate FROM s",
    "input_counts": f"{_ITEMS} SELECT count(*) AS n_items, count(DISTINCT doc_id * 10 + panel_idx) AS n_panels, count(DISTINCT doc_id) AS n_docs FROM items",
    "review_diff": P + """, v AS (SELECT panel, code, CASE WHEN conf = '△' THEN coalesce(CASE WHEN carried OR by_symbol THEN NULL ELSE cands[2].code END, '') ELSE code END AS final FROM graded)
        SELECT panel, count(*) AS n_rows, count(*) FILTER (final <> '' AND final <> code) AS n_changed FROM v GROUP BY panel""",
    "lag_flag": _EV + """ SELECT item_idx, coalesce(lag(event_type = 'error') OVER (PARTITION BY doc_id, panel_idx ORDER BY item_idx), false) AS after_error FROM ev WHERE event_type <> 'view'""",
    "carry_forward": _EV + """ SELECT doc_id, item_idx, event_type, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY panel_idx, item_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM ev""",
    "attach_details": _EV + """, p AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN item_idx END IGNORE NULLS) OVER (PARTITION BY doc_id, panel_idx ORDER BY item_idx) AS parent FROM ev)
        SELECT parent AS item_idx, string_agg(printf('%.2f', value), ', ' ORDER BY item_idx) AS loads, count(*) AS n_loads FROM p WHERE event_type = 'view' AND parent IS NOT NULL GROUP BY doc_id, panel_idx, parent""",
    "group_suppress": _EV + """, g AS (SELECT *, event_type = 'click' AND bool_or(event_type = 'error' AND value > 20) OVER (PARTITION BY doc_id, panel_idx) AS gone FROM ev)
        SELECT item_idx, gone AS absorbed, CASE WHEN gone THEN '—' ELSE '◎' END AS conf FROM g""",
    "row_numbering": _EV + " SELECT item_idx, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY panel_idx, item_idx) AS gid FROM ev WHERE event_type <> 'view'",
}
