"""DuckDB SQL for the item pipeline, written from the definitions: every item set is
compared with every catalogue row of its part, rules are one CASE, context is plain windows.
"""

from __future__ import annotations

from catamatch import rules
from catamatch.functions import text as t
from catamatch.plans import views

_DROP = r"[ー\-\s　()（）\[\]、,．.]"
_END = r"([^\pL\pN_]|$)"


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '{_DROP}', '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def grab(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def strings(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def mapping(pairs: dict, key: str) -> str:
    return "(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "})[" + key + "]"


def values(x: str, volt: str | None = None) -> str:
    def every(p, tag, group=1, before=""):
        return f"list_transform(regexp_extract_all({x}, '{p}', {group}), lambda v: '{before}' || v || '{tag}')"

    def flag(p, tag, on=x):
        return f"CASE WHEN {has(on, p)} THEN ['{tag}'] ELSE []::VARCHAR[] END"
    g = [every(r"(\d)P([^a-zA-Z0-9]|$)", "P"), every(r"(\d{2,3})P([^a-zA-Z]|$)", "P"),
         every(r"(\d+)\s*AF", "AF"), every(r"(\d+)\s*AT", "AT"),
         f"CASE WHEN {has(x, 'MCB|ELB|LUG|MCCB')} THEN {every(r'(\d+)\s*A([^A-Za-z]|$)', 'AF')} ELSE []::VARCHAR[] END",
         flag(r"(?i)7\.2kV|6\.6kV|6kV", "HV"), flag("415|440", "400V"), flag("210|220", "200V"), flag("105|100V", "100V"),
         every(r"(?i)(\d+\.?\d*)\s*kW", "kW"), every(r"(?i)(\d+\.?\d*)\s*kvar", "kvar"), every(r"(\d+\.?\d*)\s*kVA", "kVA"),
         every(r"(\d+)/5A", "/5A"), every(r"(^|[^/\d])(\d{2,4})A([^A-Za-z]|$)", "A", 2),
         f"list_transform(regexp_extract_all({x}, '(?i)(\\d+\\.?\\d*)kA', 1), lambda v: regexp_replace(v, '\\.0*$', '') || 'kA')",
         every(r"(\d)D([^a-z]|$)", "D"), flag("(?i)amp", "AMP"), flag("(?i)mix", "MIX"), every(r"(\d+)回路", "回路"),
         flag("片切", "片切"), flag("両切", "両切"), flag("(?i)6a", "6A"), flag("調光", "調光"), flag("接点入力", "接点入力"),
         every("([13])[φΦ]", "φ"), every(r"(?i)(\d+)\s*KVA", "KVA"), every(r"(?i)PF=?(\d+)A", "A", 1, "PF"),
         flag("(?i)(クラス|保護レベル|class)i([^i]|$)", "クラスi"), flag("(?i)(クラス|保護レベル|class)ii", "クラスii"),
         every(r"(\d+)KA", "ka")]
    if volt:
        g += [flag("(?i)kv", "HV", volt)] + [flag(v, v + "V", volt) for v in ("400", "200", "100")]
    return f"list_sort(list_distinct(flatten([{', '.join(g)}])))"


def quantity(x: str) -> tuple[str, str]:
    """(text, qty) SQL."""
    three = f"({has(x, r'(?i)(^|[^a-z])ds([^a-z]|$)')} AND {has(x, r'[xX×]\s*3' + _END)})"
    bare = f"trim(regexp_replace({x}, '[xX×]\\s*3{_END}', '\\1', 'g'), ' ,、')"
    count = rf"(?i)(kw|kva|kvar|kvr)?\s*[x×]\s*(\d{{1,3}}){_END}"
    n = f"CASE WHEN regexp_extract({x}, '{count}', 1) = '' THEN {grab(x, count, 2)} END"
    rest = f"trim(regexp_replace({x}, '[xX×]\\s*\\d{{1,3}}{_END}', '\\1'), ' ,、')"
    text = (f"CASE WHEN {three} THEN CASE WHEN {has(bare, '(?i)[123]p')} THEN {bare} ELSE {bare} || ' 3P' END "
            f"WHEN ({n}) IS NOT NULL THEN {rest} ELSE {x} END")
    return text, f"CASE WHEN NOT {three} THEN {n} END"


def part_case(form: str) -> str:
    def hit(k):
        return f"contains({form}, '{k}')" if len(k) > 2 else has(form, f"(^|[^a-z]){k}([^a-z]|$)")
    return (f"CASE WHEN {has(form, '^(mccb|mcb)')} THEN 'MCB' WHEN {has(form, '^(elcb|elb)')} THEN 'ELB' "
            f"WHEN {has(form, '^lug')} THEN 'LUG' WHEN ({has(form, '^t:')} OR ({has(form, '[13]φ')} AND "
            f"{has(form, r'\d+kva')} AND NOT contains({form}, 'kvar'))) AND NOT {has(form, '(^|[^a-z])(sc|sr)([^a-z]|$)')} THEN 'TR' "
            + " ".join(f"WHEN {hit(t.squeeze_literal(a))} THEN '{p}'" for a, p in rules.aliases()) + " END")


def any_alias(form: str) -> str:
    keys = [t.squeeze_literal(a) for a, _ in rules.aliases()]
    short = "|".join(k for k in keys if len(k) <= 2)
    return "(" + any_of(form, [k for k in keys if len(k) > 2]) + f" OR {has(form, f'(^|[^a-z])({short})([^a-z]|$)')})"


def band_item(volt: str, form: str, spaced: str) -> str:
    return (f"CASE WHEN {volt} IN ('HV', '400V', '200V', '100V') THEN {volt} WHEN {has(spaced, r'6kv|6\.6kv|7\.2kv|12\.5')} THEN 'HV' "
            f"WHEN {has(form, '415|440')} THEN '400V' WHEN {has(form, '210|220')} THEN '200V' "
            f"WHEN {has(form, '105|100v')} THEN '100V' ELSE '' END")


def band_cat(volt: str) -> str:
    return (f"CASE WHEN contains(lower({volt}), 'kv') THEN 'HV' WHEN contains({volt}, '400') THEN '400V' "
            f"WHEN contains({volt}, '200') THEN '200V' WHEN contains({volt}, '100') THEN '100V' ELSE '' END")


def options(x: str, form: str, words=rules.OPTION_WORDS) -> tuple[str, str]:
    """(main, opts) SQL."""
    b = r"[（(]([^（）()]*)[）)]"
    bare = f"trim(regexp_replace({x}, '{b}', '', 'g'))"
    toks = f"list_filter(string_split_regex({bare}, '[\\s　,、]'), lambda w: ends_with(w, '付') AND length(w) > 1)"
    main = f"list_reduce(list_concat([{bare}], {toks}), lambda acc, w: trim(replace(acc, w, '')))"
    named = f"list_concat(list_transform(regexp_extract_all({x}, '{b}', 1), lambda v: trim(v)), {toks})"
    pairs = "[" + ", ".join(f"{{'w': '{w}', 'n': '{t.squeeze_literal(w)}'}}" for w in dict.fromkeys(words)) + "]"
    forms = f"list_transform({named}, lambda v: {norm('v')})"
    known = (f"list_transform(list_filter({pairs}, lambda p: contains({form}, p.n) AND NOT list_contains({forms}, p.w)), "
             "lambda p: p.w)")
    return main, f"list_concat({named}, {known})"


def excluded(raw: str, form: str, cable: str) -> str:
    out = [f"({cable})", f"({has(form, rules.CABLE_PATTERN)} AND NOT {any_alias(form)})"]
    for p, on_raw, keep in rules.FUSE_RULES:
        p = p.replace(r"\p{L}", r"\pL").replace(r"\p{N}", r"\pN")
        hit = has(raw if on_raw else form, p)
        out.append(f"({hit} AND NOT {has(form, keep)})" if keep else hit)
    return "(" + " OR ".join(out) + ")"


_KNOWN = [(p, t.squeeze_literal(p), prefix) for p, _, prefix in rules.parts()] + [("LUG", "lug", True)]
_MAIN, _OPTS = options("qname", "form")
_TEXT, _QTY = quantity("name")
_TEXT2, _ = quantity("regexp_replace(cname, '(?i)vgb', 'VCB', 'g')")
_STD = [str(v) for v in rules.STANDARD_AMPS]


def _std(v: str) -> str:
    tries = [f"CASE WHEN {v} IN ({', '.join(repr(s) for s in _STD)}) THEN {v} END"]
    tries += [f"CASE WHEN left({v}, {n}) IN ({', '.join(repr(s) for s in _STD if len(s) == n)}) THEN left({v}, {n}) END"
              for n in (4, 3, 2)]
    return f"coalesce({', '.join(tries)})"


BASE = f"""
items AS ({views.ITEMS.format(orders='orders')}),
cat AS ({views.CATALOGUE.format(part='part')}),
catf AS (SELECT *, {norm('name')} AS form, {band_cat('volt')} AS band, {values('name', 'volt')} AS vals,
   list_filter([{', '.join(f"CASE WHEN {'starts_with' if pre else 'contains'}({norm('name')}, '{k}') THEN '{p}' END" for p, k, pre in _KNOWN)}],
     lambda p: p IS NOT NULL) AS parts,
   TRY_CAST({grab('name', r'(\d+)/5A\s*[~〜\-]\s*(\d+)/5A', 1)} AS BIGINT) AS lo, TRY_CAST({grab('name', r'(\d+)/5A\s*[~〜\-]\s*(\d+)/5A', 2)} AS BIGINT) AS hi
  FROM cat),
marked AS (SELECT *, {norm('name')} AS form, {norm('panel')} AS pform FROM items),
stated AS (SELECT *, CASE WHEN load_detail THEN 'detail' WHEN {excluded('name', 'form', 'cable')} THEN 'excluded' ELSE 'kept' END AS state,
   {has('form', 'm(mcb|lug)')} AND NOT contains(left(form, 3), 'tb') AS is_main FROM marked),
kept0 AS (SELECT *, coalesce(lag(is_main) OVER (PARTITION BY doc_id, panel_idx ORDER BY item_idx), false) AS after_main,
   {_TEXT} AS qtext, {_QTY} AS qn FROM stated WHERE state = 'kept'),
kept AS (SELECT * REPLACE (coalesce(qn, qty) AS qty), CASE WHEN qn IS NOT NULL THEN qtext ELSE name END AS cname,
   CASE WHEN {any_of('pform', ('制御', '動力'))} THEN 'control' WHEN {any_of('pform', ('分電', '電灯'))} THEN 'lighting'
     WHEN {any_of('pform', ('配電', '受電', '高圧'))} THEN 'receiving' ELSE 'lighting' END AS kind,
   {any_of('pform', rules.TB_CONTROL_WORDS)} AS tb_control,
   contains(panel, '高圧') AND contains(panel, 'コンデンサ') AS cap_panel FROM kept0),
ctx AS (SELECT DISTINCT cname, volt, symbol, kw, grp, kind, tb_control, cap_panel, after_main FROM kept),
f0 AS (SELECT *, {_TEXT2} AS qname, {norm('cname')} AS cform, regexp_replace(lower(cname), '\\s', '', 'g') AS cspaced FROM ctx),
f1 AS (SELECT *, {norm('qname')} AS form, regexp_replace(lower(qname), '\\s', '', 'g') AS spaced FROM f0),
f2 AS (SELECT *, {_MAIN} AS main_text, {_OPTS} AS opts, {band_item('volt', 'form', 'spaced')} AS band, {values('qname')} AS vals,
   TRY_CAST({grab('lower(qname)', r'(\d+\.\d+|\d+)\s*kw')} AS DOUBLE) AS kwt, TRY_CAST({grab('qname', r'(?i)(\d+\.?\d*)\s*k?var?')} AS DOUBLE) AS want,
   TRY_CAST({grab('form', r'(\d+)/5a')} AS BIGINT) AS ratio FROM f1),
f3 AS (SELECT *, {part_case(norm('main_text'))} AS part FROM f2),
sets AS (SELECT DISTINCT part, band, form, vals, opts FROM f3),
pairs AS (SELECT s.*, c.ord, c.code, c.name, c.volt AS cvolt,
   list_filter(s.vals, lambda v: list_contains(c.vals, v)) AS inter, list_filter(s.vals, lambda v: NOT list_contains(c.vals, v)) AS miss,
   coalesce(len(list_filter(s.vals, lambda v: ends_with(v, '/5A') AND TRY_CAST(replace(v, '/5A', '') AS BIGINT) BETWEEN c.lo AND c.hi)) > 0, false) AS in_range,
   CASE WHEN s.band = c.band AND s.band <> '' THEN 6 ELSE 0 END AS eq, c.form AS nform
  FROM sets s JOIN catf c ON (s.part IS NULL OR list_contains(c.parts, s.part)) AND (s.band = '' OR c.band = '' OR s.band = c.band)),
scored AS (SELECT *,
   len(inter) * 10 - len(miss) * 8 + CASE WHEN in_range AND len(list_filter(miss, lambda v: ends_with(v, '/5A'))) > 0
     THEN 10 + 8 * len(list_filter(miss, lambda v: ends_with(v, '/5A'))) ELSE 0 END AS value_score,
   5 * len(list_filter(opts, lambda o: {norm('o')} <> '' AND contains(nform, {norm('o')})))
   {' '.join(f"- CASE WHEN contains(nform, '{w}') AND NOT contains(form, '{w}') THEN 4 ELSE 0 END" for w in map(t.squeeze_literal, rules.SPECIAL_WORDS))}
   + CASE WHEN {any_of('form', map(t.squeeze_literal, rules.SPECIAL_IN_DRAWING))} THEN 0 ELSE
     {' + '.join(f"CASE WHEN contains(nform, '{w}') THEN 4 ELSE 0 END" for w in map(t.squeeze_literal, rules.DEFAULT_WORDS))} END AS option_score,
   CASE WHEN len(opts) = 0 AND {any_of('name', rules.EXTRA_WORDS)} THEN -3 ELSE 0 END AS extra_score FROM pairs),
ranked AS (SELECT part, band, form, vals, opts, ord, code, name, cvolt, value_score, option_score, eq,
   10 + eq + value_score + option_score + extra_score AS score,
   row_number() OVER (PARTITION BY part, band, form, vals, opts ORDER BY 10 + eq + value_score + option_score + extra_score DESC, ord) AS rn
  FROM scored QUALIFY rn <= 8),
cands AS (SELECT part, band, form, vals, opts, list({{'rn': rn, 'code': code, 'name': name, 'volt': cvolt}} ORDER BY rn) AS cands
  FROM ranked GROUP BY ALL),
"""

_AMP = grab("cform", r"(\d+)a")
_AF0, _AT0 = grab("cform", r"(\d+)af"), grab("cform", r"(\d+)at")
_PAF, _PAT = grab("cform", r"[234]p(\d{2,4})(/(\d{2,4}))?", 1), grab("cform", r"[234]p(\d{2,4})(/(\d{2,4}))?", 3)
_LAF, _LAT = grab("cform", r"(\d{2,4})/(\d{2,4})", 1), grab("cform", r"(\d{2,4})/(\d{2,4})", 2)
_MOTOR = {f"{k}|{b}|{kw:g}|{str(s).lower()}": c for (k, b, kw, s), c in rules.motor_codes().items()}
_FR = rules.STANDARD_FRAMES


def _kw_key(x: str) -> str:
    return f"regexp_replace(printf('%.6f', {x}), '\\.?0+$', '')"


def _motor(kind: str, band: str, kw: str, own: str) -> str:
    return mapping(_MOTOR, f"'{kind}|' || {band} || '|' || {_kw_key(kw)} || '|' || CAST({own} AS VARCHAR)")


_MAINS = {f"{k}|{a}": c for (k, a), c in rules.main_codes().items()}
_DIG = {str(k): v for k, v in rules.FRAME_DIGIT.items()}
_SUF = {f"{p}|{str(e).lower()}": s for (p, e), s in rules.BRANCH_SUFFIX.items()}


def _branch(base: str) -> str:
    code = f"'{base}' || {mapping(_DIG, 'frame')} || {mapping(_SUF, 'bpole || chr(124) || CAST(elb AS VARCHAR)')}"
    return f"CASE WHEN list_contains(known, {code}) THEN {code} END"


_HV = (f"CASE WHEN part IN ('SR', 'SC') AND cap_panel THEN true WHEN part = 'TR' AND "
       f"{has('cform', r'6600v|66kv|3300v|33kv|72kv|702kv|\dkv/')} THEN true "
       f"WHEN {has('cspaced', r'(^|[^.\d])(100|105|200|210|400|415)v([^a-z]|$)')} THEN false "
       f"WHEN {has('cspaced', r'\dkv([^a-z]|$)|6600v|3300v')} THEN true "
       f"ELSE part = 'TR' OR (part = 'SC' AND NOT contains(cform, 'kvar')) END")
_KBN = ("CASE WHEN contains(cname, '支給') THEN 'S' WHEN contains(cname, 'スペース') OR contains(cname, 'SP') THEN 'P' "
        "WHEN high THEN 'S' ELSE 'N' END")


def _res(rule: str, code: str, conf: str, note: str) -> str:
    """``note``: SQL, or the text itself after a colon."""
    note = f"'{note[1:]}'" if note.startswith(":") else note
    return f"{{'rule': '{rule}', 'code': {code}, 'conf': '{conf}', 'note': {note}}}"


_S, _N, _C = rules.SURE, rules.NEARLY, rules.CHECK
_TBC = mapping({str(k): v for k, v in rules.TB_CONTROL.items()}, "amp")
_TBG = mapping({str(k): v for k, v in rules.TB_GENERAL.items()}, "amp")
_CTL = mapping({str(k): v for k, v in rules.CT_LV.items()}, "CAST(ratio AS VARCHAR)")
_CTH = "CASE WHEN ratio <= 0 THEN NULL WHEN ratio <= 40 THEN '44121' WHEN ratio <= 75 THEN '44122' WHEN ratio <= 200 THEN '44123' END"


def _ds(pole: str) -> str:
    return (f"list_filter(cands, lambda c: contains(c.name, '{pole}') AND contains(c.name, ds_amp || 'A') "
            "AND contains(c.name, '標準'))[1].code")


_TB = ":terminal block of a "
_BREAKER = ("CASE WHEN main_b THEN 'main ' ELSE 'branch ' END || CASE WHEN contains(cform, 'elb') THEN 'ELB' ELSE 'MCB' END "
            "|| ' by panel kind and frame'")
_CHAIN = [
    (f"part = 'TB' AND after_main AND tb_control AND list_contains(known, {_TBC})", _res("R1", _TBC, _N, _TB + "control panel main")),
    (f"part = 'TB' AND after_main AND list_contains(known, {_TBG})", _res("R1", _TBG, _N, _TB + "main breaker")),
    ("part = 'TB' AND after_main", _res("R1", "''", _C, _TB + "main breaker, check the rating")),
    ("part = 'TB'", _res("R2", "''", _N, ":terminal block contained in the branch unit")),
    (f"contains(cform, 'spd用') AND {has('cform', 'mcb|mccb')} AND af IS NULL", _res("R3", "''", _C, ":breaker for a surge device without rating")),
    ("breaker_part AND breaker IS NOT NULL", _res("R4", "breaker", _S, _BREAKER)),
    ("breaker_part", _res("R4", "''", _C, ":breaker rating or panel kind to check")),
    ("motor IS NOT NULL", _res("R5", "CASE WHEN list_contains(known, motor) THEN motor ELSE '' END", _C, ":motor set")),
    (f"part = 'CT' AND ratio IS NOT NULL AND band = 'HV' AND list_contains(known, {_CTH})", _res("R6", _CTH, _N, ":high-voltage CT by ratio")),
    (f"part = 'CT' AND ratio IS NOT NULL AND band IN ('400V', '200V', '100V') AND list_contains(known, {_CTL})",
     _res("R6", _CTL, _N, ":low-voltage CT by ratio")),
    ("part = 'CT' AND ratio IS NOT NULL", _res("R6", "''", _C, ":CT ratio or band to check")),
    ("sized AND fit IS NOT NULL AND abs(fit.c - want) < 1e-6", _res("R7", "fit.k", _S, ":capacity equal")),
    ("sized AND fit IS NOT NULL", _res("R7", "fit.k", _N, f"'capacity raised to ' || {_kw_key('fit.c')}")),
    ("sized AND top_cap IS NOT NULL", _res("R7", "''", _C, f"'capacity above the largest, ' || {_kw_key('top_cap')}")),
    ("sized", _res("R7", "''", _C, ":no row of this capacity series")),
    ("part IS NULL", _res("R8", "''", _C, "'part not identified, ' || CAST(n AS VARCHAR) || ' candidates'")),
    (f"ds AND contains(form, '3p') AND {_ds('3P')} IS NOT NULL", _res("R9", _ds("3P"), _N, ":three-pole standard disconnector")),
    (f"ds AND NOT {has('form', '[123]p')} AND coalesce({_ds('3P')}, {_ds('1P')}) IS NOT NULL",
     _res("R10", f"coalesce({_ds('3P')}, {_ds('1P')})", _C, ":pole number to check")),
    ("lgr AND NOT two AND list_contains(known, '46401')", _res("R11", "'46401'", _S, ":leak relay with detector")),
    ("lgr AND two AND list_contains(known, '46403')", _res("R11", "'46403'", _N, ":two-stage leak relay")),
    ("n = 0", _res("R12", "''", _C, ":no catalogue row")),
    (has("cform", "(^|[^a-z])vmc([^a-z]|$)"), _res("R13", "top.code", _C, ":VMC read as VCS")),
    ("n = 1", _res("R14", "top.code", _S, ":only candidate")),
    ("len(missing) = 0 AND (matched > 0 OR opt_hit OR default_top)", _res("R15", "top.code", _N, "CASE WHEN matched > 0 THEN 'values agree' "
     "WHEN opt_hit THEN 'option agrees' ELSE 'standard type' END")),
    ("len(missing) > 0", _res("R15", "top.code", _C, "'not explained: ' || array_to_string(list_sort(missing), ', ')")),
]
_SPEC = rules.attr_spec()


def _lacking(required: bool) -> str:
    cases = []
    for cls in dict.fromkeys(s[0] for s in _SPEC):
        checks = [f"CASE WHEN NOT {has('cname', '(?i)' + p)} THEN '{a}' END" for c, a, r, p in _SPEC if c == cls and r == required]
        if checks:
            cases.append(f"WHEN part = '{cls}' THEN list_filter([{', '.join(checks)}], lambda a: a IS NOT NULL)")
    return f"CASE {' '.join(cases)} ELSE []::VARCHAR[] END"


def _recipe() -> str:
    rows = []
    for sym, devices in rules.SYMBOL_RECIPES.items():
        for i, (kind, qty) in enumerate(devices):
            rows.append(f"('{sym}', {i}, {repr(kind) if kind else 'NULL'}, {qty})")
    return "(VALUES " + ", ".join(rows) + ") AS r(sym, seq, dev, q)"


_STEPS = "(VALUES " + ", ".join(f"('{k}', {float(s)})" for k, steps in rules.MOTOR_SUFFIX.items() for s in steps) + ") AS s(dev, step)"

RULES = f"""
known AS (SELECT list(code) AS known FROM cat WHERE code IN ({', '.join(repr(c) for c in rules.rule_codes())})),
g0 AS (SELECT f3.*, c.cands, coalesce(len(c.cands), 0) AS n, c.cands[1] AS top, k.known, {_AMP} AS amp,
   {_AF0} AS af0, {_std(_AT0)} AS at0, {_PAF} AS paf, {_std(_PAT)} AS pat, {_LAF} AS laf, {_LAT} AS lat,
   {grab("regexp_replace(cform, '[234]p', '', 'g')", r'(\d{2,4})')} AS lone
  FROM f3 LEFT JOIN cands c ON f3.part IS NOT DISTINCT FROM c.part AND f3.band = c.band AND f3.form = c.form
    AND f3.vals = c.vals AND f3.opts = c.opts CROSS JOIN known k),
g1 AS (SELECT *, coalesce(af0, paf) AS af, CASE WHEN af0 IS NULL AND paf IS NOT NULL THEN coalesce(pat, at0) ELSE at0 END AS at1,
   part IN ({', '.join(repr(p) for p in rules.BREAKER_PARTS)}) AS breaker_part,
   contains(cname, '主幹') OR starts_with(part, 'M)') AS main_b, contains(cform, 'elb') OR part IN ('ELB', 'M)ELB', 'B)ELB') AS elb,
   coalesce({grab('cform', r'(\d)p')}, '3') AS pole, {values('top.name', 'top.volt')} AS tvals, {_HV} AS high FROM g0),
g2 AS (SELECT *, CAST(coalesce(af, laf, lone) AS BIGINT) AS af_any,
   CAST(CASE WHEN af IS NULL AND laf IS NOT NULL THEN coalesce(at1, lat) ELSE at1 END AS BIGINT) AS at_any,
   CASE WHEN pole IN ('2', '4') THEN pole ELSE '3' END AS bpole, list_filter(vals, lambda v: NOT list_contains(tvals, v)) AS miss0,
   len(list_filter(vals, lambda v: list_contains(tvals, v))) AS matched, {_KBN} AS need,
   part IN ('TR', 'SC', 'SR') AND want IS NOT NULL AS sized FROM g1),
g3 AS (SELECT *, CAST(CASE WHEN af_any IN ({', '.join(map(str, _FR))}) THEN af_any ELSE
     coalesce((SELECT min(s) FROM unnest([{', '.join(map(str, _FR))}]) AS u(s)
       WHERE s >= CASE WHEN at_any > 0 AND at_any <= af_any AND at_any <= 3200 THEN at_any ELSE af_any END), 3200) END AS VARCHAR) AS frame,
   coalesce({_motor('direct', "CASE WHEN band = '400V' THEN '400V' ELSE '200V' END", 'CASE WHEN contains(cform, chr(108) || chr(115)) AND contains(cform, chr(107) || chr(119)) THEN kwt END', 'false')},
     CASE WHEN contains(cname, 'インバータ') OR (contains(cform, 'inv') AND NOT contains(cform, 'mcb') AND NOT contains(cname, '盤'))
     THEN {_motor('inverter', "CASE WHEN band = '400V' THEN '400V' ELSE '200V' END", 'kwt', "contains(cname, '支給')")} END) AS motor,
   {has('form', '(^|[^a-z])ds([^a-z]|$)')} AS ds, {grab('form', r'(\d+)a([^a-z]|$)')} AS ds_amp,
   {has('cform', '(^|[^a-z])(lgr|lgry)([^a-z]|$)')} AS lgr, contains(cname, '2段') OR contains(cname, '警報') AS two,
   coalesce(len(list_filter(opts, lambda o: {norm('o')} <> '' AND contains({norm('top.name')}, {norm('o')}))) > 0, false) AS opt_hit,
   coalesce({any_of('top.name', rules.DEFAULT_WORDS)}, false) AS default_top,
   list_filter(miss0, lambda v: NOT ((ends_with(v, '/5A') AND coalesce(len(list_filter(vals, lambda r: ends_with(r, '/5A')
       AND TRY_CAST(replace(r, '/5A', '') AS BIGINT) BETWEEN TRY_CAST({grab('top.name', r'(\d+)/5A\s*[~〜\-]\s*(\d+)/5A', 1)} AS BIGINT)
       AND TRY_CAST({grab('top.name', r'(\d+)/5A\s*[~〜\-]\s*(\d+)/5A', 2)} AS BIGINT))) > 0, false))
     OR (ends_with(v, 'P') AND NOT {has('top.name', '[234]P')})
     OR (ends_with(v, 'V') AND len(list_filter(vals, lambda r: list_contains(tvals, r) AND ends_with(r, 'φ'))) > 0
         AND len(list_filter(vals, lambda r: list_contains(tvals, r) AND ends_with(r, 'KVA'))) > 0))) AS missing
  FROM g2),
ladder AS (SELECT *, TRY_CAST({grab('name', r'(?i)(\d+\.?\d*)\s*kvar?')} AS DOUBLE) AS cap, starts_with(code, '45') AS hrow FROM cat),
fits AS (SELECT q.part, q.cform, q.high, q.need, q.want, min({{'c': l.cap, 'k': l.code}}) FILTER (WHERE l.cap >= q.want - 1e-6) AS fit, max(l.cap) AS top_cap
  FROM (SELECT DISTINCT part, cform, high, need, want FROM g3 WHERE sized) q JOIN ladder l
   ON starts_with(l.name, q.part) AND l.hrow = q.high AND l.cap IS NOT NULL
   AND CASE q.need WHEN 'S' THEN contains(l.name, '支給品') WHEN 'P' THEN contains(l.name, 'スペース') OR contains(l.name, '(SP)')
       ELSE NOT (contains(l.name, '支給品') OR contains(l.name, 'スペース') OR contains(l.name, '(SP)')) END
   AND (q.high OR {grab('q.cform', '(200|400)v')} IS NULL OR contains(l.name, {grab('q.cform', '(200|400)v')} || 'V'))
   AND (q.part <> 'TR' OR ((NOT contains(q.cform, '3φ') OR contains(l.name, '3φ3W')) AND (NOT contains(q.cform, '1φ') OR contains(l.name, '1φ3W'))))
   AND (q.part <> 'SR' OR NOT q.high OR {grab('q.cform', r'l=?(\d+)')} IS NULL OR contains(l.name, '=' || {grab('q.cform', r'l=?(\d+)')} || '%'))
  GROUP BY ALL),
g4 AS (SELECT g3.*, fits.fit, fits.top_cap, CASE WHEN af_any IS NOT NULL THEN CASE WHEN main_b THEN
     CASE WHEN NOT elb AND pole = '3' AND list_contains(known, {mapping(_MAINS, "kind || chr(124) || frame")}) THEN {mapping(_MAINS, "kind || chr(124) || frame")} END
     ELSE CASE WHEN kind = 'control' THEN coalesce({', '.join(_branch(b) for b in ('50', '40', '60'))})
       ELSE coalesce({', '.join(_branch(b) for b in ('40', '60', '50'))}) END END END AS breaker
  FROM g3 LEFT JOIN fits USING (part, cform, high, need, want)),
sp0 AS (SELECT g.cname, g.symbol, g.kw, g.volt, r.seq, r.q, r.dev, coalesce(TRY_CAST(nullif(g.kw, '') AS DOUBLE), CASE WHEN g.kw = '' THEN g.kwt END) AS v, g.known
  FROM (SELECT DISTINCT cname, symbol, kw, volt, kwt, known FROM g4 WHERE symbol <> '') g LEFT JOIN {_recipe()} ON r.sym = upper(trim(g.symbol))),
sp1 AS (SELECT p.cname, p.symbol, p.kw, p.volt, p.known, p.seq, coalesce(p.q, 1) AS q, p.dev, p.v, min(s.step) FILTER (WHERE s.step >= p.v) AS fit, max(s.step) AS top
  FROM sp0 p LEFT JOIN {_STEPS} ON s.dev = p.dev GROUP BY ALL),
sp2 AS (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(fit, top) END AS step, coalesce(v > top, false) AS clamped FROM sp1),
sp3 AS (SELECT *, coalesce({mapping(_MOTOR, "dev || '|' || CASE WHEN volt = '400V' THEN '400V' ELSE '200V' END || '|' || " + _kw_key('step') + " || '|' || CAST(contains(cname, '支給') AS VARCHAR)")}, '') AS c0 FROM sp2),
sparts AS (SELECT cname, symbol, kw, volt, list({{'code': CASE WHEN list_contains(known, c0) THEN c0 ELSE '' END, 'qty': q, 'clamped': clamped}} ORDER BY seq) AS parts
  FROM sp3 GROUP BY cname, symbol, kw, volt),
settled0 AS (SELECT g4.*, sp.parts, CASE WHEN g4.symbol <> '' THEN {{'rule': 'SYMBOL', 'code': sp.parts[1].code, 'conf':
     CASE WHEN sp.parts[1].code = '' OR len(list_filter(sp.parts, lambda p: p.clamped)) > 0 THEN '{_C}'
       WHEN len(sp.parts) = 1 THEN '{_S}' ELSE '{_N}' END, 'note': 'by main-circuit symbol'}}
   {' '.join(f'WHEN {c} THEN {r}' for c, r in _CHAIN)} ELSE {_res('R15', 'top.code', _C, ':several candidates')} END AS sel
  FROM g4 LEFT JOIN sparts sp ON g4.symbol <> '' AND sp.cname = g4.cname AND sp.symbol = g4.symbol AND sp.kw = g4.kw AND sp.volt = g4.volt),
settled1 AS (SELECT *, sel.rule AS rule, sel.code AS code, sel.note AS note0, CASE WHEN symbol = '' AND grp <> '' AND n > 0 AND sel.conf = '{_C}' AND sel.code <> ''
     AND NOT contains(coalesce({norm('part')}, cform), {norm('grp')}) THEN '{_N}' ELSE sel.conf END AS conf1,
   sel.conf AS conf0 FROM settled0),
settled2 AS (SELECT *, CASE WHEN symbol = '' AND code <> '' THEN {_lacking(True)} ELSE []::VARCHAR[] END AS missing_attrs,
   CASE WHEN symbol = '' AND code <> '' THEN {_lacking(False)} ELSE []::VARCHAR[] END AS missing_opt FROM settled1),
settled AS (SELECT *, CASE WHEN len(missing_attrs) > 0 AND conf1 = '{_S}' THEN '{_N}' ELSE conf1 END AS conf,
   CASE WHEN len(missing_attrs) > 0 AND conf1 = '{_S}' THEN 'required values missing (' || array_to_string(missing_attrs, '/') || '): ' ELSE '' END
   || CASE WHEN conf1 <> conf0 THEN 'accessory of ' || grp || ': ' ELSE '' END || note0 AS note FROM settled2),
r0 AS (SELECT k.*, s.part, s.rule, s.code, s.conf, s.note, s.cands, s.missing_attrs, s.missing_opt, s.symbol <> '' AS by_symbol, c.name AS official, c.spec,
   coalesce(starts_with(s.code, '420') AND contains(c.name, 'マルチ指示計'), false) AS src
  FROM kept k JOIN settled s USING (cname, volt, symbol, kw, grp, kind, tb_control, cap_panel, after_main) LEFT JOIN cat c ON c.code = s.code),
r1 AS (SELECT *, last_value(CASE WHEN src THEN code END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY panel_idx, item_idx
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mm FROM r0),
r2 AS (SELECT *, NOT src AND mm IS NOT NULL AND NOT {has('form', rules.METER_GUARD)} AND (code IN ({', '.join(repr(c) for c in rules.METER_CODES)})
   OR {has('form', rules.METER_TEXT)}) AS carried FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN carried THEN mm ELSE code END AS code,
   CASE WHEN carried THEN 'same type as the multi-meter above, check the type' WHEN src THEN 'multi-meter, check the type'
     ELSE CASE WHEN unclear AND conf <> '{_C}' THEN 'drawing hard to read: ' ELSE '' END || note END AS note, CASE WHEN carried OR src OR unclear THEN '{_C}' ELSE conf END AS conf) FROM r2),
r4 AS (SELECT r3.* EXCLUDE (official, spec), c.name AS official, c.spec, bool_or(r3.code <> '' AND (contains(c.name || c.spec, 'ZCT付')
   OR contains(c.name || c.spec, 'ZCT含') OR contains(c.name, 'LG-RY'))) OVER (PARTITION BY doc_id, panel_idx) AS has_relay
  FROM r3 LEFT JOIN cat c ON c.code = r3.code),
graded AS (SELECT * REPLACE (CASE WHEN gone THEN '' ELSE code END AS code, CASE WHEN gone THEN 'contained in the relay of the panel' ELSE note END AS note, CASE WHEN gone THEN '—' ELSE conf END AS conf, CASE WHEN gone THEN NULL ELSE official END AS official)
  FROM (SELECT *, coalesce(has_relay, false) AND {has('form', rules.STANDALONE_DETECTOR)} AND NOT {has('form', rules.STANDALONE_GUARD)} AS gone FROM r4)),
dets AS (SELECT d.doc_id, d.panel_idx, d.item_idx, {grab('trim(d.name)', r'^(\S+)')} AS load,
   (SELECT max(k.item_idx) FROM kept k WHERE k.doc_id = d.doc_id AND k.panel_idx = d.panel_idx AND k.item_idx < d.item_idx) AS parent_idx
  FROM stated d WHERE state = 'detail')
"""

PIPELINE = "WITH " + BASE.strip() + RULES
