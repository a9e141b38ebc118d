"""Rule tables.  Everything here is plain data; operators take these tables as arguments.

The constants in the "fixed values" sections are the vocabulary and code numbers that a
result must use, so they are written out as they are; longer tables are built from a rule.
"""

from __future__ import annotations

# --- fixed values: grades -------------------------------------------------------------
SURE, NEARLY, CHECK, UNCOUNTED = "◎", "○", "△", "—"

# --- fixed values: option words -------------------------------------------------------
OPTION_WORDS = (
    "spd用 ct付 ax付 2e付 1e付 am付 as付 pf付 al付 zct付 sog付 g-ry付 td付 広角 赤針付 spd付 "
    "th付 ドアsw付 検付 通信 方向性 引出 電動 手動 コージェネ 標準 高性能 漏電アラーム"
).split()

# --- fixed values: words that lower or raise a candidate --------------------------------
SPECIAL_WORDS = "引出 スペース (sp) ｓｐ 電動 コージェネ 高性能 可逆".split()
DEFAULT_WORDS = "静止型 標準 (手動)".split()
SPECIAL_IN_DRAWING = "引出 電動 可逆 スペース".split()
EXTRA_WORDS = "スペース (SP) コージェネ 高性能".split()

# --- fixed values: part dictionary, one part per line in priority order -----------------
# part, aliases, whether the catalogue name must start with the part
PART_DICTIONARY = (
    ("T/U", ("t/u",), True),
    ("リモコンSW", ("リモコンsw",), True),
    ("MDF", ("mdf",), True),
    ("端子盤", ("端子盤",), True),
    ("分配器", ("分配器",), True),
    ("増幅器", ("増幅器",), True),
    ("混合器", ("混合器",), True),
    ("UHFアンテナ", ("uhf",), False),
    ("BS-110CSアンテナ", ("bs-110",), False),
    ("アンテナ", ("アンテナ",), False),
    ("インターホン", ("インターホン",), True),
    ("ネットワークカメラ", ("ネットワークカメラ",), False),
    ("カメラ", ("カメラ",), False),
    ("カードリーダー", ("カードリーダー",), True),
    ("TV BOX", ("tvbox",), False),
    ("TV", ("tv-",), False),
    ("自動力率調整器", ("自動力率調整", "自動力率", "apfc"), True),
    ("マルチ指示計", ("マルチ指示計", "mda", "多機能電力計", "デジタルマルチメーター"), True),
    ("マルチT/D", ("マルチt/d",), True),
    ("電圧計", ("電圧計",), True),
    ("電流計", ("電流計",), True),
    ("電力計", ("電力計",), True),
    ("力率計", ("力率計",), True),
    ("VM", ("vm",), True),
    ("AM", ("am",), True),
    ("VS", ("vs",), True),
    ("AS", ("as",), True),
    ("WHM", ("whm",), False),
    ("MGS", ("mgs",), True),
    ("PAS", ("pas",), True),
    ("VCB", ("vcb", "vgb"), True),
    ("VCT", ("vct",), True),
    ("VCS", ("vcs", "vmc"), True),
    ("SOG", ("sog",), True),
    ("LBS", ("lbs",), True),
    ("DS", ("ds",), True),
    ("CH", ("ch",), True),
    ("L-S", ("l-s",), False),
    ("INV", ("インバータ", "inv"), False),
    ("OCR", ("ocr",), True),
    ("DGR", ("dgr",), True),
    ("RPR", ("rpr",), True),
    ("OVGR", ("ovgr",), True),
    ("LG-RY", ("lg-ry",), True),
    ("LGR", ("lgr",), True),
    ("ZPD", ("zpd",), True),
    ("ZCTT", ("zctt",), True),
    ("ZCT", ("zct",), True),
    ("VTT", ("vtt",), True),
    ("CTT", ("ctt",), True),
    ("M)LUG", ("m)lug",), True),
    ("M)MCB", ("m)mcb", "m)mccb"), True),
    ("M)ELB", ("m)elb", "m)elcb"), True),
    ("B)MCB", ("b)mcb", "b)mccb"), True),
    ("B)ELB", ("b)elb", "b)elcb"), True),
    ("MCB", ("mcb", "mccb"), True),
    ("ELB", ("elb", "elcb"), True),
    ("ACB", ("acb",), True),
    ("VT", ("vt",), True),
    ("CT", ("ct",), True),
    ("PF", ("pf",), True),
    ("LA", ("la",), True),
    ("SC", ("sc",), True),
    ("SR", ("sr", "srx"), True),
    ("TR", ("tr",), True),
    ("SM", ("sm",), True),
    ("FL-10W", ("fl-10w",), True),
    ("PBS", ("pbs",), True),
    ("SPD", ("spd",), True),
    ("MCTT", ("mctt",), True),
    ("換気扇", ("換気扇",), True),
    ("コンセント", ("コンセント",), True),
    ("伝送", ("伝送",), True),
    ("R.RY", ("リモコンリレー",), False),
    ("R.TR", ("リモコントランス",), False),
    ("TB", ("端子台",), True),
)

# --- fixed values: exclusion patterns on the normalised text ----------------------------
CABLE_PATTERN = r"^(\d+k?v)?(fpt|cvt|cvv|vvf|kiv|hiv|fp|cv)\d"
# (pattern, read the raw text instead, pattern that keeps the row)
FUSE_RULES = (
    (r"^f([x×]\d+)?($|\d)", False, r"^pf"),
    (r"計器ヒューズ", True, r"^pf"),
    (r"^(f|fx\d*|fx\d*\d+a|計器ヒュ?ズ|計器用ヒュ?ズ)$", False, None),
    (r"^fx", False, r"pf"),
    (r"^f(x|\d|$|[^\p{L}\p{N}_]|付)", False, r"(^|[^a-z])pf([^a-z]|$)"),
)

# --- fixed values: breakers -------------------------------------------------------------
STANDARD_AMPS = (15, 20, 30, 40, 50, 60, 75, 100, 125, 150, 175, 200, 225, 250, 300, 350,
                 400, 500, 600, 700, 800, 1000, 1200, 1600, 2000, 2500, 3200)
STANDARD_FRAMES = (50, 100, 225, 400, 600, 800, 1000, 1200, 1600, 2000, 2500, 3200)
BREAKER_PARTS = ("M)MCB", "M)LUG", "M)ELB", "B)MCB", "B)ELB", "MCB", "ELB")
FRAME_DIGIT = {50: "5", 100: "1", 225: "2", 400: "4", 600: "6", 800: "8"}
MAIN_BASE = {"control": "50", "lighting": "50", "receiving": "40"}
MAIN_FRAMES = {"control": (50, 100, 225, 400, 600, 800),
               "lighting": (50, 100, 225, 400, 600),
               "receiving": (50, 100, 225, 400, 600, 800)}
MAIN_SUFFIX = "03"
BRANCH_BASES = {"control": ("50", "40", "60"), "other": ("40", "60", "50")}
BRANCH_SUFFIX = {("2", False): "22", ("2", True): "25", ("3", False): "33",
                 ("3", True): "36", ("4", False): "46", ("4", True): "46"}
PANEL_KINDS = (("control", ("制御", "動力")), ("lighting", ("分電", "電灯")),
               ("receiving", ("配電", "受電", "高圧")))
PANEL_KIND_DEFAULT = "lighting"

# --- fixed values: terminal blocks ------------------------------------------------------
TB_CONTROL_WORDS = "制御 動力 pac m1 m2 m3 m4".split()
TB_CONTROL = {50: "50901", 100: "50902", 200: "50903", 225: "50903", 400: "50904"}
TB_GENERAL = {50: "68509", 100: "68109", 225: "68209", 200: "68209", 400: "68409", 600: "68609"}

# --- fixed values: current transformers -------------------------------------------------
CT_HV_BUCKETS = ((0, 40, "44121"), (40, 75, "44122"), (75, 200, "44123"))
CT_LV = {10: "72000", 15: "72001", 100: "72002", 200: "72003", 300: "72004", 400: "72005",
         500: "72006", 600: "72007"}

# --- fixed values: motor circuits -------------------------------------------------------
MOTOR_BASE = {"200V": "22", "400V": "26"}
MOTOR_SUFFIX = {
    "direct": {2.2: "000", 3.7: "001", 5.5: "011", 7.5: "021", 11: "031", 15: "041", 18.5: "061",
               22: "071", 30: "081", 37: "091", 45: "111", 55: "121", 75: "131"},
    "stardelta": {7.5: "022", 11: "032", 15: "042", 18.5: "062", 22: "072", 30: "082", 37: "092",
                  45: "112", 55: "122", 75: "132"},
    "inverter": {0.75: "993", 1.5: "983", 2.2: "053", 3.7: "003", 5.5: "013", 7.5: "023",
                 11: "033", 15: "043", 18.5: "063", 22: "073", 30: "083", 37: "093", 45: "113",
                 55: "123", 75: "133", 90: "143"},
}
# symbol -> (device kind, quantity) in order; None: supply only
SYMBOL_RECIPES = {
    "A": ((None, 1),), "B": ((None, 1),),
    "C": (("direct", 1),), "D": (("stardelta", 1),),
    "E": (("direct", 2),), "F": (("stardelta", 2),),
    "G": (("direct", 2),), "H": (("stardelta", 2),),
    "I": (("inverter", 1),),
    "J": (("inverter", 1), ("direct", 1)), "K": (("inverter", 1), ("stardelta", 1)),
    "L": (("inverter", 2),),
}

DEVICE_LABELS = {"direct": "direct starter", "stardelta": "star-delta starter", "inverter": "inverter"}

# --- fixed values: ground relays, meters ------------------------------------------------
LGR_PLAIN, LGR_TWO_STAGE = "46401", "46403"
METER_CODES = "71001 71002 98802 98803 42001 42002 42003 42014 74275 74276".split()
METER_TEXT = (r"^(thr|vs|as|v/s|a/s|切換スイッチ|切換sw|vm|am|vm/am|v|a|電圧計|電流計|計器[va/]+)$")
METER_GUARD = r"tr|変圧器|sc|sr|mcb|elb|lbs|vcb|vcs|vmc|pas|ds|lgr|zct|ct|vt|pf|kva|kvar|kw"
METER_SOURCE_PREFIX, METER_SOURCE_NAME = "420", "マルチ指示計"
ABSORBING_NAME, ABSORBING_WORDS = "LG-RY", ("ZCT付", "ZCT含")
STANDALONE_DETECTOR = r"(^|[^a-z])zctt?([^a-z]|$)"
STANDALONE_GUARD = r"lgr|lgry|elry|igr|dgr|ry|mcb|elb|lbs|vcb|tr|変圧器"

# --- fixed values: attribute checks -----------------------------------------------------
ATTR_PATTERN = {
    "電圧": r"\d+\.?\d*kV", "定格電流": r"\d+A", "遮断容量": r"\d+\.?\d*kA",
    "操作方式": "手動|電動|引出", "極数": r"[234]P", "PF": "PF", "G感度": r"G\d+A",
    "種別": "SOG|UGS|G-?RY", "変流比": r"\d+/[15]A", "負担": r"\d+VA", "相数": "[13]φ",
    "電流": r"\d+A", "検定": "検付|未検", "容量": r"\d+\.?\d*\s*kW", "AF": r"\d+AF|\d+/\d+",
    "AT": r"\d+AT|/\d+", "クラス": "クラス[III]+|class", "形式": "モールド",
}
# class, required, optional, patterns that differ from the table above
ATTR_SPEC = (
    ("VCB", ("定格電流", "遮断容量"), ("電圧", "操作方式"), {}),
    ("VCS", ("定格電流",), ("電圧", "形式"), {"形式": "電磁|引出|PF付"}),
    ("DS", ("極数", "定格電流"), ("電圧",), {"極数": "[13]P"}),
    ("LBS", ("定格電流",), ("電圧", "PF", "G感度"), {}),
    ("PAS", ("定格電流",), ("電圧", "種別"), {}),
    ("PF", ("定格電流",), (), {}),
    ("CT", ("変流比",), ("負担", "形式"), {"形式": "丸型|モールド"}),
    ("VT", ("負担",), ("電圧", "形式"), {}),
    ("WHM", ("相数",), ("変流比", "電流", "検定"), {}),
    ("ZCT", ("定格電流",), (), {}),
    ("TR", ("相数", "容量"), (), {"容量": r"\d+\.?\d*\s*kVA"}),
    ("SC", ("容量",), ("電圧",), {"電圧": r"\d+\.?\d*k?V", "容量": r"\d+\.?\d*\s*(kVA|kvar)"}),
    ("SR", ("容量",), ("相数",), {"容量": r"\d+\.?\d*\s*kvar"}),
    ("MCB", ("極数", "AF"), ("AT",), {}),
    ("ELB", ("極数", "AF"), ("AT",), {"AT": r"/\d+"}),
    ("MCCB", ("極数", "定格電流"), (), {}),
    ("ACB", ("極数", "AF"), ("AT",), {"AF": r"\d+AF"}),
    ("MCTT", ("極数", "定格電流"), (), {}),
    ("MGS", ("容量",), ("電圧",), {"電圧": r"\d+V"}),
    ("SM", ("容量",), ("極数", "電圧"), {"電圧": r"\d+V"}),
    ("INV", ("容量",), ("電圧",), {"電圧": r"\d+V"}),
    ("端子盤", ("極数",), (), {"極数": r"\d+P"}),
    ("TB", ("極数",), ("定格電流",), {"極数": r"\d+P"}),
    ("SPD", ("クラス", "極数"), ("遮断容量",), {"遮断容量": r"\d+kA"}),
    ("コンセント", ("極数", "定格電流"), (), {"極数": r"\d+P"}),
)


def parts() -> list[tuple[str, tuple[str, ...], bool]]:
    """(part, aliases, catalogue name must start with the part) in priority order."""
    return list(PART_DICTIONARY)


def aliases() -> list[tuple[str, str]]:
    """(alias, part) in the order they are tried.

    Order of the dictionary, except that an alias which contains another one is tried
    first, so that the longer word is never read as the shorter word inside it.
    """
    listed = [(a, p) for p, names, _ in parts() for a in names]
    ordered: list[tuple[str, str]] = []
    for alias, part in listed:
        at = next((i for i, (a, _) in enumerate(ordered)
                   if a != alias and a in alias and len(a) > 2), len(ordered))
        ordered.insert(at, (alias, part))
    return ordered


def attr_spec() -> list[tuple[str, str, bool, str]]:
    """(class, attribute, required, pattern)."""
    return [(cls, attr, needed, own.get(attr, ATTR_PATTERN[attr]))
            for cls, required, optional, own in ATTR_SPEC
            for attrs, needed in ((required, True), (optional, False)) for attr in attrs]


# --- decision rules, the first one that fits settles an item ------------------------------
# rule, conditions ("!" in front: must not hold), code column, grade, note
DECISION_RULES = (
    ("R1", "main_terminal control_panel control_code", "control", NEARLY, "terminal block of a control panel main"),
    ("R1", "main_terminal general_code", "general", NEARLY, "terminal block of a main breaker"),
    ("R1", "main_terminal", "", CHECK, "terminal block of a main breaker, check the rating"),
    ("R2", "terminal", "", NEARLY, "terminal block contained in the branch unit"),
    ("R3", "surge_breaker !frame", "", CHECK, "breaker for a surge device without rating"),
    ("R4", "breaker_part breaker_code", "breaker", SURE, "{place} {device} by panel kind and frame"),
    ("R4", "breaker_part", "", CHECK, "breaker rating or panel kind to check"),
    ("R5", "motor", "motor", CHECK, "motor set"),
    ("R6", "ct high_band ct_high_code", "ct_high", NEARLY, "high-voltage CT by ratio"),
    ("R6", "ct low_band ct_low_code", "ct_low", NEARLY, "low-voltage CT by ratio"),
    ("R6", "ct", "", CHECK, "CT ratio or band to check"),
    ("R7", "capacity step_fits step_equal", "step", SURE, "capacity equal"),
    ("R7", "capacity step_fits", "step", NEARLY, "capacity raised to {step}"),
    ("R7", "capacity largest_step", "", CHECK, "capacity above the largest, {largest}"),
    ("R7", "capacity", "", CHECK, "no row of this capacity series"),
    ("R8", "!part", "", CHECK, "part not identified, {candidates} candidates"),
    ("R9", "disconnector three_poles three_pole_code", "three_pole", NEARLY, "three-pole standard disconnector"),
    ("R10", "disconnector !poles any_pole_code", "any_pole", CHECK, "pole number to check"),
    ("R11", "leak_relay !two_stage plain_relay_code", "plain_relay", SURE, "leak relay with detector"),
    ("R11", "leak_relay two_stage two_stage_code", "two_stage_relay", NEARLY, "two-stage leak relay"),
    ("R12", "!candidates", "", CHECK, "no catalogue row"),
    ("R13", "vmc", "top", CHECK, "VMC read as VCS"),
    ("R14", "one_candidate", "top", SURE, "only candidate"),
    ("R15", "explained agreed", "top", NEARLY, "values agree"),
    ("R15", "explained option_agreed", "top", NEARLY, "option agrees"),
    ("R15", "explained standard", "top", NEARLY, "standard type"),
    ("R15", "!explained", "top", CHECK, "not explained: {missing}"),
    ("R15", "", "top", CHECK, "several candidates"),
)


def main_codes() -> dict[tuple[str, int], str]:
    """(panel kind, frame) -> code of the three-pole main breaker."""
    return {(kind, af): MAIN_BASE[kind] + FRAME_DIGIT[af] + MAIN_SUFFIX
            for kind, frames in MAIN_FRAMES.items() for af in frames}


def branch_suffixes() -> set[str]:
    return set(BRANCH_SUFFIX.values())


def motor_codes() -> dict[tuple[str, str, float, bool], str]:
    """(kind, band, kW, supplied by the customer) -> code; a supplied inverter ends in 5."""
    out = {}
    for kind, steps in MOTOR_SUFFIX.items():
        for band, base in MOTOR_BASE.items():
            for kw, suffix in steps.items():
                out[(kind, band, float(kw), False)] = base + suffix
                own = kind == "inverter"
                out[(kind, band, float(kw), True)] = base + (suffix[:-1] + "5" if own else suffix)
    return out


def rule_codes() -> list[str]:
    """Every code a rule can emit by itself; the size is fixed (a few hundred)."""
    codes = set(TB_CONTROL.values()) | set(TB_GENERAL.values()) | set(CT_LV.values())
    codes |= {c for _, _, c in CT_HV_BUCKETS} | {LGR_PLAIN, LGR_TWO_STAGE}
    codes |= set(main_codes().values()) | set(motor_codes().values())
    codes |= {b + d + s for b in BRANCH_BASES["control"] for d in FRAME_DIGIT.values()
              for s in branch_suffixes()}
    return sorted(codes)
