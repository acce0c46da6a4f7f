"""DuckDB SQL for the record domain, written from the same tables of fixed values."""

from __future__ import annotations

from millrace.functions import vocab
from millrace.functions.exprs import ASCII_DIGITS, DIGITS
from millrace.functions.vocab import FAMILIES, FIELDS, PHRASES, WEIGHTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(codes) -> str:
    return "(" + ", ".join(map(q, codes)) + ")"


def draw(name: str, total: int | str) -> str:
    return f"(('0x' || substr(sha256('{vocab.SEED}:' || attempt || ':{name}'), 1, 15))::BIGINT % {total})"


def weighted(name: str, k: int = 0) -> str:
    weights = WEIGHTS[name][k][1]
    total, out = 0, "CASE"
    for code, w in weights.items():
        total += w
        out += f" WHEN {draw(name, sum(weights.values()))} < {total} THEN {q(code)}"
    return out + " END"


def lookup(column: str, field: str, default: str = "NULL") -> str:
    return f"CASE {column}" + "".join(f" WHEN {q(k)} THEN {q(v)}" for k, v in PHRASES[field].items()) + f" ELSE {default} END"


def has(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def cascade(text: str, field: str) -> str:
    return "CASE" + "".join(f" WHEN {has(text, phrases)} THEN {q(code)}" for code, phrases in vocab.CASCADES[field]) + " ELSE 'not_mentioned' END"


def stated(column: str) -> str:
    return f"({column} NOT IN {listed(vocab.MISSING)})"


def field_stated(field: str, prefix: str = "") -> str:
    if field == "location_segment":
        return f"(CASE WHEN {prefix}location_side = 'isthmus' THEN {prefix}location_segment = 'not_applicable' ELSE {stated(prefix + field)} END)"
    return stated(prefix + field)


def clamp(x: str) -> str:
    return f"least(greatest({x}, {vocab.CLAMP[0]}), {vocab.CLAMP[1]})"


def by_shape(k: int) -> str:
    s = vocab.SIZES
    return f"CASE shape WHEN 'taller_than_wide' THEN {s['taller_than_wide'][k]} WHEN 'wider_than_tall' THEN {s['wider_than_tall'][k]} ELSE {s['other'][k]} END"


#: attempts come from orders: e5 holds the drawn records.
CASES = f"""
e0 AS (SELECT o_orderkey AS attempt FROM orders),
e1 AS (SELECT attempt, {weighted('location_side')} AS location_side, {weighted('composition')} AS composition, {weighted('lymph_nodes')} AS lymph_nodes FROM e0),
e2 AS (SELECT *, CASE WHEN location_side = 'isthmus' THEN 'not_applicable' WHEN location_side IN ('left', 'right') THEN {weighted('location_segment')} ELSE location_side END AS location_segment,
  CASE WHEN composition = 'cystic' THEN {weighted('echogenicity', 0)} WHEN composition = 'spongiform' THEN {weighted('echogenicity', 1)}
    WHEN composition IN ('solid', 'mixed_cystic_solid') THEN {weighted('echogenicity', 2)} ELSE {weighted('echogenicity', 3)} END AS echogenicity FROM e1),
e3 AS (SELECT *, (composition IN ('cystic', 'spongiform') OR echogenicity = 'anechoic') AS restricted,
  {', '.join(f"CASE WHEN (composition IN ('cystic', 'spongiform') OR echogenicity = 'anechoic') THEN {weighted(f, 0)} ELSE {weighted(f, 1)} END AS {f}" for f in ('shape', 'margin', 'echogenic_foci', 'vascularity'))} FROM e2),
e4a AS (SELECT *, {by_shape(0)} + {draw('width', 1 << 40)} % {by_shape(1)} AS w FROM e3),
e4b AS (SELECT *, {clamp(f"((w * ({by_shape(2)} + {draw('depth', 1 << 40)} % {by_shape(3)}) + 50) // 100)")} AS d0 FROM e4a),
e4c AS (SELECT *, CASE WHEN shape = 'taller_than_wide' THEN greatest(d0, w + 1) ELSE d0 END AS d FROM e4b),
e4 AS (SELECT *, {clamp(f"((greatest(w, d) * ({vocab.LENGTH_PERCENT[0]} + {draw('length', 1 << 40)} % {vocab.LENGTH_PERCENT[1]}) + 50) // 100)")} AS l, {weighted('dims_state')} AS state, {weighted('dims_count')} AS arity FROM e4c),
e5 AS (SELECT attempt, {', '.join(FIELDS)}, CASE WHEN state = 'measured' THEN CASE WHEN arity = '3' THEN [w / 10.0::DOUBLE, d / 10.0::DOUBLE, l / 10.0::DOUBLE] ELSE [w / 10.0::DOUBLE, d / 10.0::DOUBLE] END END::DOUBLE[] AS dims,
  CASE WHEN state <> 'measured' THEN state END AS dims_state FROM e4)"""

_JSON = """'{"lymph_nodes":"' || lymph_nodes || '","nodules":[{"composition":"' || composition || '","dimensions_mm":' ||
  CASE WHEN dims IS NOT NULL THEN '[' || array_to_string(list_transform(dims, lambda x: x::VARCHAR), ',') || ']' ELSE '"' || dims_state || '"' END ||
  ',"echogenic_foci":"' || echogenic_foci || '","echogenicity":"' || echogenicity || '","location":{"segment":"' || location_segment || '","side":"' || location_side ||
  '"},"margin":"' || margin || '","nodule_id":"n1","shape":"' || shape || '","vascularity":"' || vascularity || '"}],"organ":"%s","schema_version":"%s"}'""" % (vocab.ORGAN, vocab.SCHEMA_VERSION)

#: c1: identified records, the first attempt of each.
IDENTIFIED = f"""{CASES},
c0 AS (SELECT *, {_JSON} AS input FROM e5),
c1 AS (SELECT *, 'sc_' || sha256(input) AS semantic_case_id FROM c0 QUALIFY row_number() OVER (PARTITION BY 'sc_' || sha256(input) ORDER BY attempt) = 1)"""

_NUMBER = r"regexp_replace(x::VARCHAR, '\.0$', '')"
#: p1: fragments of the records of c1.
FRAGMENTS = f"""{IDENTIFIED},
p1 AS (SELECT *, '甲状腺' || CASE WHEN location_side IN ('left', 'right') THEN {lookup('location_side', 'location_side')} || {lookup('location_segment', 'location_segment', "''")} WHEN location_side = 'isthmus' THEN '峡部' ELSE '内' END AS part_location,
  {lookup('composition', 'composition', "''")} || {lookup('echogenicity', 'echogenicity', "''")} || '结节' AS part_descriptor,
  '大小约' || array_to_string(list_transform(dims, lambda x: {_NUMBER}), '×') || 'mm' AS part_dimensions,
  {', '.join(f"{lookup(f, f)} AS part_{f}" for f in ('shape', 'margin', 'echogenic_foci', 'vascularity', 'lymph_nodes'))} FROM c1)"""


def report(family: str) -> str:
    lead = {
        "location_first_v2": "part_location || '见一枚' || part_descriptor",
        "descriptor_first_v2": "'可见一枚' || part_descriptor || '，位于' || part_location",
        "dimensions_first_v2": "coalesce('一枚约' || substr(part_dimensions, 4) || '的' || part_descriptor || '位于' || part_location, '一枚' || part_descriptor || '位于' || part_location)",
        "flow_first_v2": "part_location || '探及一枚' || part_descriptor",
    }[family]
    return f"concat_ws('，', {lead}, {', '.join('part_' + c for c in FAMILIES[family])}) || '。' || coalesce(part_lymph_nodes, '')"


#: r1: every record of c1 in every family.
RENDERED = f"""{FRAGMENTS},
r1 AS ({' UNION ALL '.join(f"SELECT *, {q(f)} AS template_family, {report(f)} AS target FROM p1" for f in FAMILIES)})"""


def parsed(source: str, text: str, name: str) -> str:
    """CTEs that extract a record from a text column of a source; the last is called name."""
    found = {f: cascade("body", f) for f in vocab.CASCADES}
    found["location_side"] = f"CASE WHEN contains(body, '{vocab.ISTHMUS}') THEN 'isthmus' ELSE {found['location_side']} END"
    found["location_segment"] = f"CASE WHEN contains(body, '{vocab.ISTHMUS}') THEN 'not_applicable' ELSE {found['location_segment']} END"
    group = lambda k: f"regexp_extract(body, {q(vocab.DIMENSIONS)}, {k})"
    rest = [f for f in FIELDS if not f.startswith("location")]
    explicit = f"(CASE WHEN parsed_location_side = 'isthmus' THEN 1 ELSE {stated('parsed_location_side')}::INT + {stated('parsed_location_segment')}::INT END + (parsed_dims IS NOT NULL)::INT + {' + '.join(stated('parsed_' + f) + '::INT' for f in rest)})"
    return f"""
{name}_a AS (SELECT *, trim({text}) AS body FROM {source}),
{name}_b AS (SELECT *, {', '.join(f"{c} AS parsed_{f}" for f, c in found.items())},
  CASE WHEN {group(1)} <> '' AND NOT {has('body', vocab.NO_DIMENSIONS)} THEN list_transform(list_filter([{group(1)}, {group(2)}, {group(3)}], lambda x: x <> ''), lambda x: translate(x, {q(DIGITS)}, {q(ASCII_DIGITS)})::DOUBLE * CASE WHEN {group(4)} = 'cm' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END) END::DOUBLE[] AS parsed_dims FROM {name}_a),
{name}_c AS (SELECT *, {explicit} AS parsed_explicit FROM {name}_b),
{name} AS (SELECT *, (body <> '' AND (parsed_explicit > 0 OR {has('body', vocab.ANCHORS)})) AS parsed_parseable FROM {name}_c)"""


def violations() -> list[tuple[str, str]]:
    from millrace.functions.vocab import LIMITED_FLOW, LIMITED_FOCI, SOFT_MARGINS, SOFT_SHAPES

    soft = {"echogenic_foci": LIMITED_FOCI, "vascularity": LIMITED_FLOW, "shape": SOFT_SHAPES, "margin": SOFT_MARGINS}
    out = [("dimensions.not_applicable", "coalesce(dims_state = 'not_applicable', false)")] + [(f"{f}.not_applicable", f"{f} = 'not_applicable'") for f in ("echogenicity", "echogenic_foci", "vascularity")]
    outside = lambda group, c: [(f"{group}_{f}", f"({c} AND {f} NOT IN {listed(codes)})") for f, codes in soft.items()]
    out.append(("composition.non_cystic_anechoic", "(composition IN ('solid', 'mixed_cystic_solid') AND echogenicity IN ('anechoic', 'not_applicable'))"))
    out.append(("composition.cystic_echogenicity", "(composition = 'cystic' AND echogenicity NOT IN ('anechoic', 'not_mentioned', 'unknown'))"))
    out += outside("composition.cystic", "composition = 'cystic'")
    out.append(("composition.spongiform_echogenicity", "(composition = 'spongiform' AND echogenicity IN ('anechoic', 'very_hypoechoic', 'not_applicable'))"))
    out += outside("composition.spongiform", "composition = 'spongiform'")
    out += outside("echogenicity.anechoic", "echogenicity = 'anechoic'")
    out.append(("dimensions.below_synthetic_minimum", "coalesce(list_min(dims) < 3, false)"))
    out.append(("dimensions.extreme_ratio", "coalesce(list_max(dims) > 3 * list_min(dims), false)"))
    out.append(("shape.wider_than_tall_mismatch", "coalesce(shape = 'wider_than_tall' AND dims[2] > dims[1], false)"))
    out.append(("shape.taller_than_wide_mismatch", "coalesce(shape = 'taller_than_wide' AND dims[2] <= dims[1], false)"))
    return out


def outside_schema() -> str:
    """Codes outside their domains, location rules and measurements that a record's types can't say."""
    rules = [f"{f} NOT IN {listed(codes)}" for f, codes in vocab.DOMAINS.items()]
    rules += ["location_side = 'isthmus' AND location_segment <> 'not_applicable'", "location_side IN ('left', 'right') AND location_segment = 'not_applicable'"]
    rules += ["coalesce(len(dims) NOT IN (2, 3) OR list_min(dims) <= 0, false)", "(dims IS NULL) = (dims_state IS NULL)"]
    return "(" + " OR ".join(f"({r})" for r in rules) + ")"


def clip(text: str) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= 80 THEN {flat} ELSE substr({flat}, 1, 79) || '…' END"


def findings(source: str, name: str) -> str:
    """CTE with a row per finding (ord, rule_id, severity, field) of a parsed source (see parsed())."""
    rows: list[tuple[str, str, str, str]] = [(f"contains(body, {q(t)})", "QC.DIAGNOSTIC_LANGUAGE", "error", "NULL") for t in vocab.DIAGNOSTIC]
    rows += [
        ("contains(body, '左叶') AND contains(body, '右叶')", "QC.TEXT_FIELD_CONTRADICTION", "error", "'location_side'"),
        (f"contains(body, '非高于宽') AND {has('body', ('呈高于宽', '前后径超过横径'))}", "QC.TEXT_FIELD_CONTRADICTION", "error", "'shape'"),
        ("contains(body, '实性') AND contains(body, '无回声') AND NOT contains(body, '囊')", "QC.TEXT_FIELD_CONTRADICTION", "error", "'echogenicity'"),
        (f"regexp_matches(body, {q(vocab.MM_MEASURE)}) AND regexp_matches(body, {q(vocab.CM_MEASURE)})", "QC.UNIT_MIXED_MM_CM", "warning", "'dimensions_mm'"),
        ("NOT parsed_parseable", "QC.UNPARSEABLE_REPORT", "error", "NULL"),
        (f"{field_stated('location_side')} AND parsed_location_side <> location_side", "QC.TEXT_LOCATION_MISMATCH", "error", "'location_side'"),
        ("dims IS NOT NULL AND NOT coalesce(len(parsed_dims) = len(dims) AND len(list_filter(list_zip(parsed_dims, dims), lambda z: abs(z[1] - z[2]) > 0.05)) = 0, false)", "QC.TEXT_DIMENSION_MISMATCH", "error", "'dimensions_mm'"),
    ]
    for f, (rule, severity) in vocab.OMISSIONS.items():
        differs = f"{field_stated(f)} AND parsed_{f} <> {f}"
        rows.append((f"{differs} AND {field_stated(f, 'parsed_')}", "QC.TEXT_FIELD_VALUE_MISMATCH", "error", q(f)))
        rows.append((f"{differs} AND NOT {field_stated(f, 'parsed_')}", rule, severity, q(f)))
    for f, phrases in (("vascularity", vocab.NEGATIVE_VASCULARITY), ("echogenic_foci", vocab.NEGATIVE_FOCI)):
        rows.append((f"{f} = 'not_mentioned' AND {has('body', phrases)}", "QC.STRUCTURE_NEGATION_MISLABEL", "warning", q(f)))
    rows += [(c, "QC.STRUCTURE_INTERNAL_CONSISTENCY", "warning", "NULL") for _, c in violations()]
    items = ", ".join(f"CASE WHEN {c} THEN {{'ord': {k}, 'rule_id': {q(r)}, 'severity': {q(s)}, 'field': {f}::VARCHAR}} END" for k, (c, r, s, f) in enumerate(rows))
    return f"""
{name} AS (SELECT *, CASE WHEN body = '' THEN [{{'ord': 0, 'rule_id': 'QC.EMPTY_REPORT', 'severity': 'error', 'field': NULL::VARCHAR}}] ELSE list_filter([{items}], lambda x: x IS NOT NULL) END AS findings FROM {source})"""


def first_phrase(text: str, phrases) -> str:
    return "CASE" + "".join(f" WHEN contains({text}, {q(p)}) THEN {q(p)}" for p in phrases) + " END"


def replace_first(text: str, phrase: str, replacement: str) -> str:
    return f"(substr({text}, 1, strpos({text}, {phrase}) - 1) || {replacement} || substr({text}, strpos({text}, {phrase}) + length({phrase})))"


def mutations(text: str) -> dict[str, str]:
    out = {d: f"CASE WHEN {first_phrase(text, p)} IS NOT NULL THEN {replace_first(text, '(' + first_phrase(text, p) + ')', chr(39) * 2)} END" for d, (_, p) in vocab.DEFECTS.items() if p}
    number = f"regexp_extract({text}, {q(vocab.NUMBER)}, 0)"
    out["dimension_mismatch"] = f"CASE WHEN dims IS NOT NULL AND {number} <> '' THEN {replace_first(text, number, f'(({number})::DOUBLE + 5)::VARCHAR')} END"
    left, right = f"contains({text}, '左叶')", f"contains({text}, '右叶')"
    out["laterality_mismatch"] = f"CASE WHEN {left} AND NOT {right} THEN replace({text}, '左叶', '右叶') WHEN {right} AND NOT {left} THEN replace({text}, '右叶', '左叶') END"
    out["unit_mixed"] = f"CASE WHEN contains({text}, 'mm') THEN {replace_first(text, chr(39) + 'mm' + chr(39), q('mm（约1.0cm）'))} END"
    out["text_contradiction"] = f"CASE WHEN {left} THEN {text} || '同时可见右叶结节。' WHEN {right} THEN {text} || '同时可见左叶结节。' END"
    out["negation_mislabeled"] = f"CASE WHEN vascularity = 'none' AND contains({text}, '未见明显血流') THEN {text} END"
    out["diagnostic_language"] = f"{text} || '考虑恶性可能。'"
    return {d: out[d] for d in vocab.DEFECTS}


def injected(source: str, text: str, example: str, per_defect: int, name: str) -> str:
    """CTEs with the first per_defect mutated pairs of each defect; the mutated text is called text."""
    columns = ", ".join(f for f in FIELDS if f != "vascularity")
    each = " UNION ALL ".join(f"SELECT {example}, {columns}, CASE WHEN {q(d)} = 'negation_mislabeled' THEN 'not_mentioned' ELSE vascularity END AS vascularity, dims, dims_state, {q(d)} AS defect_id, {q(vocab.DEFECTS[d][0])} AS expected_rule, {m} AS text FROM {source}" for d, m in mutations(text).items())
    return f"""
{name}_all AS ({each}),
{name} AS (SELECT * FROM {name}_all WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY defect_id ORDER BY {example}) <= {per_defect})"""
