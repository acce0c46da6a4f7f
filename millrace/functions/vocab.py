"""Fixed values of the record domain: codes, phrases, weights and rule tables. They must be as they are for equal results."""

# Versions that are part of the data.
SCHEMA_VERSION = "1.0.0"
GENERATOR_VERSION = "1.1.0"
RENDERER_VERSION = "1.1.0"
CHALLENGE_VERSION = "1.0.0"
ORGAN = "thyroid"
SEED = 20260824

MISSING = ("not_mentioned", "unknown", "not_applicable")

#: Field -> codes.
DOMAINS = {
    "location_side": ("left", "right", "isthmus", "not_mentioned", "unknown"),
    "location_segment": ("upper", "middle", "lower", "not_mentioned", "unknown", "not_applicable"),
    "composition": ("solid", "cystic", "mixed_cystic_solid", "spongiform", "not_mentioned", "unknown"),
    "echogenicity": ("anechoic", "hyperechoic", "isoechoic", "hypoechoic", "very_hypoechoic", "not_mentioned", "unknown", "not_applicable"),
    "shape": ("wider_than_tall", "taller_than_wide", "not_mentioned", "unknown"),
    "margin": ("smooth", "ill_defined", "lobulated_or_irregular", "extrathyroidal_extension", "not_mentioned", "unknown"),
    "echogenic_foci": ("none", "comet_tail", "macrocalcification", "peripheral_calcification", "punctate_echogenic_foci", "not_mentioned", "unknown", "not_applicable"),
    "vascularity": ("none", "peripheral", "internal", "mixed", "not_mentioned", "unknown", "not_applicable"),
    "lymph_nodes": ("no_suspicious", "suspicious", "not_mentioned", "unknown"),
}
FIELDS = tuple(DOMAINS)

#: Weights of the draws: field -> rows of (condition, code -> weight); a condition names earlier fields' codes.
WEIGHTS = {
    "location_side": [("always", {"left": 44, "right": 44, "isthmus": 8, "not_mentioned": 2, "unknown": 2})],
    "location_segment": [("sided", {"upper": 30, "middle": 30, "lower": 30, "not_mentioned": 6, "unknown": 4})],
    "composition": [("always", {"solid": 48, "cystic": 14, "mixed_cystic_solid": 20, "spongiform": 8, "not_mentioned": 6, "unknown": 4})],
    "echogenicity": [
        ("cystic", {"anechoic": 85, "not_mentioned": 10, "unknown": 5}),
        ("spongiform", {"hyperechoic": 10, "isoechoic": 55, "hypoechoic": 15, "not_mentioned": 10, "unknown": 10}),
        ("solid_or_mixed", {"hyperechoic": 12, "isoechoic": 27, "hypoechoic": 40, "very_hypoechoic": 10, "not_mentioned": 6, "unknown": 5}),
        ("always", {"anechoic": 10, "hyperechoic": 10, "isoechoic": 25, "hypoechoic": 35, "very_hypoechoic": 8, "not_mentioned": 7, "unknown": 5}),
    ],
    "shape": [
        ("restricted", {"wider_than_tall": 80, "not_mentioned": 12, "unknown": 8}),
        ("always", {"wider_than_tall": 67, "taller_than_wide": 21, "not_mentioned": 8, "unknown": 4}),
    ],
    "margin": [
        ("restricted", {"smooth": 75, "ill_defined": 12, "not_mentioned": 8, "unknown": 5}),
        ("always", {"smooth": 48, "ill_defined": 18, "lobulated_or_irregular": 17, "extrathyroidal_extension": 3, "not_mentioned": 9, "unknown": 5}),
    ],
    "echogenic_foci": [
        ("restricted", {"none": 40, "comet_tail": 40, "not_mentioned": 13, "unknown": 7}),
        ("always", {"none": 32, "comet_tail": 10, "macrocalcification": 13, "peripheral_calcification": 10, "punctate_echogenic_foci": 16, "not_mentioned": 13, "unknown": 6}),
    ],
    "vascularity": [
        ("restricted", {"none": 45, "peripheral": 25, "not_mentioned": 20, "unknown": 10}),
        ("always", {"none": 26, "peripheral": 20, "internal": 21, "mixed": 18, "not_mentioned": 10, "unknown": 5}),
    ],
    "lymph_nodes": [("always", {"no_suspicious": 38, "suspicious": 9, "not_mentioned": 46, "unknown": 7})],
    "dims_state": [("always", {"measured": 94, "not_mentioned": 4, "unknown": 2})],
    "dims_count": [("always", {"2": 70, "3": 30})],
}
#: Transverse size in tenths of a millimetre (low, values), and the second size in percent of it (low, values), by shape.
SIZES = {"taller_than_wide": (50, 246, 105, 31), "wider_than_tall": (50, 351, 45, 51), "other": (50, 271, 55, 71)}
LENGTH_PERCENT = (75, 51)
CLAMP = (30, 400)

#: Code -> phrase of a rendered report.
PHRASES = {
    "location_side": {"left": "左叶", "right": "右叶", "isthmus": "峡部"},
    "location_segment": {"upper": "上部", "middle": "中部", "lower": "下部"},
    "composition": {"solid": "实性", "cystic": "囊性", "mixed_cystic_solid": "囊实性", "spongiform": "海绵状"},
    "echogenicity": {"anechoic": "无回声", "hyperechoic": "高回声", "isoechoic": "等回声", "hypoechoic": "低回声", "very_hypoechoic": "极低回声"},
    "shape": {"wider_than_tall": "呈非高于宽形", "taller_than_wide": "呈高于宽形"},
    "margin": {"smooth": "边缘光滑", "ill_defined": "边界欠清", "lobulated_or_irregular": "边缘分叶或不规则", "extrathyroidal_extension": "可见甲状腺外侵犯征象"},
    "echogenic_foci": {"none": "内未见明显强回声", "comet_tail": "内见彗尾征", "macrocalcification": "内见粗大钙化", "peripheral_calcification": "周边见环形钙化", "punctate_echogenic_foci": "内见点状强回声"},
    "vascularity": {"none": "CDFI示结节内及周边未见明显血流信号", "peripheral": "CDFI示周边可见血流信号", "internal": "CDFI示内部可见血流信号", "mixed": "CDFI示内部及周边可见血流信号"},
    "lymph_nodes": {"no_suspicious": "颈部未见明显可疑淋巴结。", "suspicious": "颈部可见可疑淋巴结。"},
}
#: Clause order of each template family after its lead; the lead's pieces are in operators/render.py.
FAMILIES = {
    "location_first_v2": ("dimensions", "shape", "margin", "echogenic_foci", "vascularity"),
    "descriptor_first_v2": ("margin", "shape", "dimensions", "vascularity", "echogenic_foci"),
    "dimensions_first_v2": ("echogenic_foci", "margin", "vascularity", "shape"),
    "flow_first_v2": ("vascularity", "dimensions", "echogenic_foci", "shape", "margin"),
}
HELD_OUT = "flow_first_v2"

#: Phrases that state a code, in the order in which they are tried: the first code with any phrase in the text is taken.
CASCADES = {
    "location_side": [("left", ("左叶", "左侧叶", "左侧甲状腺")), ("right", ("右叶", "右侧叶", "右侧甲状腺"))],
    "location_segment": [("upper", ("上部", "上段")), ("middle", ("中部", "中段")), ("lower", ("下部", "下段"))],
    "composition": [
        ("mixed_cystic_solid", ("囊实性", "囊实混合", "囊实相间", "囊、实", "囊性与实性", "囊性与实性部分并存")),
        ("spongiform", ("海绵状", "海绵样")),
        ("cystic", ("囊性", "液性")),
        ("solid", ("实性",)),
    ],
    "echogenicity": [
        ("very_hypoechoic", ("极低回声",)),
        ("hypoechoic", ("低回声", "回声偏低")),
        ("hyperechoic", ("高回声",)),
        ("isoechoic", ("等回声", "回声与周围腺体接近")),
        ("anechoic", ("无回声",)),
    ],
    "shape": [
        ("wider_than_tall", ("非高于宽", "横径大于前后径", "横径较前后径大", "横径略大于", "横径超过前后径", "横向径大于前后径", "横向生长", "横向排列", "横向径占优", "横向径较大", "横径较大", "前后径小于横径", "前后径未超过横径")),
        ("taller_than_wide", ("高于宽", "前后径超过横径", "前后径大于横径")),
    ],
    "margin": [
        ("extrathyroidal_extension", ("甲状腺外侵犯", "越出甲状腺轮廓", "延伸至腺体轮廓之外")),
        ("lobulated_or_irregular", ("分叶或不规则", "分叶且不规则", "分叶样不规则", "分叶、不规则", "分叶不规则", "外形欠规则", "轮廓分叶", "外缘呈分叶")),
        ("ill_defined", ("边界欠清", "边界显示欠清", "边缘分辨欠佳", "边缘显示不够清楚")),
        ("smooth", ("边缘光滑", "轮廓光整", "壁缘规整", "边缘连续光滑", "边缘尚光整", "边缘平整", "轮廓平滑", "外缘平滑", "轮廓规整", "边缘规则", "边缘光整", "边缘平滑", "边缘仍光滑")),
    ],
    "echogenic_foci": [
        ("none", ("未见明显强回声", "没有明确强回声", "未检出强回声", "未发现明确强回声", "未见内部强回声", "未见明确强回声", "内部未发现强回声", "内部没有明确强回声", "内部未见强回声", "未见强回声灶", "未发现强回声灶")),
        ("punctate_echogenic_foci", ("点状强回声", "细小点状", "细点状")),
        ("comet_tail", ("彗尾",)),
        ("macrocalcification", ("粗大钙化", "较大钙化")),
        ("peripheral_calcification", ("环形钙化", "周边见环形", "周缘伴钙化", "周边伴钙化")),
    ],
    "vascularity": [
        ("none", ("结节内及周边未见明显血流", "未见明显血流信号", "未记录到明确血流", "结节内外未见明确信号", "均无明确显示", "结节内外无明确血流", "内外均无明显血流", "彩色血流亦未显示", "未显示明显血流", "无明确血流")),
        ("mixed", ("内部及周边可见血流", "结节内和周围均可见血流", "内部与周边均有", "内部和外围都有血流", "结节内外均显示血流")),
        ("internal", ("内部可见血流信号", "进入结节内部", "可记录到内部血流", "点状强回声及血流", "点状强回声与血流", "强回声和血流信号", "强回声与血流信号", "内部有血流", "内部血流", "并可记录到血流")),
        ("peripheral", ("周边可见血流信号", "环绕结节", "周缘可记录到血流", "血流仅在外围", "血流环绕", "环周血流", "周边有少量血流", "血流主要位于结节周围", "周边可见血流")),
    ],
    "lymph_nodes": [
        ("no_suspicious", ("未见明显可疑淋巴结", "未扫及明显异常淋巴结", "未见可疑改变", "未发现形态可疑", "未扫及可疑淋巴结", "未发现明显可疑淋巴结", "未发现可疑淋巴结", "未见可疑淋巴结")),
        ("suspicious", ("可见可疑淋巴结", "形态可疑淋巴结", "另见形态可疑", "同时发现可疑淋巴结", "另有可疑淋巴结", "颈部见形态可疑")),
    ],
}
ISTHMUS = "峡部"
NO_DIMENSIONS = ("未给出结节径线", "具体大小无法", "大小无法获得", "径线及纵横形态")
ANCHORS = ("甲状腺", "结节", "峡部")
#: Digits and white space are Unicode's, written so that Java's and RE2's patterns agree.
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
GAP = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
DIMENSIONS = rf"({NUMBER}){GAP}(?:mm)?{GAP}[×xX*]{GAP}({NUMBER})(?:{GAP}(?:mm)?)(?:{GAP}[×xX*]{GAP}({NUMBER}))?{GAP}(mm|cm)?"

#: Terms of diagnosis: for reports, and the shorter list for challenge texts.
DIAGNOSTIC = ("TI-RADS", "良性", "恶性", "癌", "确诊", "治疗")
CHALLENGE_DIAGNOSTIC = ("TI-RADS", "良性", "恶性", "癌")
CM_MEASURE = rf"(?i){NUMBER}{GAP}(?:cm)|{NUMBER}{GAP}[×xX*]{GAP}{NUMBER}(?:{GAP}[×xX*]{GAP}{NUMBER})?{GAP}cm"
MM_MEASURE = rf"(?i){NUMBER}{GAP}(?:mm)|{NUMBER}{GAP}[×xX*]{GAP}{NUMBER}(?:{GAP}[×xX*]{GAP}{NUMBER})?{GAP}mm"
NEGATIVE_VASCULARITY = ("未见明显血流", "未记录到明确血流", "无明确血流", "未显示明显血流", "结节内及周边未见明显血流")
NEGATIVE_FOCI = ("未见明显强回声", "没有明确强回声", "未检出强回声", "未见明确强回声", "内部未见强回声")
OMISSIONS = {
    "composition": ("QC.TEXT_OMITS_STATED_COMPOSITION", "error"),
    "echogenicity": ("QC.TEXT_OMITS_STATED_ECHOGENICITY", "error"),
    "shape": ("QC.TEXT_OMITS_STATED_SHAPE", "warning"),
    "margin": ("QC.TEXT_OMITS_STATED_MARGIN", "warning"),
    "echogenic_foci": ("QC.TEXT_OMITS_STATED_FOCI", "warning"),
    "vascularity": ("QC.TEXT_OMITS_STATED_VASCULARITY", "warning"),
    "lymph_nodes": ("QC.TEXT_OMITS_STATED_LYMPH_NODES", "warning"),
}

#: Sets of the consistency rules.
LIMITED_FOCI = ("none", "comet_tail", "not_mentioned", "unknown")
LIMITED_FLOW = ("none", "peripheral", "not_mentioned", "unknown")
SOFT_MARGINS = ("smooth", "ill_defined", "not_mentioned", "unknown")
SOFT_SHAPES = ("wider_than_tall", "not_mentioned", "unknown")

#: Injected defects: id -> (rule that must find it, phrases of which the first one in the text is removed).
DEFECTS = {
    "missing_composition": ("QC.TEXT_OMITS_STATED_COMPOSITION", ("囊实性", "海绵状", "海绵样", "囊性", "液性", "实性")),
    "missing_echogenicity": ("QC.TEXT_OMITS_STATED_ECHOGENICITY", ("极低回声", "低回声", "高回声", "等回声", "无回声")),
    "missing_shape": ("QC.TEXT_OMITS_STATED_SHAPE", ("呈非高于宽形", "呈高于宽形")),
    "missing_margin": ("QC.TEXT_OMITS_STATED_MARGIN", ("边缘光滑", "边界欠清", "边缘分叶或不规则", "可见甲状腺外侵犯征象")),
    "missing_foci": ("QC.TEXT_OMITS_STATED_FOCI", ("内未见明显强回声", "内见点状强回声", "内见彗尾征", "内见粗大钙化", "周边见环形钙化")),
    "dimension_mismatch": ("QC.TEXT_DIMENSION_MISMATCH", ()),
    "laterality_mismatch": ("QC.TEXT_LOCATION_MISMATCH", ()),
    "unit_mixed": ("QC.UNIT_MIXED_MM_CM", ()),
    "text_contradiction": ("QC.TEXT_FIELD_CONTRADICTION", ()),
    "negation_mislabeled": ("QC.STRUCTURE_NEGATION_MISLABEL", ()),
    "diagnostic_language": ("QC.DIAGNOSTIC_LANGUAGE", ()),
}

#: Control tokens of the character vocabulary, ids from 0; bytes follow from 8, characters from 264.
CONTROL_TOKENS = ("<pad>", "<bos>", "<eos>", "<unk>", "<task_extract>", "<task_generate>", "<input>", "<target>")
FIRST_BYTE, FIRST_CHARACTER = 8, 264
IGNORED_LABEL = -100
