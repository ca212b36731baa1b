"""Fixed values.

Everything in this module is a constant that decides results: field names,
label words, extraction patterns, key words, thresholds, messages and output
formats. They are data, kept together and in their natural order.
"""

# --- Fixed values: the appliance field catalogue ---------------------------
# (field id, display name, value kind, required, fix OCR digits,
#  label words in order, extraction patterns in order)
APPLIANCE_FIELDS = [
    ("product_name", "产品名称", "text", False, False,
     ["产品名称", "NAME", "PRODUCT NAME"],
     []),
    ("product_model", "产品型号", "model", True, False,
     ["产品型号", "MODEL", "MODEL NO", "PRODUCT MODEL"],
     [r"\bModel\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9./ _()~-]{1,40})",
      r"规格型号\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9./ _()~-]{1,40})"]),
    ("rated_voltage", "额定电压", "unit", True, True,
     ["额定电压", "VOLTAGE", "RATED VOLTAGE"],
     [r"Rated\s+Voltage\s*[:：]?\s*([0-9OISBl.\-~～ ]+\s*V\s*~?)"]),
    ("rated_power", "额定功率", "unit", False, True,
     ["额定功率", "POWER", "RATED POWER"],
     []),
    ("version", "版本号", "version", False, False,
     ["版本号", "VERSION", "REVISION", "REV"],
     [r"版本号\s*[:：]?\s*([A-Za-z0-9. _-]{1,20})"]),
    ("serial_no", "序列号", "code", False, False,
     ["序列号", "S/N", "SN", "SERIAL NUMBER", "SERIAL NO", "SERIAL"],
     [r"\b(?:S/N|SN|SERIAL(?:\s+NO)?)\s*[:：]?\s*([A-Za-z0-9._/-]{3,40})"]),
    ("producer", "生产者名称", "text", False, False,
     ["生产者名称", "生产商", "制造商", "PRODUCER", "MANUFACTURER"],
     [r"生产者名称\s*[:：]?\s*([^\n\r]{2,60})"]),
    ("spec_model", "规格型号", "model", True, False,
     ["规格型号", "型号规格", "MODEL", "MODEL NUMBER", "MODEL NO"],
     [r"规格型号\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9./ _()~-]{1,50})",
      r"\bModel\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9./ _()~-]{1,50})",
      r"\bMODEL\s+NUMBER\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9./ _()~-]{1,50})"]),
    ("energy_class", "能效等级", "code", False, True,
     ["能效等级", "ENERGY CLASS", "ENERGY EFFICIENCY CLASS"],
     [r"([1-5A-G])\s*(?:级|等級|CLASS)"]),
    ("energy_use", "耗电量", "unit", True, True,
     ["耗电量", "耗电量(千瓦时/工作周期)", "ENERGY CONSUMPTION"],
     [r"耗电量[^\n\r\d]{0,30}([0-9OISBl.]+)"]),
    ("water_use", "用水量", "unit", True, True,
     ["用水量", "用水量(升/工作周期)", "WATER CONSUMPTION"],
     [r"用水量[^\n\r\d]{0,30}([0-9OISBl.]+)"]),
    ("wash_ratio", "洗净比", "number", True, True,
     ["洗净比", "WASH RATIO"],
     [r"洗净比\s*([0-9OISBl.]+)"]),
    ("wash_spin_capacity", "洗涤/脱水容量", "unit", True, True,
     ["洗涤/脱水容量", "洗涤/脱水容量(公斤)"],
     [r"洗涤\s*/\s*脱水容量[^\n\r\d]{0,20}([0-9OISBl.]+\s*/\s*[0-9OISBl.]+)"]),
    ("annual_energy", "年耗电量", "unit", True, True,
     ["年耗电量", "ANNUAL ENERGY CONSUMPTION", "ANNUAL ENERGY CONSUMPTION KWH"],
     [r"(?:ANNUAL\s+ENERGY\s+CONSUMPTION|KWH)\D{0,30}([0-9OISBl.]+)\s*(?:KWH|kWh)?"]),
    ("annual_water", "年耗水量", "unit", True, True,
     ["年耗水量", "ANNUAL WATER CONSUMPTION", "LITER"],
     [r"(?:ANNUAL\s+WATER\s+CONSUMPTION|LITER)\D{0,30}([0-9OISBl.]+)\s*(?:LITER|L)?"]),
    ("rated_capacity", "额定容量", "unit", True, True,
     ["额定容量", "CAPACITY", "Rated Capacity"],
     [r"\bCAPACITY\D{0,20}([0-9OISBl.]+)\s*(?:KG|kg)?"]),
    ("waterproof_class", "防水等级", "code", True, False,
     ["防水等级", "DEGREE OF WATER-PROOF", "WATER-PROOF", "IP"],
     [r"Degree\s+of\s+Water[- ]Proof\s*[:：]?\s*([A-Za-z0-9]+)"]),
    ("rated_frequency", "额定频率", "unit", True, True,
     ["额定频率", "FREQUENCY", "RATED FREQUENCY"],
     [r"Rated\s+Frequency\s*[:：]?\s*([0-9OISBl.]+\s*Hz)"]),
    ("wash_capacity", "洗涤容量", "unit", True, True,
     ["洗涤容量", "RATED CAPACITY OF WASH", "CAPACITY OF WASH"],
     [r"Rated\s+Capacity\s+of\s+Wash\s*[:：]?\s*([0-9OISBl.]+\s*kg)"]),
    ("spin_capacity", "脱水容量", "unit", True, True,
     ["脱水容量", "RATED CAPACITY OF SPIN", "CAPACITY OF SPIN"],
     [r"Rated\s+Capacity\s+of\s+Spin\s*[:：]?\s*([0-9OISBl.]+\s*kg)"]),
    ("wash_power", "洗涤输入功率", "unit", True, True,
     ["洗涤输入功率", "RATED INPUT POWER OF WASH", "INPUT POWER OF WASH"],
     [r"Rated\s+Input\s+Power\s+of\s+Wash\s*[:：]?\s*([0-9OISBl.]+\s*W)"]),
    ("spin_power", "脱水输入功率", "unit", True, True,
     ["脱水输入功率", "RATED INPUT POWER OF SPIN", "INPUT POWER OF SPIN"],
     [r"Rated\s+Input\s+Power\s+of\s+Spin\s*[:：]?\s*([0-9OISBl.]+\s*W)"]),
    ("made_in", "制造地", "text", False, False,
     ["制造地", "MADE IN", "MADE IN CHINA"],
     [r"MADE\s+IN\s+([A-Za-z ]{2,30})"]),
    ("brand", "品牌", "text", False, False,
     ["品牌", "BRAND", "BRAND NAME"],
     [r"\bBRAND\s+NAME\s*[:：]?\s*([A-Za-z0-9 _-]{2,40})"]),
    ("registration_no", "注册号", "code", False, True,
     ["注册号", "REGISTRATION NO", "REGISTRATION NUMBER"],
     [r"\bREGISTRATION\s+NO\D{0,20}([0-9OISBl Vv.-]{2,30})"]),
    ("part_code", "编码", "code", False, True,
     ["编码", "CODE", "PART NO", "图纸编号"],
     [r"编码\s*[:：]?\s*([0-9OISBl]{5,12})",
      r"\b(100[0-9OISBl]{5})\b"]),
    ("project_name", "项目名称", "text", False, False,
     ["项目名称", "PROJECT NAME"],
     [r"项目名称\s*[:：]?\s*([^\n\r]{2,40})"]),
    ("label_name", "标签名称", "text", False, False,
     ["标签名称", "LABEL", "RATING LABEL", "ENERGY LABEL"],
     [r"(能效标签\s+LABEL-ENERGY|铭牌\s*RATING\s*LABEL|电器铭牌\s*LABEL-RATING)"]),
]

# Fields shown when a document has no recognised field at all: the first six.
DEFAULT_FIELD_COUNT = 6

# Two model fields stand in for each other when only one is recognised.
MODEL_PAIR = ("product_model", "spec_model")

# --- Fixed values: the six-field profile and its label words ----------------
SIX_FIELDS = [
    ("product_name", "产品名称",
     ["产品名称", "产品名称 / NAME", "产品名称/NAME", "NAME"]),
    ("product_model", "产品型号",
     ["产品型号", "产品型号 / MODEL", "产品型号/MODEL", "MODEL"]),
    ("rated_voltage", "额定电压",
     ["额定电压", "额定电压 / VOLTAGE", "额定电压/VOLTAGE", "VOLTAGE"]),
    ("rated_power", "额定功率",
     ["额定功率", "额定功率 / POWER", "额定功率/POWER", "POWER"]),
    ("version", "版本号",
     ["版本号", "版本号 / VERSION", "版本号/VERSION", "VERSION", "REVISION", "REV"]),
    ("serial_no", "序列号",
     ["序列号", "序列号 / S/N", "序列号/S/N", "S/N", "SERIAL NUMBER", "SERIAL NO"]),
]

# --- Fixed values: words that mark a line as no value ------------------------
NOISE_WORDS = ["CMYK", "借通用件登记", "描图", "校描", "签字", "日期", "比例", "单位",
               "技术要求", "材质工艺要求", "更改文件号", "旧底图总号", "二维码", "QR"]

# --- Fixed values: key words that score a text -------------------------------
PAGE_KEYWORDS = ["MODEL", "规格型号", "耗电量", "Rated", "Capacity", "编码", "能效", "铭牌"]
LABEL_KEYWORDS = ["MODEL", "规格型号", "耗电量", "Rated", "Capacity", "Multilingual",
                  "能效", "铭牌"]

# --- Fixed values: known phrases used when nothing else set the field --------
MADE_IN_CHINA_PATTERN, MADE_IN_CHINA_VALUE = r"MADE\s+IN\s+CHINA", "China"
KNOWN_BRANDS = ["impex", "DEFY"]
LABEL_NAME_RULES = [
    (r"CHINA\s+ENERGY\s+LABEL|中国能效标识|能效标签", "能效标签"),
    (r"RATING\s+LABEL|铭牌", "铭牌"),
    (r"Multilingual\s+Overview", "Multilingual Overview"),
]
PROJECT_NAME_PATTERN = r"项目名称\s*[:：]?\s*([^\n\r]{2,40})"

# Words of which a text must hold one for the pattern to match at all (pattern
# number within its field); patterns not listed start with their word.
PATTERN_WORDS = {
    ("serial_no", 0): ["S/N", "SN", "SERIAL"],
    ("energy_class", 0): ["级", "等級", "CLASS"],
    ("annual_energy", 0): ["ANNUAL", "KWH"],
    ("annual_water", 0): ["ANNUAL", "LITER"],
    ("part_code", 1): ["100"],
    ("label_name", 0): ["能效标签", "铭牌"],
}
PHRASE_WORDS = {"made_in": ["MADE"], "brand": ["impex", "DEFY"],
                "label_name": ["LABEL", "能效", "铭牌", "Multilingual"]}

# --- Fixed values: limits and thresholds -------------------------------------
MAX_VALUE_CHARS = 90
LOOKAHEAD_LINES = 5
SIX_FIELD_LOOKAHEAD_LINES = 3
MAX_LABELS_PER_CASE = 5
MIN_DIRECT_TEXT_CHARS = 80
ENOUGH_FIELDS = 4
LABEL_SCORE_FLOOR = 0.30
PAGE_SCORE_FLOOR = 0.25
COMPAT_SCORE_FLOOR = 0.50
LOW_MEAN_CONFIDENCE = 0.65
LOW_LINE_CONFIDENCE = 0.80
EXPORT_TEXT_CHARS = 30000
TRIM_NOTE = ("\n...[trimmed ", " chars]")
SCORE_PER_FIELD, SCORE_PER_KEYWORD, SCORE_PER_CONFIDENCE = 20, 4, 10
SCORE_TEXT_CAP, SCORE_TEXT_UNIT = 2000, 1000
MATCH_CONFIDENCE, MISMATCH_CONFIDENCE = 0.98, 0.95

# --- Fixed values: states, verdicts and display words ------------------------
# Per-field results and per-record verdicts, with the words shown to people.
RESULT_WORDS = {"PASS": "PASS", "FAIL": "FAIL", "UNKNOWN": "无法判断"}
VERDICT_WORDS = {"PASS": "PASS", "FAIL": "FAIL", "REVIEW": "待人工确认"}
YES_NO = ("是", "否")
RECOGNISED_WORDS = ("成功", "未识别")

SPEC_REASONS = {
    "not_applicable": "图纸和标签均未识别到该字段。",
    "drawing_missing": "图纸字段未识别，无法判断标签是否一致。",
    "label_missing": "标签字段缺失或OCR未识别，需要人工确认。",
    "match": "标准化后完全一致。",
    "mismatch": "标准化后仍不一致。",
}
LABEL_REASONS = {
    "not_applicable": "两张标签均未识别到该字段。",
    "baseline_missing": "基准标签未识别到该字段。",
    "target_missing": "对比标签缺少该字段或OCR未识别成功。",
    "match": "标准化后完全一致。",
    "mismatch": "标签之间字段值不一致。",
}
ISSUE_WORDS = {
    "missing_and_differs": "部分标签缺失且字段值不一致",
    "missing": "部分标签未识别该字段",
    "differs": "字段值不一致",
}
NO_DIFFERENCE_TEXT = "未发现标签之间存在字段差异。"

# --- Fixed values: warnings and failure reasons -------------------------------
WARN_TEXT_TOO_SHORT = "PDF文字层为空或有效字段过少，已启用PDF OCR模式。"
WARN_TOO_FEW_FIELDS = "PDF文字层存在但关键字段命中过少，已补充PDF OCR模式。"
WARN_OCR_FAILED = "PDF OCR失败，保留文字层结果："
WARN_NO_FIELDS = "OCR未提取到可比较字段，需要人工确认。"
WARN_LOW_CONFIDENCE = "OCR平均置信度偏低。"
REASON_SCANNED = "PDF 是扫描件或关键字段需要 OCR 补充"
REASON_NO_TEXT = "PDF 没有解析出文字"
REASON_DRAWING_UNMATCHED = "PDF 字段名称未匹配或正则表达式不支持真实格式"
REASON_LABEL_UNMATCHED = "标签字段名称未匹配或 OCR 漏字/错字"
REASON_UNSURE = "OCR 不确定"
REASON_BY_STATUS = {
    "mismatch": " 字段值没有标准化或真实不一致",
    "label_missing": " 标签缺失或未识别",
    "drawing_missing": " 图纸缺失或未识别",
}
REASON_ROTATED = "标签图片旋转"
ROTATION_MARK = "90"
ERROR_DRAWING, ERROR_LABEL = "PDF处理失败：", " OCR失败："

# --- Fixed values: formats ----------------------------------------------------
PAGE_HEADER = ("===== 第 ", " 页 =====\n")
OCR_PAGE_HEADER = ("===== 第 ", " 页 OCR =====\n")
PAGE_SEPARATOR = "\n\n"
LIST_SEPARATOR, MESSAGE_SEPARATOR = "、", "；"
NON_PASS_FORMAT = "%s：图纸值为「%s」，标签值为「%s」。%s"
REPORT_NAME_PREFIX, BATCH_REPORT_NAME_PREFIX = "检测报告_", "批量检测总报告_"
REPORT_NAME_SUFFIX = ".xlsx"
DRAWING_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]
ROTATABLE_SUFFIXES = [".jpg", ".jpeg", ".png"]
LABEL_DIR_PREFIX = "label"

# --- Fixed values: display column names ---------------------------------------
HISTORY_HEADERS = {
    "detection_id": "检测编号", "detection_time": "检测时间", "drawing_file": "图纸文件名",
    "label_file": "标签文件名", "result": "总体结果", "n_pass": "一致字段数量",
    "n_fail": "异常字段数量", "n_unknown": "无法判断数量", "report_path": "Excel报告路径",
}
COMPARISON_HEADERS = {
    "field_name": "字段名称", "drawing_value": "图纸值", "label_value": "标签值",
    "drawing_raw": "图纸原始值", "drawing_norm": "图纸标准化值",
    "label_raw": "标签原始值", "label_norm": "标签标准化值", "status": "字段状态",
    "result": "检测结果", "reason": "异常说明", "required": "是否必填",
    "confidence": "置信度",
}

# What may follow a label word on its line (the value is the group).
AFTER_WORD = [r"(?U)^\s*[:：]\s*(.+)$", r"(?U)^\s{2,}(.+)$",
              r"(?U)^\s+([A-Za-z0-9][A-Za-z0-9./ _()~:-]{0,60})$"]
SIX_AFTER_WORD = [r"(?U)^\s*[:：]\s*(.+)$", r"(?U)^\s+(.+)$"]
