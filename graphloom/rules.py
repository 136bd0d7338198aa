"""Rule packs and lexicons: the replaceable inputs of the text and graph operators.

Everything under "fixed values" has to equal the published rules for results to
be the same; it is kept as plain text in its natural order. A user replaces a
pack by building another ``RulePack`` or by passing own tables to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Text quality (zh)
# --------------------------------------------------------------------------
SURNAMES = (
    "张王李赵刘陈杨黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜"
    "范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段漕钱汤尹黎易常武乔贺赖龚文"
)
PERSON_PATTERN = f"[{SURNAMES}][一-龥]{{1,3}}"
PLACE_PATTERN = "[一-龥]{2,}[市县区镇村]|[一-龥]{2,}[省州]"
ORG_PATTERN = "[一-龥]{2,}[公司企业集团组织机构]"
ORG_PATTERN_COMPLETION = "[一-龥]{2,}[公司企业集团组织机构大学学院]"
RELATION_CUES = ("是", "在", "去", "来自", "属于", "位于", "担任", "工作于", "CEO", "总裁", "经理", "主任", "总部", "分公司")
SENTENCE_MARKS = "[。！？.]"
NOISE_PATTERN = r"啊{3,}|哈{3,}|呵{3,}|[a-zA-Z]{20,}|\p{Nd}{10,}"

ISSUE_TOO_SHORT = "数据过短"
ISSUE_FEW_ENTITIES = "实体信息不足"
ISSUE_NO_RELATION = "缺少关系信息"
ISSUE_NO_MARK = "缺少标点符号"
ISSUE_ALL_UPPER = "全大写格式"
ISSUE_ALL_LOWER = "全小写格式"
CONFLICT_WORD = "冲突"
FORMAT_WORD = "格式"

ADVICE_GOOD = "数据质量良好，可直接用于知识图谱构建"
ADVICE_TOO_SHORT = "建议补充更多详细信息"
ADVICE_FEW_ENTITIES = "建议添加更多实体信息（人名、地名、组织名等）"
ADVICE_NO_RELATION = "建议明确实体间的关系"
ADVICE_CONFLICT = "建议修正语义冲突"
ADVICE_DEFAULT = "建议进行知识补全以提高数据质量"
ADVICE_SEPARATOR = "；"

# --------------------------------------------------------------------------
# Facts and conflict rules
# --------------------------------------------------------------------------
FACTS = (
    ("巴黎", "country", "法国"), ("巴黎", "continent", "欧洲"),
    ("北京", "country", "中国"), ("北京", "continent", "亚洲"),
    ("东京", "country", "日本"), ("东京", "continent", "亚洲"),
    ("伦敦", "country", "英国"), ("伦敦", "continent", "欧洲"),
    ("纽约", "country", "美国"), ("纽约", "continent", "北美洲"),
    ("柏林", "country", "德国"), ("柏林", "continent", "欧洲"),
)
LOCATED_PREDICATES = ("位于", "在", "属于")


@dataclass(frozen=True)
class ConflictRule:
    rule_id: int
    subject: str
    wrong_object: str
    predicate: str
    conflict_type: str
    message: str


CONFLICT_RULES = (
    ConflictRule(1, "巴黎", "德国", "位于", "地理错误", "地理冲突：巴黎不在德国"),
    ConflictRule(2, "北京", "日本", "位于", "地理错误", "地理冲突：北京不在日本"),
)
# subject / object around these words are rewritten, in this order
CORRECTION_TEMPLATES = (("{s}是", "{o}", "城市"), ("", "{o}", "{s}"), ("{s}位于", "{o}", ""), ("{s}在", "{o}", ""))
CORRECTION_MESSAGE = "修正{type}：{subject}属于{right}，不是{wrong}"
PERIOD = "。"
PERIOD_ADDED = "添加句号"
IMPLICIT_NOTES = (("CEO", "隐性知识：CEO通常负责公司战略决策"), ("大学", "隐性知识：大学是教育机构"))

REJECT_BLANK = "输入文本不能为空"
REJECT_NOTHING_FOUND = "无法从输入文本中提取到有效的实体或关系"
REJECT_SUGGESTION = "请尝试输入包含明确实体和关系的文本，例如：'张三担任阿里巴巴公司的CEO'"
SKIP_REASON = "数据质量良好"

# --------------------------------------------------------------------------
# Triples and entity classes
# --------------------------------------------------------------------------
GOOD_TYPE_PAIRS = (
    ("Person", "Organization"), ("Person", "Location"), ("Organization", "Location"), ("Person", "Product"),
)
BASIC_CLASSES = (
    ("Organization", ("大学", "学院", "机构")),
    ("Place", ("市", "省", "区", "县", "国")),
)
BASIC_SURNAMES = "张王李赵刘陈杨黄周吴"
FULL_CLASSES_BEFORE_PERSON = (
    ("Organization", ("大学", "学院", "机构", "公司", "企业", "集团", "组织", "政府", "部门")),
    ("Location", ("市", "省", "区", "县", "国", "街", "路", "广场", "大厦", "中心")),
)
DATE_WORDS = ("年", "月", "日", "时", "点", "期间", "时候")
NUMBER_WORDS = ("万", "亿", "千", "百", "元", "美元", "%", "％")
EVENT_WORDS = ("会议", "活动", "比赛", "项目", "计划", "工程")
PRODUCT_WORDS = ("产品", "软件", "系统", "平台", "应用", "App", "iPhone", "iPad")
FULL_CLASS_NAMES = ("Organization", "Location", "Person", "Date", "Number", "Event", "Product", "Other")

HISTOGRAM_BINS = (
    ("0.0-0.2", "很低(0-0.2)", 0.2), ("0.2-0.4", "较低(0.2-0.4)", 0.4), ("0.4-0.6", "中等(0.4-0.6)", 0.6),
    ("0.6-0.8", "较高(0.6-0.8)", 0.8), ("0.8-1.0", "很高(0.8-1.0)", None),
)

# --------------------------------------------------------------------------
# Entity details
# --------------------------------------------------------------------------
REQUIRED_ATTRIBUTES = {
    "Person": ("姓名", "性别"),
    "Organization": ("名称", "类型"),
    "Location": ("名称", "地理类型"),
    "Product": ("名称", "类别"),
}
OPTIONAL_ATTRIBUTES = {
    "Person": ("年龄", "职业", "出生地", "教育背景", "工作单位"),
    "Organization": ("成立时间", "总部地址", "规模", "行业", "法人代表"),
    "Location": ("所属区域", "人口", "面积", "特色产业"),
    "Product": ("价格", "生产商", "发布时间", "功能特性"),
}
# type, attribute, pattern, group that holds the value
ATTRIBUTE_PATTERNS = (
    ("Person", "年龄", r"(\p{Nd}{1,3})[岁|周岁]", 1),
    ("Person", "职业", r"(CEO|总裁|经理|主任|教授|医生|工程师)", 1),
    ("Person", "出生地", r"[一-龥]{2,}[市县区镇村省州]", 0),
    ("Person", "教育背景", r"[一-龥]{2,}[大学学院]", 0),
    ("Organization", "成立时间", r"(\p{Nd}{4})年", 1),
    ("Organization", "总部地址", r"[一-龥]{2,}[市县区镇村省州]", 0),
    ("Organization", "规模", r"(\p{Nd}+)[人|员工]", 1),
    ("Organization", "行业", r"(科技|金融|教育|医疗|制造)[行业|领域]", 1),
    ("Location", "人口", r"(\p{Nd}+)[万|千]人", 1),
    ("Location", "面积", r"(\p{Nd}+)[平方公里|公顷]", 1),
    ("Location", "所属区域", r"[一-龥]{2,}[省州市县区]", 0),
    ("Product", "价格", r"(\p{Nd}+)[元|美元|USD]", 1),
    ("Product", "发布时间", r"(\p{Nd}{4})年(\p{Nd}{1,2})月", 1),
    ("Product", "生产商", r"[一-龥]{2,}[公司企业集团]", 0),
)
SUBJECT_PREDICATES = (
    (("工作于", "就职于", "任职于"), "工作单位"), (("是", "担任"), "职业"),
    (("位于", "在"), "地址"), (("出生于", "来自"), "出生地"),
)
OBJECT_PREDICATES = ((("雇佣", "聘用"), "雇主"),)
ATTRIBUTE_CLASSES = (
    (("姓名", "名称", "类型"), "基础属性"), (("出生日期", "成立时间", "发布时间"), "时间属性"),
    (("地址", "位置", "总部地址"), "空间属性"), (("职业", "职务", "工作单位"), "关系属性"),
)
ATTRIBUTE_CLASS_DEFAULT = "描述属性"
GAP_SOURCES = ("知识库查询", "文本深度分析")
GAP_EXTRA_SOURCES = (
    ("Person", ("年龄", "出生日期"), "人物百科"), ("Person", ("职业",), "职业数据库"),
    ("Organization", ("成立时间", "总部地址"), "企业信息库"),
)
TYPE_SIMILARITY = (
    ("Person", "Organization", 0.6), ("Organization", "Location", 0.5), ("Person", "Product", 0.4), ("Location", "Product", 0.3),
)
TYPE_SIMILARITY_DEFAULT = 0.1
LABEL_DIRECT, LABEL_COOCCUR, LABEL_TYPE = "直接关系", "高频共现", "类型相关"
RULE_ERRORS = {
    "profession": ("人物职业一致性", "职业与工作单位不匹配"),
    "region": ("地理位置层次性", "地理位置层次关系错误"),
    "founding": ("组织成立时间合理性", "成立时间不合理"),
}

# --------------------------------------------------------------------------
# Global analysis
# --------------------------------------------------------------------------
VERBS = (
    "进行", "执行", "实现", "完成", "处理", "分析", "计算", "生成",
    "创建", "建立", "构建", "开发", "设计", "制作", "产生", "形成",
    "发生", "出现", "存在", "包含", "具有", "拥有", "展示", "显示",
    "导致", "引起", "造成", "促使", "推动", "影响", "改变", "转换",
)
CAUSAL_WORDS = (
    "因为", "由于", "因此", "所以", "导致", "引起", "造成", "促使",
    "结果", "原因", "后果", "影响", "作用", "效果", "产生", "形成",
    "如果", "当", "在", "时候", "条件下", "情况下", "基础上", "前提下",
)
MODULE_CONFIDENCE = (
    ("verb_predicate_analysis", 0.8), ("keyword_frequency_analysis", 0.9),
    ("causal_relationship_analysis", 0.75), ("direct_logic_analysis", 0.85),
)


@dataclass(frozen=True)
class RulePack:
    """What the text operators look for in one family of languages."""

    name: str
    mention_patterns: tuple[str, ...]
    cues: tuple[str, ...]
    conflicts: tuple[ConflictRule, ...] = ()
    sentence_marks: str = SENTENCE_MARKS
    noise: str = NOISE_PATTERN
    # the same as literal words and as runs tried at their first character only
    noise_words: tuple[str, ...] = ("啊啊啊", "哈哈哈", "呵呵呵")
    noise_runs: tuple[str, ...] = ("(?<![a-zA-Z])[a-zA-Z]{20}", r"(?<!\p{Nd})\p{Nd}{10}")
    implicit_notes: tuple[tuple[str, str], ...] = IMPLICIT_NOTES
    # head, cue and tail of a rule triple; three groups
    triple_pattern: str = ""
    # what must hold in front of a match; saves trying every letter of a word
    triple_guard: str = ""
    completion_mentions: tuple[str, ...] = field(default=())


def _by_length(words):
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


ZH = RulePack(
    name="zh",
    mention_patterns=(PERSON_PATTERN, PLACE_PATTERN, ORG_PATTERN),
    cues=RELATION_CUES,
    conflicts=CONFLICT_RULES,
    triple_pattern=f"([一-龥]{{2,}}?)({_by_length(RELATION_CUES)})([一-龥A-Za-z]{{2,}})",
    completion_mentions=(PERSON_PATTERN, PLACE_PATTERN, ORG_PATTERN_COMPLETION),
)

LATIN_CUES = ("of", "for", "with", "from", "de", "para", "con", "dans", "pour", "avec", "von", "mit")
LATIN = RulePack(
    name="latin",
    mention_patterns=("[A-ZÀ-Þ][a-zß-ÿ]{2,}",),
    cues=tuple(f" {w} " for w in LATIN_CUES),
    sentence_marks="[.!?]",
    implicit_notes=(),
    triple_pattern=f"([A-Za-zÀ-ÿ]{{3,}}) ({'|'.join(LATIN_CUES)}) ([A-Za-zÀ-ÿ]{{3,}})",
    triple_guard="(?<![A-Za-zÀ-ÿ])",
    completion_mentions=("[A-ZÀ-Þ][a-zß-ÿ]{2,}",),
)
