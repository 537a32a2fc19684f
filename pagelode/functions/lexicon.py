"""Fixed values of the text rules; another language or domain brings its own tables."""

# Metric families and their aliases.
METRICS: dict[str, tuple[str, ...]] = {
    "营业收入": ("营业收入", "营收"),
    "归母净利润": ("归属于上市公司股东的净利润", "归母净利润", "净利润"),
    "经营活动现金流量净额": ("经营活动产生的现金流量净额", "经营活动现金流量净额"),
    "研发投入": ("研发投入", "研发费用", "研发支出"),
    "资产总额": ("资产总额", "总资产"),
    "负债合计": ("负债合计", "负债总额"),
    "报告标题": ("报告标题", "标题处显示", "标题是什么"),
    "报告年度": ("报告年度", "对应的报告年度", "哪一年"),
    "风险": ("主要风险", "风险因素", "风险"),
    "同比变化": ("同比", "本年比上年增减", "增减幅度", "相比上年"),
}
# Units, longest first.
UNITS = ("人民币元", "人民币万元", "人民币亿元", "百分点", "万元", "亿元", "元", "%")
# Words that are no keywords.
STOP_WORDS = ("多少", "是什么", "是多少", "披露", "显示", "首页", "标题处", "这份", "年度报告", "报告", "对应", "公司", "中", "的", "了", "和", "或")
# Parts that make a run no keyword.
STOP_PARTS = ("哪一年", "是多少", "是什么")
# Keywords of financial lines, in the order in which metric rows are cut.
FINANCIAL = ("营业收入", "归属于上市公司股东的净利润", "经营活动产生的现金流量净额", "研发投入", "研发费用", "资产总额", "负债合计")
# Clues of numeric questions, table terms, narrative terms, cover terms.
NUMERIC_CLUES = ("多少", "增减", "幅度", "收入", "利润", "现金流", "资产", "负债", "研发")
TABLE_TERMS = ("项目", "2024", "2025", "2023", "本年比上年", "同比", "单位")
NARRATIVE_TERMS = ("关键审计事项", "审计", "管理层", "风险", "会计政策", "确认时点")
COVER_QUESTION = ("报告年度", "报告标题", "首页", "标题处")
COVER_TEXT = ("年度报告", "证券代码", "证券简称")
# Question terms and the section words they call for; the first row that fits decides.
SECTIONS = (
    (("营业收入", "归属于上市公司股东的净利润", "资产总额"), ("主要会计数据", "财务指标", "本年比上年增减")),
    (("现金流量净额", "经营活动"), ("现金流量数据", "现金流量表", "经营活动")),
    (("研发投入", "研发费用"), ("研发投入", "研发费用", "研发人员", "研发支出")),
    (("同比", "增减幅度", "相比上年"), ("本年比上年增减", "同比", "增减")),
)
# Risk headings in order.
RISK_TERMS = ("风险因素", "可能面对的风险", "公司面临的风险", "风险")
# Regular expressions (Java). \d and \s take Unicode digits and white space.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TOKEN = "([a-z0-9_]+|[一-鿿])"
YEAR = r"(?U)20\d{2}"
NUMBER_LIKE = r"(?U)[-+]?[(（]?\d[\d,]*(?:\.\d+)?[)）]?%?"
NUMBER = r"(?U)\(?-?\d[\d,]*(?:\.\d+)?\)?"
PERCENT = r"(?U)-?\d+(?:\.\d+)?%"
ANSWER_NUMBER = r"(?U)[-+]?\(?\d[\d,]*(?:\.\d+)?\)?%?"
ANSWER_UNIT = r"人民币元|人民币万元|人民币亿元|万元|亿元|元|%|百分点"
HAS_UNIT = r"(?:人民币)?(?:元|万元|亿元)|%|百分点"
UNIT_NOTE = r"(?U)单位[：:][\s\x1c-\x1f]*([人民币元万元亿元百万元千元]+)"
NUMERIC_SHAPE = (
    r"(?U)[(（]\s*[-+]?\d[\d,]*(?:\.\d+)?\s*[)）]"
    r"|[-+]?\d[\d,]*(?:\.\d+)?\s*%"
    r"|[-+]?\d[\d,]*(?:\.\d+)?\s*(?:元|万元|亿元|百分点)"
    r"|\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|[-+]?\d+\.\d+"
)
KEYWORD_RUN = "[一-鿿A-Za-z%]{2,}"
