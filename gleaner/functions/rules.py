"""Ordered rules compiled to column expressions. Order decides, so rules are lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name prefix and file type.
PREFIX_TYPES = [("00_", "个人总结"), ("01_", "简历"), ("02_", "项目"), ("03_", "博客"), ("04_", "推荐信"), ("05_", "技能全景")]
#: Word in a file name, in any case, and file type.
KEYWORD_TYPES = [
    ("简历", "简历"), ("项目", "项目"), ("博客", "博客"), ("推荐信", "推荐信"), ("resume", "简历"), ("cv", "简历"),
    ("个人总结", "个人总结"), ("技能", "技能全景"), ("技术全景", "技能全景"),
]
OTHER_TYPE = "其他文档"
#: Word in a file name and the project it belongs to.
NAME_PROJECTS = [
    ("AI数字分身", "AI数字分身RAG系统"), ("AI 数字分身", "AI数字分身RAG系统"), ("RAG系统", "AI数字分身RAG系统"), ("MamaCare", "MamaCare孕期智能守护助手"),
    ("孕期", "MamaCare孕期智能守护助手"), ("个人总结", "个人背景"), ("简历", "个人背景"), ("技能", "技能全景"),
]
OTHER_PROJECT = "其他"
#: Pattern in headings or text, and section type.
SECTIONS = [
    ("教育背景|学历|毕业院校|主修|专业|课程|学习经历|在校", "education"),
    ("项目经历|项目经验|项目概述|项目成果|核心项目|主要项目|项目描述", "project"),
    ("技术(栈|能力|技能|特长)|编程语言|开发能力|熟练掌握|精通|了解.*框架", "skills"),
    ("工作经历|实习经历|工作经验|任职|在职|就职", "experience"),
    ("自我(介绍|评价|描述)|个人(简介|概述|特点)|关于我|基本信息", "self_intro"),
    ("获得荣誉|获奖|证书|竞赛|奖学金|荣誉称号", "awards"),
    ("联系方式|电话|邮箱|地址|GitHub|博客|主页", "contact"),
    ("推荐信|推荐人|推荐理由", "recommendation"),
]
OTHER_SECTION = "general"
#: Section types a question can ask for, and words that tell.
INTENTS = [
    ("skills", ["技能", "技术栈", "框架", "语言", "工具", "掌握", "精通", "熟练", "会什么", "编程", "开发能力", "擅长", "用过"]),
    ("education", ["教育", "学校", "毕业", "学历", "专业", "课程", "GPA", "学位", "大学", "学院", "成绩"]),
    ("project", ["项目", "开发", "架构", "系统", "实现", "设计", "经历", "经验", "RAG", "Agent", "MamaCare", "数字分身"]),
    ("experience", ["工作", "实习", "任职", "公司", "团队", "角色"]),
    ("self_intro", ["自我介绍", "介绍你自己", "背景", "你是谁", "个人总结", "概述", "简单介绍"]),
    ("awards", ["获奖", "荣誉", "证书", "竞赛", "奖学金", "比赛"]),
    ("contact", ["联系", "邮箱", "电话", "GitHub", "地址"]),
]
#: Projects a question can ask for, and words that tell.
QUESTION_PROJECTS = [
    ("AI数字分身RAG系统", ["AI数字分身", "AI 数字分身", "RAG系统", "RAG 系统", "数字分身", "混合检索", "RRF", "五级切分", "六级切分"]),
    ("MamaCare孕期智能守护助手", ["MamaCare", "孕期", "智能守护", "孕妇", "产检", "多Agent", "多 Agent", "LangGraph"]),
]
#: How a section type is shown.
SECTION_LABELS = {
    "education": "教育背景", "project": "项目经历", "skills": "技能", "experience": "工作经历", "self_intro": "自我介绍", "awards": "荣誉奖项",
    "contact": "联系方式", "recommendation": "推荐信", "general": "综合",
}


def first_of(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """The value of the first condition that holds."""
    if not cases:
        return F.lit(default)
    out = F.when(*_lit(cases[0]))
    for case in cases[1:]:
        out = out.when(*_lit(case))
    return out.otherwise(F.lit(default))


def _lit(case: tuple[Column, str]) -> tuple[Column, Column]:
    return F.coalesce(case[0], F.lit(False)), F.lit(case[1])


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def file_type(name: Column, prefixes=PREFIX_TYPES, keywords=KEYWORD_TYPES, default: str = OTHER_TYPE) -> Column:
    low = F.lower(name)
    return first_of([(F.startswith(name, F.lit(p)), t) for p, t in prefixes] + [(F.contains(low, F.lit(k.lower())), t) for k, t in keywords], default)


def project(name: Column, keywords=NAME_PROJECTS, default: str = OTHER_PROJECT) -> Column:
    return first_of([(F.contains(name, F.lit(k)), p) for k, p in keywords], default)


def section_type(text: Column, headings: Column | None = None, rules=SECTIONS, default: str = OTHER_SECTION) -> Column:
    """By the first pattern found in the headings and the first 200 characters, in lower case."""
    head = F.coalesce(F.array_join(headings, " "), F.lit("")) if headings is not None else F.lit("")
    seen = F.lower(F.concat(head, F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 200)))
    # Put together once, not for each rule.
    return F.get(F.transform(F.array(seen), lambda x: first_of([(F.rlike(x, F.lit(p)), s) for p, s in rules], default)), F.lit(0))


def intents(question: Column, rules=INTENTS) -> Column:
    """All section types with a word in the question, in rule order."""
    return F.array_compact(F.array(*[F.when(any_word(question, words), F.lit(s)) for s, words in rules]))


def target_project(question: Column, rules=QUESTION_PROJECTS) -> Column:
    return first_of([(any_word(question, words), p) for p, words in rules], None)
