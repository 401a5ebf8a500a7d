"""A wording for the test tables' views, as rows of (what, key, lang, n, texts)."""

from __future__ import annotations

# The kinds of view and the labels that occur in the tables.
_FIELDS = [
    ("abstract", "en", [["headline", "summary"], ["name of the work", "gist"]]),
    ("abstract", "zh", [["篇名", "提要"], ["作品", "大意"]]),
    ("comment", "en", [["remark", "about"], ["opinion", "object"]]),
    ("comment", "zh", [["看法", "对象"], ["意见", "主题"]]),
    ("dialogue", "en", [["asked", "answered"], ["turn 1", "turn 2"]]),
    ("dialogue", "zh", [["提问", "回答"], ["第一轮", "第二轮"]]),
    ("pair", "en", [["left", "right"], ["this one", "that one"]]),
    ("pair", "zh", [["左句", "右句"], ["此句", "彼句"]]),
    ("passage", "en", [["excerpt", "matter"]]),
    ("passage", "zh", [["选段", "事项"]]),
    ("utterance", "en", [["said"], ["spoken words"]]),
    ("utterance", "zh", [["所说"], ["口述"]]),
]
_TASKS = [
    ("choice", "en", ["Name the option that goes with {0}.", "Of the options, which belongs to {last} ({arg})?"]),
    ("choice", "zh", ["指出与{0}相配的选项。", "{last}（{arg}）属于哪个选项？"]),
    ("score", "en", ["Place {last} on the scale given {0}."]),
    ("score", "zh", ["根据{0}，{last}在量表上处于何处？"]),
    ("noul", "en", ["Would you say so of {0}?", "Do {0} and {last} bear this out?"]),
    ("noul", "zh", ["{0}是这样吗？", "{0}与{last}能证实吗？"]),
]
_LABELS = [("poor", "差"), ("weak", "较差"), ("fair", "中等"), ("good", "良好"), ("excellent", "优秀"), ("very low", "很低"), ("low", "较低"), ("medium", "一般"), ("high", "较高"), ("very high", "很高")]

ROWS: list[tuple[str, str, str, int, list[str]]] = [
    *(("field", key, lang, n, names) for key, lang, each in _FIELDS for n, names in enumerate(each)),
    *(("task", key, lang, n, [text]) for key, lang, each in _TASKS for n, text in enumerate(each)),
    *(("label", en, lang, 0, [text]) for en, zh in _LABELS for lang, text in (("en", en), ("zh", zh))),
    ("levels", "", "en", 0, ["below the middle", "the middle", "above the middle"]),
    ("levels", "", "zh", 0, ["中间以下", "中间", "中间以上"]),
    ("answers", "", "en", 0, ["not so", "so"]),
    ("answers", "", "zh", 0, ["不然", "是的"]),
]
