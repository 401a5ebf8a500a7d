"""Converters: rows of a source to unified records, one engine driven by a declaration per source.

A declaration names the shape of the source, its columns, its class names and the shares of the question forms it branches into.
Everything random follows a digest of the source, the split and the row. Rows with blank texts or without a valid label give
no record. Test rows always get the full list of options. Class names that a source keeps outside its rows are a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import arrays as A
from sievemill.functions import text as X
from sievemill.functions.hashing import number, ordered, pick, place, uniform
from sievemill.operators.sampling import negatives, sample, sample_per
from sievemill.session import spread

SEED = "13"


@dataclass(frozen=True)
class Spec:
    source: str
    lang: str
    shape: str
    columns: dict[str, str]  #: role of a column to its name; dots lead into structs
    names: tuple[str, ...] = ()  #: classes, or levels in ascending order
    second: tuple[str, ...] = ()  #: of a second list of classes
    full: float = 1.0  #: share of train and dev rows with the full list of options
    subset: float = 0.0  #: share with 4 to 12 of them, or of the second form; the rest are yes-no questions
    edges: tuple[float, ...] = ()  #: of binned numbers
    cuts: tuple[int, int] = (1 << 20, 1 << 20)  #: most characters of prompt and reply, or least and most of a text
    base: int = 1  #: the number of the first option, where answers are numbers
    choices: tuple[str, ...] = ()  #: columns that make up the options, where there is no array
    scale: tuple[float, float] = (0.0, 1.0)  #: lowest and highest rating
    ratings: int = 2  #: fewer ratings than that give no label
    first: float = 1.0  #: share of replies rated by the first attribute, where it is rated
    extras: bool = False  #: a record for each further attribute too, in training
    sample: dict[str, int] = field(default_factory=dict)  #: most rows of a split
    per_bin: dict[str, int] = field(default_factory=dict)  #: most rows of each bin of a split
    question: str = "Which label fits the text best?"
    yes_no: str = "Does this label fit the text: {}?"
    questions: tuple[str, ...] = ()


Out = dict[str, Column]
SHAPES: dict[str, Callable[[Spec, Column, Column], Out]] = {}


def _position(gold: Column) -> Column:
    """Place from one of the gold among the record's options, which are made in a step before."""
    return F.array_position("_o", gold)


def shape(f):
    SHAPES[f.__name__] = f
    return f


def _u(spec: Spec, split: Column, row: Column, *purpose: str) -> Column:
    return uniform(SEED, spec.source, *purpose, split, row)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _view(kind: str, texts: Column, task: str | Column, arg: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), texts.alias("text"), (F.lit(task) if isinstance(task, str) else task).alias("task"), (arg if arg is not None else _none("string")).alias("arg"))


def _number(spec: Spec, role: str = "label") -> Column:
    return F.col(spec.columns[role]).try_cast("int")


def _asked(template: str, arg: Column) -> Column:
    """The template with arg in place of {}."""
    head, *rest = template.split("{}", 1)
    return F.concat(F.lit(head), arg, F.lit(rest[0])) if rest else F.lit(template)


def some_of(names: tuple[str, ...], gold: Column, least: int, most: int, n: Column, u: Column) -> Column:
    """The gold and other names, least to most in all or as many as there are, in an order of their own."""
    k = F.least(F.lit(len(names)), F.lit(least) + F.floor(u * (most - least + 1)).cast("int"))
    keyed = [F.struct(F.when(F.lit(x) == gold, -1).otherwise(place(x, n, "pick")), place(x, n, "order").alias("at"), F.lit(x).alias("name")) for x in names]
    chosen = F.slice(F.array_sort(F.array(*keyed)), F.lit(1), k)
    return F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["at"], x["name"].alias("name")))), lambda x: x["name"])


def first_but(names: tuple[str, ...], n: Column, fits: Callable[[Column], Column]) -> Column:
    """The first fitting name in the order of negatives; null if none fits."""
    keyed = F.array(*(F.struct(place(x, n, "negative").alias("at"), F.lit(x).alias("name")) for x in names))
    return F.array_min(F.filter(keyed, lambda x: fits(x["name"])))["name"]


def _of(names: tuple[str, ...], raw: Column) -> Column:
    """A class by its name or number from zero; null if it is neither."""
    text = raw.cast("string")
    return F.coalesce(F.when(text.isin(*names), text), F.get(_strings(names), text.try_cast("int")))


@shape
def pair(spec: Spec, split: Column, row: Column) -> Out:
    """Two sentences and whether they mean the same: yes or no."""
    a, b, y = F.col("_a"), F.col("_b"), _number(spec)
    one, two = ("句子A：", "\n句子B：") if spec.lang == "zh" else ("Sentence A: ", "\nSentence B: ")
    q = pick(_strings(spec.questions or (spec.yes_no,)), _u(spec, split, row, "question"))
    return {"type": F.lit("noul"), "question": q, "options": _none("array<string>"), "context": F.concat(F.lit(one), a, F.lit(two), b), "label": F.when(y.isin(0, 1), y), "view": _view("pair", F.array(a, b), "noul"), "units": F.array(a, b), "ok": (a != "") & (b != "")}


@shape
def labelled(spec: Spec, split: Column, row: Column) -> Out:
    """A text and its class, by name or index: the full list, some of it, or yes or no about one class."""
    text, n = F.col("_a"), F.col("_n")
    gold = _of(spec.names, F.col(spec.columns["label"]))
    u = _u(spec, split, row, "form")
    full = (split == "test") | (u < spec.full)
    some = ~full & (u < spec.full + spec.subset)
    yes = _u(spec, split, row, "positive") < 0.5
    other = first_but(spec.names, n, lambda x: x != gold)
    asked = F.when(yes, gold).otherwise(other)
    options = F.when(full, ordered(spec.names, n, "order")).when(some, some_of(spec.names, gold, 4, 12, n, _u(spec, split, row, "k")))
    choice = full | some
    return {"type": F.when(choice, "choice").otherwise("noul"), "question": F.when(choice, F.lit(spec.question)).otherwise(_asked(spec.yes_no, asked)), "options": options, "context": text, "label": F.when(choice, (_position(gold) - 1).cast("int")).otherwise(yes.cast("int")), "view": _view("utterance", F.array(text), F.when(choice, "choice").otherwise("noul"), F.when(~choice, asked)), "units": F.array(text), "ok": (text != "") & gold.isNotNull() & asked.isNotNull()}


@shape
def intents(spec: Spec, split: Column, row: Column) -> Out:
    """An utterance with an intent (names) and a scenario (second): the intent, half of the time among some, the scenario, or yes or no
    about an intent. full and subset are the shares of the first two forms."""
    text, n = F.col("_a"), F.col("_n")
    gold, scene = _of(spec.names, F.col(spec.columns["label"])), _of(spec.second, F.col(spec.columns["second"]))
    u = _u(spec, split, row, "form")
    every = (split == "test") | (u < spec.full / 2)
    some = ~every & (u < spec.full)
    scenario = ~every & ~some & (u < spec.full + spec.subset)
    yes = _u(spec, split, row, "positive") < 0.5
    asked = F.when(yes, gold).otherwise(first_but(spec.names, n, lambda x: x != gold))
    options = F.when(every, ordered(spec.names, n, "order")).when(some, some_of(spec.names, gold, 4, 12, n, _u(spec, split, row, "k"))).when(scenario, ordered(spec.second, n, "scenario"))
    choice = every | some | scenario
    label = F.when(scenario, _position(scene)).otherwise(_position(gold))
    return {"type": F.when(choice, "choice").otherwise("noul"), "question": F.when(choice, F.lit(spec.question)).otherwise(_asked(spec.yes_no, asked)), "options": options, "context": text, "label": F.when(choice, F.nullif(label, F.lit(0)).cast("int") - 1).otherwise(yes.cast("int")), "view": _view("utterance", F.array(text), F.when(choice, "choice").otherwise("noul"), F.when(~choice, asked)), "units": F.array(text), "ok": (text != "") & gold.isNotNull()}


@shape
def dialogue(spec: Spec, split: Column, row: Column) -> Out:
    """A turn of a dialogue after the other side's last one, with the arrays of its domains and of the slots it asks for: the domain where there is one
    (a share `full`), the slot among 3 to 6 where there is one (up to `full` and `subset`), or whether anything is asked for."""
    text, before, n = F.col("_a"), F.nullif(F.col("_b"), F.lit("")), F.col("_n")
    domains, slots = F.col(spec.columns["domains"]), F.col(spec.columns["slots"])
    u = _u(spec, split, row, "form")
    domain = F.when(F.size(domains) == 1, _of(spec.names, F.get(domains, F.lit(0))))
    slot = F.when(F.size(slots) == 1, _of(spec.second, F.get(slots, F.lit(0))))
    first = F.coalesce(domain.isNotNull() & (u < spec.full), F.lit(False))
    second = F.coalesce(~first & slot.isNotNull() & (u < spec.full + spec.subset), F.lit(False))
    options = F.when(first, ordered(spec.names, n, "order")).when(second, some_of(spec.second, slot, 3, 6, n, _u(spec, split, row, "k")))
    label = F.when(first | second, (_position(F.when(first, domain).otherwise(slot)) - 1).cast("int")).otherwise((F.size(slots) > 0).cast("int"))
    said = ("系统：", "\n用户：") if spec.lang == "zh" else ("System: ", "\nUser: ")
    context = F.when(before.isNull(), text).otherwise(F.concat(F.lit(said[0]), before, F.lit(said[1]), text))
    q = spec.questions or (spec.question, spec.question, spec.yes_no)
    return {"type": F.when(first | second, "choice").otherwise("noul"), "question": F.when(first, F.lit(q[0])).when(second, F.lit(q[1])).otherwise(F.lit(q[2])), "options": options, "context": context, "label": label, "view": _view("dialogue", F.filter(F.array(before, text), lambda x: x.isNotNull()), F.when(first | second, "choice").otherwise("noul")), "units": F.array(text), "ok": (text != "") & slots.isNotNull() & domains.isNotNull()}


@shape
def topical(spec: Spec, split: Column, row: Column) -> Out:
    """A comment on a topic (names) and a yes-no label: a share `full`, and comments of no known topic, are asked for the label, the others for the topic."""
    text, topic, y = F.col("_a"), _of(spec.names, F.col(spec.columns["topic"])), _number(spec)
    noul = topic.isNull() | (_u(spec, split, row, "form") < spec.full)
    options = F.when(~noul, ordered(spec.names, F.col("_n"), "order"))
    return {"type": F.when(noul, "noul").otherwise("choice"), "question": F.when(noul, F.lit(spec.yes_no)).otherwise(F.lit(spec.question)), "options": options, "context": text, "label": F.when(noul, F.when(y.isin(0, 1), y)).otherwise((_position(topic) - 1).cast("int")), "view": _view("comment", F.array(text), F.when(noul, "noul").otherwise("choice")), "units": F.array(text), "ok": text != ""}


@shape
def paper(spec: Spec, split: Column, row: Column) -> Out:
    """A title and an abstract: the category (names; a share `full` and all of test), the discipline (second) among 4 to 10, or whether a keyword is
    the paper's; keywords that aren't come with the row as `_negative`, from papers of its category."""
    title, text, n = F.col("_a"), F.col("_b"), F.col("_n")
    category, discipline = _of(spec.names, F.col(spec.columns["label"])), _of(spec.second, F.col(spec.columns["second"]))
    u = _u(spec, split, row, "form")
    first = (split == "test") | (u < spec.full)
    second = F.coalesce(~first & (u < spec.full + spec.subset) & discipline.isNotNull(), F.lit(False))
    yes = _u(spec, split, row, "positive") < 0.5
    asked = F.when(yes, pick(F.col(spec.columns["keywords"]), _u(spec, split, row, "keyword"))).otherwise(F.col("_negative"))
    options = F.when(first, ordered(spec.names, n, "order")).when(second, some_of(spec.second, discipline, 4, 10, n, _u(spec, split, row, "k")))
    choice = first | second
    context = F.concat(F.lit("标题：" if spec.lang == "zh" else "Title: "), title, F.lit("\n摘要：" if spec.lang == "zh" else "\nAbstract: "), text)
    label = F.when(choice, (_position(F.when(first, category).otherwise(discipline)) - 1).cast("int")).otherwise(yes.cast("int"))
    return {"type": F.when(choice, "choice").otherwise("noul"), "question": F.when(choice, F.lit(spec.question)).otherwise(_asked(spec.yes_no, asked)), "options": options, "context": context, "label": label, "view": _view("abstract", F.array(title, text), F.when(choice, "choice").otherwise("noul"), F.when(~choice, asked)), "units": F.array(title, text), "ok": (text != "") & (title != "") & F.when(choice, F.when(first, category).otherwise(discipline)).otherwise(asked).isNotNull()}


@shape
def passage(spec: Spec, split: Column, row: Column) -> Out:
    """A question about a passage and whether the answer is yes."""
    text, q = F.col("_a"), F.col("_b")
    y = F.col(spec.columns["label"]).cast("boolean").cast("int")
    return {"type": F.lit("noul"), "question": X.question_form(q), "options": _none("array<string>"), "context": text, "label": y, "view": _view("passage", F.array(text, q), "noul"), "units": F.array(text, q), "ok": (text != "") & (q != "")}


@shape
def nli(spec: Spec, split: Column, row: Column) -> Out:
    """Premise, hypothesis and one of three relations, 0 following from it and 2 against it: choose one, say whether it follows, or (a share `subset`
    before `full` ends, not in test) how likely it is, on three levels."""
    p, h, y = F.col("_a"), F.col("_b"), _number(spec)
    u = _u(spec, split, row, "form")
    score = (split != "test") & (u >= spec.full - spec.subset) & (u < spec.full)
    full = ~score & ((split == "test") | (u < spec.full))
    q = F.when(full, F.concat(F.lit("Hypothesis: "), h, F.lit(" How does it relate to the text?"))).when(score, F.concat(F.lit("How likely is this, given the text: "), h)).otherwise(F.concat(F.lit("If the text is true, does this follow: "), h))
    levels = spec.second or ("unlikely", "open", "likely")
    return {"type": F.when(full, "choice").when(score, "score").otherwise("noul"), "question": q, "options": F.when(full, _strings(spec.names)).when(score, _strings(levels)), "context": p, "label": F.when(y.isin(0, 1, 2), F.when(full, y).when(score, 2 - y).otherwise((y == 0).cast("int"))), "view": _view("pair", F.array(p, h), F.when(full, "choice").when(score, "score").otherwise("noul")), "units": F.array(p, h), "ok": (p != "") & (h != "")}


@shape
def multiple_choice(spec: Spec, split: Column, row: Column) -> Out:
    """A question with its own options, the answer by text, key, letter, or number from `base` on; with a passage or without."""
    o = F.array(*map(F.col, spec.choices)) if spec.choices else F.col(spec.columns["options"])
    raw = F.col(spec.columns["label"]).cast("string")
    by_key = F.nullif(F.array_position(F.col(spec.columns["keys"]), raw), F.lit(0)) - 1 if "keys" in spec.columns else _none("long")
    by_letter = F.when(F.length(raw) == 1, F.nullif(F.instr(F.lit("ABCDEFGH"), F.upper(raw)), F.lit(0)) - 1)
    at = F.coalesce(by_key, by_letter, raw.try_cast("int") - spec.base, F.nullif(F.array_position(o, raw), F.lit(0)) - 1)
    ctx = F.nullif(F.col("_b"), F.lit("")) if "passage" in spec.columns else _none("string")
    return {"type": F.lit("choice"), "question": F.col("_a"), "options": o, "context": ctx, "label": F.when((at >= 0) & (at < F.size(o)), at.cast("int")), "view": _none("struct<kind: string, text: array<string>, task: string, arg: string>"), "units": F.filter(F.array(F.col("_a"), ctx), lambda x: x.isNotNull()), "ok": (F.col("_a") != "") & A.unique(o) & ~F.exists(o, lambda x: x.isNull())}


@shape
def binned(spec: Spec, split: Column, row: Column) -> Out:
    """A text and a number: which of the ordered bins, open to the right, or whether it reaches the middle one."""
    text, x = F.col("_a"), F.col(spec.columns["number"]).cast("double")
    full = (split == "test") | (_u(spec, split, row, "form") < spec.full)
    mid = spec.edges[len(spec.edges) // 2]
    fits = F.length(text).between(*spec.cuts) if spec.cuts[0] < spec.cuts[1] else text != ""
    return {"type": F.when(full, "score").otherwise("noul"), "question": F.when(full, F.lit(spec.question)).otherwise(F.lit(spec.yes_no)), "options": F.when(full, _strings(spec.names)), "context": text, "label": F.when(x.isNotNull(), F.when(full, F.col("_bin")).otherwise((x >= mid).cast("int"))).cast("int"), "view": _view("comment", F.array(text), "score"), "units": F.array(text), "ok": fits}


@shape
def rated(spec: Spec, split: Column, row: Column) -> Out:
    """Prompt, reply, and a mean rating with its number for one attribute, `_attribute`: one of the ordered levels."""
    p, r = X.truncate(F.col("_a"), spec.cuts[0]), X.truncate(F.col("_b"), spec.cuts[1])
    ctx = F.concat(F.lit("用户："), p, F.lit("\n\n助手："), r) if spec.lang == "zh" else X.turns(p, r)
    y = A.level((F.col("_value") - spec.scale[0]) / (spec.scale[1] - spec.scale[0]), F.when(F.col("_count") >= spec.ratings, 2), len(spec.names))
    return {"type": F.lit("score"), "question": _asked(spec.question, F.col("_attribute")), "options": _strings(spec.names), "context": ctx, "label": y, "view": _view("dialogue", F.array(p, r), "score", F.col("_attribute")), "units": F.array(r), "ok": (p != "") & (r != "")}


@shape
def emotions(spec: Spec, split: Column, row: Column) -> Out:
    """A text and an array of classes, by name or number: where there is one, the class (a share `full` and all of test); else yes or no about one."""
    text, n = F.col("_a"), F.col("_n")
    golds = F.filter(F.transform(F.col(spec.columns["labels"]), lambda x: _of(spec.names, x)), lambda x: x.isNotNull())
    full = (F.size(golds) == 1) & ((split == "test") | (_u(spec, split, row, "form") < spec.full))
    yes = _u(spec, split, row, "positive") < 0.5
    other = first_but(spec.names, n, lambda x: ~F.array_contains(golds, x))
    asked = F.when(yes, pick(golds, _u(spec, split, row, "which"))).otherwise(other)
    options = F.when(full, ordered(spec.names, n, "order"))
    return {"type": F.when(full, "choice").otherwise("noul"), "question": F.when(full, F.lit(spec.question)).otherwise(_asked(spec.yes_no, asked)), "options": options, "context": text, "label": F.when(full, (_position(F.get(golds, F.lit(0))) - 1).cast("int")).otherwise(yes.cast("int")), "view": _view("comment", F.array(text), F.when(full, "choice").otherwise("noul"), F.when(~full, asked)), "units": F.array(text), "ok": (text != "") & (F.size(golds) > 0) & asked.isNotNull()}


@shape
def valence(spec: Spec, split: Column, row: Column) -> Out:
    """A text and an array of classes; those of names are on the bad side, those of second on the good one, all others on neither. Texts on both
    sides are left out. Half are asked as a choice and half on a scale of three levels, `questions`."""
    text = F.col("_a")
    sides = F.transform(F.col(spec.columns["labels"]).cast("array<string>"), lambda x: F.when(x.isin(*spec.names), -1).when(x.isin(*spec.second), 1).otherwise(0))
    at = (F.array_max(sides) + F.array_min(sides)).cast("int")
    both = F.array_contains(sides, F.lit(1)) & F.array_contains(sides, F.lit(-1))
    choice = _u(spec, split, row, "form") < 0.5
    levels = _strings(spec.questions)
    label = F.greatest(F.lit(-1), F.least(F.lit(1), at)) + 1
    options = F.when(choice, ordered(spec.questions, F.col("_n"), "order")).otherwise(levels)
    return {"type": F.when(choice, "choice").otherwise("score"), "question": F.lit(spec.question), "options": options, "context": text, "label": F.when(~both, F.when(choice, _position(F.get(levels, label)) - 1).otherwise(label)).cast("int"), "view": _view("comment", F.array(text), F.when(choice, "choice").otherwise("score")), "units": F.array(text), "ok": (text != "") & (F.size(sides) > 0)}


_TEXTS = {"pair": ("a", "b"), "labelled": ("text",), "intents": ("text",), "dialogue": ("text", "before"), "topical": ("text",), "paper": ("title", "text"), "passage": ("text", "question"), "nli": ("a", "b"), "multiple_choice": ("question", "passage"), "binned": ("text",), "rated": ("prompt", "reply"), "emotions": ("text",), "valence": ("text",)}
# Shapes that mean nothing without the names of their classes.
_NAMED = {"labelled": ("names",), "intents": ("names", "second"), "dialogue": ("names", "second"), "topical": ("names",), "paper": ("names", "second"), "nli": ("names",), "binned": ("names", "edges"), "rated": ("names",), "emotions": ("names",), "valence": ("names", "second", "questions")}


def named(spec: Spec, names: tuple[str, ...], second: tuple[str, ...] = ()) -> Spec:
    """The declaration with the class names of a release."""
    return replace(spec, names=tuple(names), second=tuple(second) or spec.second)


def _attributes(spec: Spec, r: DataFrame) -> DataFrame:
    """A row per reply and attribute: ratings is an array of structs (name, value, count) or comes from columns of the attributes' names. One attribute per
    reply makes the record: the first of spec.second, where it is rated and with a share `first`, else one of the others. With extras the others follow
    in training, unless more than six in ten of an attribute's replies are of its top level."""
    if "ratings" in spec.columns:
        each = F.filter(F.col(spec.columns["ratings"]), lambda x: x["name"].isin(*spec.second) & x["value"].isNotNull() & (F.coalesce(x["count"], F.lit(0)) >= spec.ratings))
    else:
        made = F.array(*(F.struct(F.lit(a).alias("name"), F.col(a).cast("double").alias("value"), F.lit(spec.ratings).alias("count")) for a in spec.second))
        each = F.filter(made, lambda x: x["value"].isNotNull())
    r = r.withColumn("_each", F.array_sort(each, lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)))
    split, row = F.col("split"), F.col("row").cast("string")
    lead = F.exists("_each", lambda x: x["name"] == spec.second[0]) & (_u(spec, split, row, "attribute") < spec.first)
    rest = F.transform(F.filter("_each", lambda x: x["name"] != spec.second[0]), lambda x: x["name"])
    other = F.when(F.size(rest) > 0, pick(rest, _u(spec, split, row, "which"))).otherwise(F.lit(spec.second[0]))
    r = r.where(F.size("_each") > 0).withColumn("_lead", F.when(lead, F.lit(spec.second[0])).otherwise(other))
    rows = r.withColumn("_x", F.explode("_each")).withColumn("_attribute", F.col("_x.name")).withColumn("_value", F.col("_x.value")).withColumn("_count", F.col("_x.count"))
    main = rows.where("_attribute = _lead").withColumn("_tail", _none("string"))
    if not spec.extras:
        return main
    more = rows.where("_attribute <> _lead AND split = 'train'").withColumn("_tail", F.col("_attribute"))
    span = spec.scale[1] - spec.scale[0]
    top = F.floor((F.col("_value") - spec.scale[0]) / span * len(spec.names)) >= len(spec.names) - 1
    skewed = more.groupBy("_attribute").agg(F.avg(top.cast("int")).alias("_top")).where("_top > 0.6")  # a row per attribute
    return main.unionByName(more.join(F.broadcast(skewed.select("_attribute")), "_attribute", "left_anti").select(*main.columns))


def convert(spec: Spec, rows: DataFrame) -> DataFrame:
    """Unified records with their units and grp from rows that have the columns of the declaration, split and row; grp is the column of that role, in training only."""
    missing = [f for f in _NAMED.get(spec.shape, ()) if not getattr(spec, f)]
    if missing:
        raise ValueError(f"{spec.source}: {', '.join(missing)} must be given")
    r = spread(rows)
    for name, role in zip(("_a", "_b"), _TEXTS[spec.shape]):
        text = F.col(spec.columns[role]) if role in spec.columns else _none("string")
        r = r.withColumn(name, (X.clean_keep_lines if spec.shape == "rated" else X.clean)(text, once=True))
    split, row = F.col("split"), F.col("row").cast("string")
    r = r.where(split.isin("train", "dev", "test")).withColumn("_n", number(SEED, spec.source, split, row))
    if spec.shape == "rated":
        r = _attributes(spec, r) if spec.second else r.select("*", F.lit("").alias("_attribute"), F.col(spec.columns["value"]).cast("double").alias("_value"), (F.col(spec.columns["count"]) if "count" in spec.columns else F.lit(spec.ratings)).alias("_count"), _none("string").alias("_tail"))
    if spec.shape == "binned":
        x = F.col(spec.columns["number"]).cast("double")
        r = r.withColumn("_bin", F.aggregate(F.array(*map(F.lit, spec.edges)), F.lit(0), lambda s, e: s + (x >= e).cast("int")))
        if spec.per_bin:
            r = r.where(x.isNotNull())
            parts = [sample_per(r.where(split == s), k, ["_bin"], row, SEED, spec.source, "bin") for s, k in spec.per_bin.items()]
            r = _union([r.where(~split.isin(*spec.per_bin)), *parts])
    if spec.shape == "paper":
        keyed = r.withColumn("id", F.concat_ws("/", split, row))
        pool = keyed.select(F.col(spec.columns["label"]).alias("_group"), F.explode(spec.columns["keywords"]).alias("entry")).distinct()
        found = negatives(keyed.select("id", F.col(spec.columns["label"]).alias("_group"), F.col(spec.columns["keywords"]).alias("_own"), F.concat("_a", F.lit("\n"), "_b").alias("_text")), pool, "_group", "_own", "_text", SEED, spec.source)
        r = keyed.join(found.withColumnRenamed("negative", "_negative"), "id", "left").drop("id")
    out = SHAPES[spec.shape](spec, split, row)
    ok = F.coalesce(out.pop("ok"), F.lit(False))
    r, out["options"] = r.withColumn("_o", out["options"]), F.col("_o")
    tail = F.col("_tail") if spec.shape == "rated" else _none("string")
    group = F.when(split == "train", F.col(spec.columns["group"]).cast("string")) if "group" in spec.columns else _none("string")
    made = r.where(ok).select(F.concat_ws("/", F.lit(spec.source), split, row, tail).alias("id"), F.lit(spec.lang).alias("lang"), *(c.alias(k) for k, c in out.items()), F.lit(spec.source).alias("source"), split.alias("split"), group.alias("grp"))
    made = made.where("label IS NOT NULL")
    if not spec.sample:
        return made
    return _union([made.where(~F.col("split").isin(*spec.sample)), *(sample(made.where(F.col("split") == s), k, F.col("id"), SEED, spec.source) for s, k in spec.sample.items())])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def convert_all(specs: list[Spec], tables: dict[str, DataFrame]) -> DataFrame:
    """The records of every declared source whose table is given; a source of several tables has them as one union."""
    return _union([convert(s, tables[s.source]) for s in specs if s.source in tables])


def declared(source: str, lang: str, shape: str, columns: dict[str, str], names: tuple[str, ...] = (), **more) -> Spec:
    return Spec(source, lang, shape, columns, names, **more)


_PAIR = {"a": "sentence1", "b": "sentence2", "label": "label"}
_NLI = {"a": "premise", "b": "hypothesis", "label": "label"}
_TEXT = {"text": "text", "label": "label"}
_RELATIONS = ("entailment", "neutral", "contradiction")
_LEVELS = {"zh": ("很差", "较差", "一般", "较好", "很好"), "en": ("very poor", "poor", "average", "good", "excellent")}
_TREE = {"prompt": "prompt", "reply": "reply", "ratings": "ratings", "group": "root"}
# The public data sets with the columns they come with, and the shares and sizes their records are drawn in. Class names that vary
# by release are left to `named`.
SOURCES: list[Spec] = [
    declared("pawsx_zh", "zh", "pair", _PAIR),
    declared("paws_en", "en", "pair", _PAIR, sample={"train": 10_000, "dev": 1_000, "test": 2_000}),
    declared("massive_zh", "zh", "intents", {"text": "text", "label": "intent", "second": "scenario"}, full=0.6, subset=0.2),
    declared("massive_en", "en", "intents", {"text": "text", "label": "intent", "second": "scenario"}, full=0.6, subset=0.2),
    declared("crosswoz_zh", "zh", "dialogue", {"text": "utterance", "before": "previous", "domains": "domains", "slots": "requests"}, full=0.5, subset=0.25),
    declared("cold_zh", "zh", "topical", {"text": "TEXT", "topic": "topic", "label": "label"}, full=0.8),
    declared("csl_zh", "zh", "paper", {"title": "title", "text": "abstract", "label": "category", "second": "discipline", "keywords": "keywords"}, full=0.5, subset=0.25),
    declared("sib200_zh", "zh", "labelled", {"text": "text", "label": "category"}),
    *(declared(f"nli26_zh_{k}", "zh", "nli", _NLI, _RELATIONS, full=0.7, subset=0.15) for k in ("mnli", "wanli", "fever")),
    *(declared(f"oasst2_{lg}", lg, "rated", _TREE, _LEVELS[lg], second=("quality", "helpfulness", "creativity", "humor"), cuts=(1200, 2400), first=0.7, extras=True, question="{}", sample=s) for lg, s in (("zh", {}), ("en", {"train": 6_000, "dev": 1_000}))),
    declared("belebele_zh", "zh", "multiple_choice", {"question": "question", "passage": "flores_passage", "label": "correct_answer_num"}, choices=("mc_answer1", "mc_answer2", "mc_answer3", "mc_answer4")),
    declared("xcopa_zh", "zh", "multiple_choice", {"question": "question", "passage": "premise", "label": "label"}, choices=("choice1", "choice2"), base=0),
    declared("xwinograd_zh", "zh", "multiple_choice", {"question": "sentence", "label": "answer"}, choices=("option1", "option2")),
    declared("globalmmlu_zh", "zh", "multiple_choice", {"question": "question", "label": "answer"}, choices=("option_a", "option_b", "option_c", "option_d"), sample={"test": 1_000}),
    declared("minds14_zh", "zh", "labelled", {"text": "transcription", "label": "intent_class"}),
    declared("banking77_en", "en", "labelled", _TEXT, full=0.5, subset=0.5),
    declared("boolq_en", "en", "passage", {"text": "passage", "question": "question", "label": "answer"}),
    declared("dbpedia14_en", "en", "labelled", {"text": "content", "label": "label"}, sample={"train": 10_000, "test": 2_000}),
    declared("mnli_en", "en", "nli", _NLI, _RELATIONS, full=0.7, sample={"train": 12_000, "test": 2_000}),
    declared("csqa_en", "en", "multiple_choice", {"question": "question", "options": "choices.text", "keys": "choices.label", "label": "answerKey"}),
    declared("arc_en", "en", "multiple_choice", {"question": "question", "options": "choices.text", "keys": "choices.label", "label": "answerKey"}),
    declared("goemotions_en", "en", "emotions", {"text": "text", "labels": "labels"}, full=0.6, sample={"train": 10_000, "dev": 1_000, "test": 2_000}),
    declared("civil_en", "en", "binned", {"text": "text", "number": "toxicity"}, ("under 10%", "10-30%", "30-50%", "50-80%", "80% and more"), edges=(0.1, 0.3, 0.5, 0.8), full=0.7, cuts=(20, 1500), per_bin={"train": 1_600, "test": 400}),
    declared("helpsteer2_en", "en", "rated", {"prompt": "prompt", "reply": "response"}, ("0", "1", "2", "3", "4"), second=("helpfulness", "correctness", "coherence", "complexity", "verbosity"), scale=(0.0, 4.0), cuts=(1500, 2500), first=0.5, question="{}", sample={"train": 10_000}),
]
