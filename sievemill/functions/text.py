"""Text functions: cleaning, comparison keys, truncation, units."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space, as a regex class body that Java and RE2 read alike.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_BUT_LINES = r"\x{9}\x{b}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Prefixes of the parts of a composed context.
ROLES = "句子[AB]|前提|假设|用户|系统|助手|标题|摘要|Sentence [AB]|User|Assistant"
MIN_UNIT = 8
MIN_CONTAINED = 12


def _plain() -> tuple[str, str]:
    """Code points with a one-character compatibility form, and these: full-width ASCII, super- and subscript or circled digits, radicals."""
    blocks = [range(0xFF01, 0xFF5F), (0xB2, 0xB3, 0xB9), range(0x2070, 0x208A), range(0x2460, 0x2469), range(0x2F00, 0x2FD6)]
    pairs = [(chr(c), k) for b in blocks for c in b if len(k := unicodedata.normalize("NFKC", chr(c)).casefold()) == 1 and k != chr(c) and k.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


WIDE, NARROW = _plain()
# Letters whose folded form is several characters.
LIGATURES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column, once: bool = False) -> Column:
    """Canonical composition; the JVM functions have none. Null stays null. once=True keeps the optimiser from computing what is made of it a
    second time in a filter that it moves down; such a column may stand in a projection only."""
    f = F.pandas_udf(_composed, StringType())
    return (f.asNondeterministic() if once else f)(text)


def clean(text: Column, once: bool = False) -> Column:
    """Composed, without carriage returns, white space collapsed to one space and trimmed; null gives the empty text."""
    t = F.regexp_replace(nfc(F.coalesce(text, F.lit("")), once), "\r", "")
    return F.trim(F.regexp_replace(t, f"[{SPACE}]+", " "))


def clean_keep_lines(text: Column, once: bool = False) -> Column:
    """The same line by line; of three or more line feeds in a row two stay."""
    t = F.regexp_replace(nfc(F.coalesce(text, F.lit("")), once), "\r", "")
    t = F.regexp_replace(F.regexp_replace(t, f"[{SPACE_BUT_LINES}]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def norm_key(text: Column, composed: bool = False, once: bool = False) -> Column:
    """The key under which texts count as the same: composed, plain forms of wide and raised characters, case folded, and
    only letters and digits left. composed=True says that the text is composed already. Null gives the empty key."""
    low = F.lower(F.coalesce(text, F.lit("")) if composed else nfc(F.coalesce(text, F.lit("")), once))
    t = low
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    # Few texts hold any of these, and finding that out costs far less than rewriting all of them.
    rare = low.rlike("[²³¹ß⁰-₉①-⑨⼀-⿕ﬀ-ﬄ０-９Ａ-Ｚａ-ｚ]")
    return F.regexp_replace(F.when(rare, F.translate(t, WIDE, NARROW)).otherwise(low), r"[^\p{L}\p{N}]+", "")


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def question_form(text: Column) -> Column:
    """A question with a capital first letter and one question mark at its end."""
    t = F.regexp_replace(F.trim(text), "[? ]+$", "")
    return F.when(t == "", t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30), F.lit("?")))


def turns(user: Column, reply: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.lit("\n\nAssistant: "), reply)


def prettify(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def record_parts(context: Column, kind: Column, question: Column, view_text: Column) -> Column:
    """The texts in a record: the context, its role-prefixed parts, the texts of the view, and the question where a multiple
    choice has no context."""
    ctx = F.coalesce(context, F.lit(""))
    parts = F.concat(F.array(ctx), F.split(ctx, rf"(?:^|\n)[{SPACE}]*(?:{ROLES})[{SPACE}]*[:：][{SPACE}]*"), F.coalesce(view_text, F.array().cast("array<string>")))
    parts = F.when((kind == "choice") & (ctx == ""), F.concat(parts, F.array(question))).otherwise(parts)
    return F.array_distinct(parts)


# The same in DuckDB's SQL, for the queries' checks.


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(replace(nfc_normalize(coalesce({x}, '')), chr(13), ''), '[{SPACE}]+', ' ', 'g'))"


def sql_clean_keep_lines(x: str) -> str:
    t = f"regexp_replace(replace(nfc_normalize(coalesce({x}, '')), chr(13), ''), '[{SPACE_BUT_LINES}]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def sql_norm_key(x: str, composed: bool = False) -> str:
    t = f"lower(coalesce({x}, ''))" if composed else f"lower(nfc_normalize(coalesce({x}, '')))"
    for a, b in LIGATURES.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_replace(translate({t}, '{WIDE}', '{NARROW}'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def sql_units(context: str, kind: str, question: str, view_text: str) -> str:
    ctx = f"coalesce({context}, '')"
    split = f"regexp_split_to_array({ctx}, '(?:^|\\n)[{SPACE}]*(?:{ROLES})[{SPACE}]*[:：][{SPACE}]*')"
    parts = f"list_concat([{ctx}], {split}, coalesce({view_text}, []), case when {kind} = 'choice' and {ctx} = '' then [{question}] else [] end)"
    return f"list_distinct(list_filter(list_transform({parts}, lambda p: {sql_norm_key('p', True)}), lambda k: length(k) >= {MIN_UNIT}))"
