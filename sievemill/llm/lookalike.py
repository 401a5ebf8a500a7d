"""One consistent form of texts that look alike on the page but differ in their characters.

Two forms:

* The consistent form (`visible=False`): compatibility normalisation (NFKC), full case folding, mapped white space and no
  default-ignorable characters, composed. Records are joined by it.
* The visible form (`visible=True`), which keeps apart what a reader can tell apart: canonical decomposition; wide, narrow, no-break
  and ligature or radical forms give way to their plain characters; look-alike letters of other scripts to Latin
  ones; every kind of space to one space; default-ignorable characters go; then composition. Letter case, accents, raised and
  circled digits and the number of spaces stay. Of records with one consistent form those of one visible form are alike. Texts of one
  visible form have one consistent form, as the latter is computed from the former.

Contexts are rewritten once per distinct value of an Arrow batch, options once per distinct value of a task (the last KNOWN ones are kept).

Nulls stay null and equal null only, in a list too; the empty text stays empty. Repeated ids count once.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.session import stored

# The code points with the property Default_Ignorable_Code_Point, as first-last.
IGNORABLE = "AD-AD 34F-34F 61C-61C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164-3164 FE00-FE0F FEFF-FEFF FFA0-FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
# Decomposition tags whose forms look like the plain characters.
ALIKE_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}
# Letters of other scripts with the glyph of a Latin one, and that letter; the hyphens and the minus.
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "\u2010": "-", "\u2011": "-", "\u2212": "-",
}
# Radicals without a compatibility mapping, and the ideograph of the same shape.
RADICALS = {
    "⺁": "厂", "⺈": "刀", "⺌": "小", "⺍": "小", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺝": "月", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺶": "羊", "⺹": "耂", "⺼": "肉", "⺾": "艹", "⺿": "艹", "⻀": "艹",
    "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻐": "钅", "⻑": "長", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
_GONE = [(int(a, 16), int(b, 16)) for a, b in (r.split("-") for r in IGNORABLE.split())]


class _Visible(dict):
    """Code point to what shows of it, filled on demand."""

    def __missing__(self, c: int):
        ch = chr(c)
        tag, _, plain = unicodedata.decomposition(ch).partition(" ")
        if any(a <= c <= b for a, b in _GONE):
            v = None
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            v = " "
        elif ch in "\x85\u2028\u2029":
            v = "\n"
        elif ch in LETTERS:
            v = LETTERS[ch]
        elif tag in ALIKE_TAGS:
            v = "".join(chr(int(x, 16)) for x in plain.split()).translate(self)
        else:
            v = RADICALS.get(ch) or c
        self[c] = v
        return v


_TABLE = _Visible()


def form(text: str | None, visible: bool = True) -> str | None:
    if text is None:
        return None
    out = text.replace("\r\n", "\n") if "\r" in text else text
    if not out.isascii() or "\t" in out:
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", out).translate(_TABLE))
    return out if visible else _consistent(out)


def _consistent(visible: str) -> str:
    if visible.isascii():
        return visible.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", visible).casefold())


KNOWN = 1 << 16


class _Forms(dict):
    """Text to its two forms, (visible, consistent), each computed once; starts anew when it is full."""

    def __missing__(self, t: str) -> tuple[str, str]:
        if len(self) >= KNOWN:
            self.clear()
        v = form(t)
        self[t] = both = (v, _consistent(v))
        return both


def _rewritten(column: pa.Array, kind: int, known: _Forms) -> list:
    """The form of each text of a column or, where these are lists, of each text in them."""
    if pa.types.is_list(column.type):
        return [v if v is None else [x if x is None else known[x][kind] for x in v] for v in column.to_pylist()]
    d = column.dictionary_encode()
    texts = _Forms()
    words = [t if t is None else texts[t][kind] for t in d.dictionary.to_pylist()]
    return [None if i is None else words[i] for i in d.indices.to_pylist()]


def consistent(records: DataFrame, visible: bool = False) -> DataFrame:
    """id, context and options of each record, once per id, in the consistent form; each record without an id stays."""

    def run(batches):
        known, kind = _Forms(), 0 if visible else 1
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(_rewritten(b["context"], kind, known), pa.string()), pa.array(_rewritten(b["options"], kind, known), pa.list_(pa.string()))], names=["id", "context_form", "options_form"])

    rows = records.select("id", "context", "options")
    once = rows.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(rows.where("id IS NULL"))
    return once.mapInArrow(run, "id string, context_form string, options_form array<string>")


def _digest(context: str | None, options: list | None) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for x in (context, *(options if options is not None else ())):
        h.update(b"-" if x is None else b"%d:" % len(x) + x.encode("utf-8", "surrogatepass"))
    h.update(b"none" if options is None else b"%d" % len(options))
    return h.digest()


def _keys(batches):
    known = _Forms()
    for b in batches:
        contexts = b["context"].dictionary_encode()
        texts = [_FORMLESS if t is None else (t, *_Forms()[t]) for t in contexts.dictionary.to_pylist()]
        rows = [_FORMLESS if i is None else texts[i] for i in contexts.indices.to_pylist()]
        keys: list[list[bytes]] = [[], [], []]
        for own, options in zip(rows, b["options"].to_pylist()):
            each = options if options is None else [_FORMLESS if o is None else (o, *known[o]) for o in options]
            for kind, out in enumerate(keys):
                out.append(_digest(own[kind], each if each is None else [o[kind] for o in each]))
        yield pa.RecordBatch.from_arrays([b["id"], b["split"], b["source"], *(pa.array(k, pa.binary()) for k in keys)], names=["id", "split", "source", "raw", "look", "form"])


_FORMLESS = (None, None, None)


def alike_pairs(records: DataFrame) -> DataFrame:
    """id_a < id_b: records of one split and of different sources that have one consistent form and look the same in context and options, while one
    of these differs in its characters. Records with neither field are out, as are those without id, split or source."""
    rows = records.select("id", "split", "source", "context", "options").where("id IS NOT NULL AND split IS NOT NULL AND source IS NOT NULL AND (context IS NOT NULL OR options IS NOT NULL)")
    keyed = stored(rows.mapInArrow(_keys, "id string, split string, source string, raw binary, look binary, form binary"), "p2-keys")
    # By the consistent form first: of each, the spellings; more than one of them must be there.
    spellings = keyed.groupBy("split", "form", "look", "raw").agg(F.count("*").alias("n"))
    several = spellings.groupBy("split", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a < b").select("split", "form")
    mixed = stored(spellings.join(several, ["split", "form"], "left_semi").select("split", "form", "look", "raw"), "p2-mixed")
    # Pairs of different spellings that look alike: a hot spelling then meets only the members of the others.
    pairs = mixed.withColumnRenamed("raw", "raw_a").join(mixed.withColumnRenamed("raw", "raw_b"), ["split", "form", "look"]).where("raw_a < raw_b").select("split", "raw_a", "raw_b")
    members = [keyed.select("split", *(F.col(c).alias(f"{c}_{k}") for c in ("raw", "id", "source"))).distinct() for k in "ab"]
    return (
        pairs.join(members[0], ["split", "raw_a"])
        .join(members[1], ["split", "raw_b"])
        .where("source_a <> source_b AND id_a <> id_b")
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .distinct()
    )
