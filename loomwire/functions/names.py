"""Names of people, places and bodies as column expressions: honorifics, brackets, roles, display names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Honorifics and ranks.
PREFIXES = [
    "พล.ต.อ.", "พล.ต.ท.", "พล.ต.ต.", "พล.ร.อ.", "พล.อ.ท.", "พล.อ.", "พล.ท.", "ร.ต.อ.", "ร.ต.ท.", "ร.ต.ต.", "พ.ต.อ.", "พ.ต.ท.", "ศ.ดร.", "รศ.ดร.", "ผศ.ดร.", "ว่าที่ร้อยตรี",
    "นางสาว", "น.ส.", "ดร.", "ศ.", "รศ.", "ผศ.", "นาย", "นาง", "Lt. Gen.", "Maj. Gen.", "Pol. Gen.", "Gen.", "Mr.", "Mrs.", "Ms.", "Dr.",
]
#: What a role starts with.
ROLES = [
    "รมว", "รมช", "รมต", "รอง", "ผู้", "ผอ", "ผบ", "ผกก", "ผวจ", "อธิบดี", "ปลัด", "เลขาธิการ", "แม่ทัพ", "เสธ", "สส.", "ส.ส.", "สว.", "ส.ว.", "นายก", "นายอำเภอ", "ประธาน", "หัวหน้า", "โฆษก", "กรรมการ",
    "เจ้าของ", "เจ้าพนักงาน", "เจ้าอาวาส", "ทนาย", "แพทย์", "นักวิชาการ", "อดีต", "ว่าที่", "รักษาการ", "ที่ปรึกษา", "รัฐมนตรี", "เอกอัครราชทูต", "กำนัน", "อาจารย์", "ภรรยา", "สามี", "บิดา", "มารดา",
]
#: English titles, measures, and words that are no names.
ENGLISH_ROLES = ["minister", "secretary", "director", "governor", "president", "chief", "commander", "deputy", "spokesman", "spokesperson", "chairman", "head of", "adviser", "advisor", "former"]
MEASURE = r"(?U)^(?:[\d,\s]+(?:คน|ราย|ปี)|อายุ\s*[\d,]+|ไม่(?:ต่ำ|เกิน)กว่า)"
NO_NAMES = ["มหาชน", "องค์การมหาชน", "นามสมมติ", "นามสมมุติ", "นามแฝง", "สงวนชื่อ", "ผู้เสียชีวิต", "ผู้ก่อเหตุ", "ผู้ต้องหา", "ผู้บาดเจ็บ", "เหยื่อ", "ผู้รอดชีวิต", "มือปืน"]
#: Forms of one place, the first names it.
PLACES = [
    ("ไทย", "ประเทศไทย", "thailand"), ("สิงคโปร์", "singapore"), ("ญี่ปุ่น", "japan"), ("เกาหลีใต้", "southkorea", "korea"), ("เกาหลีเหนือ", "northkorea"), ("จีน", "china"),
    ("สหรัฐ", "สหรัฐฯ", "สหรัฐอเมริกา", "unitedstates", "usa", "us", "america"), ("อังกฤษ", "สหราชอาณาจักร", "unitedkingdom", "uk", "britain", "england"), ("ฝรั่งเศส", "france"), ("เยอรมนี", "germany"),
    ("รัสเซีย", "russia"), ("อินเดีย", "india"), ("เวียดนาม", "vietnam"), ("กัมพูชา", "cambodia"), ("ลาว", "laos"), ("เมียนมา", "พม่า", "myanmar", "burma"), ("มาเลเซีย", "malaysia"),
    ("อินโดนีเซีย", "indonesia"), ("ฟิลิปปินส์", "philippines"), ("แคนาดา", "canada"), ("ยูเครน", "ukraine"), ("อิสราเอล", "israel"),
]
#: A bracket and its text, the two scripts, and the punctuation that doesn't count.
_BRACKET = r"[(（]([^)）]*)[)）]"
_THAI, _LATIN = r"[฀-๿]", "[A-Za-z]"
_PUNCTUATION = "[\"'`·,;:]"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


_ENGLISH = rf"(?iU)\b(?:{'|'.join(ENGLISH_ROLES)})\b"


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Composed Unicode (NFC), which Spark has no function for; ASCII is left as it is."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def strip_prefix(name: Column) -> Column:
    """Without leading honorifics, as long as more than one character is left."""
    return F.trim(F.regexp_replace(F.trim(name), rf"^(?:(?:{_any(PREFIXES)})(?=(?s:..))\s*)+", ""))


def norm(name: Column) -> Column:
    """What names are compared by: lower-case letters and digits run together. Expects composed text, as of `composed`."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip_prefix(name), r"(?U)[\s​]+", ""), _PUNCTUATION, ""))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s.]+|[\s.]+$", "")


def is_role(text: Column) -> Column:
    bare = _bare(text)
    return (F.char_length(bare) >= 2) & (bare.rlike(rf"^(?:{_any(ROLES)})") | bare.rlike(_ENGLISH))


def is_abbreviation(short: Column, full: Column) -> Column:
    """Capitals of at most 8 characters with a Latin one among them, or a short subsequence of the full form."""
    core = F.regexp_replace(short, r"[.\s]", "")
    latin = core.rlike(_LATIN) & (F.upper(core) == core) & (F.char_length(core) <= 8)
    place = F.aggregate(F.filter(F.split(core, ""), lambda c: c != ""), F.lit(0), lambda p, c: F.when(p < 0, p).otherwise(_after(c, full, p)))
    inside = (place > 0) & (F.char_length(core) <= F.greatest(F.lit(6), F.floor(F.char_length(full) / 3)))
    return (F.char_length(core) > 0) & (F.char_length(core) <= F.char_length(full)) & (latin | inside)


def _after(c: Column, full: Column, p: Column) -> Column:
    """The position of c in full behind p, or -1."""
    at = F.instr(F.substring(full, p + 1, F.char_length(full)), c)
    return F.when(at > 0, p + at).otherwise(-1)


def clauses(raw: Column) -> Column:
    """The parts between commas, but for commas inside brackets; a bracket that never closes holds the rest."""
    def step(s: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "（"), s["depth"] + 1).when(c.isin(")", "）"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.when((c == ",") & (s["depth"] == 0), F.lit("\u0001")).otherwise(c)).alias("out"))

    marked = F.aggregate(F.split(raw, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda s: s["out"])
    # most names have no comma at all
    return F.when(F.contains(raw, F.lit(",")), F.split(marked, "\u0001")).otherwise(F.array(raw))


def strip_role_clause(raw: Column) -> Column:
    """Without the roles that follow a name, however many; the first clause always stays, and one that is no role keeps those before it."""
    parts = clauses(raw)
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(is_role(x), F.lit(0)).otherwise(i)), F.lit(0), lambda a, i: F.greatest(a, i))
    return F.trim(F.array_join(F.slice(parts, F.lit(1), last + 1), ","))


def classify(inner: Column, head: Column) -> Column:
    """What a bracket after `head` is: another form of it (STRONG), a name that others may share (WEAK), or a description (DROP)."""
    bare = _bare(inner)
    places = F.create_map(*[F.lit(x) for group in PLACES for form in group for x in (form, group[0])])
    place, own = F.try_element_at(places, norm(bare)), F.try_element_at(places, norm(head))
    crossing = (head.rlike(_THAI) & bare.rlike(_LATIN) & ~bare.rlike(_THAI)) | (head.rlike(_LATIN) & bare.rlike(_THAI) & ~bare.rlike(_LATIN))
    return (
        F.when(F.char_length(bare) < 2, "DROP").when(bare.isin(NO_NAMES) | is_role(bare) | bare.rlike(MEASURE), "DROP")
        .when(place.isNotNull(), F.when(place == own, "STRONG").otherwise("DROP")).when(is_abbreviation(bare, head) | crossing, "STRONG").otherwise("WEAK")
    )


def parsed(raw: Column) -> Column:
    """struct(head, strong, weak, qualifiers) of a mention, in composed text."""
    body = strip_role_clause(raw)
    head = F.trim(F.regexp_replace(F.regexp_replace(body, _BRACKET, " "), r"(?U)[\s​]+", " "))
    kinds = F.transform(F.regexp_extract_all(body, F.lit(_BRACKET), F.lit(1)), lambda b: F.struct(classify(b, head).alias("k"), norm(b).alias("n")))
    of = lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(kinds, lambda x: (x["k"] == k) & (F.char_length(x["n"]) >= 2)), lambda x: x["n"])))
    return F.struct(norm(head).alias("head"), of("STRONG").alias("strong"), of("WEAK").alias("weak"), of("DROP").alias("qualifiers"))


def display_name(members: Column) -> Column:
    """The longest head, Thai ones first."""
    heads = F.filter(F.transform(members, lambda m: F.trim(F.regexp_replace(strip_prefix(F.regexp_replace(strip_role_clause(m), _BRACKET, "")), r"\s+", " "))), lambda h: h != "")
    thai = F.filter(heads, lambda h: h.rlike(_THAI))
    pool = F.when(F.size(thai) > 0, thai).otherwise(heads)
    best = F.array_sort(F.transform(pool, lambda h: F.struct((-F.char_length(h)).alias("n"), h.alias("h"))))
    return F.coalesce(F.get(best, F.lit(0))["h"], F.trim(F.get(members, F.lit(0))))


def risky(heads: Column) -> Column:
    """A merge of different heads rests on a bracket: someone should look."""
    return F.size(F.array_distinct(heads)) > 1
