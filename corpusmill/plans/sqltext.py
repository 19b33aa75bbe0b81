"""Pieces of the SQL that the queries are held against."""

from __future__ import annotations

from ..functions import codeswitch, corpus
from ..functions import text as tx

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$")


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {lit(WS + '+')}), lambda x: x <> '')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def mapping(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in m.items()) + "}"


def diacritics(c: str) -> str:
    return sub(c, tx.DIACRITICS)


def unicode_form(c: str) -> str:
    return f"translate(nfc_normalize({c}), 'إأٱ', 'ااا')"


def noise(c: str) -> str:
    return sub(sub(sub(c, r"https?://\S+|www\.\S+"), r"#[\p{L}\p{N}_]+"), r"@[\p{L}\p{N}_]+")


def digits(c: str) -> str:
    return f"translate({c}, '{tx.INDIC_DIGITS}', '{tx.ASCII_DIGITS}')"


def collapse(c: str) -> str:
    return strip(sub(c, " {2,}", " "))


def substitutions(c: str) -> str:
    return f"translate({c}, '{tx.SUBSTITUTIONS[0] + tx.DELETIONS}', '{tx.SUBSTITUTIONS[1]}')"


def corrections(c: str) -> str:
    for a, b in CORRECTION_RULES:
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


def clean(c: str, correct: bool = True) -> str:
    c = collapse(substitutions(digits(sub(diacritics(unicode_form(noise(c))), tx.PUNCTUATION))))
    return collapse(corrections(c)) if correct else c


def char_class(c: str) -> str:
    return "case " + " ".join(f"when {has(c, f'^{p}$')} then '{n}'" for n, p in tx.CHAR_CLASSES) + " else 'other' end"


def light(c: str) -> str:
    return f"translate({sub(c, r'[\x{064B}-\x{0652}]')}, 'أإآىؤئة', 'اااي' || 'ويه')"


def negation(c: str) -> str:
    return sub(c, rf"(ما)([^{WS[1:-1]}]{{2,}})(ش)({WS}|$)", r"\1 \2 \3\4")


# Fixed values, stated here again so that the SQL does not depend on the engine's tables.
NOTA_OVERRIDES = "احنا احنا,انا انا,انت انت,انتي انتي,عالسلامة عالسلامة,كانطريبرنور كانطروبرونور,هاذا هاذا,هاذاكه هاذاكه,هاذي هاذي,هاذيكه هاذيكه,هو هو,هوما هوما,هي هي"
NOTA_VARIANTS = (
    "احنا احنا,اش آش,انا انا,انت انت,انترنت انترنات,انترنيت انترنات,انتي انتي,برشا برشا,بوستا بوسطة,بوستة بوسطة,بوسته بوسطة,ثما ثمة,ثمة فمة,ثمه ثمة,دجى ديجا,ديجى ديجا,"
    "رصول رسول,زادا زادة,زادة زادة,زدة زادة,فمةى فمة,فمه فمة,فمى فمة,فمّا فمة,ماش ما,متاع متاع,مش مش,موش مش,ميش مش,هاذاك هاذاكه,هاذه هاذي,هاذيك هاذيكه,"
    "هذا هاذا,هذاك هاذاكه,هذه هاذي,هذي هاذي,هذيك هاذيكه,واتسب واتساب,وواتساب واتساب"
)
NOTA_RULES = {"o": (10, "canonical_override"), "v": (9, "variant_map"), "h": (7, "hamza_drop"), "y": (6, "waw_plurality"), "t": (5, "taa_marbuta"), "a": (4, "alef_maqsura")}
NOTA_FLAGS = {"o": "override", "v": "variant", "h": "hamza", "y": "waw", "t": "taa", "a": "alef"}
CORRECTION_RULES = (("و ہ", "وه"), ("اLي", "ايلي"), ("اتs", ""), ("ايm v", "ايم قانا"), ("الفرحةd", "الفرحة"), ("دارك اتs ليكه و الي حاجة ياسر", "ولي حاجة ياسر دارك و اتس لايك"), ("كيفYou", "You"), ("cاي", "س"), ("60", "ستين"), ("18", "ثمنطاش"), ("11", "حداش"), ("3", "ثلاثة"))
# End of fixed values.


def pairs_map(pairs: str) -> str:
    return mapping(dict(x.split(" ") for x in pairs.split(",")))


def nota_words(c: str, layers: str = "ovh", keep: str = "[]", waw: str = "[]", taa: str = "MAP {}") -> str:
    """List of structs of the words of ``c``: w (new form), one flag per layer, l (changes). The
    lists of words to leave and the map are SQL expressions."""
    over, var = pairs_map(NOTA_OVERRIDES), pairs_map(NOTA_VARIANTS)
    rules = {
        "o": (f"map_contains({over}, x.w)", f"{over}[x.w]"),
        "v": (f"map_contains({var}, x.w)", f"{var}[x.w]"),
        "h": ("x.w[1] in ('أ', 'إ')", "'ا' || x.w[2:]"),
        "y": (f"length(x.w) >= 3 and x.w[-1] = 'و' and not list_contains({waw}, x.w)", "x.w || 'ا'"),
        "t": (f"map_contains({taa}, x.w)", f"{taa}[x.w]"),
        "a": (f"x.w[-1] = 'ى' and not list_contains({keep}, x.w)", "x.w[:-2] || 'ي'"),
    }
    w = f"list_transform({tokens(c)}, lambda x: {{'w': x, 'l': [{{'layer': 0, 'rule': '', 'before': '', 'after': ''}}], {', '.join(f"'{k}': false" for k in rules)}}})"
    for k in layers:
        cond, value = rules[k]
        hit = f"(not x.o and {cond})"
        number, rule = NOTA_RULES[k]
        rest = ", ".join(f"'{f}': {hit if f == k else f'x.{f}'}" for f in rules)
        w = f"list_transform({w}, lambda x: {{'w': case when {hit} then {value} else x.w end, 'l': case when {hit} then list_append(x.l, {{'layer': {number}, 'rule': '{rule}', 'before': x.w, 'after': {value}}}) else x.l end, {rest}}})"
    return w


def nota_flags(w: str = "w", layers: str = "ovhyta") -> str:
    return ", ".join(f"case when {w} is not null then len(list_filter({w}, lambda x: x.{k})) > 0 end as {NOTA_FLAGS[k]}_applied" for k in layers)


def nota_text(c: str, w: str = "w") -> str:
    return f"case when len({w}) = 0 then {c} else array_to_string(list_transform({w}, lambda x: x.w), ' ') end"


def latin_word(w: str) -> str:
    return f"({has(w, codeswitch.LATIN_WORD)} and {sub(w, r'''^['\-]+|['\-]+$''')} <> '')"


def special(c: str) -> str:
    c = sub(c, corpus.EMOJI)
    for p in (r"\[[^\]]+\]", rf"\({WS}*ضحك{WS}*\)", rf"\({WS}*تصفيق{WS}*\)", rf"\({WS}*صوت{WS}*\)", "[♪♫]+", rf"^RT{WS}+"):
        c = sub(c, f"(?i){p}")
    c = sub(c, r"(?i)(^|[^\p{L}\p{N}_])AFP($|[^\p{L}\p{N}_])", r"\1\2")
    for p in (r"<s>\[INST\]", r"\[/INST\]", "</s>"):
        c = sub(c, f"(?i){p}")
    return c


_KEEP = r"\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"


def symbols(c: str) -> str:
    return sub(c, rf"[^{_KEEP}\x{{0600}}-\x{{06FF}}.،؛:\-!؟()\"'`]")


def squeeze(c: str) -> str:
    return strip(sub(c, f"{WS}+", " "))


def dedup_key(c: str) -> str:
    return squeeze(sub(f"translate({sub(c, corpus.DEDUP_MARKS)}, '{corpus.ALEFS}ىة', 'ااااي' || 'ه')", rf"[^{_KEEP}\x{{0600}}-\x{{06FF}}]", " "))


def repeated_chars(c: str) -> str:
    return f"(length({c}) > 2 and len(list_filter(range(1, length({c}) - 1), lambda i: {c}[i] = {c}[i + 1] and {c}[i] = {c}[i + 2] and {c}[i] <> chr(10))) > 0)"


def repeated_word(c: str) -> str:
    t = tokens(c)
    end, begin = r"([\p{L}\p{N}_]+)$", r"^([\p{L}\p{N}_]+)"
    return f"(len(list_filter(range(1, len({t})), lambda i: regexp_extract(lower({t}[i]), {lit(end)}) <> '' and regexp_extract(lower({t}[i]), {lit(end)}) = regexp_extract(lower({t}[i + 1]), {lit(begin)}))) > 0)"


def script_type(c: str) -> str:
    a, f = has(c, r"[\x{0600}-\x{06FF}]"), has(c, r"\p{Latin}")
    return f"case when {a} and {f} then 'mixed' when {a} then 'arabic' when {f} then 'french' when {c} is not null then 'other' end"


def dominant(c: str) -> str:
    t = tokens(c)
    return f"(case when len({t}) < 2 then 0.0::double else list_max(list_transform(list_distinct({t}), lambda w: len(list_filter({t}, lambda y: y = w))))::double / len({t}) end)"
