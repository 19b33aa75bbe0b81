"""Orthographic normalisation of dialect text in layers, as one chain of array transforms.

Order: negation split over the text, then per word: canonical override (which stops),
variant collapse, initial hamza, plural waw, taa marbuta, alef maqsura."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, tokens

# Canonical forms that no other layer touches, and spelling variants.
OVERRIDES = {
    "احنا": "احنا",
    "انا": "انا",
    "انت": "انت",
    "انتي": "انتي",
    "عالسلامة": "عالسلامة",
    "كانطريبرنور": "كانطروبرونور",
    "هاذا": "هاذا",
    "هاذاكه": "هاذاكه",
    "هاذي": "هاذي",
    "هاذيكه": "هاذيكه",
    "هو": "هو",
    "هوما": "هوما",
    "هي": "هي",
}
VARIANTS = {
    "احنا": "احنا", "اش": "آش", "انا": "انا", "انت": "انت", "انترنت": "انترنات", "انترنيت": "انترنات", "انتي": "انتي", "برشا": "برشا",
    "بوستا": "بوسطة", "بوستة": "بوسطة", "بوسته": "بوسطة", "ثما": "ثمة", "ثمة": "فمة", "ثمه": "ثمة", "دجى": "ديجا", "ديجى": "ديجا",
    "رصول": "رسول", "زادا": "زادة", "زادة": "زادة", "زدة": "زادة", "فمةى": "فمة", "فمه": "فمة", "فمى": "فمة", "فمّا": "فمة",
    "ماش": "ما", "متاع": "متاع", "مش": "مش", "موش": "مش", "ميش": "مش", "هاذاك": "هاذاكه", "هاذه": "هاذي", "هاذيك": "هاذيكه",
    "هذا": "هاذا", "هذاك": "هاذاكه", "هذه": "هاذي", "هذي": "هاذي", "هذيك": "هاذيكه", "واتسب": "واتساب", "وواتساب": "واتساب",
}
#: Layers of words in their order: name, number and rule name in change logs.
WORD_LAYERS = (("override", 10, "canonical_override"), ("variant", 9, "variant_map"), ("hamza", 7, "hamza_drop"), ("waw", 6, "waw_plurality"), ("taa", 5, "taa_marbuta"), ("alef", 4, "alef_maqsura"))
NEGATION = (8, "negation_separation")
#: Layers that are off unless a configuration turns them on, as they depend on lexicons.
OFF_BY_DEFAULT = frozenset({"waw", "taa", "alef"})
# End of fixed values.

LAYERS = (*(k for k, _, _ in WORD_LAYERS), "negation")


@dataclass(frozen=True)
class Nota:
    """Lexicons and layer switches. The large lexicons are parameters (see
    ``sources.loaders.nota_lexicons``); ``gaf`` is kept for callers, as no layer uses it."""

    overrides: Mapping[str, str] = field(default_factory=lambda: OVERRIDES)
    variants: Mapping[str, str] = field(default_factory=lambda: VARIANTS)
    taa: Mapping[str, str] = field(default_factory=dict)
    keep_alef: Sequence[str] = ()
    waw_exceptions: Sequence[str] = ()
    gaf: Sequence[str] = ()
    off: frozenset[str] = OFF_BY_DEFAULT

    def on(self, layer: str) -> bool:
        return layer not in self.off


def split_negation(c: Column) -> Column:
    """``ma``-verb-``sh`` written as one word becomes three; the verb has two letters or more."""
    return F.regexp_replace(c, rf"(ما)([^{WS[1:-1]}]{{2,}})(ش)(?={WS}|$)", "$1 $2 $3")


def _among(x: Column, words) -> Column:
    """Membership; beyond ten words Spark looks them up in a hash set."""
    return x.isin(*words) if len(words) else F.lit(False)


def _lookup(m: Mapping[str, str]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Whether a word is a key, and its value, which is only searched for words that are keys."""
    table = F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).cast("map<string,string>") if m else F.create_map().cast("map<string,string>")
    return (lambda x: _among(x, list(m))), (lambda x: table[x])


def _rules(n: Nota) -> dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]]:
    """Of each layer that is on and not empty: the test of a word and its new form."""
    all_ = {
        "override": _lookup(n.overrides),
        "variant": _lookup(n.variants),
        "hamza": (lambda x: x.rlike("^[أإ]"), lambda x: F.regexp_replace(x, "^[أإ]", "ا")),
        "waw": (lambda x: (F.length(x) >= 3) & x.endswith("و") & ~_among(x, n.waw_exceptions), lambda x: F.concat(x, F.lit("ا"))),
        "taa": _lookup(n.taa),
        "alef": (lambda x: x.endswith("ى") & ~_among(x, n.keep_alef), lambda x: F.regexp_replace(x, "ى$", "ي")),
    }
    empty = {k for k, m in (("override", n.overrides), ("variant", n.variants), ("taa", n.taa)) if not m}
    return {k: v for k, v in all_.items() if n.on(k) and k not in empty}


def word_layers(c: Column, n: Nota = Nota(), log: bool = False) -> Column:
    """Array of ``(w, hits[, log])`` of the words of ``c``: the new form, the bits of the layers
    that applied (the first layer's is 1) and the changes ``(layer, rule, before, after)``."""
    empty = F.array().cast("array<struct<layer:int,rule:string,before:string,after:string>>")
    words = F.transform(tokens(c), lambda x: F.struct(x.alias("w"), F.lit(0).alias("hits"), *([empty.alias("log")] if log else [])))
    for i, (name, number, rule) in enumerate(WORD_LAYERS):
        if name not in (rules := _rules(n)):
            continue
        hit, value = rules[name]

        def one(x: Column) -> Column:
            ok = (x["hits"].bitwiseAND(F.lit(1)) == 0) & hit(x["w"])  # noqa: B023
            new = [value(x["w"]).alias("w"), (x["hits"] + (1 << i)).alias("hits")]  # noqa: B023
            if log:
                entry = F.struct(F.lit(number).alias("layer"), F.lit(rule).alias("rule"), x["w"].alias("before"), value(x["w"]).alias("after"))  # noqa: B023
                new.append(F.array_append(x["log"], entry).alias("log"))
            return F.when(ok, F.struct(*new)).otherwise(x)

        words = F.transform(words, one)
    return words


def with_nota(df: DataFrame, text: str, out: str = "transcript_nota", n: Nota = Nota(), log: bool = False) -> DataFrame:
    """``df`` with the normalised text, a flag ``<layer>_applied`` per layer and, with
    ``log``, ``<out>_log``: ``array<struct<layer, rule, before, after>>`` of all changes in
    their order, the split of negations first, over the whole text.

    Null stays null with null flags; blank text is left untouched with false flags."""
    c = F.col(text)
    neg = split_negation(c) if n.on("negation") else c
    words = F.col("__words")
    d = df.withColumn("__neg", neg).withColumn("__words", word_layers(F.col("__neg"), n, log))
    d = d.withColumn(out, F.when(F.size(words) == 0, c).otherwise(F.array_join(F.transform(words, lambda x: x["w"]), " ")))
    d = d.withColumn("__hits", F.when(c.isNotNull(), F.aggregate(words, F.lit(0), lambda a, x: a.bitwiseOR(x["hits"]))))
    d = d.withColumns({f"{k}_applied": F.col("__hits").bitwiseAND(F.lit(1 << i)) != 0 for i, (k, _, _) in enumerate(WORD_LAYERS)})
    d = d.withColumn("negation_applied", F.when(c.isNotNull(), c != F.col("__neg")))
    if log:
        split = F.struct(F.lit(NEGATION[0]).alias("layer"), F.lit(NEGATION[1]).alias("rule"), c.alias("before"), F.col("__neg").alias("after"))
        first = F.when(c != F.col("__neg"), F.array(split)).otherwise(F.array().cast("array<struct<layer:int,rule:string,before:string,after:string>>"))
        d = d.withColumn(f"{out}_log", F.when(c.isNotNull(), F.concat(first, F.flatten(F.transform(words, lambda x: x["log"])))))
    return d.drop("__neg", "__words", "__hits")
