"""Personal information in free text: seed entities induce lexical patterns (the words
that announce them), a pattern-instance graph is scored iteratively in Spark, and
patterns of high confidence discover unseen identifiers and names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .sieve import WordSieve, word_sieve

#: Share of a pattern's instances that must be of a kind for the pattern to announce it; its least
#: instances (more for identity numbers, whose leading digits orders share by chance); rounds of scoring; least share of seed pairs after a name pattern and its least seeds.
PATTERN_SHARE, PATTERN_LEAST, ID_LEAST, ROUNDS, NAME_SHARE, NAME_LEAST = 0.9, 5, 8, 3, 0.12, 3
#: Share of all its occurrences that a discovered name must have inside names.
OWN_SHARE = 0.3
#: Rows that a mapper holds back so as to emit each once.
HELD = 200_000

# Words that announce identity numbers and telephones (seed patterns), numbering plans, currencies, street words, spelled signs.
ID_WORDS = ("cin", "id card", "carte d'identité", "carte d'identité n°", "passport", "passeport", "passeport n°", "cnss", "sécurité sociale", "بطاقة تعريف عدد", "بطاقة التعريف الوطنية", "بطاقة تعريف", "جواز سفر عدد", "الجواز", "جواز السفر", "ب.ت.و", "الضمان الاجتماعي عدد")
PHONE_WORDS = ("tél", "tel", "téléphone", "phone", "mobile", "call", "numéro", "تلفون", "هاتف", "كلمني", "اتصل بيا على", "رقم الهاتف")
CURRENCY = r"(?:دينار|دنانير|مليم|dinars?|dt\b|tnd\b|€|euros?)"
PLANS = r"(?:\(\+216\)|\+216|00216)[ .\-]?\d{2}[ .\-]?\d{3}[ .\-]?\d{3}(?!\d)|(?:\(\+33\)|\+33|0033)[ .\-]?\d(?:[ .\-]?\d{2}){4}(?!\d)"
STREET_LATIN = r"(?:rue|avenue|av\.|bd\.?|boulevard|impasse|allée|chemin|ruelle|nahj|chara3|street)"
STREET_ARABIC = r"(?:نهج|شارع|زنقة|ممر|زقاق)"
NUMBER_WORD = r"(?:n\s?°|nº|no\.?|numéro|num|#|عدد|رقم)"
AT, DOT = r"(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\})", r"(?:\.|\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\})\s?)"
AT_WORD, DOT_WORD = r"(?:at|arobase|arrobase|arobas|آت|أروباز|اروباز)", r"(?:dot|point|نقطة)"
BEN = ("ben", "بن")
# End of fixed values.

DIGITS = {ord(a): str(i % 10) for i, a in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}
_LOCAL, _LABEL = r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*", r"[A-Za-z0-9\-]+"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+%\-])(?:{_LOCAL}(?:@|\s{{1,2}}@\s{{1,2}}|\s?(?!@){AT}\s?){_LABEL}(?:{DOT}{_LABEL})*{DOT}[A-Za-z]{{2,}}"
    rf"|[A-Za-z0-9_%+\-]+(?:(?:\.|\s{DOT_WORD}\s)[A-Za-z0-9_%+\-]+)*\s{AT_WORD}\s{_LABEL}(?:\s{DOT_WORD}\s{_LABEL})*\s{DOT_WORD}\s[A-Za-z]{{2,}})(?![A-Za-z0-9_])",
    re.IGNORECASE,
)
URL = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
NUMBER = re.compile(
    r"(?<![\w/.+#@\-])(?<!\d[ .\-])(?:"
    r"(?P<social>\d{8}-\d{2})"
    rf"|(?P<intl>{PLANS}|(?:\(\+\d{{2,3}}\)|\+\d{{2,3}}|00\d{{2,3}})[ .\-]?\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,5}})"
    r"|(?P<national>0\d(?:[ .\-]\d{2}){4})"
    r"|(?P<passport>[A-Z]{1,2}\d{6,7})"
    r"|(?P<grouped>\d{2}[ .\-]\d{3}[ .\-]\d{3})"
    r"|(?P<plain>\d{8}))(?!\w|[.\-/:]\d)(?P<money>\s*" + CURRENCY + ")?",
    re.IGNORECASE,
)
_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_HOUSE = r"(?<![\w./\-])(?<!\d[ .])\d{1,4}(?:\s?(?:bis|ter|مكرر))?"
ADDRESS = re.compile(
    rf"{_HOUSE}\s?[,،]?\s{{1,2}}(?:{STREET_LATIN}\s+(?:(?:de\sla|de\sl['’]|du|des|de|d['’]|l['’])\s?)?{_W}(?:\s{_W})?|{STREET_ARABIC}\s+{_W}(?:\s{_W})?)"
    rf"|(?<!\w)(?:{STREET_LATIN}\s+(?:{_W}\s+){{1,5}}?|{STREET_ARABIC}\s+(?:{_W}\s+){{1,4}}?|(?:{STREET_LATIN}|{STREET_ARABIC})\s+(?:{_W}\s+){{0,4}}{_W}\s?[,،]\s?){NUMBER_WORD}\s?:?\s?\d{{1,4}}(?!\d)",
    re.IGNORECASE,
)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SHAPES = ("social", "intl", "national", "passport", "grouped", "plain")
_OUTER = ":,،()[]{}«»\"<>؛;"


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """NULs over the spans, which are in order and apart."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "\0" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def before(text: str, at: int, most: int = 3) -> list[str]:
    """The announcing patterns of position ``at``: the one, two and three tokens before it
    in its line, in lower case, without outer colons, commas, brackets and quotes. Only as much of the
    line is read as these tokens take, however far away they stand."""
    reach = 80
    while True:
        part = text[max(0, at - reach) : at]
        line = part.rpartition("\n")[2]
        whole = len(line) < len(part) or reach >= at
        words = line.lower().split()
        if not whole and line and not line[0].isspace():
            words = words[1:]  # may be cut
        tokens = [t for t in (x.strip(_OUTER) for x in words) if t]
        if whole or len(tokens) >= most:
            return [" ".join(tokens[-n:]) for n in range(1, min(most, len(tokens)) + 1)] or ["^"]
        reach *= 4


AT_HINT = re.compile(rf"@|[\[({{]\s?at|\s{AT_WORD}\s", re.IGNORECASE)
DIGIT_HINT = re.compile(r"[٠-٩۰-۹]")
NUMBER_HINT = re.compile(r"\d[ .\-]?\d[ .\-]?\d[ .\-]?\d[ .\-]?\d[ .\-]?\d")
STREET_HINT = (*re.findall(r"[^\W_]{2,}", STREET_LATIN), *re.findall(r"\w{2,}", STREET_ARABIC))


def masked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with ASCII digits, and NULs over its email addresses (given) and URLs."""
    t = text.translate(DIGITS) if DIGIT_HINT.search(text) else text
    emails = [m.span() for m in EMAIL.finditer(t)] if AT_HINT.search(t) else []
    t = _blank(t, emails)
    return (_blank(t, [m.span() for m in URL.finditer(t)]) if "://" in t or "ww." in t.lower() else t), emails


def names_in(text: str, sieve: WordSieve, back: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Adjacent words ``(first, second, from, to)`` that could be a given and a family name;
    ``ben`` and its Arabic form belong to the word after them. A pair may begin with a word that is in
    the sieve or, with ``back`` 1, that comes after one."""
    lower = text.lower()
    if not sieve.among(WORD.findall(lower)):
        return
    w = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    low = [x[0].lower() for x in w]
    if len(lower) != len(text):  # letters that change their number in lower case part words otherwise
        sieve.among(low)
    hits = sieve.hits

    def near(i: int) -> bool:
        return i + 1 < len(w) and 0 < w[i + 1][1] - w[i][2] <= 2 and not text[w[i][2] : w[i + 1][1]].strip(" \t\xa0")

    for i in range(back, len(w) - 1):
        if low[i - back] in hits and near(i):
            second, end = w[i + 1][0], w[i + 1][2]
            if low[i + 1] in BEN:
                if not near(i + 1):
                    continue
                second, end = f"{second} {w[i + 2][0]}", w[i + 2][2]
            yield w[i][0], second, w[i][1], end


def spots_in(text: str) -> tuple[str, list[dict]]:
    """The masked text, and its emails, addresses and numbers with their shapes and patterns."""
    t, emails = masked(text)
    rows = [("email", a, b, "", []) for a, b in emails]
    rest = t
    low = t.lower()
    if any(word in low for word in STREET_HINT):
        streets = [m.span() for m in ADDRESS.finditer(t)]
        rows += [("address", a, b, "", []) for a, b in streets]
        rest = _blank(t, streets)
    for m in NUMBER.finditer(rest) if NUMBER_HINT.search(rest) else ():
        shape = next(k for k in SHAPES if m[k] is not None)
        if shape == "intl" and not 10 <= len(re.sub(r"\D", "", m[shape])) <= 14:
            continue
        value = re.sub(r"[ .\-]", "", m[shape])
        rows.append((shape if m["money"] is None or shape != "grouped" else "amount", m.start(), m.end(shape), value, before(rest, m.start())))
    return t, [dict(zip(("shape", "start_pos", "end_pos", "value", "patterns"), r, strict=True)) for r in rows]


def _spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        got = [spots_in(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "masked": [t for t, _ in got], "spots": [x for _, x in got]})


def _seed_contexts(given: WordSieve, family: WordSieve):
    """Patterns before pairs of words that may be listed names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for pdf in batches:
            for t in pdf["masked"]:
                for g, f, a, _ in names_in(t, given):
                    if family.limit(f.lower()):
                        seen.update((p, g.lower(), f.lower()) for p in before(t, a))
            if len(seen) >= HELD:
                yield pd.DataFrame(sorted(seen), columns=["pattern", "g", "f"])
                seen.clear()
        if seen:
            yield pd.DataFrame(sorted(seen), columns=["pattern", "g", "f"])

    return run


def _followers(patterns: WordSieve, last: WordSieve):
    """The different word pairs that follow a pattern. A mapper stops collecting beyond the
    pattern's limit, as so many rule it out whatever the other mappers find."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, set[str]] = {}
        full: set[str] = set()
        held, known = 0, patterns.known

        def out() -> pd.DataFrame:
            return pd.DataFrame([(p, x) for p, own in found.items() for x in own], columns=["pattern", "instance"])

        for pdf in batches:
            for t in pdf["masked"]:
                for line in t.lower().split("\n"):
                    w = [x for y in line.split() if (x := y.strip(_OUTER))]
                    if not last.among(w):
                        continue
                    for i, x in enumerate(w):
                        if x not in last.hits:
                            continue
                        for k in range(1, min(3, i + 1) + 1):
                            p = " ".join(w[i - k + 1 : i + 1])
                            most = known.get(p)
                            if most is None:
                                most = patterns.limit(p)
                            if not most or p in full:
                                continue
                            own = found.setdefault(p, set())
                            n = len(own)
                            own.add(" ".join(w[i + 1 : i + 3]))
                            held += len(own) - n
                            if len(own) > most:
                                full.add(p)
            if held >= HELD:
                yield out()
                found.clear()
                held = 0
        if found:
            yield out()

    return run


def _slots(patterns: WordSieve, last: WordSieve):
    """Pairs of words after what may be a pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["masked"], strict=True):
                for g, f, a, _ in names_in(t, last, 1):
                    rows += [(d, a, g.lower(), f.lower(), x) for x in before(t, a) if patterns.limit(x)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "g", "f", "pattern"])

    return run


def _capital(word: str) -> bool:
    return word.isascii() and all(x[:1].isupper() for x in word.split())


def _totals(counted: WordSieve):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, t in zip(pdf["h"], pdf["masked"], strict=True):
                w = WORD.findall(t.lower())
                if counted.among(w):
                    rows += [(x, h, n) for x, n in Counter(x for x in w if x in counted.hits).items()]
            if rows:
                yield pd.DataFrame(rows, columns=["f", "h", "total"])

    return run


def _pairs(given: WordSieve):
    """Pairs of words of which the first may be a given name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, h, t in zip(pdf["doc_id"], pdf["h"], pdf["masked"], strict=True):
                for g, f, a, b in names_in(t, given):
                    sure = (" " in f and f.split(" ")[0].lower() in BEN) or (_capital(g) and _capital(f) and len(f) > 2)
                    rows.append((d, h, a, b, g.lower(), f.lower(), sure))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "h", "start_pos", "end_pos", "g", "f", "sure"])

    return run


def number_kinds(numbers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, start_pos, end_pos, kind)`` of numbers announced as, or shaped like, a
    phone or an identity number.

    Graph: numbers are instances, their announcing patterns the other side. Shapes seed
    the instances (international and national phones; passport and social security
    numbers; eight digits from 0 or 1 lean to a national card, others to a phone), the
    word lists seed the patterns. In each round a pattern's score for a kind is the mean
    belief of its instances, and instances of accepted patterns are believed of the kind.
    Phones also need strong shapes among a pattern's instances, as numbers of orders and
    bills look like plain phones. The longest accepted pattern decides; without any, only
    unmistakable phone shapes count, unless a currency follows the number or the pattern next
    to it announces numbers that too seldom have the shape of a phone (distinct ones count)."""
    lead = F.substring("value", 1, 1).isin("0", "1")
    eight = F.col("shape").isin("grouped", "plain", "amount")
    strong_id, strong_phone = F.col("shape").isin("social", "passport"), F.col("shape").isin("intl", "national")
    seeds = numbers.sparkSession.createDataFrame([(w, "id_number") for w in ID_WORDS] + [(w, "phone") for w in PHONE_WORDS], "pattern string, kind string")
    edges = numbers.select("doc_id", "start_pos", "value", "shape", F.posexplode("patterns").alias("k", "pattern"))
    edges = materialize(edges.withColumn("id_like", (strong_id | (eight & lead)).cast("int")).withColumn("phone_like", (strong_phone | (eight & ~lead)).cast("int")).withColumn("strong", strong_phone.cast("int")), "pii-edges")
    flat = edges.groupBy("pattern", "value").agg(*[F.max(c).alias(c) for c in ("id_like", "phone_like", "strong")], F.max(F.when(F.col("shape") == "amount", 0).otherwise(F.col("phone_like"))).alias("phone"))
    flat = materialize(flat, "pii-pattern-values")  # copies count once
    known = seeds
    for i in range(rounds):
        flags = [F.max((F.col("kind") == k).cast("int")).alias(c) for k, c in (("id_number", "b_id"), ("phone", "b_phone"))]
        believed = flat.join(known, "pattern").groupBy("value").agg(*flags)
        e = flat.join(believed, "value", "left").fillna(0, ["b_id", "b_phone"])
        s = e.groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.greatest("id_like", "b_id")).alias("id"), F.avg(F.greatest("phone_like", "b_phone")).alias("phone"), F.avg(F.greatest("strong", "b_phone")).alias("strong"))
        kind = F.when((F.col("id") >= PATTERN_SHARE) & (F.col("strong") < 0.1) & (F.col("n") >= ID_LEAST), F.lit("id_number")).when((F.col("phone") >= PATTERN_SHARE) & (F.col("strong") >= 0.1), F.lit("phone"))
        found = s.where(F.col("n") >= PATTERN_LEAST).select("pattern", kind.alias("kind")).where("kind is not null and pattern <> '^'")
        known = materialize(seeds.unionByName(found.join(seeds.select("pattern"), "pattern", "left_anti")), f"pii-patterns-{i}")
    others = flat.groupBy("pattern").agg(F.count("*").alias("n"), F.avg("phone").alias("phone")).where((F.col("n") >= PATTERN_LEAST) & (F.col("phone") < PATTERN_SHARE) & (F.col("pattern") != "^"))
    others = others.join(known, "pattern", "left_anti").select("pattern", F.lit("other").alias("kind"))
    judged = edges.join(known.unionByName(others), "pattern", "left").groupBy("doc_id", "start_pos").agg(F.max(F.when(F.col("kind") != "other", F.struct("k", "kind"))).alias("best"), F.max((F.col("kind") == "other") & (F.col("k") == 0)).alias("other"))
    r = numbers.join(judged, ["doc_id", "start_pos"])
    kind = F.col("best.kind")
    out = F.when(strong_phone, F.when(kind == "id_number", F.lit(None)).otherwise(F.lit("phone"))).when(strong_id, F.when(kind == "id_number", F.lit("id_number"))).when(kind.isNotNull(), kind).when((F.col("shape") == "grouped") & ~lead & ~F.coalesce("other", F.lit(False)), F.lit("phone"))
    return r.select("doc_id", "start_pos", "end_pos", out.alias("kind")).where("kind is not null")


def name_spans(texts: DataFrame, name_list: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, start_pos, end_pos)`` of given names followed by family names in
    ``texts (doc_id, masked)``.

    Seeds are pairs of listed names. The words before them are patterns; one is accepted
    if its share of seeds among the different word pairs after it is high (copies count once). The pairs that accepted
    patterns announce form the graph: a word after a known given name becomes a family
    name, a word before known family names a given name, over ``rounds`` rounds. Pairs of
    known names count anywhere, if a discovered name mostly stands in names; so does a
    known given name before ``ben`` and a word, or, in Latin letters, before a capital.

    Mappers look for names and patterns by sieves of a fixed size, and what they find is joined
    with the tables of names and patterns; these may have any size."""
    names = name_list.where("name is not null").select(F.lower(F.trim("name")).alias("name"), "name_kind").distinct()
    given, family = (names.where(F.col("name_kind") == k).select(F.col("name").alias(c)) for k, c in (("given", "g"), ("family", "f")))
    found = texts.select("masked").mapInPandas(_seed_contexts(word_sieve(given, "g"), word_sieve(family, "f")), "pattern string, g string, f string")
    seeds = found.distinct().join(given, "g").join(family, "f").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= NAME_LEAST)
    last = lambda d: word_sieve(d.select(F.element_at(F.split("pattern", " "), -1).alias("w")), "w")
    seeds = materialize(seeds.withColumn("most", F.ceil(F.col("seeds") / NAME_SHARE)), "pii-seeds")
    totals = texts.select("masked").mapInPandas(_followers(word_sieve(seeds, "pattern", "most"), last(seeds)), "pattern string, instance string").distinct().groupBy("pattern").agg(F.count("*").alias("total"))
    good = materialize(seeds.join(totals, "pattern").where((F.col("seeds") >= NAME_SHARE * F.col("total")) & (F.col("pattern") != "^")), "pii-name-patterns")
    kind = dict(texts.dtypes)["doc_id"]
    ends = word_sieve(good.select(F.regexp_extract("pattern", r"([\p{L}]+(?:['’][\p{L}]+)*)[^\p{L}]*$", 1).alias("w")).where("w <> ''"), "w")
    slots = texts.mapInPandas(_slots(word_sieve(good, "pattern"), ends), f"doc_id {kind}, start_pos int, g string, f string, pattern string")
    slots = materialize(slots.join(good.select("pattern"), "pattern").select("g", "f").distinct(), "pii-slots")
    gs, fs = given, family
    for i in range(rounds):
        seen = slots.join(gs.withColumn("kg", F.lit(1)), "g", "left").join(fs.withColumn("kf", F.lit(1)), "f", "left").fillna(0, ["kg", "kf"])
        ben = F.col("f").rlike(r"^(?:ben|بن)\s")
        new_f = seen.groupBy("f").agg(F.avg("kg").alias("share")).where("share >= 0.5").select("f")
        new_g = seen.groupBy("g").agg(F.avg(F.greatest("kf", ben.cast("int"))).alias("share"), F.sum(F.greatest("kf", ben.cast("int"))).alias("n")).where("share >= 0.3 and n >= 2").select("g")
        gs, fs = materialize(gs.union(new_g).distinct(), f"pii-given-{i}"), materialize(fs.union(new_f).distinct(), f"pii-family-{i}")
    new = materialize(fs.join(names.select(F.col("name").alias("f")), "f", "left_anti").where("f not like '% %'"), "pii-new-names")
    hashed = texts.select("doc_id", "masked", F.xxhash64("masked").alias("h"))  # copies count once
    pairs = hashed.mapInPandas(_pairs(word_sieve(gs, "g")), f"doc_id {kind}, h bigint, start_pos int, end_pos int, g string, f string, sure boolean").join(gs, "g")
    totals = hashed.select("h", "masked").mapInPandas(_totals(word_sieve(new, "f")), "f string, h bigint, total bigint").join(new, "f").distinct().groupBy("f").agg(F.sum("total").alias("total"))
    real = materialize(pairs.join(fs.withColumn("kf", F.lit(True)), "f", "left").where(F.col("sure") | F.col("kf")), "pii-pairs")
    inside = real.select("f", "h", "start_pos").distinct().groupBy("f").agg(F.count("*").alias("inside"))
    doubtful = totals.join(inside, "f").where(F.col("inside") < OWN_SHARE * F.col("total")).select("f")
    return real.join(doubtful, "f", "left_anti").select("doc_id", "start_pos", "end_pos")


def entities(documents: DataFrame, name_list: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, kind, start_pos, end_pos)`` of the personal data in ``documents``, in code
    points from 0, the announcing words not included.

    Null texts and ids are left out, empty texts have none; rows repeated under one id
    count once; texts are read whole; other columns, whatever their names, are not read."""
    texts = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    spot = "struct<shape string, start_pos int, end_pos int, value string, patterns array<string>>"
    read = materialize(texts.mapInPandas(_spots, f"doc_id {dict(documents.dtypes)['doc_id']}, masked string, spots array<{spot}>"), "pii-masked")
    spots = read.select("doc_id", F.explode("spots").alias("x")).select("doc_id", "x.*").distinct()
    plain = spots.where("shape in ('email', 'address')").select("doc_id", F.col("shape").alias("kind"), "start_pos", "end_pos")
    numbers = number_kinds(spots.where("shape not in ('email', 'address')"), rounds).select("doc_id", "kind", "start_pos", "end_pos")
    names = name_spans(read.select("doc_id", "masked"), name_list, rounds).select("doc_id", F.lit("name").alias("kind"), "start_pos", "end_pos")
    return plain.unionByName(numbers).unionByName(names).distinct()


def found(documents: DataFrame, name_list: DataFrame) -> DataFrame:
    """``(doc_id, kind, start_pos)``, one row per occurrence."""
    return entities(documents, name_list).select("doc_id", "kind", F.col("start_pos").cast("bigint").alias("start_pos"))


def placeholders(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that overlap as one, of the kind of the one that begins first (ties: the longer one),
    so that nothing found is left in the text."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in the stead of each span; overlapping ones share one placeholder."""
    out, at = [], 0
    for a, b, kind in placeholders(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _replacer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = [[] if s is None else [(x["start_pos"], x["end_pos"], x["kind"]) for x in s] for s in pdf["spans"]]
        text = [t if t is None or not s else replace_spans(t, s) for t, s in zip(pdf["text"], spans, strict=True)]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": text, "replaced": [len(placeholders(s)) for s in spans]})


def redacted(documents: DataFrame, name_list: DataFrame) -> DataFrame:
    """``(doc_id, text, replaced)``: every document with typed placeholders and their number. The spans of one document, bounded by its length, meet in one row."""
    spans = entities(documents, name_list).groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "kind")).alias("spans"))
    own = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    return own.mapInPandas(_replacer, f"doc_id {dict(documents.dtypes)['doc_id']}, text string, replaced int")
