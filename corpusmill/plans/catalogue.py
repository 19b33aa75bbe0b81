"""One query per operator, over the whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio, codeswitch, corpus, metrics, nota
from ..functions import text as tx
from ..operators import audit, joins, knowledge, reports, timing, waveforms
from ..sources import loaders, sinks
from ..tables import load, norm_key, norm_split, rec_of, shared_dir
from . import pipelines
from . import sqltext as q
from .registry import query

T, M, R, D, E = "df_train_clean", "manifest", "recordings", "documents", "expressions"
SPLIT = "case when lower(trim(split)) in ('valid', 'dev') then 'validation' else lower(trim(split)) end"
KEY = "lower(trim(audio_id))"
REC = "regexp_replace(audio_id, '_[^_]*$', '')"
NUM = "case when isnan({c}) then null else {c} end"
# One row per segment id: all deliveries of one have the same values.
SEGMENTS = f"(select {KEY} as audio_id, max({SPLIT}) as split, max(seg_start) as seg_start, max(seg_end) as seg_end, max({NUM.format(c='duration_s')}) as duration_s, max(kept) as kept, max(sample_rate) as sample_rate from {M} where audio_id is not null group by 1)"
TEXTS = f"(select {KEY} as audio_id, max(transcript_nota) as text from {T} where audio_id is not null group by 1)"
_RD = f"select audio_id as rec_id, coalesce(list_max(list_transform(segments, lambda s: s['end'])), 0.0::double) as duration_s from {R}"
_L1 = f"select doc_id, source, {q.special('text')} as t from {D} where text is not null"
_L2 = f"select doc_id, source, {q.squeeze(q.symbols('t'))} as t from ({_L1}) where not {q.has('t', r'\p{Latin}')} and not {q.has('t', r'#[\p{L}\p{N}_]')}"
_L3 = f"select doc_id, source, t from ({_L2}) where {q.script_type('t')} = 'arabic' and not {q.has('t', r'\p{Nd}')} and not {q.repeated_chars('t')} and not {q.repeated_word('t')} and {q.dominant('t')} <= 0.5"
_L4 = f"select doc_id, t from (select *, row_number() over (partition by {q.dedup_key('t')} order by doc_id) as r from ({_L3})) where r = 1 and length(t) >= 3 and len({q.tokens('t')}) >= 3"


def reg(name: str, tables: str, sql: str | None, f) -> None:
    query(name, sql)(lambda spark, d: f(*[load(spark, d, t) for t in tables.split()]))


def col(name: str, table: str, key: str, expressions: dict[str, tuple], where: str | None = None) -> None:
    """A query of scalar columns: name to (function of a Column, SQL)."""
    cols = ", ".join(f"{s} as {n}" for n, (_, s) in expressions.items())
    w = f" where {where}" if where else ""
    reg(name, table, f"select {key}, {cols} from {table}{w}", lambda t: (t.where(where) if where else t).select(key, *[c().alias(n) for n, (c, _) in expressions.items()]))


# Transcript cleaning.
col("t1_remove_diacritics", T, "audio_id", {"t": (lambda: tx.remove_diacritics(F.col("transcript")), q.diacritics("transcript"))})
col("t3_remove_punctuation", T, "audio_id", {"t": (lambda: tx.remove_punctuation(F.col("transcript")), q.sub("transcript", tx.PUNCTUATION))})
col("t4_remove_urls_and_noise", D, "doc_id", {"t": (lambda: tx.remove_urls_and_noise(F.col("text")), q.noise("text"))})
col("t5_normalize_digits", D, "doc_id", {"kept": (lambda: tx.normalize_digits(F.col("text")), q.digits("text")), "gone": (lambda: tx.normalize_digits(F.col("text"), False), q.sub(q.digits("text"), "[0-9]"))})
col("t6_collapse_whitespace", D, "doc_id", {"t": (lambda: tx.collapse_whitespace(F.col("text")), q.collapse("text"))})
col("t7_char_substitutions", D, "doc_id", {"t": (lambda: tx.apply_char_substitutions(F.col("text")), q.substitutions("text"))})
col("t8_transcript_corrections", D, "doc_id", {"t": (lambda: tx.apply_corrections(F.col("text")), q.corrections("text"))})
reg("t2_normalize_unicode", T, f"select audio_id, {q.unicode_form('transcript')} as t from {T}", lambda t: t.select("audio_id", tx.normalize_unicode("transcript").alias("t")))
reg("t9_clean_transcript", T, f"select audio_id, {q.clean('transcript', False)} as plain, {q.clean('transcript')} as corrected from {T}", lambda t: t.select("audio_id", tx.clean_transcript("transcript").alias("plain"), tx.clean_transcript("transcript", corrections=tx.CORRECTIONS).alias("corrected")))
reg("t10_clean_dataframe", T, f"select *, {q.clean('transcript')} as cleaned from {T}".replace("select *", "select audio_id, transcript"), lambda t: t.withColumn("cleaned", tx.clean_transcript("transcript", corrections=tx.CORRECTIONS)).select("audio_id", "transcript", "cleaned"))

# Orthographic normalisation.
col("n1_separate_negation", T, "audio_id", {"t": (lambda: nota.split_negation(F.col("transcript_cs")), q.negation("transcript_cs"))})

_W = q.nota_words(q.negation("transcript_cs"))
_NW = f"(select audio_id, transcript_cs as c, {q.negation('transcript_cs')} as g, {_W} as w from {T})"
reg(
    "n2_to_n10_nota_with_flags",
    T,
    f"select audio_id, {q.nota_text('c')} as nota, {q.nota_flags()}, g <> c as negation_applied from {_NW}",
    lambda t: nota.with_nota(t.select("audio_id", "transcript_cs"), "transcript_cs", "nota").drop("transcript_cs"),
)
_LOG = "list_concat(case when g <> c then [{'layer': 8, 'rule': 'negation_separation', 'before': c, 'after': g}] else [] end, flatten(list_transform(w, lambda x: x.l[2:])))"
reg(
    "n11_change_log",
    T,
    f"select audio_id, i - 1 as step, x[i].layer as layer, x[i].rule as rule, x[i].before as before, x[i].after as after from (select audio_id, x, unnest(range(1, len(x) + 1)) as i from (select audio_id, {_LOG} as x from {_NW} where c is not null))",
    lambda t: nota.with_nota(t.select("audio_id", "transcript_cs"), "transcript_cs", "nota", log=True).select("audio_id", F.posexplode("nota_log").alias("step", "x")).select("audio_id", "step", "x.*"),
)
_OFF = q.nota_words("transcript_cs", "v")
reg(
    "n13_layers_off",
    T,
    f"select audio_id, {q.nota_text('c')} as nota, {q.nota_flags()}, case when c is not null then false end as negation_applied from (select audio_id, transcript_cs as c, {_OFF} as w from {T})",
    lambda t: nota.with_nota(t.select("audio_id", "transcript_cs"), "transcript_cs", "nota", nota.Nota(off=frozenset(nota.LAYERS) - {"variant"})).drop("transcript_cs"),
)
# All layers, with lexicons in files: words of the expressions as words to leave, their endings as a map.
_XW = f"(select distinct unnest(list_concat({q.tokens('term_arabic')}, {q.tokens('example')})) as w from {E})"
_LEX = f"(select coalesce(list(w) filter (w[-1] = 'ى' and length(w) % 2 = 0), []) as keep, coalesce(list(w) filter (w[-1] = 'و' and length(w) % 2 = 0), []) as waw, map_from_entries(coalesce(list((w, w[:-2] || 'ة')) filter (w[-1] = 'ه' and length(w) > 2), [])) as taa from {_XW})"
_ALL = q.nota_words(q.negation("transcript_cs"), "ovhyta", "keep", "waw", "taa")


def _all_layers(t: DataFrame, e: DataFrame) -> DataFrame:
    """Lexicons written as files and read by the loaders, then every layer on."""
    spark = t.sparkSession
    folder = f"{shared_dir(spark)}/corpusmill/lexicons-{uuid.uuid4().hex}"
    none = F.array().cast("array<string>")
    w = e.select(F.explode(F.concat(F.coalesce(tx.tokens("term_arabic"), none), F.coalesce(tx.tokens("example"), none))).alias("w")).distinct()
    files = {
        "alef_maqsura_list": w.where(F.col("w").endswith("ى") & (F.length("w") % 2 == 0)),
        "waw_exceptions": w.where(F.col("w").endswith("و") & (F.length("w") % 2 == 0)),
        "taa_marbuta_ha_list": w.where(F.col("w").endswith("ه") & (F.length("w") > 2)).select(F.concat_ws("\t", "w", F.regexp_replace("w", "ه$", "ة")).alias("w")),
    }
    for name, d in files.items():
        d.coalesce(1).write.text(f"{folder}/{name}.tsv")
    got = loaders.nota_lexicons(spark, folder, frozenset())
    n = nota.Nota(taa=got.taa, keep_alef=got.keep_alef, waw_exceptions=got.waw_exceptions, off=frozenset())
    return nota.with_nota(t.select("audio_id", "transcript_cs"), "transcript_cs", "nota", n).drop("transcript_cs")


reg("n1_to_n10_all_layers_with_lexicons", f"{T} {E}", f"select audio_id, {q.nota_text('c')} as nota, {q.nota_flags()}, g <> c as negation_applied from (select audio_id, transcript_cs as c, {q.negation('transcript_cs')} as g, {_ALL} as w from {T}, {_LEX})", _all_layers)

# Code-switching.
_TABLE = {"internet": "انترنات", "weekend": "ويكاند", "mobile": "موبيل", "école": "مدرسة"}
_LW = q.latin_word("x")
_ARAB = f"case when len({q.tokens('transcript_clean')}) = 0 then transcript_clean else array_to_string(list_transform({q.tokens('transcript_clean')}, lambda x: case when {_LW} then coalesce({q.mapping(_TABLE)}[lower(x)], x) else x end), ' ') end"
_REMO = f"case when len({q.tokens('transcript_clean')}) = 0 then transcript_clean else array_to_string(list_filter({q.tokens('transcript_clean')}, lambda x: not {_LW}), ' ') end"
col("c3_process_arabize", T, "audio_id", {"t": (lambda: codeswitch.process(F.col("transcript_clean"), "arabize", _TABLE), _ARAB)})
col("c3_process_remove", T, "audio_id", {"t": (lambda: codeswitch.process(F.col("transcript_clean"), "remove"), _REMO)})
_DET = f"select audio_id, i - 1 as position, w[i] as word from (select audio_id, w, unnest(range(1, len(w) + 1)) as i from (select audio_id, {q.tokens('transcript')} as w from {T})) where {q.latin_word('w[i]')}"
_STOP = ", ".join(q.lit(w) for w in codeswitch.FRENCH_STOPWORDS)
_TAB = q.mapping(_TABLE)
reg(
    "c5_detect_code_switches",
    T,
    f"select audio_id, position, word, map_contains({_TAB}, lower(word)) as in_table, {_TAB}[lower(word)] as arabic_form, lower(word) in ({_STOP}) as is_french_stopword from ({_DET})",
    lambda t: codeswitch.detect(t, "audio_id", "transcript", t.sparkSession.createDataFrame(list(_TABLE.items()), "word string, arabic_form string")),
)
reg(
    "c6_unknown_latin_words",
    T,
    f"select lower(word) as word, count(*) as n from ({_DET}) where lower(word) not in ({', '.join(map(q.lit, _TABLE))}) group by 1 order by n desc, word limit 100",
    lambda t: codeswitch.unknown_latin_words(t, "transcript", t.sparkSession.createDataFrame([(k,) for k in _TABLE], "word string")),
)

# Audit and evaluation functions.
reg("a1_classify_char", T, f"select ch, {q.char_class('ch')} as category from (select distinct unnest(string_split(transcript, '')) as ch from {T}) where ch <> ''", lambda t: audit.char_vocab(t, "transcript").select("ch", tx.classify_char("ch").alias("category")))
col("a2_normalize_light", T, "audio_id", {"t": (lambda: tx.normalize_light(F.col("transcript")), q.light("transcript"))})
_WT = f"case when {q.has('w', r'[\x{0600}-\x{06FF}]')} then 'arabic' when {q.has('w', '^[a-zA-Z]*$')} then 'latin' else 'other' end"
reg("a4_word_type_counts", T, f"select {_WT} as kind, count(*) as n from (select unnest({q.tokens('transcript')}) as w from {T}) group by 1", lambda t: t.select(F.explode(tx.tokens("transcript")).alias("w")).groupBy(tx.word_type(F.col("w")).alias("kind")).agg(F.count("*").alias("n")))
col("a5_arabic_ratio", T, "audio_id", {"ratio": (lambda: F.round(tx.arabic_ratio(F.col("transcript")), 6), f"round(case when length(transcript) = 0 then 0.0::double else length({q.sub('transcript', r'[^\x{0600}-\x{06FF}]')})::double / length(transcript) end, 6)")})
_A6 = f"lower({q.sub('text', tx.BENCH_PUNCTUATION)})"
col("a6_remove_special_characters", D, "doc_id", {"v1": (lambda: tx.remove_special_characters(F.col("text"), False), _A6), "v2": (lambda: tx.remove_special_characters(F.col("text")), q.squeeze(_A6))})
reg("a7_words_by_pattern", T, f"select w as word, count(*) as n from (select unnest({q.tokens('transcript')}) as w from {T}) where regexp_matches(w, 'ة$') group by 1 order by n desc, word limit 100", lambda t: audit.top_k(audit.word_vocab(t, "transcript").where(F.col("word").rlike("ة$")), 100))
reg("a8_digit_transcripts", T, f"select count(*) filter ({q.has('transcript', '[0-9]')}) as n_digits from {T}", lambda t: t.agg(F.count_if(F.col("transcript").rlike("[0-9]")).alias("n_digits")))
reg("a9_format_instruction", "eval_items", "select item_id, 'Instruction: ' || text || chr(10) || 'Response: ' || answer as t from eval_items", lambda t: t.select("item_id", tx.format_instruction("text", "answer").alias("t")))
reg("a10_ctc_vocabulary", T, f"with c as (select distinct unnest(string_split(transcript, '')) as ch from {T}) select ch, row_number() over (order by hex(encode(ch))) - 1 as id from c where ch <> '' union all select s, (select count(*) from c where ch <> '') + i from (values ('[UNK]', 0), ('[PAD]', 1), ('|', 2)) v(s, i) where s <> '|' or not exists (select 1 from c where ch = '|')", lambda t: _ctc(t))
reg("a12_embed_text", E, f"select id, concat_ws(' ', {', '.join(f'nullif({f}, {q.lit("")})' for f in knowledge.EMBED)}, case when type = 'expression' then nullif(origin, '') end) as t from {E}", lambda t: t.select("id", knowledge.embed_text(t).alias("t")))


def _ctc(t: DataFrame) -> DataFrame:
    """Distinct characters (bounded by the alphabet) numbered in code point order, then the special ones."""
    c = audit.char_vocab(t, "transcript").select("ch")
    n = joins.numbered(c, ["ch"], "id").withColumn("id", F.col("id") - 1)
    s = t.sparkSession.createDataFrame([("[UNK]", 0), ("[PAD]", 1), ("|", 2)], "ch string, id int")
    total = c.agg(F.count("*")).scalar()
    return n.select("ch", F.col("id").cast("bigint")).union(s.join(c.where("ch = '|'"), "ch", "left_anti").select("ch", F.col("id") + total))


# Corpus cleaning.
col("l1_remove_emojis", D, "doc_id", {"t": (lambda: corpus.remove_emojis(F.col("text")), q.sub("text", corpus.EMOJI))})
col("l2_remove_special_patterns", D, "doc_id", {"t": (lambda: corpus.remove_special_patterns(corpus.remove_emojis(F.col("text"))), q.special("text"))})
col("l3_normalize_whitespace", D, "doc_id", {"t": (lambda: corpus.normalize_whitespace(F.col("text")), q.squeeze("text"))})
col("l4_remove_symbols", D, "doc_id", {"t": (lambda: corpus.remove_symbols(F.col("text")), q.symbols("text"))})
col("l5_clean_text", D, "doc_id", {"t": (lambda: corpus.clean_text(F.col("text")), q.squeeze(q.symbols(q.special("text"))))})
col("l6_text_lengths", D, "doc_id", {"char_length": (lambda: F.length(F.col("text")), "length(text)"), "word_count": (lambda: F.when(F.col("text").isNotNull(), F.size(tx.tokens(F.col("text")))), f"len({q.tokens('text')})")})
col("l7_l8_l9_predicates", D, "doc_id", {"latin": (lambda: corpus.has_latin_letters(F.col("text")), q.has("text", r"\p{Latin}")), "numbers": (lambda: corpus.has_numbers(F.col("text")), q.has("text", r"\p{Nd}")), "hashtag": (lambda: corpus.has_hashtag(F.col("text")), q.has("text", r"#[\p{L}\p{N}_]"))})
col("l10_repeated_chars", D, "doc_id", {"hit": (lambda: corpus.has_repeated_chars(F.col("text")), q.repeated_chars("text"))})
col("l13_script_type", D, "doc_id", {"type": (lambda: corpus.script_type(F.col("text")), q.script_type("text"))})
col("l14_dedup_key", D, "doc_id", {"k": (lambda: corpus.dedup_key(F.col("text")), q.dedup_key("text"))})

# Projections, predicates, gates.
_GATE = "case when duration_s < 0.5 then 'too_short' when duration_s > 20 then 'too_long' when rms < 0.001 then 'too_silent' when silence_ratio > 0.9 then 'mostly_silent' else 'ok' end"
reg("pr2_quality_gate", M, f"select audio_id, {_GATE} as reason from {M}", lambda t: t.select("audio_id", audio.quality_gate(F.col("duration_s"), F.col("rms"), F.col("silence_ratio")).alias("reason")))
reg("pr5_drop_unneeded", T, f"select audio_id, split, seg_start, seg_end, transcript_nota from {T}", lambda t: joins.drop_unneeded(t, columns=("transcript", "transcript_raw", "transcript_clean", "transcript_cs", "char_count", "word_count", "has_latin", "has_diacritics", "speech_rate", "seg_duration", "source", "lang", "ingested_at")))
col("pr12_segment_duration", M, "audio_id", {"seg_duration": (lambda: F.col("seg_end") - F.col("seg_start"), "seg_end - seg_start")})

# Joins and set operations.
_V = f"select w as word, count(*) as n from (select unnest({q.tokens('transcript')}) as w from {T}) group by 1"
reg("j5_semi_anti_membership", f"{T} {E}", f"with e as (select distinct unnest({q.tokens('term_arabic')}) as word from {E}) select count(*) filter (word in (select word from e)) as known, count(*) filter (word not in (select word from e)) as unknown from ({_V})", lambda t, e: audit.word_vocab(t, "transcript").join(audit.word_vocab(e, "term_arabic").select("word", F.lit(True).alias("k")), "word", "left").agg(F.count_if("k").alias("known"), F.count_if(F.col("k").isNull()).alias("unknown")))
_TT = f"(select distinct unnest({q.tokens('transcript')}) as w from {T} where {SPLIT} = "
reg("o1_out_of_vocabulary", T, f"select count(*) as test_words, count(*) filter (w not in (select w from {_TT} 'train'))) as oov_words, round(100.0::double * count(*) filter (w not in (select w from {_TT} 'train'))) / count(*), 2) as oov_pct from {_TT} 'test')", lambda t: audit.out_of_vocabulary(t.where(norm_split("split") == "train"), t.where(norm_split("split") == "test"), "transcript"))
reg("o2_union_all", f"{D} {T}", f"select text, source, 'documents' as origin from {D} union all select transcript, source, 'segments' from {T}", lambda a, b: audit.union_all(a.select("text", "source", F.lit("documents").alias("origin")), b.select(F.col("transcript").alias("text"), "source", F.lit("segments").alias("origin"))))
reg("o4_near_dedup_keep_first", D, f"select doc_id, text from (select *, row_number() over (partition by {q.dedup_key('text')} order by doc_id) as r from {D}) where r = 1", lambda t: joins.near_dedup(t.select("doc_id", "text")))
reg("o5_keep_first", M, f"select audio_id, min(ingested_at) as ingested_at from {M} group by 1", lambda t: joins.keep_first(t.select("audio_id", "ingested_at"), ["audio_id"], ["ingested_at"]))

# Aggregates.
_tok, _dia = q.tokens("transcript"), q.sub("transcript", r"[\x{064B}-\x{0652}]")
reg(
    "g1_basic_text_stats",
    T,
    f"""with r as (select length(transcript) as c, len({_tok}) as w, length(transcript) - length({_dia}) as dia, {q.has('transcript', '[a-zA-Z]')}::int as lat, len(list_filter({_tok}, lambda y: {q.has('y', '[a-zA-Z]')})) as lw, len(list_filter({_tok}, lambda y: {q.has('y', r'[\x{0600}-\x{06FF}]')})) as aw from {T} where transcript is not null)
select count(*) as n_samples, sum(c)::bigint as total_chars, round(avg(c), 2) as avg_chars, round(quantile_cont(c::double, 0.5), 2) as median_chars, max(c) as max_chars, sum(w)::bigint as total_words, round(avg(w), 2) as avg_words, round(quantile_cont(w::double, 0.5), 2) as median_words, max(w) as max_words, count(*) filter (c = 0) as empty_count, sum(dia)::bigint as diacritic_count, round(sum(dia)::double / sum(c), 4) as diacritic_ratio, round(avg(lat) * 100, 2) as has_latin_pct, sum(aw)::bigint as arabic_words, round(sum(aw)::double / sum(w) * 100, 2) as arabic_words_pct, sum(lw)::bigint as latin_words, round(sum(lw)::double / sum(w) * 100, 2) as latin_words_pct from r""",
    lambda t: audit.basic_text_stats(t, "transcript"),
)
reg("g2_char_vocab", T, f"select ch, count(*) as n from (select unnest(string_split(transcript, '')) as ch from {T}) where ch <> '' group by 1", lambda t: audit.char_vocab(t, "transcript"))
reg("g3_word_vocab", T, _V, lambda t: audit.word_vocab(t, "transcript"))
reg("g4_vocab_comparison", T, f"select count(distinct a) as before, count(distinct nullif(b, '')) as after, count(distinct a) - count(distinct nullif(b, '')) as reduction from (select a, {q.light('a')} as b from (select distinct unnest(string_split(transcript, '')) as a from {T}) where a <> '')", lambda t: audit.vocab_comparison(t, "transcript"))
_dur = "case when isnan(duration_s) then null else duration_s end"
_DS = "count({x}) as n, round(sum({x}) / 3600, 4) as hours, round(avg({x}), 3) as mean_s, round(quantile_cont({x}, 0.5), 3) as median_s, round({sd}({x}), 3) as std_s, round(min({x}), 3) as min_s, round(max({x}), 3) as max_s"
_P = ", round(quantile_cont({x}, 0.05), 3) as p05_s, round(quantile_cont({x}, 0.95), 3) as p95_s"
reg("g9_recording_durations", R, _RD, timing.recording_durations)
_SEG = f"select distinct lower(trim(audio_id)) as audio_id, seg_start, seg_end from {M} where seg_start is not null"
_GAP = f"select *, lead(seg_start) over (partition by {REC} order by seg_start, seg_end nulls first, audio_id) as nxt, {REC} as rec_id from ({_SEG})"


def _segments(m: DataFrame) -> DataFrame:
    s = m.where("seg_start is not null").select(F.lower(F.trim("audio_id")).alias("audio_id"), "seg_start", "seg_end").distinct()
    return s.withColumn("rec_id", rec_of("audio_id"))


_NEW = "case when nxt is null or seg_end is null then seg_end when nxt - seg_end < 0.2::double then nxt when nxt - seg_end > 1.0::double then seg_end + 0.3::double else seg_end + (nxt - seg_end) * 0.5::double end"
reg("g11_g12_g13_gap_stats", M, f"select count(*) as n_gaps, round(avg(g), 3) as mean_gap, round(quantile_cont(g, 0.5), 3) as median_gap, round(100 * avg((g < 0.2::double)::int), 2) as pct_short, round(100 * avg((g > 1.0::double)::int), 2) as pct_long, round(max(g), 3) as max_gap, count(*) filter (g > 60) as n_huge, round(sum(g) filter (g > 0), 2) as total_silence_s, round(sum(g), 2) as net_s from (select nxt - seg_end as g from ({_GAP})) where g is not null", lambda t: timing.gap_stats(timing.gaps(_segments(t))))
reg("g14_smoothing_summary", M, f"with s as (select seg_start, seg_end as e, {_NEW} as n from ({_GAP}) where seg_end is not null) select count(*) as n, count(*) filter (n <> e) as n_smoothed, round(100.0::double * count(*) filter (n <> e) / count(*), 2) as pct_smoothed, round(sum(e - seg_start) / 3600, 4) as hours_before, round(sum(n - seg_start) / 3600, 4) as hours_after, round(sum(n - seg_start) / 3600 - sum(e - seg_start) / 3600, 4) as hours_gained from s", lambda t: timing.smoothing_summary(timing.smooth(_segments(t))))
_K = "case when kept and not isnan({c}) then {c} end"
reg("g15_g17_drop_reasons", M, f"select drop_reason, count(*) as n from {M} where not kept group by 1", audit.drop_reasons)
_TX = "coalesce(text, '')"
reg("g18_statistics", D, f"select count(*) as n, count(distinct text) as n_unique, count(*) filter ({q.strip(_TX)} = '') as n_empty, count(*) filter ({q.has(_TX, r'\p{Nd}')}) as n_digits, round(avg(length({_TX})), 4) as avg_chars, round(avg(len({q.tokens(_TX)})), 4) as avg_words from {D}", pipelines.corpus_statistics)
reg("g19_w9_top_words", D, f"select w as word, count(*) as n from (select unnest({q.tokens('text')}) as w from {D}) group by 1 order by n desc, word limit 100", lambda t: audit.top_k(audit.word_vocab(t, "text"), 100))
_ST = ("transcript_raw", "transcript_clean", "transcript_cs", "transcript_nota")
_LONG = " union all ".join(f"select {i} as pos, '{c}' as stage, {c} as text from {T}" for i, c in enumerate(_ST))
reg("g22_vocab_per_stage", T, f"with l as ({_LONG}), c as (select pos, stage, count(distinct v) as chars from (select pos, stage, unnest(string_split(text, '')) as v from l) where v <> '' group by 1, 2), w as (select pos, count(distinct v) as words from (select pos, unnest({q.tokens('text')}) as v from l) group by 1) select stage, chars, words, chars - lag(chars) over (order by pos) as d_chars, words - lag(words) over (order by pos) as d_words from c join w using (pos)", lambda t: audit.vocab_per_stage(t, list(_ST)))
reg("g23_length_per_stage", T, f"select stage, round(avg(length(text)), 2) as mean, quantile_cont(length(text)::double, 0.5) as median, round(stddev_samp(length(text)), 2) as std, min(length(text)) as least, max(length(text)) as most, count(*) filter (text = '') as empty from ({_LONG}) where text is not null group by 1", lambda t: audit.length_per_stage(t, list(_ST)))
reg("g24_hapax", T, f"select count(*) as words, count(*) filter (n = 1) as hapax, count(*) filter (n < 5) as below_5 from ({_V})", lambda t: audit.rare_word_counts(audit.word_vocab(t, "transcript")))
_FL = ("waw", "negation", "taa", "alef", "hamza", "variant", "override")
reg("g34_histogram", M, f"with v as (select duration_s as x from {M} where duration_s is not null and not isnan(duration_s)), b as (select min(x) as lo, max(x) as hi from v) select least(floor((x - lo) / (hi - lo) * 60)::int + 1, 60) as bin, count(*) as n from v, b group by 1", lambda t: audit.histogram(t, "duration_s", 60))
reg("g36_next_id", E, f"select coalesce(max(try_cast(split_part(id, '_', 2) as int)), 0) as n from {E} where id like 'expr_%'", lambda t: knowledge.next_number(t, "expr_"))

# Windows, order, shape.
reg("w11_limit", D, f"select doc_id from {D} order by doc_id limit 500", lambda t: t.orderBy("doc_id").limit(500).select("doc_id"))


def _wide(t: DataFrame) -> DataFrame:
    """One aggregate row turned into a row per metric."""
    s = norm_split("split")
    conds = (("segments", F.lit(True)), ("latin", F.col("has_latin")), ("diacritics", F.col("has_diacritics")))
    one = t.agg(*[F.count_if(c & (s == k)).alias(f"{m}_{k}") for m, c in conds for k in ("train", "test")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_train").alias("train"), F.col(f"{m}_test").alias("test")) for m, _ in conds])).alias("x")).select("x.*")


reg("w13_wide_to_long", T, " union all ".join(f"select '{m}' as metric, count(*) filter ({c} and {SPLIT} = 'train') as train, count(*) filter ({c} and {SPLIT} = 'test') as test from {T}" for m, c in (("segments", "true"), ("latin", "has_latin"), ("diacritics", "has_diacritics"))), lambda t: _wide(t))
reg("s23_stride_sample", D, f"with n as (select greatest(1, count(*) // 100) as k from {D}) select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i from {D}), n where i % k = 0", lambda t: audit.stride_sample(t.select("doc_id"), ["doc_id"], 100))
reg("s14_s15_s16_load_all", f"{D} {T}", f"select text, 'documents' as source from {D} union all select audio_id, 'segments' from {T}", lambda a, b: audit.union_all(loaders.with_source(loaders.text_of(a.select("doc_id", "text")), "documents"), loaders.with_source(loaders.text_of(b.select("audio_id")), "segments")))
reg("s22_synthetic", D, "select 'instruction ' || i as instruction, 'response ' || i as response from range(1000) t(i)", lambda t: loaders.synthetic(t.sparkSession, 1000))
reg("k4_drop_log", T, f"select split, audio_id, 1 as phase, 'too_short' as reason, transcript_nota, coalesce(length(transcript_nota), 0) as char_len from {T} where coalesce(length(trim(transcript_nota)), 0) < 2", lambda t: sinks.drop_log(t.where(F.coalesce(F.length(tx.strip("transcript_nota")), F.lit(0)) < 2)))


# Arrays of samples.
_S = "list_sum(list_transform(embedding, lambda v: v::double * v::double))"
_PK = "list_max(list_transform(embedding, lambda v: abs(v::double)))"
col("m1_rms", "embeddings", "vec_id", {"rms": (lambda: F.round(audio.rms(F.col("embedding")), 6), f"round(sqrt({_S} / len(embedding)), 6)")})
col("m2_silence_ratio", "embeddings", "vec_id", {"s": (lambda: F.round(audio.silence_ratio(F.col("embedding")), 6), "round(len(list_filter(embedding, lambda v: abs(v::double) < 0.01::double))::double / len(embedding), 6)")})
reg("m3_segment_quality", "embeddings", f"select vec_id, round(len(embedding) / 16.0::double, 4) as duration_s, round(sqrt({_S} / len(embedding)), 6) as rms, round({_PK}, 6) as peak, round(len(list_filter(embedding, lambda v: abs(v::double) < 0.01::double))::double / len(embedding), 4) as silence_ratio, len(embedding)::int as n_samples from embeddings", lambda t: t.select("vec_id", audio.segment_quality(F.col("embedding"), F.lit(16)).alias("x")).select("vec_id", "x.*"))
reg("m4_w7_slice", "embeddings", "select vec_id, len(embedding[9:40]) as n, round(list_sum(list_transform(embedding[9:40], lambda v: v::double)), 6) as total from embeddings", lambda t: t.select("vec_id", audio.slice_segment(F.col("embedding"), F.lit(16), F.lit(0.5), F.lit(2.5)).alias("s")).select("vec_id", F.size("s").alias("n"), F.round(F.aggregate(F.col("s").cast("array<double>"), F.lit(0.0), lambda p, v: p + v), 6).alias("total")))
reg("m6_to_mono", "embeddings", "select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[2 * i - 1]::double + embedding[2 * i]::double) / 2)), 6) as total from embeddings", lambda t: t.select("vec_id", F.aggregate(audio.to_mono(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice(F.col("embedding"), i * 2 + 1, 2))), F.lit(0.0), lambda p, v: p + v).alias("t")).select("vec_id", F.round("t", 6).alias("total")))
reg("m8_peak_normalize", "embeddings", f"select vec_id, round(list_max(list_transform(embedding, lambda v: abs(v::double * 0.95::double / {_PK}))), 6) as peak, round(list_sum(list_transform(embedding, lambda v: v::double * 0.95::double / {_PK})), 6) as total from embeddings", lambda t: t.select("vec_id", audio.peak_normalize(F.col("embedding")).alias("s")).select("vec_id", F.round(audio.peak(F.col("s")), 6).alias("peak"), F.round(F.aggregate("s", F.lit(0.0), lambda p, v: p + v), 6).alias("total")))
reg("m9_pre_emphasis", "embeddings", "select vec_id, round(embedding[1]::double + list_sum(list_transform(range(2, len(embedding) + 1), lambda i: embedding[i]::double - 0.97::double * embedding[i - 1]::double)), 6) as total from embeddings", lambda t: t.select("vec_id", F.round(F.aggregate(audio.pre_emphasis(F.col("embedding")), F.lit(0.0), lambda p, v: p + v), 6).alias("total")))
reg(
    "z1_cosine_top_k",
    "embeddings",
    "with n as (select vec_id, embedding::double[] as v from embeddings), p as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) as score from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5",
    lambda t: joins.cosine_top_k(t, t.where("vec_id % 20 = 0")).withColumn("score", F.round("score", 6)),
)
reg("a11_similarity_score", T, None, lambda t: t.where("transcript is not null and transcript_nota is not null").select(norm_split("split").alias("split"), metrics.indel_ratio("transcript", "transcript_nota").alias("r")).groupBy("split").agg(F.round(F.avg("r"), 4).alias("score")))
reg("w2_smooth_array", R, f"select audio_id, list_transform(list_transform(range(1, len(segments) + 1), lambda i: case when segments[i + 1]['start'] - segments[i]['end'] is null then segments[i]['end'] when segments[i + 1]['start'] - segments[i]['end'] < 0.2::double then segments[i + 1]['start'] when segments[i + 1]['start'] - segments[i]['end'] > 1.0::double then segments[i]['end'] + 0.3::double else segments[i]['end'] + (segments[i + 1]['start'] - segments[i]['end']) * 0.5::double end), lambda e: round(e, 6)) as ends from {R} where segments is not null", lambda t: t.where("segments is not null").select("audio_id", F.transform(timing.smooth_array(F.col("segments")), lambda s: F.round(s["end"], 6)).alias("ends")))
_PROF = "select {s} as stage, type, count(*) as n, count(*) filter (digits) as n_digits from (select {k} as type, {h} as digits from {f}) group by all"
reg(
    "g21_before_after_profile",
    D,
    _PROF.format(s="'before'", k=q.script_type("text"), h=q.has("text", r"\p{Nd}"), f=D) + " union all " + _PROF.format(s="'after'", k=q.script_type("t"), h=q.has("t", r"\p{Nd}"), f=f"({_L4})"),
    lambda t: audit.union_all(t.select(F.lit("before").alias("stage"), "text"), pipelines.corpus_pipeline(t.select("doc_id", "text")).select(F.lit("after").alias("stage"), "text")).groupBy("stage", corpus.script_type(F.col("text")).alias("type")).agg(F.count("*").alias("n"), F.count_if(corpus.has_numbers(F.col("text"))).alias("n_digits")),
)
reg("s12_nested_json", R, f"select unnest(list_transform(segments, lambda s: s.transcript)) as text from {R}", lambda t: loaders.nested_json_texts(t.select(F.to_json(F.transform("segments", lambda s: F.struct(s["transcript"].alias("text")))).alias("data"))))

# Whole texts, nulls included.
col("a3_text_features", T, "audio_id", {"n_chars": (lambda: tx.text_features("transcript")["char_count"], "length(transcript)"), "n_words": (lambda: tx.text_features("transcript")["word_count"], f"len({q.tokens('transcript')})"), "latin": (lambda: tx.text_features("transcript")["has_latin"], q.has("transcript", "[a-zA-Z]")), "marks": (lambda: tx.text_features("transcript")["has_diacritics"], q.has("transcript", r"[\x{064B}-\x{0652}]"))})
col("l11_repeated_word", T, "audio_id", {"hit": (lambda: corpus.has_repeated_word(F.col("transcript")), f"case when transcript is not null then {q.repeated_word('transcript')} end")})
col("l12_dominant_word_share", D, "doc_id", {"share": (lambda: F.when(F.col("text").isNotNull(), F.round(corpus.dominant_word_share(F.col("text")), 6)), f"case when text is not null then round({q.dominant('text')}, 6) end")})
reg("l15_to_l28_cleaning_pipeline", D, f"select doc_id, t as text, length(t) as char_length, len({q.tokens('t')}) as word_count, false as has_french, 'arabic' as type from ({_L4})", lambda t: pipelines.corpus_pipeline(t.select("doc_id", "text", "source")).drop("source"))
reg("l26_blocked_keywords", D, f"select doc_id from {D} where not contains(coalesce(text, ''), 'برشا')", lambda t: reports.without_keyword(t, "text", "برشا").select("doc_id"))
reg("l24_filter_by_script_type", D, f"select doc_id from {D} where {q.script_type('text')} = 'mixed'", lambda t: reports.of_script(t.withColumn("type", corpus.script_type(F.col("text"))), "mixed").select("doc_id"))
# DuckDB has no such hash order; it can say that every row comes back once.
reg("l27_shuffle", D, f"select doc_id, 1::bigint as times from {D}", lambda t: audit.shuffled(t.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("times")))


def _membership(sample: DataFrame, of: DataFrame) -> DataFrame:
    known = of.select("doc_id", F.lit(1).alias("k")).distinct()
    return sample.join(known, "doc_id", "left").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("distinct_rows"), F.count("k").alias("known"))


reg("w12_hash_sample", D, f"select least(100, count(*)) as rows, least(100, count(*)) as distinct_rows, least(100, count(*)) as known from {D}", lambda t: _membership(audit.hash_sample(t.select("doc_id"), "doc_id", 100), t))

# Gates and reports.
reg("pr1_text_pipeline_kept", T, f"select {SPLIT} as split, count(*) as n, count(*) filter (length(trim(transcript_nota)) >= 2) as n_kept from {T} group by 1", reports.kept_by_length)
reg("k7_phase_summary", T, f"select {SPLIT} as split, count(*) as n_in, count(*) filter (length(trim(transcript_nota)) >= 2) as n_kept, round(100.0::double * count(*) filter (length(trim(transcript_nota)) >= 2) / count(*), 2) as pct from {T} group by 1", reports.phase_summary)
_STEPS = (("transcript", "transcript_clean", "n_clean"), ("transcript_clean", "transcript_cs", "n_cs"), ("transcript_cs", "transcript_nota", "n_nota"))
reg("pr8_changed_rows", T, "select " + ", ".join(f"count(*) filter ({a} is distinct from {b}) as {n}" for a, b, n in _STEPS) + f" from {T}", lambda t: reports.changed_rows(t, _STEPS))
reg("pr10_length_cap", D, f"select doc_id, least(length(text), greatest(5, (select quantile_cont(length(text)::double, 0.99) from {D})::bigint)) as capped from {D} where text is not null", lambda t: reports.length_cap(t, "doc_id", "text"))
_NW2 = f"len({q.tokens('transcript')})"
col("pr11_speech_rate", T, "audio_id", {"rate": (lambda: reports.speech_rate(F.size(tx.tokens("transcript")), F.col("seg_start"), F.col("seg_end")), f"round(case when seg_end - seg_start < 1 then {_NW2} else {_NW2} / nullif(seg_end - seg_start, 0) end, 4)")}, "transcript is not null")
_WARN = ("'Missing required columns: audio'", "case when count(*) filter (text is null) > 0 then count(*) filter (text is null) || ' null transcripts' end", "case when count(*) filter (trim(text) = '') > 0 then count(*) filter (trim(text) = '') || ' empty transcripts' end", "case when count(*) filter (duration_s <= 0) > 0 then count(*) filter (duration_s <= 0) || ' segments with duration <= 0' end")
reg(
    "pr13_validate_dataset",
    f"{M} {T}",
    f"select split, concat_ws('; ', {', '.join(_WARN)}) as warnings from (select split, text, duration_s from {SEGMENTS} m join {TEXTS} t using (audio_id) where kept) group by 1",
    lambda m, t: reports.dataset_warnings(joins.build_dataset(m, t)).select("split", F.array_join("warnings", "; ").alias("warnings")),
)
_FIELDS = ("id", "type", "term_arabic", "term_arabizi", "meaning", "example", "usage_context", "region", "register", "generation", "scripts", "source", "last_updated", "severity", "gender_sensitive")
_REQ = " + ".join(f"({f} is null)::int" for f in _FIELDS)
_UNKNOWN = "'Unknown type: ' || coalesce(type, 'UNKNOWN') || '. Must be ''expression'' or ''proverb'''"
reg("pr14_validate_entries", E, f"select id, case when type = 'expression' then {_REQ} else 1 end as n_errors from {E}", lambda t: knowledge.validate(t).select("id", F.size("errors").alias("n_errors")))
reg("pr14_unknown_type", "code_switching", f"select id, false as valid, {_UNKNOWN} as error from code_switching", lambda t: knowledge.validate(t).select("id", "valid", F.col("errors")[0].alias("error")))
# Entries as JSON texts: some with a number for a text, a text for a list, or broken.
_SAID = ", ".join(f"case when {f} is null then '{f}: missing'" + {"scripts": " when k = 2 then 'scripts: wrong type'", "severity": " when k = 1 then 'severity: wrong type'"}.get(f, "") + " end" for f in _FIELDS)
reg(
    "pr14_s18_entries_of_json",
    E,
    f"select case when k = 3 then 'FILE' else coalesce(id, 'UNKNOWN') end as id, case when k = 3 then 'Invalid JSON' when type <> 'expression' then {_UNKNOWN} else concat_ws('; ', {_SAID}) end as errors from (select *, length(meaning) % 7 as k from {E})",
    lambda t: knowledge.validate_json(_as_json(t)).select("id", F.array_join("errors", "; ").alias("errors")),
)


def _as_json(t: DataFrame) -> DataFrame:
    k = F.length("meaning") % 7
    whole = F.to_json(F.struct(*t.columns))
    number = F.to_json(F.struct(*[F.when(F.col("severity").isNotNull(), F.lit(3)).alias(c) if c == "severity" else F.col(c) for c in t.columns]))
    listed = F.to_json(F.struct(*[F.array_join("scripts", ",").alias(c) if c == "scripts" else F.col(c) for c in t.columns]))
    return t.select(F.when(k == 1, number).when(k == 2, listed).when(k == 3, F.lit("{broken")).otherwise(whole).alias("entry"))


_PT = dict.fromkeys(("audio_id", "transcript", "split", "drop_reason"), "string") | dict.fromkeys(("seg_start", "seg_end", "duration_s", "rms", "peak", "silence_ratio"), "double") | dict.fromkeys(("kept", "smoothing_applied"), "boolean") | {"sample_rate": "int", "ingested_at": "timestamp"}
reg("pr15_profile", M, " union all ".join(f"select '{c}' as \"column\", '{k}' as type, count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", round(100.0::double * (count(*) - count({c})) / nullif(count(*), 0), 2) as null_pct from {M}" for c, k in _PT.items()), audit.profile)

# Joins by the segment id.
reg("j1_build_dataset", f"{M} {T}", f"select audio_id, split, duration_s, seg_start, seg_end, text from {SEGMENTS} m join {TEXTS} t using (audio_id) where kept", lambda m, t: joins.build_dataset(m, t).select("audio_id", "split", "duration_s", "seg_start", "seg_end", "text"))


def _waves(m: DataFrame, e: DataFrame) -> DataFrame:
    """Waveforms of the manifest's segments, for which vectors stand in."""
    one = joins.one_per_segment(m).select("audio_id", "sample_rate").withColumn("vec_id", F.length("audio_id").cast("bigint") * 7 % 60)
    return one.join(e.select("vec_id", F.col("embedding").alias("waveform")), "vec_id")


reg(
    "j1_p6_build_dataset_with_waveforms",
    f"{M} {T} embeddings",
    f"select audio_id, split, text, len(embedding) as n_samples, round(list_sum(list_transform(embedding, lambda v: v::double)), 5) as total, sample_rate as sampling_rate from {SEGMENTS} m join {TEXTS} t using (audio_id) join embeddings e on e.vec_id = length(audio_id) * 7 % 60 where kept",
    lambda m, t, e: joins.build_dataset(m, t, _waves(m, e)).select("audio_id", "split", "text", F.size("audio.array").alias("n_samples"), F.round(F.aggregate(F.col("audio.array").cast("array<double>"), F.lit(0.0), lambda p, v: p + v), 5).alias("total"), "audio.sampling_rate"),
)
reg("j2_recording_lookup", f"{M} {R}", f"select {KEY} as audio_id, r.k is not null as found, case when r.k is null then 'recording_not_found' end as drop_reason from {M} m left join (select distinct {KEY} as k from {R}) r on {REC.replace('audio_id', 'lower(trim(m.audio_id))')} = r.k".replace(f"select {KEY} as audio_id", "select lower(trim(m.audio_id)) as audio_id"), lambda m, r: joins.with_recording(m.select(norm_key("audio_id").alias("audio_id")).withColumn("rec_id", rec_of("audio_id")), r).drop("rec_id"))
col("a14_recording_id", M, "audio_id", {"rec": (lambda: rec_of(norm_key("audio_id")), REC.replace("audio_id", KEY))})
reg("j6_positional_zip", "eval_items", "select a.line, a.task as \"left\", b.answer as \"right\" from (select task, row_number() over (order by item_id) - 1 as line from eval_items) a join (select answer, row_number() over (order by item_id) - 1 as line from eval_items where item_id % 3 > 0) b using (line)", lambda t: joins.positional_zip(t.select("item_id", F.col("task").alias("value")), t.where("item_id % 3 > 0").select("item_id", F.col("answer").alias("value")), "item_id"))
_V5 = f"select * from (select w as word, count(*) as n from (select unnest({q.tokens('lower(text)')}) as w from {D}) group by 1) where length(word) = 5 and n >= 5"
# Words of one length that are one edit apart differ in one place.
_ONE_OFF = f"with v as ({_V5}), k as (select word, n, i, word[:i - 1] || chr(1) || word[i + 1:] as k from v, range(1, 6) t(i)) select a.word as a, b.word as b, 1 as dist, a.n + b.n as n from k a join k b on a.i = b.i and a.k = b.k and a.word < b.word"
reg("j7_similar_words", D, f"{_ONE_OFF} order by n desc, a, b limit 100", lambda t: joins.similar_word_report(audit.word_vocab(t.select(F.lower("text").alias("text")), "text"), 5, 1, 5))
reg("j7_similar_words_all", D, _ONE_OFF, lambda t: joins.similar_words(audit.word_vocab(t.select(F.lower("text").alias("text")), "text"), 5, 1, 5))
reg("o3_exact_dedup", M, f"select distinct {', '.join(_PT)} from {M}", lambda t: t.dropDuplicates())

# Statistics.
reg("g5_categorize_vocab", T, f"select {q.char_class('ch')} as category, string_agg(ch, '' order by hex(encode(ch))) as chars, count(*) as n_chars, sum(n)::bigint as n from (select ch, count(*) as n from (select unnest(string_split(transcript, '')) as ch from {T}) where ch <> '' group by 1) group by 1", lambda t: audit.categorize_vocab(t, "transcript"))
reg("g6_code_switch_ratio", T, f"select round(avg({q.has('transcript', '[a-zA-Z]')}::int), 6) as segments, round(sum(len(list_filter({_tok}, lambda y: {q.has('y', '[a-zA-Z]')})))::double / sum(len({_tok})), 6) as words from {T} where transcript is not null", lambda t: reports.code_switch_ratio(t, "transcript"))
reg("g7_segment_duration_stats", M, f"select {(_DS + _P).format(x='x', sd='stddev_samp')} from (select {_dur} as x from {M})", lambda t: audit.duration_stats(t, F.col("duration_s")))
reg("g8_recording_duration_stats", R, f"select {_DS.format(x='duration_s', sd='stddev_pop')} from ({_RD})", lambda t: audit.duration_stats(timing.recording_durations(t), F.col("duration_s"), None, True, False))
reg("g10_sample_rates", M, f"select sample_rate, count(*) as n from {M} group by 1", reports.sample_rates)
reg(
    "g15_corpus_stats",
    M,
    f"select count(*) as n_total, count(*) filter (kept) as n_kept, round(100.0::double * count(*) filter (kept) / count(*), 2) as pct_kept, round(sum(x) / 3600, 4) as total_hours_kept, round(avg(x), 3) as mean_duration_s, round(quantile_cont(x, 0.5), 3) as median_duration_s, round(stddev_samp(x), 3) as std_duration_s, round(min(x), 3) as min_duration_s, round(max(x), 3) as max_duration_s, round(avg(r), 6) as mean_rms, count(*) - count(*) filter (kept) as n_dropped, (select string_agg(k || '=' || n, ', ' order by k) from (select coalesce(drop_reason, '') as k, count(*) as n from {M} where not kept group by 1)) as drop_reasons from (select kept, {_K.format(c='duration_s')} as x, {_K.format(c='rms')} as r from {M})",
    audit.corpus_stats,
)
reg("g16_final_stats", M, f"select split, count(*) as n_segments, round(sum(x) / 3600, 4) as total_hours, round(avg(x), 3) as mean_s, round(quantile_cont(x, 0.5), 3) as median_s, min(x) as min_s, max(x) as max_s from (select {SPLIT} as split, {_dur} as x from {M} where kept) group by 1", reports.final_stats)
_CN = {"total": "true", "with_latin": q.has("transcript_clean", "[a-zA-Z]"), "changed": "transcript_clean is distinct from transcript_cs", "remaining": q.has("transcript_cs", "[a-zA-Z]")}
reg(
    "g25_code_switch_summary",
    T,
    " union all ".join(f"select '{m}' as metric, " + ", ".join(f"count(*) filter ({c} and {SPLIT} = '{k}') as {k}, round(100.0::double * count(*) filter ({c} and {SPLIT} = '{k}') / count(*) filter ({SPLIT} = '{k}'), 4) as {k}_pct" for k in ("train", "test")) + f" from {T}" for m, c in _CN.items()),
    reports.code_switch_summary,
)
reg("g26_pr9_rule_impact", T, "select " + ", ".join(f"count(*) filter (coalesce({k}_applied, false)) as {k}" for k in _FL) + f" from {T}", lambda t: reports.rule_impact(t, _FL))
reg("g27_segments_per_recording", R, f"select min(n) as least, max(n) as most, round(avg(n), 4) as mean, count(*) filter (n = 1) as single from (select coalesce(len(segments), 0) as n from {R})", reports.segments_per_recording)
reg("g28_describe", M, f"select count(x) as n, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, min(x) as least, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2, quantile_cont(x, 0.75) as q3, max(x) as most from (select peak as x from {M} where not isnan(peak))", lambda t: reports.describe(t, F.col("peak")))
_PAIRS = f"(select distinct audio_id, transcript_nota as x, transcript_raw as y from {T} where transcript_nota is not null and transcript_raw is not null)"


def _rate_sql(split) -> str:
    """Words, or characters, of a pair as signs of one byte each, as ``levenshtein`` counts bytes;
    no pair of the test tables has more than 127 different ones."""
    signs = "array_to_string(list_transform({x}, lambda t: chr(list_position(u, t)::int)), '')"
    return f"with s as (select *, list_distinct(list_concat(a, b)) as u from (select {split('x')} as a, {split('y')} as b from {_PAIRS})), e as (select len(a) as n, levenshtein({signs.format(x='a')}, {signs.format(x='b')}) as e from s) select count(*) as n, sum(e)::bigint as edits, sum(n)::bigint as units, round(sum(e)::double / sum(n), 6) as rate from e"


reg("g29_wer", T, _rate_sql(q.tokens), lambda t: metrics.corpus_error_rate(t.select("audio_id", "transcript_nota", "transcript_raw").distinct(), "transcript_nota", "transcript_raw"))
reg("g29_cer", T, _rate_sql(lambda c: f"list_filter(string_split({c}, ''), lambda y: y <> '')"), lambda t: metrics.corpus_error_rate(t.select("audio_id", "transcript_nota", "transcript_raw").distinct(), "transcript_nota", "transcript_raw", "character"))
reg("g30_mean_arabic_ratio", T, f"select round(avg(case when length(transcript_nota) = 0 then 0.0::double else length({q.sub('transcript_nota', r'[^\x{0600}-\x{06FF}]')})::double / length(transcript_nota) end), 6) as ratio from {T}", lambda t: reports.mean_arabic_ratio(t, "transcript_nota"))
_WALL = "(max(epoch(ts) + value) - min(epoch(ts)))"
reg(
    "g31_latency",
    "events",
    f"select round(sum(value), 2) as total, round(avg(value), 4) as mean, round({_WALL}, 4) as wall, round({_WALL} / sum(event_id % 30), 4) as rtf, quantile_cont(value, 0.5) as median from events",
    lambda t: reports.latency(t.select("value", (F.col("event_id") % 30).cast("double").alias("audio_s"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("b")).withColumn("e", F.col("b") + F.col("value")), "value", "audio_s", "b", "e"),
)
reg("g32_corpus_hours", M, f"select round(sum(x) / 3600, 4) as hours from (select {_dur} as x from {M})", reports.corpus_hours)
reg("g33_split_share", M, f"select split, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct from (select {SPLIT} as split from {M}) group by 1", reports.split_share)
reg("g38_distinct_recordings", M, f"select count(distinct {REC.replace('audio_id', 'lower(trim(audio_id))')}) as n from {M}", reports.distinct_recordings)
reg("g20_count_tokens", D, f"select sum(len({q.tokens('text')}))::bigint as n from {D}", reports.count_tokens)
reg("g20_count_characters", D, f"select sum(len(list_filter(string_split(text, ''), lambda y: y <> '')))::bigint as n from {D}", lambda t: reports.count_tokens(t, "text", lambda c: F.filter(F.split(c, ""), lambda y: y != "")))

# Shapes and order.
reg("w4_w6_explode_segments", R, f"select rec_id || '_' || (i - 1) as audio_id, rec_id, (i - 1)::int as seg_idx, s[i].st as seg_start, s[i].en as seg_end, s[i].tr as transcript, s[i].ra as transcript_raw, speaker_id, source from (select rec_id, speaker_id, source, s, unnest(range(1, len(s) + 1)) as i from (select audio_id as rec_id, speaker_id, source, list_sort(list_transform(segments, lambda y: {{'st': coalesce(y['start'], 0), 'en': coalesce(y['end'], 0), 'tr': y.transcript, 'ra': coalesce(y.transcript_raw, y.transcript)}})) as s from {R}))", lambda t: timing.explode_segments(t, carry=("speaker_id", "source")))
reg("w6_skipped_recordings", R, f"select count(*) as n_recordings, count(*) filter (coalesce(len(segments), 0) = 0) as n_skipped from {R}", timing.skipped_recordings)
reg("w1_segment_gaps", M, f"select audio_id, nxt - seg_end as gap from ({_GAP})", lambda t: timing.gaps(_segments(t)).select("audio_id", "gap"))
reg("w3_gap_smoothing", M, f"select audio_id, {_NEW} as seg_end, coalesce({_NEW} <> seg_end, false) as smoothing_applied from ({_GAP})", lambda t: timing.smooth(_segments(t)).select("audio_id", "seg_end", "smoothing_applied"))
_NEXT = f"(select coalesce(max(try_cast(split_part(id, '_', 2) as int)), 0) as n from {E} where id like 'expr_%')"
_NTH = "'expr_' || lpad((row_number() over (order by {k}) + n)::varchar, greatest(3, length((row_number() over (order by {k}) + n)::varchar))::int, '0')"
reg("w5_sequential_ids", f"code_switching {E}", f"select id as old, {_NTH.format(k='id')} as id from code_switching, {_NEXT}", lambda c, e: knowledge.assign_ids(c.select(F.col("id").alias("old"), F.lit(None).cast("string").alias("id")), e, "expression", "old").select("old", "id"))
reg("w5_ids_of_four_digits", f"{D} {E}", f"select doc_id as old, {_NTH.format(k='doc_id')} as id from {D}, {_NEXT}", lambda d, e: knowledge.assign_ids(d.select(F.col("doc_id").alias("old"), F.lit("temp_").alias("id")), e, "expression", "old").select("old", "id"))


def _sorted(t: DataFrame) -> DataFrame:
    """The sorted lexicon with the line on which each row stands."""
    d = loaders.sorted_lexicon(t.where("term_arabic is not null").select(F.lit(0).alias("ord"), F.col("term_arabic").alias("k"), F.col("meaning").alias("v")))
    rows = [(i, r["k"], r["v"]) for i, r in enumerate(d.collect())]  # a lexicon is a small file
    return t.sparkSession.createDataFrame(rows, "line bigint, k string, v string")


reg("k14_sorted_lexicon", E, f"select k, v, row_number() over (order by lower(k), k, v nulls first) - 1 as line from (select distinct term_arabic as k, meaning as v from {E} where term_arabic is not null)", _sorted)

# Pipelines.
_FLAGSHIP = f"(select split, audio_id, {q.clean('transcript')} as c from {T})"
_NG = f"(select split, audio_id, c, {q.negation('c')} as g, {q.nota_words(q.negation('c'))} as w from {_FLAGSHIP})"
reg(
    "text_pipeline",
    T,
    f"select split, audio_id, {q.nota_text('c')} as nota, {q.nota_flags()}, g <> c as negation_applied, coalesce(length(trim({q.nota_text('c')})) >= 2, false) as kept from {_NG}",
    lambda t: pipelines.text_pipeline(t.select("audio_id", "split", "transcript")).select("split", "audio_id", F.col("transcript_nota").alias("nota"), *[f"{k}_applied" for k in nota.LAYERS], "kept"),
)

# Waveforms.
_16 = "least(greatest(round_even(v::double * 32768, 0), -32768), 32767) / 32768"


def _total(samples: str):
    return F.round(F.aggregate(F.col(samples).cast("array<double>"), F.lit(0.0), lambda p, v: p + v), 6).alias("total")


def _rounded(t: DataFrame) -> DataFrame:
    a, b = (F.col("vec_id") % 7).cast("double") / 10, (F.col("vec_id") % 7 + F.col("vec_id") % 5).cast("double") / 10 + 1 / 16
    return t.select("vec_id", audio.slice_segment(F.col("embedding"), F.lit(16), a, b, True).alias("s")).select("vec_id", F.size("s").alias("n"), _total("s"))


def _decoded(t: DataFrame) -> DataFrame:
    return t.select("vec_id", audio.decoded("b").alias("x")).select("vec_id", F.size("x.samples").alias("n"), _total("x.samples"))


def _wav(channels=1):
    return audio.encoded(F.col("embedding"), F.lit(16), F.lit(channels) if isinstance(channels, int) else channels)


def _trimmed(t: DataFrame) -> DataFrame:
    """Each vector, ten times over, between two stretches of silence; the sound must stay whole."""
    quiet = F.array_repeat(F.lit(0.0), 4000).cast("array<float>")
    d = t.select("vec_id", F.concat(quiet, F.flatten(F.array_repeat("embedding", 10)), quiet).alias("x"))
    y = d.select("vec_id", F.size("x").alias("n"), audio.preprocess(16, True, False, False)(F.col("x"), F.lit(16)).alias("y"))
    return y.select("vec_id", (F.size("y") < F.col("n")).alias("shorter"), (F.size("y") >= 640).alias("whole"))


def _cut(t: DataFrame) -> DataFrame:
    """Vectors written as WAV bytes at 16 samples a second and cut into two segments each."""
    rec = t.select(F.col("vec_id").cast("string").alias("rec_id"), _wav().alias("bytes"))
    seg = rec.select("rec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(F.concat_ws("_", "rec_id", F.col("i").cast("string")).alias("audio_id"), "rec_id", (F.col("i") * 2.0).alias("seg_start"), (F.col("i") * 2.0 + 1.5).alias("seg_end"))
    return waveforms.extract_segments(rec, seg, 16).select("audio_id", "rec_id", F.size("waveform").alias("n"), "sample_rate", "duration_s", F.round("peak", 4).alias("peak"), "kept", "drop_reason")


reg("pr4_valid_audio", "embeddings", "select vec_id, vec_id % 4 > 1 as ok from embeddings", lambda t: t.select("vec_id", audio.is_valid(F.when(F.col("vec_id") % 4 == 0, F.lit(None)).when(F.col("vec_id") % 4 == 1, F.array().cast("array<float>")).otherwise(F.col("embedding")), F.lit(16)).alias("ok")))
reg("w8_segment_audio_rounded", "embeddings", "select vec_id, e - s as n, round(coalesce(list_sum(list_transform(embedding[s + 1:e], lambda v: v::double)), 0), 6) as total from (select vec_id, embedding, round_even((vec_id % 7)::double / 10 * 16, 0)::int as s, least(64, round_even(((vec_id % 7 + vec_id % 5)::double / 10 + 1 / 16) * 16, 0))::int as e from embeddings)", _rounded)
reg("m5_extract_slice", "embeddings", f"select vec_id, len(embedding[9:40]) as n, round(list_sum(list_transform(embedding[9:40], lambda v: {_16})), 6) as total from embeddings", lambda t: _decoded(t.select("vec_id", audio.sliced(_wav(), F.lit(0.5), F.lit(2.5)).alias("b"))))
reg("s6_s21_decode_audio", "embeddings", f"select vec_id, case when vec_id % 5 = 0 then 0 else len(embedding) end as n, case when vec_id % 5 = 0 then 0.0::double else round(list_sum(list_transform(embedding, lambda v: {_16})), 6) end as total from embeddings", lambda t: _decoded(t.select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.unhex(F.lit(""))).otherwise(_wav()).alias("b"))))
reg("g35_channel_census", "embeddings", "select case when vec_id % 3 = 0 then 'invalid' when vec_id % 3 = 1 then 'mono' else 'multi' end as kind, count(*) as n from embeddings group by 1", lambda t: waveforms.channel_census(waveforms.wav_info(t.select("vec_id", F.when(F.col("vec_id") % 3 > 0, _wav(F.greatest(F.col("vec_id") % 3, F.lit(1)).cast("int"))).alias("b")), "vec_id", "b")))
reg("m7_resample", "embeddings", "select vec_id, 128 as n from embeddings", lambda t: t.select("vec_id", F.size(audio.preprocess(32, False, False, False)(F.col("embedding"), F.lit(16))).alias("n")))
reg("m10_trim_silence", "embeddings", "select vec_id, true as shorter, true as whole from embeddings", _trimmed)
reg("m11_full_preprocess", "embeddings", f"select vec_id, 64 as n, round(abs(embedding[1]::double) * 0.95::double / {_PK}, 5) as first from embeddings", lambda t: t.select("vec_id", audio.preprocess(16)(F.col("embedding"), F.lit(16)).alias("y")).select("vec_id", F.size("y").alias("n"), F.round(F.abs(F.col("y")[0].cast("double")), 5).alias("first")))
reg("m12_extract_segments", "embeddings", "select vec_id || '_' || i as audio_id, vec_id::varchar as rec_id, 24 as n, 16 as sample_rate, 1.5::double as duration_s, 0.95::double as peak, true as kept, 'ok' as drop_reason from embeddings, (values (0), (1)) t(i)", _cut)
