"""Frequency of every distinct term: global integer dictionary, encoded terms,
blockwise count arrays, sums of arrays by identifier range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, norm_key

#: Identifiers per count array; terms of a chunk of texts (a longer text is a chunk of its own); counts that a
#: task holds before it adds up equal identifiers; groups of mappers whose arrays are summed first.
BLOCK, CHUNK_TERMS, HELD, FAN = 4096, 200_000, 2_000_000, 64


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in chunks: their terms in order as codes of the chunk's own list of terms, and where each text ends."""
    number = TaskContext.get().partitionId() << 32
    local: dict[str, int] = {}
    codes: list[int] = []
    ends: list[int] = []

    def out() -> pd.DataFrame:
        return pd.DataFrame({"chunk": [number], "terms": [list(local)], "codes": [np.array(codes, np.int32).tobytes()], "ends": [np.array(ends, np.int64).tobytes()]})

    for pdf in batches:
        for text in pdf["text"]:
            codes += [local.setdefault(t, len(local)) for t in text.lower().split()]
            ends.append(len(codes))
            if len(codes) >= CHUNK_TERMS:
                yield out()
                number += 1
                local, codes, ends = {}, [], []
    if ends:
        yield out()


class _Arrays:
    """Occurrences and records by identifier, added up."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> None:
        self.held.append(np.stack([ids, occurrences, records]))
        self.n += len(ids)
        if self.n >= HELD:
            self.compact()

    def compact(self) -> None:
        if self.held:
            a = np.concatenate(self.held, 1)
            ids, at = np.unique(a[0], return_inverse=True)
            out = np.zeros((3, len(ids)), np.int64)
            out[0] = ids
            np.add.at(out[1], at, a[1])
            np.add.at(out[2], at, a[2])
            self.held, self.n = [out], 0 if len(ids) >= HELD else len(ids)

    def blocks(self) -> Iterator[pd.DataFrame]:
        """Rows ``(block, slots, occurrences, records)``: the arrays of each range of ``BLOCK`` identifiers,
        without the slots that count nothing."""
        self.compact()
        if not self.held:
            return
        ids, occurrences, records = self.held[0]
        block = ids // BLOCK
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for lo in range(0, len(cut), 1000):
            part = cut[lo : lo + 1000]
            ends = np.append(cut[lo + 1 : lo + 1000], cut[lo + 1000] if lo + 1000 < len(cut) else len(ids))
            yield pd.DataFrame({
                "mapper": TaskContext.get().partitionId(),
                "block": block[part],
                "slots": [(ids[a:b] % BLOCK).astype(np.int32) for a, b in zip(part, ends, strict=True)],
                "occurrences": [occurrences[a:b] for a, b in zip(part, ends, strict=True)],
                "records": [records[a:b] for a, b in zip(part, ends, strict=True)],
            })


_BLOCKS = "mapper int, block bigint, slots array<int>, occurrences array<bigint>, records array<bigint>"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's codes become global identifiers; the task's arrays leave at its end."""
    arrays = _Arrays()
    for pdf in batches:
        for at, ids, codes, ends in zip(pdf["at"], pdf["ids"], pdf["codes"], pdf["ends"], strict=True):
            of = np.empty(len(ids), np.int64)
            of[np.asarray(at)] = np.asarray(ids)
            c, e = np.frombuffer(codes, np.int32).astype(np.int64), np.frombuffer(ends, np.int64)
            text = np.repeat(np.arange(len(e)), np.diff(e, prepend=0))
            once = np.unique(text * len(of) + c) % len(of)
            arrays.add(of, np.bincount(c, minlength=len(of)), np.bincount(once, minlength=len(of)))
    yield from arrays.blocks()


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    arrays = _Arrays()
    for pdf in batches:
        if len(pdf):
            base = np.repeat(pdf["block"].to_numpy(np.int64) * BLOCK, pdf["slots"].map(len))
            arrays.add(base + np.concatenate(pdf["slots"].to_list()), np.concatenate(pdf["occurrences"].to_list()), np.concatenate(pdf["records"].to_list()))
    yield from arrays.blocks()


def term_counts(records: DataFrame, min_records: int = 3, max_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``(terms, blocks)`` for ``records (id, text)``.

    ``terms``: ``(term, term_id, occurrences, records, share, mark)`` of every
    distinct term; ``mark`` is ``rare`` below ``min_records`` records, ``common``
    above the share ``max_share`` of all records that have a term, else null.
    ``blocks``: ``(block, slots, occurrences, records)``, arrays by identifier range.

    Texts become chunks of local codes; the distinct terms of all chunks become the global
    dictionary (dense identifiers within each partition's range); each chunk gets the
    identifiers of its own terms by a join with the dictionary, and its texts are encoded by
    them. A task adds its chunks up in arrays by ranges of ``BLOCK`` identifiers; arrays
    of one range are summed over ``FAN`` groups of tasks, then over the groups. A term in every
    text is one row a chunk in the join and one number a task after it; no occurrence is shuffled.
    Chunks and dictionary are tables in the shared folder.

    A term is a run of non-white characters in lower case. Rows of one id count
    once (the greatest text, should they differ); null ids, null and blank texts
    have no term; an empty table gives no term."""
    one = records.where("id is not null and text is not null").groupBy("id").agg(F.max("text").alias("text")).where(F.col("text").rlike(r"[^\s\x{1C}-\x{1F}\x{85}\p{Z}]"))
    chunks = materialize(one.select("text").mapInPandas(_chunks, "chunk bigint, terms array<string>, codes binary, ends binary"), "terms-chunks")
    total = chunks.agg(F.sum(F.octet_length("ends") / 8).cast("bigint")).scalar()
    dictionary = materialize(chunks.select(F.explode("terms").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms-dictionary")
    own = chunks.select("chunk", F.posexplode("terms").alias("at", "term")).join(dictionary, "term").groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("term_id").alias("ids"))
    counted = chunks.select("chunk", "codes", "ends").join(own, "chunk").select("at", "ids", "codes", "ends").mapInPandas(_count, _BLOCKS)
    some = counted.repartition("block", F.col("mapper") % FAN).mapInPandas(_sum, _BLOCKS)
    blocks = some.repartition("block").mapInPandas(_sum, _BLOCKS).drop("mapper")
    flat = blocks.select("block", F.explode(F.arrays_zip("slots", "occurrences", "records")).alias("x"))
    counts = flat.select((F.col("block") * BLOCK + F.col("x.slots")).alias("term_id"), F.col("x.occurrences").alias("occurrences"), F.col("x.records").alias("records"))
    share = F.col("records") / total
    mark = F.when(F.col("records") < min_records, F.lit("rare")).when(F.col("records") > total * F.lit(max_share), F.lit("common"))
    terms = dictionary.join(counts, "term_id").select("term", "term_id", "occurrences", "records", share.alias("share"), mark.alias("mark"))
    return terms, blocks


def _records(df: DataFrame) -> DataFrame:
    return df.select(norm_key("audio_id").alias("id"), F.col("transcript_nota").alias("text"))


def found(df: DataFrame) -> DataFrame:
    """``(term, mark)`` of the marked terms. A term can be both rare and common only in
    a table of fewer than 30 records; it then counts as rare."""
    return term_counts(_records(df))[0].where("mark is not null").select("term", "mark")


def counts(df: DataFrame) -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term."""
    return term_counts(_records(df))[0].select("term", "occurrences", "records")
