"""Chunks for an index: packing under a length, context sentences and embedding inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, OVERLAP, TAIL = 1200, 150, 120
_SENTENCE = re.compile(r"(?<=[.;:])\s+(?=[A-Z(])|\n")


def packed(text: str, longest: int = LONGEST, overlap: int = OVERLAP, tail: int = TAIL) -> list[str]:
    """Pieces of a text: paragraphs, else sentences, else words, packed as long as they fit.

    Each piece but the first opens with the end of the one before it, from a word start. A last piece
    with less than ``tail`` new characters is added to the one before, which may then be longer."""
    text = text.strip()
    if len(text) <= longest:
        return [text] if text else []
    parts: list[tuple[str, str]] = []  # (what divides it from the part before, part)
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        fresh = "\n\n"
        for sentence in [paragraph] if len(paragraph) <= longest else filter(None, (s.strip() for s in _SENTENCE.split(paragraph))):
            if len(sentence) <= longest - overlap - 2:
                parts.append((fresh, sentence))
                fresh = " "
                continue
            for word in sentence.split():
                while word:
                    parts.append((fresh, word[: longest - overlap - 2]))
                    word, fresh = word[longest - overlap - 2 :], " " if len(word) <= longest - overlap - 2 else ""
    pieces: list[str] = []
    here, own = "", 0
    for gap, part in parts:
        if here and len(here) + len(gap) + len(part) > longest:
            pieces.append(here)
            back = here[-overlap:] if overlap else ""
            back = back[back.find(" ") + 1 :] if " " in back and len(here) > overlap else back
            here, own = (f"{back} {part}" if back and len(back) + 1 + len(part) <= longest else part), len(part)
        else:
            here, own = here + (gap if here else "") + part, own + len(part)
    if pieces and own < tail:
        pieces[-1] = f"{pieces[-1]} {here[len(here) - own :]}"
    else:
        pieces.append(here)
    return pieces


def pack_sections(sections: DataFrame, longest: int = LONGEST, overlap: int = OVERLAP, tail: int = TAIL) -> DataFrame:
    """section_uid, doc_id, ordinal, text: the pieces of every section where it is read. Null and blank
    texts have none; short ones never leave the JVM."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([packed(t, longest, overlap, tail) for t in batch])

    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = sections.where("section_uid IS NOT NULL AND text IS NOT NULL").select("section_uid", "doc_id", body.alias("text")).where("text <> ''")
    short = rows.where(F.length("text") <= longest).select("section_uid", "doc_id", F.lit(0).alias("ordinal"), "text")
    return short.unionByName(rows.where(F.length("text") > longest).select("section_uid", "doc_id", F.posexplode(cut("text")).alias("ordinal", "text")))


def with_context(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """``chunks`` with the sentence of their section as context_text, where ``contexts`` (section_uid,
    context) has one; else they keep theirs. Null sections keep theirs."""
    fresh = contexts.where("section_uid IS NOT NULL AND context IS NOT NULL").groupBy("section_uid").agg(F.min("context").alias("fresh"))
    return chunks.join(fresh, "section_uid", "left").withColumn("context_text", F.coalesce("fresh", "context_text")).drop("fresh")


def embedding_inputs(chunks: DataFrame) -> DataFrame:
    """chunk_id, arm, input: the text alone, and with its context before it where it has one."""
    rows = chunks.where("chunk_id IS NOT NULL AND text IS NOT NULL").select("chunk_id", "text", "context_text")
    plain = rows.select("chunk_id", F.lit("plain").alias("arm"), F.col("text").alias("input"))
    return plain.unionByName(rows.where("context_text IS NOT NULL").select("chunk_id", F.lit("+ctx").alias("arm"), F.concat("context_text", F.lit("\n\n"), "text").alias("input")))


def replace_arms(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the arms that arrived again are replaced whole; the others stay."""
    return stored.join(F.broadcast(fresh.select("arm").distinct()), "arm", "left_anti").unionByName(fresh)
