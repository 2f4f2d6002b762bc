"""Texts that were cut before their end.

Method: the vocabulary of all texts as a trie; a text whose last word is unknown but a proper prefix of known words was
cut inside it. Beside it stand the length evidence (many different texts of a source are cut at one length, in
characters or bytes), what a transfer leaves behind at the end, the punctuation, and how often the last words end
anything anywhere in the corpus. A list entry, a field, a signature or an address at the end is complete as it is,
unless the trie, the length or the corpus says otherwise. Prose without a stop is cut, unless neither the trie nor the
length shows it and the corpus says that its last three words nearly always end something.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.endings import ending_evidence
from evalloom.runtime import broadcast_if_small, cut_lineage

#: Different texts of one length, visibly cut, that make it a limit of the source.
MIN_AT_LIMIT = 3
BROKEN = ("prose", "mark", "residue")
#: Below this share of ends, the last words don't end anything.
LOW_END_RATE = 0.05
LOW_DOT_RATE = 0.1
#: From this share of ends on, the same three last words are taken for an end that only lacks its stop.
HIGH_END_RATE = 0.95

_RESIDUE = re.compile(r"(?:…|\.\.\.|\[\.\.\.\]|\[…\]|�)[\s\")\]”»]*$|(?:<[^<>\s]{0,12}|&\w{0,8})$")
_CLOSED_MARKUP = re.compile(r"(?:<[^<>]*>|&\w+;|[\s​﻿])+$")
_STOP = re.compile(r"[.!?][\"'”’»)\]*_]*$")
_LIST = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
_ADDRESS = re.compile(r"(?:(?:https?|ftp)://|www\.)\S+$|\S+@\S+\.\S+$")
_SIGNATURE = re.compile(r"[^\W\d_][^\d.,:;!?\n]{1,40}, [^\W\d_][^\d.,:;!?\n]{1,40}$")
_FIELD = re.compile(r"[^:=.!?]{0,60}?[^\W\d_][^:=.!?]{0,60}?(?::\s|\s*=)\s*\S")

#: Marks at the end that something was to follow.
_GOES_ON = re.compile(r"[,;:(\[{“„«/&+=<–—-]$")


def closing(text: str) -> str:
    """How a text closes: 'stop', 'residue' (marks of a broken transfer), 'mark' (other punctuation), 'list', 'address', 'signature', 'field', 'prose', or 'none' for a text without words."""
    text = text.rstrip("​﻿ \t\r\n\xa0")
    if not any(c.isalnum() for c in text[-4096:]):
        return "none"
    if _RESIDUE.search(text[-64:]):
        return "residue"
    text = _CLOSED_MARKUP.sub("", text[-65536:]) if text[-1] in ">;" else text
    if _STOP.search(text[-16:]):
        return "stop"
    last = text[text.rfind("\n") + 1 :]
    if _ADDRESS.search(last[-2048:]):
        return "address"
    if not text[-1].isalnum():
        # A closing bracket or quotation mark is as good as a stop if its partner stands before it in the last line.
        partner = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}.get(text[-1])
        if partner and last.count(partner) >= last.count(text[-1]) or text[-1] == '"' and last.count('"') % 2 == 0:
            return "stop"
        return "mark"
    if _LIST.match(last):
        return "list"
    before = text[: text.rfind("\n") + 1]
    if _SIGNATURE.fullmatch(last) and before.endswith("\n\n") and all(len(x.split()) <= 4 for x in last.split(",")):
        return "signature"
    parts = [p for p in re.split(r"[\n;|]", text[-8192:]) if p.strip()]
    if len(parts) >= 2 and all(_FIELD.match(p) for p in parts[-2:]) and not _STOP.search(parts[-2].strip()[-8:]):
        return "field"
    return "prose"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["id", "source", "chars", "bytes", "text_hash"]].assign(closing=[closing(t) for t in batch["text"]], dotted=[bool(re.search(r"[^\W\d_]\.[\"'”’»)\]*_]*$", t.rstrip()[-16:])) for t in batch["text"]], goes_on=[bool(_GOES_ON.search(t[-64:].rstrip("\u200b\ufeff \t\r\n\xa0"))) for t in batch["text"]])


def length_limits(features: DataFrame, measure: str) -> DataFrame:
    """The limit of each source that has one, as `<measure>_limit`, with `<measure>_texts`, how many texts have it.

    A length is a limit if MIN_AT_LIMIT different texts of it or more visibly end in the middle, half of all its texts at
    least, and more texts have it than are longer. So a few longer texts don't hide it. Of several the commonest counts.
    """
    known = features.where("source is not null").withColumnRenamed(measure, "length")
    broken = known.where(F.col("closing").isin(*BROKEN)).groupBy("source", "length").agg(F.countDistinct("text_hash").alias("broken")).where(F.col("broken") >= MIN_AT_LIMIT)
    broken = broadcast_if_small(cut_lineage(broken), 100_000)
    texts = known.join(broken, ["source", "length"]).groupBy("source", "length", "broken").agg(F.countDistinct("text_hash").alias("texts")).where("2 * broken >= texts")
    # A source has few lengths, however many texts.
    rows = known.groupBy("source", "length").agg(F.count("*").alias("n"))
    longer = rows.withColumn("longer", F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("length"))) - F.col("n"))
    limits = texts.join(longer.drop("n"), ["source", "length"]).where("texts > longer").groupBy("source").agg(F.max_by("length", F.struct("texts", "length")).alias(f"{measure}_limit"), F.max("texts").alias(f"{measure}_texts"))
    return cut_lineage(limits)


def find_truncated(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """Every text of `df` with whether it was cut: id, source, `cut`, `closing` and `at_limit`.

    Null texts and texts without a letter or digit aren't cut: they have no end to miss. A null source is a source of
    its own, without a limit. Repeated texts are judged alike; repeated rows are kept. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    measured = rows.select("*", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text_hash"))
    schema = f"id {dict(df.dtypes)[id_col]}, source string, chars int, bytes int, text_hash long, closing string, dotted boolean, goes_on boolean"
    features = cut_lineage(measured.mapInPandas(_features, schema))

    limits = length_limits(features, "chars").join(length_limits(features, "bytes"), "source", "full_outer")
    # Where characters are mostly bytes, texts pile up in both: the limit is the one that more texts have.
    by_chars = F.coalesce("chars_texts", F.lit(0)) >= F.coalesce("bytes_texts", F.lit(0))
    limits = limits.select("source", F.when(by_chars, F.col("chars_limit")).alias("chars_limit"), F.when(~by_chars, F.col("bytes_limit")).alias("bytes_limit"))
    limited = features.join(broadcast_if_small(limits, 100_000), "source", "left")
    # A character that doesn't fit is left out whole: up to three bytes stay empty.
    at_limit = F.coalesce(F.col("chars") == F.col("chars_limit"), F.lit(False)) | F.coalesce(F.col("bytes").between(F.col("bytes_limit") - 3, F.col("bytes_limit")), F.lit(False))
    judged = limited.select("id", "source", "closing", "dotted", "goes_on", at_limit.alias("at_limit"))

    # The corpus is asked about every end but a clean stop and what a transfer left behind.
    doubtful = judged.where("closing in ('list', 'address', 'signature', 'field', 'prose', 'mark') or (closing = 'stop' and dotted)").select("id")
    asked = rows.select("id", "text").where(F.length("text") > 0)
    evidence = ending_evidence(rows.select("text"), asked.join(doubtful, "id", "left_semi"))
    known = judged.join(evidence, "id", "left")
    shown = F.col("at_limit") | F.col("longer").isNotNull()
    whole = ~F.col("goes_on") & F.coalesce(F.col("exact") & (F.col("end_rate") >= HIGH_END_RATE), F.lit(False))
    cut = (
        F.when(F.col("closing") == "residue", F.lit(True))
        .when(F.col("closing").isin("mark", "prose"), shown | ~whole)
        .when(F.col("closing").isin("list", "address", "signature", "field"), shown | F.coalesce(F.col("end_rate") < LOW_END_RATE, F.lit(False)))
        .when((F.col("closing") == "stop") & F.col("dotted"), F.coalesce(F.col("dot_rate") < LOW_DOT_RATE, F.lit(False)))
        .otherwise(F.lit(False))
    )
    return known.select(F.col("id").alias(id_col), F.col("source").alias(source), cut.alias("cut"), "closing", "at_limit", "end_rate", "dot_rate", "longer")


def truncation_by_source(found: DataFrame, source: str) -> DataFrame:
    """Texts, cut texts and the share of these for each source."""
    return found.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.bround(F.count_if("cut") / F.count("*"), 6).alias("share"))
