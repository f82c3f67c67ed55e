"""Keyword tables of any size against texts, by equality joins on words and on the letters around a space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.text import WORD_BREAK
from contrail.session import BROADCAST_ROWS, broadcast_if_small

SIDE = 3  # letters of a phrase looked up on each side of its first space
# Up to SIDE letters on each side of every space, in one pass: it goes on behind the space, the look-ahead sees what follows.
_AROUND = f"(?s)(?=([^ ]{{0,{SIDE}}} .{{0,{SIDE}}}))[^ ]{{0,{SIDE}}} "


def _phrase_probes(keywords: DataFrame) -> DataFrame:
    """Phrases with the hash of the letters around their first space, and how many there are on each side (0 to SIDE)."""
    head = F.instr("keyword", " ") - 1
    before = F.least(head, F.lit(SIDE))
    after = F.least(F.length("keyword") - head - 1, F.lit(SIDE))
    piece = F.substring(F.col("keyword"), head - before + 1, before + 1 + after)
    return keywords.withColumns({"before": before, "after": after, "probe": F.xxhash64(piece)})


def _probes(texts: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The columns of ``texts`` with ``probe``: the hash of the letters around each space of ``_text`` in each shape (before, after)."""
    near = texts.select("*", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(_AROUND), F.lit(1)))).alias("_near"))
    head = F.instr("_near", " ") - 1  # letters before hold no space
    pieces = [F.when((head >= b) & (F.length("_near") > head + a), F.substring(F.col("_near"), head - b + 1, F.lit(b + 1 + a))) for b, a in shapes]
    return near.select(*texts.columns, F.explode(F.array(*pieces)).alias("_piece")).where(F.col("_piece").isNotNull()).select(*texts.columns, F.xxhash64("_piece").alias("probe"))


def keyword_mentions(docs: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """The columns of ``docs`` with (domain, keyword): for every domain a text mentions its first keyword, in order
    of letters.

    ``keywords`` has lower-case (domain, keyword) rows, as many as there may be.  As with ``first_mention``, a word
    counts when it is a whole word of the lower-case text, a phrase when it occurs anywhere.  Words meet the table
    by equality.  A phrase is looked up by up to three letters on each side of its first space; what agrees is
    searched in the text.  Both go by hashes first, which are cheaper to look up than texts.  A table that can be broadcast meets the texts where they are; for a larger one each different
    text is looked up once, and only its digest travels with its words.
    NULL texts and NULL keywords mention nothing; repeated rows of ``docs`` each keep their mentions; a keyword listed twice counts
    once."""
    lower = F.lower(F.col(text))
    marked = docs.withColumn("_digest", F.sha2(lower, 256))
    texts = marked.where(F.col("_digest").isNotNull()).select("_digest", lower.alias("_text"))
    table = keywords.select("domain", "keyword").where(F.col("keyword").isNotNull()).distinct()
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if not small:
        texts = texts.dropDuplicates(["_digest"])
    is_phrase = F.contains("keyword", F.lit(" "))

    words = texts.select("_digest", F.explode(F.array_distinct(F.split("_text", WORD_BREAK))).alias("_word")).withColumn("_hash", F.xxhash64("_word"))
    listed = table.where(~is_phrase).withColumn("_hash", F.xxhash64("keyword"))
    found = words.join(broadcast_if_small(listed), "_hash").where(F.col("_word") == F.col("keyword")).select("_digest", "domain", "keyword")

    phrases = _phrase_probes(table.where(is_phrase))
    shapes = sorted(tuple(r) for r in phrases.select("before", "after").distinct().collect())  # (SIDE + 1) squared rows at most
    if shapes:
        phrases = phrases.select("probe", "domain", "keyword")
        if small:
            checked = _probes(texts, shapes).join(F.broadcast(phrases), "probe").where(F.contains("_text", "keyword"))
        else:
            probes = _probes(texts, shapes).select("_digest", "probe")
            agreeing = probes.join(broadcast_if_small(phrases), "probe").select("_digest", "domain", "keyword").distinct()
            checked = texts.join(agreeing, "_digest").where(F.contains("_text", "keyword"))
        found = found.unionByName(checked.select("_digest", "domain", "keyword"))

    first = found.groupBy("_digest", "domain").agg(F.min("keyword").alias("keyword"))
    return marked.join(first, "_digest").drop("_digest")
