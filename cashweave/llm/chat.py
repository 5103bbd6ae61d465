"""Chat formatting: one dialogue seen from each participant's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import running

BUCKET = 256  # turns of a dialogue that one window lays out


def _header(kind: str | Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), kind if isinstance(kind, Column) else F.lit(kind), F.lit("\n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", system: str = "system", nobody: str = "unknown") -> DataFrame:
    """For every participant of a dialogue all its turns, rendered with that speaker as the assistant.

    Columns: the conversation, ``perspective`` (the speaker who is the assistant), the turn, ``speaker``, ``piece`` (the rendered
    turn), ``start`` and ``end`` (where it stands in the rendered dialogue, in characters, end exclusive), and
    ``mask_start`` and ``mask_end`` (the trainable part: the assistant's words and the end mark; NULL for other turns).
    The pieces of one (conversation, perspective) in order of ``start``, concatenated, are the dialogue.

    Speakers are the values of the role; system turns are context for all and no participant, so a dialogue with
    none but system turns has no rows. Others appear as ``user name=...``. A NULL or empty role is ``nobody``; a NULL text is
    empty; marks within a text are broken up by a blank, so that no text can end its turn, and in a speaker's name, as shown
    in a header, line ends become blanks as well, so that no name can begin one. NULL conversations are one dialogue, NULL turns come first,
    and equal turns are ordered by speaker and text; repeated rows are turns of their own. Other columns are not read; an
    empty table gives an empty one.

    A dialogue is never one row or one task: places come from running totals over blocks of 256 turn numbers, and
    the join of turns with participants is one Spark splits if a dialogue holds very many.
    """
    def harmless(c: Column) -> Column:
        return F.regexp_replace(c, r"<\|(?=im_(start|end)\|>)", "<| ")

    speaker = F.coalesce(F.when(F.col(role_col) != "", F.col(role_col)), F.lit(nobody))
    text = harmless(F.coalesce(F.col(text_col), F.lit("")))
    said = turns.select(F.col(conv_col), F.col(turn_col), speaker.alias("speaker"), text.alias("__text"))
    sides = said.where(F.col("speaker") != system).select(
        F.col(conv_col).alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(sides, said[conv_col].eqNullSafe(sides["__conv"])).drop("__conv")
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(own, _header("assistant")).when(F.col("speaker") == system, _header("system"))
            .otherwise(_header(F.concat(F.lit("user name="), harmless(
                F.regexp_replace("speaker", r"[\n\r\x0B\f\x85\u2028\u2029]", " "))))))
    shown = seen.withColumn("__head", F.length(head)).withColumn(
        "piece", F.concat(head, F.col("__text"), F.lit("<|im_end|>\n"))).drop("__text")
    place = F.coalesce(F.col(turn_col), F.lit(-(1 << 62)))
    laid = running(shown, [conv_col, "perspective"], F.floor(place / BUCKET),
                   [place, F.col("speaker"), F.col("piece")], F.length("piece"), before="start", total="__all")
    end = F.col("start") + F.length("piece")
    mine = F.col("speaker") == F.col("perspective")
    return laid.select(conv_col, "perspective", turn_col, "speaker", "piece", F.col("start").cast("long").alias("start"),
                       end.cast("long").alias("end"),
                       F.when(mine, F.col("start") + F.col("__head")).cast("long").alias("mask_start"),
                       F.when(mine, end - 1).cast("long").alias("mask_end"))
