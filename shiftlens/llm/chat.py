"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<s>role\\ntext</s>`` for the roles a model learns from and
``[INST]role\\ntext[/INST]`` for all others, turn after turn.  A deterministic parser reads the
rendered text back: it cuts before every opening mark, takes the first line of a piece as role and
everything up to the first closing mark as text; a piece that does not end there is broken.  Where
the parsed turns differ from the source, the conversation is rendered again with its conflicting
strings escaped, and parsed again, level by level, until both are identical.

* level 0: as it is.
* level 1: control strings in texts get a backslash after their bracket (``[INST]`` becomes
  ``[\\INST]``), and control strings that already have backslashes get one more.
* level 2: the same in roles, whose line feeds and backslashes are written as two characters.

The parser always unescapes, so a reader needs to know nothing but the grammar.  All steps are
column expressions; a conversation's turns are gathered in one row, as its text has to be.

Turns are ordered by turn number, then role and text (nulls first, as empty strings); repeated
rows are turns of their own.  Rows without conv_id form one conversation without id.  Null roles
and texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The marks of the template.
MARKS = {True: ("<s>", "</s>"), False: ("[INST]", "[/INST]")}
LEARNED_ROLES = ("assistant",)
CONTROL = r"([\[<])(\\*)(/?(?:INST\]|s>))"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
OPENING = r"(?=\[INST\]|<s>)"
LEVELS = 3


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def escape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(role)


def unescape_role(role: Column) -> Column:
    # Cut at the pairs first, so that the second half of a pair is not read as the start of "\\n".
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def is_learned(role: Column) -> Column:
    return role.isin(*LEARNED_ROLES)


def rendered_turn(turn: Column, level: int) -> Column:
    role = escape_role(turn["role"]) if level >= 2 else turn["role"]
    text = escape(turn["text"]) if level >= 1 else turn["text"]
    body = F.concat(role, F.lit("\n"), text)
    (o1, c1), (o0, c0) = MARKS[True], MARKS[False]
    return F.when(is_learned(turn["role"]), F.concat(F.lit(o1), body, F.lit(c1))).otherwise(
        F.concat(F.lit(o0), body, F.lit(c0))
    )


def render(turns: Column, level: int) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered_turn(t, level)), "")


def parse_piece(piece: Column) -> Column:
    """(role, text, learned) of one piece, NULL where it breaks the grammar."""

    def read(learned: bool) -> Column:
        opening, closing = MARKS[learned]
        body = F.substring(piece, F.lit(len(opening) + 1), F.length(piece))
        end = F.instr(body, closing)
        turn = F.substring(body, F.lit(1), end - 1)
        line = F.instr(turn, "\n")
        whole = (end > 0) & (end + len(closing) - 1 == F.length(body)) & (line > 0)
        return F.when(
            whole,
            F.struct(
                unescape_role(F.substring(turn, F.lit(1), line - 1)).alias("role"),
                unescape(F.substring(turn, line + 1, F.length(turn))).alias("text"),
                F.lit(learned).alias("learned"),
            ),
        )

    return F.when(piece.startswith(MARKS[True][0]), read(True)).when(
        piece.startswith(MARKS[False][0]), read(False)
    )


def parse(rendered: Column) -> Column:
    """Turns (role, text, learned) read from a rendered conversation."""
    pieces = F.filter(F.split(rendered, OPENING), lambda p: p != "")
    return F.transform(pieces, parse_piece)


def same_turns(parsed: Column, turns: Column) -> Column:
    plain = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    wanted = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    right_mask = F.forall(parsed, lambda p: p["learned"] == is_learned(p["role"]))
    return F.coalesce((plain == wanted) & right_mask, F.lit(False))


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (turn, role, text) in order."""
    empty = F.lit("")
    return (
        conversations.select(
            "conv_id",
            F.struct(
                "turn",
                F.coalesce("role", empty).alias("role"),
                F.coalesce("text", empty).alias("text"),
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("row")).alias("turns"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, level, turns): one row per conversation.

    ``formatted`` is the rendered text, ``level`` how far it had to be escaped, and ``turns`` what
    the parser reads back from ``formatted``: (role, text, learned), ``learned`` being the loss
    mask.  Needs one shuffle, of the turns by conversation.
    """
    out = gathered(conversations).select("conv_id", F.col("turns").alias("source"), F.lit(-1).alias("level"))
    out = out.withColumn("formatted", F.lit(None).cast("string"))
    for level in range(LEVELS):
        # Only conversations that are still open are rendered and parsed again.
        is_open = F.col("level") < 0
        out = out.withColumn("formatted", F.when(is_open, render(F.col("source"), level)).otherwise(F.col("formatted")))
        fits = same_turns(parse(F.col("formatted")), F.col("source"))
        out = out.withColumn(
            "level", F.when(is_open & fits, F.lit(level)).otherwise(F.col("level"))
        )
    return out.select("conv_id", "formatted", "level", parse(F.col("formatted")).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """Hashes and lengths of what ``format_chats`` reads back."""
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
