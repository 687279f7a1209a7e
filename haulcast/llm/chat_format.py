r"""Chat formatting in Spark expressions: sorted turn structs, adjacent turns of one role merged, one string and a loss mask.

A message is ``<s>role[/ROLE]text</s>``; adjacent turns of one role share a message, their texts parted by ``[NEXT]``.
Control strings inside roles and texts (also those of templates like this one, ``[INST]`` and ``[/INST]``) get a backslash
after their first character, or one more where they have some already, so that taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, NEXT, CLOSE = "<s>", "[/ROLE]", "[NEXT]", "</s>"
_CONTROL = r"(?:s>|ROLE\]|NEXT\]|INST\])"
_PLAIN, _ESCAPED = rf"([<\[])(\\*/?{_CONTROL})", rf"([<\[])\\(\\*/?{_CONTROL})"
LEARNT = "assistant"
LONG_TURNS = 256  # a conversation of more turns comes in several pieces
PIECE_TURNS = 64  # turns of such a piece
_MESSAGES = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def merged(turns: Column) -> Column:
    """Messages of sorted ``turns``: a turn whose role is that of the turn before joins its message."""

    def add(messages: Column, turn: Column) -> Column:
        last = F.try_element_at(messages, F.lit(-1))
        grown = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = last.isNotNull() & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), F.array(grown))).otherwise(
            F.concat(messages, F.array(new))
        )

    return F.aggregate(turns, F.array().cast(_MESSAGES), add)


def _segments(messages: Column, continues: Column, continued: Column) -> Column:
    """The strings a piece consists of, in order, and whether each is learnt.

    ``continues``: the first message began in the piece before; ``continued``: the last one goes on in the next.
    """

    def fixed(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("learnt"))

    def of(message: Column, i: Column) -> Column:
        begin = F.when((i == 0) & continues, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(message["role"]), F.lit(ROLE_END)))
        end = F.when((i == F.size(messages) - 1) & continued, F.lit("")).otherwise(F.lit(CLOSE))
        texts = F.transform(
            message["texts"],
            lambda t, k: F.array(
                fixed(F.when(k == 0, begin).otherwise(F.lit(NEXT))),
                F.struct(escape(t).alias("text"), (message["role"] == LEARNT).alias("learnt")),
            ),
        )
        return F.concat(F.flatten(texts), F.array(fixed(end)))

    return F.flatten(F.transform(messages, of))


def _spans(segments: Column) -> Column:
    """Place (from 0) and length of every learnt segment, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, segment: Column) -> Column:
        length = F.char_length(segment["text"])
        span = F.array(F.struct(state["at"].alias("start"), length.alias("length")))
        spans = F.when(segment["learnt"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + length).alias("at"), spans.alias("spans"))

    return F.aggregate(segments, start, step, lambda state: state["spans"])


def _formatted(pieces: DataFrame) -> DataFrame:
    """From ``conv_id, piece, pieces, turns, continues, continued`` to the operator's columns."""
    segments = _segments(merged(F.col("turns")), F.col("continues"), F.col("continued"))
    return pieces.withColumn("segments", segments).select(
        "conv_id",
        "piece",
        "pieces",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        _spans(F.col("segments")).alias("loss_spans"),
    )


def chat_format(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, pieces, n_turns, formatted, loss_spans`` of ``turns(conv_id, turn, role, text)``.

    Turns ascend by ``turn``, null first; ties by role, then text; repeated rows all stay. A null text or role is empty, a
    null conv_id is a conversation of its own, other columns are not read. A conversation of up to ``LONG_TURNS`` turns is
    one piece (number 0); a longer one comes in pieces whose strings, end to end in order, are its string, so that no task
    holds it whole. A message that spans pieces stays one message. ``loss_spans`` are places in the piece's string.
    """
    given = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    long = given.groupBy(F.col("conv_id").alias("long_id")).count().where(F.col("count") > LONG_TURNS).select("long_id")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    no = F.lit(False)
    short = given.join(long, is_long, "left_anti").groupBy("conv_id").agg(_sorted("turn", "role", "text").alias("turns"))
    short = short.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), "turns", no.alias("continues"), no.alias("continued"))

    order = ["conv_id", "turn", "role", "text", "row"]  # row: equal rows can be dealt to several partitions
    rows = given.join(long, is_long, "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    cut = rows.groupBy("conv_id", F.floor(F.col("at") / PIECE_TURNS).alias("block")).agg(_sorted("at", "role", "text").alias("turns"))
    ends = cut.select("conv_id", "block", F.col("turns")[0]["role"].alias("first"), F.try_element_at("turns", F.lit(-1))["role"].alias("last"))
    along = Window.partitionBy("conv_id").orderBy("block")
    ends = ends.select(
        F.col("conv_id").alias("of"),
        F.col("block").alias("place"),
        (F.row_number().over(along) - 1).cast("long").alias("piece"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("pieces"),
        F.coalesce(F.lag("last").over(along) == F.col("first"), no).alias("continues"),
        F.coalesce(F.lead("first").over(along) == F.col("last"), no).alias("continued"),
    )
    placed = cut.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("place")))
    return _formatted(short.unionByName(placed.select(*short.columns)))


def _sorted(key: str, *columns: str) -> Column:
    """The columns of all rows as structs, in the order of the key, then of the columns."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), *columns)))
    return F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in columns)))


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, formatted_chars``: every conversation's turns (``role, text``) and the text under its loss mask.

    Only what ``chat_format`` returned is read: roles and texts are parsed from the strings, the loss is cut by the spans.
    """
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    chats = chats.withColumn("loss", loss)
    whole = chats.where("pieces = 1").select("conv_id", "formatted", "loss")
    parts = chats.where("pieces > 1").groupBy("conv_id").agg(_sorted("piece", "formatted", "loss").alias("parts"))
    joined = parts.select("conv_id", *(F.array_join(F.transform("parts", lambda p: p[c]), "").alias(c) for c in ("formatted", "loss")))
    whole = whole.unionByName(joined)
    messages = F.split("formatted", CLOSE)
    messages = F.slice(messages, F.lit(1), F.size(messages) - 1)  # nothing follows the last close

    def turns_of(message: Column) -> Column:
        halves = F.split(message, r"\[/ROLE\]")
        role = unescape(F.substring(halves[0], F.lit(len(OPEN) + 1), F.char_length(halves[0])))
        return F.transform(F.split(halves[1], r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(messages, turns_of))
    return whole.select("conv_id", turns.alias("turns"), "loss", F.char_length("formatted").cast("long").alias("formatted_chars"))
