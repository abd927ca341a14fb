"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>role LF text<|im_end|> LF``. Each rendered turn is parsed again;
where role and text do not come back as they were, the turn is rendered escaped, which no content
can break: one backslash is put into every ``<|`` that could be taken for a control string (after
backslashes that stand there already), and roles get codes for backslash, LF and ``<|``. The parser
takes such backslashes away, so a turn that holds them itself is a conflict too. The whole
conversation is parsed and compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\|"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def header(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit(END + "\n"))


def _cut(piece: Column, n: int) -> Column:
    """The piece without its last n characters."""
    return F.substring(piece, F.lit(1), F.length(piece) - n)


def parse_pieces(formatted: Column) -> Column:
    """What stands behind each start of a turn; the first element is what precedes them all."""
    return F.split(formatted, r"<\|im_start\|>")


def parse_turn(piece: Column) -> Column:
    """struct(role, text) of what follows the start of a turn; null if it isn't a whole turn."""
    body = _cut(piece, len(END) + 1)
    role = F.substring_index(body, "\n", 1)
    text = F.substring(body, F.length(role) + 2, F.length(body))
    whole = piece.endswith(END + "\n") & (F.instr(body, END) == 0) & (F.instr(body, "\n") > 0)
    return F.when(whole, F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text")))


def turn_pieces(pieces: Column) -> Column:
    """The pieces without what precedes the first turn."""
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    return F.transform(turn_pieces(parse_pieces(formatted)), parse_turn)


def masked_texts(turns: Column, starts: Column, spans: Column) -> Column:
    """What ``spans`` cut out of a formatted conversation, unescaped, one text for each; null if one of its
    turns, the pieces ``turns``, doesn't stand where ``starts`` says. Each span is cut out of its turn, so the
    work grows with the conversation, however many spans it has."""
    step = lambda a, p: F.struct(
        (a["turn"] + 1).alias("turn"),
        (a["at"] + F.length(p) + len(START)).alias("at"),
        (a["right"] & F.coalesce(F.get(starts, a["turn"]) == a["at"], F.lit(False))).alias("right"),
    )
    walked = F.aggregate(turns, F.struct(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("right")), step)
    cut = lambda s: F.substring(F.get(turns, s["turn"]), (s["start"] - F.get(starts, s["turn"]) - len(START) + 1).cast("int"), s["length"].cast("int"))
    return F.when(walked["right"], F.transform(spans, lambda s: unescape_text(cut(s))))


def survives(rendered: Column, role: Column, text: Column) -> Column:
    """Whether one rendered turn is read back as that turn."""
    pieces = parse_pieces(rendered)
    back = parse_turn(pieces[1])
    one = (F.size(pieces) == 2) & (pieces[0] == "")
    return F.coalesce(one & (back["role"] == role) & (back["text"] == text), F.lit(False))


def format_chat(turns: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(id, formatted, turn_starts, loss_spans, n_escaped, round_trip), one row for each conversation.

    ``turns`` has the id, turn, role and text; they are ordered by turn (nulls first), then role and
    text, and repeated rows are turns each. Null roles and texts are empty. Rows of a null id are a
    conversation. ``round_trip`` tells that all turns come back from ``formatted``, and that the spans cut
    out the loss texts. ``loss_spans`` are (start, length, turn): where the texts of ``loss_role`` stand within
    ``formatted``, in code points, and the number of the turn, from 0; ``turn_starts`` are where all turns
    begin there. An empty table gives no rows; other columns are not read.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = turns.select(F.col(id_col), F.col("turn"), role.alias("role"), text.alias("text"))
    plain = render(F.col("role"), F.col("text"))
    t = t.withColumn("_escape", ~survives(plain, F.col("role"), F.col("text")))
    t = t.withColumn("_role", F.when(F.col("_escape"), escape_role(F.col("role"))).otherwise(F.col("role")))
    t = t.withColumn("_text", F.when(F.col("_escape"), escape_text(F.col("text"))).otherwise(F.col("text")))
    t = t.withColumn("_rendered", render(F.col("_role"), F.col("_text")))
    order = W.partitionBy(id_col).orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_at", F.coalesce(F.sum(F.length("_rendered")).over(order), F.lit(0).cast("long")))
    span = F.when(F.col("role") == loss_role, F.struct((F.col("_at") + F.length(header(F.col("_role")))).alias("start"), F.length("_text").cast("long").alias("length")))
    # what the span cuts out of the rendered turn is, unescaped, the text
    cut = F.substring(F.col("_rendered"), (span["start"] - F.col("_at") + 1).cast("int"), span["length"].cast("int"))
    t = t.withColumn("_masked", F.coalesce(unescape_text(cut) == F.col("text"), F.col("role") != loss_role))
    own = F.struct("_at", "role", "text", F.col("_rendered").alias("rendered"), span.alias("span"))
    g = t.groupBy(id_col).agg(F.sort_array(F.collect_list(own)).alias("_turns"), F.sum(F.col("_escape").cast("long")).alias("n_escaped"), F.every("_masked").alias("_masked"))
    g = g.withColumn("formatted", F.array_join(F.transform("_turns", lambda x: x["rendered"]), ""))
    source = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    of_turn = F.transform("_turns", lambda x, i: F.when(x["span"].isNotNull(), F.struct(x["span"]["start"].alias("start"), x["span"]["length"].alias("length"), i.alias("turn"))))
    spans, starts = F.filter(of_turn, lambda s: s.isNotNull()), F.transform("_turns", lambda x: x["_at"])
    same = F.coalesce((parse(F.col("formatted")) == source) & F.col("_masked"), F.lit(False))
    return g.select(id_col, "formatted", starts.alias("turn_starts"), spans.alias("loss_spans"), "n_escaped", same.alias("round_trip"))


def digest_chat(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: their turns, and the text under the loss mask, which
    is null if ``turn_starts`` are wrong."""
    t = chats.withColumn("_pieces", turn_pieces(parse_pieces(F.col("formatted")))).withColumn("_turns", F.transform("_pieces", parse_turn))
    every = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("_pieces"), F.col("turn_starts"), F.col("loss_spans")), "")
    t = t.select(id_col, "round_trip", F.size("_turns").cast("long").alias("n_turns"), every.alias("_every"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return t.select(
        id_col,
        "n_turns",
        F.sha2("_every", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "round_trip",
    )
