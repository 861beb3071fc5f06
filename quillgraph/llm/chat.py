"""Chat formatting with a grammar round trip.

Each turn is rendered as `<|im_start|>role\\n text <|im_end|>\\n`. The rendered text is parsed again by a deterministic
parser and compared with the source; what does not come back identical is escaped, first the turns that fail on
their own, then every turn of a conversation that still fails. A conversation that would fail even then stops the
run: no lossy output is written.

Grammar: conversation = turn*; turn = START role NL text END NL. Neither role nor text holds `<|`, so no control
string of any kind stays in a text. The parser undoes three
references: `&lt;|` is `<|`, `&nl;` (in roles only) a line end, `&amp;` is `&`. Ordinary text stays as it is: it is
escaped only where the parser would read it otherwise.

Scale: turns are checked and rendered row by row before the one shuffle (by conversation), so a task holds the
strings of one conversation at a time, which is one row of the output. All steps are built-in expressions.

Defined cases: null role or text counts as empty; turns are ordered by turn (nulls first), ties by role and text;
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no conversations; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape_text(c: Column) -> Column:
    return _replace(_replace(c, "&", "&amp;"), "<|", "&lt;|")


def escape_role(c: Column) -> Column:
    return _replace(escape_text(c), "\n", "&nl;")


def unescape_text(c: Column) -> Column:
    return _replace(_replace(c, "&lt;|", "<|"), "&amp;", "&")


def unescape_role(c: Column) -> Column:
    return _replace(_replace(_replace(c, "&nl;", "\n"), "&lt;|", "<|"), "&amp;", "&")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _turn(piece: Column) -> Column:
    """One piece before an END: its role and text, or null where the grammar does not hold."""
    head = F.instr(piece, "\n")
    body = F.when(head > 0, F.struct(
        unescape_role(F.substring(piece, F.lit(len(START) + 1), head - len(START) - 1)).alias("role"),
        unescape_text(F.substring(piece, head + 1, F.length(piece))).alias("text"),
    ))
    only = ~F.substring(piece, F.lit(len(START) + 1), F.length(piece)).contains("<|")
    return F.when(piece.startswith(START) & only, body)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; elements or all of it null where it breaks the grammar."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _turn)
    return F.when(F.element_at(pieces, -1) == "", turns)


def _same(parsed: Column, source: Column) -> Column:
    return F.coalesce(parsed == source, F.lit(False))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted, turns (as read back from formatted), escaped (0: none, 1: some turns, 2: every turn), and
    loss_lengths (whether a turn is under the loss mask, lengths of its role and text as they stand in formatted), from
    which loss_spans() gives places."""
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.struct("role", "text")
    plain = F.coalesce(_same(parse(render(F.col("role"), F.col("text"))), F.array(source)), F.lit(False))
    rows = rows.withColumn("plain", plain)
    rows = rows.withColumn("r", F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role")))).withColumn("x", F.when(F.col("plain"), F.col("text")).otherwise(escape_text(F.col("text"))))
    turns = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "role", "text", "plain", "r", "x"))).alias("s"))
    turns = turns.withColumn("source", F.transform("s", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))))
    first = F.array_join(F.transform("s", lambda s: render(s["r"], s["x"])), "")
    turns = turns.withColumn("f1", first).withColumn("p1", parse(F.col("f1"))).withColumn("ok1", _same(F.col("p1"), F.col("source")))
    second = F.array_join(F.transform("source", lambda s: render(escape_role(s["role"]), escape_text(s["text"]))), "")
    turns = turns.withColumn("formatted", F.when(F.col("ok1"), F.col("f1")).otherwise(second))
    turns = turns.withColumn("turns", F.when(F.col("ok1"), F.col("p1")).otherwise(parse(F.col("formatted"))))
    sure = F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back")))
    level = F.when(~F.col("ok1"), 2).when(F.exists("s", lambda s: ~s["plain"]), 1).otherwise(0)
    stored = F.when(F.col("ok1"), F.transform("s", lambda s: F.struct(s["r"].alias("role"), s["x"].alias("text")))).otherwise(F.transform("source", lambda s: F.struct(escape_role(s["role"]).alias("role"), escape_text(s["text"]).alias("text"))))
    return turns.select(F.col("c").alias(conv), "formatted", sure.alias("turns"), stored.alias("stored"), level.alias("escaped")).withColumn("loss_lengths", F.transform("stored", lambda s: F.struct((s["role"] == "assistant").alias("loss"), F.length(s["role"]).alias("role"), F.length(s["text"]).alias("text")))).drop("stored")


def loss_spans(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turn number, start, end (code points from 0) of each text under the loss mask, as a table: running sums
    over the turns' lengths, one row a turn, so no array grows with the conversation."""
    each = formatted.select(conv, F.posexplode("loss_lengths").alias("turn", "l"))
    w = Window.partitionBy(conv).orderBy("turn")
    size = F.col("l.role") + F.col("l.text") + len(START) + len(END) + 2
    end = F.sum(size).over(w) - len(END) - 1
    return each.select(conv, "turn", F.col("l.loss").alias("loss"), (end - F.col("l.text")).alias("start"), end.alias("end")).filter("loss").drop("loss")


def loss_text(formatted: Column, lengths: Column) -> Column:
    """The text under the loss mask as it reads back: of each turn's piece of `formatted` the part that the mask's lengths
    mark, unescaped, in order and with nothing between."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    cut = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lengths, lambda p, l: F.when(l["loss"], unescape_text(F.substring(p, l["role"] + len(START) + 2, l["text"]))).otherwise(F.lit("")))
    return F.array_join(cut, "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the query returns: turns as read back, and the text that the loss mask marks in the formatted string."""
    turns = F.array_join(F.transform("turns", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return formatted.withColumn("__loss", loss_text(F.col("formatted"), F.col("loss_lengths"))).select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped",
    )
