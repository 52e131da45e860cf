"""Chat formatting with a grammar round trip, in Spark's own functions.

    output  = turn*
    turn    = "<|im_start|>" role newline text "<|im_end|>" newline

Neither role nor text may hold ``<|``. The parser splits at the end marks,
takes the role up to the first newline, and gives no result where the grammar
is broken. In what it reads, ``<``, backslashes, one more backslash, ``|``
stands for the same with one backslash less; a newline in a role is
``<|nl|>``.

Every turn is rendered plainly, parsed and compared with its source; one that
does not come back is rendered with its content escaped (one backslash added
to each ``<\\*|``), which the parser undoes. The whole conversation is parsed
again; where it still differs all turns are escaped, and a conversation that
cannot be brought back would raise an error rather than go out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURN = "struct<role:string,text:string>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def render(turn: Column, escaped: bool) -> Column:
    role, text = turn["role"], turn["text"]
    if escaped:
        role, text = F.regexp_replace(escape(role), "\n", LINE), escape(text)
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(c: Column) -> Column:
    """Turns of an output; null where it breaks the grammar."""
    parts = F.split(c, r"<\|im_end\|>\n")

    def one(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        at = F.locate("\n", body)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + 1)
        role = F.regexp_replace(role, r"<\|nl\|>", "\n")
        good = part.startswith(START) & (at > 0) & ~role.contains("<|") & ~text.contains("<|")
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)
    whole = (F.get(parts, F.size(parts) - 1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def source_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of each conversation, in order. A conversation is one value of
    the result, so its turns do come together."""
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chat(
    conversations: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, formatted, turns`` (parsed back from it) and ``loss_spans``:
    start and end of each text of ``loss_role`` in it, in code points.

    Null roles and texts are empty; rows without ``conv_id`` are one
    conversation; turns go by number, ties by role and text, a missing number
    first; repeated rows are turns of their own. Other columns are not read."""
    df = source_turns(conversations, conv_col, turn_col, role_col, text_col)

    def careful(turn: Column) -> Column:
        plain = render(turn, escaped=False)
        back = parse(plain)
        return F.when(back.eqNullSafe(F.array(turn)), plain).otherwise(render(turn, escaped=True))

    df = df.withColumn("rendered", F.transform("turns", careful))
    all_escaped = F.transform("turns", lambda t: render(t, escaped=True))
    same = parse(F.array_join("rendered", "")).eqNullSafe(F.col("turns"))
    df = df.withColumn("rendered", F.when(same, F.col("rendered")).otherwise(all_escaped))
    df = df.withColumn("formatted", F.array_join("rendered", "")).withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(F.col("parsed").eqNullSafe(F.col("turns")), F.col("parsed")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast(f"array<{TURN}>")
    )
    # each rendered turn: where it starts, then its text between head and end mark
    none = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(turn)
        head = acc["at"] + F.locate("\n", turn)
        role = unescape(F.regexp_replace(F.substr(turn, F.lit(len(START) + 1), F.locate("\n", turn) - len(START) - 1), r"<\|nl\|>", "\n"))
        span = F.struct(head.cast("int").alias("start"), (end - len(END) - 1).cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(role == loss_role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("rendered", first, add, lambda acc: acc["spans"])
    return df.select("conv_id", "formatted", checked.alias("turns"), spans.alias("loss_spans"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from ``format_chat``'s output."""
    lost = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    df = formatted.withColumn("loss", F.array_join(lost, ""))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
