"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, turn, kind, role, text). ``delta`` appends its
text to its turn; ``edit`` and ``regenerate`` start their turn anew with their own
text and take back every earlier event of that turn and of the turns after it.
Folding replays each conversation in the order of ``seq`` and leaves one final
message per turn. Rendering then writes, turn by turn,

    ### role
    text</turn>

Inside roles and texts the control strings are written as escapes, so the format
can be read back exactly: a backslash becomes two, ``###`` becomes ``\\h``,
``</turn>`` becomes ``\\e`` and, in roles, a newline becomes ``\\n``. The loss mask
is a list of (start, chars) spans over the rendered string that cover the escaped
assistant texts.

A conversation is the unit of the output: its rendered string is one value, so one
conversation must fit one row. There is no other bound.

Defined results: null texts and roles are empty strings; null conversation ids form
one conversation; events of one ``seq`` are ordered by turn, kind, role and text;
an empty log gives no rows; other columns are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Fixed values of the format: the control strings and their escapes.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
RESETS = ("edit", "regenerate")
LOSS_ROLE = "assistant"
PROBE = "\\### Assistant: </turn> ok"
#: Sequence numbers between two turns of an eventful log.
EVENTS = 8


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Doubled backslashes split the text into parts in which every backslash starts a code."""

    def part(x: Column) -> Column:
        for plain, code in (*ESCAPES[1:], ("\n", "\\n")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log of events."""
    order = ["seq", "turn", "kind", "role", "text"]
    log = events.select(
        "conv_id",
        "seq",
        "turn",
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    later = Window.partitionBy("conv_id").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind").isin(*RESETS), F.col("turn"))).over(later)
    live = log.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    parts = F.array_sort(F.collect_list(F.struct(*order)))
    return (
        live.groupBy("conv_id", "turn")
        .agg(parts.alias("parts"))
        .select(
            "conv_id",
            "turn",
            F.col("parts")[0]["role"].alias("role"),
            F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans) of final messages."""
    piece = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(escape(F.col("text"))).cast("long")
    pieces = messages.withColumn("piece", piece).withColumn("n", F.char_length("piece").cast("long"))
    spans = pieces.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") - size - len(CLOSE)).withColumn(
        "span", F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), size.alias("chars")))
    )
    whole = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return spans.groupBy("conv_id").agg(
        F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered string."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = piece.substr(F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(piece.substr(at + 1, F.char_length(piece))).alias("text"))

    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def as_log(conversations: DataFrame, eventful: bool = False) -> DataFrame:
    """Rows by turn as a log, whose fold gives the rows back.

    A turn is one delta. With ``eventful`` it arrives as events do in a live log: a first draft, which
    for every third turn is one of the next turn too, is taken back by an edit (of a user) or a
    regeneration that starts anew with the text's first third; the other thirds follow as deltas."""
    order = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(order).cast("long"))
    if not eventful:
        return rows.select("conv_id", F.col("k").alias("seq"), F.col("k").alias("turn"), F.lit("delta").alias("kind"), "role", "text")
    text, third = F.coalesce("text", F.lit("")), F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 3).cast("int")
    part = lambda n: text.substr(third * n + 1, third if n < 2 else F.char_length(text))
    anew = F.when(F.col("role") == LOSS_ROLE, "regenerate").otherwise("edit")
    event = lambda step, turn, kind, text, role="role": F.struct(
        (F.col("k") * EVENTS + step).alias("seq"), turn.alias("turn"), kind.alias("kind"), (F.col(role) if role == "role" else F.lit(role)).alias("role"), text.alias("text")
    )
    delta, ahead = F.lit("delta"), F.when(F.col("k") % 3 == 0, F.col("k") + 1).otherwise(F.col("k"))
    steps = [
        event(0, F.col("k"), delta, F.concat(F.lit("draft: "), text)),
        event(1, ahead, delta, F.lit("### taken back </turn>"), "draft"),
        event(2, F.col("k"), anew, part(0)),
        event(3, F.col("k"), delta, part(1)),
        event(4, F.col("k"), delta, part(2)),
    ]
    return rows.select("conv_id", F.explode(F.array(*steps)).alias("e")).select("conv_id", "e.*")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        render(fold(as_log(rows.unionByName(probe), eventful=True)))
        .select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learnt"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
            F.char_length("learnt").cast("long").alias("loss_chars"),
            F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')"
SQL = f"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + 1 + length({_ESCAPED.format("text")}) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
