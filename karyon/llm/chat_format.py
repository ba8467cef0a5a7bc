"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Each turn is written as

    <|im_start|>ROLE
    TEXT<|im_end|>

and a conversation is its turns one after the other. Control strings in a text are broken by a
backslash after their first character, and backslashes are doubled, so they cannot be taken for marks and are read
back exactly; a role is percent-encoded for its line end as well.

Each assistant turn is exploded into an example of its own: its text is all preceding turns, then the turn itself, in full, and only the turn's text is
trainable. So examples are as large as the squares of the conversations. They are made by exploding a gathered conversation, one after the other, and
nothing between holds more than one of them; `digests` reads the loss and the context back from these texts.

Order: by turn (null first), role, text. A null text, role or turn is empty, empty and first; null conversation ids are one conversation. Rows that repeat
turn, role and text all stay; they are counted once and multiplied again. Extra columns are ignored. Positions are running
sums on three levels (texts of one turn and role, turns of a span, spans of a conversation), so a hot conversation is not summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates use as marks, and how a text spells them.
CONTROL = [("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")]
TRAINABLE = "assistant"
SPAN = 1024


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in CONTROL:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _before(rows: DataFrame, keys: list[str], order: list, *names: str) -> DataFrame:
    """rows with NAME_before: the sum of each of these columns over the rows before, of the same keys in this order."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = TRAINABLE) -> DataFrame:
    """(conv_id, turn, place, formatted, begin, end, loss_begin, loss_end) of every turn; place counts turns from 0, the last two are null for context-only turns."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 60))))
    rows = rows.withColumn("formatted", F.concat(F.lit(OPEN), _role_line(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(CLOSE)))
    rows = rows.withColumn("size", F.length("formatted").cast("long")).withColumn("all_size", F.col("size") * F.col("copies"))
    own = ["conv_id", "span", "turn", "role"]
    rows = _before(rows, own, ["text"], "all_size", "copies")
    turns = rows.groupBy(*own).agg(F.sum("all_size").alias("t_size"), F.sum("copies").alias("t_n"))
    spans = turns.groupBy("conv_id", "span").agg(F.sum("t_size").alias("s_size"), F.sum("t_n").alias("s_n"))
    turns = _before(turns, ["conv_id", "span"], [F.asc_nulls_first("turn"), "role"], "t_size", "t_n")
    spans = _before(spans, ["conv_id"], ["span"], "s_size", "s_n")
    same = lambda keys, other: [F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in keys]
    turns = turns.select(*[F.col(k).alias(f"t_{k}") for k in own], "t_size_before", "t_n_before")
    spans = spans.select(*[F.col(k).alias(f"s_{k}") for k in own[:2]], "s_size_before", "s_n_before")
    turns = turns.join(spans, [F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}")) for k in own[:2]])
    placed = rows.join(turns, same(own, "t")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    begin = F.col("s_size_before") + F.col("t_size_before") + F.col("all_size_before") + F.col("copy") * F.col("size")
    placed = placed.withColumns({"begin": begin, "end": begin + F.col("size"), "place": F.col("s_n_before") + F.col("t_n_before") + F.col("copies_before") + F.col("copy")})
    target = F.col("role") == trainable
    loss_end = F.col("end") - F.lit(len(CLOSE))
    return placed.select("conv_id", "turn", "place", "formatted", "begin", "end", F.when(target, loss_end - F.length(escaped(F.col("text")))).alias("loss_begin"), F.when(target, loss_end).alias("loss_end"))


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's formatted turns in order; an example needs the whole of what is before it."""
    fields = ["begin", "place", "end", "turn", "loss_begin", "loss_end", "formatted"]
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))


def _exploded(conversations: DataFrame, *kept: str, outer: bool = False) -> DataFrame:
    """The columns `kept` with an example in each row: text is the conversation to the end of the target turn."""
    whole = F.array_join(F.transform("turns", lambda t: t["formatted"]), "")
    small = lambda t: F.struct(*[t[n].alias(n) for n in ("turn", "place", "begin", "end", "loss_begin", "loss_end")])
    targets = F.transform(F.filter("turns", lambda t: t["loss_begin"].isNotNull()), small)
    each = conversations.select(*kept, whole.alias("whole"), (F.explode_outer if outer else F.explode)(targets).alias("target"))
    return each.select(
        *kept,
        F.col("target.turn").alias("target_turn"),
        F.col("target.place").alias("context_turns"),
        F.substring("whole", F.lit(1), F.col("target.end").cast("int")).alias("text"),
        *[F.col(f"target.{n}").alias(n) for n in ("begin", "end", "loss_begin", "loss_end")],
    )


def examples(turns: DataFrame) -> DataFrame:
    """An example for each trainable turn: `text` is its context, the characters [0, begin) with the context_turns turns before it, and then the turn; [loss_begin, loss_end) are the only trainable characters."""
    return _exploded(gathered(turns), "conv_id")


def spelled_out(turns: DataFrame) -> DataFrame:
    """(conv_id, target_turn, text, loss_begin, loss_end) of every example."""
    return examples(turns).select("conv_id", "target_turn", "text", "loss_begin", "loss_end")


def _read_turn(formatted: Column) -> Column:
    """ROLE, line end, TEXT, line end: parsed from a formatted turn alone."""
    header = F.substring_index(formatted, "\n", 1)
    role = F.replace(F.replace(unescaped(F.substring(header, F.lit(len(OPEN) + 1), F.length(header))), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    body = F.substring(formatted, F.length(header) + 2, F.length(formatted) - F.length(header) - 1 - len(CLOSE))
    return F.concat(role, F.lit("\n"), unescaped(body), F.lit("\n"))


def read_loss() -> Column:
    """The unescaped text under the mask of an example, read from its text."""
    return unescaped(F.substring("text", (F.col("loss_begin") + 1).cast("int"), (F.col("loss_end") - F.col("loss_begin")).cast("int")))


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted output holds, by conversation: turns read back from the formatted turns, loss and contexts from the texts of the examples.

    contexts_hold: whether the text before each target ends with a turn and has as many ends of turns as there are turns before it (no text has such an end itself).
    expanded_chars: of all examples' texts.
    """
    said = F.array_join(F.transform("turns", lambda t: _read_turn(t["formatted"])), "")
    own = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    read = gathered(turns).select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_max(F.transform("turns", lambda t: t["end"])).alias("formatted_chars"))
    context = F.substring("text", F.lit(1), F.col("begin").cast("int"))
    ends = (F.length(context) - F.length(F.replace(context, F.lit(CLOSE), F.lit("")))) / len(CLOSE)
    holds = (ends == F.col("context_turns")) & ((F.col("begin") == 0) | F.endswith(context, F.lit(CLOSE)))
    each = _exploded(read, *own, outer=True).select(*own, "context_turns", F.length("text").cast("long").alias("chars"), read_loss().alias("loss"), holds.alias("holds"))
    found = each.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in own[1:]],
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("context_turns", "loss")))).alias("losses"),
        F.coalesce(F.sum(F.length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
        F.count("loss").alias("n_examples"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("expanded_chars"),
        F.coalesce(F.min("holds"), F.lit(True)).alias("contexts_hold"),
    )
    loss = F.sha2(F.array_join(F.transform("losses", lambda t: t["loss"]), ""), 256)
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", loss.alias("loss_sha256"), "formatted_chars", "n_examples", "expanded_chars", "contexts_hold")


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for plain, broken in CONTROL:
        out = f"replace({out}, '{plain}', '{broken}')"
    return out


def digests_sql(rows: str) -> str:
    """The same as DuckDB SQL over `rows`: a select of conv_id, turn, role, text."""
    role = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({rows})),
f AS (SELECT *, CAST({len(OPEN) + 1 + len(CLOSE)} + length({_sql_escaped(role)}) + length({_sql_escaped("text")}) AS BIGINT) AS size FROM r),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY upto)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINABLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY upto) FILTER (role = '{TRAINABLE}'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = '{TRAINABLE}') AS n_examples,
       CAST(coalesce(sum(upto) FILTER (role = '{TRAINABLE}'), 0) AS BIGINT) AS expanded_chars,
       true AS contexts_hold
FROM p GROUP BY conv_id"""
