"""Operator 6: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its reply trainable. A conversation whose last turn is not a
reply gets one more example without a target, so that the output holds every
turn. Only DataFrame functions are used.

An example names its turns' text once: ``text`` is the formatted context and
reply, ``loss_start`` and ``loss_length`` (code points) mask the escaped reply.

Template: an assistant turn is ``<s>role\\ntext</s>``, any other turn is
``[INST]role\\ntext[/INST]``. Escaping puts one backslash behind the first
character of a control string, ``<\\/s>`` for ``</s>``, and one more where
there are some already; so it can be undone, whatever a text holds.

A role stands on a line of its own: its line breaks are written as ``\\n``, its
backslashes as ``\\-``, which is undone in reading.

Edge cases: a null text is empty; a null role is written as an empty one; a null
conv_id is a conversation of its own; turns sort by turn (nulls first), role and
text, repeated rows stay repeated turns; an empty table gives no example.
Only conv_id, turn, role and text are read. The expansion of one conversation
is quadratic in its turns by definition; it is made row by row out of one array
of turns, so no shuffle carries a prefix. The limit that follows: a conversation's
turns, and each formatted prefix, must fit into a row (2 GB), as must the texts whose
digests are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def one_line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n"))


def many_lines(line: Column) -> Column:
    """Undo :func:`one_line`: each backslash there belongs to one of its two pairs."""
    return F.replace(F.replace(line, F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    """One formatted turn, of a role and a text without nulls."""
    reply = F.concat(F.lit("<s>"), role, F.lit("\n"), escape(text), F.lit("</s>"))
    other = F.concat(F.lit("[INST]"), escape(role), F.lit("\n"), escape(text), F.lit("[/INST]"))
    return F.when(role == ASSISTANT, reply).otherwise(other)


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), is_last, text, loss_start, loss_length (0 without a target)."""
    role = one_line(F.coalesce("role", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("raw"), render(role, text).alias("shown"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == last))
    examples = turns.select("conv_id", "turns", F.posexplode(targets).alias("example", "upto"))
    target = F.element_at("turns", F.col("upto"))
    shown = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: t["shown"]), "")
    reply = F.when(target["role"] == ASSISTANT, F.length(target["shown"]) - len(f"<s>{ASSISTANT}\n</s>")).otherwise(0)
    made = examples.select("conv_id", "example", (F.col("upto") == last).alias("is_last"), shown.alias("text"), (target["role"] == ASSISTANT).alias("has_target"), reply.cast("long").alias("loss_length"))
    start = F.when(F.col("has_target"), F.length("text") - len("</s>") - F.col("loss_length")).otherwise(F.length("text"))
    return made.select("conv_id", "example", "is_last", "text", start.cast("long").alias("loss_start"), "loss_length")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    shown = F.regexp_extract_all(text, F.lit(r"(?s)(<s>.*?</s>|\[INST\].*?\[/INST\])"), 1)

    def turn(t: Column) -> Column:
        body = F.regexp_replace(t, r"(?s)^(?:<s>|\[INST\])(.*)(?:</s>|\[/INST\])$", "$1")
        line = F.locate("\n", body)
        return F.struct(many_lines(unescape(body.substr(F.lit(1), line - 1))).alias("role"), unescape(body.substr(line + 1, F.length(body))).alias("text"))

    return F.transform(shown, turn)


def read_loss(text: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask."""
    return unescape(text.substr((start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say when they are read back.

    Each example is reduced to its reply, its length and, for the longest of a
    conversation, its turns before anything is shuffled.
    """
    turns = read_turns(F.col("text"))
    read = examples.select(
        "conv_id",
        F.struct("example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("reply")).alias("loss"),
        F.length("text").alias("chars"),
        F.when(F.col("is_last"), turns).alias("turns"),
    )
    read = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digest from the turns themselves; lengths of escapes are counted.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 17 ELSE 14 + length(role) END + length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end
  FROM rows
), prefixes AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY from_end DESC) AS prefix FROM shown
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY from_end DESC)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY from_end DESC) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM prefixes GROUP BY conv_id
"""
