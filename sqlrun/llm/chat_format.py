"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
the context, and only its reply is trainable.  A turn is written as

    <|im_start|>ROLE \\n TEXT <|im_end|> \\n

Control strings inside texts are escaped: ``<|`` becomes ``<\\|``, and every run
of backslashes between ``<`` and ``|`` grows by one, so that no text holds a
``<|`` and the reverse takes one backslash away again.  Roles, which end at a
line feed, write ``%``, ``<`` and line feeds as ``%25``, ``%3C`` and ``%0A``.

An example is (conversation, example, formatted, loss_start, loss_chars,
complete): the place of its last turn (from 1), the whole text, the reply's code
points within it (from 0), and whether the example holds all turns.  A conversation
that doesn't end with a reply has one more example, of all its turns and with
nothing to train on, so that the examples hold every turn.
``read_examples`` gets turns and replies back from the examples alone.

A conversation's turns are gathered into one row, as each of its examples is
one text that holds them; texts of an example end at Spark's 2 GB of a value.
Nothing else is gathered: examples are exploded one at a time, and reading back
sums digests and replies by conversation.

Defined results: turns are in the order of `turn` (null first), ties by role,
then text; a repeated row is a turn of its own; a null text is empty, a null
role has an empty name and is not trainable; turns with a null conversation
form one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


_ROLE_ESCAPES = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))


def escape_role(role: Column) -> Column:
    for plain, escaped in _ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(escaped))
    return role


def unescape_role(role: Column) -> Column:
    for plain, escaped in reversed(_ROLE_ESCAPES):
        role = F.replace(role, F.lit(escaped), F.lit(plain))
    return role


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"))


def chat_examples(turns: DataFrame, conversation: str = "conv_id", trainable: str = ASSISTANT) -> DataFrame:
    """`turns` (conversation, turn, role, text) -> examples."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    whole = turns.groupBy(F.col(conversation).alias("conversation")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    written = F.transform("t", lambda x: F.concat(_head(x["role"]), escape_text(x["text"]), F.lit(END + "\n")))
    each = whole.select("conversation", F.size("t").alias("n_turns"), written.alias("written"),
                        F.posexplode("t").alias("at", "turn"))
    reply, last = F.col("turn.role") == trainable, F.col("at") + 1 == F.col("n_turns")
    context = F.array_join(F.slice("written", 1, F.col("at") + F.when(reply, 0).otherwise(1)), "")
    target = escape_text(F.col("turn.text"))
    examples = each.filter(reply | last).select(
        "conversation", "at", last.alias("complete"), reply.alias("reply"),
        F.when(reply, F.concat(context, _head(F.col("turn.role")))).otherwise(context).alias("context"),
        F.when(reply, target).alias("target"))
    return examples.select(
        "conversation", (F.col("at") + 1).alias("example"),
        F.when(F.col("reply"), F.concat("context", "target", F.lit(END + "\n"))).otherwise(F.col("context"))
        .alias("formatted"),
        F.length("context").cast("long").alias("loss_start"),
        F.coalesce(F.length("target"), F.lit(0)).cast("long").alias("loss_chars"), "complete")


def write_examples(examples: DataFrame) -> DataFrame:
    """Write examples to the shared folder and read them back; prefixes repeat,
    so they are packed by zstd."""
    return materialise(examples, "chat-examples", "zstd")


def example_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"),
                        unescape_text(F.substr(body, F.length(role) + 2)).alias("text"))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def example_reply(formatted: Column, start: Column, chars: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape_text(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))


def read_examples(examples: DataFrame) -> DataFrame:
    """Examples -> for each conversation its turns' and replies' digests."""
    turns = example_turns(F.col("formatted"))
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    read = examples.select(
        "conversation", "example", F.length("formatted").cast("long").alias("chars"),
        example_reply(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("reply"),
        F.when(F.col("complete"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("complete"), F.sha2(F.array_join(F.transform(turns, line), ""), 256)).alias("turns_sha256"))
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))),
                                       lambda x: x["reply"]), "")
    return (read.groupBy("conversation").agg(
                F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
                replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
            .select("conversation", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
