"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, adjacent
turns of one role are merged by an array aggregation, and the messages are
concatenated under a template::

    <s>                                    start of the conversation
    [SYS]body[/SYS]                        role system
    [INST]body[/INST]                      role user
    body</s>                               role assistant
    [ROLE]role[/ROLE]body[END]             any other role

A body holds its turns' texts, separated by ``[NEXT]``. Inside texts a
backslash is doubled and every control string gets a backslash after its first
character, so markers stand only where the template puts them and ``parse``
gives every turn back. The loss mask is a list of code point ranges: the
assistant texts, without markers.

Defined cases: null text or role counts as empty; a null turn sorts first; ties
in turn sort by role, then text; repeated rows are separate turns; a null
conv_id is a conversation of its own; other columns are ignored. The cost grows
with the turns and the text of a conversation (offsets: n log n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|NEXT\]|END\])"
MESSAGE_ENDS = r"(?<=\[/INST\]|\[/SYS\]|\[END\]|</s>)"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _merge(turns: Column) -> Column:
    """Adjacent turns of one role as one message (role, texts): the places where
    a role begins are found, the turns between two of them are a message."""
    def cut(t):
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return _let(begins, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(t, i)["role"].alias("role"),
            F.transform(F.slice(t, i + 1, F.coalesce(F.get(at, k + 1), F.size(t)) - i), lambda x: x["text"]).alias("texts"))))

    return _let(turns, cut)


def _running(lengths: Column) -> Column:
    """Inclusive running sums in steps of growing distance: after a step with
    distance d every place holds the sum of the last 8d values, so the cost is
    n log n for any number of pieces."""
    def widened(distance):
        def step(a):
            return F.when(F.size(a) > distance, F.transform(a, lambda x, i: sum(
                (F.coalesce(F.get(a, i - k * distance), F.lit(0)) for k in range(1, 8)), x))).otherwise(a)
        return step

    distance = 1
    while distance < 1 << 31:  # an array holds fewer values
        lengths, distance = _let(lengths, widened(distance)), distance * 8
    return lengths


def _pieces(message: Column) -> Column:
    """A message as template pieces: (text, loss)."""
    role = message["role"]
    opening = (F.when(role == "system", "[SYS]").when(role == "user", "[INST]").when(role == "assistant", "")
               .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))))
    closing = (F.when(role == "system", "[/SYS]").when(role == "user", "[/INST]").when(role == "assistant", "</s>")
               .otherwise("[END]"))

    def piece(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    body = F.flatten(F.transform(message["texts"], lambda t, i: F.when(
        i == 0, F.array(piece(escape(t), role == "assistant"))).otherwise(
            F.array(piece(F.lit("[NEXT]"), no), piece(escape(t), role == "assistant")))))
    return F.concat(F.array(piece(opening, no)), body, F.array(piece(closing, no)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; ``loss`` holds
    code point ranges (start from 0, length) of ``formatted``."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pieces = sorted_turns.select("conv_id", _merge(F.col("t")).alias("m")).select(
        "conv_id", F.flatten(F.transform("m", _pieces)).alias("p"))
    ends = _running(F.transform("p", lambda x: F.char_length(x["text"]).cast("long")))
    spans = _let(ends, lambda end: F.filter(F.transform("p", lambda x, i: F.struct(
        x["loss"].alias("loss"), (F.coalesce(F.get(end, i - 1), F.lit(0)) + 3).alias("start"), F.get(end, i).alias("end"))), lambda x: x["loss"]))
    loss = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["end"] + 3 - x["start"]).alias("length")))
    return pieces.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("p", lambda x: x["text"]), "")).alias(
        "formatted"), loss.cast(SPANS).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, texts unescaped."""
    messages = F.filter(F.split(F.substring(formatted, 4, 2147483647), MESSAGE_ENDS, -1), lambda m: m != "")

    def inner(message, opening, closing):
        return message.substr(
            F.lit(len(opening) + 1), F.char_length(message) - len(opening) - len(closing))

    def read(message):
        other = F.split(message, r"\[/ROLE\]", 2)
        role = (F.when(message.startswith("[SYS]"), "system").when(message.startswith("[INST]"), "user")
                .when(message.startswith("[ROLE]"), unescape(other[0].substr(F.lit(7), F.char_length(other[0]))))
                .otherwise("assistant"))
        body = (F.when(message.startswith("[SYS]"), inner(message, "[SYS]", "[/SYS]"))
                .when(message.startswith("[INST]"), inner(message, "[INST]", "[/INST]"))
                .when(message.startswith("[ROLE]"), inner(F.get(other, F.lit(1)), "", "[END]"))
                .otherwise(inner(message, "", "</s>")))
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, read)).cast(TURNS)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped. The text is cut once in blocks of
    1024 code points, a span reads its own blocks: a place far into a long text
    costs no walk from its beginning."""
    block = 1024

    def read(blocks):
        def span(s):
            first = F.floor(s["start"] / block)
            own = F.slice(blocks, (first + 1).cast("int"), (F.floor((s["start"] + s["length"]) / block) - first + 1).cast("int"))
            return unescape(F.array_join(own, "").substr((s["start"] - first * block + 1).cast("int"), s["length"].cast("int")))
        return F.transform(loss, span)

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), read)
