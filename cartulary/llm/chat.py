"""Chat formatting: conversations to one string each, with spans that carry the loss.

A finite-state machine over roles says whether the turns come in a legal order; a declarative
template says how a turn is written and whether its text carries loss. Control strings inside a text
are escaped, so a reader can always tell the template's marks from what somebody typed.

Everything is column work: one shuffle on the conversation id, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An escaped text holds neither of the two characters every mark starts with.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


@dataclass(frozen=True)
class Template:
    """How a conversation is written.

    opening, closing   around the whole conversation
    head, tail         around a turn; ``{role}`` stands for the role, which is escaped too
    loss_roles         roles whose text carries loss
    start, moves       the machine: first state, and (state, role) -> state
    final              states a conversation may end in
    """

    opening: str = "<s>"
    closing: str = "</s>"
    head: str = "<turn>{role}<text>"
    tail: str = "<end>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "open"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("open", "system"): "briefed",
            ("open", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if self.head.count("{role}") != 1:
            raise ValueError("the head names the role once")
        marks = (self.opening, self.closing, self.tail, *self.head.split("{role}"))
        if any(mark[:1] not in ("<", "[") for mark in marks):
            raise ValueError("every mark starts with < or [")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _states(roles: Column, template: Template) -> Column:
    """The state after all roles; null once a role had no move."""

    def step(state: Column, role: Column) -> Column:
        moved = F.lit(None).cast("string")
        for (before, by), after in template.moves.items():
            moved = F.when((state == before) & (role == by), F.lit(after)).otherwise(moved)
        return moved

    return F.aggregate(roles, F.lit(template.start), step)


def _legal_turns(roles: Column, template: Template) -> Column:
    """How many turns pass before the first one that has no move."""

    def step(acc: Column, role: Column) -> Column:
        moved = F.lit(None).cast("string")
        for (before, by), after in template.moves.items():
            moved = F.when((acc.state == before) & (role == by), F.lit(after)).otherwise(moved)
        return F.struct(moved.alias("state"), F.when(moved.isNotNull(), acc.n + 1).otherwise(acc.n).alias("n"))

    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"))
    return F.aggregate(roles, start, step, lambda acc: acc.n)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``; other columns are ignored.

    Returns conv_id, n_turns, valid (the machine ends in a final state), legal_turns (turns before the
    first illegal one), formatted, and segments: array of (role, start, length, loss), where start is the
    1-based code point at which the escaped text begins. An illegal conversation is formatted as well;
    the caller decides by ``valid``.

    Defined cases: a null text or role counts as empty; rows with null conv_id are one conversation of
    their own; turns are ordered by (turn, role, text) with null turns first, so ties and repeated rows
    have one order and each stays. No rows give no rows. One conversation is one value: its text must fit
    into a row, whatever the number of rows that share its id. Work grows with the text, not with its square:
    where a turn begins is a running sum over the turns before they are put together.
    """
    before_role, after_role = template.head.split("{role}")
    said = turns.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    written = said.select(
        "*",
        F.concat(F.lit(before_role), escape(F.col("role")), F.lit(after_role)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(template.tail)
    earlier = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (earlier + len(template.opening) + 1 + F.length("head")).cast("int")
    # Places grow from turn to turn, so they are the order of the turns as well.
    placed = written.select("conv_id", F.struct(start.alias("start"), "role", "head", "body").alias("turn"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("parts"))
    segment = F.transform(
        "parts",
        lambda p: F.struct(
            p.role.alias("role"),
            p.start.alias("start"),
            F.length(p.body).alias("length"),
            p.role.isin(*template.loss_roles).alias("loss"),
        ),
    )
    roles = F.transform("parts", lambda p: p.role)
    turns_text = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(template.tail))), "")
    return grouped.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.coalesce(_states(roles, template).isin(*template.final), F.lit(False)).alias("valid"),
        _legal_turns(roles, template).cast("long").alias("legal_turns"),
        F.concat(F.lit(template.opening), turns_text, F.lit(template.closing)).alias("formatted"),
        segment.alias("segments"),
    )


def _pieces(formatted: Column, template: Template) -> Column:
    """The turns of a formatted conversation, each without its tail."""
    inner = F.substring(
        formatted,
        F.lit(len(template.opening) + 1),
        F.length(formatted) - len(template.opening) - len(template.closing),
    )
    # Marks cannot occur inside an escaped text, so plain splitting is exact; the last piece is empty.
    pieces = F.split(inner, _quoted(template.tail), -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns written in a formatted conversation: array of (role, text), unescaped."""
    before_role, after_role = template.head.split("{role}")

    def one(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(before_role) + 1), F.length(piece))
        at = F.instr(body, after_role)
        return F.struct(
            unescape(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(body, at + len(after_role), F.length(body))).alias("text"),
        )

    return F.transform(_pieces(formatted, template), one)


def read_loss(formatted: Column, segments: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, unescaped: array of strings in order.

    A segment is read inside its turn, whose place is known from the segment before it: to count code points from
    the beginning of a long conversation for each of them would take the square of its length.
    """
    ends = F.transform(segments, lambda s: s.start + s.length + len(template.tail))
    begins = F.concat(F.array(F.lit(len(template.opening) + 1)), ends)  # one too many; the shorter array decides below
    turns = F.zip_with(_pieces(formatted, template), begins, lambda piece, at: F.struct(piece.alias("piece"), at.alias("at")))
    texts = F.zip_with(
        segments,
        turns,
        lambda s, t: F.when(s.loss, unescape(F.substring(t.piece, s.start - t.at + 1, s.length))),
    )
    return F.filter(texts, lambda x: x.isNotNull())


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"
