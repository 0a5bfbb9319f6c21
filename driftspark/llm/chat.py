"""Chat formatting by a finite-state machine over roles, with DataFrame functions only.

A template (plain data) names the marks around a turn, the transitions between roles and the roles whose text bears
loss. A conversation's turns, in order of ``turn`` (equal ones by role, then text), become segments: the turn's head,
its text and its tail, each with a loss flag; only texts of loss roles have it set. The machine runs over the roles; a
conversation that it rejects is formatted all the same and has ``valid`` false.

Control strings inside texts and roles are escaped: after ``<``, a backslash is put before any backslashes that end in
``|``. So a written text never holds ``<|``, and taking one backslash away gives it back. In roles, backslashes and line
breaks are escaped too, so a head's line break ends the role. ``parse`` and ``loss_text`` read the turns and the loss
text back from what was written.

Null texts and roles are empty strings. Repeated rows are turns of their own. Rows with a null conversation id make up
one conversation. Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks must begin with ``<|``, which escaped text never holds; ``transitions`` has the states that may follow a state, by role."""

    start: str = "<|im_start|>"
    head_end: str = "\n"
    end: str = "<|im_end|>"
    after: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    final: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"begin": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
    )

    def __post_init__(self) -> None:
        if not (self.start.startswith("<|") and self.end.startswith("<|") and self.start != self.end and self.head_end == "\n"):
            raise ValueError("the marks must differ and begin with <|, and a head must end with a line break")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # at each escaped backslash
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def accepted(roles: Column, template: Template) -> Column:
    """Whether the machine, started anew, takes all ``roles`` and ends in a final state."""
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, following in template.transitions.items() for b in following])
    step = lambda state, role: F.when(F.array_contains(allowed, F.concat(state, F.lit("\n"), role)), role).otherwise(F.lit("\n"))
    return F.aggregate(roles, F.lit(template.initial), step).isin(*template.final)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id``, ``valid``, ``segments`` (array of text and loss) and ``formatted``, a row for each conversation."""
    template = template or Template()
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    in_order = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def segments(x: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.start), _escape_role(x.role), F.lit(template.head_end)), F.lit(False)),
            piece(escape(x.text), x.role.isin(*template.loss_roles)),
            piece(F.lit(template.end + template.after), F.lit(False)),
        )

    return in_order.select(
        "conv_id",
        accepted(F.col("said.role"), template).alias("valid"),
        F.flatten(F.transform("said", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role and text) read back from a formatted conversation."""
    template = template or Template()
    quoted = "".join("\\" + c if not c.isalnum() else c for c in template.start)
    parts = F.slice(F.split(formatted, quoted), 2, 2_000_000_000)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.head_end, 1)
        body = F.substr(part, F.length(role) + len(template.head_end) + 1, F.length(part) - F.length(role) - len(template.head_end + template.end + template.after))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back of each formatted conversation, as counts and SHA-256."""
    turns = parse(F.col("formatted"), template)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = loss_text(F.col("segments"))
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
