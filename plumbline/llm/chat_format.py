"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template names the strings around a turn and the roles that carry loss. A conversation becomes
text segments (start mark, role, text, end mark), each with a loss flag; only the escaped text of a
loss-bearing role has it set. Control strings inside texts and roles are escaped reversibly: of the
escape character and of the first character of each control string every occurrence becomes a
two-character code, so no control string can occur in escaped text and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    end: str = "</s>"
    turn_start: str = "[INST]"
    role_end: str = "[/INST]"
    turn_end: str = "[END]\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    #: The machine: state -> {role: next state}; what has no entry is an error, and errors stay.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered", "asked")

    def codes(self) -> list[tuple[str, str]]:
        """(character, code): the escape character first."""
        firsts = sorted({s[0] for s in (self.begin, self.end, self.turn_start, self.role_end, self.turn_end)})
        return [(self.escape, self.escape + "a")] + [(c, self.escape + "bcdefgh"[k]) for k, c in enumerate(firsts)]


TEMPLATE = Template()


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    for char, code in template.codes():
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    for char, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _final_state(roles: Column, template: Template) -> Column:
    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for at, moves in template.machine.items():
            for who, then in moves.items():
                out = F.when((state == at) & (role == who), F.lit(then)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, turn, role, text`` to one row for each conversation: ``conv_id, formatted, loss_spans, valid``.

    ``loss_spans`` has (start, length) in code points of the formatted string for every segment
    under the loss mask, in order; ``valid`` tells whether the roles follow the machine (an invalid
    conversation is formatted all the same). A null text or role is the empty string; rows of one
    turn are ordered by role and text; repeated rows are turns like any other; a null ``conv_id``
    is one conversation. Extra columns are ignored; an empty table gives no rows.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    loss = lambda t: t["role"].isin(*template.loss_roles)
    head = lambda t: F.concat(F.lit(template.turn_start), escaped(t["role"], template), F.lit(template.role_end))
    segments = F.flatten(
        F.concat(
            F.array(F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))),
            F.transform(
                "t",
                lambda t: F.array(
                    F.struct(head(t).alias("text"), F.lit(False).alias("loss")),
                    F.struct(escaped(t["text"], template).alias("text"), loss(t).alias("loss")),
                    F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")),
                ),
            ),
            F.array(F.array(F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))),
        )
    )
    convs = convs.select("conv_id", segments.alias("segments"), _final_state(F.transform("t", lambda t: t["role"]), template).isin(*template.accepting).alias("valid"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "segments",
        start,
        lambda a, s: F.struct(
            (a["at"] + F.length(s["text"])).alias("at"),
            F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"), "valid")


def read_back(convs: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text``, parsed from ``formatted`` and ``loss_spans``."""
    body = F.substr("formatted", F.lit(len(template.begin) + 1), F.length("formatted") - len(template.begin) - len(template.end))
    quoted = lambda s: "\\Q" + s + "\\E"
    parts = F.filter(F.split(body, quoted(template.turn_end)), lambda x: x != "")
    split = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(template.turn_start) + 1), F.length(p)), quoted(template.role_end), 2))
    turns = F.transform(split, lambda p: F.struct(unescaped(p[0], template).alias("role"), unescaped(p[1], template).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"], s["length"]), template)), "")
    return convs.withColumn("turns", turns).withColumn("loss_text", loss)


#: A conversation whose texts are control strings; it is formatted beside the table's own.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def digests(convs: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, derived from what is read back."""
    back = read_back(convs)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
