"""Chat formatting: turn order by a finite-state machine, text segments with loss flags.

The template is data: for each role the text before and after a turn, and
whether the turn's own text counts for the loss. Control strings cannot occur
inside a turn, since ``<``, ``>`` and the backslash are escaped there, as
``\\l``, ``\\g`` and ``\\b``; undoing first the others, then ``\\b`` gives the
text back. Marks are checked when a template is made: they must begin with ``<``
and end with ``>``, no mark before a turn may begin another one, and a role's
place is in the mark before it, closed by ``>``, so any template can be read back.

The formatted text comes with its loss mask, the spans that count for the loss
in code points; what is read back under the mask is cut out of the text by these
spans, not guessed from roles.

Turns are ordered by turn number (null last), then role and text, so ties and
repeated rows have one order. A null or empty text is empty; a null role is the
empty role. Roles that the template does not know are written by its rule for
others, without loss. A conversation that breaks the turn order is formatted
all the same and marked ``valid = false``. An empty table gives no rows; extra
columns are not read. The formatted text of one conversation is one value, so a
conversation has to fit into a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role's turns are written; ``{role}`` stands for the escaped role."""

    before: str = "<turn {role}>"
    after: str = "</turn>"
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: tuple[tuple[str, Turn], ...] = (("system", Turn()), ("user", Turn()), ("assistant", Turn(loss=True)))
    others: Turn = Turn()

    def __post_init__(self):
        starts = []
        for role, turn in (*self.roles, (None, self.others)):
            marks = (*turn.before.split("{role}", 1), turn.after)
            inner = "".join(marks)
            if not (turn.before.startswith("<") and turn.before.endswith(">") and turn.after.startswith("<") and turn.after.endswith(">")) or "\\" in inner:
                raise ValueError(f"marks of {role or 'other'} turns must be in angle brackets, without backslashes")
            if role is None and "{role}" not in turn.before:
                raise ValueError("the mark of other turns must name the role")
            starts.append(turn.before.replace("{role}", role if role is not None else "{role}"))
        for a in starts:
            if any(a != b and b.startswith(a) for b in starts):
                raise ValueError(f"{a} begins another mark")


#: State and role, then the next state. A conversation is valid if it ends in a state of ``FINAL``.
MACHINE = {
    ("start", "system"): "ready", ("start", "user"): "asked",
    ("ready", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
FINAL = ("answered",)


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def end_state(roles: Column, machine: dict[tuple[str, str], str] | None = None) -> Column:
    """The machine's state after the array ``roles``; ``broken`` once no step fits."""
    steps = F.create_map(*(F.lit(x) for (state, role), to in (machine or MACHINE).items() for x in (f"{state} {role}", to)))
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.element_at(steps, F.concat(state, F.lit(" "), role)), F.lit("broken")))


def segments(turns: DataFrame, template: Template | None = None, machine: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """conv_id, segments (array of text and loss flag), roles and valid, per conversation.

    Joined in order, the texts are the formatted conversation. Each turn gives
    three segments: the marks around it never count for the loss.
    """
    template = template or Template()
    role = F.coalesce("role", F.lit(""))
    known = [name for name, _ in template.roles]

    def of(part: str) -> Column:
        out = F.when(~role.isin(known), F.lit(getattr(template.others, part)))
        for name, turn in template.roles:
            out = out.when(role == name, F.lit(getattr(turn, part)))
        return out

    def mark(part: str) -> Column:
        return F.replace(of(part), F.lit("{role}"), escape(role))

    body = F.struct(escape(F.coalesce("text", F.lit(""))).alias("text"), of("loss").alias("loss"))
    around = [F.struct(mark(part).alias("text"), F.lit(False).alias("loss")) for part in ("before", "after")]
    order = [F.col("turn").isNull().alias("unplaced"), F.col("turn").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    turn = F.struct(*order, F.array(around[0], body, around[1]).alias("parts"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    return grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: t["parts"])).alias("segments"),
        roles.alias("roles"),
        end_state(roles, machine).isin(list(FINAL)).alias("valid"),
    )


def formatted(parts: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (the spans that count, in code points) and valid from ``segments``."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    sizes = F.transform("segments", lambda s: F.struct(F.length(s["text"]).alias("size"), s["loss"].alias("loss")))
    # Turns are three segments each, the middle one its text, so places are sums over turns.
    ends = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["size"]).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], acc["at"].cast("string"), F.lit(":"), (acc["at"] + s["size"]).cast("string"), F.lit(","))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    pairs = F.filter(F.split(ends, ","), lambda x: x != "")
    loss = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("start"), F.substring_index(x, ":", -1).cast("int").alias("stop")))
    return parts.select("conv_id", text.alias("formatted"), loss.alias("loss"), "valid")


def read_back(texts: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, valid, turns (array of role and text) and kept (the text under the loss mask).

    ``<`` and ``>`` occur in marks only, so a turn is a mark, a text without
    angle brackets, and another mark; the template tells which role it names.
    """
    template = template or Template()
    turns = (*template.roles, (None, template.others))

    def literal(mark: str) -> str:
        return "".join("\\" + c if c in r".^$|?*+()[]{}-&~#" else c for c in mark)

    marks = {(t.before.replace("{role}", "\0" if role is None else role), t.after) for role, t in turns}
    pattern = "|".join(literal(b).replace("\0", "[^<>]*") + "[^<>]*" + literal(a) for b, a in sorted(marks, key=lambda m: "\0" in m[0]))
    pieces = F.regexp_extract_all("formatted", F.lit(f"(?s){pattern}"), 0)

    def parse(piece: Column) -> Column:
        role = text = F.lit(None).cast("string")
        for name, turn in reversed(turns):
            if name is None:
                head, tail = turn.before.split("{role}", 1)
                rest = F.substring(piece, F.lit(len(head) + 1), F.length(piece))
                role = unescape(F.substring_index(rest, tail, 1))
                body = F.substring(rest, F.length(F.substring_index(rest, tail, 1)) + len(tail) + 1, F.length(rest))
                text = F.substring(body, F.lit(1), F.length(body) - len(turn.after))
            else:
                mark = turn.before.replace("{role}", name)
                own = piece.startswith(mark) & piece.endswith(turn.after)
                role = F.when(own, F.lit(name)).otherwise(role)
                text = F.when(own, F.substring(piece, F.lit(len(mark) + 1), F.length(piece) - len(mark) - len(turn.after))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    kept = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), "")
    return texts.select("conv_id", "formatted", "valid", F.transform(pieces, parse).alias("turns"), kept.alias("kept"))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation with the digests of what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("kept").cast("long").alias("loss_chars"),
        F.sha2("kept", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
