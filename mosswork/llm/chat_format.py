"""Chat formatting by event-sourced reconstruction (native).

A log holds events of conversations: `message` starts a message, `delta` appends to it, `edit`
replaces its text, `regenerate` discards what it held and everything later, starting anew; of several
messages of one name they are about the last, and without one they start it. Events
are partitioned by conversation, sorted by sequence, folded into final messages and rendered. Every conversation is folded, plain ones too.

Everything is DataFrame functions. The only shuffle brings a conversation's events together; a
rendered conversation is one value, so its rows have to meet, but texts are escaped before the
shuffle and only deltas of one message are folded.

Template: a turn is ``<s>role\\ntext</s>``. Control strings (<s>, </s>, [INST], [/INST]) inside roles
and texts are escaped by a caret after their first character; carets are doubled first, so the
escape is reversible for any string.

Defined cases: null text, role or kind is empty text, an empty role, a `message`; a null sequence
sorts first; ties of sequence are ordered by kind, role, text as they are written (escaped); null conversation ids form one
conversation; of equal events each counts; a very long conversation or text costs in proportion, but for events about earlier messages, each
of which copies the list of messages; an empty log gives no conversation; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, only, running

OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\^(/?(?:s>|INST\]))"
#: Stands for a newline inside a role; no escaped string holds a single caret before an n.
NEWLINE = "<^n>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("^"), F.lit("^^")), CONTROL, "$1^$2")


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, ESCAPED, "$1$2"), F.lit("^^"), F.lit("^"))


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"<\^n>", "\n"))


def _runs(events: Column) -> Column:
    """Sorted events with deltas that directly follow an event of their message written into it."""
    heads = F.filter(F.sequence(F.lit(0), F.size(events) - 1), lambda i: (i == 0) | (F.get(events, i).kind != "delta") | (F.get(events, i).message != F.get(events, i - 1).message))

    def run(h: Column, i: Column, e: Column) -> Column:
        first, last = F.get(events, i), F.coalesce(F.get(h, e), F.size(events))
        return F.struct(first.kind.alias("kind"), first.message.alias("message"), first.role.alias("role"), F.array_join(F.transform(F.slice(events, i + 1, last - i), lambda x: x.text), "").alias("text"))

    return bound(heads, lambda h: F.transform(h, lambda i, k: run(h, i, k + 1)))


def _fold(runs: Column) -> Column:
    """The final messages. Each step takes one event about an earlier message, if any, and all plain messages up to the next such
    event, so a step costs a copy of the list and there are as many steps as such events."""
    kind = "array<struct<message:string,role:string,text:string>>"
    plain = lambda e: F.struct(e.message.alias("message"), e.role.alias("role"), e.text.alias("text"))
    starts = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: (i == 0) | (F.get(runs, i).kind != "message"))
    steps = bound(starts, lambda st: F.transform(st, lambda i, k: F.struct(F.get(runs, i).alias("e"), F.slice(runs, i + 2, F.coalesce(F.get(st, k + 1), F.size(runs)) - i - 1).alias("rest"))))

    def step(acc: Column, x: Column) -> Column:
        e, rest = x.e, F.transform(x.rest, plain)
        back = F.array_position(F.reverse(F.transform(acc, lambda m: m.message)), e.message)
        at = F.when((e.kind == "message") | (back == 0), 0).otherwise(F.size(acc) - back.cast("int") + 1)

        def done(at: Column) -> Column:
            old = F.get(acc, at - 1)
            new = F.struct(e.message.alias("message"), F.when(e.kind == "regenerate", e.role).otherwise(old.role).alias("role"), F.when(e.kind == "delta", F.concat(old.text, e.text)).otherwise(e.text).alias("text"))
            later = F.when(e.kind == "regenerate", F.array().cast(kind)).otherwise(F.slice(acc, at + 1, F.size(acc)))
            return F.when(at == 0, F.concat(acc, F.array(plain(e)), rest)).otherwise(F.concat(F.slice(acc, F.lit(1), at - 1), F.array(new), later, rest))

        return bound(at, done)

    return F.aggregate(steps, F.array().cast(kind), step)


def reconstruct(log: DataFrame, conv="conv_id", seq="turn", role="role", text="text", kind: str | None = None, message: str | None = None) -> DataFrame:
    """conv_id, messages: array<struct<role,text>>, role and text escaped, in order. `message` names
    the message that a delta, edit or regeneration is about; by default the row's own sequence."""
    log = only(log, conv_id=conv, seq=seq, role=role, text=text, kind=kind or role, message=message or seq)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    log = log.select(
        "conv_id",
        F.struct(
            "seq",
            (F.coalesce(F.lower("kind"), F.lit("message")) if kind else F.lit("message")).alias("kind"),
            F.replace(escape(empty("role")), F.lit("\n"), F.lit(NEWLINE)).alias("role"),
            escape(empty("text")).alias("text"),
            empty("message").alias("message"),
        ).alias("e"),
    )
    events = log.groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("events"))
    runs = events.select("conv_id", _runs(F.col("events")).alias("runs"))
    return runs.select("conv_id", F.transform(_fold(F.col("runs")), lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))).alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted; loss_spans: start and length, in code points of `formatted`, of each
    assistant text, which a trainer's loss mask covers."""
    turn = lambda m: F.concat(F.lit(OPEN), m.role, F.lit("\n"), m.text, F.lit(CLOSE))
    around = len(OPEN) + len(CLOSE) + 1
    sizes = F.transform("messages", lambda m: F.length(m.role) + F.length(m.text) + around)
    # a text ends where its turn's mark begins; ends of turns are running totals, so a conversation of any length costs its logarithm in passes
    told = lambda ends: F.transform(
        F.filter(F.transform("messages", lambda m, i: F.struct(m.role.alias("role"), (F.get(ends, i) - len(CLOSE) - F.length(m.text)).alias("start"), F.length(m.text).alias("length"))), lambda x: x.role == "assistant"),
        lambda x: F.struct(x.start.alias("start"), x.length.alias("length")),
    )
    spans = bound(running(sizes, lambda x, y: x + y), told)
    return conversations.select("conv_id", F.array_join(F.transform("messages", turn), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read back: conv_id, turns (role, text, unescaped), loss (all text under the loss mask)."""
    rest = lambda x, at: F.substring(x, at, F.length(x))
    body = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    turns = F.transform(
        F.transform(body, lambda x: rest(x, F.lit(len(OPEN) + 1))),
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(rest(x, F.instr(x, "\n") + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
