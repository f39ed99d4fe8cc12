"""Chat formatting: conversations through a compiled template, with a loss mask.

Turns are shuffled by conversation, sorted, and rendered one after the other while they are
read, so that neither a long conversation nor a crowded partition is gathered in memory.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import id_like, map_batches
from marketpulse.llm.templates import compile_template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "<s>{% for m in messages %}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_SEGMENT_ROWS = 256


def escape(text: str) -> str:
    """Doubles backslashes and splits control strings with one after their first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_conversations(
    df: DataFrame,
    template: str = TEMPLATE,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Segments (conv_id, part, text, loss) of every formatted conversation, in ``part`` order.

    Joined segments are the formatted text; those with ``loss`` are what a model is to learn.
    Turns go by number, then role and text (a missing number first); repeated rows are turns
    of their own. Null roles and texts are empty; turns without a conversation id form one
    conversation without an id. The template sees ``messages`` with ``role`` and ``text``.
    """
    name = lambda c: F.col(f"`{c}`")
    turns = df.select(
        name(id_col).alias("conv_id"),
        name(turn_col).alias("turn"),
        F.coalesce(name(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(name(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    render = lambda: compile_template(template, {"escape": escape})

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch[c] for c in ("conv_id", "role", "text")), strict=True)

    def run(batches):
        pieces = render()
        out: list[tuple] = []
        for conv_id, own in groupby(rows(batches), key=lambda r: r[0]):
            messages = ({"role": r[1], "text": r[2]} for r in own)
            for part, (text, loss) in enumerate(pieces({"messages": messages})):
                out.append((conv_id, part, text, loss))
                if len(out) == _SEGMENT_ROWS:
                    yield _columns(out, ("conv_id", "part", "text", "loss"))
                    out = []
        yield _columns(out, ("conv_id", "part", "text", "loss"))

    return map_batches(
        ordered, run, f"conv_id {id_like(turns, 'conv_id')}, part long, text string, loss boolean"
    )


def _columns(rows, names):
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss of conversations in the default template, parsed from their segments.

    One row per conversation: number of turns, digest of role and text of each turn, code
    points and digest of the text under the loss mask, and formatted code points.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def segments(batches):
        for batch in batches:
            yield from zip(*(batch[c] for c in ("conv_id", "text", "loss")), strict=True)

    def run(batches):
        out = []
        for conv_id, own in groupby(segments(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            waiting = ""
            for _, text, marked in own:
                chars += len(text)
                waiting += text
                if marked:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8"))
                while (end := waiting.find("</s>")) >= 0:
                    role, text = waiting[:end].removeprefix("<s>").split("[/INST]")
                    role = unescape(role.removeprefix("[INST]"))
                    turns.update(f"{role}\n{unescape(text)}\n".encode())
                    n_turns += 1
                    waiting = waiting[end + 4 :]
            out.append(
                (conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            )
        yield _columns(out, names)

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return map_batches(
        ordered.select("conv_id", "text", "loss"),
        run,
        f"conv_id {id_like(formatted, 'conv_id')}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long",
    )
