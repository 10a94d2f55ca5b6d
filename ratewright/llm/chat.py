"""Conversations formatted by a compiled template, with the spans a model is trained on.

Turns are brought together and ordered by Spark; each conversation then streams through the template, so even one that
holds a third of all rows needs no more memory than a turn. The result has one row per piece of output: the conversation's
text is its pieces in order, and pieces of `{% generation %}` blocks are marked. `read_back` parses the text into turns
again and digests it.

Control strings inside texts are escaped by a backslash after their first character, and backslashes are doubled, so no
text can end or open a turn and every text can be read back. Null texts and roles are empty. Turns of equal number are
ordered by role and text; turns without a number come first; rows without a conversation id form one conversation. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import compile_template

# The control strings. Each begins with a character that no other place of a control string has.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/TEXT]")
TEMPLATE = """
{%- for message in messages -%}
{%- if message.role == "user" -%}
[INST]{{ message.text | escape }}[/INST]
{%- elif message.role == "assistant" -%}
<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>
{%- else -%}
[ROLE]{{ message.role | escape }}[TEXT]{{ message.text | escape }}[/TEXT]
{%- endif -%}
{%- endfor -%}
"""

OPENS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str | None) -> str:
    return OPENS.sub(lambda m: m[0] + "\\", (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def trimmed(template: str) -> str:
    """`{%-` and `-%}` take the white space beside them away."""
    return re.sub(r"-%\}\s*", "%}", re.sub(r"\s*\{%-", "{%", template))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False, name=None)


def _batches(rows: Iterator[tuple], columns: list[str], at_most: int = 4_096, chars: int = 8_000_000) -> Iterator[pd.DataFrame]:
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += sum(len(v) for v in row if isinstance(v, str))
        if len(waiting) >= at_most or held >= chars:
            yield pd.DataFrame(waiting, columns=columns)
            waiting, held = [], 0
    if waiting:
        yield pd.DataFrame(waiting, columns=columns)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Pieces of formatted conversations: conv (the id as text), piece (from 0), text, generated.

    The pieces of a conversation stand together and in order.
    """
    source = trimmed(template)
    compile_template(source, {"escape": escape})  # a faulty template fails here

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rendered = compile_template(source, {"escape": escape})

        def pieces() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in turns)
                number = 0
                for text, generated in rendered({"messages": messages}):
                    if text:
                        yield conv, number, text, generated
                        number += 1

        return _batches(pieces(), ["conv", "piece", "text", "generated"])

    turns = rows.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return ordered.mapInPandas(render, "conv string, piece bigint, text string, generated boolean")


class Reader:
    """Reads the turns of one conversation back from pieces of its text."""

    def __init__(self):
        self.rest = ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def _closing(self, control: str, after: int) -> int:
        return self.rest.find(control, after)

    def _turn(self, role: str, text: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))

    def add(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        if generated:
            original = unescape(text)
            self.loss_chars += len(original)
            self.loss.update(original.encode("utf-8", "surrogatepass"))
        self.rest += text
        while self._take():
            pass

    def _take(self) -> bool:
        """Takes one whole turn off the text, if there is one."""
        for start, end, role in (("[INST]", "[/INST]", "user"), ("<s>", "</s>", "assistant")):
            if self.rest.startswith(start):
                at = self._closing(end, len(start))
                if at < 0:
                    return False
                self._turn(role, unescape(self.rest[len(start) : at]))
                self.rest = self.rest[at + len(end) :]
                return True
        if self.rest.startswith("[ROLE]"):
            middle = self._closing("[TEXT]", 6)
            at = self._closing("[/TEXT]", middle + 6) if middle >= 0 else -1
            if at < 0:
                return False
            self._turn(unescape(self.rest[6:middle]), unescape(self.rest[middle + 6 : at]))
            self.rest = self.rest[at + 7 :]
            return True
        return False

    def result(self, conv: str | None) -> tuple:
        if self.rest:
            raise ValueError("the text does not end with a whole turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its text says: number and digest of turns, length and digest of the text under the loss mask
    (escapes removed), and code points of the text. Takes the result of `format_conversations` as it comes."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for conv, own in groupby(_rows(batches), key=lambda r: r[0]):
                reader = Reader()
                for _, _, text, generated in own:
                    reader.add(text, generated)
                yield reader.result(conv)

        return _batches(rows(), [c.split()[0] for c in DIGESTS.split(", ")])

    return pieces.mapInPandas(digest, DIGESTS)
