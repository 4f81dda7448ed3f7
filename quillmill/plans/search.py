"""The search language, compiled to a predicate.

A query is words and "quoted phrases", which must occur anywhere in a message, and field:value for from, to, subject,
cc and bcc, whose value must occur in that header; all of one group must hold, groups are separated by OR.  There is
no case, no word boundary, no NOT and no nesting; cc and bcc look into the recipients.  Nothing to look for finds
nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which column a field looks into.
FIELDS = {"from": "from_addr", "to": "to_addr", "subject": "subject", "cc": "to_addr", "bcc": "to_addr"}
#: The columns that words and phrases look into, in the order of the text they are joined to.
TEXT = ("subject", "from_addr", "to_addr", "body")

_LEX = re.compile(r'"(?P<phrase>[^"]*)(?:"|$)|(?P<field>bcc|cc|from|subject|to):(?:"(?P<quoted>[^"]*)(?:"|$)|(?P<value>\S*))|(?P<word>\S+)', re.I)


@dataclass(frozen=True)
class Atom:
    """One condition: field is None for words and phrases."""

    text: str
    field: str | None = None


def parse(query: str) -> list[list[Atom]]:
    """The groups of a query, each a list of atoms; [] for a query without any."""
    groups: list[list[Atom]] = [[]]
    for m in _LEX.finditer(query):
        if m["phrase"] is not None:
            groups[-1].append(Atom(m["phrase"].lower()))
        elif m["field"]:
            groups[-1].append(Atom((m["quoted"] if m["quoted"] is not None else m["value"]).lower(), m["field"].lower()))
        elif m["word"].lower() == "or":
            groups.append([])
        else:
            groups[-1].append(Atom(m["word"].lower()))
    return [g for g in groups if g]


def predicate(query: str, text: Column | None = None, columns: dict[str, Column] | None = None, lowered: bool = False) -> Column:
    """The query as a boolean Column that is never null.

    text: what words look into (the columns of TEXT, joined by line feeds, if not given); columns: headers by name.
    lowered: the columns hold lower-case text already, so that the conditions reach the files' statistics and filters.
    """

    def low(c: Column) -> Column:
        c = F.coalesce(c, F.lit("")) if not lowered else c
        return c if lowered else F.lower(c)

    def header(name: str) -> Column:
        return (columns or {}).get(name, F.col(name))

    everything = low(text if text is not None else F.concat_ws("\n", *[F.coalesce(header(c), F.lit("")) for c in TEXT]))

    def atom(a: Atom) -> Column:
        return (everything if a.field is None else low(header(FIELDS[a.field]))).contains(F.lit(a.text))

    groups = [reduce(lambda x, y: x & y, map(atom, g)) for g in parse(query)]
    return F.coalesce(reduce(lambda x, y: x | y, groups), F.lit(False)) if groups else F.lit(False)


def search(messages: DataFrame, query: str) -> DataFrame:
    """All messages that a query finds; there is no ranking and no limit."""
    return messages.where(predicate(query))
