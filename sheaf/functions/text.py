"""Text expressions: tokens, keyword rules, chunks, prompts, JSON repair."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.schemas import EFFICIENCY_PHRASES, RELEVANCE_STEMS

# Maximal runs of two or more word characters, in any script.
TERM = r"([\p{L}\p{N}_]{2,})"
TABLE_ROW = "\t\t\t"
TERM_BUCKETS = 16_384


class ExampleTemplate(NamedTuple):
    """The parts of a training example; ``asked`` holds {chunk} and {memory}."""

    intro: str = (
        "Below is a chunk of a research paper with the record extracted so far. "
        "Update the record with what the chunk says."
    )
    asked: str = "### Instruction:\nchunk: {chunk}\nmemory: {memory}"
    response_key: str = "### Output:"
    end_key: str = "### End"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def term_frequency(text: Column, names: Sequence[str] = RELEVANCE_STEMS) -> Column:
    """How many whitespace tokens equal one of ``names`` (lower-cased)."""
    return F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.isin(*names)))


def keyword_rule(
    text: Column,
    names: Sequence[str] = RELEVANCE_STEMS,
    phrases: Sequence[str] = EFFICIENCY_PHRASES,
    more_than: int = 2,
) -> Column:
    """A name and a phrase occur, and the names occur often enough as tokens."""
    low = F.lower(text)

    def any_of(needles: Sequence[str]) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        return hit

    return any_of(names) & any_of(phrases) & (term_frequency(text, names) > more_than)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_chunk(line: Column, position: Column) -> Column:
    """Lines worth scoring: not the first, not blank, not a table row."""
    return (position > 0) & line.rlike(r"\S") & ~line.startswith(TABLE_ROW)


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(words(text), 1, limit), " ")


def prompt(system: str, user: Column, limit: int = 16_000) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system)), message("user", truncate_tokens(user, limit))
    )


def training_example(
    chunk: Column, memory: Column, output: Column, template: ExampleTemplate = ExampleTemplate()
) -> Column:
    """Intro, request, answer and end mark, a blank line between them."""
    given = {"chunk": chunk, "memory": memory}
    parts = re.split(r"\{(chunk|memory)\}", template.asked)
    asked = F.concat(*[given[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    answer = F.concat(F.lit(template.response_key + "\n"), output)
    return F.concat_ws("\n\n", F.lit("\n" + template.intro), asked, answer, F.lit(template.end_key))


def brace_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def strip_fence(text: Column, marker: str = "```json") -> Column:
    """Text after the first fence marker, narrowed to its brace span."""
    inner = F.split(text, marker, -1)[1]
    return F.when(text.contains(marker), F.coalesce(brace_span(inner), inner)).otherwise(text)


# A double quote inside a text. One that delimits follows "{" or a blank, or
# precedes ":" or "}" or a comma that opens the next quoted part.
_OPENS_NEXT = r', "(?!:)|,\{"|,":'
_INNER_QUOTE = rf'(?<![{{ ])"(?!:|\}}|{_OPENS_NEXT})'
# Fixed value: a quoted value behind its key, with any white space between them.
_SPACED_VALUE = r'":\s*"([^"]*?)"'


def _drop_quoted_colons(line: Column) -> Column:
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.when(
                (i % 2 == 1) & (i < last), F.replace(part, F.lit(":"), F.lit(""))
            ).otherwise(part),
        ),
        '"',
    )


def repair_json(text: Column) -> Column:
    """Turn almost-JSON into JSON where a fixed chain of rewrites can."""
    t = strip_fence(text)
    t = F.replace(t, F.lit("None"), F.lit("null"))
    t = F.replace(t, F.lit("'"), F.lit('"'))
    t = F.regexp_replace(t, _SPACED_VALUE, '": "$1"')
    t = F.regexp_replace(t, _INNER_QUOTE, "'")
    t = F.array_join(F.transform(F.split(t, "\n", -1), _drop_quoted_colons), "\n")
    return F.replace(t, F.lit("treated_pec"), F.lit("treated_pce"))


def quoted(text: Column) -> Column:
    """A text as JSON string; null is ``"null"``, as a key that is none."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit("null"))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()
