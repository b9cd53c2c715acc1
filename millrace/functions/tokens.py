"""Token arrays of completions as Column expressions: what stands before the stop, how long the thinking is, which letter scores best."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.letters import final_letter


def stop_ids(configured: int | Iterable[int] | None, own: int | None) -> list[int]:
    """All ids that end a completion: those of the generation settings and the tokenizer's."""
    named = [] if configured is None else [configured] if isinstance(configured, int) else list(configured)
    return sorted({*named, *([] if own is None else [own])})


def _any_of(x: Column, ids: list[int]) -> Column:
    return x.isin(ids) if ids else F.lit(False)


def hit_the_cap(tokens: Column, stops: list[int]) -> Column:
    """Whether a completion ran out of tokens: no stop in it."""
    return ~F.exists(tokens, lambda x: _any_of(x, stops))


def without_stops(tokens: Column, stops: list[int]) -> Column:
    """The tokens up to the last that is no stop."""
    last = F.coalesce(F.array_max(F.transform(tokens, lambda x, i: F.when(_any_of(x, stops), 0).otherwise(i + 1))), F.lit(0))
    return F.slice(tokens, F.lit(1), last)


def think_length(tokens: Column, think_id: int) -> Column:
    """Tokens before the last end of thinking; all, if thinking never ended."""
    from_end = F.array_position(F.reverse(tokens), F.lit(think_id))
    return (F.size(tokens) - from_end).cast("int")  # a position of 0: there is none


def row_of_tokens(tokens: Column, think_id: int, stops: list[int], decode: Callable[[Column], Column] | None = None, letters: Column | None = None) -> dict[str, Column]:
    """The columns of a scored completion. decode: tokens to text; letters: those of the question; both, or neither for lengths alone."""
    new = without_stops(tokens, stops)
    closed, n, think = F.array_contains(new, think_id), F.size(new), think_length(new, think_id)
    out = {"closed": closed, "new_tokens": n, "think_tokens": think}
    if decode is None:
        return out
    said = decode(F.when(closed, F.slice(new, think + 2, F.greatest(n - think - 1, F.lit(0)))).otherwise(F.slice(new, 1, 0)))
    letter = F.when(closed, final_letter(said, letters))
    return out | {"letter": letter, "forced": letter.isNull(), "text": decode(new)}


def pick_letter(scores: Column, letters: Column) -> Column:
    """The letter of the highest score, the earliest of equal ones. A score that is null, infinite or no number fails the job."""
    finite = F.forall(scores, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    best = F.get(letters, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    return F.when(finite, best).otherwise(F.raise_error(F.lit("a letter's score is not finite")).cast("string"))
