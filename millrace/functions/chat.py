"""Questions, answers and conversations as text and arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.letters import short_explanation
from millrace.functions.text import strip

#: What the system turn says.
SYSTEM_FIRST = "You are a medical education assistant. Answer the multiple-choice question by reasoning briefly from the clinical findings, then stating your choice on a final line in the exact form 'Answer: X'."
SYSTEM_MCQ = "You are a medical education assistant. Work through the question, then give your choice first, on its own line, in the exact form 'Answer: X', followed by a brief explanation."
SYSTEM_CHAT = "You are a medical education assistant. Explain clearly and carefully in plain language. You are not a substitute for a clinician: do not give a definitive diagnosis, and advise the person to seek in-person care when their description warrants it."


def letters_of(options: Column) -> Column:
    return F.array_sort(F.map_keys(options))


def question_text(letters: Column | None = None) -> Column:
    """The question and its options in letter order, one a line; letters: only these."""
    options = F.col("options")
    keys = letters_of(options) if letters is None else F.array_intersect(letters, F.map_keys(options))
    listed = F.transform(keys, lambda k: F.concat(k, F.lit(". "), F.element_at(options, k)))
    is_mcq = (F.col("kind") == "mcq") & options.isNotNull() & (F.size(options) > 0)
    return F.when(is_mcq, F.concat_ws("\n", F.col("question"), F.lit(""), F.array_join(listed, "\n"))).otherwise(F.col("question"))


def rationale_first() -> Column:
    """The target of the first format: the rationale, then the answer."""
    why = strip(F.coalesce("rationale", F.lit("")))
    answer = F.concat(F.lit("Answer: "), F.col("answer"))
    return F.when(F.col("kind") == "dialogue", F.coalesce("response", F.lit(""))).when(why != "", F.concat(why, F.lit("\n\n"), answer)).otherwise(answer)


def letter_first() -> Column:
    """The target of the second format: the answer, then a short explanation or the option's text."""
    head, why = F.concat(F.lit("Answer: "), F.col("answer")), short_explanation("rationale")
    option = F.try_element_at(F.col("options"), F.col("answer"))
    mcq = F.when(why != "", F.concat(head, F.lit("\n\n"), why)).when(F.coalesce(option, F.lit("")) != "", F.concat(head, F.lit(". "), option)).otherwise(head)
    return F.when(F.col("kind") == "mcq", mcq).otherwise(strip(F.coalesce("response", F.lit(""))))


def message(role: str, content: Column, reasoning: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if reasoning is None else reasoning).alias("reasoning_content"))


def messages(with_answer: bool, think: bool | None = None) -> Column:
    """The turns of a record; the user's ends with the switch for thinking."""
    thinks = F.coalesce(F.col("reasoning") != "", F.lit(False)) if think is None else F.lit(think)
    system = F.when(F.col("kind") == "mcq", F.lit(SYSTEM_MCQ)).otherwise(F.lit(SYSTEM_CHAT))
    user = F.concat(question_text(), F.lit("\n\n"), F.when(thinks, "/think").otherwise("/no_think"))
    turns = [message("system", system), message("user", user)]
    if with_answer:
        turns.append(message("assistant", letter_first(), or_empty_null(F.col("reasoning"))))
    return F.array(*turns)


def first_messages(with_answer: bool) -> Column:
    """The turns of a record in the first format: letters A to D, rationale before the answer."""
    letters = F.array(*map(F.lit, "ABCD"))
    turns = [message("system", F.when(F.col("kind") == "mcq", F.lit(SYSTEM_FIRST)).otherwise(F.lit(SYSTEM_CHAT))), message("user", question_text(letters))]
    return F.array(*turns, *([message("assistant", rationale_first())] if with_answer else []))


def or_empty_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def render(turns: Column, generate: bool = False) -> Column:
    """Messages by the default template: <|im_start|>role, content, <|im_end|>; reasoning in a think block."""

    def one(m: Column) -> Column:
        why = F.coalesce(F.concat(F.lit("<think>\n"), m["reasoning_content"], F.lit("\n</think>\n\n")), F.lit(""))
        return F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), why, F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))

    return F.concat(F.array_join(F.transform(turns, one), ""), F.lit("<|im_start|>assistant\n" if generate else ""))


def letter_prompt() -> Column:
    """Thinking off, then 'Answer:': the next token is the choice."""
    return F.concat(render(messages(False, False), True), F.lit("<think>\n\n</think>\n\nAnswer:"))


def reasoning_prompt() -> Column:
    return render(messages(False, True), True)


def forced_suffix(closed: Column) -> Column:
    """What makes the next token the letter; an open think block is closed first."""
    return F.when(closed, F.lit("\n\nAnswer:")).otherwise(F.lit("\n</think>\n\nAnswer:"))
