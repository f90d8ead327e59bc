"""Column functions over text: pre-tokens, answers, tool calls, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split pattern of the tokenizer (numbers in groups of two digits).
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def pretokens(text: Column) -> Column:
    """All pre-tokens in order, nothing lost; ``(?U)`` gives blanks their Unicode meaning. Null for null."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


#: The final answer of a word problem, a fenced program, and the texts around a multiple-choice question.
ANSWER_PATTERN, PROGRAM_PATTERN = r"#### (-?[0-9.,]+)", r"(?s)```(?:python)?\s*\n(.*?)\n```"
CHOICES_HEAD, CHOICES_TAIL = "Multiple Choice question: ", "\nRespond only with the letter of the correct answer."


def final_answer(text: Column) -> Column:
    """The number after the first ``#### ``, without commas; null without one."""
    return F.nullif(F.replace(F.regexp_extract(text, ANSWER_PATTERN, 1), F.lit(","), F.lit("")), F.lit(""))


def tool_parts(text: Column) -> Column:
    """Array of (type, text): text between calls, ``python`` and ``python_output`` of each ``<<expr=result>>``."""
    marked = F.split(F.regexp_replace(text, r"(<<[^>]+>>)", "\u0001$1\u0001"), "\u0001")

    def part(x: Column) -> Column:
        inner = F.substring(x, F.lit(3), F.length(x) - 4)
        at = F.length(inner) - F.instr(F.reverse(inner), "=") + 1
        has = F.instr(inner, "=") > 0
        call = F.array(
            F.struct(F.lit("python").alias("type"), F.when(has, F.substring(inner, F.lit(1), at - 1)).otherwise(inner).alias("text")),
            F.struct(F.lit("python_output").alias("type"), F.when(has, F.substring(inner, at + 1, F.length(inner))).otherwise("").alias("text")),
        )
        return F.when(x.rlike(r"^<<[^>]+>>$"), call).otherwise(F.array(F.struct(F.lit("text").alias("type"), x.alias("text"))))

    return F.flatten(F.transform(marked, part))


def program_of(completion: Column) -> Column:
    """The first fenced code block, else the whole text, stripped of blanks at both ends."""
    block = F.regexp_extract(completion, PROGRAM_PATTERN, 1)
    return strip(F.when(completion.rlike(PROGRAM_PATTERN), block).otherwise(completion))


def strip(text: Column) -> Column:
    """Without blanks, as Unicode has them, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def leading_imports(prompt: Column) -> Column:
    """The import lines before the first line that is no import, comment or blank."""
    lines = F.transform(F.split(prompt, "\n"), strip)
    state = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        is_import = line.startswith("import ") | line.startswith("from ")
        stop = acc["stop"] | ((line != "") & ~is_import & ~line.startswith("#"))
        return F.struct(stop.alias("stop"), F.when(is_import & ~stop, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(lines, state, step)["out"], "\n")


def plain_name(name: Column, prefix: str = "_orig_mod.") -> Column:
    """A parameter's name without the prefix that compiling puts before it."""
    return F.when(F.startswith(name, F.lit(prefix)), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def count_letter(word: Column, letter: Column) -> Column:
    """How often a letter stands in a word."""
    return (F.length(word) - F.length(F.replace(word, letter, F.lit("")))).cast("int")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def render_choices(question: Column, letters: Column, choices: Column) -> Column:
    """A multiple-choice question; the letter stands after the choice, without a blank before it."""
    n = F.least(F.size(letters), F.size(choices))
    lines = F.zip_with(F.slice(letters, 1, n), F.slice(choices, 1, n), lambda letter, choice: F.concat(F.lit("- "), choice, F.lit("="), letter, F.lit("\n")))
    return F.concat(F.lit(CHOICES_HEAD), question, F.lit("\n"), F.array_join(lines, ""), F.lit(CHOICES_TAIL))
