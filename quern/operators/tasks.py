"""Task views: multiple choice, in-context-learning prompts, spelling, mixtures, grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import characters, count_letter, final_answer, strip
from quern.operators.order import running, seeded_order

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Ways to ask for a letter count.
TEMPLATES = [
    "How many {letter} are in the word {word}", "How many {letter} are in {word}", "Count the number of {letter} in {word}", "How many times does {letter} appear in {word}", "What's the count of {letter} in {word}", "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}", "Count how many {letter} appear in {word}", "Tell me the number of {letter} in {word}", "How many occurrences of {letter} are in {word}", "Find the count of {letter} in {word}", "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}", "How many {letter}s are in {word}", "How many {letter}'s are in {word}", "Count all the {letter} in {word}", "How many times is {letter} in {word}", "Number of {letter} in {word}", "Total count of {letter} in {word}",
    "How many {letter} does {word} have", "How many {letter} does {word} contain", "What's the number of {letter} in {word}", "{word} has how many {letter}", "In {word}, count the {letter}", "How many {letter} appear in {word}", "Count the {letter} in {word}", "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}", "Show me how many {letter} are in {word}", "Calculate the number of {letter} in {word}", "¿Cuántas {letter} hay en {word}?", "¿Cuántas veces aparece {letter} en {word}?", "Cuenta las {letter} en {word}", "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}", "{word}里有几个{letter}", "数一下{word}中的{letter}", "{word}这个词里有多少{letter}", "{word}에 {letter}가 몇 개 있나요", "{word}에서 {letter}의 개수는", "{word}에 {letter}가 몇 번 나오나요", "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}", "Combien de fois {letter} apparaît dans {word}", "Compte les {letter} dans {word}", "Wie viele {letter} sind in {word}", "Wie oft kommt {letter} in {word} vor", "Zähle die {letter} in {word}", "{word}に{letter}は何個ありますか", "{word}の中に{letter}がいくつ", "{word}に{letter}が何回出てくる",
]


def pick(seed: str, key: Column, n: int) -> Column:
    """A number below ``n`` from the hash of a seed and a key; the same in every engine with MD5."""
    return (_roll(seed, key) % n).cast("int")


def mixture(tasks: list[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """All rows of all tasks in a seeded order; a task given twice counts twice. Adds task_idx and position."""
    marked = [t.select(F.lit(k).alias("task_idx"), F.col(key).alias("local")) for k, t in enumerate(tasks)]
    rows = reduce(DataFrame.unionByName, marked)
    return running(rows, [seeded_order(seed, F.concat_ws("/", "task_idx", "local")), F.col("task_idx"), F.col("local")]).withColumnRenamed("pos", "position").drop("upto")


def sequence(tasks: list[DataFrame], key: str) -> DataFrame:
    """The tasks one after the other. Adds task_idx and position."""
    marked = [t.select(F.lit(k).alias("task_idx"), F.col(key).alias("local")) for k, t in enumerate(tasks)]
    return running(reduce(DataFrame.unionByName, marked), [F.col("task_idx"), F.col("local")]).withColumnRenamed("pos", "position").drop("upto")


def few_shot(items: DataFrame, key: str, group: str, k: int, seed: int = 1234) -> DataFrame:
    """(``key``, shot, other): ``k`` other items of the group for each item, those with the least hash after the item's own.

    Items stand on a ring ordered by hash; an item's shots are its successors, so no pair is built. Places come from one
    order over all groups, by ranges, so that no group is sorted in one task. Items without a group have no shots.
    """
    rows = items.select(key, group).where(F.col(group).isNotNull()).withColumn("h", seeded_order(seed, F.col(key)))
    placed = running(rows, [F.col(group), F.col("h"), F.col(key)]).select(key, group, "pos")
    rings = placed.groupBy(group).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    placed = placed.join(rings, group).withColumn("at", F.col("pos") - F.col("first"))
    wanted = placed.withColumn("shot", F.explode(F.sequence(F.lit(1), F.lit(k)))).where("shot < n").withColumn("at", (F.col("at") + F.col("shot")) % F.col("n")).select(group, "at", "shot", F.col(key).alias("asked"))
    return wanted.join(placed.select(group, "at", F.col(key).alias("other")), [group, "at"]).select(F.col("asked").alias(key), "shot", "other")


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def examples(items: DataFrame, shots: DataFrame, key: str, delimiter: Column | str = " ") -> DataFrame:
    """(``key``, examples): each item's solved examples, in the order of ``shots`` (``key``, shot, other), an empty line after each."""
    d = _text(delimiter)
    kind = F.col("icl_task_type")
    solved = (
        F.when(kind == "multiple_choice", F.concat("query", d, F.get("choices", F.col("gold"))))
        .when(kind == "schema", F.concat(F.get("context_options", F.col("gold")), d, F.col("continuation")))
        .when(kind == "language_modeling", F.concat(strip(F.col("context")), d, F.col("continuation")))
    )
    own = shots.join(items.select(F.col(key).alias("other"), F.concat(solved, F.lit("\n\n")).alias("text")), "other")
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot", "text"))), lambda x: x["text"]), "").alias("examples"))


def lm_prompts(context: Column, continuation: Column, delimiter: Column | str = " ", before: Column | str = "") -> tuple[Column, Column]:
    """Prompts without and with the continuation, after the examples ``before``; the context is trimmed, the first prompt stripped."""
    head = F.concat(_text(before), strip(context), _text(delimiter))
    return strip(head), F.concat(head, continuation)


def choice_prompts(query: Column, choices: Column, delimiter: Column | str = " ", before: Column | str = "") -> Column:
    return F.transform(choices, lambda c: F.concat(_text(before), query, _text(delimiter), c))


def schema_prompts(options: Column, continuation: Column, delimiter: Column | str = " ", before: Column | str = "") -> Column:
    return F.transform(options, lambda c: F.concat(_text(before), c, _text(delimiter), continuation))


def spelling_transcript(word: Column, letter: Column) -> Column:
    """Letter by letter, with the count after each hit."""
    letters = characters(word)

    def line(c: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(":"), c)
        hits = count_letter(F.substring(word, F.lit(1), i + 1), letter)
        return F.when(c == letter, F.concat(head, F.lit(" hit! count="), hits.cast("string"))).otherwise(head)

    return F.array_join(F.transform(letters, line), "\n")


#: The texts around a spelled count, and the prompt of plain spelling.
SPELLING = {
    "ask": "We are asked to find the number '%s' in the word '%s'. Let me try a manual approach first.\n\nFirst spell the word out:\n",
    "count": "\n\nThen count the occurrences of '%s':\n", "sum": "\n\nThis gives us %d.", "check": "\n\nLet me double check this using Python:\n\n", "call": "'%s'.count('%s')",
    "answer": "\n\nPython gives us %d.\n\nMy final answer is:\n\n#### %d", "spell": "Spell the word: %s",
}


def spelled(word: Column) -> Column:
    """A word and its letters, one by one."""
    return F.concat(word, F.lit(":"), F.array_join(characters(word), ","))


def spelling_parts(word: Column, letter: Column) -> Column:
    """The whole answer to how often a letter is in a word: counted by hand, then by a call, with its output and the final answer."""
    n = count_letter(word, letter)
    by_hand = F.concat(F.format_string(SPELLING["ask"], letter, word), spelled(word), F.format_string(SPELLING["count"], letter), spelling_transcript(word, letter), F.lit("\n"), F.format_string(SPELLING["sum"].removeprefix("\n"), n))
    parts = [("text", by_hand), ("text", F.lit(SPELLING["check"])), ("python", F.format_string(SPELLING["call"], word, letter)), ("python_output", n.cast("string")), ("text", F.format_string(SPELLING["answer"], n, n))]
    return F.array(*(F.struct(F.lit(kind).alias("type"), text.alias("text")) for kind, text in parts))


def spelling_conversations(rows: DataFrame, key: str, word: str = "word") -> DataFrame:
    """(``key``, messages): a word to spell, and its letters."""
    return rows.select(key, _talk(F.format_string(SPELLING["spell"], F.col(word)), spelled(F.col(word))).alias("messages"))


def grade_number(reference: Column, answer: Column) -> Column:
    """1 if both texts have the same final answer; no answer equals no answer."""
    return final_answer(reference).eqNullSafe(final_answer(answer)).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common head of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def _talk(question: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def labelled_conversations(rows: DataFrame) -> DataFrame:
    """(messages, letters) of questions whose choices carry labels; an answer outside them is an error."""
    from quern.functions.text import render_choices

    letters, answer = F.col("choices")["label"], F.col("answerKey")
    checked = F.when(F.array_contains(letters, answer), answer).otherwise(F.raise_error(F.concat(F.lit("no such letter: "), F.coalesce(answer, F.lit("null")))).cast("string"))
    return rows.select(_talk(render_choices(F.col("question"), letters, F.col("choices")["text"]), checked).alias("messages"), letters.alias("letters"))


def indexed_conversations(rows: DataFrame) -> DataFrame:
    """(messages, letters, subject) of questions with four choices and the place of the answer."""
    from quern.functions.text import render_choices

    letters = F.array(*map(F.lit, "ABCD"))
    question = F.when(F.size("choices") == 4, render_choices(F.col("question"), letters, F.col("choices"))).otherwise(F.raise_error(F.lit("four choices are needed")).cast("string"))
    return rows.select(_talk(question, F.get(letters, F.col("answer"))).alias("messages"), letters.alias("letters"), "subject")


def program_conversations(rows: DataFrame) -> DataFrame:
    """(messages, entry_point, test): a prompt, and the prompt with its solution."""
    return rows.select(_talk(F.col("prompt"), F.concat("prompt", F.lit("\n"), "canonical_solution")).alias("messages"), "entry_point", "test")


def problem_conversations(rows: DataFrame) -> DataFrame:
    """(question, parts, messages): a word problem with its calls split out, as a conversation whose answer has parts."""
    from quern.functions.text import tool_parts

    no = F.lit(None).cast("array<struct<type: string, text: string>>")
    ask = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), no.alias("parts"))
    say = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), tool_parts(F.col("answer")).alias("parts"))
    return rows.select("question", tool_parts(F.col("answer")).alias("parts"), F.array(ask, say).alias("messages"))


def diverse(df: DataFrame, key: str, dimensions: dict[str, list[str]], seed: str = "d") -> DataFrame:
    """Adds one value of each dimension to each row, chosen by the hash of its key."""
    return df.select("*", *(F.get(F.array(*map(F.lit, values)), pick(f"{seed}:{name}", F.col(key), len(values))).alias(name) for name, values in dimensions.items()))


def diverse_by_category(df: DataFrame, key: str, name: str, categories: dict[str, list[str]], seed: str = "d", most: int = 1) -> DataFrame:
    """Adds a category and ``most`` of its values, chosen by the hash of the key: each category is as likely, however many values it has."""
    names = list(categories)
    lists = F.array(*(F.array(*map(F.lit, categories[c])) for c in names))
    place = pick(f"{seed}:{name}:category", F.col(key), len(names))
    own = F.get(lists, F.col("_place"))
    values = [F.get(own, (_roll(f"{seed}:{name}:{k}", F.col(key)) % F.size(own)).cast("int")) for k in range(most)]
    out = df.withColumn("_place", place).withColumn(f"{name}_category", F.get(F.array(*map(F.lit, names)), F.col("_place")))
    return out.withColumn(name, values[0] if most == 1 else F.array(*values)).drop("_place")


def _roll(seed: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")


def not_allowed(requested: Column, allowed: list[str]) -> Column:
    """What is asked for but not allowed."""
    return F.array_sort(F.array_except(requested, F.array(*map(F.lit, allowed))))


#: Ways to evaluate the tasks by name: by the letter of greatest score, or by grading what was generated.
KINDS = {"labelled_choice": "categorical", "indexed_choice": "categorical", "word_problem": "generative", "program": "generative", "spelling": "generative"}
