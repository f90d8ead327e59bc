"""Tasks: prompts of evaluation items, word problems, spelling, programs, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tasks as K
from quern.session import table

_ABC = "['A', 'B', 'C', 'D', 'E', 'F']"


def _items(spark, d, kind):
    return table(spark, d, "eval_items").where(F.col("icl_task_type") == kind)


def _letters():
    return F.array(*map(F.lit, "ABCDEF"))


def mc_render(spark, d):
    return _items(spark, d, "multiple_choice").select("item_id", T.render_choices(F.col("query"), _letters(), F.col("choices")).alias("prompt"), F.get(_letters(), F.col("gold")).alias("answer"))


def mc_prompts(spark, d):
    own = _items(spark, d, "multiple_choice").select("item_id", F.posexplode(K.choice_prompts(F.col("query"), F.col("choices"))).alias("option", "prompt"))
    return own


def schema_prompts(spark, d):
    return _items(spark, d, "schema").select("item_id", F.posexplode(K.schema_prompts(F.col("context_options"), F.col("continuation"))).alias("option", "prompt"))


def lm_prompts(spark, d):
    without, with_ = K.lm_prompts(F.col("context"), F.col("continuation"))
    return _items(spark, d, "language_modeling").select("item_id", without.alias("prompt_without"), with_.alias("prompt_with"))


def _with_examples(spark, d):
    items = table(spark, d, "eval_items")
    return items.join(K.examples(items, K.few_shot(items, "item_id", "task", 2), "item_id"), "item_id", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def mc_prompts_fewshot(spark, d):
    """Each option's prompt behind two solved examples of its task, an empty line after each."""
    own = _with_examples(spark, d).where("icl_task_type = 'multiple_choice'")
    return own.select("item_id", F.posexplode(K.choice_prompts(F.col("query"), F.col("choices"), " ", F.col("examples"))).alias("option", "prompt"))


def schema_prompts_fewshot(spark, d):
    own = _with_examples(spark, d).where("icl_task_type = 'schema'")
    return own.select("item_id", F.posexplode(K.schema_prompts(F.col("context_options"), F.col("continuation"), " ", F.col("examples"))).alias("option", "prompt"))


def lm_prompts_fewshot(spark, d):
    without, with_ = K.lm_prompts(F.col("context"), F.col("continuation"), " ", F.col("examples"))
    return _with_examples(spark, d).where("icl_task_type = 'language_modeling'").select("item_id", without.alias("prompt_without"), with_.alias("prompt_with"))


def option_spans(spark, d):
    """Where the options' continuations start and end, in characters: after the common head, or before the common tail."""
    mc = mc_prompts(spark, d).groupBy("item_id").agg(F.collect_list(F.struct("option", F.split("prompt", "").alias("c"))).alias("o"))
    chars = F.transform(F.array_sort("o"), lambda x: x["c"])
    head = F.array_min(F.transform(F.slice(chars, 2, F.size(chars) - 1), lambda c: K.common_prefix(F.get(chars, 0), c)))
    return mc.select("item_id", head.alias("start"), F.transform(chars, lambda c: F.size(c)).alias("ends"))


def schema_spans(spark, d):
    own = schema_prompts(spark, d).groupBy("item_id").agg(F.collect_list(F.struct("option", F.split("prompt", "").alias("c"))).alias("o"))
    chars = F.transform(F.array_sort("o"), lambda x: x["c"])
    tail = F.array_min(F.transform(F.slice(chars, 2, F.size(chars) - 1), lambda c: K.common_suffix(F.get(chars, 0), c)))
    return own.select("item_id", tail.alias("shared"), F.transform(chars, lambda c: F.size(c) - tail).alias("starts"))


def fewshot_pick(spark, d):
    return K.few_shot(table(spark, d, "eval_items"), "item_id", "task", 3)


def gsm_extract(spark, d):
    own = table(spark, d, "chat_messages").where("content like '%####%'").select("conv_id", "turn", T.final_answer(F.col("content")).alias("answer"))
    return own.distinct()


def gsm_parts(spark, d):
    own = table(spark, d, "chat_messages").where("content like '%<<%'").select("conv_id", "turn", "content").distinct()
    return own.select("conv_id", "turn", F.posexplode(T.tool_parts(F.col("content"))).alias("part", "p")).select("conv_id", "turn", "part", "p.type", "p.text")


def gsm_grade(spark, d):
    """Each conversation's last answer graded against its first: equal final numbers, or none in both."""
    own = table(spark, d, "chat_messages").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("content", F.struct("turn", "content")).alias("a"), F.max_by("content", F.struct("turn", "content")).alias("b"))
    return own.select("conv_id", K.grade_number(F.col("a"), F.col("b")).alias("correct"))


def _vocabulary(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("word")).where("length(word) > 0")


def letter_counts(spark, d):
    own = _vocabulary(spark, d).withColumn("letter", F.substring("word", 1, 1))
    return own.select("p_partkey", "letter", T.count_letter(F.col("word"), F.col("letter")).alias("n"))


def spell_words(spark, d):
    return _vocabulary(spark, d).select("p_partkey", F.concat("word", F.lit(":"), F.array_join(T.characters(F.col("word")), ",")).alias("spelled"))


def spell_transcript(spark, d):
    own = _vocabulary(spark, d).withColumn("letter", F.substring("word", 2, 1))
    return own.where("length(word) > 1").select("p_partkey", K.spelling_transcript(F.col("word"), F.col("letter")).alias("transcript"))


def spell_talks(spark, d):
    """The parts of the answer to how often a word's second letter is in it."""
    own = _vocabulary(spark, d).where("length(word) > 1").withColumn("letter", F.substring("word", 2, 1))
    return own.select("p_partkey", F.posexplode(K.spelling_parts(F.col("word"), F.col("letter"))).alias("part", "p")).select("p_partkey", "part", "p.type", "p.text")


def spell_simple(spark, d):
    got = K.spelling_conversations(_vocabulary(spark, d), "p_partkey")
    return got.select("p_partkey", F.inline("messages"))


def category_prompts(spark, d):
    """A topic of a category, and two first messages of another one, for each customer."""
    topics = {"setup": ["install", "data", "cost"], "limits": ["length"], "history": ["origin", "name"]}
    openers = {"greeting": ["hi", "hello"], "question": ["who are you", "what is this", "can you code"]}
    own = K.diverse_by_category(table(spark, d, "customer").select("c_custkey"), "c_custkey", "topic", topics)
    own = K.diverse_by_category(own, "c_custkey", "first", openers, most=2)
    return own.select("c_custkey", "topic_category", "topic", "first_category", F.array_join("first", "|").alias("first"))


def spell_prompts(spark, d):
    own = _vocabulary(spark, d)
    key = F.col("p_partkey")
    letter = F.when(K.pick("in", key, 10) < 9, F.substring("word", K.pick("letter", key, 1_000_003) % F.length("word") + 1, F.lit(1))).otherwise(F.substring(F.lit(K.LETTERS), K.pick("any", key, 26) + 1, F.lit(1)))
    template = F.get(F.array(*map(F.lit, K.TEMPLATES)), K.pick("template", key, len(K.TEMPLATES)))
    template = F.when(K.pick("lower", key, 10) < 3, F.lower(template)).otherwise(template)
    quotes = F.array(F.lit(""), F.lit("'"), F.lit('"'))
    quote = lambda name: F.get(quotes, K.pick(name, key, 3))
    own = own.select("p_partkey", "word", letter.alias("letter"), template.alias("t"), quote("lq").alias("lq"), quote("wq").alias("wq"), K.pick("mark", key, 2).alias("mark"))
    prompt = F.replace(F.replace("t", F.lit("{letter}"), F.concat("lq", "letter", "lq")), F.lit("{word}"), F.concat("wq", "word", "wq"))
    return own.select("p_partkey", "letter", F.concat(prompt, F.when(F.col("mark") == 0, "?").otherwise("")).alias("prompt"), T.count_letter(F.col("word"), F.col("letter")).alias("answer"))


def code_block_extract(spark, d):
    own = table(spark, d, "documents").where("text like '%```%'")
    return own.select("doc_id", F.length(T.program_of(F.col("text"))).alias("chars"), F.md5(T.program_of(F.col("text")).cast("binary")).alias("code"))


def import_extract(spark, d):
    own = table(spark, d, "documents").where("text like '%import %'")
    return own.select("doc_id", T.leading_imports(F.col("text")).alias("imports"))


def program_assembly(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.concat(F.lit("import math\n# "), "p_name", F.lit("\ndef f():")).alias("prompt"), F.concat(F.lit("```python\nreturn "), F.col("p_size").cast("string"), F.lit("\n```")).alias("answer"))
    whole = F.concat(T.leading_imports(F.col("prompt")), F.lit("\n\n"), T.program_of(F.col("answer")), F.lit("\n\nassert True\ncheck(f)"))
    return own.select("p_partkey", whole.alias("program"))


def _three(spark, d):
    nation, region, supplier = (table(spark, d, t).select(F.col(c).cast("long").alias("k")) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")))
    return [nation, supplier, region, region]


def task_mixture(spark, d):
    return K.mixture(_three(spark, d), "k")


def task_sequence(spark, d):
    return K.sequence(_three(spark, d), "k")


def diverse_prompts(spark, d):
    """A topic, a persona and a manner for each customer."""
    dims = {"topic": ["history", "limits", "cost"], "persona": ["child", "engineer"], "manner": ["short", "long", "joke", "plain"]}
    return K.diverse(table(spark, d, "customer").select("c_custkey"), "c_custkey", dims)


def invalid_modes(spark, d):
    own = table(spark, d, "nation").select("n_nationkey", F.split(F.lower("n_name"), "").alias("asked"))
    return own.select("n_nationkey", F.array_join(K.not_allowed(F.col("asked"), list("aeiou ")), ",").alias("invalid"))


_MC = "(SELECT * FROM eval_items WHERE icl_task_type = 'multiple_choice')"
_SC = "(SELECT * FROM eval_items WHERE icl_task_type = 'schema')"
_LM = "(SELECT * FROM eval_items WHERE icl_task_type = 'language_modeling')"
_VOC = "(SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS word FROM part WHERE length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) > 0)"
_UNION = "(SELECT 0 AS task_idx, n_nationkey::BIGINT AS local FROM nation UNION ALL SELECT 1, s_suppkey::BIGINT FROM supplier UNION ALL SELECT 2, r_regionkey::BIGINT FROM region UNION ALL SELECT 3, r_regionkey::BIGINT FROM region)"
_ENDS = "list_transform(choices, lambda c: (length(query) + 1 + length(c))::INT)"


def _pick(seed, n, key="p_partkey"):
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 7))::BIGINT) % {n})"


_TEMPLATES = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in K.TEMPLATES) + "]"
_LETTER = f"CASE WHEN {_pick('in', 10)} < 9 THEN substr(word, ({_pick('letter', 1_000_003)} % length(word) + 1)::BIGINT, 1) ELSE substr('{K.LETTERS}', ({_pick('any', 26)} + 1)::BIGINT, 1) END"
_Q = "['', '''', '\"']"

_TAIL = "reverse(c || ' ' || continuation)"
_STRIP = r"regexp_replace({x}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"
_BLOCK = r"'(?s)```(?:python)?\s*\n(.*?)\n```'"
_CODE = _STRIP.format(x=f"CASE WHEN regexp_matches(text, {_BLOCK}) THEN regexp_extract(text, {_BLOCK}, 1) ELSE text END")

#: The two items after each on its task's ring, solved.
_EXAMPLES = """WITH r AS (SELECT item_id, task, row_number() OVER (PARTITION BY task ORDER BY md5('1234:' || item_id), item_id) - 1 AS at, count(*) OVER (PARTITION BY task) AS n,
        CASE icl_task_type WHEN 'multiple_choice' THEN query || ' ' || choices[gold + 1] WHEN 'schema' THEN context_options[gold + 1] || ' ' || continuation ELSE trim(context) || ' ' || continuation END || chr(10) || chr(10) AS text FROM eval_items),
    x AS (SELECT a.item_id, string_agg(b.text, '' ORDER BY s.shot) AS x FROM r a, range(1, 3) s(shot), r b WHERE a.task = b.task AND s.shot < a.n AND b.at = (a.at + s.shot) % a.n GROUP BY a.item_id),
    e AS (SELECT i.*, coalesce(x, '') AS x FROM eval_items i LEFT JOIN x USING (item_id))"""

QUERIES = {
    "mc_prompts_fewshot": (mc_prompts_fewshot, f"{_EXAMPLES} SELECT item_id, unnest(range(0, len(choices)))::INT AS option, unnest(list_transform(choices, lambda c: x || query || ' ' || c)) AS prompt FROM e WHERE icl_task_type = 'multiple_choice'"),
    "schema_prompts_fewshot": (schema_prompts_fewshot, f"{_EXAMPLES} SELECT item_id, unnest(range(0, len(context_options)))::INT AS option, unnest(list_transform(context_options, lambda c: x || c || ' ' || continuation)) AS prompt FROM e WHERE icl_task_type = 'schema'"),
    "lm_prompts_fewshot": (lm_prompts_fewshot, f"{_EXAMPLES} SELECT item_id, trim(x || trim(context) || ' ', ' ' || chr(10)) AS prompt_without, x || trim(context) || ' ' || continuation AS prompt_with FROM e WHERE icl_task_type = 'language_modeling'"),
    "mc_render": (mc_render, f"SELECT item_id, 'Multiple Choice question: ' || query || chr(10) || list_aggregate(list_transform(range(1, len(choices) + 1), lambda i: '- ' || choices[i] || '=' || {_ABC}[i] || chr(10)), 'string_agg', '') || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt, {_ABC}[gold + 1] AS answer FROM {_MC}"),
    "mc_prompts": (mc_prompts, f"SELECT item_id, unnest(range(0, len(choices)))::INT AS option, unnest(list_transform(choices, lambda c: query || ' ' || c)) AS prompt FROM {_MC}"),
    "schema_prompts": (schema_prompts, f"SELECT item_id, unnest(range(0, len(context_options)))::INT AS option, unnest(list_transform(context_options, lambda c: c || ' ' || continuation)) AS prompt FROM {_SC}"),
    "lm_prompts": (lm_prompts, f"SELECT item_id, trim(trim(context) || ' ') AS prompt_without, trim(context) || ' ' || continuation AS prompt_with FROM {_LM}"),
    "option_spans": (option_spans, f"SELECT item_id, (length(query) + 1 + list_min(list_transform(choices[2:], lambda c: coalesce(list_filter(range(1, least(length(c), length(choices[1])) + 1), lambda i: c[i] <> choices[1][i])[1] - 1, least(length(c), length(choices[1]))))))::INT AS start, {_ENDS} AS ends FROM {_MC}"),
    "schema_spans": (schema_spans, f"WITH o AS (SELECT item_id, list_transform(context_options, lambda c: {_TAIL}) AS r FROM {_SC}), t AS (SELECT item_id, r, list_min(list_transform(r[2:], lambda x: coalesce(list_filter(range(1, least(length(x), length(r[1])) + 1), lambda i: x[i] <> r[1][i])[1] - 1, least(length(x), length(r[1]))))) AS shared FROM o) SELECT item_id, shared::INT AS shared, list_transform(r, lambda x: (length(x) - shared)::INT) AS starts FROM t"),
    "fewshot_pick": (fewshot_pick, "WITH p AS (SELECT item_id, task, row_number() OVER (PARTITION BY task ORDER BY md5('1234:' || item_id), item_id) - 1 AS at, count(*) OVER (PARTITION BY task) AS n FROM eval_items) SELECT a.item_id, s.shot::INT AS shot, b.item_id AS other FROM p a, range(1, 4) s(shot), p b WHERE a.task = b.task AND s.shot < a.n AND b.at = (a.at + s.shot) % a.n"),
    "gsm_extract": (gsm_extract, r"SELECT DISTINCT conv_id, turn, nullif(replace(regexp_extract(content, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS answer FROM chat_messages WHERE content LIKE '%####%'"),
    "gsm_parts": (gsm_parts, """WITH m AS (SELECT DISTINCT conv_id, turn, content FROM chat_messages WHERE content LIKE '%<<%'),
        s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(content, '(<<[^>]+>>)', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS x, unnest(range(0, len(string_split(regexp_replace(content, '(<<[^>]+>>)', chr(1) || '\\1' || chr(1), 'g'), chr(1))))) AS k FROM m),
        p AS (SELECT conv_id, turn, k, 0 AS j, CASE WHEN regexp_full_match(x, '<<[^>]+>>') THEN 'python' ELSE 'text' END AS type, CASE WHEN regexp_full_match(x, '<<[^>]+>>') THEN CASE WHEN contains(x, '=') THEN regexp_extract(x, '<<(.*)=', 1) ELSE x[3:-3] END ELSE x END AS text FROM s
              UNION ALL SELECT conv_id, turn, k, 1, 'python_output', CASE WHEN contains(x, '=') THEN regexp_extract(x, '=([^=]*)>>', 1) ELSE '' END FROM s WHERE regexp_full_match(x, '<<[^>]+>>'))
        SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, j) - 1)::INT AS part, type, text FROM p"""),
    "gsm_grade": (gsm_grade, r"WITH a AS (SELECT conv_id, arg_min(content, (turn, content)) AS a, arg_max(content, (turn, content)) AS b FROM chat_messages WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, (nullif(replace(regexp_extract(a, '#### (-?[0-9.,]+)', 1), ',', ''), '') IS NOT DISTINCT FROM nullif(replace(regexp_extract(b, '#### (-?[0-9.,]+)', 1), ',', ''), ''))::INT AS correct FROM a"),
    "letter_counts": (letter_counts, f"SELECT p_partkey, word[1] AS letter, (length(word) - length(replace(word, word[1], '')))::INT AS n FROM {_VOC}"),
    "spell_words": (spell_words, f"SELECT p_partkey, word || ':' || list_aggregate(string_split(word, ''), 'string_agg', ',') AS spelled FROM {_VOC}"),
    "spell_transcript": (spell_transcript, f"SELECT p_partkey, list_aggregate(list_transform(range(1, length(word) + 1), lambda i: i || ':' || word[i] || CASE WHEN word[i] = word[2] THEN ' hit! count=' || (i - length(replace(word[1:i], word[2], ''))) ELSE '' END), 'string_agg', chr(10)) AS transcript FROM {_VOC} WHERE length(word) > 1"),
    "spell_talks": (spell_talks, f"""WITH v AS (SELECT p_partkey, word, word[2] AS c, (length(word) - length(replace(word, word[2], '')))::INT AS n FROM {_VOC} WHERE length(word) > 1),
        t AS (SELECT *, list_aggregate(list_transform(range(1, length(word) + 1), lambda i: i || ':' || word[i] || CASE WHEN word[i] = c THEN ' hit! count=' || (i - length(replace(word[1:i], c, ''))) ELSE '' END), 'string_agg', chr(10)) AS steps FROM v)
        SELECT p_partkey, 0 AS part, 'text' AS type, printf('We are asked to find the number ''%s'' in the word ''%s''. Let me try a manual approach first.', c, word) || chr(10) || chr(10) || 'First spell the word out:' || chr(10) || word || ':' || list_aggregate(string_split(word, ''), 'string_agg', ',') || chr(10) || chr(10) || printf('Then count the occurrences of ''%s'':', c) || chr(10) || steps || chr(10) || chr(10) || printf('This gives us %d.', n) AS text FROM t
        UNION ALL SELECT p_partkey, 1, 'text', chr(10) || chr(10) || 'Let me double check this using Python:' || chr(10) || chr(10) FROM v UNION ALL SELECT p_partkey, 2, 'python', chr(39) || word || chr(39) || '.count(' || chr(39) || c || chr(39) || ')' FROM v UNION ALL SELECT p_partkey, 3, 'python_output', n::VARCHAR FROM v
        UNION ALL SELECT p_partkey, 4, 'text', chr(10) || chr(10) || printf('Python gives us %d.', n) || chr(10) || chr(10) || 'My final answer is:' || chr(10) || chr(10) || printf('#### %d', n) FROM v"""),
    "spell_simple": (spell_simple, f"SELECT p_partkey, 'user' AS role, 'Spell the word: ' || word AS content FROM {_VOC} UNION ALL SELECT p_partkey, 'assistant', word || ':' || list_aggregate(string_split(word, ''), 'string_agg', ',') FROM {_VOC}"),
    "category_prompts": (category_prompts, f"WITH c AS (SELECT c_custkey, {_pick('d:topic:category', 3, 'c_custkey')} + 1 AS t, {_pick('d:first:category', 2, 'c_custkey')} + 1 AS f, {_pick('d:topic:0', 10**9, 'c_custkey')} AS x, {_pick('d:first:0', 10**9, 'c_custkey')} AS y, {_pick('d:first:1', 10**9, 'c_custkey')} AS z FROM customer), l AS (SELECT *, [['install', 'data', 'cost'], ['length'], ['origin', 'name']][t] AS tl, [['hi', 'hello'], ['who are you', 'what is this', 'can you code']][f] AS fl FROM c) SELECT c_custkey, ['setup', 'limits', 'history'][t] AS topic_category, tl[x % len(tl) + 1] AS topic, ['greeting', 'question'][f] AS first_category, fl[y % len(fl) + 1] || '|' || fl[z % len(fl) + 1] AS first FROM l"),
    "spell_prompts": (spell_prompts, f"WITH p AS (SELECT p_partkey, word, {_LETTER} AS letter, {_TEMPLATES}[{_pick('template', len(K.TEMPLATES))} + 1] AS t, {_Q}[{_pick('lq', 3)} + 1] AS lq, {_Q}[{_pick('wq', 3)} + 1] AS wq, {_pick('mark', 2)} AS mark, {_pick('lower', 10)} AS low FROM {_VOC}) SELECT p_partkey, letter, replace(replace(CASE WHEN low < 3 THEN lower(t) ELSE t END, '{{letter}}', lq || letter || lq), '{{word}}', wq || word || wq) || CASE WHEN mark = 0 THEN '?' ELSE '' END AS prompt, (length(word) - length(replace(word, letter, '')))::INT AS answer FROM p"),
    "code_block_extract": (code_block_extract, f"SELECT doc_id, length({_CODE})::INT AS chars, md5({_CODE}) AS code FROM documents WHERE text LIKE '%```%'"),
    "import_extract": (import_extract, f"WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(x='x')}) AS l FROM documents WHERE text LIKE '%import %'), s AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: x <> '' AND NOT starts_with(x, 'import ') AND NOT starts_with(x, 'from ') AND NOT starts_with(x, '#')), true) AS stop FROM l) SELECT doc_id, coalesce(array_to_string(list_filter(CASE WHEN stop > 0 THEN l[1 : stop - 1] ELSE l END, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ')), chr(10)), '') AS imports FROM s"),
    "program_assembly": (program_assembly, "SELECT p_partkey, 'import math' || chr(10) || chr(10) || 'return ' || p_size || chr(10) || chr(10) || 'assert True' || chr(10) || 'check(f)' AS program FROM part"),
    "task_mixture": (task_mixture, f"SELECT task_idx, local, row_number() OVER (ORDER BY md5('42:' || task_idx || '/' || local), task_idx, local) - 1 AS position FROM {_UNION}"),
    "task_sequence": (task_sequence, f"SELECT task_idx, local, row_number() OVER (ORDER BY task_idx, local) - 1 AS position FROM {_UNION}"),
    "diverse_prompts": (diverse_prompts, f"SELECT c_custkey, ['history', 'limits', 'cost'][{_pick('d:topic', 3, 'c_custkey')} + 1] AS topic, ['child', 'engineer'][{_pick('d:persona', 2, 'c_custkey')} + 1] AS persona, ['short', 'long', 'joke', 'plain'][{_pick('d:manner', 4, 'c_custkey')} + 1] AS manner FROM customer"),
    "invalid_modes": (invalid_modes, "SELECT n_nationkey, coalesce(array_to_string(list_sort(list_filter(list_distinct(string_split(lower(n_name), '')), lambda c: c NOT IN ('a', 'e', 'i', 'o', 'u', ' '))), ','), '') AS invalid FROM nation"),
}
