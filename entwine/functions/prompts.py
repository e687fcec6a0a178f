"""Instructions, chat templates and example records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: texts and templates that a model was or will be trained with ---------------------

#: The instructions, as they stand, by number.
INSTRUCTIONS = {
    1: """\
The text is in {language}.
You are a coreference resolver.
Rewrite the sentence considering these rules:
Mentions are in <m>...</m>#MASK format.
Group the mentions that refer to same real-world entity.
If mentions refer to same thing write the same number instead of MASK.
If mentions represent different things write another number.
Where you see </z>@ there is a zero mention, which is normally not written but you also need to link them with other mentions.""",
    2: """\
Identify instances of coreference where different mentions refer to the same entity.
Rewrite the passage, tagging each term with a unique identifier and indicating coreferential relationships.
Ensure accuracy and consider context.
Fill MASK with unique number for every entity. Be sure that they represent exactly the same entity, not similar.
Example output format:
... <m>Bertrand Russell </m>#MASK is a good author, I love <m>The History of Western Philosophy </m>#MASK ...
... <m>Bertrand Russell </m>#0 is a good author, I love <m>The History of Western Philosophy </m>#1 ...
Where you see </z>@ there is a zero mention, which is normally not written but you also need to link them with other mentions.""",
    3: """\
For every mention in <m> </m> tags examine if there is any coreferential/coherent mention.
If two mentions represent the same entity write the same number instead of MASK after closing mention tag </m>.
Do not change anything else other than MASK.
Where you see </z>@ there is a zero mention, which is normally not written but you also need to link them with other mentions.""",
    4: """\
For every mention in <m> </m> tags examine if there is any coreferential mention.
If two mentions represent the same entity write the same number instead of MASK after closing mention tag </m>.
For example: author and book represent different entities.
Do not change anything else other than MASK.
Where you see </z>@ there is a zero mention, which is normally not written but you also need to link them with other mentions.""",
    5: """\
For every mention in <m> </m> tags examine if there is any coreferential/coherent mention.
If two mentions represent the same entity write the same number instead of MASK after closing mention tag </m>.
For example: author and book represent different entities.
Do not change anything else other than MASK.
Where you see </z>@ there is a zero mention, which is normally not written but you also need to link them with other mentions.""",
}
DEFAULT_INSTRUCTION = 5
NO_LANGUAGE = "the given language"

#: family -> (system, user, assistant before, assistant after, end of sequence)
TEMPLATES = {
    "chatml": ("<|im_start|>system\n{}<|im_end|>\n", "<|im_start|>user\n{}<|im_end|>\n", "<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>"),
    "llama3": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{}<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|>",
        "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|eot_id|>",
    ),
    "mistral": ("<s>[INST] {}\n\n", "{} [/INST]", " ", "</s>", "</s>"),
    "gemma": ("<bos><start_of_turn>user\n{}\n\n", "{}<end_of_turn>\n", "<start_of_turn>model\n", "<end_of_turn>\n", "<eos>"),
}

#: What may open a response, in the order in which it is looked for.
RESPONSE_MARKS = ("<|start_header_id|>assistant<|end_header_id|>\n\n", "[/INST]", "<start_of_turn>model\n", "### Response:\n", "<|im_start|>assistant\n")

# -----------------------------------------------------------------------------------------------------


def instruction(number: Column | int, language: Column | str | None = None) -> Column:
    """The instruction of a number (the default for unknown ones) with the language filled in."""
    n = F.lit(number) if isinstance(number, int) else number
    table = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    said = F.lit(language) if language is None or isinstance(language, str) else language
    name = F.coalesce(F.nullif(said.cast("string"), F.lit("")), F.lit(NO_LANGUAGE))
    return F.replace(F.coalesce(F.try_element_at(table, n), F.lit(INSTRUCTIONS[DEFAULT_INSTRUCTION])), F.lit("{language}"), name)


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after))


def prompt_prefix(system: Column, user: Column, family: str) -> Column:
    """System and user turn, and what opens the response."""
    s, u, opens, _, _ = TEMPLATES[family]
    return F.concat(_filled(s, system), _filled(u, user), F.lit(opens))


def training_text(system: Column, user: Column, assistant: Column, family: str, add_eos: bool = True) -> Column:
    """All three turns; the end-of-sequence sign is added where the text doesn't end with it."""
    *_, closes, eos = TEMPLATES[family]
    text = F.concat(prompt_prefix(system, user, family), F.coalesce(assistant, F.lit("")), F.lit(closes))
    return F.when(~text.endswith(eos), F.concat(text, F.lit(eos))).otherwise(text) if add_eos else text


def response_mark(rendered: str) -> str | None:
    """The first known opening of a response that a rendered dialogue holds."""
    return next((m for m in RESPONSE_MARKS if m in rendered), None)


def _json(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    return F.col(c) if kind == "string" else F.to_json(c)


RECORD = ("doc_id", "language", "instruction", "input", "output", "before_mentions", "after_mentions", "before_sent_indices", "after_sent_indices")


def example_records(examples: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Examples as records: masked_input becomes input, nested fields become JSON texts; more: columns that stay as they are."""
    key = [c for c in ("example_id", *(more or [])) if c in examples.columns]
    return examples.select(*key, "doc_id", "language", "instruction", F.col("masked_input").alias("input"), "output", *[_json(examples, c).alias(c) for c in RECORD[5:]])


def pair_examples(pairs: DataFrame, number: int = DEFAULT_INSTRUCTION) -> DataFrame:
    """Pairs (with doc_id and lang) as examples with their instruction."""
    return pairs.withColumn("language", F.col("lang")).withColumn("instruction", instruction(number, F.col("lang"))).drop("lang")
